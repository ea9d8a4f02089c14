import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import statespace
from chronoloom.functions.spec import Spec
from chronoloom.operators.series import ar1_least_squares
from chronoloom.sources.panel import bucketed
from chronoloom.streaming.panel import running_ar1, running_filter, stream_buckets


def run(df, name, mode, folder):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_running_estimate_ends_at_least_squares(spark, tmp_path):
    rows = [(k, t, float((t * 37 + k * 11) % 17)) for k in range(3) for t in range(90)]
    panel = spark.createDataFrame(rows, "id long, t int, y double")
    for i in range(3):
        panel.where(f"t between {30 * i} and {30 * i + 29}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(panel.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(running_ar1(stream, "id"), "running", "update", tmp_path / "c1")
    last = {r.key: r for r in got.groupBy("key").agg(F.max_by(F.struct("*"), "n_obs").alias("r")).select("r.*").collect()}
    want = {r.id: r for r in ar1_least_squares(panel, ["id"]).collect()}
    for k, w in want.items():
        assert (last[k].n_obs, last[k].phi, last[k].scale) == (90, pytest.approx(w.phi), pytest.approx(w.scale))


def test_stream_buckets_equal_batch_buckets(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = run(stream_buckets(stream, ["event_type"], "ts", "1 day", "40 days", "value"), "buckets", "complete", tmp_path / "c2")
    want = bucketed(events, ["event_type"], F.col("ts"), "day", {"y": F.sum("value")})
    plain = lambda df: sorted((r.event_type, r.bucket, round(r.y, 6)) for r in df.collect())
    assert plain(got) == plain(want)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("spec, params", [(Spec.of((1, 1, 1)), [0.5, -0.3]), (Spec.of((2, 0, 0), concentrate_scale=False), [0.4, 0.2, 30.0])])
def test_running_filter_ends_where_the_batch_filter_does(spark, rocksdb, tmp_path, spec, params):
    """Over two runs from one checkpoint, with rows out of order, one too late and one that is no number."""
    value = lambda k, t: float((t * 37 + k * 11) % 17)
    shuffled = [[(k, t ^ 1, value(k, t ^ 1)) for t in range(a, a + 20) for k in range(3)] for a in (0, 20, 40)]
    shuffled[1].append((0, 25.5, float("nan")))
    shuffled[2].append((1, 2.5, 99.0))  # long past the watermark
    shuffled.append([(k, 500, 1.0) for k in range(3)])  # stays waiting
    schema = "id long, ts timestamp, y double"

    def add(i):
        rows = spark.createDataFrame([(k, 86400 + t * 60.0, y) for k, t, y in shuffled[i]], "id long, s double, y double")
        rows.select("id", F.timestamp_seconds("s").alias("ts"), "y").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = running_filter(stream, "id", "ts", "5 minutes", spec, params).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c3"))
        out.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    add(0)
    add(1)
    first = go()
    assert first and max(r.n_obs for r in first) < 40
    add(2)
    add(3)
    got = go()
    new = [r for r in got if r not in first]
    assert len(new) < len(got) and min(r.n_obs for r in new) > max(r.n_obs for r in first)  # it went on from the first run's state
    last = {k: max((r for r in got if r.key == k), key=lambda r: r.n_obs) for k in range(3)}
    y = np.array([[value(k, t) for t in range(60)] for k in range(3)])
    given = np.tile(params, (3, 1))
    want, (mean, variance, _) = statespace.run_filter(spec, y, given), statespace.forecast(spec, y, given, 1)
    for k in range(3):
        r = last[k]
        assert r.n_obs == 60 and r.until.timestamp() % 3600 == 59 * 60 % 3600
        assert (r.loglike, r.scale, r.mean, r.variance) == pytest.approx((want["loglike"][k], want["scale"][k], mean[k, 0], variance[k, 0]), rel=1e-8)


def test_running_filter_takes_no_regressors(spark):
    with pytest.raises(ValueError, match="regressors"):
        running_filter(spark.sql("SELECT 1L AS id, now() AS ts, 1D AS y"), "id", "ts", "1 day", Spec.of((1, 0, 0), n_exog=1), [1.0, 0.5])
