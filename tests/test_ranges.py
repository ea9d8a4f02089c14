"""Range windows, Burg and Hannan-Rissanen as aggregates, and folds of low orders, against the array helpers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import estimate, statespace
from chronoloom.functions.spec import Spec
from chronoloom.operators import folds, ranges, series
from chronoloom.sources import panel


def draws():
    rng = np.random.default_rng(1)
    out = {}
    for i, n in enumerate([200, 83, 31, 30, 12, 8]):
        e = rng.standard_normal(n + 20)
        y = np.zeros(n + 20)
        for t in range(13, n + 20):
            y[t] = 0.6 * y[t - 1] + 0.2 * y[t - 12] * (i < 2) + e[t] + 0.4 * e[t - 1]
        out[f"s{i}"] = y[20:] + 3
    return out


@pytest.fixture(scope="module")
def some(spark):
    rows = [(k, t, float(v)) for k, y in draws().items() for t, v in enumerate(y)]
    rows += [(None, t, float(t % 5)) for t in range(40)] + [("const", t, 2.0) for t in range(50)]
    return spark.createDataFrame(rows, "id string, t int, y double").repartition(3).cache()


@pytest.fixture(params=[1 << 16, 7])
def size(request, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", request.param)
    return request.param


def by_id(df, name):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.t):
        out.setdefault(r.id, []).append(r[name])
    return out


def test_lags_and_differences(some, size):
    known = by_id(some, "y")
    told = by_id(ranges.with_lags(some, ["id"], {"b": ("y", 9)}), "b")
    assert told == {k: [None] * min(9, len(y)) + y[:-9] for k, y in known.items()}
    for d, D, s in ((1, 0, 0), (2, 0, 0), (1, 1, 5), (0, 2, 3)):
        got = by_id(series.difference(some, ["id"], d, D, s), "y")
        for k, y in known.items():
            want = np.diff(np.array(y), d)
            for _ in range(D):
                want = want[s:] - want[:-s]
            assert got.get(k, []) == pytest.approx(want.tolist(), abs=1e-9)


def test_a_long_series_is_many_tasks(spark):
    long = spark.range(200_000, numPartitions=4).selectExpr("'hot' as id", "cast(id as int) as t", "double(id % 11) as y")
    told = ranges.with_lags(long, ["id"], {"b": ("y", 3)}, rows=1000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shares = [r["count"] for r in told.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(shares) == 4 and max(shares) < 100_000
    assert told.where("b <> y - 3 and y >= 3").count() == 0 and told.count() == 200_000


def test_numbers_by_spans_are_the_same(spark):
    rows = spark.range(500).selectExpr("id % 3 as id", "timestamp_seconds(1700000000 + id * id * 37 % 900000) as ts", "id as at", "double(id) as y")
    whole = panel.long_panel(rows, ["id"], F.struct("ts", "at"), F.col("y"))
    spans = panel.long_panel(rows, ["id"], F.struct("ts", "at"), F.col("y"), span=F.date_trunc("day", "ts"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, spans.collect()))


@pytest.mark.parametrize("order", [1, 4, 9])
def test_burg_of_any_order(some, size, order):
    got = {r.id: r.ar for r in series.burg(some, ["id"], order).collect()}
    assert got["const"] is None
    for k, y in draws().items():
        want = estimate.burg(y, order)
        assert got[k] == (None if want is None else pytest.approx(want.tolist(), abs=1e-9))


@pytest.mark.parametrize("orders", [((1, 0, 1), (0, 0, 0, 0)), ((2, 0, 1), (0, 0, 0, 0)), ((1, 0, 1), (1, 0, 1, 12))])
def test_hannan_rissanen(some, orders):
    (p, _, q), (P, _, Q, s) = orders
    got = {r.id: list(r)[1:] for r in series.hannan_rissanen(some, ["id"], p, q, P, Q, s).collect()}
    assert set(got) == {*draws(), None, "const"} and got["s0"][0] is not None
    for k, y in draws().items():
        if got[k][0] is not None:
            assert got[k] == pytest.approx(estimate.start_values(Spec.of(*orders), y, None).tolist(), abs=1e-8)


@pytest.fixture(scope="module")
def arrays(some):
    return panel.to_arrays(some.where("id <> 'const'").withColumn("y", F.col("y") - 3), ["id"]).cache()


FOLDS = [((1, 0, 0), [0.6]), ((2, 0, 0), [0.5, 0.2]), ((1, 0, 1), [0.5, 0.3]), ((0, 0, 1), [-0.4]), ((2, 0, 1), [0.3, -0.4, 0.7]), ((1, 1, 0), [0.4])]


@pytest.mark.parametrize("order,params", FOLDS)
@pytest.mark.parametrize("stationary", [True, False])
def test_filter_folds(arrays, order, params, stationary):
    spec = Spec.of(order, enforce_stationarity=stationary)
    got = {r.id: r.loglike for r in folds.loglike_fold(arrays, ["id"], order, params, stationary).collect()}
    for k, y in draws().items():
        want = statespace.loglike(spec, (y - 3)[None], np.array([params]))[0]
        assert got[k] == pytest.approx(want, abs=1e-6)


def test_folds_refuse_what_they_cannot_hold(arrays):
    for order, params in (((2, 1, 0), [0.1, 0.1]), ((1, 0, 0), []), ((0, 0, 2), [0.1, 0.1])):
        with pytest.raises(ValueError):
            folds.loglike_fold(arrays, ["id"], order, params)


def test_the_score_is_the_slope(arrays):
    h = 1e-4
    at = lambda x: {r.id: r for r in folds.ma1_score(arrays, ["id"], x).collect()}
    for x in (-0.7, 0.0, 0.45):
        low, mid, high = at(x - h), at(x), at(x + h)
        for k in mid:
            assert mid[k].score == pytest.approx((high[k].loglike - low[k].loglike) / (2 * h), rel=1e-5, abs=1e-4)
            assert mid[k].curvature == pytest.approx((high[k].score - low[k].score) / (2 * h), rel=1e-5, abs=1e-3)


def test_newton_finds_the_same_optimum(arrays, spark):
    got = {r.id: r for r in folds.fit_ma1_fold(arrays, ["id"]).collect()}
    for k, y in draws().items():
        want = estimate.fit(Spec.of((0, 0, 1)), (y - 3)[None])[0]
        assert got[k].loglike == pytest.approx(want["loglike"], abs=1e-4) and got[k].error is None
        if abs(want["params"][0]) < 0.99:
            assert got[k].theta == pytest.approx(want["params"][0], abs=2e-3) and got[k].converged
            assert got[k].scale == pytest.approx(want["scale"], rel=1e-2)
    none = spark.createDataFrame([("z", [0.0] * 9), ("e", [])], "id string, y array<double>")
    assert {(r.id, r.theta, r.error) for r in folds.fit_ma1_fold(none, ["id"]).collect()} == {("z", None, "the scale is zero"), ("e", None, "the scale is zero")}


@pytest.mark.parametrize("order", range(1, 7))
def test_transforms_round_trip(spark, order):
    rng = np.random.default_rng(order)
    x = rng.standard_normal((20, order)) * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    told = df.select("i", folds.stationary_fold(F.col("x")).alias("c")).select("i", "c", folds.unconstrained_fold(F.col("c")).alias("x")).orderBy("i").collect()
    assert np.array([r.c for r in told]) == pytest.approx(statespace.to_stationary(x), abs=1e-9)
    near = np.abs(x) / np.sqrt(1 + x * x) < 0.9999
    assert np.array([r.x for r in told])[near] == pytest.approx(x[near], rel=1e-5, abs=1e-5)


# The settled filter.


def dense_loglike(theta_poly, y):
    """Of a moving average, by the Gaussian density of the whole series, scale concentrated out."""
    n = len(y)
    acov = np.array([sum(theta_poly[i] * theta_poly[i + k] for i in range(len(theta_poly) - k)) if k < len(theta_poly) else 0.0 for k in range(n)])
    cov = acov[np.abs(np.arange(n)[:, None] - np.arange(n))]
    quad = y @ np.linalg.solve(cov, y)
    return -n / 2 * (math.log(2 * math.pi) + math.log(quad / n) + 1) - np.linalg.slogdet(cov)[1] / 2


@pytest.mark.parametrize("s", [12, 24, 52])
def test_seasonal_likelihoods_do_not_settle_too_soon(s):
    y = np.random.default_rng(s).standard_normal(6 * s + 30)
    spec = Spec.of((0, 0, 1), (0, 0, 1, s))
    for theta, big in ((0.0, -0.6), (0.3, -0.6), (0.9, 0.8)):
        poly = np.convolve([1, theta], [1, *[0] * (s - 1), big])
        assert statespace.loglike(spec, y[None], np.array([[theta, big]]))[0] == pytest.approx(dense_loglike(poly, y), abs=1e-6)


def test_common_factors_and_batch_mates():
    y = np.random.default_rng(3).standard_normal((2, 400))
    spec = Spec.of((1, 0, 1), (1, 0, 1, 12))
    near = np.array([[0.999, -0.999, 0.2, -0.999]])
    free = statespace.loglike(spec, y[:1], near)[0]
    from chronoloom.functions import exact

    assert free == pytest.approx(exact.arma_loglike(spec, y[:1], np.array([400]), near)[0][0], abs=1e-5)
    pair = Spec.of((1, 0, 0), (0, 0, 1, 12))
    both = statespace.loglike(pair, y, np.array([[0.001, -0.6], [0.7, -0.6]]))
    assert [statespace.loglike(pair, y[i : i + 1], np.array([[(0.001, 0.7)[i], -0.6]]))[0] for i in (0, 1)] == pytest.approx(both.tolist(), abs=1e-9)


def test_a_fit_has_the_likelihood_of_its_parameters():
    y = np.cumsum(np.random.default_rng(4).standard_normal(300))
    spec = Spec.of((0, 1, 1), (0, 1, 1, 12))
    got = estimate.fit(spec, y[None], maxiter=80)[0]
    assert statespace.loglike(spec, y[None], np.array([got["params"]]))[0] == pytest.approx(got["loglike"], abs=1e-3)


def test_a_zero_scale_is_an_error():
    assert "scale" in estimate.fit(Spec.of((1, 0, 0)), np.zeros((1, 50)))[0]["error"]
