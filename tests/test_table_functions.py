"""The forecast table function and the checks of future regressors."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chronoloom.functions.spec import Spec
from chronoloom.operators import sarimax, table_functions
from chronoloom.sources import panel


@pytest.fixture(scope="module")
def series(spark):
    table_functions.register(spark)
    rows = [("a", [1.0, 2.0, 1.5, 2.5, 2.0, 3.0, 2.2, 2.8], [0.4, 0.3]), ("nan", [1.0, float("nan")], [0.4, 0.3]), ("none", [1.0, 2.0, 3.0, 1.0], None), ("short", [1.0, 2.0, 1.0, 0.0], [0.4])]
    return spark.createDataFrame(rows, "id string, y array<double>, params array<double>")


def test_it_gives_what_the_operator_gives(spark, series):
    text = "SELECT id, f.* FROM {s} s, LATERAL sarimax_forecast(s.y, s.params, array(1, 1, 1), array(0, 0, 0, 0), 3, 0.1D) f"
    got = {(r.id, r.h): r for r in spark.sql(text, s=series).collect()}
    want = sarimax.forecast(series.select("id", "y"), ["id"], Spec.of((1, 1, 1)), series.select("id", "params"), 3, 0.1).collect()
    for r in want:
        if r.error is None:
            assert tuple(got[r.id, r.h])[2:6] == pytest.approx((r["mean"], r.variance, r.ci_lower, r.ci_upper), rel=1e-9)
    errors = {r.id: r.error for r in got.values() if r.error}
    assert set(errors) == {"nan", "none", "short"} and "NaN" in errors["nan"] and "length" in errors["short"]


@pytest.mark.parametrize("call", [
    "sarimax_forecast(s.y, s.params, array(1, 1), array(0, 0, 0, 0), 3, 0.1D)", "sarimax_forecast(s.y, s.params, array(1, 1, 1), array(0, 0, 0, 0), 3, 1.5D)",
    "sarimax_forecast(s.id, s.params, array(1, 1, 1), array(0, 0, 0, 0), 3, 0.1D)", "sarimax_forecast(s.y, s.params, array(1, 1, 1), array(0, 0, 0, 0), 1000000000, 0.1D)",
])
def test_wrong_arguments_fail_before_the_query_runs(spark, series, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT id, f.* FROM {{s}} s, LATERAL {call} f", s=series)


def test_future_rows_are_checked_by_series(spark):
    rows = [(i, t, 1.0) for i in ("ok", "short", "nan", "twice", "none", None) for t in range(4)]
    past = spark.createDataFrame(rows, "id string, t int, y double")
    future = [("ok", h, float(h)) for h in (1, 2, 3)] + [("short", 1, 1.0), ("nan", 1, 1.0), ("nan", 2, float("inf")), ("twice", 1, 1.0), ("twice", 1, 1.0), ("twice", 2, 1.0)]
    future += [(None, 1, 1.0), (None, 2, None), ("other", 1, 1.0), ("other", 2, 1.0)]
    ahead = spark.createDataFrame(future, "id string, h int, x1 double")
    got = {r.id: (r.n_future, r.error) for r in panel.future_quality(past, ahead, ["id"], ["x1"], 2).collect()}
    assert got == {
        "ok": (2, None), "short": (1, "future_exog has 1 of 2 steps"), "nan": (2, "future_exog contains NaN or Inf"), "twice": (2, "future_exog repeats a step"),
        "none": (0, "future_exog is required"), None: (2, "future_exog contains NaN or Inf"), "other": (2, "no series for this future"),
    }
    packed = {r.id: r.future_x for r in panel.future_arrays(ahead, ["id"], ["x1"], 2).collect()}
    assert packed["ok"] == [[1.0, 2.0]] and packed["short"] == [[1.0]]


def test_long_futures_forecast_like_arrays(spark):
    past = spark.createDataFrame([("a", t, float(t % 3), float(t % 2)) for t in range(12)], "id string, t int, y double, x1 double")
    arrays = panel.to_arrays(past, ["id"], ["x1"])
    ahead = spark.createDataFrame([("a", h, float(h % 2)) for h in (3, 1, 2)], "id string, h int, x1 double")
    spec = Spec.of((1, 0, 0), n_exog=1)
    got = sarimax.forecast(arrays, ["id"], spec, [0.5, 0.2], 3, future=panel.future_arrays(ahead, ["id"], ["x1"], 3)).collect()
    given = arrays.select("id", F.array(F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0))).alias("future_x"))
    assert got == sarimax.forecast(arrays, ["id"], spec, [0.5, 0.2], 3, future=given).collect() and got[0].error is None
