"""The panel operators: errors stay with their series, pairing, intervals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import estimate, statespace
from chronoloom.functions.spec import Spec
from chronoloom.operators import sarimax, series
from chronoloom.operators.model import SarimaxPanel
from chronoloom.sources import panel

AR1 = Spec.of((1, 0, 0))


@pytest.fixture(scope="module")
def arrays(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=60).cumsum().tolist()) for i in range(4)]
    rows += [(4, [1.0, 2.0]), (5, [1.0, float("nan"), 2.0, 3.0]), (6, None), (7, []), (8, [1.0, None, 3.0, 4.0])]
    return spark.createDataFrame(rows, "id int, y array<double>")


def test_errors_stay_with_their_series(arrays):
    got = {r.id: r for r in sarimax.fit(arrays, ["id"], AR1).collect()}
    assert all(got[i].error is None and got[i].converged for i in range(4))
    assert "too few" in got[4].error and "NaN or Inf" in got[5].error and "too few" in got[6].error and "too few" in got[7].error and "NaN" in got[8].error


def test_an_empty_panel_gives_an_empty_result(arrays):
    assert sarimax.fit(arrays.where("false"), ["id"], AR1).collect() == []


def test_arguments_are_checked(arrays):
    for alpha in (0, 1, -0.5):
        with pytest.raises(ValueError, match="alpha"):
            sarimax.forecast(arrays, ["id"], AR1, [0.5], alpha=alpha)
    with pytest.raises(ValueError, match="forecast steps requested"):
        sarimax.forecast(arrays, ["id"], AR1, [0.5], 10_001)
    with pytest.raises(ValueError, match="future_exog is required"):
        sarimax.forecast(arrays, ["id"], Spec.of((1, 0, 0), n_exog=1), [1.0, 0.5])
    with pytest.raises(RuntimeError):
        sarimax.fit(arrays, ["id"], AR1, method="newton")
    with pytest.raises(ValueError, match="parameter length mismatch"):
        sarimax.fit(arrays, ["id"], AR1, start_params=[0.1, 0.2])


def test_series_without_parameters_and_the_other_way(arrays, spark):
    params = spark.createDataFrame([(0, [0.5]), (1, [0.5, 0.1]), (99, [0.1])], "id int, params array<double>")
    got = {r.id: r for r in sarimax.loglike(arrays.where("id < 3"), ["id"], AR1, params).collect()}
    assert got[0].error is None and "mismatch" in got[1].error and "no parameters" in got[2].error
    assert {r.id for r in panel.unpaired(arrays.where("id < 3"), params, ["id"]).collect()} == {2, 99}


def test_forecasts_have_symmetric_intervals(arrays):
    rows = sarimax.forecast(arrays.where("id < 4"), ["id"], AR1, [0.9], 5).collect()
    assert len(rows) == 20 and {r.h for r in rows} == {1, 2, 3, 4, 5}
    for r in rows:
        assert r.ci_upper - r["mean"] == pytest.approx(r["mean"] - r.ci_lower)
        assert (r.ci_upper - r["mean"]) / math.sqrt(r.variance) == pytest.approx(1.959963985, abs=1e-8)


def test_exog_goes_in_and_out(spark):
    rng = np.random.default_rng(1)
    rows = [(t, float(v), float(3 * v + e)) for t, (v, e) in enumerate(zip(rng.normal(size=80), rng.normal(size=80)))]
    long = spark.createDataFrame([(1, *r) for r in rows], "id int, t int, x1 double, y double")
    arr, spec = panel.to_arrays(long, ["id"], ["x1"]), Spec.of((1, 0, 0), n_exog=1)
    fit = sarimax.fit(arr, ["id"], spec)
    assert fit.first().params[0] == pytest.approx(3, abs=0.3)
    future = spark.createDataFrame([(1, [[1.0, 2.0, 9.0]])], "id int, future_x array<array<double>>")
    got = sarimax.forecast(arr, ["id"], spec, fit, 2, future=future).orderBy("h").collect()
    assert [r["mean"] for r in got] == pytest.approx([3, 6], abs=1.2)
    short = future.withColumn("future_x", F.array(F.array(F.lit(1.0))))
    assert "future_exog" in sarimax.forecast(arr, ["id"], spec, fit, 2, future=short).first().error


def test_summary_and_search(arrays):
    got = sarimax.parameter_summary(arrays.where("id < 2"), ["id"], Spec.of((1, 0, 1)), [0.5, 0.2]).collect()
    assert {r.name for r in got} == {"ar.L1", "ma.L1"} and all(r.inference_status in ("ok", "partial", "failed") for r in got)
    for r in got:
        if r.z is not None:
            assert r.p_value == pytest.approx(math.erfc(abs(r.z) / 2**0.5), rel=1e-6)
    fits = [sarimax.fit(arrays, ["id"], Spec.of((p, 0, 0))) for p in (1, 2)]
    best = {r.id: r.aic for r in sarimax.order_search(arrays, ["id"], [Spec.of((1, 0, 0)), Spec.of((2, 0, 0))]).collect()}
    every = [{r.id: r.aic for r in f.collect()} for f in fits]
    assert {i: a for i, a in best.items() if a is not None} == {i: min(e[i] for e in every) for i in range(4)}
    assert set(best) == set(every[0])  # a series that no order fits keeps a row


def test_residuals_are_standardized(arrays):
    rows = sarimax.residuals(arrays.where("id = 0"), ["id"], AR1, [0.9]).where("t > 0").collect()
    values = np.array([r.standardized_residual for r in rows])
    assert (values**2).mean() == pytest.approx(1, abs=1e-3)


def test_least_squares_is_the_diffuse_optimum(spark, arrays):
    long = arrays.where("id < 4").select("id", F.posexplode("y").alias("t", "y"))
    closed = {r.id: r.phi for r in series.ar1_least_squares(long, ["id"]).collect()}
    fits = sarimax.fit(arrays.where("id < 4"), ["id"], Spec.of((1, 0, 0), enforce_stationarity=False))
    for r in fits.collect():
        assert r.params[0] == pytest.approx(min(closed[r.id], 0.999), abs=1e-4)


def test_order_search_keeps_series_that_no_order_fits(spark):
    good = [float((7 * i) % 5) for i in range(40)]
    rows = [(1, good), (2, good[:20] + [float("nan")]), (3, [1.0])]
    arrays = spark.createDataFrame(rows, "id long, y array<double>")
    got = {r.id: r for r in sarimax.order_search(arrays, ["id"], [Spec.of((1, 0, 0)), Spec.of((2, 0, 0))]).collect()}
    assert set(got) == {1, 2, 3} and got[1].error is None and got[1].aic is not None
    assert got[2].error == "endog contains NaN or Inf" and got[3].error.startswith("too few observations")


def test_order_search_scans_once_and_deals_by_cost(spark, arrays, tmp_path):
    specs = [Spec.of((1, 0, 0)), Spec.of((0, 0, 1)), Spec.of((2, 0, 1))]
    arrays.write.parquet(str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a"))
    found = sarimax.order_search(stored, ["id"], specs, tasks=12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("MapInPandas") == 1
    shares = sarimax.order_shares(specs, 12)
    assert min(shares) >= 1 and shares[2] > shares[0] and abs(sum(shares) - 12) <= 2
    alone = [{r.id: r for r in sarimax.fit(stored, ["id"], s).collect()} for s in specs]
    for r in found.collect():
        fits = [a[r.id] for a in alone if a[r.id].error is None]
        assert r.aic == (min(f.aic for f in fits) if fits else None)
    with pytest.raises(ValueError, match="at least one order"):
        sarimax.order_search(stored, ["id"], [])


def test_a_model_object_gives_what_the_operators_give(arrays, spark):
    long = arrays.where("id < 3").select("id", F.posexplode("y").alias("t", "y"))
    model = SarimaxPanel(long.union(spark.createDataFrame([(9, 0, 1.0)], "id int, t int, y double")), ["id"], (1, 0, 1))
    fitted = model.fit()
    fits = {r.id: r for r in fitted.fits.collect()}
    assert fits[9].error.startswith("too few") and {r.id: r.n_obs for r in model.nobs().collect()} == {0: 60, 1: 60, 2: 60, 9: 1}
    assert {(r.id, r.name): r.coef for r in fitted.params().collect()} == {(i, n): c for i in range(3) for n, c in zip(("ar.L1", "ma.L1"), fits[i].params)}
    for r in model.loglike(fitted.fits.where("id < 3").select("id", "params")).where("id < 3").collect():
        assert r.loglike == pytest.approx(fits[r.id].loglike, rel=1e-6)
    ahead = fitted.get_forecast().where("id < 3")
    assert ahead.count() == 3  # one step unless told otherwise
    for narrow, wide in zip(fitted.conf_int(ahead, 0.5).orderBy("id").collect(), ahead.orderBy("id").collect()):
        assert wide.ci_lower < narrow.ci_lower < narrow.ci_upper < wide.ci_upper
    assert fitted.resid().where("id = 0").count() == 60
    skipped = fitted.parameter_summary(inference="none").collect()
    assert len(skipped) == 6 and all(r.inference_status == "skipped" and r.std_err is None for r in skipped)
    told = fitted.summary().collect()
    assert sum(r.id < 3 and r.loglike is not None and r.inference_status in ("ok", "partial") for r in told) == 6
    assert {r.inference_status for r in told if r.id == 9} <= {"failed", None}
    for wrong in ({"inference": "magic"}, {"alpha": 1}):
        with pytest.raises(ValueError):
            fitted.parameter_summary(**wrong)
    fitted.unpersist()


def test_moment_starts_in_tasks_and_in_columns_agree(spark):
    y = np.random.default_rng(8).normal(size=200).cumsum()
    long = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(y)] + [(2, t, 5.0) for t in range(9)], "id int, t int, y double")
    for step in (1, 6):
        acov = estimate.autocovariances(y, 4, step)
        for operator, helper in ((series.yule_walker, estimate.yule_walker), (series.innovations_ma, estimate.innovations)):
            got = {r.id: list(r)[1:] for r in operator(long, ["id"], 4, step).collect()}
            assert got[1] == pytest.approx(helper(acov), abs=1e-9) and got[2] == [None] * 4
    gram = np.array([[acov[abs(i - j)] for j in range(4)] for i in range(4)])
    assert estimate.yule_walker(acov) == pytest.approx(np.linalg.solve(gram, acov[1:]))
    assert estimate.burg(np.ones(9), 2) is None and estimate.burg(y[:2], 2) is None and not estimate.yule_walker(np.zeros(3)).any()
    short = sarimax.fit(spark.createDataFrame([(1, y[:14].tolist())], "id int, y array<double>"), ["id"], Spec.of((1, 0, 1), (1, 0, 1, 3)))
    assert short.first().error is None


def test_reasons_of_failure_by_kind(spark):
    rng = np.random.default_rng(5)
    rows = [("few", [1.0, 2.0]), ("ok", rng.normal(size=40).tolist()), ("vast", (rng.normal(size=40) * 1e200).tolist())]
    df = spark.createDataFrame(rows, "k string, y array<double>")
    got = {r.k: r.error for r in sarimax.loglike(df, ["k"], Spec.of((1, 1, 0), (0, 1, 0, 4)), [0.5]).collect()}
    assert got["ok"] is None
    assert got["few"] == "not enough observations: 2 <= 5 that the start leaves out"
    assert got["vast"] == "likelihood sums are not finite"
    spec, y = Spec.of((1, 0, 0), concentrate_scale=False), np.array([rows[1][1]])
    out = statespace.run_filter(spec, np.repeat(y, 2, 0), np.array([[0.5, -1.0], [0.5, 1.0]]))  # the operators refuse such a variance
    assert statespace.failure(out, 0, 40) == "prediction variance is not positive at t=1" and statespace.failure(out, 1, 40) is None
    ahead = {r.k: r.error for r in sarimax.forecast(df, ["k"], Spec.of((1, 1, 0), (0, 1, 0, 4)), [0.5], 1).collect()}
    assert ahead["few"].startswith("not enough observations") and ahead["ok"] is None
    fits = {r.k: r.error for r in sarimax.fit(df.where("k <> 'few'"), ["k"], Spec.of((1, 0, 0)), maxiter=0).collect()}
    assert fits["ok"] is None and fits["vast"].startswith("optimization failed: ")


@pytest.mark.parametrize("order,seasonal,want", [((1, 0, 0), (0, 0, 0, 0), 0), ((1, 0, 1), (0, 0, 0, 0), 1), ((2, 0, 1), (0, 0, 0, 0), 2), ((2, 0, 2), (0, 0, 0, 0), 3), ((0, 0, 0), (0, 0, 1, 12), 2), ((3, 0, 3), (1, 0, 1, 4), 3)])
def test_restarts_follow_the_number_of_parameters(order, seasonal, want):
    spec = Spec.of(order, seasonal)
    assert estimate.restarts(spec) == want
    y = np.random.default_rng(1).normal(size=(3, 50))
    data = estimate.Data(y, None, np.full(3, 50))
    starts = estimate.further_starts(spec, np.zeros((3, spec.n_params)), data, True)
    assert len(starts) == 1 + want + (len(estimate.SEASONAL_GRID) if spec.Q else 0)
    alone = estimate.further_starts(spec, np.zeros((1, spec.n_params)), data[1:2], True)
    assert all(np.array_equal(a[1:2], b) for a, b in zip(starts, alone))


def test_inference_by_scores_beside_the_hessian(spark):
    rng = np.random.default_rng(7)
    y = np.zeros(4000)
    for t in range(1, len(y)):
        y[t] = 0.5 * y[t - 1] + rng.normal()
    df = spark.createDataFrame([("a", y.tolist()), ("zero", [0.0] * 30)], "k string, y array<double>")
    spec = Spec.of((1, 0, 0))
    rows = {r.k: r for r in sarimax.parameter_summary(df, ["k"], spec, [0.5], 0.05, "both").collect()}
    a = rows["a"]
    # A right model's two informations agree, and both are n / (1 - phi ** 2) in the long run.
    want = np.sqrt((1 - 0.25) / len(y))
    assert abs(a.hessian_std_err / want - 1) < 0.05 and abs(a.opg_std_err / want - 1) < 0.05
    assert a.std_err == a.hessian_std_err and a.ci_upper == a.hessian_ci_upper
    assert a.delta_std_err == pytest.approx(a.hessian_std_err - a.opg_std_err)
    assert a.delta_ci_lower == pytest.approx(a.hessian_ci_lower - a.opg_ci_lower)
    assert (a.inference_status, a.inference_status_hessian, a.inference_status_opg, a.inference_message) == ("ok", "ok", "ok", None)
    assert rows["zero"].inference_status != "ok" and rows["zero"].opg_std_err is None
    opg = sarimax.parameter_summary(df, ["k"], spec, [0.5], 0.05, "opg").where("k = 'a'").first()
    assert opg.std_err == a.opg_std_err and opg.inference_status == "ok" and "hessian_std_err" not in opg.asDict()
    with pytest.raises(ValueError, match="inference must be one of"):
        sarimax.parameter_summary(df, ["k"], spec, [0.5], 0.05, "other")


def test_standard_errors_of_poor_informations():
    assert sarimax.standard_errors(None)[1:] == ("failed", "information is not finite")
    se, status, _ = sarimax.standard_errors(np.diag([4.0, 0.0]))
    assert status == "partial" and se[0] == 0.5 and np.isnan(se[1])
    assert sarimax.standard_errors(-np.eye(2))[1] == "failed"
