"""Seasonal ARIMA operators over panels in array form (ids, y, optional x): one row for each series.

Spark deals the series to tasks; inside a task, the series of an Arrow batch that have the same length go through the filter
together. An invalid or failing series gives a row with `error` and nulls, and leaves the others alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions import estimate, exact, statespace
from chronoloom.functions.spec import MOST_STEPS, Spec
from chronoloom.operators.series import with_interval

FIT_COLUMNS = "params array<double>, loglike double, scale double, aic double, bic double, n_obs long, n_params long, n_iter long, converged boolean, method string, error string"
PAD = math.log(1.1)  # lengths that differ by less are one batch
SERIES_ERRORS = (ValueError, RuntimeError, ArithmeticError, np.linalg.LinAlgError)  # what a series' own values can lead to
FIT_NAMES = [c.split()[0] for c in FIT_COLUMNS.split(", ")]


def _problem(spec: Spec, y, x, least: int) -> str | None:
    """What makes a series unfit for the operator, or None."""
    values = np.asarray(y, float) if y is not None else np.zeros(0)
    if not np.isfinite(values).all():
        return "endog contains NaN or Inf"
    if len(values) < least:
        return f"too few observations: {len(values)} < {least}"
    if spec.n_exog:
        if x is None or len(x) != spec.n_exog or any(len(c) != len(values) for c in x):
            return f"exog must have {spec.n_exog} columns of the series' length"
        if not np.isfinite(np.array([np.asarray(c, float) for c in x])).all():
            return "exog contains NaN or Inf"
    return None


def _answered(rows: pd.DataFrame, ids: list[str], spec: Spec, names: list[str], least: int, run: Callable[..., list[dict]], padded: bool) -> pd.DataFrame:
    """ids and `names` for the series of a batch: run(y, x, rows, length) gets those of one length and returns one dict a series.

    With `padded`, series of about one length go together, with zeros behind the shorter ones.
    """
    out: list[dict | None] = [None] * len(rows)
    by_length: dict[int, list[int]] = {}
    for i in range(len(rows)):
        problem = _problem(spec, rows["y"].iloc[i], rows["x"].iloc[i] if spec.n_exog else None, least)
        if problem:
            out[i] = {"error": problem}
        else:
            n = len(rows["y"].iloc[i])
            by_length.setdefault(int(math.log(max(n, 1)) / PAD) if padded else n, []).append(i)
    for some in by_length.values():
        length = np.array([len(rows["y"].iloc[i]) for i in some])
        y = np.zeros((len(some), length.max()))
        x = np.zeros((*y.shape, spec.n_exog)) if spec.n_exog else None
        for k, i in enumerate(some):
            y[k, : length[k]] = rows["y"].iloc[i]
            if spec.n_exog:
                x[k, : length[k]] = np.stack([np.asarray(c, float) for c in rows["x"].iloc[i]], 1)
        try:
            got = run(y, x, rows.iloc[some], length)
        except SERIES_ERRORS:  # one series can't take the others down: each on its own
            got = []
            for k, i in enumerate(some):
                try:
                    got += run(y[k : k + 1, : length[k]], None if x is None else x[k : k + 1, : length[k]], rows.iloc[[i]], length[k : k + 1])
                except SERIES_ERRORS as e:
                    got.append({"error": str(e)})
        for i, result in zip(some, got):
            out[i] = result
    result = pd.DataFrame(out, columns=names).astype(object)
    return pd.concat([rows[ids].reset_index(drop=True), result.where(result.notna(), None)], axis=1)


def _id_columns(series: DataFrame, ids: list[str]) -> str:
    schema = T.StructType([series.schema[c] for c in ids]).simpleString()[7:-1]
    return ", ".join(p.replace(":", " ", 1) for p in schema.split(","))


def _mapped(series: DataFrame, ids: list[str], spec: Spec, columns: str, names: list[str], least: int, run: Callable[..., list[dict]], extra: tuple[str, ...] = (), padded: bool = False) -> DataFrame:
    """Calls run(y, x, rows, length) for the series of one length in a batch; see _answered."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield _answered(rows, ids, spec, names, least, run, padded)

    wanted = [*ids, "y", *(["x"] if spec.n_exog else []), *extra]
    return series.select(*wanted).mapInPandas(work, f"{_id_columns(series, ids)}, {columns}")


def _fitting(spec: Spec, method: str, maxiter: int | None, start_params: list[float] | None) -> Callable[..., list[dict]]:
    def run(y, x, _rows, length):
        starts = None if start_params is None else np.tile(np.array(start_params, float), (len(y), 1))
        return estimate.fit(spec, y, x, method, maxiter, starts, length)

    return run


def fit(series: DataFrame, ids: list[str], spec: Spec, method: str = "lbfgsb", maxiter: int | None = None, start_params: list[float] | None = None) -> DataFrame:
    """Maximum likelihood for every series: ids and the columns of FIT_COLUMNS."""
    if method not in estimate.METHODS:
        raise RuntimeError(f"optimization failed: unknown method {method}")
    if start_params is not None:
        spec.check_params(start_params)

    return _mapped(series, ids, spec, FIT_COLUMNS, FIT_NAMES, spec.least_obs, _fitting(spec, method, maxiter, start_params), padded=exact.usable(spec))


def _given(rows: pd.DataFrame, spec: Spec) -> np.ndarray:
    out = []
    for p in rows["params"]:
        if p is None:
            raise ValueError("no parameters for this series")
        spec.check_params(p)
        out.append(np.asarray(p, float))
    return np.array(out).reshape(len(out), spec.n_params)


def with_params(series: DataFrame, params: DataFrame | list[float]) -> DataFrame:
    """Adds `params`: one vector for all series, or by join on the columns that both tables share."""
    if isinstance(params, DataFrame):
        keys = [c for c in params.columns if c in series.columns]
        return series.join(params.select(*keys, "params"), keys, "left")
    return series.withColumn("params", F.array(*[F.lit(float(p)) for p in params]).cast("array<double>"))


def loglike(series: DataFrame, ids: list[str], spec: Spec, params: DataFrame | list[float]) -> DataFrame:
    """ids, loglike, error at given parameters."""

    def run(y, x, rows, _length):
        out = statespace.run_filter(spec, y, _given(rows, spec), x)
        problems = [statespace.failure(out, i, y.shape[1]) for i in range(len(y))]
        return [{"error": e} if e else {"loglike": float(v)} for v, e in zip(out["loglike"], problems)]

    return _mapped(with_params(series, params), ids, spec, "loglike double, error string", ["loglike", "error"], 1, run, ("params",))


def forecast(series: DataFrame, ids: list[str], spec: Spec, params: DataFrame | list[float], steps: int = 10, alpha: float = 0.05, future: DataFrame | None = None) -> DataFrame:
    """ids, h, mean, variance, ci_lower, ci_upper, error. `future` has the ids and future_x, an array for each regressor.

    Uses the diffuse start, whatever the fit used. Future regressors may be longer than `steps`; the rest isn't used.
    """
    if steps > MOST_STEPS:
        raise ValueError(f"forecast steps requested {steps} exceeds maximum {MOST_STEPS}")
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    if spec.n_exog and steps and future is None:
        raise ValueError("future_exog is required")
    free = spec.diffuse()
    paired = with_params(series, params)
    if spec.n_exog:
        paired = paired.join(future.select(*ids, "future_x"), ids, "left")

    def run(y, x, rows, _length):
        ahead = None
        if spec.n_exog:
            for f in rows["future_x"]:
                if f is None or len(f) != spec.n_exog or any(len(c) < steps for c in f):
                    raise ValueError("future_exog is required: one array of at least `steps` values a regressor")
            ahead = np.array([np.stack([np.asarray(c, float)[:steps] for c in f], 1) for f in rows["future_x"]])
            if not np.isfinite(ahead).all():
                raise ValueError("future_exog contains NaN or Inf")
        mean, var, problems = statespace.forecast(free, y, _given(rows, free), steps, x, ahead)
        problems = [e or (None if np.isfinite(m).all() else "forecasts are not finite") for m, e in zip(mean, problems)]
        return [{"error": e} if e else {"mean": m.tolist(), "variance": v.tolist()} for m, v, e in zip(mean, var, problems)]

    arrays = _mapped(paired, ids, spec, "mean array<double>, variance array<double>, error string", ["mean", "variance", "error"], 1, run, ("params", *(("future_x",) if spec.n_exog else ())))
    rows = arrays.select(*ids, "error", F.posexplode_outer(F.arrays_zip("mean", "variance")).alias("h", "_p"))
    told = rows.select(*ids, (F.col("h") + 1).alias("h"), "_p.mean", "_p.variance", "error")
    return with_interval(told, alpha).select(*ids, "h", "mean", "variance", "ci_lower", "ci_upper", "error")


def residuals(series: DataFrame, ids: list[str], spec: Spec, params: DataFrame | list[float]) -> DataFrame:
    """ids, t, residual, standardized_residual, error, under the diffuse start."""
    free = spec.diffuse()

    def run(y, x, rows, _length):
        v, std = statespace.residuals(free, y, _given(rows, free), x)
        return [{"residual": a.tolist(), "standardized_residual": b.tolist(), "error": None} for a, b in zip(v, std)]

    arrays = _mapped(with_params(series, params), ids, spec, "residual array<double>, standardized_residual array<double>, error string", ["residual", "standardized_residual", "error"], 1, run, ("params",))
    rows = arrays.select(*ids, "error", F.posexplode_outer(F.arrays_zip("residual", "standardized_residual")).alias("t", "_p"))
    return rows.select(*ids, "t", "_p.residual", "_p.standardized_residual", "error")


INFORMATION = {"hessian": lambda *given: [None if h is None else -h for h in estimate.hessians(*given)], "opg": estimate.score_outers}  # of a batch
TOLD = ("std_err", "z", "p_value", "ci_lower", "ci_upper")  # what inference adds to a coefficient


def standard_errors(information: np.ndarray | None) -> tuple[np.ndarray | None, str, str | None]:
    """Standard errors from an information matrix, their status and message; where it isn't positive, by its pseudo-inverse as far as that goes."""
    if information is None:
        return None, "failed", "information is not finite"
    status, message = "ok", None
    try:
        var = np.diag(np.linalg.inv(information))
    except np.linalg.LinAlgError:
        var = np.zeros(len(information))
    if not (var > 0).all():
        status, message, var = "partial", "information is singular or not positive definite; pseudo-inverse used", np.diag(np.linalg.pinv(information))
    if not (var > 0).any():
        return None, "failed", "no positive variance"
    return np.sqrt(np.where(var > 0, var, np.nan)), status, message


def parameter_summary(series: DataFrame, ids: list[str], spec: Spec, params: DataFrame | list[float], alpha: float = 0.05, inference: str = "hessian") -> DataFrame:
    """ids, idx, name, coef, std_err, z, p_value, ci_lower, ci_upper, inference_status, inference_message.

    Standard errors come from the inverse of an information matrix: minus the numerical Hessian (`hessian`), or the outer products
    of the scores of single values (`opg`); if that isn't positive, from its pseudo-inverse where the diagonal allows, with
    status partial. `both` shows the Hessian's, and the columns TOLD and the status of each under its name (`hessian_std_err`,
    ..., `opg_std_err`, ..., `inference_status_hessian`, `inference_status_opg`), with `delta_std_err`, `delta_ci_lower` and
    `delta_ci_upper`, the Hessian's less the other's. It is partial where one of them failed.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    if inference not in (*INFORMATION, "both"):
        raise ValueError(f"inference must be one of {', '.join(INFORMATION)}, both, not {inference}")
    z_value = NormalDist().inv_cdf(1 - alpha / 2)
    kinds = list(INFORMATION) if inference == "both" else [inference]

    def run(y, x, rows, _length):
        out, given = [], _given(rows, spec)
        information = {kind: INFORMATION[kind](spec, y, given, x) for kind in kinds}
        for i, p in enumerate(given):
            told = {"coef": p.tolist()}
            for kind in kinds:
                se, status, message = standard_errors(information[kind][i])
                known = [None if se is None or np.isnan(s) else float(s) for s in (p if se is None else se)]
                p_value = [None if s is None else math.erfc(abs(c / s) / math.sqrt(2)) for c, s in zip(p.tolist(), known)]  # two-sided
                told |= {f"{kind}_se": known, f"{kind}_p": p_value, f"{kind}_status": status, f"{kind}_message": message}
            out.append(told)
        return out

    columns = {"coef": "array<double>"}
    for kind in kinds:
        columns |= {f"{kind}_se": "array<double>", f"{kind}_p": "array<double>", f"{kind}_status": "string", f"{kind}_message": "string"}
    columns["error"] = "string"
    arrays = _mapped(with_params(series, params), ids, spec, ", ".join(f"{c} {t}" for c, t in columns.items()), list(columns), 1, run, ("params",))
    names = F.array(*[F.lit(n) for n in spec.names]).cast("array<string>")
    by_param = F.arrays_zip(names.alias("name"), "coef", *[f"{k}_{c}" for k in kinds for c in ("se", "p")])
    status = {k: F.coalesce(f"{k}_status", F.lit("failed")) for k in kinds}
    rows = arrays.select(*ids, *[status[k].alias(f"{k}_status") for k in kinds], *[f"{k}_message" for k in kinds], "error", F.posexplode_outer(by_param).alias("idx", "_p"))

    def told(kind: str) -> dict:
        coef, se = F.col("_p.coef"), F.col(f"_p.{kind}_se")
        return dict(zip(TOLD, (se, coef / se, F.col(f"_p.{kind}_p"), coef - se * z_value, coef + se * z_value)))

    first = [*ids, "idx", "_p.name", "_p.coef", *[c.alias(n) for n, c in told(kinds[0]).items()]]
    if inference != "both":
        return rows.select(*first, F.col(f"{inference}_status").alias("inference_status"), F.coalesce(f"{inference}_message", "error").alias("inference_message"))
    each = [c.alias(f"{k}_{n}") for k in kinds for n, c in told(k).items()]
    delta = [(told("hessian")[n] - told("opg")[n]).alias(f"delta_{n}") for n in ("std_err", "ci_lower", "ci_upper")]
    failed = [F.col(f"{k}_status") == "failed" for k in kinds]
    whole = F.when(failed[0] & failed[1], "failed").when(failed[0] | failed[1], "partial").otherwise("ok")
    said = F.concat_ws("; ", *[F.concat(F.lit(f"{k}: "), F.col(f"{k}_message")) for k in kinds], "error")
    return rows.select(
        *first, *each, *delta, *[F.col(f"{k}_status").alias(f"inference_status_{k}") for k in kinds], whole.alias("inference_status"), F.nullif(said, F.lit("")).alias("inference_message"),
    )


def order_shares(specs: list[Spec], tasks: int) -> list[int]:
    """How many of about `tasks` tasks each order gets, at least one each, in proportion to what a fit of it costs.

    A quasi-Newton fit takes steps in proportion to its parameters, each with a likelihood at every parameter's neighbours; the
    likelihood itself grows with the states.
    """
    cost = [(1 + s.n_params) ** 2 * (4 + s.n_states) for s in specs]
    return [max(1, round(tasks * c / sum(cost))) for c in cost]


def order_search(series: DataFrame, ids: list[str], specs: list[Spec], criterion: str = "aic", method: str = "lbfgsb", maxiter: int | None = None, tasks: int | None = None) -> DataFrame:
    """Fits every order to every series and keeps the best by `criterion`: ids, order, and the fit's columns.

    The panel is scanned and packed once. Each series then becomes a row an order, and each order's rows are spread over a number
    of tasks in proportion to its cost, so that dear orders are not left to the end; a task has one order, whose series run
    together. `tasks` is about how many there are (the session's shuffle partitions by default).
    """
    from chronoloom.operators.series import best_by

    if method not in estimate.METHODS:
        raise RuntimeError(f"optimization failed: unknown method {method}")
    if not specs:
        raise ValueError("order search needs at least one order")
    shares = order_shares(specs, tasks or int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    begins = [sum(shares[:k]) for k in range(len(specs))]
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(b).alias("begin"), F.lit(n).alias("share")) for k, (b, n) in enumerate(zip(begins, shares))])
    wanted = [*ids, "y", *(["x"] if any(s.n_exog for s in specs) else [])]
    units = series.select(*wanted, F.explode(places).alias("_o"))
    task = F.col("_o.begin") + F.pmod(F.xxhash64(*ids), F.col("_o.share").cast("long")).cast("int")
    dealt = units.withColumn("_task", task).repartitionById(sum(shares), "_task").select(*wanted, F.col("_o.k").alias("_order"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k, some in rows.groupby("_order"):
                spec = specs[k]
                done = _answered(some, ids, spec, FIT_NAMES, spec.least_obs, _fitting(spec, method, maxiter, None), exact.usable(spec))
                yield done.assign(order=str((spec.p, spec.d, spec.q, spec.P, spec.D, spec.Q, spec.s)))

    return best_by(dealt.mapInPandas(work, f"{_id_columns(series, ids)}, {FIT_COLUMNS}, order string"), ids, criterion)
