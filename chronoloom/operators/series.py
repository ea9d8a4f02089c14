"""Operators on long panels that Catalyst expresses by itself: differences, moments, closed forms, likelihood folds."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.ranges import joined, with_lags, with_means, with_past


def difference(panel: DataFrame, ids: list[str], d: int = 1, D: int = 0, s: int = 0, columns: tuple[str, ...] = ("y",)) -> DataFrame:
    """d first differences and D seasonal ones of lag s, in one pass; rows without enough past go."""
    coefs = [1.0]
    for lag in [1] * d + [s] * D:
        coefs = [a - b for a, b in zip([*coefs, *[0.0] * lag], [*[0.0] * lag, *coefs])]
    if len(coefs) == 1:
        return panel
    used = [(k, c) for k, c in enumerate(coefs) if c and k]
    told = with_lags(panel, ids, {f"_{c}_{k}": (c, k) for c in columns for k, _ in used} | {"_has": ("t", len(coefs) - 1)}).where("_has is not null")
    minus = {c: reduce(lambda e, kc, c=c: e + F.lit(kc[1]) * F.col(f"_{c}_{kc[0]}"), used, F.col(c)) for c in columns}
    return told.withColumns(minus).select(*panel.columns)


def lag_filtered(panel: DataFrame, ids: list[str], coefs: list[float], step: int = 1) -> DataFrame:
    """y_t minus coefs[i] * y_(t - step (i + 1)); the first rows, which lack a lag, go."""
    told = with_lags(panel, ids, {f"_y{i}": ("y", step * (i + 1)) for i in range(len(coefs))}) if coefs else panel
    out = reduce(lambda e, ic: e - F.lit(float(ic[1])) * F.col(f"_y{ic[0]}"), enumerate(coefs), F.col("y"))
    return told.select(*ids, "t", out.alias("y")).where("y is not null") if coefs else panel.select(*ids, "t", "y")


def lag_products(panel: DataFrame, ids: list[str], lags: list[int]) -> DataFrame:
    """ids, n, g<lag>: sums of c_t c_(t - lag) around the series' mean, by ranges of t; 0 where the series is too short."""
    centred = with_means(panel.select(*ids, "t", "y"), ids, ["y"]).select(*ids, "t", (F.col("y") - F.col("_mean_y")).alias("c"))
    lagged = with_lags(centred, ids, {f"c{k}": ("c", k) for k in lags})
    return lagged.groupBy(*ids).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col("c") * F.col(f"c{k}")), F.lit(0.0)).alias(f"g{k}") for k in lags])


def autocovariance(panel: DataFrame, ids: list[str], lags: list[int]) -> DataFrame:
    """ids, lag, acov: around the series' mean, divided by n."""
    sums = lag_products(panel, ids, lags)
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"g{k}") / F.col("n")).alias("acov")) for k in lags])
    return sums.select(*ids, F.explode(pairs).alias("_p")).select(*ids, "_p.*")


def clamped(e: Column) -> Column:
    """Within 0.99 of 0; null stays null."""
    return F.when(e.isNotNull(), F.greatest(F.lit(-0.99), F.least(F.lit(0.99), e)))


def low_order_starts(panel: DataFrame, ids: list[str], s: int) -> DataFrame:
    """Closed-form start values: burg_ar1, yw2_1, yw2_2 (Yule-Walker of order 2), ma1 and seasonal_ma1 (innovations)."""
    lags = [0, 1, 2, s]
    acov = autocovariance(panel, ids, lags).groupBy(*ids).pivot("lag", lags).agg(F.first("acov"))
    g0, g1, g2, gs = (F.col(f"`{k}`") for k in lags)
    safe = F.when(g0 > 1e-15, g0)
    r1, r2 = g1 / safe, g2 / safe
    centred = with_means(panel.select(*ids, "t", "y"), ids, ["y"]).select(*ids, "t", (F.col("y") - F.col("_mean_y")).alias("c"))
    c = with_lags(centred, ids, {"b": ("c", 1)})
    burg = c.where("b is not null").groupBy(*ids).agg((2 * F.sum(F.col("c") * F.col("b")) / F.sum(F.col("c") ** 2 + F.col("b") ** 2)).alias("burg_ar1"))
    phi2 = (r2 - r1 * r1) / (1 - r1 * r1)
    closed = acov.select(*ids, (r1 * (1 - phi2)).alias("yw2_1"), phi2.alias("yw2_2"), clamped(r1).alias("ma1"), clamped(gs / safe).alias("seasonal_ma1"))
    return joined(burg, closed, ids)


def _acov_columns(panel: DataFrame, ids: list[str], order: int, step: int) -> DataFrame:
    """ids and _g0, _g1, ...: the autocovariances of lags 0, step, ..., order * step; a constant series has null for lag 0."""
    lags = [k * step for k in range(order + 1)]
    acov = autocovariance(panel, ids, lags).groupBy(*ids).pivot("lag", lags).agg(F.first("acov"))
    return acov.select(*ids, *[(F.when(F.col(f"`{lag}`") > 1e-15, F.col(f"`{lag}`")) if k == 0 else F.col(f"`{lag}`")).alias(f"_g{k}") for k, lag in enumerate(lags)])


def yule_walker(panel: DataFrame, ids: list[str], p: int, step: int = 1) -> DataFrame:
    """ids, ar1, ..., ar<p>: Yule-Walker coefficients at lags step, 2 step, ..., order by order; null for a constant series."""
    acov = _acov_columns(panel, ids, p, step).withColumn("_left", F.col("_g0"))
    for k in range(1, p + 1):
        told = reduce(lambda e, j: e - F.col(f"_a{k - 1}_{j}") * F.col(f"_g{k - j}"), range(1, k), F.col(f"_g{k}"))
        acov = acov.withColumn(f"_a{k}_{k}", told / F.col("_left"))
        last = F.col(f"_a{k}_{k}")
        inner = {f"_a{k}_{j}": F.col(f"_a{k - 1}_{j}") - last * F.col(f"_a{k - 1}_{k - j}") for j in range(1, k)}
        acov = acov.withColumns(inner | {"_left": F.col("_left") * (1 - last * last)})
    return acov.select(*ids, *[F.col(f"_a{p}_{j}").alias(f"ar{j}") for j in range(1, p + 1)])


def innovations_ma(panel: DataFrame, ids: list[str], q: int, step: int = 1) -> DataFrame:
    """ids, ma1, ..., ma<q>: q rounds of the innovations algorithm at lags step, 2 step, ..., within 0.99; null for a constant series."""
    rows = _acov_columns(panel, ids, q, step).withColumn("_v0", F.col("_g0"))
    for n in range(1, q + 1):
        for k in range(n):
            told = reduce(lambda e, j: e - F.col(f"_t{k}_{k - j}") * F.col(f"_t{n}_{n - j}") * F.col(f"_v{j}"), range(k), F.col(f"_g{n - k}"))
            rows = rows.withColumn(f"_t{n}_{n - k}", told / F.col(f"_v{k}"))
        rows = rows.withColumn(f"_v{n}", reduce(lambda e, j: e - F.col(f"_t{n}_{n - j}") ** 2 * F.col(f"_v{j}"), range(n), F.col("_g0")))
    return rows.select(*ids, *[clamped(F.col(f"_t{q}_{j}")).alias(f"ma{j}") for j in range(1, q + 1)])


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def solved(rows: Column) -> Column:
    """The solution of a positive definite system given as rows of its matrix with the right side behind; Gauss-Jordan as a fold."""
    n = F.size(rows)

    def clear(m: Column, k: Column) -> Column:
        pivot = F.transform(m[k], lambda v: v / m[k][k])
        return let(pivot, lambda p: F.transform(m, lambda row, i: F.when(i == k, p).otherwise(F.zip_with(row, p, lambda a, b: a - row[k] * b))))

    done = F.aggregate(F.sequence(F.lit(0), n - 1), rows, clear)
    return F.transform(done, lambda row: row[n])


def _burg_fold(g: Column, head: Column, tail: Column, order: Column) -> Column:
    """Burg's coefficients from lag products and the series' first and last values.

    Forward and backward errors are linear in the values, so their sums of squares and products are quadratic forms in the sums R
    of y_(t-i) y_(t-j) over t >= m, which lag products give but for the ends: each order adds a row and takes the ends away.
    """
    first = F.struct(F.array(F.lit(1.0)).alias("a"), F.array(F.array(g[0])).alias("r"))

    def grown(r: Column, m: Column) -> Column:
        width = lambda j: F.greatest(m - j + 1, F.lit(0))
        top = F.transform(F.sequence(F.lit(0), m + 1), lambda j: F.get(g, j) - dot(F.slice(head, F.lit(1), width(j)), F.slice(head, j + 1, width(j))))
        inner = lambda row, i: F.transform(row, lambda v, j: v - F.get(tail, i) * F.get(tail, j))
        return let(top, lambda t: F.concat(F.array(t), F.transform(r, lambda row, i: F.concat(F.array(F.get(t, i + 1)), inner(row, i)))))

    def step(acc: Column, m: Column) -> Column:
        def reflected(told: Column) -> Column:
            r, f = told["r"], told["f"]
            b = F.reverse(f)
            rf, rb = F.transform(r, lambda row: dot(row, f)), F.transform(r, lambda row: dot(row, b))
            sums = F.struct(dot(f, rb).alias("num"), (dot(f, rf) + dot(b, rb)).alias("den"))
            k = let(sums, lambda q: F.when(q["den"] > 1e-15, 2 * q["num"] / q["den"]))
            return let(k, lambda k: F.struct(F.when(F.abs(k) < 1, F.zip_with(f, b, lambda x, y: x - k * y)).alias("a"), r.alias("r")))

        return let(F.struct(grown(acc["r"], m).alias("r"), F.concat(acc["a"], F.array(F.lit(0.0))).alias("f")), reflected)

    done = F.aggregate(F.sequence(F.lit(0), order - 1), first, step)["a"]
    return F.transform(F.slice(done, F.lit(2), order), lambda v: -v)


def burg(panel: DataFrame, ids: list[str], order: int | Column, most: int | None = None) -> DataFrame:
    """ids, n_obs, ar: AR coefficients by Burg's method of the demeaned series, as an array.

    `order` may be an expression of n_obs, of at most `most`. Null where a series is not longer than the order, constant, or at the
    border of what is stationary. One pass by ranges of t gives the sums that all orders need.
    """
    most = order if most is None else most
    told = with_past(panel.select(*ids, "t", "y"), ids, "y", most, ["y"])
    c = F.transform("_past", lambda v: v - F.col("_mean_y"))
    rows = told.select(*ids, "t", "_begin", "_end", c.alias("c"))
    now = F.get("c", F.lit(0))
    ends = lambda near: F.array_sort(F.collect_list(F.when(near, F.struct("t", now.alias("c")))))
    sums = rows.groupBy(*ids).agg(
        F.count("*").alias("n_obs"), *[F.coalesce(F.sum(now * F.get("c", F.lit(k))), F.lit(0.0)).alias(f"_g{k}") for k in range(most + 1)],
        ends(F.col("t") < F.col("_begin") + most).alias("_head"), F.reverse(ends(F.col("t") > F.col("_end") - most)).alias("_tail"),
    )
    p = F.lit(order) if isinstance(order, int) else order
    ar = _burg_fold(F.array(*[f"_g{k}" for k in range(most + 1)]), F.col("_head.c"), F.col("_tail.c"), p)
    return sums.select(*ids, "n_obs", F.when((F.col("n_obs") > p) & (F.col("_g0") > 1e-15), ar).alias("ar"))


def hannan_rissanen(panel: DataFrame, ids: list[str], p: int = 0, q: int = 0, P: int = 0, Q: int = 0, s: int = 0) -> DataFrame:
    """ids, ar1, ..., ma1, ..., sar1, ..., sma1, ...: start values by Hannan and Rissanen's regression, within 0.95.

    A long autoregression (Burg) stands in for the errors; then y is regressed on its own lags and theirs. The sums of products are
    aggregates by series, the small system is solved in a fold. Null for a series too short or too even.
    """
    lags = {"ar": range(1, p + 1), "ma": range(1, q + 1), "sar": [s * i for i in range(1, P + 1)], "sma": [s * i for i in range(1, Q + 1)]}
    columns = [(name, k) for name, some in lags.items() for k in some]
    if not columns:
        raise ValueError("Hannan-Rissanen needs a lag")
    n, reach = len(columns), max(k for _, k in columns)
    longest = max(10, 2 * reach)
    order = F.least(F.lit(longest), F.floor(F.col("n_obs") / 3).cast("int"))
    long = burg(panel, ids, order, longest).where(F.col("n_obs") - order - reach > 2 * n + 2).where("ar is not null")
    rows = with_past(panel.select(*ids, "t", "y"), ids, "y", longest + reach, [], long.drop("n_obs")).where(F.col("t") - F.col("_begin") >= F.size("ar") + reach)
    past = lambda k: F.get("_past", F.lit(k))
    error = lambda k: past(k) - dot(F.col("ar"), F.slice("_past", F.lit(k + 2), F.size("ar")))
    told = rows.select(*ids, *[(error(k) if name in ("ma", "sma") else past(k)).alias(f"_x{i}") for i, (name, k) in enumerate(columns)], past(0).alias(f"_x{n}"))
    sums = told.groupBy(*ids).agg(*[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_g{i}_{j}") for i in range(n) for j in range(i, n + 1)])
    ridge = 1e-10 / n * reduce(lambda a, b: a + b, [F.col(f"_g{i}_{i}") for i in range(n)])
    cell = lambda i, j: F.col(f"_g{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0)
    beta = solved(F.array(*[F.array(*[cell(i, j) for j in range(n)], F.col(f"_g{i}_{n}")) for i in range(n)]))
    fit = sums.withColumn("_beta", beta)
    names = [f"{name}{i}" for name, some in lags.items() for i in range(1, len(some) + 1)]
    near = lambda i: F.greatest(F.lit(-0.95), F.least(F.lit(0.95), F.get("_beta", F.lit(i))))
    every = panel.select(*ids).distinct()
    return joined(every, fit.select(*ids, *[near(i).alias(name) for i, name in enumerate(names)]), ids, "left")


def exog_slopes(panel: DataFrame, ids: list[str], exog: list[str]) -> DataFrame:
    """The least-squares slope of y on each regressor by itself."""
    return panel.groupBy(*ids).agg(*[F.regr_slope("y", x).alias(f"beta_{x}") for x in exog])


def convolve(a: Column, b: Column) -> Column:
    """The product of two polynomials given as arrays of coefficients, lowest power first."""
    return F.transform(
        F.sequence(F.lit(0), F.size(a) + F.size(b) - 2),
        lambda k: F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(a, i) * F.get(b, k - i), F.lit(0.0))),
    )


def lag_polynomial(coefs: Column, step: int, sign: float) -> Column:
    """1 + sign c1 L^step + sign c2 L^(2 step) + ... as an array of coefficients."""
    zeros = F.array_repeat(F.lit(0.0), step - 1)
    return F.concat(F.array(F.lit(1.0)), F.flatten(F.transform(coefs, lambda c: F.concat(zeros, F.array(c * sign)))))


def stationary_pair(x1: Column, x2: Column) -> tuple[Column, Column]:
    """Two free numbers as the coefficients of a stationary AR(2)."""
    r1, r2 = x1 / F.sqrt(1 + x1 * x1), x2 / F.sqrt(1 + x2 * x2)
    return -(r1 + r2 * r1), -r2


def ar1_loglike(arrays: DataFrame, ids: list[str], phi: float) -> DataFrame:
    """Exact log-likelihood of a stationary AR(1), scale concentrated out, as a fold over the array."""
    fold = F.aggregate(
        F.slice("y", F.lit(2), F.size("y")),
        F.struct(F.get("y", F.lit(0)).alias("last"), (F.get("y", F.lit(0)) ** 2 * (1 - phi * phi)).alias("sum")),
        lambda acc, v: F.struct(v.alias("last"), (acc["sum"] + (v - phi * acc["last"]) ** 2).alias("sum")),
    )
    n = F.size("y")
    ll = -n / 2 * (math.log(2 * math.pi) + F.log(fold["sum"] / n) + 1) + 0.5 * math.log(1 - phi * phi)
    return arrays.select(*ids, ll.alias("loglike"))


def ma1_loglike(arrays: DataFrame, ids: list[str], theta: float) -> DataFrame:
    """Exact log-likelihood of an MA(1), scale concentrated out: the filter's error and variance are folded along."""
    start = F.struct(F.lit(0.0).alias("v"), F.lit(None).cast("double").alias("f"), F.lit(0.0).alias("quad"), F.lit(0.0).alias("logs"))

    def step(acc: Column, y: Column) -> Column:
        f = F.when(acc["f"].isNull(), 1 + theta**2).otherwise(1 + theta**2 - theta**2 / acc["f"])
        v = F.when(acc["f"].isNull(), y).otherwise(y - theta * acc["v"] / acc["f"])
        return F.struct(v.alias("v"), f.alias("f"), (acc["quad"] + v * v / f).alias("quad"), (acc["logs"] + F.log(f)).alias("logs"))

    fold, n = F.aggregate("y", start, step), F.size("y")
    ll = -n / 2 * (math.log(2 * math.pi) + F.log(fold["quad"] / n) + 1) - 0.5 * fold["logs"]
    return arrays.select(*ids, ll.alias("loglike"))


def ar1_least_squares(panel: DataFrame, ids: list[str]) -> DataFrame:
    """The diffuse-start maximum likelihood of an AR(1) in closed form: phi, scale, loglike, n_obs, last value.

    A series of zeros but for its last value, or of one value, has no phi.
    """
    lagged = with_lags(panel.select(*ids, "t", "y"), ids, {"_before": ("y", 1)})
    sums = lagged.groupBy(*ids).agg(
        F.sum(F.col("y") * F.col("_before")).alias("yb"), F.sum(F.col("_before") ** 2).alias("bb"), F.sum(F.when(F.col("_before").isNotNull(), F.col("y") ** 2)).alias("yy"),
        F.count("*").alias("n_obs"), F.max_by("y", "t").alias("last"),
    )
    phi, m = F.try_divide("yb", "bb"), F.col("n_obs") - 1
    scale = F.try_divide(F.col("yy") - phi * F.col("yb"), m)
    ll = -m / 2 * (math.log(2 * math.pi) + F.log(scale) + 1)
    return sums.select(*ids, phi.alias("phi"), scale.alias("scale"), ll.alias("loglike"), "n_obs", "last")


def ar1_forecast(fits: DataFrame, ids: list[str], steps: int) -> DataFrame:
    """Rows h = 1..steps of mean and variance from ar1_least_squares."""
    h, phi = F.col("h"), F.col("phi")
    rows = fits.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return rows.select(*ids, "h", (phi**h * F.col("last")).alias("mean"), (F.col("scale") * (1 - phi ** (2 * h)) / (1 - phi**2)).alias("variance"))


def with_interval(forecasts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds ci_lower and ci_upper at level 1 - alpha from mean and variance."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    half = F.sqrt("variance") * NormalDist().inv_cdf(1 - alpha / 2)
    return forecasts.withColumns({"ci_lower": F.col("mean") - half, "ci_upper": F.col("mean") + half})


def information_criteria(fits: DataFrame, n_params: Column | str = "n_params") -> DataFrame:
    """Adds aic and bic from loglike, n_obs and the number of parameters, the scale included."""
    k = F.col(n_params) if isinstance(n_params, str) else n_params
    return fits.withColumns({"aic": 2 * k - 2 * F.col("loglike"), "bic": k * F.log(F.col("n_obs")) - 2 * F.col("loglike")})


def best_by(fits: DataFrame, ids: list[str], criterion: str = "aic") -> DataFrame:
    """The row of each series with the least criterion; fits with an error come last, so a series that no order fits keeps one."""
    every = F.struct(*[c for c in fits.columns if c not in ids])
    failed = F.col("error").isNotNull()
    rank = F.struct(failed, F.when(~failed, F.coalesce(F.col(criterion), F.lit(float("nan")))), *[F.col(c) for c in ("order", "error") if c in fits.columns])
    return fits.groupBy(*ids).agg(F.min_by(every, rank).alias("_b")).select(*ids, "_b.*")
