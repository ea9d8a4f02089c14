"""Likelihoods of low orders, their derivatives and fits, and parameter transforms, as folds over arrays: no Python in tasks.

A filter of two states at most is a fold whose state holds the state's mean and covariance. Parameters are numbers or columns, so
each series can have its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.series import let

KAPPA = 1e6  # variance of a diffuse start
NEWTON_STEPS = 40
EDGE = 1 - 1e-6  # what a moving average's coefficient stays within


def column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def record(**fields: Column | float) -> Column:
    return F.struct(*[column(v).alias(k) for k, v in fields.items()])


def concentrated(n: Column, quad: Column, logs: Column) -> Column:
    """The log-likelihood with the scale at its best, from the sums of v * v / f and log f over n observations."""
    return -n / 2 * (math.log(2 * math.pi) + F.log(quad / n) + 1) - logs / 2


def _start(phi1: Column, phi2: Column, theta: Column) -> tuple[Column, Column, Column]:
    """The stationary covariance of an ARMA(2, 1)'s two states, by elimination of the three equations P = T P T' + R R'."""
    p11 = (1 + theta * theta + 2 * phi1 * theta / (1 - phi2)) / (1 - phi1 * phi1 - 2 * phi1 * phi1 * phi2 / (1 - phi2) - phi2 * phi2)
    p12 = (phi1 * phi2 * p11 + theta) / (1 - phi2)
    return p11, p12, phi2 * phi2 * p11 + theta * theta


def filter_fold(y: Column, order: tuple[int, int, int], params: list[Column | float], stationary: bool = True) -> Column:
    """n, quad, logs of the filter over an array: sums of v * v / f and log f over the observations after the diffuse start.

    `order` is (p, d, q) with d + max(p, q + 1) <= 2 states; `params` are the p AR, then the q MA coefficients. Without
    `stationary` all states start diffuse.
    """
    p, d, q = order
    states = d + max(p, q + 1)
    if not 1 <= states <= 2 or len(params) != p + q:
        raise ValueError("a fold has one or two states and a parameter a lag")
    ar, ma = [column(v) for v in params[:p]], [column(v) for v in params[p:]]
    zero, one = F.lit(0.0), F.lit(1.0)
    phi1, phi2, theta = (ar + [zero, zero])[0], (ar + [zero, zero])[1], (ma + [zero])[0]
    if d == 0:  # y_t and what of y_(t + 1) is known of the lags
        t, z, r = ((phi1, one), (phi2, zero)), (one, zero), (one, theta)
    elif states == 2:  # a level and an AR(1) of its steps
        t, z, r = ((one, one), (zero, phi1)), (one, one), (zero, one)
    else:
        raise ValueError("one difference takes a state of its own")
    inner = states - d  # states that are not integrated
    if not stationary:
        cov, burn = (F.lit(KAPPA), zero, F.lit(KAPPA if states == 2 else 0.0)), states
    elif d:
        cov, burn = (F.lit(KAPPA), zero, 1 / (1 - phi1 * phi1)), d
    else:
        cov, burn = _start(phi1, phi2, theta) if inner == 2 else (1 / (1 - phi1 * phi1), zero, zero), 0

    def step(s: Column, value: Column) -> Column:
        pz = F.struct((s["p11"] * z[0] + s["p12"] * z[1]).alias("a"), (s["p12"] * z[0] + s["p22"] * z[1]).alias("b"))

        def seen(m: Column) -> Column:
            f, v = m["f"], m["v"]
            g1, g2 = m["a"] / f, m["b"] / f
            now = record(x1=s["a1"] + g1 * v, x2=s["a2"] + g2 * v, q11=s["p11"] - g1 * m["a"], q12=s["p12"] - g1 * m["b"], q22=s["p22"] - g2 * m["b"])
            counted = s["i"] >= burn

            def ahead(x: Column) -> Column:
                row = [(t[k][0] * x["q11"] + t[k][1] * x["q12"], t[k][0] * x["q12"] + t[k][1] * x["q22"]) for k in (0, 1)]  # T P
                return record(
                    i=s["i"] + 1, a1=t[0][0] * x["x1"] + t[0][1] * x["x2"], a2=t[1][0] * x["x1"] + t[1][1] * x["x2"],
                    p11=row[0][0] * t[0][0] + row[0][1] * t[0][1] + r[0] * r[0], p12=row[0][0] * t[1][0] + row[0][1] * t[1][1] + r[0] * r[1],
                    p22=row[1][0] * t[1][0] + row[1][1] * t[1][1] + r[1] * r[1],
                    quad=s["quad"] + F.when(counted, v * v / f).otherwise(0.0), logs=s["logs"] + F.when(counted, F.log(f)).otherwise(0.0),
                )

            return let(now, ahead)

        told = let(pz, lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), (w["a"] * z[0] + w["b"] * z[1]).alias("f"), (value - s["a1"] * z[0] - s["a2"] * z[1]).alias("v")))
        return let(told, seen)

    first = record(i=0.0, a1=0.0, a2=0.0, p11=cov[0], p12=cov[1], p22=cov[2], quad=0.0, logs=0.0)
    done = F.aggregate(y, first, step)
    return let(done, lambda s: record(n=F.greatest(s["i"] - burn, F.lit(0.0)), quad=s["quad"], logs=s["logs"]))


def loglike_fold(arrays: DataFrame, ids: list[str], order: tuple[int, int, int], params: list[Column | float], stationary: bool = True) -> DataFrame:
    """ids, loglike of each array `y`, scale concentrated out; null for a series that has nothing, or only zeros, after its start.

    Values must be finite; a null value makes the result null.
    """
    ll = let(filter_fold(F.col("y"), order, params, stationary), lambda s: F.when((s["n"] > 0) & (s["quad"] > 0), concentrated(s["n"], s["quad"], s["logs"])))
    return arrays.select(*ids, ll.alias("loglike"))


def ma1_tangent(y: Column, theta: Column) -> Column:
    """loglike, score and curvature of an MA(1) at theta: the errors, their variances and both derivatives go along in one fold."""
    first = record(v=0.0, v1=0.0, v2=0.0, f=1.0, f1=0.0, f2=0.0, quad=0.0, quad1=0.0, quad2=0.0, logs=0.0, logs1=0.0, logs2=0.0, i=0.0)

    def step(s: Column, value: Column) -> Column:
        new = s["i"] == 0  # the first error is the value itself
        h = F.struct((s["v"] / s["f"]).alias("q"), (1 / s["f"]).alias("h"))

        def second(m: Column) -> Column:
            q1 = (s["v1"] - m["q"] * s["f1"]) * m["h"]
            return F.struct(m["q"].alias("q"), m["h"].alias("h"), q1.alias("q1"), (-s["f1"] * m["h"] ** 2).alias("h1"))

        def third(m: Column) -> Column:
            q2 = (s["v2"] - 2 * m["q1"] * s["f1"] - m["q"] * s["f2"]) * m["h"]
            h2 = -s["f2"] * m["h"] ** 2 + 2 * s["f1"] ** 2 * m["h"] ** 3
            none = F.lit(0.0)
            pick = lambda a, b: F.when(new, a).otherwise(b)
            return record(
                v=pick(value, value - theta * m["q"]), v1=pick(none, -(m["q"] + theta * m["q1"])), v2=pick(none, -(2 * m["q1"] + theta * q2)),
                f=pick(1 + theta * theta, 1 + theta * theta * (1 - m["h"])), f1=pick(2 * theta, 2 * theta * (1 - m["h"]) - theta * theta * m["h1"]),
                f2=pick(F.lit(2.0), 2 * (1 - m["h"]) - 4 * theta * m["h1"] - theta * theta * h2),
            )

        def rates(d: Column) -> Column:
            q = d["v"] / d["f"]
            return let(q, lambda q: F.struct(q.alias("q"), ((d["v1"] - q * d["f1"]) / d["f"]).alias("q1")))

        def summed(d: Column, m: Column) -> Column:
            q2 = (d["v2"] - 2 * m["q1"] * d["f1"] - m["q"] * d["f2"]) / d["f"]
            rate = d["f1"] / d["f"]
            return record(
                v=d["v"], v1=d["v1"], v2=d["v2"], f=d["f"], f1=d["f1"], f2=d["f2"], quad=s["quad"] + d["v"] * m["q"], quad1=s["quad1"] + d["v1"] * m["q"] + d["v"] * m["q1"],
                quad2=s["quad2"] + d["v2"] * m["q"] + 2 * d["v1"] * m["q1"] + d["v"] * q2, logs=s["logs"] + F.log(d["f"]), logs1=s["logs1"] + rate,
                logs2=s["logs2"] + d["f2"] / d["f"] - rate * rate, i=s["i"] + 1,
            )

        return let(let(let(h, second), third), lambda d: let(rates(d), lambda m: summed(d, m)))

    def told(s: Column) -> Column:
        rate = s["quad1"] / s["quad"]
        curve = -s["i"] / 2 * (s["quad2"] / s["quad"] - rate * rate) - s["logs2"] / 2
        held = record(loglike=concentrated(s["i"], s["quad"], s["logs"]), score=-s["i"] / 2 * rate - s["logs1"] / 2, curvature=curve)
        return F.when(s["quad"] > 0, held)  # null for a series of zeros, and an empty one

    return let(F.aggregate(y, first, step), told)


def ma1_score(arrays: DataFrame, ids: list[str], theta: Column | float) -> DataFrame:
    """ids, loglike, score, curvature of an MA(1) at theta, for each array `y`; null for a series of zeros."""
    return arrays.select(*ids, ma1_tangent(F.col("y"), column(theta)).alias("_t")).select(*ids, "_t.*")


def fit_ma1_fold(arrays: DataFrame, ids: list[str]) -> DataFrame:
    """ids, theta, loglike, scale, std_err, n_iter, converged, error: an MA(1) fitted to each array `y` by Newton steps in a fold.

    The steps keep a bracket in which the score falls through zero, and halve it where Newton's step would leave it. Where the score
    keeps its sign up to the edge, the edge is the estimate and `converged` is false. An empty or constant-zero series has an error.
    """
    first = record(lo=-EDGE, hi=EDGE, x=0.0, step=1.0, n=0.0)

    def move(s: Column, y: Column) -> Column:
        def by(t: Column) -> Column:
            lo, hi = F.when(t["score"] > 0, s["x"]).otherwise(s["lo"]), F.when(t["score"] > 0, s["hi"]).otherwise(s["x"])
            newton = s["x"] - t["score"] / t["curvature"]

            def bracketed(b: Column) -> Column:
                x = F.when((t["curvature"] < 0) & (b["new"] > b["lo"]) & (b["new"] < b["hi"]), b["new"]).otherwise((b["lo"] + b["hi"]) / 2)
                return let(x, lambda x: record(lo=b["lo"], hi=b["hi"], x=x, step=F.abs(x - s["x"]), n=s["n"] + 1))

            return let(record(lo=lo, hi=hi, new=newton), bracketed)

        return F.when(s["step"] < 1e-12, s).otherwise(let(ma1_tangent(y, s["x"]), by))

    y = F.col("y")
    sound = F.exists(y, lambda v: v != 0)
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), first, lambda s, _: move(s, y))
    found = arrays.select(*ids, "y", F.when(sound, steps).alias("_s"))
    told = found.select(*ids, "_s", "y", F.when(F.col("_s").isNotNull(), ma1_tangent(y, F.col("_s.x"))).alias("_t"))
    quad = filter_fold(y, (0, 0, 1), [F.col("_s.x")])
    return told.select(
        *ids, F.col("_s.x").alias("theta"), F.col("_t.loglike").alias("loglike"), F.when(F.col("_s").isNotNull(), let(quad, lambda q: q["quad"] / q["n"])).alias("scale"),
        F.when(F.col("_t.curvature") < 0, F.sqrt(-1 / F.col("_t.curvature"))).alias("std_err"), F.col("_s.n").cast("int").alias("n_iter"),
        ((F.abs("_t.score") < 1e-6 * F.size("y")) & (F.abs("_s.x") < 1 - 2e-6)).alias("converged"), F.when(F.col("_s").isNull(), "the scale is zero").alias("error"),
    )


# Transforms of any order.


def stationary_fold(x: Column) -> Column:
    """Any array of numbers as the coefficients of a stationary AR polynomial of that order: Levinson's recursion upwards."""
    def up(c: Column, v: Column) -> Column:
        r = v / F.sqrt(1 + v * v)
        return let(r, lambda r: F.concat(F.zip_with(c, F.reverse(c), lambda a, b: a + r * b), F.array(r)))

    grown = F.aggregate(x, F.array().cast("array<double>"), up)
    return F.transform(grown, lambda v: -v)


def unconstrained_fold(coefs: Column) -> Column:
    """The numbers that stationary_fold maps to these coefficients: the recursion downwards. Beyond the border, those just inside."""
    def down(s: Column, _: Column) -> Column:
        last = F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.element_at(s["c"], -1)))
        head = F.slice(s["c"], F.lit(1), F.size(s["c"]) - 1)
        lower = lambda r: F.zip_with(head, F.reverse(head), lambda a, b: (a - r * b) / (1 - r * r))
        return let(last, lambda r: F.struct(lower(r).alias("c"), F.concat(F.array(r / F.sqrt(1 - r * r)), s["x"]).alias("x")))

    first = F.struct(F.transform(coefs, lambda v: -v).alias("c"), F.array().cast("array<double>").alias("x"))
    return F.aggregate(coefs, first, down)["x"]


def invertible_fold(x: Column) -> Column:
    """Any array of numbers as the coefficients of an invertible MA polynomial."""
    return F.transform(stationary_fold(x), lambda v: -v)
