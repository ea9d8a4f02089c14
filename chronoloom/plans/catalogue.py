"""Named queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.spec import Spec
from chronoloom.operators import folds, hierarchy, ranges, sarimax, series, table_functions
from chronoloom.operators.model import SarimaxPanel
from chronoloom.sources import panel

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PHI, THETA = 0.6, 0.3
STEPS, ALPHA = 6, 0.1
Z05, Z10 = NormalDist().inv_cdf(0.975), NormalDist().inv_cdf(1 - ALPHA / 2)


def query(sql: str | None = None):
    """Registers a query by its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Rounds away what depends on the order of additions."""
    return df.withColumns({c: F.round(c, places) for c in columns})


# Panels: event sums by type and day, order totals by month, quantities and mean discounts by supplier and month.


def events_daily(spark, sf_dir) -> DataFrame:
    days = panel.bucketed(table(spark, sf_dir, "events"), ["event_type"], F.col("ts"), "day", {"y": F.sum("value")})
    return panel.long_panel(days, ["event_type"], F.col("bucket"), F.col("y"))


def orders_monthly(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("series", F.lit("orders"))
    months = panel.bucketed(orders, ["series"], F.col("o_orderdate"), "month", {"y": F.sum("o_totalprice")})
    return panel.long_panel(months, ["series"], F.col("bucket"), F.col("y"))


def supplier_monthly(spark, sf_dir) -> DataFrame:
    aggs = {"y": F.sum("l_quantity"), "x1": F.avg("l_discount")}
    months = panel.bucketed(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_shipdate"), "month", aggs)
    return panel.long_panel(months, ["l_suppkey"], F.col("bucket"), F.col("y"), {"x1": F.col("x1")})


def user_events(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return panel.long_panel(events, ["user_id"], F.struct("ts", "event_id"), F.col("value"), span=F.date_trunc("day", "ts"))


def centred(p: DataFrame, ids: list[str]) -> DataFrame:
    return ranges.with_means(p, ids, ["y"]).withColumn("y", F.col("y") - F.col("_mean_y")).drop("_mean_y")


EVENTS = """events_daily AS (
  SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS INTEGER) AS t, y
  FROM (SELECT event_type, date_trunc('day', ts) AS day, sum(value) AS y FROM events GROUP BY ALL))"""
ORDERS = """orders_monthly AS (
  SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS INTEGER) AS t, y
  FROM (SELECT 'orders' AS series, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS y FROM orders GROUP BY ALL))"""
SUPPLIERS = """supplier_monthly AS (
  SELECT l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY month) - 1 AS INTEGER) AS t, y, x1
  FROM (SELECT l_suppkey, date_trunc('month', l_shipdate) AS month, sum(l_quantity) AS y, avg(l_discount) AS x1 FROM lineitem GROUP BY ALL))"""
CENTRED = EVENTS + """, c AS (SELECT event_type, t, y - avg(y) OVER (PARTITION BY event_type) AS y FROM events_daily)"""
LAGGED = CENTRED + ", l AS (SELECT event_type, t, y, lag(y) OVER (PARTITION BY event_type ORDER BY t) AS b FROM c)"


@query(f"WITH {EVENTS} SELECT event_type, t, round(y, 4) AS y FROM events_daily")
def panel_daily(spark, sf_dir):
    return rounded(events_daily(spark, sf_dir), 4, "y")


@query(f"WITH {ORDERS} SELECT series, t, round(y, 2) AS y FROM orders_monthly")
def panel_monthly(spark, sf_dir):
    return rounded(orders_monthly(spark, sf_dir), 2, "y")


@query(f"WITH {SUPPLIERS} SELECT l_suppkey, t, round(y, 4) AS y, round(x1, 6) AS x1 FROM supplier_monthly")
def panel_exog(spark, sf_dir):
    return rounded(rounded(supplier_monthly(spark, sf_dir), 4, "y"), 6, "x1")


@query("""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS b, sum(value) AS y FROM events GROUP BY ALL),
r AS (SELECT event_type, unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM h GROUP BY event_type)
SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY b) - 1 AS INTEGER) AS t, round(coalesce(y, 0), 4) AS y
FROM r LEFT JOIN h USING (event_type, b)
""")
def panel_gapfill(spark, sf_dir):
    hours = panel.bucketed(table(spark, sf_dir, "events"), ["event_type"], F.col("ts"), "hour", {"y": F.sum("value")})
    filled = panel.gap_filled(hours, ["event_type"], "hour")
    return rounded(panel.long_panel(filled, ["event_type"], F.col("bucket"), F.col("y")), 4, "y")


@query("""
SELECT user_id, count(*) AS n_obs, CAST(sum(CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 1 ELSE 0 END) AS BIGINT) AS n_bad,
  CASE WHEN sum(CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 1 ELSE 0 END) > 0 THEN 'endog contains NaN or Inf'
       WHEN count(*) < 65 THEN 'too few observations: ' || count(*) || ' < 65' END AS error
FROM events GROUP BY user_id
""")
def panel_quality(spark, sf_dir):
    return panel.quality(user_events(spark, sf_dir), ["user_id"], 65)


@query("""
SELECT s AS l_suppkey, CASE WHEN p IS NULL THEN 'no parameters for this series' ELSE 'no series for these parameters' END AS error
FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem) FULL JOIN (SELECT s_suppkey AS p FROM supplier WHERE s_suppkey % 3 = 0) ON s = p
WHERE p IS NULL
UNION ALL SELECT s_suppkey, 'no series for these parameters' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)
""")
def params_pairing(spark, sf_dir):
    params = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"), F.array(F.lit(PHI)).alias("params"))
    return panel.unpaired(table(spark, sf_dir, "lineitem").select("l_suppkey"), params, ["l_suppkey"])


@query(f"WITH {ORDERS} SELECT * FROM (SELECT series, t, round(y - lag(y) OVER (ORDER BY t), 2) AS y FROM orders_monthly) WHERE t >= 1")
def difference_d1(spark, sf_dir):
    return rounded(series.difference(orders_monthly(spark, sf_dir), ["series"], 1), 2, "y")


@query(f"WITH {ORDERS} SELECT * FROM (SELECT series, t, round(y - 2 * lag(y) OVER (ORDER BY t) + lag(y, 2) OVER (ORDER BY t), 2) AS y FROM orders_monthly) WHERE t >= 2")
def difference_d2(spark, sf_dir):
    return rounded(series.difference(orders_monthly(spark, sf_dir), ["series"], 2), 2, "y")


@query(f"WITH {ORDERS} SELECT * FROM (SELECT series, t, round(y - lag(y, 12) OVER (ORDER BY t), 2) AS y FROM orders_monthly) WHERE t >= 12")
def seasonal_difference_s12(spark, sf_dir):
    return rounded(series.difference(orders_monthly(spark, sf_dir), ["series"], 0, 1, 12), 2, "y")


@query(f"""WITH {CENTRED}, k AS (SELECT unnest(range(0, 8)) AS lag), n AS (SELECT event_type, count(*) AS n FROM c GROUP BY event_type)
SELECT a.event_type, CAST(k.lag AS INTEGER) AS lag, round(sum(a.y * b.y) / any_value(n.n), 4) AS acov
FROM k JOIN c a ON TRUE JOIN c b ON b.event_type = a.event_type AND b.t = a.t - k.lag JOIN n ON n.event_type = a.event_type GROUP BY a.event_type, k.lag""")
def acov_lags(spark, sf_dir):
    return rounded(series.autocovariance(events_daily(spark, sf_dir), ["event_type"], list(range(8))), 4, "acov")


@query(f"""WITH {CENTRED}, g AS (
  SELECT a.event_type, sum(a.y * a.y) / count(*) AS g0, coalesce(sum(a.y * b.y), 0) / count(*) AS g1, coalesce(sum(a.y * d.y), 0) / count(*) AS g2,
    coalesce(sum(a.y * w.y), 0) / count(*) AS g7, 2 * sum(a.y * b.y) / sum(CASE WHEN b.t IS NOT NULL THEN a.y * a.y + b.y * b.y END) AS burg
  FROM c a LEFT JOIN c b ON b.event_type = a.event_type AND b.t = a.t - 1 LEFT JOIN c d ON d.event_type = a.event_type AND d.t = a.t - 2
  LEFT JOIN c w ON w.event_type = a.event_type AND w.t = a.t - 7 GROUP BY a.event_type),
r AS (SELECT *, g1 / g0 AS r1, (g2 / g0 - (g1 / g0) ** 2) / (1 - (g1 / g0) ** 2) AS p2 FROM g)
SELECT event_type, round(burg, 6) AS burg_ar1, round(r1 * (1 - p2), 6) AS yw2_1, round(p2, 6) AS yw2_2,
  round(greatest(-0.99, least(0.99, r1)), 6) AS ma1, round(greatest(-0.99, least(0.99, g7 / g0)), 6) AS seasonal_ma1 FROM r""")
def low_order_starts(spark, sf_dir):
    return rounded(series.low_order_starts(events_daily(spark, sf_dir), ["event_type"], 7), 6, "burg_ar1", "yw2_1", "yw2_2", "ma1", "seasonal_ma1")


ACOV_SQL = f"""WITH {CENTRED}, g AS (
  SELECT a.event_type, sum(a.y * a.y) / count(*) AS g0, {", ".join(f"sum(a.y * coalesce(l{k}.y, 0)) / count(*) AS g{k}" for k in (1, 2, 3, 7, 14))}
  FROM c a {" ".join(f"LEFT JOIN c l{k} ON l{k}.event_type = a.event_type AND l{k}.t = a.t - {k}" for k in (1, 2, 3, 7, 14))} GROUP BY a.event_type)"""


@query(ACOV_SQL + """, a1 AS (SELECT *, g1 / g0 AS k1, g0 * (1 - (g1 / g0) ** 2) AS e1 FROM g), a2 AS (SELECT *, (g2 - k1 * g1) / e1 AS k2 FROM a1),
a3 AS (SELECT *, k1 - k2 * k1 AS b1, e1 * (1 - k2 * k2) AS e2 FROM a2), a4 AS (SELECT *, (g3 - b1 * g2 - k2 * g1) / e2 AS k3 FROM a3)
SELECT event_type, round(b1 - k3 * k2, 6) AS ar1, round(k2 - k3 * b1, 6) AS ar2, round(k3, 6) AS ar3 FROM a4""")
def yule_walker_p3(spark, sf_dir):
    return rounded(series.yule_walker(events_daily(spark, sf_dir), ["event_type"], 3), 6, "ar1", "ar2", "ar3")


@query(ACOV_SQL + """ SELECT event_type, round(g7 / g0 * (1 - p2), 6) AS ar1, round(p2, 6) AS ar2
FROM (SELECT *, (g14 / g0 - (g7 / g0) ** 2) / (1 - (g7 / g0) ** 2) AS p2 FROM g)""")
def seasonal_yule_walker_p2(spark, sf_dir):
    return rounded(series.yule_walker(events_daily(spark, sf_dir), ["event_type"], 2, 7), 6, "ar1", "ar2")


@query(ACOV_SQL + """ SELECT event_type, round(greatest(-0.99, least(0.99, (g1 - g1 / g0 * g2) / (g0 - g1 * g1 / g0))), 6) AS ma1,
  round(greatest(-0.99, least(0.99, g2 / g0)), 6) AS ma2 FROM g""")
def innovations_ma2(spark, sf_dir):
    return rounded(series.innovations_ma(events_daily(spark, sf_dir), ["event_type"], 2), 6, "ma1", "ma2")


@query(ACOV_SQL + """ SELECT event_type, round(greatest(-0.99, least(0.99, (g7 - g7 / g0 * g14) / (g0 - g7 * g7 / g0))), 6) AS ma1,
  round(greatest(-0.99, least(0.99, g14 / g0)), 6) AS ma2 FROM g""")
def seasonal_innovations_ma2(spark, sf_dir):
    return rounded(series.innovations_ma(events_daily(spark, sf_dir), ["event_type"], 2, 7), 6, "ma1", "ma2")


@query(f"WITH {SUPPLIERS} SELECT l_suppkey, round(regr_slope(y, x1), 4) AS beta_x1 FROM supplier_monthly GROUP BY l_suppkey")
def exog_slope(spark, sf_dir):
    return rounded(series.exog_slopes(supplier_monthly(spark, sf_dir), ["l_suppkey"], ["x1"]), 4, "beta_x1")


@query(f"""WITH {ORDERS} SELECT * FROM (
  SELECT series, t, round(y - 0.5 * lag(y) OVER (ORDER BY t) - 0.2 * lag(y, 2) OVER (ORDER BY t), 2) AS y FROM orders_monthly) WHERE t >= 2""")
def ar_residuals(spark, sf_dir):
    return rounded(series.lag_filtered(orders_monthly(spark, sf_dir), ["series"], [0.5, 0.2]), 2, "y")


@query(f"WITH {ORDERS} SELECT * FROM (SELECT series, t, round(y - 0.4 * lag(y, 12) OVER (ORDER BY t), 2) AS y FROM orders_monthly) WHERE t >= 12")
def sar_residuals(spark, sf_dir):
    return rounded(series.lag_filtered(orders_monthly(spark, sf_dir), ["series"], [0.4], 12), 2, "y")


FIRST_FOUR = f"""WITH {SUPPLIERS}, x AS (
  SELECT l_suppkey, {", ".join(f"max(CASE WHEN t = {k} THEN y / 100 - 1.5 END) AS x{k + 1}" for k in range(4))} FROM supplier_monthly WHERE t < 4 GROUP BY l_suppkey HAVING count(*) = 4)"""


def first_four(spark, sf_dir) -> DataFrame:
    """l_suppkey and x: a supplier's first four months as numbers around zero, to serve as parameters."""
    arrays = panel.to_arrays(supplier_monthly(spark, sf_dir).where("t < 4"), ["l_suppkey"]).where("size(y) = 4")
    return arrays.select("l_suppkey", F.transform("y", lambda v: v / 100 - 1.5).alias("x"))


@query(FIRST_FOUR + """, c AS (SELECT l_suppkey, [1.0, -x1 / 10, -x2 / 10] AS a, [1.0, 0, 0, 0, -x3 / 10, 0, 0, 0, -x4 / 10] AS b FROM x)
SELECT l_suppkey, CAST(k AS INTEGER) AS power, round(list_sum(list_transform(range(0, 3), lambda i: CASE WHEN k - i BETWEEN 0 AND 8 THEN a[i + 1] * b[k - i + 1] ELSE 0 END)), 9) + 0.0 AS coef
FROM c, range(0, 11) AS r(k)""")
def poly_expand(spark, sf_dir):
    x = first_four(spark, sf_dir)
    ar, sar = (F.transform(F.slice("x", start, 2), lambda v: v / 10) for start in (1, 3))
    rows = x.select("l_suppkey", F.posexplode(series.convolve(series.lag_polynomial(ar, 1, -1.0), series.lag_polynomial(sar, 4, -1.0))).alias("power", "coef"))
    return rounded(rows, 9, "coef").withColumn("coef", F.col("coef") + 0.0)  # no minus zero


def _levinson_sql(order: int) -> str:
    """Nested queries that add, order by order, the coefficients of a stationary AR polynomial from x1, x2, ..."""
    at = f"(SELECT *, {', '.join(f'x{k} / sqrt(1 + x{k} * x{k}) AS r{k}' for k in range(1, order + 1))} FROM x)"
    for k in range(1, order + 1):
        inner = [f"c{k - 1}_{j} + r{k} * c{k - 1}_{k - j} AS c{k}_{j}" for j in range(1, k)]
        at = f"(SELECT *, {', '.join([*inner, f'r{k} AS c{k}_{k}'])} FROM {at})"
    return at


@query(FIRST_FOUR + f" SELECT l_suppkey, {', '.join(f'round(-c4_{j}, 8) + 0.0 AS ar{j}' for j in range(1, 5))} FROM {_levinson_sql(4)}")
def stationary_transform(spark, sf_dir):
    told = first_four(spark, sf_dir).select("l_suppkey", folds.stationary_fold(F.col("x")).alias("c"))
    got = rounded(told.select("l_suppkey", *[(F.get("c", F.lit(j)) + 0.0).alias(f"ar{j + 1}") for j in range(4)]), 8, *[f"ar{j}" for j in range(1, 5)])
    return got.withColumns({f"ar{j}": F.col(f"ar{j}") + 0.0 for j in range(1, 5)})


@query(FIRST_FOUR + " SELECT l_suppkey, round(x1, 5) + 0.0 AS x1, round(x2, 5) + 0.0 AS x2, round(x3, 5) + 0.0 AS x3, round(x4, 5) + 0.0 AS x4 FROM x")
def transform_round_trip(spark, sf_dir):
    """Parameters made invertible and back: what comes back is what went in."""
    told = first_four(spark, sf_dir).select("l_suppkey", folds.invertible_fold(F.col("x")).alias("c"))
    back = told.select("l_suppkey", folds.unconstrained_fold(F.transform("c", lambda v: -v)).alias("x"))
    got = rounded(back.select("l_suppkey", *[F.get("x", F.lit(j)).alias(f"x{j + 1}") for j in range(4)]), 5, "x1", "x2", "x3", "x4")
    return got.withColumns({f"x{j}": F.col(f"x{j}") + 0.0 for j in range(1, 5)})


def _burg_sql(key: str, order: int) -> str:
    """CTEs over c (key, t, y): lattice errors level by level, reflections k0, k1, ... and the coefficients of the last order in ar."""
    out = [f"l0 AS MATERIALIZED (SELECT * FROM (SELECT {key}, t, y AS f, lag(y) OVER (PARTITION BY {key} ORDER BY t) AS b FROM c) WHERE b IS NOT NULL)"]
    for m in range(order):
        out.append(f"k{m} AS MATERIALIZED (SELECT {key}, 2 * sum(f * b) / sum(f * f + b * b) AS k FROM l{m} GROUP BY {key})")
        step = f"SELECT l.{key}, t, f - k * b AS f, lag(b - k * f) OVER (PARTITION BY l.{key} ORDER BY t) AS b FROM l{m} l JOIN k{m} USING ({key})"
        out.append(f"l{m + 1} AS MATERIALIZED (SELECT * FROM ({step}) WHERE b IS NOT NULL)")
        inner = [f"a{j} - k * a{m + 1 - j} AS a{j}" for j in range(1, m + 1)]
        before = f"FROM k{m}" if m == 0 else f"FROM ar{m - 1} JOIN k{m} USING ({key})"
        out.append(f"ar{m} AS (SELECT {key}, {', '.join([*inner, f'k AS a{m + 1}'])} {before})")
    return ", ".join(out)


@query(f"WITH {CENTRED}, {_burg_sql('event_type', 2)} SELECT event_type, round(a1, 6) AS ar1, round(a2, 6) AS ar2 FROM ar1")
def burg_p2(spark, sf_dir):
    got = series.burg(events_daily(spark, sf_dir), ["event_type"], 2)
    return rounded(got.select("event_type", *[F.get("ar", F.lit(j)).alias(f"ar{j + 1}") for j in range(2)]), 6, "ar1", "ar2")


@query(f"WITH {CENTRED}, {_burg_sql('event_type', 4)} SELECT event_type, {', '.join(f'round(a{j}, 6) AS ar{j}' for j in range(1, 5))} FROM ar3")
def burg_p4(spark, sf_dir):
    got = series.burg(events_daily(spark, sf_dir), ["event_type"], 4)
    return rounded(got.select("event_type", *[F.get("ar", F.lit(j)).alias(f"ar{j + 1}") for j in range(4)]), 6, "ar1", "ar2", "ar3", "ar4")


# The long autoregression has ten lags, as these series have 30 values or more.
@query(f"""WITH {SUPPLIERS}, c AS (SELECT l_suppkey, t, y - avg(y) OVER (PARTITION BY l_suppkey) AS y FROM supplier_monthly), {_burg_sql('l_suppkey', 10)},
e AS (SELECT s.l_suppkey, t, y, y - ({" + ".join(f"a{k} * lag(y, {k}) OVER w" for k in range(1, 11))}) AS e FROM supplier_monthly s JOIN ar9 USING (l_suppkey) WINDOW w AS (PARTITION BY s.l_suppkey ORDER BY t)),
x AS (SELECT l_suppkey, t, y, lag(y) OVER w AS x1, lag(e) OVER w AS x2 FROM e WINDOW w AS (PARTITION BY l_suppkey ORDER BY t)),
g AS (SELECT l_suppkey, sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22, sum(x1 * y) AS b1, sum(x2 * y) AS b2 FROM x WHERE t >= 11 GROUP BY l_suppkey),
r AS (SELECT l_suppkey, g11 + 1e-10 / 2 * (g11 + g22) AS g11, g12, g22 + 1e-10 / 2 * (g11 + g22) AS g22, b1, b2 FROM g)
SELECT l_suppkey, round(greatest(-0.95, least(0.95, (g22 * b1 - g12 * b2) / (g11 * g22 - g12 * g12))), 6) AS ar1,
  round(greatest(-0.95, least(0.95, (g11 * b2 - g12 * b1) / (g11 * g22 - g12 * g12))), 6) AS ma1 FROM r""")
def hannan_rissanen_11(spark, sf_dir):
    return rounded(series.hannan_rissanen(supplier_monthly(spark, sf_dir), ["l_suppkey"], 1, 1), 6, "ar1", "ma1")


AR1_SQL = f"""WITH {LAGGED} SELECT event_type, round(-count(*) / 2.0 * (ln(2 * pi()) + ln((sum((y - {PHI} * b) ** 2) + max(CASE WHEN b IS NULL THEN y * y * (1 - {PHI} ** 2) END)) / count(*)) + 1)
  + 0.5 * ln(1 - {PHI} ** 2), 5) AS loglike FROM l GROUP BY event_type"""


def events_arrays(spark, sf_dir) -> DataFrame:
    return panel.to_arrays(centred(events_daily(spark, sf_dir), ["event_type"]), ["event_type"])


@query(AR1_SQL)
def loglike_ar1_fold(spark, sf_dir):
    return rounded(series.ar1_loglike(events_arrays(spark, sf_dir), ["event_type"], PHI), 5, "loglike")


@query(AR1_SQL)
def loglike_ar1(spark, sf_dir):
    got = sarimax.loglike(events_arrays(spark, sf_dir), ["event_type"], Spec.of((1, 0, 0)), [PHI])
    return rounded(got.drop("error"), 5, "loglike")


MA1_SQL = f"""WITH RECURSIVE {CENTRED}, f AS (
  SELECT event_type, t, y AS v, CAST(1 + {THETA} ** 2 AS DOUBLE) AS f FROM c WHERE t = 0
  UNION ALL
  SELECT c.event_type, c.t, c.y - {THETA} * f.v / f.f, 1 + {THETA} ** 2 - {THETA} ** 2 / f.f FROM f JOIN c ON c.event_type = f.event_type AND c.t = f.t + 1)
SELECT event_type, round(-count(*) / 2.0 * (ln(2 * pi()) + ln(sum(v * v / f) / count(*)) + 1) - 0.5 * sum(ln(f)), 5) AS loglike FROM f GROUP BY event_type"""


@query(MA1_SQL)
def loglike_ma1_fold(spark, sf_dir):
    return rounded(series.ma1_loglike(events_arrays(spark, sf_dir), ["event_type"], THETA), 5, "loglike")


@query(MA1_SQL)
def loglike_ma1(spark, sf_dir):
    got = sarimax.loglike(events_arrays(spark, sf_dir), ["event_type"], Spec.of((0, 0, 1)), [THETA])
    return rounded(got.drop("error"), 5, "loglike")


PHI2 = 0.2


@query(f"""WITH {CENTRED}, l AS (SELECT event_type, t, y, lag(y) OVER w AS b, lag(y, 2) OVER w AS b2 FROM c WINDOW w AS (PARTITION BY event_type ORDER BY t)),
s AS (SELECT event_type, count(*) AS n, sum(CASE WHEN t >= 2 THEN (y - {PHI} * b - {PHI2} * b2) ** 2 END) AS rest, max(CASE WHEN t = 0 THEN y END) AS y0, max(CASE WHEN t = 1 THEN y END) AS y1 FROM l GROUP BY event_type),
v AS (SELECT *, (1 - {PHI2}) / ((1 + {PHI2}) * ((1 - {PHI2}) ** 2 - {PHI} ** 2)) AS g0 FROM s),
d AS (SELECT *, g0 * {PHI} / (1 - {PHI2}) AS g1 FROM v),
q AS (SELECT *, rest + (g0 * (y0 * y0 + y1 * y1) - 2 * g1 * y0 * y1) / (g0 * g0 - g1 * g1) AS quad FROM d)
SELECT event_type, round(-n / 2.0 * (ln(2 * pi()) + ln(quad / n) + 1) - 0.5 * ln(g0 * g0 - g1 * g1), 5) AS loglike FROM q""")
def loglike_ar2_fold(spark, sf_dir):
    """An AR(2)'s likelihood; the SQL takes the joint density of the first two values, then one-step errors."""
    return rounded(folds.loglike_fold(events_arrays(spark, sf_dir), ["event_type"], (2, 0, 0), [PHI, PHI2]), 5, "loglike")


@query(f"""WITH RECURSIVE {CENTRED}, f AS (
  SELECT event_type, t, y, y AS v, CAST((1 + 2 * {PHI} * {THETA} + {THETA} ** 2) / (1 - {PHI} ** 2) AS DOUBLE) AS f FROM c WHERE t = 0
  UNION ALL
  SELECT c.event_type, c.t, c.y, c.y - {PHI} * f.y - {THETA} * f.v / f.f, 1 + {THETA} ** 2 - {THETA} ** 2 / f.f FROM f JOIN c ON c.event_type = f.event_type AND c.t = f.t + 1)
SELECT event_type, round(-count(*) / 2.0 * (ln(2 * pi()) + ln(sum(v * v / f) / count(*)) + 1) - 0.5 * sum(ln(f)), 5) AS loglike FROM f GROUP BY event_type""")
def loglike_arma11_fold(spark, sf_dir):
    return rounded(folds.loglike_fold(events_arrays(spark, sf_dir), ["event_type"], (1, 0, 1), [PHI, THETA]), 5, "loglike")


@query(f"""WITH {CENTRED}, d AS (SELECT * FROM (SELECT event_type, t, y - lag(y) OVER (PARTITION BY event_type ORDER BY t) AS y FROM c) WHERE t >= 1),
l AS (SELECT event_type, y, lag(y) OVER (PARTITION BY event_type ORDER BY t) AS b FROM d)
SELECT event_type, round(-count(*) / 2.0 * (ln(2 * pi()) + ln((sum((y - {PHI} * b) ** 2) + max(CASE WHEN b IS NULL THEN y * y * (1 - {PHI} ** 2) END)) / count(*)) + 1) + 0.5 * ln(1 - {PHI} ** 2), 3) AS loglike
FROM l GROUP BY event_type""")
def loglike_arima110_fold(spark, sf_dir):
    """A level with a diffuse start and AR(1) steps; the SQL is the steps' own likelihood."""
    return rounded(folds.loglike_fold(events_arrays(spark, sf_dir), ["event_type"], (1, 1, 0), [PHI]), 3, "loglike")


@query(f"""WITH RECURSIVE {CENTRED}, f AS (
  SELECT event_type, t, y AS v, CAST(0 AS DOUBLE) AS v1, CAST(1 + {THETA} ** 2 AS DOUBLE) AS f, CAST(2 * {THETA} AS DOUBLE) AS f1 FROM c WHERE t = 0
  UNION ALL
  SELECT c.event_type, c.t, c.y - {THETA} * f.v / f.f, -(f.v / f.f) - {THETA} * (f.v1 * f.f - f.v * f.f1) / (f.f * f.f),
    1 + {THETA} ** 2 - {THETA} ** 2 / f.f, 2 * {THETA} - 2 * {THETA} / f.f + {THETA} ** 2 * f.f1 / (f.f * f.f) FROM f JOIN c ON c.event_type = f.event_type AND c.t = f.t + 1)
SELECT event_type, round(-count(*) / 2.0 * (ln(2 * pi()) + ln(sum(v * v / f) / count(*)) + 1) - 0.5 * sum(ln(f)), 5) AS loglike,
  round(-count(*) / 2.0 * sum((2 * v * v1 * f - v * v * f1) / (f * f)) / sum(v * v / f) - 0.5 * sum(f1 / f), 5) AS score FROM f GROUP BY event_type""")
def score_ma1_fold(spark, sf_dir):
    return rounded(folds.ma1_score(events_arrays(spark, sf_dir), ["event_type"], THETA).drop("curvature"), 5, "loglike", "score")


@query()
def fit_ma1_fold(spark, sf_dir):
    """Newton steps inside a fold; the tests hold it against the other optimiser."""
    return folds.fit_ma1_fold(events_arrays(spark, sf_dir), ["event_type"])


SEASON, SEASONAL_THETA = 24, -0.6


@query(f"""WITH RECURSIVE h AS (SELECT event_type, date_trunc('hour', ts) AS b, sum(value) AS y FROM events GROUP BY ALL),
r AS (SELECT event_type, unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM h GROUP BY event_type),
p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY b) - 1 AS t, coalesce(y, 0) AS y FROM r LEFT JOIN h USING (event_type, b)),
c AS (SELECT event_type, t, y - avg(y) OVER (PARTITION BY event_type) AS y FROM p), f AS (
  SELECT event_type, t, y AS v, CAST(1 + {SEASONAL_THETA**2} AS DOUBLE) AS f FROM c WHERE t < {SEASON}
  UNION ALL
  SELECT c.event_type, c.t, c.y - ({SEASONAL_THETA}) * f.v / f.f, 1 + {SEASONAL_THETA**2} - {SEASONAL_THETA**2} / f.f FROM f JOIN c ON c.event_type = f.event_type AND c.t = f.t + {SEASON})
SELECT event_type, round(-count(*) / 2.0 * (ln(2 * pi()) + ln(sum(v * v / f) / count(*)) + 1) - 0.5 * sum(ln(f)), 4) AS loglike FROM f GROUP BY event_type""")
def loglike_seasonal_ma(spark, sf_dir):
    """Hours with a season of a day: a series is as many moving averages of order one as the season has hours, which the SQL folds."""
    hours = panel.bucketed(table(spark, sf_dir, "events"), ["event_type"], F.col("ts"), "hour", {"y": F.sum("value")})
    rows = panel.long_panel(panel.gap_filled(hours, ["event_type"], "hour"), ["event_type"], F.col("bucket"), F.col("y"))
    arrays = panel.to_arrays(centred(rows, ["event_type"]), ["event_type"])
    return rounded(sarimax.loglike(arrays, ["event_type"], Spec.of((0, 0, 0), (0, 0, 1, SEASON)), [SEASONAL_THETA]).drop("error"), 4, "loglike")


@query(f"""WITH {LAGGED}, s AS (SELECT 2.5 AS sigma2) SELECT event_type, round(-0.5 * (count(b) * ln(2 * pi()) + count(b) * ln(any_value(sigma2)) + sum((y - {PHI} * b) ** 2) / any_value(sigma2)), 3) AS loglike
FROM l, s WHERE b IS NOT NULL GROUP BY event_type""")
def loglike_full_scale(spark, sf_dir):
    spec = Spec.of((1, 0, 0), concentrate_scale=False, enforce_stationarity=False)
    # The first value is left to the diffuse start: with kappa finite, what remains of it is below the rounding.
    got = sarimax.loglike(events_arrays(spark, sf_dir), ["event_type"], spec, [PHI, 2.5])
    return rounded(got.drop("error"), 3, "loglike")


FIT_SQL = f"""WITH {SUPPLIERS}, l AS (SELECT l_suppkey, t, y, lag(y) OVER (PARTITION BY l_suppkey ORDER BY t) AS b FROM supplier_monthly),
s AS (SELECT l_suppkey, sum(y * b) AS yb, sum(b * b) AS bb, sum(CASE WHEN b IS NOT NULL THEN y * y END) AS yy, count(*) AS n, max_by(y, t) AS last FROM l GROUP BY l_suppkey),
f AS (SELECT l_suppkey, yb / bb AS phi, (yy - yb * yb / bb) / (n - 1) AS scale, n, last FROM s)"""
LL = "(-(n - 1) / 2.0 * (ln(2 * pi()) + ln(scale) + 1))"


@query(FIT_SQL + "SELECT l_suppkey, round(phi, 8) AS phi, round(scale, 4) AS scale, " + f"round({LL}, 5) AS loglike, n AS n_obs FROM f")
def ar1_least_squares(spark, sf_dir):
    got = series.ar1_least_squares(supplier_monthly(spark, sf_dir), ["l_suppkey"])
    return rounded(rounded(rounded(got.drop("last"), 8, "phi"), 4, "scale"), 5, "loglike")


@query(FIT_SQL + f"SELECT l_suppkey, round(phi, 3) AS phi, round({LL}, 3) AS loglike, n AS n_obs FROM f")
def fit_ar1_diffuse(spark, sf_dir):
    arrays = panel.to_arrays(supplier_monthly(spark, sf_dir), ["l_suppkey"])
    got = sarimax.fit(arrays, ["l_suppkey"], Spec.of((1, 0, 0), enforce_stationarity=False))
    return rounded(got.select("l_suppkey", F.get("params", F.lit(0)).alias("phi"), "loglike", "n_obs"), 3, "phi", "loglike")


@query(FIT_SQL + f"SELECT l_suppkey, round(4 - 2 * {LL}, 4) AS aic, round(2 * ln(n) - 2 * {LL}, 4) AS bic FROM f")
def information_criteria(spark, sf_dir):
    got = series.ar1_least_squares(supplier_monthly(spark, sf_dir), ["l_suppkey"])
    return rounded(series.information_criteria(got, F.lit(2)).select("l_suppkey", "aic", "bic"), 4, "aic", "bic")


AHEAD = "SELECT l_suppkey, h, phi ** h * last AS mean, scale * (1 - phi ** (2 * h)) / (1 - phi ** 2) AS variance FROM f, range(1, {n}) AS r(h)"


@query(FIT_SQL + f"SELECT l_suppkey, CAST(h AS INTEGER) AS h, round(mean, 5) AS mean, round(variance, 3) AS variance FROM ({AHEAD.format(n=STEPS + 1)})")
def forecast_ar1_closed(spark, sf_dir):
    fits = series.ar1_least_squares(supplier_monthly(spark, sf_dir), ["l_suppkey"])
    return rounded(rounded(series.ar1_forecast(fits, ["l_suppkey"], STEPS), 5, "mean"), 3, "variance")


def _ar1_params(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = supplier_monthly(spark, sf_dir)
    fits = series.ar1_least_squares(p, ["l_suppkey"]).select("l_suppkey", F.array("phi").alias("params"))
    return panel.to_arrays(p, ["l_suppkey"]), fits


@query(FIT_SQL + f"""SELECT l_suppkey, CAST(h AS INTEGER) AS h, round(mean, 4) AS mean, round(variance, 3) AS variance,
  round(mean - {Z05!r} * sqrt(variance), 4) AS ci_lower, round(mean + {Z05!r} * sqrt(variance), 4) AS ci_upper FROM ({AHEAD.format(n=STEPS + 1)})""")
def forecast_ar1(spark, sf_dir):
    arrays, fits = _ar1_params(spark, sf_dir)
    got = sarimax.forecast(arrays, ["l_suppkey"], Spec.of((1, 0, 0)), fits, STEPS).drop("error")
    return rounded(rounded(got, 4, "mean", "ci_lower", "ci_upper"), 3, "variance")


@query(FIT_SQL + f"""SELECT l_suppkey, CAST(h AS INTEGER) AS h, round(mean, 4) AS mean, round(variance, 3) AS variance,
  round(mean - {Z05!r} * sqrt(variance), 4) AS ci_lower, round(mean + {Z05!r} * sqrt(variance), 4) AS ci_upper FROM ({AHEAD.format(n=STEPS + 1)})""")
def forecast_table_function(spark, sf_dir):
    """The rows of forecast_ar1, by SQL."""
    arrays, fits = _ar1_params(spark, sf_dir)
    table_functions.register(spark)
    text = f"SELECT l_suppkey, f.h, f.mean, f.variance, f.ci_lower, f.ci_upper FROM {{fitted}} s, LATERAL sarimax_forecast(s.y, s.params, array(1, 0, 0), array(0, 0, 0, 0), {STEPS}, 0.05D) f"
    return rounded(rounded(spark.sql(text, fitted=arrays.join(fits, "l_suppkey")), 4, "mean", "ci_lower", "ci_upper"), 3, "variance")


@query(FIT_SQL + f"""SELECT l_suppkey, CAST(h AS INTEGER) AS h, round(mean - {Z10!r} * sqrt(variance), 4) AS ci_lower,
  round(mean + {Z10!r} * sqrt(variance), 4) AS ci_upper FROM ({AHEAD.format(n=STEPS + 1)})""")
def conf_int_alpha(spark, sf_dir):
    fits = series.ar1_least_squares(supplier_monthly(spark, sf_dir), ["l_suppkey"])
    got = series.with_interval(series.ar1_forecast(fits, ["l_suppkey"], STEPS), ALPHA)
    return rounded(got.select("l_suppkey", "h", "ci_lower", "ci_upper"), 4, "ci_lower", "ci_upper")


@query(f"WITH {LAGGED}, s AS (SELECT event_type, sum((y - {PHI} * b) ** 2) / count(b) AS scale FROM l GROUP BY event_type) SELECT event_type, t, round(y - {PHI} * b, 4) AS residual, round((y - {PHI} * b) / sqrt(scale), 5) AS standardized_residual FROM l JOIN s USING (event_type) WHERE t >= 1")
def residuals_ar1(spark, sf_dir):
    got = sarimax.residuals(events_arrays(spark, sf_dir), ["event_type"], Spec.of((1, 0, 0)), [PHI]).where("t >= 1").drop("error")
    return rounded(rounded(got, 4, "residual"), 5, "standardized_residual")


@query("""
SELECT event_type, CAST(i AS INTEGER) AS idx, name FROM (SELECT DISTINCT event_type FROM events),
  (VALUES (0, 'x1'), (1, 'ar.L1'), (2, 'ar.L2'), (3, 'ma.L1'), (4, 'ar.S.L12'), (5, 'ma.S.L12'), (6, 'ma.S.L24'), (7, 'sigma2')) AS v(i, name)
""")
def param_names(spark, sf_dir):
    """Each series with the names of its model's parameters."""
    spec = Spec.of((2, 1, 1), (1, 1, 2, 12), n_exog=1, concentrate_scale=False)
    series_ids = table(spark, sf_dir, "events").select("event_type").distinct()
    return series_ids.select("event_type", F.posexplode(F.array(*[F.lit(n) for n in spec.names])).alias("idx", "name"))


@query("""
WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT n < 66 AS failed, count(*) AS n_series FROM n GROUP BY 1
""")
def batch_error_isolation(spark, sf_dir):
    arrays = panel.to_arrays(user_events(spark, sf_dir), ["user_id"])
    spec = Spec.of((1, 0, 0), (1, 0, 0, 63))
    got = sarimax.fit(arrays, ["user_id"], spec, maxiter=0)
    return got.groupBy(F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n_series"))


NODES_SQL = """b AS (SELECT r_name, n_name, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
months AS (SELECT unnest(generate_series((SELECT min(m) FROM b), (SELECT max(m) FROM b), INTERVAL 1 MONTH)) AS m),
leaf AS (SELECT k.r_name, k.n_name, months.m, coalesce(b.y, 0) AS y FROM (SELECT DISTINCT r_name, n_name FROM b) k JOIN months ON TRUE
  LEFT JOIN b ON b.r_name = k.r_name AND b.n_name = k.n_name AND b.m = months.m),
node AS (SELECT CAST(2 - grouping(r_name) - grouping(n_name) AS INTEGER) AS level, r_name, n_name, m, sum(y) AS y FROM leaf
  GROUP BY GROUPING SETS ((m), (r_name, m), (r_name, n_name, m))),
panel AS (SELECT level, r_name, n_name, CAST(row_number() OVER (PARTITION BY level, r_name, n_name ORDER BY m) - 1 AS INTEGER) AS t, y FROM node)"""


def nation_panel(spark, sf_dir) -> DataFrame:
    """level, r_name, n_name, t, y: order totals by month of the whole, the regions and the nations; months without orders are zero."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = orders.groupBy("c_nationkey", F.date_trunc("month", "o_orderdate").alias("bucket")).agg(F.sum("o_totalprice").alias("y"))
    leaves = sums.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name", "bucket").agg(F.sum("y").alias("y"))
    dense = panel.gap_filled(leaves, ["r_name", "n_name"], "month", whole=True)
    nodes = hierarchy.rolled_up(dense, ["r_name", "n_name"], "bucket", "y")
    return panel.long_panel(nodes, ["level", "r_name", "n_name"], F.col("bucket"), F.col("y"))


@query(f"WITH {NODES_SQL} SELECT level, r_name, n_name, t, round(y, 2) AS y FROM panel")
def hierarchy_panel(spark, sf_dir):
    return rounded(nation_panel(spark, sf_dir), 2, "y")


@query(f"""WITH {NODES_SQL}, c AS (SELECT *, avg(y) OVER w AS mu, y - avg(y) OVER w AS c FROM panel WINDOW w AS (PARTITION BY level, r_name, n_name)),
l AS (SELECT *, lag(c) OVER (PARTITION BY level, r_name, n_name ORDER BY t) AS b FROM c),
f AS (SELECT level, r_name, n_name, any_value(mu) AS mu, sum(c * b) / sum(b * b) AS phi, max_by(c, t) AS last, sum(y) AS seen FROM l GROUP BY level, r_name, n_name),
d AS (SELECT level, r_name, n_name, CAST(h AS INTEGER) AS h, mu + phi ** h * last AS mean, seen FROM f, range(1, {STEPS + 1}) AS g(h)),
u AS (SELECT CAST(2 - grouping(r_name) - grouping(n_name) AS INTEGER) AS level, r_name, n_name, h, sum(mean) AS bottom_up FROM d WHERE level = 2
  GROUP BY GROUPING SETS ((h), (r_name, h), (r_name, n_name, h)))
SELECT d.level, d.r_name, d.n_name, d.h, round(d.mean, 1) AS mean, round(bottom_up, 1) AS bottom_up, round(top.mean * d.seen / top.seen, 1) AS top_down
FROM d JOIN u ON u.level = d.level AND u.h = d.h AND u.r_name IS NOT DISTINCT FROM d.r_name AND u.n_name IS NOT DISTINCT FROM d.n_name
JOIN d top ON top.level = 0 AND top.h = d.h""")
def hierarchy_forecast(spark, sf_dir):
    """AR(1) forecasts of the whole, each region and each nation, with what the nations add up to and what the whole hands down."""
    nodes = nation_panel(spark, sf_dir)
    ahead = hierarchy.ar1_with_mean(nodes, ["level", "r_name", "n_name"], STEPS)
    return rounded(hierarchy.reconciled(ahead, nodes, ["r_name", "n_name"]), 1, "mean", "bottom_up", "top_down")


# Fits that SQL can't express; the tests hold them against published values.


def supplier_arrays(spark, sf_dir, exog: bool = False) -> DataFrame:
    return panel.to_arrays(supplier_monthly(spark, sf_dir), ["l_suppkey"], ["x1"] if exog else None)


def fitted(df: DataFrame) -> DataFrame:
    """Fit rows with the parameters one by one."""
    keys = [c for c in df.columns if c not in sarimax.FIT_NAMES]
    return df.select(*keys, F.posexplode_outer("params").alias("idx", "coef"), "loglike", "aic", "bic", "n_obs", "converged", "method", "error")


@query()
def fit_arma11(spark, sf_dir):
    return fitted(sarimax.fit(supplier_arrays(spark, sf_dir), ["l_suppkey"], Spec.of((1, 0, 1))))


@query()
def fit_sarima(spark, sf_dir):
    arrays = panel.to_arrays(orders_monthly(spark, sf_dir), ["series"])
    return fitted(sarimax.fit(arrays, ["series"], Spec.of((0, 1, 1), (0, 1, 1, 12)), maxiter=60))


@query()
def fit_exog(spark, sf_dir):
    return fitted(sarimax.fit(supplier_arrays(spark, sf_dir, True), ["l_suppkey"], Spec.of((1, 0, 0), n_exog=1)))


@query()
def fit_nelder_mead(spark, sf_dir):
    return fitted(sarimax.fit(events_arrays(spark, sf_dir), ["event_type"], Spec.of((1, 0, 1)), method="nelder-mead"))


@query()
def fit_multi(spark, sf_dir):
    return fitted(sarimax.fit(events_arrays(spark, sf_dir), ["event_type"], Spec.of((2, 0, 1)), method="lbfgsb-multi"))


def _fitted_sql(source: str, coefs: list[str], converged: str, method: str) -> str:
    """The columns of fitted() from a table of event_type, v and f (errors and their variances over the scale) and the coefficients."""
    rows = ", ".join(f"({i}, {c})" for i, c in enumerate(coefs))
    k = len(coefs) + 1
    return f"""s AS (SELECT event_type, count(*) AS n, -count(*) / 2.0 * (ln(2 * pi()) + ln(sum(v * v / f) / count(*)) + 1) - 0.5 * sum(ln(f)) AS ll,
  {", ".join(f"any_value({c}) AS {c}" for c in coefs)} FROM {source} GROUP BY event_type)
SELECT event_type, CAST(idx AS INTEGER) AS idx, round(coef, 6) AS coef, round(ll, 4) AS loglike, round({2 * k} - 2 * ll, 4) AS aic, round({k} * ln(n) - 2 * ll, 4) AS bic,
  n AS n_obs, {converged} AS converged, '{method}' AS method, CAST(NULL AS VARCHAR) AS error FROM s, LATERAL (VALUES {rows}) AS v(idx, coef)"""


def _left(first: int) -> str:
    """The product of 1 - k * k over Burg's reflections from `first` on."""
    return " * ".join(f"(1 - k{j}.k * k{j}.k)" for j in range(first, 4))


# A value with fewer than four before it is predicted by Burg's coefficients of that lower order.
_LOWER = "".join(f" WHEN {m} THEN y - ({' + '.join(f'ar{m - 1}.a{j} * l{j}' for j in range(1, m + 1))})" for m in range(1, 4))
BURG_ERRORS = f"""lags AS (SELECT event_type, t, y, {", ".join(f"lag(y, {j}) OVER w AS l{j}" for j in range(1, 5))} FROM c WINDOW w AS (PARTITION BY event_type ORDER BY t)),
e AS (SELECT lags.event_type, CASE t WHEN 0 THEN y{_LOWER} ELSE y - ({" + ".join(f"ar3.a{j} * l{j}" for j in range(1, 5))}) END AS v,
  CASE t {" ".join(f"WHEN {m} THEN 1 / ({_left(m)})" for m in range(4))} ELSE 1 END AS f, ar3.a1, ar3.a2, ar3.a3, ar3.a4
  FROM lags {" ".join(f"JOIN k{m} ON k{m}.event_type = lags.event_type JOIN ar{m} ON ar{m}.event_type = lags.event_type" for m in range(4))})"""


@query(f"WITH {CENTRED}, {_burg_sql('event_type', 4)}, {BURG_ERRORS}, {_fitted_sql('e', ['a1', 'a2', 'a3', 'a4'], 'TRUE', 'burg-direct')}")
def fit_burg_direct(spark, sf_dir):
    got = fitted(sarimax.fit(events_arrays(spark, sf_dir), ["event_type"], Spec.of((4, 0, 0))))
    return rounded(rounded(got, 6, "coef"), 4, "loglike", "aic", "bic")


# The start values of an ARMA(1,1) by Hannan-Rissanen, over a long autoregression of ten lags as these series have 30 values.
@query(f"""WITH RECURSIVE {CENTRED}, {_burg_sql("event_type", 10)},
e AS (SELECT c.event_type, t, y, y - ({" + ".join(f"a{k} * lag(y, {k}) OVER w" for k in range(1, 11))}) AS e FROM c JOIN ar9 USING (event_type) WINDOW w AS (PARTITION BY c.event_type ORDER BY t)),
x AS (SELECT event_type, t, y, lag(y) OVER w AS x1, lag(e) OVER w AS x2 FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t)),
g AS (SELECT event_type, sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22, sum(x1 * y) AS b1, sum(x2 * y) AS b2 FROM x WHERE t >= 11 GROUP BY event_type),
r AS (SELECT event_type, g11 + 1e-10 / 2 * (g11 + g22) AS g11, g12, g22 + 1e-10 / 2 * (g11 + g22) AS g22, b1, b2 FROM g),
p AS MATERIALIZED (SELECT event_type, greatest(-0.95, least(0.95, (g22 * b1 - g12 * b2) / (g11 * g22 - g12 * g12))) AS phi,
  greatest(-0.95, least(0.95, (g11 * b2 - g12 * b1) / (g11 * g22 - g12 * g12))) AS theta FROM r),
z AS (SELECT event_type, t, y, phi, theta FROM c JOIN p USING (event_type)), f AS (
  SELECT event_type, t, y, phi, theta, y AS v, CAST((1 + 2 * phi * theta + theta ** 2) / (1 - phi ** 2) AS DOUBLE) AS f FROM z WHERE t = 0
  UNION ALL
  SELECT z.event_type, z.t, z.y, z.phi, z.theta, z.y - z.phi * f.y - z.theta * f.v / f.f, 1 + z.theta ** 2 - z.theta ** 2 / f.f FROM f JOIN z ON z.event_type = f.event_type AND z.t = f.t + 1),
{_fitted_sql("f", ["phi", "theta"], "FALSE", "lbfgsb")}""")
def fit_maxiter0(spark, sf_dir):
    got = fitted(sarimax.fit(events_arrays(spark, sf_dir), ["event_type"], Spec.of((1, 0, 1)), maxiter=0))
    return rounded(rounded(got, 6, "coef"), 4, "loglike", "aic", "bic")


SARIMA = {"phi": 0.3, "theta": -0.4, "sphi": 0.2, "stheta": -0.5}


def _arma11_acov(phi: float, theta: float, lag: str) -> str:
    return f"CASE WHEN {lag} = 0 THEN {(1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)!r} ELSE {(phi + theta) * (1 + phi * theta) / (1 - phi * phi)!r} * {phi} ** (abs({lag}) - 1) END"


# Autocovariances of the differences are those of the plain and the seasonal part convolved; Durbin and Levinson's recursion
# makes one-step errors and their variances from them.
@query(f"""WITH RECURSIVE {ORDERS},
d AS (SELECT series, t, y - lag(y) OVER w - lag(y, 12) OVER w + lag(y, 13) OVER w AS w FROM orders_monthly WINDOW w AS (PARTITION BY series ORDER BY t)),
w AS MATERIALIZED (SELECT series, list(w ORDER BY t) AS w FROM d WHERE t >= 13 GROUP BY series),
h AS (SELECT h, sum(({_arma11_acov(SARIMA["sphi"], SARIMA["stheta"], "m")}) * ({_arma11_acov(SARIMA["phi"], SARIMA["theta"], "(h - 12 * m)")})) AS g
  FROM range(0, 200) AS a(h), range(-40, 41) AS b(m) GROUP BY h),
g AS MATERIALIZED (SELECT list(g ORDER BY h) AS g FROM h),
s AS (
  SELECT series, w, g, 0 AS n, CAST([] AS DOUBLE[]) AS phi, g[1] AS f, w[1] AS v FROM w, g
  UNION ALL
  SELECT series, w, g, n + 1, phi, f, w[n + 2] - list_sum(list_transform(range(1, n + 2), lambda j: phi[j] * w[n + 2 - j]))
  FROM (SELECT series, w, g, n, list_append(list_transform(range(1, n + 1), lambda j: phi[j] - k * phi[n + 1 - j]), k) AS phi, f * (1 - k * k) AS f
    FROM (SELECT *, (g[n + 2] - coalesce(list_sum(list_transform(range(1, n + 1), lambda j: phi[j] * g[n + 2 - j])), 0)) / f AS k FROM s WHERE n + 1 < len(w)))
)
SELECT series, round(-count(*) / 2.0 * (ln(2 * pi()) + ln(sum(v * v / f) / count(*)) + 1) - 0.5 * sum(ln(f)), 3) AS loglike FROM s GROUP BY series""")
def loglike_sarima(spark, sf_dir):
    arrays = panel.to_arrays(orders_monthly(spark, sf_dir), ["series"])
    got = sarimax.loglike(arrays, ["series"], Spec.of((1, 1, 1), (1, 1, 1, 12)), list(SARIMA.values()))
    return rounded(got.drop("error"), 3, "loglike")


@query()
def forecast_sarima(spark, sf_dir):
    arrays = panel.to_arrays(orders_monthly(spark, sf_dir), ["series"])
    return sarimax.forecast(arrays, ["series"], Spec.of((0, 1, 1), (0, 1, 1, 12)), [-0.6, -0.5], 12)


@query(f"""WITH {SUPPLIERS}, r AS (SELECT l_suppkey, t, x1, y - 100.0 * x1 AS r FROM supplier_monthly),
l AS (SELECT *, lag(r) OVER (PARTITION BY l_suppkey ORDER BY t) AS b FROM r),
s AS (SELECT l_suppkey, count(*) AS n, max_by(r, t) AS last, sum((r - {PHI} * b) ** 2) / (count(*) - 1) AS scale FROM l GROUP BY l_suppkey),
f AS (SELECT s.l_suppkey, h, {PHI} ** h * last + 100.0 * r.x1 AS mean, scale * (1 - {PHI} ** (2 * h)) / (1 - {PHI} ** 2) AS variance
  FROM s JOIN range(1, {STEPS + 1}) AS g(h) ON TRUE JOIN r ON r.l_suppkey = s.l_suppkey AND r.t = s.n - {STEPS + 1} + h)
SELECT l_suppkey, CAST(h AS INTEGER) AS h, round(mean, 4) AS mean, round(variance, 3) AS variance,
  round(mean - {Z05!r} * sqrt(variance), 4) AS ci_lower, round(mean + {Z05!r} * sqrt(variance), 4) AS ci_upper FROM f""")
def forecast_exog(spark, sf_dir):
    spec, arrays = Spec.of((1, 0, 0), n_exog=1), supplier_arrays(spark, sf_dir, True)
    future = arrays.select("l_suppkey", F.transform("x", lambda c: F.slice(c, -STEPS, STEPS)).alias("future_x"))
    got = sarimax.forecast(arrays, ["l_suppkey"], spec, [100.0, PHI], STEPS, future=future).drop("error")
    return rounded(rounded(got, 4, "mean", "ci_lower", "ci_upper"), 3, "variance")


def _future(spark, sf_dir) -> DataFrame:
    """Future discounts in long form, with gaps: suppliers by their number lack all, the last step, or have one that isn't a number."""
    of = F.pmod(F.col("l_suppkey"), F.lit(5))
    last = supplier_monthly(spark, sf_dir).select("l_suppkey", (F.col("t") + 1).alias("h"), F.when((of == 2) & (F.col("t") == 1), float("nan")).otherwise(F.col("x1")).alias("x1"))
    return last.where(F.col("h") <= STEPS).where((of != 0) & ~((of == 1) & (F.col("h") == STEPS)))


@query(f"""WITH {SUPPLIERS}, f AS (
  SELECT l_suppkey, t + 1 AS h FROM supplier_monthly WHERE t + 1 <= {STEPS} AND l_suppkey % 5 <> 0 AND NOT (l_suppkey % 5 = 1 AND t + 1 = {STEPS})),
n AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE h = 2) AS second FROM f GROUP BY l_suppkey)
SELECT s.l_suppkey, coalesce(n, 0) AS n_future, CASE WHEN n IS NULL THEN 'future_exog is required' WHEN n < {STEPS} THEN 'future_exog has ' || n || ' of {STEPS} steps'
  WHEN s.l_suppkey % 5 = 2 AND second > 0 THEN 'future_exog contains NaN or Inf' END AS error
FROM (SELECT DISTINCT l_suppkey FROM lineitem) s LEFT JOIN n USING (l_suppkey)""")
def future_regressors(spark, sf_dir):
    return panel.future_quality(supplier_monthly(spark, sf_dir), _future(spark, sf_dir), ["l_suppkey"], ["x1"], STEPS)


@query()
def param_summary_hessian(spark, sf_dir):
    spec, arrays = Spec.of((1, 0, 1)), supplier_arrays(spark, sf_dir)
    return sarimax.parameter_summary(arrays, ["l_suppkey"], spec, sarimax.fit(arrays, ["l_suppkey"], spec))


# An AR(1)'s sum of squares is quadratic in its coefficient, so both informations have closed forms at any coefficient.
@query(f"""WITH {LAGGED}, s AS (SELECT event_type, count(*) AS n, sum(CASE WHEN t = 0 THEN y * y * (1 - {PHI} ** 2) ELSE (y - {PHI} * b) ** 2 END) AS q,
  sum(CASE WHEN t = 0 THEN -2 * {PHI} * y * y ELSE -2 * b * (y - {PHI} * b) END) AS q1, sum(CASE WHEN t = 0 THEN -2 * y * y ELSE 2 * b * b END) AS q2 FROM l GROUP BY event_type),
o AS (SELECT l.event_type, sum((-0.5 * (q1 / q + CASE WHEN t = 0 THEN 2 * {PHI} / (1 - {PHI} ** 2) + n * y * y * (-2 * {PHI} / q - (1 - {PHI} ** 2) * q1 / (q * q))
  ELSE n * (-2 * b * (y - {PHI} * b) / q - (y - {PHI} * b) ** 2 * q1 / (q * q)) END)) ** 2) AS outer_sum FROM l JOIN s USING (event_type) GROUP BY l.event_type),
i AS (SELECT s.event_type, 1 / sqrt(n / 2.0 * (q2 / q - (q1 / q) ** 2) + (1 + {PHI} ** 2) / (1 - {PHI} ** 2) ** 2) AS hess, 1 / sqrt(outer_sum) AS opg FROM s JOIN o USING (event_type))
SELECT event_type, CAST(0 AS INTEGER) AS idx, 'ar.L1' AS name, CAST({PHI} AS DOUBLE) AS coef, round(hess, 5) AS std_err, round({PHI} / hess, 3) AS z, round({PHI} - {Z10!r} * opg, 5) AS opg_ci_lower,
  round(opg, 5) AS opg_std_err, round(hess - opg, 5) AS delta_std_err, round({Z10!r} * (hess - opg), 5) AS delta_ci_upper, 'ok' AS inference_status FROM i""")
def inference_both(spark, sf_dir):
    """Standard errors by the Hessian and by scores side by side, with what lies between them."""
    got = sarimax.parameter_summary(events_arrays(spark, sf_dir), ["event_type"], Spec.of((1, 0, 0)), [PHI], ALPHA, "both")
    told = got.select("event_type", "idx", "name", "coef", "std_err", "z", "opg_ci_lower", "opg_std_err", "delta_std_err", "delta_ci_upper", "inference_status")
    return rounded(rounded(told, 5, "std_err", "opg_ci_lower", "opg_std_err", "delta_std_err", "delta_ci_upper"), 3, "z")


@query()
def model_summary(spark, sf_dir):
    """The model object's fits with their parameters and errors."""
    return SarimaxPanel(events_daily(spark, sf_dir), ["event_type"], (1, 0, 1)).fit().summary()


@query()
def order_search(spark, sf_dir):
    specs = [Spec.of((p, 0, q)) for p, q in ((1, 0), (0, 1), (1, 1), (2, 0))]
    return fitted(sarimax.order_search(events_arrays(spark, sf_dir), ["event_type"], specs))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits an AR(1) to every supplier's monthly quantities and forecasts six months with intervals."""
    arrays = supplier_arrays(spark, sf_dir)
    spec = Spec.of((1, 0, 0), enforce_stationarity=False)
    return sarimax.forecast(arrays, ["l_suppkey"], spec, sarimax.fit(arrays, ["l_suppkey"], spec), STEPS)


QUERIES["flagship_forecast"] = flagship
