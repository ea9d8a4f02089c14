"""Panels of series: long rows (ids, t, y, regressors) from tables, and their array form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.operators.ranges import joined


def long_panel(rows: DataFrame, ids: list[str], order: Column, y: Column, exog: dict[str, Column] | None = None, span: Column | None = None) -> DataFrame:
    """ids, t (0, 1, ... by `order` within ids), y and the regressors as doubles, one row for each row of `rows`.

    With `span`, a stretch of time such as the day or the month of `order`, rows are numbered in each span from the number of those
    in the spans before it: no task gets more than one span of a series. Without it, a series is numbered in one task.
    """
    extra = [c.cast("double").alias(n) for n, c in (exog or {}).items()]
    if span is None:
        numbered = F.row_number().over(Window.partitionBy(*ids).orderBy(order)) - 1
        return rows.select(*ids, numbered.cast("int").alias("t"), y.cast("double").alias("y"), *extra)
    spanned = rows.select(*ids, span.alias("_span"), order.alias("_order"), y.cast("double").alias("y"), *extra)
    counts = spanned.groupBy(*ids, "_span").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*ids).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*ids, "_span", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*ids, "_span").orderBy("_order")) - 1
    told = joined(spanned, starts, [*ids, "_span"])
    return told.select(*ids, (F.col("_start") + inside).cast("int").alias("t"), "y", *(exog or {}))


def bucketed(rows: DataFrame, ids: list[str], when: Column, unit: str, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates rows into time buckets: ids, bucket (a timestamp), and the aggregates."""
    return rows.groupBy(*ids, F.date_trunc(unit, when).alias("bucket")).agg(*[c.alias(n) for n, c in aggs.items()])


def gap_filled(buckets: DataFrame, ids: list[str], unit: str, fill: float = 0.0, value: str = "y", whole: bool = False) -> DataFrame:
    """Adds the missing buckets between each series' first and last, or with `whole` those of all series, with `fill` as value."""
    spans = buckets.groupBy(*ids).agg(F.min("bucket").alias("_from"), F.max("bucket").alias("_to"))
    if whole:
        spans = spans.withColumns({"_from": buckets.agg(F.min("bucket")).scalar(), "_to": buckets.agg(F.max("bucket")).scalar()})
    every = spans.select(*ids, F.explode(F.sequence("_from", "_to", F.expr(f"interval 1 {unit}"))).alias("bucket"))
    return every.join(buckets, [*ids, "bucket"], "left").select(*ids, "bucket", F.coalesce(value, F.lit(fill)).alias(value))


def quality(panel: DataFrame, ids: list[str], least_obs: int = 2) -> DataFrame:
    """For each series: n_obs, n_bad (null, NaN or infinite values), and the error that fitting it would give, or null."""
    bad = F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))
    found = panel.groupBy(*ids).agg(F.count("*").alias("n_obs"), F.sum(bad.cast("long")).alias("n_bad"))
    short = F.concat(F.lit("too few observations: "), F.col("n_obs").cast("string"), F.lit(f" < {least_obs}"))
    return found.withColumn("error", F.when(F.col("n_bad") > 0, "endog contains NaN or Inf").when(F.col("n_obs") < least_obs, short))


def to_arrays(panel: DataFrame, ids: list[str], exog: list[str] | None = None) -> DataFrame:
    """One row for each series: ids, y, and x (an array for each regressor) if there are any; ordered by t."""
    exog = exog or []
    rows = F.array_sort(F.collect_list(F.struct("t", "y", *exog)))
    packed = panel.groupBy(*ids).agg(rows.alias("_rows"))
    x = [F.array(*[F.col(f"_rows.{c}") for c in exog]).alias("x")] if exog else []
    return packed.select(*ids, F.col("_rows.y").alias("y"), *x)


def unpaired(panel: DataFrame, params: DataFrame, ids: list[str]) -> DataFrame:
    """Series without parameters and parameters without a series: ids and error."""
    series = panel.select(*ids).distinct()
    left = series.join(params, ids, "left_anti").select(*ids, F.lit("no parameters for this series").alias("error"))
    right = params.join(series, ids, "left_anti").select(*ids, F.lit("no series for these parameters").alias("error"))
    return left.unionByName(right)


def future_arrays(future: DataFrame, ids: list[str], exog: list[str], steps: int) -> DataFrame:
    """ids and future_x, an array for each regressor, from long future rows (ids, h = 1, 2, ..., regressors); h beyond `steps` goes."""
    rows = F.array_sort(F.collect_list(F.struct("h", *exog)))
    packed = future.where(F.col("h").between(1, steps)).groupBy(*ids).agg(rows.alias("_rows"))
    return packed.select(*ids, F.array(*[F.col(f"_rows.{c}") for c in exog]).alias("future_x"))


def future_quality(panel: DataFrame, future: DataFrame, ids: list[str], exog: list[str], steps: int) -> DataFrame:
    """For each series: n_future, the different h of 1 to `steps` that it has, and the error that forecasting it would give, or null.

    Counts come by aggregation on either side, so no series' rows meet in one task. Future rows of no series have an error too.
    """
    wrong = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in exog])
    used = future.where(F.col("h").between(1, steps))
    told = used.groupBy(*ids).agg(F.countDistinct("h").alias("_n"), F.count("*").alias("_rows"), F.sum(wrong.cast("long")).alias("_wrong"))
    series = panel.select(*ids).distinct().withColumn("_known", F.lit(True))
    both = joined(series, told, ids, "left").unionByName(joined(told, series, ids, "left_anti").withColumn("_known", F.lit(False)))
    n = F.coalesce("_n", F.lit(0)).cast("long")
    error = (
        F.when(~F.col("_known"), "no series for this future")
        .when(n == 0, "future_exog is required")
        .when(n < steps, F.concat(F.lit("future_exog has "), n.cast("string"), F.lit(f" of {steps} steps")))
        .when(F.col("_rows") > n, "future_exog repeats a step")
        .when(F.col("_wrong") > 0, "future_exog contains NaN or Inf")
    )
    return both.select(*ids, n.alias("n_future"), error.alias("error"))
