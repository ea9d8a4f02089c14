"""Lags and means over long series: a series is cut into ranges of t, each with the last rows of the one before it.

So a series is as many tasks as it has ranges, and one that holds a third of all rows is no hot key. The numbers t of a series are
consecutive, as long_panel makes them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_ROWS = 1 << 16


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys of which any may be null: a null is a key like others."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys])
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys if how != "left_anti"])


def range_size(most: int, rows: int | None = None) -> int:
    """Rows of a range: one at least as long as the greatest lag, so that a lag reaches into one range before only."""
    return max(RANGE_ROWS if rows is None else rows, most, 1)


def with_halo(panel: DataFrame, most: int, size: int) -> DataFrame:
    """Adds `_range` and `_own`: each row goes to its range, and, not its own, to the next one if it is among the last `most`."""
    own = F.floor(F.col("t") / size)
    ahead = F.when(F.pmod(F.col("t"), F.lit(size)) >= size - most, F.array(own, own + 1)).otherwise(F.array(own))
    return panel.withColumn("_range", F.explode(ahead)).withColumn("_own", F.col("_range") == own)


def range_totals(panel: DataFrame, ids: list[str], columns: list[str], size: int) -> DataFrame:
    """ids, `_range` of every range, and of its whole series: `_n`, `_begin`, `_end` and, for each column, its mean `_mean_<column>`."""
    sums = panel.groupBy(*ids, F.floor(F.col("t") / size).alias("_range")).agg(
        F.count("*").alias("_rows"), F.min("t").alias("_from"), F.max("t").alias("_to"),
        *[e for c in columns for e in (F.sum(c).alias(f"_sum_{c}"), F.count(c).alias(f"_count_{c}"))],
    )
    whole = Window.partitionBy(*ids)  # over one row a range
    means = [(F.sum(f"_sum_{c}").over(whole) / F.sum(f"_count_{c}").over(whole)).alias(f"_mean_{c}") for c in columns]
    return sums.select(*ids, "_range", F.sum("_rows").over(whole).alias("_n"), F.min("_from").over(whole).alias("_begin"), F.max("_to").over(whole).alias("_end"), *means)


def with_means(panel: DataFrame, ids: list[str], columns: list[str], rows: int | None = None) -> DataFrame:
    """Adds each column's mean over its series, as `_mean_<column>`."""
    size = range_size(0, rows)
    totals = range_totals(panel, ids, columns, size).drop("_n", "_begin", "_end")
    return joined(panel.withColumn("_range", F.floor(F.col("t") / size)), totals, [*ids, "_range"]).drop("_range")


def with_lags(panel: DataFrame, ids: list[str], lags: dict[str, tuple[Column | str, int]], rows: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds, for each name, what a column (or expression) was so many rows before in its series; null before its first row."""
    most = max([k for _, k in lags.values()], default=0)
    dealt = with_halo(panel, most, range_size(most, rows))
    w = Window.partitionBy(*ids, "_range").orderBy("t")
    told = dealt.withColumns({name: F.lag(c, k).over(w) for name, (c, k) in lags.items()})
    return told.where("_own").drop("_range", "_own").select(*(keep or panel.columns), *lags)


def with_past(panel: DataFrame, ids: list[str], column: str, most: int, totals: list[str], more: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Adds `_past`, the values of a column from `most` rows before on up to the row's own, latest first; and totals of the series.

    `totals` are columns whose means are added (see range_totals, whose other columns are there too); `more` has columns by series
    to add. All is one shuffle by series and range.
    """
    size = range_size(most, rows)
    told = range_totals(panel, ids, totals, size)
    if more is not None:
        told = joined(told, more, ids)
    dealt = joined(with_halo(panel, most, size), told, [*ids, "_range"])
    w = Window.partitionBy(*ids, "_range").orderBy("t").rowsBetween(-most, 0)
    past = F.reverse(F.collect_list(column).over(w))
    return dealt.withColumn("_past", past).where("_own").drop("_own", "_range")
