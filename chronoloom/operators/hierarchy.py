"""Hierarchical panels: series summed over the levels of their ids, and forecasts of every level held against those below and above."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.spec import MOST_STEPS
from chronoloom.operators.ranges import joined, with_means
from chronoloom.operators.series import ar1_forecast, ar1_least_squares


def rolled_up(rows: DataFrame, levels: list[str], by: str, value: str) -> DataFrame:
    """level, the ids, `by` and the sums of `value` at every level, from rows of the lowest one.

    `level` is the number of ids that a sum keeps: 0 is the whole, len(levels) the rows' own. Ids beyond it are null; a null id of the
    rows themselves is an id like others, told apart by its level. Tasks sum their own rows before anything is shuffled.
    """
    sums = rows.rollup(by, *levels).agg(F.sum(value).alias(value), F.grouping(by).alias("_all"), sum(F.grouping(c) for c in levels).alias("_above"))
    return sums.where("_all = 0").select((F.lit(len(levels)) - F.col("_above")).cast("int").alias("level"), *levels, by, value)


def ar1_with_mean(panel: DataFrame, ids: list[str], steps: int) -> DataFrame:
    """ids, h = 1..steps and mean: least-squares AR(1) forecasts around each series' mean; a constant series stays where it is."""
    if steps > MOST_STEPS:
        raise ValueError(f"forecast steps requested {steps} exceeds maximum {MOST_STEPS}")
    told = with_means(panel, ids, ["y"])
    level = told.groupBy(*ids).agg(F.first("_mean_y").alias("_level"))
    fits = ar1_least_squares(told.withColumn("y", F.col("y") - F.col("_mean_y")), ids)
    ahead = joined(ar1_forecast(fits.withColumn("phi", F.coalesce("phi", F.lit(0.0))), ids, steps), level, ids)
    return ahead.select(*ids, "h", (F.col("mean") + F.col("_level")).alias("mean"))


def reconciled(forecasts: DataFrame, panel: DataFrame, levels: list[str], value: str = "mean") -> DataFrame:
    """Adds to every node's forecasts (level, ids, h, `value`) what other levels say of it: bottom_up and top_down.

    bottom_up sums the lowest level's forecasts. top_down is the whole's forecast times the node's share of all that was seen in
    `panel` (level, ids, t, y); null where the whole came to zero.
    """
    nodes = ["level", *levels]
    lowest = forecasts.where(F.col("level") == len(levels)).select(*levels, "h", F.col(value).alias("bottom_up"))
    below = joined(forecasts, rolled_up(lowest, levels, "h", "bottom_up"), [*nodes, "h"], "left")
    seen = panel.groupBy(*nodes).agg(F.sum("y").alias("_seen"))
    whole = seen.where("level = 0").select("_seen").scalar()
    shares = seen.withColumn("_share", F.try_divide(F.col("_seen"), whole)).drop("_seen")
    top = forecasts.where("level = 0").select("h", F.col(value).alias("_top"))  # a row a step, at most MOST_STEPS
    told = joined(below, shares, nodes, "left").join(F.broadcast(top), "h", "left")
    return told.select(*nodes, "h", value, "bottom_up", (F.col("_top") * F.col("_share")).alias("top_down"))
