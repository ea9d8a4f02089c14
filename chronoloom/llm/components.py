"""Connected components of a graph given as edges: joined inside each task first, then by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import drop_folder, written


TASK_EDGES = 1 << 21  # of 16 bytes: what a task joins by itself at most


def least_of_group(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node on an edge that isn't the least of its group, and that least node."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    up = np.arange(len(names))
    while (up[a] != up[b]).any():
        low = np.minimum(up[a], up[b])
        np.minimum.at(up, up[a], low)
        np.minimum.at(up, up[b], low)
        while (up[up] != up).any():
            up = up[up]
    other = np.flatnonzero(up != np.arange(len(names)))
    return names[other], names[up[other]]


def _joined_in_tasks(edges: DataFrame) -> DataFrame:
    """The same groups by fewer edges: a task's edges, TASK_EDGES at a time, become one to each node from the least of its group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def out() -> pa.RecordBatch:
            a, b = least_of_group(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += batch.num_rows
            if n >= TASK_EDGES:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return edges.select("a", "b").mapInArrow(rows, "a long, b long")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of each node are hung on its least neighbour; small star: smaller ones and itself."""
    near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    both = near.join(least, "a")
    hung = both.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        hung = hung.unionByName(least.where("a <> m").select("a", F.col("m").alias("b")))
    return hung.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node on an edge (a, b) of long ids: label is the component's least node.

    Loops, repeated edges and either direction are fine; edges with a null end are left out. An empty table gives an empty
    result. While there are more than TASK_EDGES edges, rounds of joining inside tasks and of stars go on until the edges stay the
    same; their number grows with the logarithm of the longest path. As many as that or fewer are joined in one task. Each
    round's edges are a table in the scratch folder, and those of the round before are deleted.
    """
    spark = edges.sparkSession
    print_of = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    now, folder = written(_joined_in_tasks(edges.where("a is not null and b is not null and a <> b")))
    last, this = None, now.agg(*print_of).first()
    while this != last:
        tasks = 1 + this["n"] // TASK_EDGES
        joined = _joined_in_tasks(now.coalesce(tasks))
        after, new_folder = written(joined if tasks == 1 else _stars(_stars(joined, True), False))
        drop_folder(spark, folder)
        now, folder = after, new_folder
        if tasks == 1:
            break
        last, this = this, now.agg(*print_of).first()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
