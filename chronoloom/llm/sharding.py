"""Contiguous shards of nearly equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import cut, prefix_sums

ROW_OVERHEAD = 16


def byte_size(text: Column, overhead: int = ROW_OVERHEAD) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def shard(df: DataFrame, n_shards: int, key: str = "doc_id", size: str = "size") -> DataFrame:
    """Adds `shard` and `slot`: rows in the order of key and size, cut where the sum of sizes passes equal targets.

    A row belongs to the shard in which the middle of its bytes falls, so a shard's bytes differ from the target by less than
    one row's size. Slots count from 0 inside each shard. Null keys come first; rows with equal key and size are
    interchangeable and each gets its own slot. Key ranges, and so tasks, grow in number with the bytes; rows of one key that
    holds very many, or of no key, are dealt to several ranges by a hash of the row and come in the order of that. A shard may
    stay empty if a row is larger than a target. An empty table gives an empty result. Other columns pass through, whatever
    their names, but for those called shard or slot, which are replaced.
    """
    own = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(F.struct(*own).alias("_row"), F.col(key).alias("_key"), F.col(size).alias("_size"), F.xxhash64(*own).alias("_tie"))
    key, size = "_key", "_size"
    total = df.agg(F.sum(size)).first()[0] or 1
    placed = prefix_sums(df, key, [size, "_tie"], {"_bytes": F.col(size), "_rank": F.lit(1).cast("long")}, [], total)
    at = f"cast(2 * _bytes + {size} as decimal(28, 0)) * {n_shards} div {2 * total}"
    placed = placed.withColumn("shard", F.expr(f"cast(least({n_shards - 1}, {at}) as int)"))
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    placed = placed.join(F.broadcast(first), "shard")  # n_shards rows
    return placed.select("_row.*", "shard", (F.col("_rank") - F.col("_first")).alias("slot"))


def shard_digest(docs: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32 (0 for a null text), law, shard, slot and grown_shard of every row of documents."""
    sized = docs.select(
        "doc_id",
        byte_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    out = shard(cut(sized), n_shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
