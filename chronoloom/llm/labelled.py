"""A bounded sample of labelled documents, which the quality models are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import id_column

SAMPLE = 8000


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves 1 on division by 3; such labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def in_order(sample: DataFrame) -> DataFrame:
    """A sample with numbers for ids, by which rows are put in order on the driver: hashes where ids aren't integers."""
    key, kind = id_column(sample)
    return sample.withColumn("doc_id", key if kind == "bigint" else F.xxhash64("doc_id"))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most `most` rows (doc_id, text, n_chars, quality) of `docs` with a label outside the held-out third.

    The ids are those with the smallest hashes, so the sample is the same for the same labels and as good as random. An id
    with several labels counts by its smallest; null ids and null labels are left out.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.length("text")
    texts = docs.select("doc_id", "text", n_chars.cast("long").alias("n_chars"))
    return texts.join(F.broadcast(ids), "doc_id")  # `most` rows of two numbers
