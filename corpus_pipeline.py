"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import drop_folder, scratch_folder
from chronoloom.llm.decontaminate import decontaminated
from chronoloom.llm.jaccard import one_of_each
from chronoloom.llm.mixing import mix_texts
from chronoloom.llm.quality_fm import keep_good, train
from chronoloom.llm.sharding import byte_size, shard

N_SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier scores at 0.5 or more; it learns from labels outside the held-out third.

    Null and empty texts have no words and are scored as such; repeated rows, null ids and rows without a label are scored each.
    An empty table stays empty. All columns pass through.
    """
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles link at a similarity of 0.8: the one of least id.

    Null texts and texts without words link with nothing and all stay. Of repeated rows one stays; rows without an id are linked
    like others and give way to rows with one.
    """
    return one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain 80 % of a benchmark item's five-word shingles.

    Null and empty texts contain nothing and stay. Rows that share an id, or have none, go together if one of them contains an item.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to their targets, as documents' taken words; see mix_texts.

    Null texts and texts without words are never taken and go. A null source is a source; repeated rows are taken each.
    """
    return mix_texts(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, shard and slot: contiguous shards of nearly equal bytes, in the order of doc_id.

    A null text has no bytes but those of a row; null ids come first; repeated rows each get a slot of their own.
    """
    sized = docs.withColumn("size", byte_size(F.col("text")))
    return shard(sized, N_SHARDS)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

# A trained model decides in the first stage and hashes in the fourth, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the scratch folder and read again, and the one before is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            drop_folder(spark, f"{folder}/{i - 1}")
    return docs
