"""The queries op1 to op13 over whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import chat, decontaminate, jaccard, merkle, mixing, quality_fm, quality_gbt, runs, secrets, sharding, tokens, urls, warc
from chronoloom.llm.oracles import ORACLES

N_SHARDS = 40
TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op3_packed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.packed_blocks(table(spark, sf_dir, "documents"))


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.format_preferences(turns, chat.neighbour_pairs(turns))


def op4_answer_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.answer_preferences(table(spark, sf_dir, "conversations"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 gives without its model's verdicts, which SQL can't express."""
    judged = op5_url_filter(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"), N_SHARDS)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), n=4, percent=85, counted=False)


def op8_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gbt.judge(docs, quality_gbt.train(docs, table(spark, sf_dir, "labels")))


def op9_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 gives without its model's verdict, which SQL can't express."""
    return op9_quality_rules(spark, sf_dir).drop("kept", "score")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digest(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def queries() -> dict:
    found = [
        op1_quality_classifier, op2_benchmark_decontamination, op3_source_mixing, op3_packed_shards, op4_answer_preferences, op4_preference_formatting, op5_url_filter, op5_url_rules, op6_sharding,
        op7_token_counts, op8_jaccard_join, op8_jaccard_links, op9_quality_rules, op9_base_rules, op10_secret_scan,
        op11_periodic_runs, op12_merkle_manifest, op13_warc,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
