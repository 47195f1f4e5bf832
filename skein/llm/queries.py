"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table
from skein.llm.oracles import NEAR_DUPLICATES, QUALITY, WARC


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.toxicity import held_out, score_documents, train

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score_documents(docs, model).withColumn("hits", F.size("hits"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.pii import pseudonym_rows

    return pseudonym_rows(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id").drop("tkey")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.near_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.token_counts import attribute_tokens

    return attribute_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.secrets import find_secrets, span_digests, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return span_digests(find_secrets(docs, train(docs)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.quality import quality

    found = quality(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_counts": op7_token_counts,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {"op6_near_duplicates": NEAR_DUPLICATES, "op9_quality": QUALITY, "op10_warc": WARC}
