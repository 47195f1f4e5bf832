"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; between stages the rows are written as
Parquet and read again.  All stages but the last return the columns of documents.

* toxicity: documents that op1 predicts as toxic, by score and threshold, go (model trained on the labels that may be learned from);
* near_dedup: one document of each group of near copies stays (five words, similarity of 0.8 or more);
* decontamination: documents that hold a benchmark item go;
* mixing: each document comes once for every pass that takes words of it, so repeated sources repeat rows;
* sharding: the shard and slot of each row, with the columns of documents except the text.

The edge cases of a stage are those of its operator; an empty table passes through all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import spill, table
from skein.llm.decontaminate import drop_contaminated
from skein.llm.mixing import mixed_rows
from skein.llm.near_dedup import drop_near_duplicates
from skein.llm.sharding import shard_documents
from skein.llm.toxicity import THRESHOLD, drop_toxic, held_out, train

REJECT_SCORE = THRESHOLD


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return drop_toxic(docs, model, threshold=REJECT_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Trained scores, alignment and propagation are not SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spill(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
