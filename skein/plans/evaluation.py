"""Evaluation: case sets as JSON, all metrics of all cases in one plan, reports by grouping sets."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.errors import ValidationError
from skein.functions import scoring

PASS = 0.5
CASE = "id string, query string, expected_answer string, relevant_chunk_ids array<string>, relevant_keywords array<string>, query_type string, difficulty string, metadata map<string,string>"


@dataclass(frozen=True)
class TestCase:
    id: str
    query: str
    expected_answer: str
    relevant_chunk_ids: list[str] = field(default_factory=list)
    relevant_keywords: list[str] = field(default_factory=list)
    query_type: str = "factual"
    difficulty: str = "medium"
    metadata: dict[str, str] = field(default_factory=dict)


TestCase.__test__ = False  # not a class of tests


@dataclass
class EvaluationSet:
    name: str
    description: str = ""
    version: str = "1.0"
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    metadata: dict = field(default_factory=dict)
    test_cases: list[TestCase] = field(default_factory=list)

    def add(self, query: str, expected_answer: str, **more) -> TestCase:
        case = TestCase(more.pop("id", f"test_{len(self.test_cases) + 1:03}"), query, expected_answer, **more)
        self.test_cases.append(case)
        return case

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2, ensure_ascii=False)

    @classmethod
    def load(cls, path: str) -> EvaluationSet:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        names = set(TestCase.__dataclass_fields__)
        return cls(**{k: v for k, v in d.items() if k in cls.__dataclass_fields__} | {"test_cases": [TestCase(**{k: v for k, v in c.items() if k in names}) for c in d.get("test_cases", [])]})

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(c).values()) for c in self.test_cases], CASE)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Saved case sets of any number, as rows."""
    wrapped = spark.read.schema(f"name string, test_cases array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in CASE.split(', ')))}>>").json(path, multiLine=True)
    return wrapped.select(F.col("name").alias("dataset"), F.inline("test_cases"))


def example_cases() -> EvaluationSet:
    """A small set of our own, of every type and difficulty."""
    s = EvaluationSet("examples", "questions on a made-up annual report")
    s.add("What was the total revenue in 2023?", "Total revenue was $5.3 million in 2023.", relevant_keywords=["revenue", "2023"], difficulty="easy")
    s.add("Compare profit in Q1 and Q2", "Profit rose from $100 thousand in Q1 to $350 thousand in Q2.", relevant_keywords=["profit", "Q1", "Q2"], query_type="comparison", difficulty="medium")
    s.add("How did margins change over time?", "Margins grew from 10 to 14 per cent.", relevant_keywords=["margin"], query_type="trend", difficulty="medium")
    s.add("List the business segments", "Cloud, devices and services.", relevant_keywords=["segment"], query_type="list", difficulty="easy")
    s.add("Why did expenses fall?", "Expenses fell because two plants closed.", relevant_keywords=["expense", "plant"], query_type="explanation", difficulty="hard")
    s.add("Is the company profitable?", "Yes, it made a profit of $670 thousand.", relevant_keywords=["profit"], query_type="yes_no", difficulty="easy")
    return s


def evaluate(results: DataFrame) -> DataFrame:
    """results: CASE's columns with generated string, chunk_ids and chunks arrays, latency_ms, error.

    All metrics as columns; a row with an error has zeros.  Without relevant ids, retrieval is judged by keywords.
    """
    chunks, ids = (F.coalesce(c, F.array().cast("array<string>")) for c in ("chunks", "chunk_ids"))
    judged = F.size("relevant_chunk_ids") > 0
    df = results.withColumn("r", scoring.retrieval_metrics(ids, F.coalesce("relevant_chunk_ids", F.array().cast("array<string>")))).withColumn("k", scoring.keyword_retrieval(chunks, F.coalesce("relevant_keywords", F.array().cast("array<string>"))))
    df = df.withColumn("g", scoring.generation_metrics(F.col("query"), F.col("generated"), F.col("expected_answer"), F.array_join(chunks, " "))).withColumn("e", scoring.end_to_end_metrics(F.col("query"), F.col("generated"), F.col("expected_answer"), chunks))
    ok = F.col("error").isNull()
    value = lambda c: F.when(ok, F.bround(c, 4)).otherwise(0.0)
    out = [value(F.when(judged, F.col(f"r.{m}")).otherwise(F.col(f"k.{m}"))).alias(m) for m in ("precision", "recall", "f1_score")]
    out += [value(F.when(judged, F.col(f"r.{m}")).otherwise(F.lit(0.0))).alias(m) for m in ("accuracy", "mrr", "map_score", "ndcg", "hit_rate")]
    out += [value(F.col(f"g.{m}")).alias(m) for m in ("bleu", "rouge_1", "rouge_2", "rouge_l", "answer_relevance", "faithfulness", "answer_completeness")]
    out += [value(F.col(f"e.{m}")).alias(m) for m in ("answer_correctness", "answer_similarity", "context_precision", "context_recall")]
    return df.select("id", "query", "query_type", "difficulty", "latency_ms", "error", *out)


AVERAGED = ("precision", "recall", "f1_score", "mrr", "map_score", "ndcg", "hit_rate", "bleu", "rouge_1", "rouge_2", "rouge_l", "answer_relevance", "faithfulness", "answer_completeness", "answer_correctness", "context_precision", "context_recall", "latency_ms")


def report(scores: DataFrame) -> DataFrame:
    """One pass: a row for the whole, for each query type and for each difficulty."""
    if scores.isEmpty():
        raise ValidationError("there are no results to report on")
    scores.createOrReplaceTempView("__scores")
    means = ", ".join(f"avg({c}) AS {c}" for c in AVERAGED)
    return scores.sparkSession.sql(
        f"SELECT CASE WHEN grouping(query_type) = 0 THEN 'query_type' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'all' END AS level, coalesce(query_type, difficulty, 'all') AS name, count(*) AS cases, "
        f"sum(CASE WHEN answer_correctness > {PASS} THEN 1 ELSE 0 END) AS passed, avg(CASE WHEN answer_correctness > {PASS} THEN 1.0D ELSE 0.0D END) AS pass_rate, {means} FROM __scores GROUP BY GROUPING SETS ((), (query_type), (difficulty))"
    )


def printed(rows: DataFrame) -> str:
    """A report as text, with bars of ten blocks."""
    out = []
    for r in rows.orderBy("level", "name").collect():
        out.append(f"{r.level}: {r.name} - {r.cases} cases, {r.passed} passed")
        for c in AVERAGED[:-1]:
            v = min(1.0, max(0.0, r[c] or 0.0))
            out.append(f"  {c:20} [{'█' * int(v * 10)}{'░' * (10 - int(v * 10))}] {v:.3f}")
    return "\n".join(out)


def run_cases(cases: EvaluationSet, answer: Callable[[str], dict]) -> list[dict]:
    """Ask each question; answer gives generated, chunk_ids, chunks.  A failure is the case's error."""
    import time

    out = []
    for c in cases.test_cases:
        began, got, error = time.time(), {}, None
        try:
            got = answer(c.query)
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
        out.append(asdict(c) | {"generated": got.get("generated", ""), "chunk_ids": got.get("chunk_ids", []), "chunks": got.get("chunks", []), "latency_ms": (time.time() - began) * 1000, "error": error})
    return out


RESULT = f"{CASE}, generated string, chunk_ids array<string>, chunks array<string>, latency_ms double, error string"


def result_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [x.split()[0] for x in RESULT.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RESULT)
