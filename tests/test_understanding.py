from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.functions import understanding as un


def analyse(spark, *queries):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "i int, q string")
    return [r.a for r in df.select("i", un.analysis(F.col("q")).alias("a")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("kind", "queries"),
    [
        ("greeting", ["hi", " Hello ", "good morning"]), ("chitchat", ["how are you", "what can you do"]), ("gratitude", ["thanks, what is revenue", "Great job!"]), ("farewell", ["bye", "see you"]), ("help", ["help", "?"]),
        ("unclear", ["ab", "123 456", "banana", "", None]), ("comparison", ["compare a and b", "q1 vs. q2"]), ("trend", ["total growth"]), ("aggregation", ["the total of it"]), ("list", ["list them all"]), ("explanation", ["why so low"]), ("yes_no", ["is it good"]),
        ("summary", ["summarize it please"]), ("factual", ["revenue", "what was the eps"]),
    ],
)
def test_intents(spark, kind, queries):
    assert [a.query_type for a in analyse(spark, *queries)] == [kind] * len(queries)


def test_details(spark):
    a, b, c, d = analyse(spark, 'Compare Q1 vs Q2 "Net Cash" in fy 2021', "revenue by segment", "hi", "how to compute the ratio")
    assert (a.comparison_items, a.key_entities, a.time_references) == (["q1", "q2"], ["net cash"], ["q1", "q2", "fy 2021", "2021"])
    assert (a.response_format, b.response_format, c.response_format, d.response_format) == ("comparison_table", "table", "direct_message", "step_by_step")
    assert a.metrics == ["cash"] and a.is_specific and d.requires_calculation and not a.requires_calculation
    assert c.direct_response == un.DIRECT_RESPONSES["greeting"] and not c.requires_search and a.direct_response is None


def test_engine_intents(spark):
    rows = [("the difference", "comparison", "the difference comparison analysis"), ("how many", "aggregation", "how many total summary"), ("find it", "lookup", "find it"), ("analyze it", "analytical", "analyze it"), ("x", "general", "x"), ("a trend", "trend", "a trend over time historical")]
    got = spark.createDataFrame([(r[0],) for r in rows], "q string").select("q", un.engine_intent(F.col("q")).alias("k")).select("q", "k", un.expanded(F.col("q"), F.col("k")).alias("e")).collect()
    assert [tuple(r) for r in got] == rows
