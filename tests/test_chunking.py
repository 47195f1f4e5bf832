from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.operators import chunking as ch
from skein.operators.chunking import ChunkingConfig


def frame(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, text string")


def test_repeated_sentence_gives_five_chunks():
    got = ch.recursive_chunks("This is a test sentence. " * 20, ChunkingConfig(100, 20, 10))
    assert [len(c["content"]) for c in got] == [98] * 5
    assert [c["chunk_index"] for c in got] == [0, 1, 2, 3, 4] and {c["total_chunks"] for c in got} == {5}


def test_short_texts_and_limits():
    assert ch.recursive_chunks("", ChunkingConfig()) == [] and ch.recursive_chunks("Short text", ChunkingConfig()) == [] and ch.recursive_chunks(None, ChunkingConfig()) == []
    with pytest.raises(ValueError, match="overlap"):
        ChunkingConfig(100, 100)
    windows = ch.split_recursive("x" * 250, ChunkingConfig(100, 20, 10, ()))
    assert [len(w) for w in windows] == [100, 100, 90, 10]


def test_overlap_is_of_whole_words():
    text = " ".join(f"w{i:03}" for i in range(100))
    got = [c["content"] for c in ch.recursive_chunks(text, ChunkingConfig(60, 20, 5))]
    for a, b in zip(got, got[1:]):
        assert a.split()[-3:] == b.split()[:3] or a.split()[-4:] == b.split()[:4]
    assert set(text.split()) == {w for c in got for w in c.split()}


def test_sections_and_types():
    assert ch.sections("# One\nbody\n## Two\nmore") == ["# One\nbody", "## Two\nmore"]
    assert ch.sections("  REVENUE ANALYSIS:\n  EXPENSE BREAKDOWN:") == ["REVENUE ANALYSIS:\n  EXPENSE BREAKDOWN:"]
    assert [ch.detect_type(t) for t in ("| a | b | c | d | e | f |", "Cash Flow up", "A HEADER", "some text", "123")] == ["table", "financial_data", "header", "text", "text"]
    (only,) = ch.financial_chunks("The revenue of the company rose. " * 10, ChunkingConfig())
    assert only["chunk_type"] == "financial_data"


def test_types_agree_on_both_sides(spark):
    texts = ["| a | b | c | d | e | f |", "Cash Flow up", "A HEADER", "some text", "123", "", "ÜBER ALLES", "Net INCOME", "STRAẞE"]
    got = [r.k for r in frame(spark, *texts).orderBy("document_id").select(ch.chunk_type(F.col("text")).alias("k")).collect()]
    assert got == [ch.detect_type(t) for t in texts]


def test_strategies_as_frames(spark):
    long = "Revenue rose by much. It was a good year for all. " * 60
    df = frame(spark, long, "", None, "tiny")
    for strategy in ("recursive", "sentence", "financial", "unknown"):
        got = ch.create_chunks(df, strategy).collect()
        assert got and {r.document_id for r in got} == {"d0"}
        assert [r.chunk_seq for r in got] == list(range(len(got))) and len({r.chunk_id for r in got}) == len(got)
        assert all(len(r.content) <= 1000 for r in got)
    assert {r.metadata["chunking_method"] for r in ch.create_chunks(df, "sentence").collect()} == {"sentence"}
    again = ch.create_chunks(df.repartition(3), "financial").collect()
    assert sorted(r.chunk_id for r in again) == sorted(r.chunk_id for r in ch.create_chunks(df, "financial").collect())


def test_sentences_equal_a_plain_version(spark):
    import re

    texts = [f"One {i} here. Two! Three? " * (i + 1) + "x" * (i * 9) for i in range(12)]
    c = ChunkingConfig(80, 10, 20)

    def plain(text):
        out, held, n = [], [], 0
        for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text):
            if not s.strip():
                continue
            if held and n + len(s.strip()) > c.chunk_size:
                out.append(" ".join(held))
                held, n = [], 0
            held.append(s.strip())
            n += len(s.strip()) + 1
        return [x for x in [*out, " ".join(held)] if len(x) >= c.min_chunk_size]

    got = {}
    for r in ch.create_chunks(frame(spark, *texts), "sentence", c).collect():
        got.setdefault(r.document_id, []).append((r.chunk_seq, r.content))
    assert {d: [t for _, t in sorted(v)] for d, v in got.items()} == {f"d{i}": plain(t) for i, t in enumerate(texts) if plain(t)}


def test_headers_and_footers(spark):
    pages = spark.createDataFrame([("a", i, f"Head\nbody {i}\nFoot" if i != 3 else "Head\nlast") for i in range(5)] + [("b", 0, "Head\nx"), ("b", 1, "Head\ny"), ("c", 0, None), ("c", 1, ""), ("c", 2, "z")], "document_id string, page int, text string")
    got = {(r.document_id, r.page): r.text for r in ch.without_headers_and_footers(pages).collect()}
    assert [got["a", i] for i in range(5)] == ["body 0", "body 1", "body 2", "last", "body 4"]
    assert got["b", 0] == "Head\nx" and got["c", 2] == "z"
