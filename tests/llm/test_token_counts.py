from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from skein.llm import token_counts as tc


def brute(text, rule):
    """Byte by byte."""
    enc = tc.encoder(tc.VOCABULARY)
    sections, k = [], 0
    for c in text:
        sections += [k] * len(c.encode())
        k += c == "\n"
    n = (max(sections) + 1) if sections else 0
    counts, at = [0.0] * n, 0
    for t in enc.encoding.encode_ordinary(text):
        size = len(enc.encoding.decode_single_token_bytes(t))
        own = sections[at : at + size]
        if rule == "split":
            for s in own:
                counts[s] += 1 / size
        else:
            counts[{"first": own[0], "last": own[-1], "majority": max(sorted(set(own)), key=own.count)}[rule]] += 1
        at += size
    assert at == len(text.encode())
    return counts


def texts():
    rnd = random.Random(9)
    parts = ["word", " the", "\n", "\n\n\n", "é", "日本", " ", "   ", "x1", "!?", "\t", "😀"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(60)]


@pytest.mark.parametrize("rule", tc.RULES)
def test_rules_equal_brute_force(spark, rule):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, section string")
    got = defaultdict(dict)
    for r in tc.attribute_tokens(docs, rule=rule).collect():
        got[r.id][r.section] = r.tokens
        assert r.start_byte < r.end_byte
    for i, t in rows:
        assert [got[i][k] for k in sorted(got[i])] == pytest.approx(brute(t, rule))


def test_pieces_give_the_tokens_of_the_whole(spark, sf):
    enc = tc.encoder(tc.VOCABULARY)
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect():
        ids = [i for p in tc.pieces(r.text, 100) for i in enc.encoding.encode_ordinary(p)]
        assert ids == enc.encoding.encode_ordinary(r.text) and "".join(tc.pieces(r.text, 100)) == r.text
    assert list(tc.pieces("x" * 1000, 100)) == ["x" * 1000]


def test_fields_and_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a title", None, "body of it"), (None, None, None, None), (1, "a title", None, "body of it")], "doc_id long, title string, tokens string, text string")
    got = sorted((r.id or 0, r.section, r.tokens) for r in tc.attribute_tokens(docs, text_cols=("title", "tokens", "text")).collect())
    n = lambda t: len(tc.encoder(tc.VOCABULARY).encoding.encode_ordinary(t))
    assert sum(t for i, _, t in got if i == 1) == 2 * n("a title\n\nbody of it")
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert tc.attribute_tokens(empty).count() == 0 and tc.attribute_tokens(empty.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word \n" * 100_000)], "doc_id long, text string")
    assert tc.attribute_tokens(long).count() == 100_000
    with pytest.raises(ValueError, match="rule"):
        tc.attribute_tokens(docs, rule="best")


def test_allot_adds_up():
    rnd = np.random.default_rng(0)
    for rule in tc.RULES:
        ends = np.cumsum(rnd.integers(1, 6, 500))
        cuts = np.unique(np.r_[rnd.integers(1, ends[-1], 60), ends[-1]])
        assert tc.allot(ends, cuts, rule)[0].sum() == pytest.approx(500)


def test_query_sums_are_the_documents_counts(spark, sf):
    from skein.llm.queries import QUERIES

    enc = tc.encoder(tc.VOCABULARY).encoding
    sums = defaultdict(float)
    for r in QUERIES["op7_token_counts"](spark, sf).collect():
        sums[r.doc_id] += r.tokens
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {r.doc_id: len(enc.encode_ordinary(r.text)) for r in docs if r.text} == dict(sums)
