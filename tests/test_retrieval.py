from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import bm25, hybrid, vectors
from skein.operators.hybrid import RetrieverConfig

DOCS = ["revenue rose in the first quarter", "costs fell and revenue rose, revenue!", "the board met", "", None, "profit of the quarter"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(f"c{i}", f"d{i % 2}", t, "text", {"lang": "en"} if i % 3 else None) for i, t in enumerate(DOCS)], "chunk_id string, document_id string, content string, chunk_type string, metadata map<string,string>").withColumn("page_number", F.lit(None).cast("int"))


def plain_bm25(docs, query):
    toks = lambda t: re.findall(r"\w+", (t or "").lower())
    tf = [Counter(toks(d)) for d in docs]
    dl = [len(toks(d)) for d in docs]
    avg = sum(dl) / len(dl)
    out = Counter()
    for q in toks(query):
        df = sum(q in t for t in tf)
        for i, t in enumerate(tf):
            if q in t:
                out[f"c{i}"] += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * t[q] * 2.5 / (t[q] + 1.5 * (0.25 + 0.75 * dl[i] / avg))
    return out


def questions(spark, *qs):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(qs)], "query_id string, query string")


def test_bm25_equals_a_plain_version(spark, chunks, tmp_path):
    index = bm25.fit(chunks)
    bm25.save(index, f"file://{tmp_path}/i")
    qs = ["revenue quarter", "revenue revenue the", "unknown words", ""]
    for i in (index, bm25.load(spark, f"file://{tmp_path}/i")):
        got = {}
        for r in bm25.search(i, questions(spark, *qs), 10).collect():
            got.setdefault(r.query_id, {})[r.chunk_id] = r.score
        assert got == {f"q{k}": pytest.approx(plain_bm25(DOCS, q)) for k, q in enumerate(qs) if plain_bm25(DOCS, q)}
    only = bm25.search(index, questions(spark, "revenue"), 10, among=chunks.where("document_id = 'd0'")).collect()
    assert [r.chunk_id for r in only] == ["c0"] and only[0]["rank"] == 1


def test_bm25_of_many_tokens_equals_that_of_few(spark, chunks, monkeypatch):
    index, q = bm25.fit(chunks), questions(spark, "revenue quarter", "the board of the quarter", "nothing")
    few = bm25.search(index, q, 10).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(bm25, "FILTER_TOKENS", 1)
    assert bm25.search(index, q, 10).orderBy("query_id", "rank").collect() == few and len(few) > 3
    monkeypatch.setattr(bm25, "BROADCAST_TOKENS", 1)
    assert bm25.search(index, q, 10).orderBy("query_id", "rank").collect() == few


def test_flat_search_equals_numpy_and_ivf_recall(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(800, 16))
    m[17] = m[5]
    m[40] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [])]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = items.where("vec_id < 30")
    unit = m.astype(np.float32).astype(float)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    want = {}
    for q in range(30):
        s = unit @ unit[q]
        want[q] = sorted(range(800), key=lambda i: (-round(float(s[i]), 9), i))[:7]
    got = {}
    for r in vectors.flat_search(items, queries, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == want
    index = vectors.build_ivf(items, cells=8)
    assert index.items.count() == 802
    found = {(r.query_id, r.chunk_id) for r in vectors.ivf_search(index, queries, 7, probes=8).collect()}
    assert found == {(q, i) for q, v in want.items() for i in v}
    assert vectors.flat_search(items, queries.limit(0), 7).count() == 0


def test_ivf_recall_on_the_tables(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 50 = 0")
    exact = {(r.query_id, r.chunk_id) for r in vectors.flat_search(e, q, 10).collect()}
    near = {(r.query_id, r.chunk_id) for r in vectors.ivf_search(vectors.build_ivf(e), q, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_embeddings(spark):
    df = spark.createDataFrame([("a", "one two two"), ("b", "two one two"), ("c", ""), ("d", None)], "chunk_id string, content string")
    got = {r.chunk_id: r.embedding for r in vectors.embed_chunks(df).collect()}
    assert got["a"] == got["b"] and sum(x * x for x in got["a"]) == pytest.approx(1) and not any(got["c"]) and not any(got["d"])
    by_column = {r.chunk_id: r.v for r in df.select("chunk_id", vectors.hashed_embedding(F.col("content")).alias("v")).collect()}
    assert by_column["a"] == pytest.approx(got["a"]) and not any(by_column["c"])
    own = {r.chunk_id: r.embedding for r in vectors.embed_chunks(df, encode=lambda ts: [[len(t or ""), 1.0] for t in ts]).collect()}
    assert own["a"] == [11.0, 1.0] and own["c"] == [0.0, 1.0]


def test_fusion_rerank_and_filters(spark, chunks):
    left = spark.createDataFrame([("q0", "c0", 0.8), ("q0", "c2", 0.4), ("q1", "c2", -1.0), ("q1", "c0", -2.0)], "query_id string, chunk_id string, score double")
    right = spark.createDataFrame([("q0", "c0", 1.0), ("q0", "c1", 2.0)], "query_id string, chunk_id string, score double")
    got = {(r.query_id, r.chunk_id): (round(r.score, 6), r["rank"]) for r in hybrid.fuse(left, right).collect()}
    assert got == {("q0", "c0"): (0.85, 1), ("q0", "c2"): (0.35, 2), ("q0", "c1"): (0.3, 3), ("q1", "c0"): (1.4, 1), ("q1", "c2"): (0.7, 2)}
    hits = hybrid.fuse(left, right).where("query_id = 'q0'")
    ranked = hybrid.rerank(hits, questions(spark, "revenue rose"), chunks, RetrieverConfig(threshold=0.4)).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in ranked] == [("c0", 1.275), ("c1", 0.45)]
    assert hybrid.filter_chunks(chunks, ["d1"]).count() == 3 and hybrid.filter_chunks(chunks, None, "table").count() == 0
    assert {r.chunk_id for r in hybrid.filter_chunks(chunks, metadata={"lang": "de"}).collect()} == {"c0", "c3"}


def test_retrieve_filters_both_sides(spark, chunks):
    q = questions(spark, "revenue in the quarter")
    e, qv = vectors.embed_chunks(chunks), vectors.embed_chunks(q, "query_id", "query").withColumnRenamed("chunk_id", "query_id")
    index = bm25.fit(chunks)
    got = hybrid.retrieve(hybrid.filter_chunks(chunks, ["d1"]), e, index, q, qv).collect()
    assert got and {r.document_id for r in got} == {"d1"}
    plain = hybrid.retrieve(chunks, e, index, q, qv, RetrieverConfig(use_hybrid=False)).collect()
    assert {r.method for r in plain} == {"vector"} and [r["rank"] for r in plain] == list(range(1, len(plain) + 1))
