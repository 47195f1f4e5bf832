from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from skein.llm import near_dedup as nd

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("fp", T.IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = rnd.choices(vocab, k=rnd.choice([2, 5, 12, 60, 150]))
        for _ in range(rnd.choice([1, 1, 2, 6, 25])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((n, rnd.choice([" ", "\n"]).join(w).title()))
            n += 1
    return [*rows, (n, None), (n + 1, " \t\n"), (n + 2, ""), (n + 3, "One"), (n + 4, "one")]


@pytest.mark.parametrize(("k", "num", "exact"), [(3, 85, False), (5, 80, False), (3, 85, True), (2, 50, True)])
def test_equals_brute_force(spark, k, num, exact):
    rows = corpus(k)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(frame(spark, rows), k=k, num=num, exact=exact).collect()}
    assert got == brute(rows, k, num, 100)


def test_query_equals_brute_force_on_the_smallest_tables(spark, sf):
    from skein.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op6_near_duplicates"](spark, sf).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_empty_null_ids_and_repeated_rows(spark):
    assert nd.near_duplicates(frame(spark, [])).count() == 0
    text, other = "a b c d e f g h", "k l m n o p q r"
    rows = [(1, text), (1, text), (1, other), (None, text), (2, text.upper()), (3, other)]
    got = nd.drop_near_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "id", "fp"]
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, text), (1, text), (1, other)]


def test_columns_of_any_name_stay_as_they_were(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(1, text, 10, 20, 30, 40), (2, text, 11, 21, 31, 41), (3, None, 12, 22, 32, 42)], "doc_id long, text string, `a.b` int, __tkey int, row int, id int")
    assert sorted(map(tuple, nd.drop_near_duplicates(docs).collect())) == [(1, text, 10, 20, 30, 40), (3, None, 12, 22, 32, 42)]


def test_tables_go_when_nothing_needs_them(spark, tmp_path):
    import os

    from skein.llm.common import shared_dir

    at = shared_dir(spark).removeprefix("file://")
    had = set(os.listdir(at)) if os.path.isdir(at) else set()
    nd.near_duplicates(frame(spark, corpus(1))).collect()
    left = {name.split("-")[1] for name in set(os.listdir(at)) - had}
    assert left.isdisjoint({"sets", "members", "live", "placed", "star", "seen", "regs", "apart"})


def test_registers_hold_the_smallest_hash():
    import numpy as np

    u = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    r = nd.registers(u)
    more = nd.registers(np.unique(np.r_[u, np.arange(1, 10, dtype=np.uint64)]))
    assert (more >> nd.MANTISSA_BITS >= r >> nd.MANTISSA_BITS).all()  # more hashes: more leading zeros
    assert more[0] >> nd.MANTISSA_BITS == nd.REST_BITS  # of 1: all but the last bit
    assert not nd.registers(u[:0]).any()


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(500)] + [(1000, i) for i in range(1001, 1400)] + [(2000, 2000)]
    got = {r.node: r.label for r in nd.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(501)} | {i: 1000 for i in range(1000, 1400)}
