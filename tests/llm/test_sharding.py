from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from skein.llm import sharding as sh


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, shard int, m string")


def checked(got, rows, shards):
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts[i] for i in range(shards)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert want == Counter((r.doc_id, r.size, r.text_crc32) for r in got)


def test_groups_stay_together_and_counts_even(spark):
    rows, i = [], 0
    for g in range(60):
        for _ in range(1 + g % 7):
            rows.append((i, f"text of group {g} é"))
            i += 1
    rows += [(i + j, f"single {j}") for j in range(400)]
    got = sh.shard_documents(frame(spark, rows), shards=8).collect()
    checked(got, rows, 8)
    at = defaultdict(set)
    text = dict(rows)
    for r in got:
        at[text[r.doc_id]].add(r.shard)
    assert sum(len(v) - 1 for v in at.values()) <= 4  # links that are cut
    again = sh.shard_documents(frame(spark, rows).repartition(5), shards=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_groups_that_fit_on_a_shard_are_not_cut(spark):
    sizes = [100, 95, 80, 70, 60, 51, 51]
    rows = [(1000 * g + i, f"group {g}") for g, m in enumerate(sizes) for i in range(m)]
    rows += [(50_000 + i, f"small {i // 3}") for i in range(120)] + [(90_000 + i, f"single {i}") for i in range(800 - sum(sizes) - 120)]
    got = sh.shard_documents(frame(spark, rows), shards=8).collect()
    checked(got, rows, 8)
    at = defaultdict(set)
    for r in got:
        if r.doc_id < 50_000:
            at[r.doc_id // 1000].add(r.shard)
    assert all(len(at[g]) == 1 for g in range(len(sizes))), at


def test_salted_parts(spark, monkeypatch):
    rows = [(i, f"group {min(i // 130, 2)}") for i in range(600)] + [(1000 + i, f"single {i}") for i in range(200)]
    monkeypatch.setattr(sh, "SALT_ROWS", 16)
    got = sh.shard_documents(frame(spark, rows), shards=4).collect()
    checked(got, rows, 4)
    at = defaultdict(Counter)
    for r in got:
        at[min(r.doc_id // 130, 2) if r.doc_id < 1000 else None][r.shard] += 1
    assert len(at[0]) == len(at[1]) == 1 and len(at[2]) <= 4, at


def test_hot_group_nulls_repeats_and_empty(spark):
    rows = [(i, "hot") for i in range(200)] + [(i, None) for i in range(200, 230)] + [(i, "") for i in range(230, 240)] + [(7, "again"), (7, "again"), (None, "no id"), (None, "hot"), (900, "long " * 200000)]
    got = sh.shard_documents(frame(spark, rows), shards=5, keep=("m",)).collect()
    checked(got, rows, 5)
    assert {r.m for r in got} == {"x"}
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"hot")}) >= 4
    empty = sh.shard_documents(frame(spark, []))
    assert empty.count() == 0 and empty.columns == sh.shard_documents(frame(spark, rows[:3])).columns
    checked(sh.shard_documents(frame(spark, rows[:3])).collect(), rows[:3], 40)


def test_query_on_the_smallest_tables(spark, sf):
    from skein.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    checked(QUERIES["op3_sharding"](spark, sf).collect(), docs, 40)
