from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

import pytest

from skein.llm import mixing as mx


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, free = Fraction(sum(sizes.values())), {}, set(order)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: Fraction(3 * sizes[s]) for s in over}
        free -= over
    return out


def brute_seats(targets: dict, house: int) -> dict:
    seats = dict.fromkeys(targets, 0)
    for _ in range(house):
        best = max((s for s in targets if targets[s]), key=lambda s: (Fraction(targets[s]) / (2 * seats[s] + 1), -s))
        seats[best] += 1
    return seats


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size string, taken int, target int")


ROWS = [(i, s, " ".join(["w"] * n), "x", 1, 2) for i, (s, n) in enumerate([("a", 5), ("a", 900), ("b", 40), ("é", 2000), ("z", 3), ("z", 0), (None, 700), (None, 1), ("Z", 10), ("a", 77), ("~", 4000), ("q", 0)])]


def test_targets_and_takes(spark):
    rows = [*ROWS, ROWS[1], (None, "b", "x\ty z\x0bw", None, None, None), (50, "b", None, None, None, None)]
    got = mx.mix_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, source = defaultdict(int), defaultdict(int), {}
    for i, s, t, *_ in rows:
        import re

        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        source[i] = s
    want = brute_targets(sizes)
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and abs(r.target - float(want[s])) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3, (s, taken[s], float(t))
    again = mx.mix_documents(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1, 1, 1, 5000], [100] * 23, [3, 0, 7], [977, 13, 4400, 1, 1, 62]])
def test_quotas_are_sainte_lague(spark, sizes):
    table = spark.createDataFrame([(f"s{i:03}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    shares = mx.targets(table)
    places = {r.place: r.target for r in shares.collect()}
    got = defaultdict(dict)
    block = 1
    for r in mx.quotas(shares, shards=4, blocks_per_source=50).collect():
        got[r.shard][r.place] = r.blocks
        block = r.block
        assert r.blocks >= 0
    total = sum(sizes)
    for shard in range(4):
        house = (shard + 1) * (total // block) // 4
        held = {p: sum(got[h].get(p, 0) for h in range(shard + 1)) for p in got[3]}
        assert sum(held.values()) == house
        want = brute_seats({p: Fraction(t).limit_denominator(10**9) for p, t in places.items() if p in got[3]}, house)
        assert held == want


@pytest.mark.parametrize("sizes", [[200_000] * 19 + [10], [250_000_000] * 19 + [30_000], [2_000_000_000, 7, 3_000_000_000, 400, 90_000]])
def test_small_sources_get_their_targets(spark, sizes):
    table = spark.createDataFrame([(f"s{i:03}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    shares = mx.targets(table)
    taken = defaultdict(int)
    for r in mx.quotas(shares).collect():
        taken[r.place] += r.blocks * r.block
    for r in shares.collect():
        assert abs(taken[r.place] - r.target) <= 0.002 * r.target + 1, (r.source, taken[r.place], r.target)


def test_rows_of_the_mix(spark):
    docs = frame(spark, ROWS)
    taken = {r.doc_id: -(-r.taken // r.size) if r.size else 0 for r in mx.mix_documents(docs).collect()}
    got = mx.mixed_rows(docs)
    assert got.columns == docs.columns
    seen = defaultdict(int)
    for r in got.collect():
        seen[r.doc_id] += 1
    assert dict(seen) == {i: n for i, n in taken.items() if n}


def test_empty_and_wordless(spark):
    assert mx.mix_documents(frame(spark, [])).count() == 0 and mx.mixed_rows(frame(spark, [])).count() == 0
    rows = [(1, "a", None, None, None, None), (2, None, " ", None, None, None)]
    assert [(r.size, r.target, r.taken) for r in mx.mix_documents(frame(spark, rows)).collect()] == [(0, 0.0, 0)] * 2


def test_query_on_the_smallest_tables(spark, sf):
    from skein.llm.queries import QUERIES

    got = QUERIES["op4_mixing"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = docs[r.doc_id].source
        sizes[s] += len(docs[r.doc_id].text.encode().split())
        taken[s] += r.taken
        target[s] = r.target
    assert len(got) == len(docs) and target == pytest.approx({s: float(t) for s, t in brute_targets(sizes).items()})
    assert all(abs(taken[s] - target[s]) < 0.005 * target[s] + 2 for s in sizes)


def test_values_of_columns_with_clashing_names_stay(spark):
    from skein.llm.mixing import mixed_rows

    docs = spark.createDataFrame([(1, "one two three", "a", 10, 20, 30, 40), (2, "four five", "b", 11, 21, 31, 41)], "doc_id long, text string, source string, `a.b` int, __size int, __h int, row int")
    got = {tuple(r) for r in mixed_rows(docs).collect()}
    assert got and got <= {tuple(r) for r in docs.collect()} and mixed_rows(docs).columns == docs.columns
