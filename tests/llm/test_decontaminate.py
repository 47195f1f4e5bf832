from __future__ import annotations

import datetime
import random

import pytest

from skein.llm import decontaminate as dc


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
    return max(map(max, h))


def test_alignment_equals_the_plain_recurrence():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = (rnd.choices("abcd", k=rnd.randint(0, 14)) for _ in range(2))
        score, start, end = dc.align(a, b)
        assert score == slow_align(a, b)
        assert score == slow_align(a, b[start:end])


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, score string")
    return d, spark.createDataFrame(items, "item_id long, text string")


def noise(rnd, n):
    return ["".join(rnd.choices("etaoin", k=rnd.randint(2, 7))) for _ in range(n)]


def case():
    rnd = random.Random(11)
    items = [(i, " ".join(noise(rnd, rnd.randint(15, 60)))) for i in range(20)]
    docs = [(i, " ".join(noise(rnd, rnd.randint(1, 400)))) for i in range(150)]
    held = set()
    for k in range(40):
        item, text = rnd.choice(items)
        words = text.split()
        if k % 3 == 1:  # edited
            for _ in range(len(words) // 8):
                words[rnd.randrange(len(words))] = noise(rnd, 1)[0]
        if k % 3 == 2:  # most of it, another case and punctuation
            words = [w.upper() + "," for w in words[: int(len(words) * 0.8)]]
        docs.append((1000 + k, " ".join([*noise(rnd, rnd.randint(0, 50)), *words, *noise(rnd, rnd.randint(0, 300))])))
        held.add((1000 + k, item))
    return docs, items, held


def test_finds_what_alignment_of_everything_finds(spark):
    docs, items, held = case()
    d, b = frames(spark, docs, items)
    got = {(r.id, r.item_id): r.ratio for r in dc.contaminated(d, b).collect()}
    assert held <= set(got)
    brute = set()
    for i, t in docs:
        for k, text in items:
            w = dc.words_of(text)
            if dc.align(w, dc.words_of(t))[0] >= dc.LEAST * dc.MATCH * len(w):
                brute.add((i, k))
    assert set(got) == brute


def test_leaked_item_keeps_its_seeds_and_blocks_agree(spark):
    docs, items, _ = case()
    docs = [*docs, *[(5000 + i, f"x{i} {items[0][1]} y") for i in range(150)]]
    d, b = frames(spark, docs, items)
    whole = sorted(map(str, dc.contaminated(d, b, rare_df=3).collect()))
    assert sum("item_id=0," in r for r in whole) >= 150
    assert sorted(map(str, dc.contaminated(d, b, rare_df=3, block_words=200).collect())) == whole


def test_ids_of_any_type_and_columns_of_any_name(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(datetime.date(2024, 1, 1), item, 1, 2, 3), (datetime.date(2024, 1, 2), "clean", 4, 5, 6)], "doc_id date, text string, `a.b` int, __own int, row int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.id for r in dc.contaminated(docs, items).collect()] == [datetime.date(2024, 1, 1)]
    assert [tuple(r) for r in dc.drop_contaminated(docs, items).collect()] == [(datetime.date(2024, 1, 2), "clean", 4, 5, 6)]


def test_recall_on_the_tables_against_alignment_of_everything(spark, sf):
    items = [(r.item_id, dc.words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, dc.words_of(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, k) for i, t in docs for k, w in items if w and dc.align(w, t)[0] >= dc.LEAST * dc.MATCH * len(w)}
    got = {(r.id, r.item_id) for r in dc.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert got == want


def test_many_edited_copies_of_one_item_are_all_found(spark):
    item = [f"word{i}" for i in range(40)]
    edited = " ".join(w if i % 5 else f"other{i}" for i, w in enumerate(item))
    docs = [(i, f"before{i} {edited} after{i}") for i in range(150)] + [(150, " ".join(item)), (151, f"{' '.join(item[1:5])} and nothing else")]
    d, b = frames(spark, docs, [(1, " ".join(item))])
    assert sorted(r.id for r in dc.contaminated(d, b).collect()) == list(range(151))


def test_edge_cases_and_stage(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, item), (1, item), (None, f"... {item.upper()}!"), (2, None), (3, ""), (4, "clean " * 50000), (5, item + " " + item)]
    d, b = frames(spark, docs, [(1, item), (2, item), (3, None), (4, ""), (5, "two words")])
    got = dc.contaminated(d, b).collect()
    assert {(r.id, r.item_id) for r in got} == {(i, k) for i in (1, None, 5) for k in (1, 2)}
    kept = dc.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert dc.contaminated(d, b.limit(0)).count() == 0 and dc.contaminated(d.limit(0), b).count() == 0


@pytest.mark.parametrize("name", ["op5_decontamination"])
def test_query_finds_exact_passages(spark, sf, name):
    from skein.llm.queries import QUERIES

    got = {(r.doc_id, r.item_id) for r in QUERIES[name](spark, sf).collect()}
    items = [(r.item_id, " ".join(dc.words_of(r.text))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        t = f" {' '.join(dc.words_of(r.text))} "
        for k, x in items:
            assert f" {x} " not in t or (r.doc_id, k) in got
