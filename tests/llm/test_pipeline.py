from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from skein.llm import decontaminate as dc
from skein.llm import toxicity as tx

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = f"{COLUMNS}, size long, target string, taken int, shard int, slot long, keep_0 string, label int, part string, rank int, __size int, id long, tkey long, fp string, component_id long, score string"


def words(rnd, n):
    return " ".join("".join(rnd.choices("aeioulnrst", k=rnd.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rnd = random.Random(8)
    items = [(i, words(rnd, rnd.randint(20, 50))) for i in range(6)]
    docs = [[i, words(rnd, rnd.randint(80, 140)), "en", f"src{i % 4}"] for i in range(160)]
    planted = {"toxic": set(), "copy": {}, "leak": set()}
    for i in range(0, 24):
        n = rnd.randint(5, 8)
        docs.append([1000 + i, " ".join([words(rnd, 20), *(f"you {t} {words(rnd, 2)}" for t in rnd.sample(["idiot", "moron", "stupid", "scum", "loser", "trash", "clown", "worthless", "pathetic"], n))]), "en", "src0"])
        planted["toxic"].add(1000 + i)
    for i in range(12):
        base = docs[i][1].split()
        copy = list(base)
        if i % 2:
            copy[len(copy) // 2] = "changed"
        docs.append([2000 + i, " ".join(copy), "en", "src1"])
        planted["copy"][2000 + i] = i
    for i in range(10):
        docs.append([3000 + i, f"{words(rnd, 30)} {rnd.choice(items)[1].upper()} {words(rnd, 30)}", "en", "src2"])
        planted["leak"].add(3000 + i)
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, g, s, len(t)) for i, t, g, s in docs], COLUMNS).write.parquet(f"file://{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{d}/benchmark.parquet")
    labels = [(i, 1, int(i in planted["toxic"])) for i, *_ in docs if i < 1000 or i in planted["toxic"]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{d}/labels.parquet")
    return f"file://{d}", docs, items, planted


def test_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"] and cp.ORACLE_SQL is None


def test_stages_equal_brute_force(spark, case, tmp_path):
    sf, docs, items, planted = case
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept, text = frame.columns, {i for i, *_ in docs}, {i: t for i, t, *_ in docs}
    for k, (name, stage) in enumerate(cp.STAGES[:3]):
        out = stage(spark, frame, sf)
        assert out.columns == columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        frame = spark.read.parquet(f"file://{tmp_path}/{k}")
        got = {r.doc_id: r.text for r in frame.collect()}
        if name == "toxicity":
            model = tx.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where(~tx.held_out(tx.F.col("doc_id"))))
            want = {i for i in kept if tx.score_of(tx.features_of(*tx.hits_of(text[i], model.terms), model.terms), model.weights) < cp.REJECT_SCORE}
            assert kept - want == planted["toxic"]
        elif name == "near_dedup":
            shingles = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i in kept for w in [text[i].split()]}
            same = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])  # noqa: E731, B023
            want = {i for i in kept if not any(j < i and same(i, j) for j in kept)}
            assert kept - want == set(planted["copy"])
        else:
            bad = lambda t: any(dc.align(dc.words_of(x), dc.words_of(t))[0] >= dc.LEAST * dc.MATCH * len(dc.words_of(x)) for _, x in items)
            want = {i for i in kept if not bad(text[i])}
            assert kept - want == planted["leak"]
        kept = want
        assert got == {i: text[i] for i in kept}
    mixed = cp.mixing(spark, frame, sf)
    assert mixed.columns == columns
    rows = Counter(r.doc_id for r in mixed.collect())
    assert set(rows) <= kept and max(rows.values()) <= 4
    final = cp.sharding(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in final) == rows
    counts = Counter(r.shard for r in final)
    assert max(counts.values()) - min(counts[i] for i in range(40)) <= 1


def test_toxicity_stage_drops_what_op1_predicts(spark, case, monkeypatch):
    model = tx.ToxicityModel()
    score = lambda t: tx.score_of(tx.features_of(*tx.hits_of(t, model.terms), model.terms), model.weights)
    texts = [" ".join(["you idiot", *["calm"] * n]) for n in range(0, 400, 2)]
    between = [t for t in texts if tx.THRESHOLD <= score(t) < 0.5]
    assert between
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate([*between, "calm " * 50])], COLUMNS)
    monkeypatch.setattr(cp, "train", lambda *_: model)
    want = {r.doc_id for r in tx.score_documents(docs, model).collect() if not r.predicted}
    assert {r.doc_id for r in cp.toxicity(spark, docs, case[0]).collect()} == want == {len(between)}


def test_run_gives_the_same_again(spark, case):
    sf = case[0]
    a, b = (sorted(map(str, cp.run(spark, sf).collect())) for _ in range(2))
    assert a == b and a


@pytest.mark.parametrize("k", range(5))
def test_nulls_empties_repeats_and_clashing_names(spark, case, k):
    sf = case[0]
    name, stage = cp.STAGES[k]
    rows = [(1, "one two three four five six seven", "en", "a", 5), (1, "one two three four five six seven", "en", "a", 5), (None, "nothing like it at all in here", None, None, None), (2, None, "en", "b", 0), (3, "", "en", "b", 0), (2, None, "en", "b", 0), (4, "long text " * 30_000, "de", "é", None)]
    docs = spark.createDataFrame([(*r, *[None] * 15) for r in rows], CLASHING)
    out = stage(spark, docs, sf)
    got = out.collect()
    if name != "sharding":
        assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in got)
    if name == "near_dedup":
        assert ids == Counter({1: 1, None: 1, 2: 2, 3: 1, 4: 1})
    elif name == "mixing":
        assert 2 not in ids and 3 not in ids and ids[None] >= 1
    else:
        assert ids == Counter({1: 2, None: 1, 2: 2, 3: 1, 4: 1})
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_is_registered(spark, sf):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, sf).count() > 0
