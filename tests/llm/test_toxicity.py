from __future__ import annotations

import random
import zlib

import pytest

from skein.llm import toxicity as tx


def distance(a: str, b: str) -> int:
    """Optimal string alignment: edits with neighbours exchanged."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distances():
    rnd = random.Random(3)
    terms = ("abc", "abcd", "bacca", "abcabcab", "cabbage", "dad", "dadda")
    automaton = tx.LexiconAutomaton(terms)
    for _ in range(20_000):
        word = "".join(rnd.choices("abcdx", k=rnd.randint(0, 10)))
        best = min(((distance(word, t), t) for t in terms if distance(word, t) <= tx.budget(t)), default=None)
        got = automaton.match(word)
        assert (got and got[1]) == (best and best[0]), (word, got, best)


def test_quotation_scores_below_abuse():
    terms = tx.ToxicityModel().terms
    say = lambda t: tx.score_of(tx.features_of(*tx.hits_of(t, terms), terms), tx.ToxicityModel().weights)
    abuse = say("you are an idiot and a stupid, worthless loser")
    typos = say("you are an idoit and a stpuid, worthles loser")
    quoted = say('the report said the word "idiot" is rude, and quoted "stupid" and "loser" as terms')
    clean = say("the weather was fine and the bridge is open")
    assert abuse > typos > max(quoted, clean)
    assert abuse > 0.5 > quoted


def test_held_out_accuracy_and_contract(spark):
    from skein.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(got) == docs
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    y = [(got[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    pos, neg = [s for s, t in y if t], [s for s, t in y if not t]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.95


def test_empty_null_and_stage(spark):
    schema = "doc_id long, text string, score string, id int, t string"
    docs = spark.createDataFrame([(1, None, "a", 1, "t"), (2, "", "b", 2, "t"), (None, "You idiot, stupid worthless loser, moron scum trash", "c", 3, "t"), (3, "fine words " * 30000, None, None, None)], schema)
    got = {r.doc_id: r for r in tx.score_documents(docs, tx.ToxicityModel()).collect()}
    assert got[1].score == got[2].score == got[3].score < 0.3 and got[None].predicted == 1 and not got[None].held_out
    kept = tx.drop_toxic(docs, tx.ToxicityModel())
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.train(docs, none) == tx.ToxicityModel()
    assert tx.score_documents(docs.limit(0), tx.ToxicityModel()).count() == 0
    some = spark.createDataFrame([(1, 1), (1, None), (2, 0), (77, 1), (3, 0)], "doc_id long, toxic int")
    assert tx.train(docs, some).trained_on == 3


@pytest.mark.parametrize("text", ['"idiot', 'said "you" idiot" x', "« idiot »", "İdiot idiot"])
def test_odd_quotes_do_not_crash(text):
    assert len(tx.hits_of(text, tx.ToxicityModel().terms)[0]) >= 1


def test_a_letter_that_grows_in_lower_case_changes_nothing():
    terms, plain = tx.ToxicityModel().terms, 'they said "you idiot" and "stupid" in a play'
    hits, n = tx.hits_of(plain, terms)
    more, m = tx.hits_of("\u0130 " + plain, terms)
    assert m == n + 1 and len(hits) == len(more) == 2
    for h, g in zip(hits, more, strict=True):
        assert (h["start"] + 2, h["end"] + 2, h["term"], h["quotation"]) == (g["start"], g["end"], g["term"], g["quotation"])
        assert plain[h["start"] : h["end"]] in ("idiot", "stupid")


def test_quotations_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(500):
        text = "".join(rnd.choices(['"', "idiot ", "x ", "\n", "\u00ab", "\u00bb"], k=rnd.randint(1, 40)))
        quotes = tx._quoted_spans(text)
        for h in tx.hits_of(text, tx.ToxicityModel().terms)[0]:
            assert (h["quotation"] == 0.7) == any(a < h["start"] and h["end"] <= z for a, z in quotes)


def test_many_quoted_hits_in_one_text_take_linear_time():
    import time

    began = time.monotonic()
    hits, _ = tx.hits_of('say "idiot" now ' * 50_000, tx.ToxicityModel().terms)
    assert len(hits) == 50_000 and time.monotonic() - began < 10


def test_rows_that_repeat_an_id_are_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert tx.train(docs, labels).trained_on == 2


def test_columns_of_any_name_stay_as_they_were(spark):
    docs = spark.createDataFrame([(1, "fine", 5, 6, 7), (2, "You idiot, stupid worthless loser, moron scum trash", 8, 9, 10)], "doc_id long, text string, `a.b` int, __t int, row int")
    assert [tuple(r) for r in tx.drop_toxic(docs, tx.ToxicityModel()).collect()] == [(1, "fine", 5, 6, 7)]
