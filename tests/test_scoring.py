from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.functions import scoring as sc

TEXTS = ["the revenue was five million in total", "revenue was five million", "", "the of in", "a b c d e f a b", "a b c d x f a b c", "Profit ROSE by 5% in Q1", "profit rose by 5 in q1 of it", "one", "the revenue was five million in total"]


def toks(t):
    return re.findall(r"\w+", t.lower())


def grams(ws, n):
    return [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]


def f1(p, r):
    return 2 * p * r / (p + r) if p + r else 0.0


def rouge(g, e, n):
    a, b = Counter(grams(toks(g), n)), Counter(grams(toks(e), n))
    hit = sum((a & b).values())
    return f1(hit / max(1, sum(a.values())), hit / max(1, sum(b.values())))


def bleu(g, e):
    g, e = toks(g), toks(e)
    ps = []
    for n in range(1, 5):
        a, b = Counter(grams(g, n)), Counter(grams(e, n))
        ps.append(sum((a & b).values()) / max(1, sum(a.values())))
    if not g or not e or 0 in ps:
        return 0.0
    return (1.0 if len(g) >= len(e) else math.exp(1 - len(e) / len(g))) * math.exp(sum(map(math.log, ps)) / 4)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def correct(g, e):
    a, b = Counter(toks(g)), Counter(toks(e))
    if not a or not b:
        return 0.0
    dot = sum(a[x] * b[x] for x in a)
    return 0.5 * len(a.keys() & b.keys()) / len(a.keys() | b.keys()) + 0.5 * dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def test_answer_metrics_equal_plain_versions(spark):
    pairs = [(g, e) for g in TEXTS for e in TEXTS]
    df = spark.createDataFrame([(i, g, e) for i, (g, e) in enumerate(pairs)], "i int, g string, e string")
    g, e = F.col("g"), F.col("e")
    got = df.select("i", sc.bleu(g, e).alias("bleu"), sc.rouge(g, e, 1).alias("r1"), sc.rouge(g, e, 2).alias("r2"), sc.rouge_l(g, e).alias("rl"), sc.correctness(g, e).alias("c"), sc.answer_relevance(g, e).alias("rel"), sc.faithfulness(g, e).alias("f"), sc.completeness(g, e).alias("full")).collect()
    for r in got:
        a, b = pairs[r.i]
        x, y = toks(a), toks(b)
        assert r.bleu == pytest.approx(bleu(a, b)) and r.r1 == pytest.approx(rouge(a, b, 1)) and r.r2 == pytest.approx(rouge(a, b, 2))
        n = lcs(x, y)
        assert r.rl == pytest.approx(f1(n / max(1, len(x)), n / max(1, len(y)))) and r.c == pytest.approx(correct(a, b))
        keys = set(x) - set(sc.RELEVANCE_STOP)
        assert r.rel == pytest.approx(0.0 if not x or not y else len(keys & set(y)) / len(keys) if keys else 0.5)
        own = set(x) - set(sc.FAITH_STOP)
        assert r.f == pytest.approx(0.0 if not x or not y else len(own & set(y)) / len(own) if own else 1.0)
        want = set(y) - set(sc.EXPECTED_STOP)
        assert r.full == pytest.approx(len(want & set(x)) / len(want) if want else 1.0)


def test_retrieval_metrics_equal_plain_versions(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choices("abcdefgh", k=rnd.randint(0, 6)), rnd.sample("abcdefgh", rnd.randint(0, 5))) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, q array<string>, r array<string>")
    for x in df.select("i", sc.retrieval_metrics(F.col("q"), F.col("r")).alias("m")).collect():
        _, q, r = rows[x.i]
        hits = [k for k, v in enumerate(q, 1) if v in r]
        p, rec = (len(set(q) & set(r)) / len(set(q)) if q else 0.0), (len(set(q) & set(r)) / len(r) if r else 0.0)
        ideal = sum(1 / math.log2(k + 1) for k in range(1, len(r) + 1))
        want = (p, rec, f1(p, rec), (len(set(q) & set(r)) + 100 - len(set(q) | set(r))) / 100, 1 / hits[0] if hits else 0.0, sum((j + 1) / k for j, k in enumerate(hits)) / len(r) if r else 0.0, sum(1 / math.log2(k + 1) for k in hits) / ideal if r and q else 0.0, float(bool(hits)))
        assert tuple(x.m) == pytest.approx(want)


def test_contexts_keywords_and_grades(spark):
    df = spark.createDataFrame([(["the revenue was five million", "nothing here at all", ""], "the revenue was five million strong", ["REVENUE", "five", "x"]), ([], "a", [])], "c array<string>, a string, k array<string>")
    a, b = df.select(sc.context_precision(F.col("c"), F.col("a")).alias("p"), sc.context_recall(F.col("c"), F.col("a")).alias("r"), sc.keyword_retrieval(F.col("c"), F.col("k")).alias("k")).collect()
    assert a.p == pytest.approx(1 / 3) and a.r == pytest.approx(3 / 4) and tuple(a.k) == pytest.approx((1 / 3, 1 / 3, 1 / 3))
    assert (b.p, b.r, tuple(b.k)) == (0.0, 0.0, (0.0, 0.0, 0.0))
    g = spark.createDataFrame([(["a", "b", "c"], {"a": 1.0, "c": 3.0})], "f array<string>, g map<string,double>").select(sc.graded_ndcg(F.col("f"), F.col("g")).alias("x"), sc.hit_rate(F.col("f"), F.array(F.lit("c")), 2).alias("h")).first()
    assert g.x == pytest.approx((1 + 3 / 2) / (3 + 1 / math.log2(3))) and g.h == 0.0
    assert spark.range(1).select(sc.overall(F.lit(1.0), F.lit(0.8), F.lit(0.2), F.lit(0.2)).alias("o")).first().o == (0.55, "good")
