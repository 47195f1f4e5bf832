from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from skein.llm import quality as ql

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(ql.SYMBOLS, text)), dup, r, n < 20 or 100 * r > 30 * n


def values(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x") for i, t, g in rows], "doc_id long, text string, lang string, h int, words string")


def texts():
    rnd = random.Random(2)
    rows = []
    for i in range(150):
        vocab = [f"w{j}" for j in range(rnd.choice([2, 5, 50, 500]))]
        words = rnd.choices(vocab, k=rnd.choice([0, 3, 7, 8, 9, 19, 20, 40, 200]))
        if rnd.random() < 0.4 and len(words) > 12:
            words += words[3:12] + ["x"] + words[: rnd.randint(1, 12)]
        rows.append((i, "".join(w + rnd.choice([" ", " ", "\n", "\t ", " \x0b", "$ "]) for w in words), rnd.choice(["en", "de", None])))
    return [*rows, (900, None, "en"), (901, "", "en"), (902, " \n\t\n ", None), (903, "é é x😀 y", "fr"), (904, "same words " * 40_000, "en"), (900, None, "en")]


def test_base_counts_equal_brute_force(spark):
    rows = texts()
    got = sorted(((r.doc_id, *values(r)) for r in ql.quality(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    assert ql.quality(frame(spark, [])).count() == 0


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    half = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    return math.sqrt(max(0.0, (half(p) + half(q)) / 2))


def test_distances_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(["The", "of", "and", "tree,", "HOUSE!!", "a$b", "12"], weights=[5, 4, 3, 9, 2, 1, 1], k=1300)), g) for i, g in enumerate(["en"] * 9 + ["de"] * 4)]
    rows += [(99, " ".join(f"menu{i}" for i in range(400)), "en"), (98, "OF!! 77 $$$ " * 150, "en"), (97, "the " * 49, "de")]

    def classes(t):
        s = [len(re.findall(x, t)) for x in (r"\s", ql.SYMBOLS, "[A-Z]", "[0-9]", ql.PUNCTUATION)]
        return [*s, len(t) - sum(s)]

    def common(t):
        c = Counter(w.lower() for w in WORDS.findall(t))
        usual = [c[w] for w in ql.COMMON]
        return [*usual, c.total() - sum(usual)]

    share = lambda v: [x / max(1, sum(v)) for x in v]
    got = {r.doc_id: r for r in ql.quality(frame(spark, rows)).collect()}
    for lang in ("en", "de"):
        mine = [(i, t) for i, t, g in rows if g == lang]
        refs = [share([sum(x) for x in zip(*(f(t) for _, t in mine if not brute(t)[-1]))]) for f in (classes, common)]
        for i, t in mine:
            near = js(share(classes(t)), refs[0]) if len(t) >= ql.LEAST_CHARS else None
            assert got[i].class_distance == pytest.approx(near, abs=1e-9)
            n = sum(common(t))
            far = js(share(common(t)), refs[1]) if n >= ql.LEAST_HISTOGRAM_WORDS else None
            assert got[i].word_distance == pytest.approx(far, abs=1e-9)
            most = math.sqrt(ql.MOST_WORD_DISTANCE**2 + ql.WORD_NOISE / n)
            assert got[i].kept == (not brute(t)[-1] and (near is None or near <= ql.MOST_CLASS_DISTANCE) and (far is None or far <= most))
    assert not got[99].kept and not got[99].base_failed and got[98].base_failed


def test_query_equals_brute_force_and_spares_good_documents(spark):
    from skein.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op9_quality"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert values(got[i]) == brute(t)
        assert not (got[i].kept and got[i].base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [got[i] for i, q in labels.items() if q == 1 and not got[i].base_failed]
    bad = [got[i] for i, q in labels.items() if q == 0]
    assert sum(not r.kept for r in good) <= 0.02 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
