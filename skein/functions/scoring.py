"""Retrieval and answer metrics as Column expressions over arrays; 0..1 unless said otherwise."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import tokens

# Words that the answer metrics leave out.
RELEVANCE_STOP = tuple(
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after above below between under again "
    "further then once what which who whom this that these those am or and but if because until while although though".split()
)
FAITH_STOP = tuple("the a an is are was were be been have has had do does did to of in for on with at by".split())
EXPECTED_STOP = tuple("the a an is are was were to of in for on with at by and or but".split())


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f and the lambdas in it refer to it."""
    return F.transform(F.array(value), f)[0]


def both_tokens(a: Column, b: Column, f) -> Column:
    return let(tokens(a), lambda x: let(tokens(b), lambda y: f(x, y)))


def _size(c: Column) -> Column:
    return F.size(c).cast("double")


def _div(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.when(b > 0, F.try_divide(a.cast("double"), b)).otherwise(F.lit(other))


def precision(found: Column, relevant: Column) -> Column:
    return _div(_size(F.array_intersect(found, relevant)), _size(F.array_distinct(found)))


def recall(found: Column, relevant: Column) -> Column:
    return _div(_size(F.array_intersect(found, relevant)), _size(F.array_distinct(relevant)))


def f1(p: Column, r: Column) -> Column:
    return _div(2 * p * r, p + r)


def accuracy(found: Column, relevant: Column, total: int = 100) -> Column:
    right = _size(F.array_intersect(found, relevant)) + total - _size(F.array_union(found, relevant))
    return right / max(total, 1)


def _hits(found: Column, relevant: Column) -> Column:
    """1-based ranks of found elements that are relevant."""
    return F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda r: r.isNotNull())


def mrr(found: Column, relevant: Column) -> Column:
    return F.coalesce(1.0 / F.array_min(_hits(found, relevant)), F.lit(0.0))


def average_precision(found: Column, relevant: Column) -> Column:
    parts = F.transform(_hits(found, relevant), lambda rank, i: (i + 1) / rank)
    return _div(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), _size(F.array_distinct(relevant)))


def ndcg(found: Column, relevant: Column) -> Column:
    """Binary gains; the ideal has a hit for each of the relevant list."""
    gain = lambda ranks: F.aggregate(F.transform(ranks, lambda r: 1.0 / F.log2(r + F.lit(1.0))), F.lit(0.0), lambda s, x: s + x)
    best = F.when(F.size(relevant) > 0, F.sequence(F.lit(1), F.size(relevant))).otherwise(F.array().cast("array<int>"))
    return _div(gain(_hits(found, relevant)), gain(best))


def graded_ndcg(found: Column, grades: Column) -> Column:
    """grades: a map from element to gain; what is not in it has none."""
    total = lambda gains: F.aggregate(F.transform(gains, lambda g, i: g / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    mine = F.transform(found, lambda x: F.coalesce(F.try_element_at(grades, x).cast("double"), F.lit(0.0)))
    ideal = F.reverse(F.array_sort(F.transform(F.map_values(grades), lambda g: g.cast("double"))))
    return _div(total(mine), total(ideal))


def hit_rate(found: Column, relevant: Column, k: int | None = None) -> Column:
    top = found if k is None else F.slice(found, 1, k)
    return F.coalesce(F.arrays_overlap(top, relevant), F.lit(False)).cast("double")


def retrieval_metrics(found: Column, relevant: Column) -> Column:
    p, r = precision(found, relevant), recall(found, relevant)
    return F.struct(
        p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1_score"), accuracy(found, relevant).alias("accuracy"), mrr(found, relevant).alias("mrr"), average_precision(found, relevant).alias("map_score"),
        ndcg(found, relevant).alias("ndcg"), hit_rate(found, relevant).alias("hit_rate"),
    )


def ngrams(words: Column, n: int) -> Column:
    """Joined n-grams, with repeats."""
    last = F.size(words) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def clipped_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    times = lambda xs, x: F.size(xs) - F.size(F.array_remove(xs, x))
    return F.aggregate(F.transform(F.array_intersect(a, b), lambda x: F.least(times(a, x), times(b, x))), F.lit(0), lambda s, x: s + x)


def _overlap_of(x: Column, y: Column, k: int) -> Column:
    """struct(hit, n_x, n_y): clipped matches of k-grams, and how many there are."""
    counted = lambda a, b: F.struct(clipped_overlap(a, b).cast("double").alias("hit"), _size(a).alias("n_x"), _size(b).alias("n_y"))
    return let(ngrams(x, k), lambda a: let(ngrams(y, k), lambda b: counted(a, b)))


def bleu(generated: Column, expected: Column, n: int = 4) -> Column:
    """No smoothing: any order without a match gives 0."""

    def score(g, e):
        def of(orders):
            some = F.forall(orders, lambda o: o["hit"] > 0)
            logs = F.aggregate(orders, F.lit(0.0), lambda s, o: s + F.log(F.try_divide(F.greatest(o["hit"], F.lit(1.0)), F.greatest(o["n_x"], F.lit(1.0)))))
            brevity = F.when(F.size(g) >= F.size(e), F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(_size(e), _size(g))))
            return F.when(some, brevity * F.exp(logs / n)).otherwise(F.lit(0.0))

        return F.when((F.size(g) > 0) & (F.size(e) > 0), let(F.array(*[_overlap_of(g, e, k) for k in range(1, n + 1)]), of)).otherwise(F.lit(0.0))

    return both_tokens(generated, expected, score)


def rouge(generated: Column, expected: Column, n: int) -> Column:
    """F1 of clipped n-gram overlap."""
    share = lambda o: f1(_div(o["hit"], o["n_x"]), _div(o["hit"], o["n_y"]))
    return both_tokens(generated, expected, lambda g, e: let(_overlap_of(g, e, n), share))


def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    def length(x, y) -> int:
        row = [0] * (len(y) + 1)
        for u in x:
            diagonal = 0
            for j, v in enumerate(y, 1):
                diagonal, row[j] = row[j], diagonal + 1 if u == v else max(row[j], row[j - 1])
        return row[-1]

    return pd.Series([length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(generated: Column, expected: Column) -> Column:
    """F1 of the longest common subsequence; the table is filled in Arrow batches, as folds copy their rows."""
    g, e = tokens(generated), tokens(expected)
    both = F.pandas_udf(_lcs, "int")(g, e)
    return f1(_div(both, _size(g)), _div(both, _size(e)))


def _without(words: Column, stop: tuple[str, ...]) -> Column:
    return F.array_except(words, F.array(*[F.lit(w) for w in stop]))


def _covered(keys: Column, words: Column, nothing: float) -> Column:
    """The share of keys that are among words; nothing if there are no keys."""
    return let(keys, lambda k: _div(_size(F.array_intersect(k, words)), _size(k), nothing))


def answer_relevance(query: Column, answer: Column) -> Column:
    share = lambda q, a: F.when((F.size(q) == 0) | (F.size(a) == 0), F.lit(0.0)).otherwise(_covered(_without(q, RELEVANCE_STOP), a, 0.5))
    return both_tokens(query, answer, share)


def faithfulness(answer: Column, context: Column) -> Column:
    share = lambda a, c: F.when((F.size(a) == 0) | (F.size(c) == 0), F.lit(0.0)).otherwise(_covered(_without(a, FAITH_STOP), c, 1.0))
    return both_tokens(answer, context, share)


def completeness(generated: Column, expected: Column) -> Column:
    return both_tokens(generated, expected, lambda g, e: _covered(_without(e, EXPECTED_STOP), g, 1.0))


def correctness(generated: Column, expected: Column) -> Column:
    """Half Jaccard of the words, half cosine of their counts."""
    times = lambda xs, x: (F.size(xs) - F.size(F.array_remove(xs, x))).cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    norm = lambda xs: F.sqrt(total(F.transform(F.array_distinct(xs), lambda x: times(xs, x) * times(xs, x))))

    def score(g, e):
        jaccard = _div(_size(F.array_intersect(g, e)), _size(F.array_union(g, e)))
        dot = total(F.transform(F.array_intersect(g, e), lambda x: times(g, x) * times(e, x)))
        return F.when((F.size(g) == 0) | (F.size(e) == 0), F.lit(0.0)).otherwise(0.5 * jaccard + 0.5 * F.try_divide(dot, norm(g) * norm(e)))

    return both_tokens(generated, expected, score)


def context_precision(chunks: Column, answer: Column) -> Column:
    useful = lambda a: F.filter(chunks, lambda c: F.size(F.array_intersect(tokens(c), a)) > 3)
    return let(tokens(answer), lambda a: _div(_size(useful(a)), _size(chunks)))


def context_recall(chunks: Column, expected: Column) -> Column:
    words = F.flatten(F.transform(chunks, lambda c: tokens(c)))
    return F.when(F.size(chunks) == 0, F.lit(0.0)).otherwise(_covered(_without(tokens(expected), EXPECTED_STOP), words, 1.0))


def generation_metrics(query: Column, generated: Column, expected: Column, context: Column) -> Column:
    return F.struct(
        bleu(generated, expected).alias("bleu"), rouge(generated, expected, 1).alias("rouge_1"), rouge(generated, expected, 2).alias("rouge_2"), rouge_l(generated, expected).alias("rouge_l"),
        answer_relevance(query, generated).alias("answer_relevance"), faithfulness(generated, context).alias("faithfulness"), completeness(generated, expected).alias("answer_completeness"),
    )


def end_to_end_metrics(query: Column, generated: Column, expected: Column, chunks: Column) -> Column:
    return F.struct(
        correctness(generated, expected).alias("answer_correctness"), bleu(generated, expected).alias("answer_similarity"), context_precision(chunks, generated).alias("context_precision"), context_recall(chunks, expected).alias("context_recall"),
    )


def keyword_retrieval(chunks: Column, keywords: Column) -> Column:
    """struct(precision, recall, f1_score) where a chunk that holds 30 per cent of the keywords counts as relevant."""
    held = lambda c: F.size(F.filter(keywords, lambda k: F.lower(c).contains(F.lower(k))))
    hits = _size(F.filter(chunks, lambda c: held(c) >= F.size(keywords) * 0.3))
    both = (F.size(chunks) > 0) & (F.size(keywords) > 0)
    p = F.when(both, _div(hits, _size(chunks))).otherwise(F.lit(0.0))
    r = F.when(both, F.least(_div(hits, F.greatest(_size(keywords), F.lit(1.0))), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1_score"))


#: What separates words in UTF-8: keywords are made of letters, digits and underscores, so that each lies within one run of other bytes.
_APART = bytes(c if chr(c).isalnum() or c == 0x5F or c > 0x7F else 0x20 for c in range(256))
#: Runs whose keywords are remembered, and bytes of the longest of them.
RUNS_KEPT, RUN_BYTES = 100_000, 64


def keyword_hits(docs: DataFrame, sets: list[list[str]], group_col: str, text_col: str) -> DataFrame:
    """Partial sums group, at, hits: texts that hold 30 per cent of the keywords of sets[at], lower-cased runs of word characters.

    A text is cut into its distinct runs once, and the keywords that a run holds are looked up once for all sets.
    """
    low = docs.select(F.col(group_col).alias("group"), F.lower(F.col(text_col)).cast("binary").alias("text"))
    return low.mapInArrow(functools.partial(_keyword_hits, sets=sets), f"group {low.schema['group'].dataType.simpleString()}, at int, hits long")


def _keyword_hits(batches: Iterator[pa.RecordBatch], sets: list[list[str]]) -> Iterator[pa.RecordBatch]:
    of_word: dict[bytes, list[int]] = {}
    for at, words in enumerate(sets):
        for w in dict.fromkeys(words):
            of_word.setdefault(w.encode(), []).append(at)
    at_words = {w: np.array(ats) for w, ats in of_word.items()}
    lengths = sorted({len(w) for w in at_words})
    needed = np.array([len(dict.fromkeys(words)) for words in sets])
    known: dict[bytes, tuple[bytes, ...]] = {}

    def held(run: bytes) -> tuple[bytes, ...]:
        found = known.get(run)
        if found is None:
            found = tuple({run[i : i + n] for n in lengths for i in range(len(run) - n + 1)} & at_words.keys()) if len(run) <= RUN_BYTES else tuple(w for w in at_words if w in run)
            if len(run) <= RUN_BYTES:
                if len(known) >= RUNS_KEPT:
                    known.clear()
                known[run] = found
        return found

    for batch in batches:
        hits: dict = {}
        for group, text in zip(batch.column("group").to_pylist(), batch.column("text")):
            words = {w for run in set(text.as_py().translate(_APART).split()) for w in held(run)} if text.is_valid else ()
            if words:
                counts = np.bincount(np.concatenate([at_words[w] for w in words]), minlength=len(sets))
                enough = (counts * 10 >= needed * 3) & (needed > 0)
                hits[group] = hits[group] + enough if group in hits else enough.astype(np.int64)
        for group, n in hits.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(at), batch.schema.field("group").type), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["group", "at", "hits"])


def overall(correct: Column, relevant: Column, faithful: Column, complete: Column) -> Column:
    """struct(score, band): the mean of four metrics, and what it is called."""
    mean = (correct + relevant + faithful + complete) / 4
    return F.struct(mean.alias("score"), F.when(mean >= 0.7, "excellent").when(mean >= 0.5, "good").when(mean >= 0.3, "fair").otherwise("poor").alias("band"))
