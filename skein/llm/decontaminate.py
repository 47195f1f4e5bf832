"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Test items are the stated query set.  Their word n-grams go into an Aho-Corasick automaton (in blocks of
at most BLOCK_WORDS words, so that an automaton's size is bounded whatever the benchmark), one scan of the
training texts finds every occurrence, and hits of one item that lie near each other become a passage: the
words around them, wide enough for the whole item.  Each n-gram's document frequency is counted over the
corpus; a passage goes on at once if it has a rare seed: an n-gram in at most rare_df documents, or at most
twice the median frequency of its item's n-grams.  A passage whose n-grams are all more frequent goes on if
it has so many of the item's words that an alignment could reach `least`; no alignment has more matches than
that, so rarity saves work and loses nothing.  Items of fewer than n words are one n-gram.

Passage and item are aligned by words: +2 for a match, -1 for a mismatch or gap.  A document is
contaminated if an alignment reaches `least` of an item's perfect score, which takes in exact and edited
copies and copies of over half an item.

Words are runs of letters, digits and underscores of the lower-cased text, so case, punctuation and
spacing do not matter.  Edge cases: null and empty texts have no hits; items without words are never
found; an empty benchmark or corpus gives no rows; equal items are each found; rows that repeat are
each reported; documents with a null id are found under that null id; of passages with equal scores the first
counts; other columns are not read, and may have any names.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import packed, small_batches, spill, text_key, unpacked

SEED_WORDS = 4
RARE_DF = 100
LEAST = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: An automaton of so many words takes about 150 MB in a worker.
BLOCK_WORDS = 500_000

_WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def grams_of(words: list[str], n: int) -> list[str]:
    """n-grams by their offset, with blanks at both ends."""
    width = min(n, len(words))
    return [f" {' '.join(words[i : i + width])} " for i in range(len(words) - width + 1)] if words else []


@functools.lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[int, str], ...], n: int):
    """The automaton of some items' n-grams; each leads to (gram number, [(item's index, offset)])."""
    import ahocorasick

    places: dict[str, list[tuple[int, int]]] = {}
    lengths = []
    for k, (_, text) in enumerate(items):
        words = words_of(text)
        lengths.append(len(words))
        for o, g in enumerate(grams_of(words, n)):
            places.setdefault(g, []).append((k, o))
    auto = ahocorasick.Automaton()
    for i, (g, at) in enumerate(places.items()):
        auto.add_word(g, (i, at))
    if places:
        auto.make_automaton()
    return auto, lengths, bool(places)


def find_passages(text: str, auto, lengths: list[int]) -> list[tuple[int, list[int], int, str]]:
    """(item's index, gram numbers, first word's position, words) of each passage that holds seeds."""
    words = words_of(text)
    hits = list(auto.iter(f" {' '.join(words)} "))
    if not hits:
        return []
    ends = list(accumulate(len(w) + 1 for w in words))  # of each word's last blank
    seeds: dict[int, list[tuple[int, int]]] = {}
    for end, (gram, at) in hits:
        last = bisect_right(ends, end - 1)  # the gram's last word
        for item, offset in at:
            seeds.setdefault(item, []).append((last, gram, offset))
    out = []
    for item, found in seeds.items():
        size = lengths[item]
        slack = size // 4 + 4
        found.sort()
        run: list = []
        for seed in [*found, None]:
            if run and (seed is None or seed[0] - run[-1][0] > size + slack):
                low = max(0, min(e - o for e, _, o in run) - slack - 8)
                high = min(len(words), max(e - o for e, _, o in run) + size + slack)
                out.append((item, sorted({g for _, g, _ in run}), low, " ".join(words[low:high])))
                run = []
            run.append(seed)
    return out


@functools.lru_cache(maxsize=100_000)
def _counts(item: str) -> Counter:
    return Counter(words_of(item))


def reach(item: str, passage: str) -> float:
    """No alignment of the two has a greater share of the item's perfect score."""
    own = _counts(item)
    there = Counter(passage.split(" "))
    return sum(min(m, there[w]) for w, m in own.items()) / own.total()


def _scan(batches: Iterator[pa.RecordBatch], sent, n: int, block: int) -> Iterator[pa.RecordBatch]:
    items = sent.value
    auto, lengths, any_grams = _automaton(items, n)
    schema = pa.schema([("id", pa.null()), ("tkey", pa.int64()), ("item_id", pa.int64()), ("item", pa.string()), ("block", pa.int32()), ("grams", pa.list_(pa.int32())), ("low", pa.int32()), ("passage", pa.string()), ("reach", pa.float64())])
    for batch in batches:
        schema = schema.set(0, batch.schema.field("id"))
        rows: dict[str, list] = {k: [] for k in schema.names}
        for id_, tkey, text in zip(*(batch.column(c).to_pylist() for c in ("id", "tkey", "text")), strict=True):
            for item, grams, low, passage in find_passages(text, auto, lengths) if text and any_grams else ():
                for k, v in zip(schema.names, (id_, tkey, items[item][0], items[item][1], block, grams, low, passage, reach(items[item][1], passage)), strict=True):
                    rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def align(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Smith-Waterman of words: (score, start and end in b) of the best local alignment; the first of equals."""

    def best(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
        j = np.arange(len(y) + 1)
        row, top = np.zeros(len(y) + 1, np.int64), (0, 0, 0)
        for i, word in enumerate(x):
            base = np.maximum(row + GAP, 0)
            base[1:] = np.maximum(base[1:], row[:-1] + np.where(y == word, MATCH, MISMATCH))
            row = np.maximum.accumulate(base - GAP * j) + GAP * j  # gaps along y
            row[0] = 0
            if (m := int(row.max())) > top[0]:
                top = (m, i + 1, int(row.argmax()))
        return top

    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in v], np.int64) for v in (a, b))
    if not len(x) or not len(y):
        return 0, 0, 0
    score, i, end = best(x, y)
    if not score:
        return 0, 0, 0
    back = best(x[:i][::-1], y[:end][::-1])
    return score, end - back[2], end


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score, ratio, start, end = [], [], [], []
        for item, passage, low in zip(*(batch.column(c).to_pylist() for c in ("item", "passage", "low")), strict=True):
            words = words_of(item)
            s, a, z = align(words, passage.split(" "))
            score.append(s)
            ratio.append(s / (MATCH * len(words)))
            start.append(low + a)
            end.append(low + z)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("tkey"), batch.column("item_id"), pa.array(score, pa.int32()), pa.array(ratio, pa.float64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
            names=["id", "tkey", "item_id", "score", "ratio", "start_word", "end_word"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = SEED_WORDS, rare_df: int = RARE_DF, least: float = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and item that it holds: id, tkey, item_id, score, ratio, start_word, end_word.

    The best passage of each; positions count the text's words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, tkey long, item_id long, item string, block int, grams array<int>, low int, passage string, reach double"
    # a block of items at a time: it is held on the driver, sent once to each executor, and its passages are
    # written before the next block is read
    passages: list[DataFrame] = []
    items: list[tuple[int, str]] = []
    size = 0
    queries = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t is not null").orderBy("i", "t")
    for item in chain(queries.toLocalIterator(), [None]):
        if item is None or (items and size > block_words):
            sent = spark.sparkContext.broadcast(tuple(items))
            passages.append(spill(rows.mapInArrow(functools.partial(_scan, sent=sent, n=n, block=len(passages)), schema), "passages"))
            sent.unpersist()
            items, size = [], 0
        if item is not None:
            items.append((item.i, item.t))
            size += len(item.t.split())
    found = functools.reduce(DataFrame.unionByName, passages)
    # the automaton's numbers name grams within a block: a table of the benchmark's size, not the corpus's
    seen = found.select("block", "item_id", "id", "tkey", F.explode("grams").alias("gram"))
    df = seen.select("block", "gram", "id", "tkey").distinct().groupBy("block", "gram").agg(F.count("*").alias("df"))
    of_item = seen.select("block", "item_id", "gram").distinct().join(df, ["block", "gram"])
    rare = of_item.join(of_item.groupBy("block", "item_id").agg(F.percentile("df", 0.5).alias("mid")), ["block", "item_id"])
    rare = rare.where(F.col("df") <= F.greatest(F.lit(float(rare_df)), 2 * F.col("mid"))).groupBy("block", "item_id").agg(F.collect_list("gram").alias("seeds"))
    chosen = found.join(rare, ["block", "item_id"], "left").where(F.arrays_overlap("grams", "seeds") | (F.col("reach") >= least)).select("id", "tkey", "item_id", "item", "low", "passage")
    scored = chosen.mapInArrow(_verify, f"id {id_type}, tkey long, item_id long, score int, ratio double, start_word int, end_word int").where(F.col("ratio") >= least)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), "ratio", "start_word", "end_word"))
    return scored.groupBy("id", "tkey", "item_id").agg(best.alias("b")).select("id", "tkey", "item_id", "b.score", "b.ratio", "b.start_word", "b.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a test item; all columns, and rows with null ids, as they were."""
    gone = spill(contaminated(docs, benchmark, id_col, text_col, **options).select("id", "tkey").distinct(), "gone").select(F.col("id").alias("gone_id"), F.col("tkey").alias("gone_tkey"))
    keyed = packed(docs, id=F.col(id_col), tkey=text_key(F.col(text_col)))
    return unpacked(keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("tkey") == F.col("gone_tkey")), "left_anti"))
