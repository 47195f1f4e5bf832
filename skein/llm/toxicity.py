"""Toxicity: Levenshtein automata met with a lexicon trie, and context windows.

The lexicon's trie and a Levenshtein automaton for each of its terms are run together as one automaton,
made deterministic as texts come by: a state is the set of trie nodes a word so far can be at, each with
the edits it took (insertion, deletion, substitution, neighbours exchanged).  Terms of up to 3 letters
allow no edit, up to 7 one, longer ones two.  Most words leave the automaton after a few letters, and the
number of states depends on the lexicon alone.

Each hit is judged in its window of words: quotation marks around it, and words of report or mention
nearby, make it a quotation; further hits and second-person words nearby make it abuse.  The document's
sums of both, with exact and fuzzy hits apart, go into a logistic regression.

Trained from labelled rows, on a sample of at most sample_rows of them chosen by hash (a documented bound):
the terms that mark toxic documents join a seed lexicon, and the regression is fitted to the features.  A
term marks if it is in least_positive toxic documents or more and its log odds are least_odds or more; of
such terms the max_terms with the most evidence (toxic documents times log odds) are learned, which bounds
the automaton.  The driver gets terms and feature rows of that sample, never texts.

Edge cases: null and empty texts get the score of a document without hits; without labels of both
classes the prior weights hold; documents that repeat get equal scores; labels of one document that
disagree count as the largest, and of texts that repeat its id one is learned from; labels without a
document are not used; terms with equal evidence are taken in alphabetical order; work grows with a text's
length, however many hits and quotations it has; other columns are not read, and may have any names.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import packed, small_batches, spill, text_key, unpacked

#: Insults that any model starts from.
SEED_TERMS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumbass", "bastard", "asshole", "bitch", "retard", "whore", "scumbag")
#: Words that report or mention, and words that address someone.
REPORT_WORDS = frozenset("said says say wrote writes called calls quoted quotes quote word words term terms phrase reported report reports according mentioned titled named entitled".split())
ADDRESS_WORDS = frozenset("you your yours yourself youre u ur".split())
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}

WINDOW = 8
SAMPLE_ROWS = 20_000
#: Of the lexicon: terms that are learned; in how many toxic documents; and how much likelier in one than in others.
MAX_TERMS, LEAST_POSITIVE, LEAST_ODDS = 500, 3, math.log(20)
SEED_WEIGHT = 5.0
THRESHOLD = 0.3
_PARTS = re.compile(r"([^\W_]+)")
#: A task remembers the verdicts of so many words of either kind, and then starts anew.
_KNOWN_WORDS = 150_000


def budget(term: str) -> int:
    return 0 if len(term) <= 3 else 1 if len(term) <= 7 else 2


class LexiconAutomaton:
    """The deterministic form, made as needed, of a trie of terms met with their Levenshtein automata."""

    def __init__(self, terms: tuple[str, ...]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]  # the largest budget below a node
        for term in terms:
            node = 0
            self.most[0] = max(self.most[0], budget(term))
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], budget(term))
            self.term[node] = term
        self.alphabet = {c for d in self.children for c in d}
        self.letters = ["", *sorted(self.alphabet)]
        self.nth = {c: i for i, c in enumerate(self.letters)}
        #: each a packed run of node, nth letter owed, edits; there are tens of thousands
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._state({(0, ""): 0})

    def _state(self, at: dict[tuple[int, str], int]) -> int:
        """at: edits by (node, letter that must come next after an exchange); -1 if empty."""
        queue = list(at)
        for node, owed in queue:  # letters of a term that the word leaves out
            e = at[node, owed] + 1
            if not owed:
                for child in self.children[node].values():
                    if e <= self.most[child] and e < at.get((child, ""), 99):
                        at[child, ""] = e
                        queue.append((child, ""))
        if not at:
            return -1
        of = sorted((n, o, e) for (n, o), e in at.items())
        key = array("I", chain.from_iterable((n, self.nth[o], e) for n, o, e in of)).tobytes()
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, o, e in of if not o and self.term[n] is not None and e <= budget(self.term[n])]
            self.accepts.append(min(ends)[::-1] if ends else None)
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        at: dict[tuple[int, str], int] = {}

        def reach(node: int, owed: str, e: int) -> None:
            if e <= self.most[node] and e < at.get((node, owed), 99):
                at[node, owed] = e

        packed_state = iter(array("I", self.states[state]))
        for node, nth, e in zip(packed_state, packed_state, packed_state, strict=True):
            owed = self.letters[nth]
            if owed:
                if c == owed:
                    reach(node, "", e)
                continue
            reach(node, "", e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, "", e + (letter != c))
                if letter != c and c in self.children[child]:
                    reach(self.children[child][c], letter, e + 1)
        return self._state(at)

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that a word is an edit of, and the edits."""
        state = self.start
        for c in word:
            c = c if c in self.alphabet else "\0"
            after = self.moves[state].get(c)
            if after is None:
                after = self.moves[state][c] = self._step(state, c)
            if after < 0:
                return None
            state = after
        return self.accepts[state]


@dataclass(frozen=True)
class ToxicityModel:
    #: terms with their log odds
    terms: tuple[tuple[str, float], ...] = tuple((t, SEED_WEIGHT) for t in SEED_TERMS)
    #: bias, then a weight for each of FEATURES
    weights: tuple[float, ...] = (-3.5, 1.4, 0.8, -0.3, 0.3, 0.3, 0.2, 0.2)
    trained_on: int = field(default=0, compare=False)


FEATURES = ("log_evidence", "fuzzy", "quoted", "density", "dense_window", "addressed", "evidence")


@lru_cache(maxsize=1)  # workers outlive a query; the automaton of an earlier model goes
def _automaton(terms: tuple[tuple[str, float], ...]) -> tuple[LexiconAutomaton, set[str], dict]:
    return LexiconAutomaton(tuple(t for t, _ in terms)), set(), {}


def _quoted_spans(text: str) -> list[tuple[int, int]]:
    """Stretches between quotation marks of one line."""
    out, opened, closing = [], -1, ""
    for m in re.finditer('["“”«»„\n]', text):
        c = m.group()
        if c == "\n":
            opened = -1
        elif opened >= 0 and c == closing:
            out.append((opened, m.start()))
            opened = -1
        elif opened < 0 and c in QUOTES:
            opened, closing = m.start(), QUOTES[c]
    return out


def _lowered(text: str) -> tuple[list[str], list[str]]:
    """Gaps and words of a text by turns, as long as they are in it, and the words in lower case."""
    if "İ" in text or "Σ" in text:  # these become longer, or other letters by what is around the word
        parts = _PARTS.split(text)
        return parts, [w.lower() for w in parts[1::2]]
    parts = _PARTS.split(text.lower())
    return parts, parts[1::2]


def hits_of(text: str | None, terms: tuple[tuple[str, float], ...]) -> tuple[list[dict], int]:
    """Hits (start, end, term, edits, quotation 0..1, near, addressed) and the number of words."""
    automaton, clean, found = _automaton(terms)
    text = text or ""
    parts, words = _lowered(text)
    distinct = set(words)
    for known in (clean, found):
        if len(known) > _KNOWN_WORDS:
            known.clear()
    for w in distinct - clean:
        if w not in found:
            m = automaton.match(w)
            if m:
                found[w] = m
            else:
                clean.add(w)
    if found.keys().isdisjoint(distinct):
        return [], len(words)
    ends = list(accumulate(map(len, parts)))
    at = [i for i, w in enumerate(words) if w in found]
    quotes = _quoted_spans(text)
    openings = [a for a, _ in quotes]
    out = []
    for i in at:
        term, edits = found[words[i]]
        start, end = ends[2 * i], ends[2 * i + 1]
        window = words[max(0, i - WINDOW) : i + WINDOW + 1]
        q = bisect_left(openings, start) - 1  # the last quotation that opens before; they don't overlap
        inside = q >= 0 and end <= quotes[q][1]
        reported = not REPORT_WORDS.isdisjoint(window)
        near = bisect_right(at, i + WINDOW) - bisect_left(at, i - WINDOW) - 1
        addressed = not ADDRESS_WORDS.isdisjoint(window)
        quotation = max(0.0, 0.7 * inside + 0.4 * reported - 0.3 * addressed)
        out.append({"start": start, "end": end, "term": term, "edits": edits, "quotation": min(1.0, quotation), "near": near, "addressed": addressed})
    return out, len(words)


def features_of(hits: list[dict], n_words: int, terms: tuple[tuple[str, float], ...]) -> list[float]:
    if not hits:
        return [0.0] * len(FEATURES)
    odds = _odds(terms)
    exact: dict[str, float] = {}
    fuzzy: dict[str, float] = {}
    for h in hits:
        of = fuzzy if h["edits"] else exact
        of[h["term"]] = of.get(h["term"], 0) + (1 - h["quotation"]) / (1 + h["edits"])
    evidence, faint = (sum(odds[t] * math.log1p(n) for t, n in of.items()) for of in (exact, fuzzy))
    return [
        math.log1p(evidence), math.log1p(faint), math.log1p(sum(h["quotation"] for h in hits)), math.log1p(1000 * sum(exact.values()) / (n_words + 20)),
        math.log1p(max(h["near"] for h in hits)), math.log1p(sum(h["addressed"] for h in hits)), min(evidence, 40) / 10,
    ]


@lru_cache(maxsize=4)
def _odds(terms: tuple[tuple[str, float], ...]) -> dict[str, float]:
    return dict(terms)


def score_of(features: list[float], weights: tuple[float, ...]) -> float:
    z = weights[0] + sum(w * x for w, x in zip(weights[1:], features, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


HIT = "struct<start:int,end:int,term:string,edits:int,quotation:double>"


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """struct(score, hits): the score from 0 to 1, and where and what the hits are."""

    @F.pandas_udf(T.StructType.fromDDL(f"score double, hits array<{HIT}>"))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                hits, n = hits_of(t, model.terms)
                rows.append((score_of(features_of(hits, n, model.terms), model.weights), [{k: h[k] for k in ("start", "end", "term", "edits", "quotation")} for h in hits]))
            yield pd.DataFrame(rows, columns=["score", "hits"])

    return run(text)


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """The score of toxicity() alone, without the hits on their way out of Python."""

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([score_of(features_of(*hits_of(t, model.terms), model.terms), model.weights) for t in batch], dtype="float64")

    return run(text)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; but for the quotations' no feature may lower the score."""
    w = _newton(x, y, ridge)
    free = np.ones(x.shape[1], bool)
    quoted = FEATURES.index("quoted")
    while (bad := [i for i in np.flatnonzero(free) if i != quoted and w[i + 1] < 0]):
        free[bad] = False
        part = _newton(x[:, free], y, ridge)
        w = np.zeros(x.shape[1] + 1)
        w[0], w[1:][free] = part[0], part[1:]
    return w


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS,
          max_terms: int = MAX_TERMS, least_positive: int = LEAST_POSITIVE, least_odds: float = LEAST_ODDS) -> ToxicityModel:
    """labels holds the rows that may be learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    ids = spill(ids.orderBy(F.xxhash64(F.lit("toxicity"), "id"), "id").limit(sample_rows), "labels")
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    sample = spill(sample.groupBy("id").agg(F.max("y").alias("y"), F.max_by("text", text_key(F.col("text"))).alias("text")), "sample")
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return ToxicityModel()
    words = sample.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\W_]{3,}"), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n[1] + 1)) - F.log((F.col("neg") + 0.5) / (n[0] + 1))
    marking = counts.where(F.col("pos") >= least_positive).withColumn("odds", F.round(odds, 6)).where(F.col("odds") >= least_odds)
    learned = {r.word: r.odds for r in marking.orderBy(F.desc(F.col("pos") * F.col("odds")), "word").limit(max_terms).collect()}
    terms = tuple(sorted(({t: SEED_WEIGHT for t in SEED_TERMS} | learned).items()))

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([features_of(*hits_of(t, terms), terms) for t in texts])

    rows = sample.select("y", features("text").alias("x")).toPandas()
    w = _fit(np.array(rows["x"].tolist(), float), rows["y"].to_numpy(float))
    return ToxicityModel(terms, tuple(float(v) for v in w), len(rows))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from; rows without an id are none of them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, hits; a row for each document."""
    small_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("doc_id"), toxicity(F.col(text_col), model).alias("t"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("t.score").alias("score"), (F.col("t.score") >= threshold).cast("int").alias("predicted"), F.col("t.hits").alias("hits"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more; all columns as they were."""
    small_batches(docs.sparkSession)
    return unpacked(packed(docs, score=toxicity_score(F.col(text_col), model)).where(F.col("score") < threshold))
