"""Secret scans: fixed forms, and strings that look random to character Markov models.

Two models of characters given the two before them are trained from labelled samples.  Ordinary: every
distinct name of the corpus, that is a run of letters, maybe with up to four digits after it, alone or
joined by - _ or /, that no fixed form covers; each counts once, with the other ways that code writes it
(upper case, title case, joined to itself, numbered).  Random: every distinct value that the forms match,
and draws from the alphabets that keys are written in.  All documents are read for both, and what leaves
the executors are the counts of the alphabet's character triples, at most 2 * 67^3 numbers at any size.

A candidate is a run of LEAST_RUN or more characters of A-Za-z0-9+/_=- that no fixed form overlaps.  Its
mean log-likelihood ratio a character decides; where that of the whole run falls short, each stretch of
LEAST_RUN letters and digits between its joints is judged alone.  Without a digit the ratio has to be
higher.  Out of scope are shorter runs, whose ratio says little, and runs without a letter, which are
numbers.

Fixed forms, each found leftmost and without overlap within its kind:
  assign  a keyword, =, : and quotes, then a value of 6 or more characters (the span is the whole match)
  access  AKIA and capitals or digits, 20 or more characters
  hex     24 or more of 0-9a-f
  markov  what the models add

Work grows with a text's length: candidates and fixed forms are merged in order.

Edge cases: null and empty texts have no spans; a corpus without usable words leaves the random draws
against a uniform model, which still has an answer; rows that repeat each get their row, and their strings
count once in training; spans that start together are ordered by kind; other columns are not read, and may
have any names.  Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import small_batches

KINDS = ("assign", "access", "hex", "markov")
#: The forms and the lengths that count.
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

LEAST_RUN = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
STRETCH = re.compile(rf"[A-Za-z0-9]{{{LEAST_RUN},}}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{3,}")
NAME = re.compile(r"[A-Za-z]{3,}[0-9]{0,4}(?:[_/-][A-Za-z]{3,}[0-9]{0,4})*")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Nats a character by which random must be likelier, in runs with and without a digit.
LEAST_RATIO, LEAST_RATIO_LETTERS = 0.5, 1.0
#: Distinct strings that a training task holds before it sends them on.
HELD_STRINGS = 200_000
_N = len(ALPHABET) + 1
_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_HAS_DIGIT, _HAS_LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed forms."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _free(pattern: re.Pattern, text: str, taken: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Matches of the pattern that overlap none of the taken spans, which are in order of their starts."""
    i, reached = 0, 0  # reached: the furthest end of the spans that start before the match's end
    for m in pattern.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            reached = max(reached, taken[i][2])
            i += 1
        if reached <= m.start():
            yield m


@dataclass(frozen=True)
class SecretModel:
    """Log likelihood ratios of a character after two others, random over ordinary, row by row."""

    ratios: np.ndarray

    def ratio(self, s: str) -> float:
        c = _CODE[np.frombuffer(s.encode(), np.uint8)]
        return float(self.ratios[c[:-2], c[1:-1], c[2:]].mean())


def _count(into: np.ndarray, strings: list[str]) -> np.ndarray:
    """Adds the strings' triples of characters to the flat counts."""
    codes = _CODE[np.frombuffer("\0".join(strings).encode("ascii", "replace"), np.uint8)]  # \0 is no character of the alphabet
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inside = (a < _N - 1) & (b < _N - 1) & (c < _N - 1)
    into += np.bincount(((a * _N + b) * _N + c)[inside], minlength=_N**3)
    return into


def _logs(counts: np.ndarray) -> np.ndarray:
    """Log probabilities; a context falls back on the shorter one as far as it has not been seen."""
    counts = counts.reshape(_N, _N, _N).astype(float)
    one = counts.sum(axis=(0, 1)) + 0.5
    one /= one.sum()
    two = counts.sum(axis=0) + 8 * one
    two /= two.sum(axis=1, keepdims=True)
    three = counts + 8 * two
    return np.log(three / three.sum(axis=2, keepdims=True))


def random_strings(n: int) -> list[str]:
    """Labelled random samples: hexadecimal and base-64 digests of numbers."""
    import base64

    out = []
    for i in range(n):
        d = hashlib.sha256(f"random {i}".encode()).digest()
        out.append((d.hex(), base64.b64encode(d).decode(), base64.urlsafe_b64encode(d).decode().rstrip("="), base64.b32encode(d).decode().rstrip("="))[i % 4])
    return out


def spellings(name: str) -> list[str]:
    """A name, and other ways that code writes it."""
    title = name.title()
    return [name, name.upper(), title + title, f"{name}_{name}", f"{name}-{name}", f"{name}{len(name) % 10}", f"{name}_20{len(name) % 90 + 10}"]


def fit(random: np.ndarray, ordinary: np.ndarray) -> SecretModel:
    """From the counts of triples in random strings and in ordinary names."""
    return SecretModel(_logs(_count(random.copy(), random_strings(4000))) - _logs(ordinary))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(random, s): names and values of the forms, each once while they are held."""
    schema = pa.schema([("random", pa.bool_()), ("s", pa.string())])
    values: set[str] = set()
    runs: set[str] = set()

    def sent() -> pa.RecordBatch:
        names = [s for s in runs if NAME.fullmatch(s)]
        out = pa.RecordBatch.from_pydict({"random": [True] * len(values) + [False] * len(names), "s": [*values, *names]}, schema=schema)
        values.clear()
        runs.clear()
        return out

    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            taken = base_spans(text)
            if taken:
                found = (ASSIGN.match(text, a)[1] if k == 0 else text[a:z] for a, k, z in taken)
                values.update(v for v in found if len(v) >= LEAST_RUN)
                runs.update(m[0] for m in _free(RUN, text, taken))
            else:
                runs.update(RUN.findall(text))
            if len(values) + len(runs) >= HELD_STRINGS:
                yield sent()
    yield sent()


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(random, triple, m) of distinct strings; at most one row a triple and label."""
    counts = {label: np.zeros(_N**3, np.int64) for label in (False, True)}
    for batch in batches:
        ways: list[str] = []
        values: list[str] = []
        for label, s in zip(batch.column("random").to_pylist(), batch.column("s").to_pylist(), strict=True):
            # letters alone are no random value: passwords in prose
            if not label:
                ways += spellings(s)
            elif _HAS_DIGIT.search(s):
                values.append(s)
        for label, strings in ((False, ways), (True, values)):
            if strings:
                _count(counts[label], strings)
    for label, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_pydict({"random": [label] * len(at), "triple": at, "m": c[at]}, schema=pa.schema([("random", pa.bool_()), ("triple", pa.int64()), ("m", pa.int64())]))


def train(docs: DataFrame, text_col: str = "text") -> SecretModel:
    """Both models, from all of docs."""
    small_batches(docs.sparkSession)
    samples = docs.select(F.col(text_col).alias("text")).mapInArrow(_samples, "random boolean, s string").distinct()
    triples = samples.mapInArrow(_triples, "random boolean, triple long, m long").groupBy("random", "triple").agg(F.sum("m").alias("m"))
    counts = {label: np.zeros(_N**3, np.int64) for label in (False, True)}
    for r in triples.collect():  # at most 2 * _N^3
        counts[r.random][r.triple] = r.m
    return fit(counts[True], counts[False])


def spans_of(text: str | None, model: SecretModel, least: float = LEAST_RATIO, least_letters: float = LEAST_RATIO_LETTERS) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all secrets of a text."""
    if not text:
        return []
    out = base_spans(text)
    more = []

    def random(s: str) -> bool:
        return bool(_HAS_LETTER.search(s)) and model.ratio(s) >= (least if _HAS_DIGIT.search(s) else least_letters)

    for m in _free(CANDIDATE, text, out):
        if random(m[0]):
            more.append((m.start(), 3, m.end()))
        elif not m[0].isalnum():
            more += [(m.start() + p.start(), 3, m.start() + p.end()) for p in STRETCH.finditer(m[0]) if random(p[0])]
    return sorted(out + more)


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def _scan(batches: Iterator[pa.RecordBatch], ratios: bytes, least: float) -> Iterator[pa.RecordBatch]:
    model = SecretModel(np.frombuffer(ratios, np.float32).reshape(_N, _N, _N))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [spans_of(t, model, least) for t in batch.column("text").to_pylist()]
        rows = [[{"kind": KINDS[k], "start": a, "end": z} for a, k, z in f] for f in found]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, span)], names=["id", "spans"])


def find_secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """id and spans, an array of (kind, start, end) by start and then kind; a row for each document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(functools.partial(_scan, ratios=model.ratios.astype(np.float32).tobytes(), least=least), f"id {id_type}, spans array<struct<kind:string,start:int,end:int>>")


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed forms, their digest, and all spans as text."""
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = as_text(F.filter("spans", lambda s: s["kind"] != "markov"))
    return found.select(F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
