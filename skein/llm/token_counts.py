"""Token counts by offsets: whole documents are encoded once, and tokens are allotted to sections.

A tokenizer's tokens are byte strings that join to the text, so the lengths of a document's tokens give
their spans.  The spans are interval-joined with the sections' spans by searching the sorted bounds, which
costs the tokens once and the sections a logarithm each.  Sections are the fields given (columns, in
order, joined by line ends), or the lines of one text; a line end belongs to the section before it.

A token that crosses a bound is allotted by an explicit rule:
  first     to the section of its first byte (the default)
  last      to the section of its last byte
  majority  to the section of most of its bytes, the first of equals
  split     to all of them by their share of its bytes
Under each rule the sections' counts add up to the document's.

Vocabularies are public files (their folder is a parameter); none is trained or copied here.  A text
longer than PIECE_CHARS is encoded in pieces cut before a blank that follows a letter, where the
pre-tokenizer parts words too, so that the tokens are those of the whole.

Edge cases: null and empty texts have no tokens and no sections; an empty line is a section of its line
end; null fields are empty sections; rows that repeat each get their rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's rule for parting a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "majority", "split")
PIECE_CHARS = 200_000


@dataclass(frozen=True)
class Encoder:
    encoding: object
    lengths: np.ndarray

    def ends(self, text: str) -> np.ndarray:
        """The end, in bytes, of each of the text's tokens."""
        ids = []
        for piece in pieces(text):
            ids += self.encoding.encode_ordinary(piece)
        return np.cumsum(self.lengths[ids]) if ids else np.zeros(0, np.int64)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cuts = [m.start() for m in re.finditer(r"(?<=[^\W\d_]) (?=[^\W\d_])", text[at + size // 2 : at + size])]
        cut = at + size // 2 + cuts[-1] if cuts else None
        if cut is None:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return Encoder(tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths)


def allot(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and how many tokens of it cross its end."""
    n = len(section_ends)
    if not len(token_ends):
        return np.zeros(n), np.zeros(n, np.int64)
    starts = np.r_[0, token_ends[:-1]]
    first, last = np.searchsorted(section_ends, starts, "right"), np.searchsorted(section_ends, token_ends - 1, "right")
    crossing = np.bincount(first[first != last], minlength=n)
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float), crossing
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float), crossing
    counts = np.bincount(first[first == last], minlength=n).astype(float)
    for s, e, i, j in zip(*(x[first != last] for x in (starts, token_ends, first, last)), strict=True):
        share = np.diff(np.r_[s, section_ends[i:j], e])
        if rule == "split":
            counts[i : j + 1] += share / (e - s)
        else:
            counts[i + int(share.argmax())] += 1
    return counts, crossing


def _attribute(batches: Iterator[pa.RecordBatch], path: str, rule: str, n_fields: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        ids, texts = batch.column("id"), batch.column("parts").to_pylist()
        row, section, start, end, tokens, crossing = [], [], [], [], [], []
        for i, parts in enumerate(texts):
            if n_fields:
                names = [p or "" for p in parts]
                bytes_ = [len(p.encode()) + (k < len(names) - 1) for k, p in enumerate(names)]
                text = "\n".join(names)
            else:
                text = parts[0] or ""
                lines = text.split("\n")
                bytes_ = [len(p.encode()) + (k < len(lines) - 1) for k, p in enumerate(lines)]
                if bytes_ and not bytes_[-1]:
                    bytes_.pop()
            bounds = np.cumsum(bytes_) if bytes_ else np.zeros(0, np.int64)
            counts, over = allot(enc.ends(text), bounds, rule)
            row += [i] * len(bounds)
            section += range(len(bounds))
            start += np.r_[0, bounds[:-1]].tolist() if len(bounds) else []
            end += bounds.tolist()
            tokens += counts.tolist()
            crossing += over.tolist()
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row, pa.int64())), pa.array(section, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(tokens, pa.float64()), pa.array(crossing, pa.int64())],
            names=["id", "section", "start_byte", "end_byte", "tokens", "crossing"],
        )


def attribute_tokens(docs: DataFrame, id_col: str = "doc_id", text_cols: tuple[str, ...] = ("text",), rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, section, start_byte, end_byte, tokens, crossing: a row for each section of each document.

    One text column: sections are its lines.  Several: sections are the fields.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("string") for c in text_cols]).alias("parts"))
    id_type = rows.schema["id"].dataType.simpleString()
    n_fields = len(text_cols) if len(text_cols) > 1 else 0
    return rows.mapInArrow(functools.partial(_attribute, path=vocabulary, rule=rule, n_fields=n_fields), f"id {id_type}, section int, start_byte long, end_byte long, tokens double, crossing long")
