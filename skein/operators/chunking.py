"""Chunking: one document row to many chunk rows.

Sentence chunks fold on the JVM; recursive and sectioned chunks run in Arrow batches, one document at a time.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where recursive chunks are cut, what opens a section, and what marks financial text.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SECTION_OPENERS = (r"(?:^|\n)(#{1,3}\s+.+)", r"(?:^|\n)([A-Z][A-Z\s]+:)", r"(?:^|\n)((?:Item|Section|Part)\s+\d+[.:]\s*.+)", r"(?:^|\n)((?:Revenue|Income|Expense|Asset|Liability|Equity).*:)")
FINANCIAL_WORDS = ("revenue", "income", "expense", "profit", "loss", "asset", "liability", "equity", "cash flow", "balance sheet", "income statement")
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"


@dataclass(frozen=True)
class ChunkingConfig:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_size: int = 100
    separators: tuple[str, ...] = SEPARATORS

    def __post_init__(self):
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")


def _groups(parts: list[str], sep: str, size: int, overlap: int) -> Iterator[tuple[str, bool]]:
    """Parts packed up to size, each group opened by the whole parts that end the one before, as far as overlap goes; and whether it is the last."""
    held, length = [], 0
    for part in parts:
        need = len(part) + len(sep)
        if held and length + need > size:
            yield sep.join(held), False
            room, first = overlap, len(held)
            while first and len(held[first - 1]) + len(sep) <= room:
                first -= 1
                room -= len(held[first]) + len(sep)
            tail = sep.join(held[first:])
            held, length = ([tail], len(tail)) if tail else ([], 0)
        held.append(part)
        length += need
    if held:
        yield sep.join(held), True


def split_recursive(text: str, c: ChunkingConfig, level: int = 0) -> list[str]:
    if level == len(c.separators):
        step = c.chunk_size - c.chunk_overlap
        windows = (text[i : i + c.chunk_size] for i in range(0, len(text), step))
        return [w for w in windows if len(w) >= c.min_chunk_size]
    sep = c.separators[level]
    out: list[str] = []
    for group, last in _groups(text.split(sep) if sep else list(text), sep, c.chunk_size, c.chunk_overlap):
        if len(group) > c.chunk_size:
            out += split_recursive(group, c, level + 1)
        elif not last or len(group) >= c.min_chunk_size:
            out.append(group)
    return out


def recursive_chunks(text: str | None, c: ChunkingConfig) -> list[dict]:
    """content, start and end (which assume a whole overlap), chunk_index, total_chunks."""
    if not text or len(text.strip()) < c.min_chunk_size:
        return []
    pieces = split_recursive(text, c)
    out, at = [], 0
    for i, piece in enumerate(pieces):
        out.append({"content": piece.strip(), "start_index": at, "end_index": at + len(piece), "chunk_index": i, "total_chunks": len(pieces)})
        at += len(piece) - c.chunk_overlap
    return out


def sections(text: str) -> list[str]:
    """A text parted where headers open a section; header and body joined by line ends."""
    out: list[list[str]] = []
    for part in re.split("|".join(SECTION_OPENERS), text):
        part = (part or "").strip()
        if not part:
            continue
        if not out or any(re.match(p, part) for p in SECTION_OPENERS):
            out.append([])
        out[-1].append(part)
    return ["\n".join(s) for s in out] or [text]


def detect_type(text: str) -> str:
    if text.count("|") > 5:
        return "table"
    low = text.lower()
    if any(w in low for w in FINANCIAL_WORDS):
        return "financial_data"
    return "header" if len(text) < 200 and text.strip().isupper() else "text"


def chunk_type(text: Column) -> Column:
    """detect_type as a Column expression."""
    low = F.lower(text)
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    is_upper = (F.upper(text) == text) & (low != text)
    return F.when(pipes > 5, "table").when(low.rlike("|".join(FINANCIAL_WORDS)), "financial_data").when((F.length(text) < 200) & is_upper, "header").otherwise("text")


def financial_chunks(text: str | None, c: ChunkingConfig, kind: str = "text") -> list[dict]:
    out = []
    for i, section in enumerate(sections(text or "")):
        if len(section) > c.chunk_size:
            out += [x | {"chunk_type": kind, "section_index": i} for x in recursive_chunks(section, c)]
        elif len(section) >= c.min_chunk_size:
            out.append({"content": section.strip(), "chunk_type": detect_type(section), "section_index": i})
    return out


FIELDS = {"chunk_seq": pa.int32(), "content": pa.string(), "chunk_type": pa.string(), "start_index": pa.int32(), "end_index": pa.int32(), "chunk_index": pa.int32(), "total_chunks": pa.int32(), "section_index": pa.int32()}


def _run(batches: Iterator[pa.RecordBatch], strategy: str, c: ChunkingConfig, kind: str) -> Iterator[pa.RecordBatch]:
    make = {"recursive": lambda t: [x | {"chunk_type": kind} for x in recursive_chunks(t, c)]}.get(strategy, lambda t: financial_chunks(t, c, kind))
    for batch in batches:
        row, found = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for seq, x in enumerate(make(text)):
                row.append(i)
                found.append(x | {"chunk_seq": seq})
        columns = {k: pa.array([x.get(k) for x in found], t) for k, t in FIELDS.items()}
        yield pa.RecordBatch.from_pydict({"document_id": batch.column("document_id").take(pa.array(row, pa.int64()))} | columns)


def chunk_id(document_id: Column, *parts: Column) -> Column:
    """The same chunk gets the same id whenever it is made."""
    return F.sha2(F.concat_ws(":", document_id.cast("string"), *[p.cast("string") for p in parts]), 256)


def create_chunks(docs: DataFrame, strategy: str = "financial", config: ChunkingConfig | None = None, id_col: str = "document_id", text_col: str = "text", kind: str = "text") -> DataFrame:
    """chunk_id, document_id, chunk_seq, content, chunk_type, start_index, end_index, metadata.

    strategy: recursive, sentence or financial; others count as financial.
    """
    c = config or ChunkingConfig()
    rows = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("text"))
    if strategy == "sentence":
        chunks = _sentence_chunks(rows, c).withColumn("chunk_type", F.lit(kind))
    else:
        kind_of_id = rows.schema["document_id"].dataType.simpleString()
        schema = f"document_id {kind_of_id}, chunk_seq int, content string, chunk_type string, start_index int, end_index int, chunk_index int, total_chunks int, section_index int"
        chunks = rows.mapInArrow(functools.partial(_run, strategy=strategy, c=c, kind=kind), schema)
    keys = [k for k in ("chunk_index", "total_chunks", "section_index", "chunking_method") if k in chunks.columns]
    metadata = F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k).cast("string"))]), lambda k, v: v.isNotNull())
    start, end = (F.col(k) if k in chunks.columns else F.lit(None).cast("int").alias(k) for k in ("start_index", "end_index"))
    return chunks.select(chunk_id(F.col("document_id"), F.col("chunk_seq"), F.col("content")).alias("chunk_id"), "document_id", "chunk_seq", "content", "chunk_type", start, end, metadata.alias("metadata"))


def _sentence_chunks(rows: DataFrame, c: ChunkingConfig) -> DataFrame:
    sentence = F.filter(F.transform(F.split("text", f"(?U){SENTENCE_END}"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")

    def add(s, x):
        full = (F.size(s["held"]) > 0) & (s["length"] + F.length(x) > c.chunk_size)
        return F.struct(
            F.when(full, F.array_append(s["out"], F.array_join(s["held"], " "))).otherwise(s["out"]).alias("out"), F.when(full, F.array(x)).otherwise(F.array_append(s["held"], x)).alias("held"),
            (F.when(full, F.lit(0)).otherwise(s["length"]) + F.length(x) + 1).alias("length"),
        )

    none = F.array().cast("array<string>")
    packed = F.aggregate(F.coalesce(sentence, none), F.struct(none.alias("out"), none.alias("held"), F.lit(0).alias("length")), add, lambda s: F.when(F.size(s["held"]) > 0, F.array_append(s["out"], F.array_join(s["held"], " "))).otherwise(s["out"]))
    long = F.filter(packed, lambda x: F.length(x) >= c.min_chunk_size)
    out = rows.select("document_id", F.posexplode(long).alias("chunk_seq", "content"))
    return out.withColumn("chunk_index", F.col("chunk_seq")).withColumn("chunking_method", F.lit("sentence"))


def without_headers_and_footers(pages: DataFrame, document_col: str = "document_id", page_col: str = "page", text_col: str = "text", share: float = 0.7) -> DataFrame:
    """pages without the first or last line that share of a document's pages (3 or more) have alike; of lines as common the first seen."""
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n")
    ends = pages.select(F.col(document_col).alias("d"), F.col(page_col).alias("p"), F.col(text_col).alias("t"), F.explode(F.array(F.struct(F.lit("head").alias("side"), F.element_at(lines, 1).alias("line")), F.struct(F.lit("foot").alias("side"), F.element_at(lines, -1).alias("line")))).alias("e"))
    counts = ends.groupBy("d", "e.side", "e.line").agg(F.count("*").alias("n"), F.min("p").alias("seen"))
    sizes = pages.groupBy(F.col(document_col).alias("d")).agg(F.count("*").alias("pages"))
    best = counts.where(F.trim("line") != "").groupBy("d", "side").agg(F.max(F.struct("n", (-F.col("seen")).alias("early"), "line")).alias("b")).join(sizes, "d").where((F.col("pages") >= 3) & (F.col("b.n") >= share * F.col("pages")))
    common = best.groupBy("d").agg(F.max(F.when(F.col("side") == "head", F.col("b.line"))).alias("head"), F.max(F.when(F.col("side") == "foot", F.col("b.line"))).alias("foot"))
    joined = pages.join(common.withColumnRenamed("d", "__d"), F.col(document_col) == F.col("__d"), "left")
    body = joined.withColumn("__lines", lines)
    body = body.withColumn("__lines", F.when(F.col("head") == F.element_at("__lines", 1), F.slice("__lines", F.lit(2), F.size("__lines"))).otherwise(F.col("__lines")))
    last = F.try_element_at("__lines", F.lit(-1))
    body = body.withColumn("__lines", F.when(F.col("foot") == last, F.slice("__lines", F.lit(1), F.size("__lines") - 1)).otherwise(F.col("__lines")))
    return body.withColumn(text_col, F.array_join("__lines", "\n")).select(*pages.columns)
