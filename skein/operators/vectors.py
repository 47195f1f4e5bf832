"""Vector search: exact and inverted-file top-k by inner product of unit vectors.

Queries go to the data in blocks of bounded size; each batch of vectors is multiplied with a block in
NumPy and yields its own top k, so that what is shuffled is k rows a batch and query, not the scores.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import tokens
from skein.operators.bm25 import top_k

#: Queries of a block: 4 MB of 1024-dimensional floats.
BLOCK = 1024
SAMPLE_ROWS = 20_000
HASH_DIMENSIONS = 64


def l2_normalized(v: Column) -> Column:
    """A vector at length 1; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of a list column, and which rows have a vector."""
    rows = column.to_pylist()
    has = np.array([r is not None and len(r) > 0 for r in rows], bool)
    m = np.array([r for r, h in zip(rows, has, strict=True) if h], np.float64)
    if len(m):
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(norm > 0, norm, 1)
    return m, has


def _block_scores(batches: Iterator[pa.RecordBatch], queries: np.ndarray, names: list, k: int, lists: list[set] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m, has = _matrix(batch.column("v"))
        ids = np.array(batch.column("item").to_pylist(), dtype=object)[has]
        cells = np.array(batch.column("cell").to_pylist())[has] if lists is not None else None
        q_out, item_out, score_out = [], [], []
        if len(m):
            scores = m @ queries.T
            for j, name in enumerate(names):
                s = scores[:, j]
                at = np.arange(len(s)) if lists is None else np.flatnonzero(np.isin(cells, list(lists[j])))
                if len(at) > k:  # with all ties of the last, which the final order decides
                    least = np.partition(s[at], -k)[-k]
                    at = at[s[at] >= least - 1e-9]
                q_out += [name] * len(at)
                item_out += ids[at].tolist()
                score_out += s[at].tolist()
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_out, batch.schema.field("item").type), "chunk_id": pa.array(item_out, batch.schema.field("item").type), "score": pa.array(score_out, pa.float64())})


def _blocks(queries: DataFrame, id_col: str, vector_col: str) -> Iterator[tuple[list, np.ndarray]]:
    """The query set in blocks, one at a time on the driver."""
    names, rows = [], []
    for r in queries.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v")).where("v is not null").toLocalIterator():
        names.append(r.i)
        rows.append(r.v)
        if len(rows) == BLOCK:
            yield names, _unit(rows)
            names, rows = [], []
    if rows:
        yield names, _unit(rows)


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def flat_search(items: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "vec_id", query_vector: str = "embedding") -> DataFrame:
    """Exact top k of all items for each query: query_id, chunk_id, score, rank.  Filter items beforehand."""
    rows = items.select(F.col(id_col).alias("item"), F.col(vector_col).alias("v"))
    kind = rows.schema["item"].dataType.simpleString()
    out = None
    for names, block in _blocks(queries, query_id, query_vector):
        part = rows.mapInArrow(functools.partial(_block_scores, queries=block, names=names, k=k, lists=None), f"query_id {kind}, chunk_id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return items.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id {kind}, score double, rank int")
    return top_k(out, k)


@dataclass(frozen=True)
class IvfIndex:
    """items(item, v, cell) by cell, and the cells' centres."""

    items: DataFrame
    centres: np.ndarray


def _kmeans(m: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = m[rng.choice(len(m), min(k, len(m)), replace=False)]
    for _ in range(rounds):
        own = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _assign(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m, has = _matrix(batch.column("v"))
        cell = np.full(len(has), -1, np.int32)
        if len(m):
            cell[has] = (m @ centres.T).argmax(1)
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("v"), pa.array(cell)], names=["item", "v", "cell"])


def build_ivf(items: DataFrame, cells: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> IvfIndex:
    """Centres come from at most sample_rows vectors chosen by hash; every vector is indexed."""
    rows = items.select(F.col(id_col).alias("item"), F.col(vector_col).alias("v"))
    sample = [r.v for r in rows.where("v is not null and size(v) > 0").orderBy(F.xxhash64("item"), "item").limit(sample_rows).select("v").collect()]
    centres = _kmeans(_unit(sample), cells) if sample else np.zeros((1, 1))
    kind, vector = rows.schema["item"].dataType.simpleString(), rows.schema["v"].dataType.simpleString()
    return IvfIndex(rows.mapInArrow(functools.partial(_assign, centres=centres), f"item {kind}, v {vector}, cell int"), centres)


def ivf_search(index: IvfIndex, queries: DataFrame, k: int, probes: int = 12, query_id: str = "vec_id", query_vector: str = "embedding") -> DataFrame:
    """Approximate top k: each query looks into its nearest cells."""
    kind = index.items.schema["item"].dataType.simpleString()
    out = None
    for names, block in _blocks(queries, query_id, query_vector):
        nearest = np.argsort(-(block @ index.centres.T), axis=1, kind="stable")[:, :probes]
        wanted = sorted({int(c) for c in nearest.ravel()})
        cells = index.items.where(F.col("cell").isin(wanted))
        part = cells.mapInArrow(functools.partial(_block_scores, queries=block, names=names, k=k, lists=[{int(c) for c in n} for n in nearest]), f"query_id {kind}, chunk_id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return index.items.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id {kind}, score double, rank int")
    return top_k(out, k)


def hashed_embedding(text: Column, dimensions: int = HASH_DIMENSIONS) -> Column:
    """An embedding that needs no model: signed counts of the words' MD5 buckets, at length 1.  Blank texts give zeros."""
    digest = lambda w: F.md5(w.cast("binary"))
    entry = lambda w: F.struct(F.pmod(F.conv(F.substring(digest(w), 1, 4), 16, 10).cast("int"), F.lit(dimensions)).alias("d"), F.when(F.substring(digest(w), 5, 1) < "8", 1.0).otherwise(-1.0).alias("s"))
    entries = F.transform(tokens(text), entry)
    of = lambda d: F.aggregate(F.filter(entries, lambda e: e["d"] == d), F.lit(0.0), lambda s, e: s + e["s"])
    return l2_normalized(F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), of))


def embed_chunks(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", dimensions: int = HASH_DIMENSIONS, encode=None) -> DataFrame:
    """chunk_id, embedding.  Equal texts are encoded once.

    encode: a function from a list of texts to a list of vectors, run in Arrow batches on the executors,
    where it may keep a model; failures fail the task and are not hidden as zeros.  Without it, hashing.
    """
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("content")).withColumn("key", F.sha2(F.coalesce("content", F.lit("")), 256))
    if encode is None:
        words = rows.select("chunk_id", F.explode(tokens(F.col("content"))).alias("w"))
        digest = F.md5(F.col("w").cast("binary"))
        words = words.groupBy("chunk_id", "w").agg(F.count("*").alias("tf"))
        parts = words.select("chunk_id", F.pmod(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(dimensions)).alias("d"), (F.when(F.substring(digest, 5, 1) < "8", 1.0).otherwise(-1.0) * F.col("tf")).alias("x"))
        sums = parts.groupBy("chunk_id").agg(*[F.sum(F.when(F.col("d") == d, F.col("x")).otherwise(0.0)).alias(f"x{d}") for d in range(dimensions)])
        vectors = sums.select("chunk_id", l2_normalized(F.array(*[F.col(f"x{d}") for d in range(dimensions)])).alias("embedding"))
        zero = F.array_repeat(F.lit(0.0), dimensions)
        return rows.select("chunk_id").join(vectors, "chunk_id", "left").select("chunk_id", F.coalesce("embedding", zero).alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encode(batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))], names=["key", "embedding"])

    known = rows.select("key", "content").dropDuplicates(["key"]).mapInArrow(run, "key string, embedding array<float>")
    return rows.select("chunk_id", "key").join(known, "key").select("chunk_id", "embedding")


def store_stats(chunks: DataFrame) -> DataFrame:
    """total_chunks and total_documents, and the histogram of chunk types, in one pass."""
    by = chunks.groupBy("chunk_type").agg(F.count("*").alias("chunks"))
    whole = chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct("document_id").alias("total_documents"))
    return whole.crossJoin(by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_type", "chunks")))).alias("chunk_types")))
