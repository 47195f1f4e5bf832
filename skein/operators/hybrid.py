"""Hybrid retrieval: vector and BM25 results fused, reranked by words, cut and ranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import tokens
from skein.operators import bm25, vectors


@dataclass(frozen=True)
class RetrieverConfig:
    top_k: int = 10
    vector_weight: float = 0.7
    bm25_weight: float = 0.3
    rerank_top_k: int = 5
    threshold: float = 0.3
    use_hybrid: bool = True


def fuse(vector_hits: DataFrame, bm25_hits: DataFrame, config: RetrieverConfig | None = None) -> DataFrame:
    """Both sides (query_id, chunk_id, score) at their share of their best score; full outer join; top_k a query."""
    c = config or RetrieverConfig()
    best = Window.partitionBy("query_id")
    share = lambda df, w, name: df.withColumn("m", F.max("score").over(best)).select("query_id", "chunk_id", (w * F.col("score") / F.when(F.col("m") == 0, 1.0).otherwise(F.col("m"))).alias(name))
    both = share(vector_hits, c.vector_weight, "v").join(share(bm25_hits, c.bm25_weight, "b"), ["query_id", "chunk_id"], "full_outer")
    scored = both.select("query_id", "chunk_id", (F.coalesce("v", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score"))
    return bm25.top_k(scored, c.top_k)


def rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, config: RetrieverConfig | None = None) -> DataFrame:
    """hits with content: score * (1 + 0.3 * share of the query's words + 0.2 if it is found whole); the first rerank_top_k over the threshold, ranked.

    The order that fused ranks give decides among equals.
    """
    c = config or RetrieverConfig()
    q = queries.select("query_id", F.lower("query").alias("q"), F.array_distinct(tokens(F.col("query"))).alias("q_words"))
    joined = hits.join(chunks, "chunk_id").join(q, "query_id")
    share = F.size(F.array_intersect("q_words", tokens(F.col("content")))) / F.greatest(F.size("q_words"), F.lit(1))
    whole = F.lower("content").contains(F.col("q")).cast("double")
    scored = joined.withColumn("score", F.col("score") * (1 + 0.3 * share + 0.2 * whole)).drop("q", "q_words")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("rank"), "chunk_id")
    first = scored.withColumn("at", F.row_number().over(order)).where(F.col("at") <= c.rerank_top_k).where(F.col("score") >= c.threshold)
    return first.drop("rank").withColumnRenamed("at", "rank").withColumn("method", F.lit("hybrid" if c.use_hybrid else "vector"))


def filter_chunks(chunks: DataFrame, document_ids: list | None = None, chunk_type: str | None = None, metadata: dict | None = None) -> DataFrame:
    """Before any ranking: documents, type, and metadata keys, where a chunk that lacks a key passes."""
    out = chunks
    if document_ids is not None:
        out = out.where(F.col("document_id").isin(document_ids))
    if chunk_type is not None:
        out = out.where(F.col("chunk_type") == chunk_type)
    for key, value in (metadata or {}).items():
        out = out.where(~F.coalesce(F.map_contains_key("metadata", key), F.lit(False)) | (F.try_element_at("metadata", F.lit(key)) == str(value)))
    return out


def retrieve(chunks: DataFrame, embeddings: DataFrame, index: bm25.Bm25Index, queries: DataFrame, query_vectors: DataFrame, config: RetrieverConfig | None = None) -> DataFrame:
    """query_id, chunk_id, content and the chunk's columns, score, rank, method.

    chunks may be filtered; both sides then see only what is left.  queries: query_id, query; query_vectors: query_id, embedding.
    """
    c = config or RetrieverConfig()
    width = 2 * c.top_k if c.use_hybrid else c.top_k
    own = chunks.select("chunk_id")
    left = vectors.flat_search(embeddings.join(own, "chunk_id", "left_semi"), query_vectors, width, "chunk_id", "embedding", "query_id", "embedding")
    if c.use_hybrid:
        hits = fuse(left, bm25.search(index, queries, width, among=own), c)
    else:
        hits = left
    return rerank(hits, queries, chunks, c)
