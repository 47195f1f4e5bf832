"""BM25: postings as a table, search as a join on tokens.

A posting carries the length of its chunk, so that a search reads the postings of the query's tokens and
nothing else.  Stored postings are ordered by token (see ordered()), and the tokens of a small set of
queries reach the scan as a filter; a larger set is sent to all executors while its checked count is small,
and joins by shuffle beyond.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import tokens

K1, B = 1.5, 0.75
#: Tokens of a query set that become a filter of the scan, and that are sent to every executor.
FILTER_TOKENS, BROADCAST_TOKENS = 1_000, 500_000


@dataclass(frozen=True)
class Bm25Index:
    """postings(chunk_id, token, tf, dl) and corpus(n, avgdl): one row."""

    postings: DataFrame
    corpus: DataFrame


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, keep, dl, token, tf: a row for each different token of a chunk."""
    words = chunks.select(F.col(id_col).alias("chunk_id"), *keep, tokens(F.col(text_col)).alias("words"))
    each = words.select("chunk_id", *keep, F.size("words").cast("long").alias("dl"), F.explode("words").alias("token"))
    return each.groupBy("chunk_id", *keep, "dl", "token").agg(F.count("*").alias("tf"))


def n_tokens(text: Column) -> Column:
    return F.greatest(F.coalesce(F.size(tokens(text)), F.lit(0)), F.lit(0)).cast("long")


def corpus_row(n: Column, total: Column) -> list[Column]:
    return [n.alias("n"), (F.coalesce(total, F.lit(0)) / F.greatest(n, F.lit(1))).alias("avgdl")]


def fit(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> Bm25Index:
    """A pure function of the chunks: refitting never doubles anything.  Chunks without words have no postings, but count."""
    corpus = chunks.agg(*corpus_row(F.count("*"), F.sum(n_tokens(F.col(text_col)))))
    return Bm25Index(postings(chunks, id_col, text_col), corpus)


def ordered(rows: DataFrame) -> DataFrame:
    """Postings as they are stored: ranges of tokens, so that a scan skips row groups; a frequent token spans several."""
    return rows.repartitionByRange("token", "chunk_id").sortWithinPartitions("token", "chunk_id")


def save(index: Bm25Index, path: str) -> None:
    ordered(index.postings).write.mode("overwrite").parquet(f"{path}/postings")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def load(spark, path: str) -> Bm25Index:
    return Bm25Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "corpus")))


def _asked_postings(index: Bm25Index, asked: DataFrame, small: bool) -> DataFrame:
    """The postings of the asked tokens: few of them are a filter of the scan."""
    words = asked.select("token").distinct()
    few = [r.token for r in words.limit(FILTER_TOKENS + 1).collect()]
    if len(few) <= FILTER_TOKENS:
        return index.postings.where(F.col("token").isin(few))
    return index.postings.join(F.broadcast(words) if small else words, "token", "left_semi")


def search(index: Bm25Index, queries: DataFrame, k: int, query_id: str = "query_id", text_col: str = "query", k1: float = K1, b: float = B, among: DataFrame | None = None) -> DataFrame:
    """queries -> query_id, chunk_id, score, rank up to k.  A token that a query repeats counts as often.

    among(chunk_id) restricts the results before ranks are given; document frequencies are those of the whole index.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    small = asked.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    found = _asked_postings(index, asked, small)
    known = asked.join(found.groupBy("token").agg(F.count("*").alias("df")), "token")
    hits = found.join(F.broadcast(known) if small else known, "token")
    if among is not None:
        hits = hits.join(among.select("chunk_id").distinct(), "chunk_id", "left_semi")
    hits = hits.crossJoin(F.broadcast(index.corpus))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.sum(F.col("times") * score).alias("score"))
    return top_k(scored, k)


def top_k(scored: DataFrame, k: int, partition: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Ranks 1 to k by score; scores are told apart to 9 decimals, then by id, so that ranks repeat."""
    order = Window.partitionBy(partition).orderBy(F.round("score", 9).desc(), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
