"""From questions to answers: analysis, retrieval, a context within a budget, generation, confidence.

A batch of questions is one plan; retrieval runs once a question, and only for those that need documents.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.errors import GenerationError, RateLimitError
from skein.functions import finance, understanding
from skein.functions.text import tokens
from skein.operators import bm25, hybrid

CONTEXT_CHARS = 8000
SEPARATOR = "\n\n---\n\n"
NO_CONTEXT = 'The documents hold nothing about: "{query}". Load documents first, or ask about another figure or period.'

#: Our own prompts; {context} and {query} are filled in by replacement, other braces stay.
PROMPTS = {
    "default": "Answer from the context alone.\n\nContext:\n{context}\n\nQuestion: {query}\nAnswer:",
    "factual": "Give the figure or fact asked for, from the context alone, with its period and unit.\n\nContext:\n{context}\n\nQuestion: {query}\nAnswer:",
    "comparison": "Compare what is asked, in a table if there are several figures, from the context alone.\n\nContext:\n{context}\n\nQuestion: {query}\nAnswer:",
    "trend": "Describe how the figures move over the periods in the context.\n\nContext:\n{context}\n\nQuestion: {query}\nAnswer:",
    "aggregation": "Total or average what is asked and show the parts, from the context alone.\n\nContext:\n{context}\n\nQuestion: {query}\nAnswer:",
    "list": "List every item as {n}. item, from the context alone.\n\nContext:\n{context}\n\nQuestion: {query}\nAnswer:",
    "explanation": "Explain the reasons that the context gives.\n\nContext:\n{context}\n\nQuestion: {query}\nAnswer:",
    "yes_no": "Answer yes or no first, then why, from the context alone.\n\nContext:\n{context}\n\nQuestion: {query}\nAnswer:",
    "summary": "Summarise the context in a few points.\n\nContext:\n{context}\n\nQuestion: {query}\nAnswer:",
}


def process_queries(queries: DataFrame) -> DataFrame:
    """queries(query_id, query) with analysis, engine_intent, expanded, entities, hints."""
    df = queries.withColumn("analysis", understanding.analysis(F.col("query"))).withColumn("engine_intent", understanding.engine_intent(F.col("query")))
    df = df.withColumn("expanded", understanding.expanded(F.col("query"), F.col("engine_intent"))).withColumn("entities", finance.entities(F.col("query")))
    return df.withColumn("hints", understanding.filter_hints(F.col("query"), F.exists("entities", lambda e: e["entity_type"] == "date")))


def formatted(document_id: Column, page: Column, sheet: Column, content: Column) -> Column:
    """[Document: 8 characters... | Page: n | Sheet: s] and the content; [Source] if none is known."""
    head = F.concat_ws(" | ", F.concat(F.lit("Document: "), F.left(document_id.cast("string"), F.lit(8)), F.lit("...")), F.concat(F.lit("Page: "), page.cast("string")), F.concat(F.lit("Sheet: "), sheet))
    return F.concat(F.lit("["), F.when(head == "", "Source").otherwise(head), F.lit("]\n"), content)


def contexts(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """hits(query_id, rank, document_id, page_number, metadata, content) -> query_id, context, used.

    Chunks in rank order while their total length is within the budget.
    """
    part = formatted(F.col("document_id"), F.col("page_number"), F.try_element_at("metadata", F.lit("sheet_name")), F.col("content"))
    running = F.sum(F.length("part")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    fit = hits.withColumn("part", part).withColumn("running", running).where(F.col("running") <= budget)
    return fit.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), SEPARATOR).alias("context"), F.count("*").alias("used"))


def confidence(scores: Column, query_type: Column) -> Column:
    """The mean of the first five scores; more for good facts, less for explanations; 0 to 1."""
    top = F.slice(scores, 1, 5)
    mean = F.try_divide(F.aggregate(top, F.lit(0.0), lambda s, x: s + x), F.size(top))
    mean = F.when((query_type == "factual") & (mean > 0.7), F.least(mean * 1.1, F.lit(1.0))).when(query_type == "explanation", mean * 0.9).otherwise(mean)
    return F.when(F.size(scores) > 0, F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def prompt(query_type: Column, context: Column, query: Column) -> Column:
    template = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PROMPTS.items() for x in kv]), query_type), F.lit(PROMPTS["default"]))
    return F.replace(F.replace(template, F.lit("{query}"), query), F.lit("{context}"), context)


def post_processed(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(answer, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def extractive(query: str, context: str, _prompt: str) -> str:
    """The generator that needs no model: the sentences of the context that share most words with the question."""
    import re

    asked = set(re.findall(r"\w+", query.lower()))
    sentences = [s for block in context.split(SEPARATOR) for s in re.split(r"(?<=[.!?])\s+|\n", block.partition("]\n")[2]) if s.strip()]
    best = sorted(range(len(sentences)), key=lambda i: (-len(asked & set(re.findall(r"\w+", sentences[i].lower()))), i))[:3]
    return " ".join(sentences[i].strip() for i in sorted(best))


Generator = Callable[[str, str, str], str]


def with_retries(generate: Generator, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> Generator:
    """Three tries: 30, 60 and 90 seconds after a rate limit, 5 after other failures."""

    def run(query: str, context: str, text: str) -> str:
        for n in range(1, tries + 1):
            try:
                return generate(query, context, text)
            except Exception as e:  # noqa: BLE001
                limited = isinstance(e, RateLimitError) or "429" in str(e) or "ResourceExhausted" in str(e)
                if n == tries:
                    raise GenerationError(f"generation failed after {tries} tries: {e}") from e
                wait(30.0 * n if limited else 5.0)
        raise AssertionError

    return run


def stream(answer: str, size: int = 20) -> Iterator[str]:
    """An answer in pieces, as a client shows it while it comes."""
    for i in range(0, len(answer), size):
        yield answer[i : i + size]


@dataclass(frozen=True)
class Corpus:
    chunks: DataFrame
    embeddings: DataFrame
    index: bm25.Bm25Index
    #: from a frame (query_id, query) to (query_id, embedding)
    embed: Callable[[DataFrame], DataFrame]


def retrieve(corpus: Corpus, queries: DataFrame, config: hybrid.RetrieverConfig | None = None, document_ids: list[str] | None = None, chunk_type: str | None = None) -> DataFrame:
    """queries(query_id, query): the chunks of each, ranked, with content and metadata."""
    chunks = hybrid.filter_chunks(corpus.chunks, document_ids, chunk_type)
    return hybrid.retrieve(chunks, corpus.embeddings, corpus.index, queries, corpus.embed(queries), config)


def prepared(corpus: Corpus, queries: DataFrame, config: hybrid.RetrieverConfig | None = None, document_ids: list[str] | None = None, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Everything a generator needs: query_id, query, analysis, context, prompt, sources, confidence."""
    asked = process_queries(queries)
    search = asked.where("analysis.requires_search").select("query_id", F.col("expanded").alias("query"))
    hits = retrieve(corpus, search, config, document_ids)
    sources = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "document_id", "score", F.left("content", F.lit(500)).alias("content")))).alias("sources"))
    df = asked.join(contexts(hits, budget), "query_id", "left").join(sources, "query_id", "left")
    kind = F.col("analysis.query_type")
    scores = F.transform(F.coalesce("sources", F.array().cast("array<struct<rank:int,chunk_id:string,document_id:string,score:double,content:string>>")), lambda s: s["score"])
    sure = F.when(F.col("analysis.requires_search"), confidence(scores, kind)).otherwise(F.lit(1.0))
    return df.select("query_id", "query", "analysis", "context", prompt(kind, F.coalesce("context", F.lit("")), F.col("query")).alias("prompt"), "sources", sure.alias("confidence"))


def n_words(text: Column) -> Column:
    return F.size(tokens(text))
