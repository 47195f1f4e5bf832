"""The engine: the verbs of the service over one catalog folder."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.errors import DocumentProcessingError, FileSizeExceededError, NotFoundError, UnsupportedFileTypeError, ValidationError
from skein.operators import bm25, hybrid, vectors
from skein.plans import answering, evaluation, ingestion
from skein.ship import ship
from skein.sources import files
from skein.sources.catalog import Catalog

MAX_QUESTION, MAX_TOP_K = 1000, 50
SOURCES, SOURCE_CHARS, SNIPPET_CHARS = 5, 500, 300


class Engine:
    def __init__(self, spark: SparkSession, path: str, config: ingestion.IngestConfig | None = None, generate: answering.Generator = answering.extractive, retriever: hybrid.RetrieverConfig | None = None):
        ship(spark)
        self.spark, self.catalog, self.config = spark, Catalog(spark, path), config or ingestion.IngestConfig()
        self.generate, self.retriever = answering.with_retries(generate), retriever or hybrid.RetrieverConfig()

    # documents

    def ingest(self, path: str, recursive: bool = True, extensions: tuple[str, ...] | None = None) -> DataFrame:
        """Files of a folder, or one file: the log, a row a file by its whole path."""
        return ingestion.ingest(self.catalog, files.scan(self.spark, path, recursive, extensions), self.config)

    def ingest_file(self, path: str) -> dict:
        kind = path.rpartition(".")[2].lower()
        if kind not in files.UPLOADS:
            raise UnsupportedFileTypeError(f"Unsupported file type: {kind}", supported=files.UPLOADS)
        rows = self.ingest(path).collect()
        if not rows:
            raise DocumentProcessingError(f"File not found: {path}")
        if not rows[0].success:
            raise (FileSizeExceededError if "larger than" in rows[0].error else DocumentProcessingError)(rows[0].error)
        return self.document(rows[0].document_id)

    def ingest_bytes(self, name: str, content: bytes, metadata: str | None = None) -> dict:
        """Bytes are landed in the catalog's folder, then taken in as a file; metadata that is no JSON is ignored."""
        landing = os.path.join(self.catalog.path.removeprefix("file://"), "landing")
        os.makedirs(landing, exist_ok=True)
        at = os.path.join(landing, os.path.basename(name))
        with open(at, "wb") as f:
            f.write(content)
        out = self.ingest_file(at)
        try:
            out["custom_metadata"] = json.loads(metadata or "{}")
        except ValueError:
            out["custom_metadata"] = {}
        return out

    def documents(self) -> DataFrame:
        return self.catalog.table("documents")

    def document(self, document_id: str) -> dict:
        found = self.catalog.document(document_id)
        if found is None:
            raise NotFoundError(f"No document {document_id}")
        return found

    def delete(self, document_id: str) -> None:
        if not self.catalog.delete_document(document_id):
            raise NotFoundError(f"No document {document_id}")

    def clear(self) -> None:
        self.catalog.clear()

    def stats(self) -> dict:
        return self.catalog.stats().first().asDict()

    def health(self) -> dict:
        return {"status": "healthy", "spark": self.spark.version, "embedding": "model" if self.config.encode else f"hashed-{self.config.dimensions}"}

    # questions

    def corpus(self) -> answering.Corpus:
        """What was stored at ingestion; nothing is fitted for a question."""
        chunks = self.catalog.table("chunks")
        embeddings = self.catalog.table("embeddings").select("chunk_id", "embedding")
        embed = lambda q: vectors.embed_chunks(q, "query_id", "query", self.config.dimensions, self.config.encode).withColumnRenamed("chunk_id", "query_id")
        corpus = self.catalog.table("lengths").agg(*bm25.corpus_row(F.coalesce(F.sum("chunks"), F.lit(0)), F.sum("words")))
        index = bm25.Bm25Index(self.catalog.table("postings").select("chunk_id", "token", "tf", "dl"), corpus)
        return answering.Corpus(chunks, embeddings, index, embed)

    def _asked(self, question: str, top_k: int) -> DataFrame:
        if not 1 <= len(question) <= MAX_QUESTION:
            raise ValidationError(f"A question has 1 to {MAX_QUESTION} characters")
        if not 1 <= top_k <= MAX_TOP_K:
            raise ValidationError(f"top_k is from 1 to {MAX_TOP_K}")
        return self.spark.createDataFrame([("q", question)], "query_id string, query string")

    def query(self, question: str, top_k: int = 10, document_ids: list[str] | None = None) -> dict:
        began = time.time()
        config = hybrid.RetrieverConfig(**(self.retriever.__dict__ | {"top_k": top_k}))
        r = answering.prepared(self.corpus(), self._asked(question, top_k), config, document_ids).first()
        a = r.analysis
        if not a.requires_search:
            answer = a.direct_response
        elif not r.context:
            answer = answering.NO_CONTEXT.replace("{query}", question)
        else:
            answer = self.generate(question, r.context, r.prompt).strip()
        sources = [] if not a.requires_search else [s.asDict() for s in (r.sources or [])[:SOURCES]]
        return {"answer": answer, "confidence": r.confidence, "sources": sources, "query_type": a.query_type, "response_format": a.response_format, "token_usage": {"prompt_tokens": 0, "completion_tokens": len(answer) // 4}, "processing_time": time.time() - began}

    def query_stream(self, question: str, **options) -> Iterator[str]:
        yield from answering.stream(self.query(question, **options)["answer"])

    def search(self, question: str, top_k: int = 10, document_ids: list[str] | None = None, chunk_type: str | None = None) -> list[dict]:
        """Vector search alone, with the first characters of each chunk."""
        corpus, asked = self.corpus(), self._asked(question, top_k)
        chunks = hybrid.filter_chunks(corpus.chunks, document_ids, chunk_type)
        hits = vectors.flat_search(corpus.embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), corpus.embed(asked), top_k, "chunk_id", "embedding", "query_id", "embedding")
        rows = hits.join(chunks, "chunk_id").orderBy("rank").collect()
        return [{"chunk_id": r.chunk_id, "document_id": r.document_id, "score": r.score, "rank": r["rank"], "content": r.content if len(r.content) <= SNIPPET_CHARS else r.content[:SNIPPET_CHARS] + "..."} for r in rows]

    def evaluate(self, cases: evaluation.EvaluationSet) -> tuple[DataFrame, DataFrame]:
        """(scores, report) of a case set asked of this engine."""

        def answer(question: str) -> dict:
            got = self.query(question)
            return {"generated": got["answer"], "chunk_ids": [s["chunk_id"] for s in got["sources"]], "chunks": [s["content"] for s in got["sources"]]}

        scores = evaluation.evaluate(evaluation.result_frame(self.spark, evaluation.run_cases(cases, answer)))
        return scores, evaluation.report(scores)

    def chunk(self, chunk_id: str) -> dict | None:
        r = self.catalog.table("chunks").where(F.col("chunk_id") == chunk_id).first()
        return r.asDict() if r else None
