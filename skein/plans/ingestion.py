"""From files to tables: parse, clean, chunk, extract, embed, append."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import finance
from skein.functions.text import CleaningConfig, clean
from skein.operators import bm25, vectors
from skein.operators import tables as tb
from skein.operators.chunking import ChunkingConfig, create_chunks
from skein.sources import files
from skein.sources.catalog import Catalog


@dataclass(frozen=True)
class IngestConfig:
    cleaning: CleaningConfig = field(default_factory=CleaningConfig)
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    strategy: str = "financial"
    dimensions: int = vectors.HASH_DIMENSIONS
    #: a function from texts to vectors, for a model of one's own
    encode: object = None


def process(parsed: DataFrame, config: IngestConfig | None = None) -> dict[str, DataFrame]:
    """documents, chunks, entities and log of parsed files; nothing is written."""
    c = config or IngestConfig()
    docs = parsed.withColumn("document_id", files.document_id(F.col("filename"), F.col("sha256")))
    good = docs.where("error is null")
    text_docs = good.where(~F.col("file_type").isin("csv", "xlsx"))
    pages = text_docs.select("document_id", "file_type", F.explode("pages").alias("p")).select("document_id", "file_type", F.col("p.number").alias("page"), clean(F.col("p.text"), c.cleaning).alias("text")).where("text != ''")
    paged = pages.withColumn("key", F.concat_ws("\x1f", "document_id", F.col("page").cast("string"), "file_type"))
    made = create_chunks(paged, c.strategy, c.chunking, "key", "text")
    parts = F.split("document_id", "\x1f")
    page = F.when(parts[2] == "pdf", parts[1].cast("int"))
    source = F.when(parts[2] == "docx", "word").otherwise(F.when(parts[2] == "txt", "text").otherwise(parts[2]))
    prose = made.select("chunk_id", parts[0].alias("document_id"), (F.coalesce(parts[1].cast("int"), F.lit(1)) * 100000 + F.col("chunk_seq")).cast("int").alias("chunk_seq"), "content", "chunk_type", page.alias("page_number"), F.map_concat("metadata", F.create_map(F.lit("source_type"), source)).alias("metadata"))

    held = good.where(F.col("file_type").isin("csv", "xlsx")).select("document_id", "file_type", F.explode("tables").alias("t"))
    table_rows = held.select(F.concat_ws("\x1f", "document_id", F.col("t.table_index").cast("string"), "file_type").alias("table_id"), "t.headers", "t.rows", "t.caption", "t.table_index")
    live = tb.live_chunks(table_rows, c.chunking.chunk_size)
    of = F.split("table_id", "\x1f")
    order = F.when(F.col("part") == "schema", 0).otherwise(1)
    metadata = F.map_filter(F.create_map(F.lit("table_id"), F.concat_ws("-", of[0], of[1]), F.lit("type"), F.col("part"), F.lit("source_type"), of[2]), lambda k, v: v.isNotNull())
    from_tables = live.select(F.sha2(F.concat_ws(":", "table_id", "part", F.col("seq").cast("string"), "content"), 256).alias("chunk_id"), of[0].alias("document_id"), (of[1].cast("int") * 100000 + order + F.col("seq")).cast("int").alias("chunk_seq"), "content", F.lit("table").alias("chunk_type"), F.lit(None).cast("int").alias("page_number"), metadata.alias("metadata"))
    summaries = _csv_summaries(table_rows.where(F.split("table_id", "\x1f")[2] == "csv"))
    chunks = prose.unionByName(from_tables).unionByName(summaries)

    joined = chunks.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_seq", "content"))), lambda x: x["content"]), " ").alias("text"))
    entities = joined.select("document_id", F.inline(finance.entities(F.col("text"))))
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    documents = good.join(counts, "document_id", "left").select("document_id", "filename", "file_type", "size", F.col("modified").alias("uploaded"), F.when(F.size("pages") > 0, F.size("pages")).alias("page_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.size("tables").alias("table_count"), "metadata")
    log = docs.select("path", "document_id", F.col("error").isNull().alias("success"), "error")
    return {"documents": documents, "chunks": chunks, "entities": entities, "log": log}


def _csv_summaries(table_rows: DataFrame) -> DataFrame:
    """One chunk a CSV with numeric columns: mean, sum, min and max of each."""
    stats = tb.profiles(tb.cells(table_rows)).where("type = 'numeric'")
    line = F.concat(F.col("header"), F.lit(": "), F.format_string("mean: %.2f, sum: %.2f, min: %.2f, max: %.2f", "mean", "sum", "min", "max"))
    by = stats.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("col_idx", line.alias("l")))).alias("l"))
    content = F.concat_ws("\n", F.lit("Table Summary:"), F.transform("l", lambda x: x["l"]))
    of = F.split("table_id", "\x1f")
    return by.select(F.sha2(F.concat_ws(":", "table_id", F.lit("summary"), content), 256).alias("chunk_id"), of[0].alias("document_id"), F.lit(99_999).alias("chunk_seq"), content.alias("content"), F.lit("metadata").alias("chunk_type"), F.lit(None).cast("int").alias("page_number"), F.create_map(F.lit("type"), F.lit("summary"), F.lit("source_type"), F.lit("csv")).alias("metadata"))


def ingest(catalog: Catalog, scanned: DataFrame, config: IngestConfig | None = None) -> DataFrame:
    """Append scanned files to a catalog and return this batch's log.  A document that is there already is replaced.

    All of it is seen at once, when the batch is committed, or never: after a failure just ingest again.
    """
    c = config or IngestConfig()
    batch = catalog.claim_batch()
    parsed = files.parse(scanned)
    stage = f"staging/{batch}"
    parsed.write.mode("overwrite").parquet(f"{catalog.path}/{stage}")  # files are parsed once for all tables
    made = process(catalog.spark.read.schema(parsed.schema).parquet(f"{catalog.path}/{stage}"), c)
    catalog.append("tombstones", made["documents"].select("document_id").distinct(), batch)  # hides earlier batches only
    catalog.append("chunks", made["chunks"].dropDuplicates(["chunk_id"]), batch)  # a file may lie in a folder twice
    mine = catalog.raw("chunks").where(F.col("batch") == batch)
    embedded = vectors.embed_chunks(mine.select("chunk_id", "content"), dimensions=c.dimensions, encode=c.encode).join(mine.select("chunk_id", "document_id"), "chunk_id")
    catalog.append("embeddings", embedded.withColumn("embedding", F.col("embedding").cast("array<double>")), batch)
    catalog.append("postings", bm25.ordered(bm25.postings(mine, keep=("document_id",))), batch)
    catalog.append("lengths", mine.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(bm25.n_tokens(F.col("content"))).alias("words")), batch)
    catalog.append("entities", made["entities"], batch)
    catalog.append("documents", made["documents"], batch)
    catalog.append("ingest_log", made["log"], batch)
    catalog.commit(batch)
    catalog.remove(stage)
    return catalog.raw("ingest_log").where(F.col("batch") == batch)
