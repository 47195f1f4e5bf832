"""The stored corpus: documents, chunks, vectors and postings as Parquet tables under one folder.

Everything is appended under a batch number of its writer's own, and is seen once the batch is committed,
by one row in `commits` that is written last: what a writer that failed has left is never seen, and a retry
takes a new number.  Deleting a document appends a tombstone that hides the document's rows of earlier
batches, so nothing is re-embedded or rewritten, readers are never disturbed, and a document that comes
again is seen again.  compact() writes the visible rows as a new generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.bm25 import ordered

SCHEMAS = {
    "documents": "document_id string, filename string, file_type string, size long, uploaded timestamp, page_count int, chunk_count long, table_count int, metadata map<string,string>, batch long",
    "chunks": "chunk_id string, document_id string, chunk_seq int, content string, chunk_type string, page_number int, metadata map<string,string>, batch long",
    "embeddings": "chunk_id string, document_id string, embedding array<double>, batch long",
    "postings": "chunk_id string, document_id string, token string, tf long, dl long, batch long",
    "lengths": "document_id string, chunks long, words long, batch long",
    "entities": "document_id string, entity_type string, value string, normalized_number double, normalized_ts timestamp_ntz, context string, confidence double, batch long",
    "ingest_log": "path string, document_id string, success boolean, error string, batch long",
    "tombstones": "document_id string, batch long",
    "commits": "batch long",
}


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _path(self, name: str):
        """A Hadoop path below the catalog, and its file system."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def raw(self, name: str) -> DataFrame:
        at, fs = self._path(name)
        if not fs.exists(at):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(self._at(name))

    def committed(self, name: str) -> DataFrame:
        return self.raw(name).join(self.raw("commits").distinct(), "batch", "left_semi").select(*[f.split()[0] for f in _fields(SCHEMAS[name])])

    def table(self, name: str) -> DataFrame:
        """Committed rows that no later tombstone hides."""
        gone = self.committed("tombstones").groupBy("document_id").agg(F.max("batch").alias("gone"))
        return self.committed(name).join(gone, "document_id", "left").where(F.col("gone").isNull() | (F.col("batch") >= F.col("gone"))).drop("gone")

    def claim_batch(self) -> int:
        """A number above all that were claimed, by a file that only one writer can create."""
        folder, fs = self._path("claims")
        fs.mkdirs(folder)
        batch = max([0, *(int(s.getPath().getName()) for s in fs.listStatus(folder))]) + 1
        while not fs.createNewFile(self._path(f"claims/{batch}")[0]):
            batch += 1
        return batch

    def commit(self, batch: int) -> None:
        self.spark.createDataFrame([(batch,)], SCHEMAS["commits"]).coalesce(1).write.mode("append").parquet(self._at("commits"))

    def remove(self, name: str) -> None:
        at, fs = self._path(name)
        fs.delete(at, True)

    def append(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).select(*[f.split()[0] for f in _fields(SCHEMAS[name])]).write.mode("append").parquet(self._at(name))

    def delete_document(self, document_id: str) -> bool:
        """Whether there was such a document."""
        found = not self.table("documents").where(F.col("document_id") == document_id).isEmpty()
        if found:
            batch = self.claim_batch()
            self.append("tombstones", self.spark.createDataFrame([(document_id,)], "document_id string"), batch)
            self.commit(batch)
        return found

    def clear(self) -> None:
        for name, schema in SCHEMAS.items():
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self._at(name))

    def compact(self, path: str) -> Catalog:
        """The visible rows as a catalog of their own in another folder."""
        out = Catalog(self.spark, path)
        for name in ("documents", "chunks", "embeddings", "lengths", "entities"):
            self.table(name).write.mode("overwrite").parquet(out._at(name))
        ordered(self.table("postings")).write.mode("overwrite").parquet(out._at("postings"))
        for name in ("ingest_log", "commits"):
            self.raw(name).write.mode("overwrite").parquet(out._at(name))
        newest = self.raw("commits").agg(F.max("batch")).first()[0]
        if newest:  # numbers go on from here
            at, fs = out._path(f"claims/{newest}")
            fs.mkdirs(at.getParent())
            fs.createNewFile(at)
        return out

    def document(self, document_id: str) -> dict | None:
        r = self.table("documents").where(F.col("document_id") == document_id).first()
        return r.asDict(recursive=True) if r else None

    def stats(self) -> DataFrame:
        """total_documents, total_chunks, total_tables, total_size and the histogram of chunk types: one row."""
        docs = self.table("documents").agg(F.count("*").alias("total_documents"), F.coalesce(F.sum("table_count"), F.lit(0)).alias("total_tables"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
        by = self.table("chunks").groupBy("chunk_type").agg(F.count("*").alias("n"))
        chunks = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_type", "n")))).alias("chunk_types"))
        return docs.crossJoin(chunks)


def _fields(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return out
