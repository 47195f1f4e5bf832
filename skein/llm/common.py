"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.ship import ship

#: Java and Python alike: a word is a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch: long texts make large batches, so few of them.
ARROW_ROWS = 1000

#: A table of ids of at most this many rows is sent to every executor (24 bytes a row and its hash: under 50 MB).
BROADCAST_ROWS = 500_000

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one in local mode (tests).

    On a cluster executors would each write to a folder of their own machine, so an unset folder is an error there.
    """
    global _own_dir
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="skein-shared-")
    return f"file://{_own_dir}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared place, removed when the driver ends."""
    path = f"{shared_dir(spark)}/skein-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Spark removes a query's shuffle files as soon as the query has ended; the session's setting comes back after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def spill(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage and survives lost executors.

    Once it is written, the shuffles that made it are gone from disk.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with _shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spilled = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that spill() wrote; nothing that is still to run may read them."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._spilled)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Columns of an operator's own beside docs' row as a struct, so that docs' columns may have any names."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def unpacked(df: DataFrame) -> DataFrame:
    """The rows that packed() put away, with the columns that docs had."""
    return df.select("row.*")


def small_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: the package is there, and batches are short (Spark also ends them at 64 MB)."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def join_by_size(big: DataFrame, ids: DataFrame, on: list[str], n_ids: int, how: str = "inner") -> DataFrame:
    """big joined with ids, which go to all executors only while they number at most BROADCAST_ROWS."""
    return big.join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids, on, how)


def text_key(text: Column) -> Column:
    """64 bits that, with the id, name a row."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(text))


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")
