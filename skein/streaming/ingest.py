"""Streaming ingestion: a landing folder read as a stream of files, appended batch by batch."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from skein.plans.ingestion import IngestConfig, ingest
from skein.sources import files
from skein.sources.catalog import Catalog


def watch(catalog: Catalog, folder: str, checkpoint: str, config: IngestConfig | None = None, available_now: bool = True, max_files: int = 1000) -> StreamingQuery:
    """Ingest new files of folder: those that are there now, or as they come.

    A file is appended under an id made of its name and content.  A batch that is repeated after a failure
    replaces what it had committed; what it had not is never seen.
    """
    stream = files.scan(catalog.spark, folder, stream=True, max_files=max_files)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: ingest(catalog, batch, config) and None)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
