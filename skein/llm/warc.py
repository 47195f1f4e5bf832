"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by page id and payload digest and cut into ranges of range_bytes, by the exact running
total of all records before: the cuts depend on the pages alone, so the same pages give the same files on any
cluster, and however the ids are spread no range holds more than range_bytes and one page's records (where there
would be more than MOST_RANGES, ranges grow instead: the driver holds one key a range).  Each range is a
task of its own.  Each record is a gzip member of its own; a file is closed when its compressed size
reaches roll_bytes, several times a range, or at its range's end.  All
headers are made anew, the record id, date and digests from the record's content, never from a clock.
A payload of at least min_revisit bytes that another record has too is written once, with the smallest
page id; the others become revisit records (identical-payload-digest) that refer to it.

A task writes under a temporary name that holds its own attempt, and reports file, size, digest and
records; the reports are a table that only finished tasks are in.  The manifest is made from it, and only
then are its files given their final names, which can be repeated after a failure; this run's files of lost
or repeated attempts are in no manifest and are removed, another writer's are left alone.  Readers go by the manifest.

Files are reached through pyarrow's file systems by the folder's URI, so any store works that pyarrow
has a file system for.  Tasks hold one record and one compressed buffer of at most roll_bytes.

Edge cases: a null html is an empty payload, a null url an empty target; rows with a null page id come
first and are responses of their own; of rows equal in page id and payload the first in url order is
the response; pages without rows make a manifest without files; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import fresh_path, join_by_size, release, small_batches, spill

#: Of a file, compressed, and of a range, as it is: HTML is packed to about a quarter, so a range gives some files.
ROLL_BYTES, RANGE_BYTES = 4 << 20, 64 << 20
MOST_RANGES = 50_000
#: Bytes of a record's headers, about.
HEADER_BYTES = 500
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "name string, temp string, bytes long, sha1 string, records long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{nth}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, nth: int, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record; nth tells rows of one page id and payload apart."""
    digest = base32_sha1(payload)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, nth)}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _fs(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _write(batches: Iterator[pa.RecordBatch], folder: str, roll_bytes: int, run: str) -> Iterator[pa.RecordBatch]:
    """Records arrive sorted; a file is whole when it is reported."""
    from pyspark import TaskContext

    fs, base = _fs(folder)
    attempt = f"{run}-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
    buffer, records, nth, part = io.BytesIO(), 0, 0, 0
    rows: list[tuple] = []
    last = None
    again = 0

    def close() -> None:
        nonlocal buffer, records, nth
        if records:
            data = buffer.getvalue()
            temp = f"{base}/tmp-{attempt}-{part:06}-{nth:05}.warc.gz"
            with fs.open_output_stream(temp, compression=None) as out:
                out.write(data)
            rows.append((f"part-{part:06}-{nth:05}.warc.gz", temp, len(data), hashlib.sha1(data).hexdigest(), records))
            buffer, records, nth = io.BytesIO(), 0, nth + 1

    for batch in batches:
        for span, page_id, url, html, low in zip(*(batch.column(c).to_pylist() for c in ("span", "page_id", "url", "payload", "low")), strict=True):
            if span != part:
                close()
                part, nth = span, 0
            here = (page_id, base32_sha1(html))
            again = again + 1 if here == last else 0
            last = here
            is_revisit = low is not None and page_id is not None and (low != page_id or again > 0)
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            buffer.write(pack.compress(record_bytes(page_id, url, html, again, low if is_revisit else None, is_revisit)) + pack.flush())
            records += 1
            if buffer.tell() >= roll_bytes:
                close()
    close()
    yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("name", "temp", "bytes", "sha1", "records"))}, schema=pa.schema([("name", pa.string()), ("temp", pa.string()), ("bytes", pa.int64()), ("sha1", pa.string()), ("records", pa.int64())]))


def _publish(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Give the files of the manifest their final names; what was done before a failure is left as it is."""
    from pyarrow.fs import FileType

    fs, base = _fs(folder)
    for batch in batches:
        done = []
        for name, temp, size in zip(*(batch.column(c).to_pylist() for c in ("name", "temp", "bytes")), strict=True):
            final = f"{base}/{name}"
            at = fs.get_file_info(final)
            if at.type == FileType.NotFound or at.size != size:
                fs.move(temp, final)
            done.append(name)
        yield pa.RecordBatch.from_pydict({"name": done})


def _key(page_id: Column, digest: Column) -> Column:
    """What ranges are cut by; rows without an id come first."""
    return F.struct(F.coalesce(page_id, F.lit(-(2**63))).alias("p"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("d"))


def _cuts(digests: DataFrame, range_bytes: int) -> list[tuple[int, int]]:
    """The first key of each range but the first."""
    keyed = digests.groupBy(_key(F.col("page_id"), F.col("digest")).alias("key")).agg(F.sum(F.col("n") + HEADER_BYTES).alias("bytes"))
    # sorted pieces, the totals of those before, and the running total within each
    pieces = spill(keyed.repartitionByRange("key").select("key", "bytes", F.spark_partition_id().alias("piece")), "keys")
    before, total = {}, 0
    for r in pieces.groupBy("piece").agg(F.sum("bytes").alias("bytes"), F.min("key").alias("low")).orderBy("low").collect():
        before[r.piece] = total
        total += r.bytes
    range_bytes = max(range_bytes, math.ceil(total / MOST_RANGES))
    starts = digests.sparkSession.createDataFrame(list(before.items()), "piece int, before long")
    within = F.sum("bytes").over(Window.partitionBy("piece").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    at = F.col("before") + F.coalesce("within", F.lit(0))
    ranges = pieces.withColumn("within", within).join(F.broadcast(starts), "piece").groupBy(F.floor(at / range_bytes).alias("span")).agg(F.min("key").alias("low"))
    firsts = sorted((r.low.p, r.low.d) for r in ranges.collect())  # MOST_RANGES at most
    release(pieces)
    return firsts[1:]


def _span(key: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many cuts are not above a key, by halving; the cuts are one constant of the plan."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([{"p": p, "d": d} for p, d in cuts])), "array<struct<p:bigint,d:bigint>>")
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

    def halve(s, _):
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = (s["low"] < s["high"]) & (F.get(table, mid) <= key)
        return F.struct(F.when(below, mid + 1).otherwise(s["low"]).alias("low"), F.when(below | (s["low"] >= s["high"]), s["high"]).otherwise(mid).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), start, halve)["low"]


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write the archives and return their manifest, which is also kept as a table in folder/manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    # the smallest id of each payload that occurs again: digests only, the payloads stay where they are
    digests = spill(rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")), "digests")
    again = digests.where(F.col("page_id").isNotNull() & (F.col("n") >= min_revisit)).groupBy("digest").agg(F.min("page_id").alias("low"), F.count("*").alias("m")).where("m > 1").select("digest", "low")
    again = spill(again, "payloads")
    cuts = _cuts(digests, range_bytes)
    release(digests)
    marked = join_by_size(rows.withColumn("digest", F.sha1("payload")), again, ["digest"], again.count(), "left")
    spanned = marked.withColumn("span", _span(_key(F.col("page_id"), F.col("digest")), cuts).cast("int"))
    dealt = spanned.repartitionById(len(cuts) + 1, F.col("span"))
    ordered = dealt.sortWithinPartitions("span", "page_id", "digest", "url").select("span", "page_id", "url", "payload", "low")
    run = uuid.uuid4().hex
    manifest = ordered.mapInArrow(functools.partial(_write, folder=folder, roll_bytes=roll_bytes, run=run), MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    spill(manifest.mapInArrow(functools.partial(_publish, folder=folder), "name string"), "published")
    from pyarrow.fs import FileSelector, FileType

    for info in fs.get_file_info(FileSelector(base)):  # of this run's attempts that are in no manifest
        if info.type == FileType.File and info.base_name.startswith(f"tmp-{run}-"):
            fs.delete_file(info.path)
    return manifest


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open .warc.gz stream, read piece by piece."""
    pack, data = zlib.decompressobj(31), b""
    ended = False

    def more() -> bool:
        nonlocal pack, data, ended
        while not ended:
            raw = pack.unused_data or stream.read(1 << 16)  # small: what follows a member is copied with each
            if pack.eof:
                pack = zlib.decompressobj(31)
            if not raw:
                ended = True
                return False
            if out := pack.decompress(raw):
                data += out
                return True
        return False

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more():
                if data.strip():
                    raise ValueError("a record is cut short")
                return
        first, *lines = data[:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:40]}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        size = int(head["Content-Length"])
        while len(data) < end + 4 + size + 4:
            if not more():
                raise ValueError("a record is cut short")
        yield head, data[end + 4 : end + 4 + size]
        data = data[end + 8 + size :]


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_block: bool) -> Iterator[pa.RecordBatch]:
    fs, base = _fs(folder)
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    for batch in batches:
        for name in batch.column("name").to_pylist():
            rows: list[tuple] = []
            with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                for head, block in parse_records(f):
                    if head["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"{name}: a block does not have its digest")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"{name}: a payload does not have its digest")
                    page, refers = (int(v) if (v := head.get(k)) else None for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
                    rows.append((page, head["WARC-Target-URI"], size, digest, head["WARC-Type"], refers, payload if with_block else None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=schema)
                        rows = []
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=schema)


def read_warc(manifest: DataFrame, folder: str, with_block: bool = True) -> DataFrame:
    """The records of a manifest's files; block holds the payload of responses.  Digests are checked."""
    small_batches(manifest.sparkSession)
    spread = manifest.select("name").repartition(max(1, min(manifest.count(), 2000)), "name")
    return spread.mapInArrow(functools.partial(_read, folder=folder, with_block=with_block), RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write pages as archives and read them back: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder, **options), folder, with_block=False).drop("block")
