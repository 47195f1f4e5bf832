from __future__ import annotations

import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest

from skein.llm import warc


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, low string, payload int")


ROWS = [(5, "http://a/5", "<p>same é</p>"), (3, "http://a/3\r\nX: y", "<p>same é</p>"), (9, None, "<p>same é</p>"), (1, "http://a/1", "other"), (2, "u", None), (4, "u", ""), (7, "u", "r\r\n\r\nWARC/1.1\r\n\r\n" * 5), (8, "u", "long " * 300_000)]


def brute(rows, least=0):
    by = defaultdict(list)
    for i, _, h in rows:
        by[h or ""].append(i)
    out = {}
    for i, _, h in rows:
        b = (h or "").encode()
        low = min(by[h or ""])
        r = len(b) >= least and i != low
        out[i] = (len(b), warc.base32_sha1(b), "revisit" if r else "response", low if r else None)
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(frame(spark, ROWS), folder, min_revisit=least, roll_bytes=2000, range_bytes=1500)
    got = {r.page_id: r for r in warc.read_warc(manifest, folder).collect()}
    assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()} == brute(ROWS, least)
    for i, _, h in ROWS:
        assert got[i].block == ((h or "").encode() if got[i].record_type == "response" else b"")
    files = sorted(p for p in Path(f"{tmp_path}/w").iterdir() if p.suffix == ".gz")
    assert [p.name for p in files] == sorted(r.name for r in manifest.collect())
    for r in manifest.collect():
        data = Path(f"{tmp_path}/w/{r.name}").read_bytes()
        assert len(data) == r.bytes and hashlib.sha1(data).hexdigest() == r.sha1
        assert gzip.decompress(data).count(b"\r\nWARC-Record-ID: ") == r.records


def test_same_pages_same_files(spark, tmp_path):
    out = []
    for k, df in enumerate([frame(spark, ROWS), frame(spark, ROWS[::-1])]):
        warc.write_warc(df, f"file://{tmp_path}/{k}", range_bytes=1000)
        out.append({p.name: p.read_bytes() for p in Path(f"{tmp_path}/{k}").iterdir() if p.suffix == ".gz"})
    assert out[0] == out[1]


def test_ranges_hold_what_they_should_with_an_outlier_and_one_hot_id(spark):
    rows = [(i, "u", f"{i}" * 50) for i in range(300)] + [(2**62, "u", "far away")] + [(7, "u", f"hot {i} " * 10) for i in range(300)] + [(None, "u", f"null {i}") for i in range(50)]
    digests = frame(spark, rows).selectExpr("page_id", "sha1(html) as digest", "octet_length(html) as n")
    cuts = warc._cuts(digests, 20_000)
    spans = digests.withColumn("span", warc._span(warc._key(digests.page_id, digests.digest), cuts))
    sizes = [r.b for r in spans.groupBy("span").agg({"n": "sum", "page_id": "count", "digest": "count"}).selectExpr("`sum(n)` + 500 * `count(digest)` as b").collect()]
    assert len(sizes) == len(cuts) + 1 and max(sizes) <= 20_000 + 2000 and len(sizes) >= 15
    keys = sorted((-(2**63) if r.page_id is None else r.page_id, int(r.digest[:15], 16), r.span) for r in spans.collect())
    assert all(s == sum(c <= (p, d) for c in cuts) for p, d, s in keys)


def test_each_range_is_a_task_and_files_roll(spark, tmp_path):
    import random

    rnd = random.Random(3)
    rows = [(i, "u", "".join(rnd.choices("abcdefghij", k=4000))) for i in range(400)]
    proportion = warc.RANGE_BYTES // warc.ROLL_BYTES
    manifest = warc.write_warc(frame(spark, rows), f"file://{tmp_path}/w", roll_bytes=400_000 // proportion, range_bytes=400_000).collect()
    parts = {r.name.split("-")[1] for r in manifest}
    tasks = {Path(r.temp).name.split("-")[2] for r in manifest}
    assert len(parts) == len(tasks) == 5 and len(manifest) >= 3 * len(parts)


def test_empty_nulls_and_repeats(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0
    rows = [(None, "u", "x"), (None, "u", "x"), (1, "a", "y"), (1, "b", "y"), (1, "c", "z"), (2, "d", "y")]
    got = [(r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(0, "response", None)] * 2 + [(1, "response", None), (1, "revisit", 1), (1, "response", None), (2, "revisit", 1)], key=str)


def test_damage_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(frame(spark, ROWS), folder)
    name = manifest.first().name
    data = gzip.decompress(Path(f"{tmp_path}/w/{name}").read_bytes())
    Path(f"{tmp_path}/w/{name}").write_bytes(gzip.compress(data.replace(b"same", b"lame")))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(manifest, folder).collect()


def test_query_equals_brute_force(spark, sf):
    from skein.llm.queries import QUERIES

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op10_warc"](spark, sf).collect()}
    assert got == brute(rows)
