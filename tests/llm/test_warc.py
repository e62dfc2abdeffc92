"""op2: round trip through archives, digests, framing errors."""

from __future__ import annotations

import gzip
import hashlib
import io
import os

import pytest

from aerolens.llm import op2_warc as wc
from aerolens.llm.common import scratch

BIG = "<html>" + "é" * 1200 + "</html>"
ROWS = [(1, "http://a/1?q=ü", BIG), (2, "http://a/2\r\nX: y", BIG), (3, None, None), (4, "http://a/4", ""), (5, "u", "short"), (6, "u", "short"),
        (None, "u", BIG), (7, "u", BIG), (7, "u", BIG), (8, "u", "x" * 1000), (9, "u", "x" * 1000), (10, "u", "y" * 300_000), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in ROWS], "page_id bigint, url string, html string, record_type string").repartition(3)


def expected():
    out = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        same = [j for j, _, g in ROWS if (g or "") == (h or "") and j is not None]
        revisit = len(b) >= 1000 and i is not None and i < max(same)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, pages):
    manifest = wc.write_warc(pages, scratch(spark, "warc-test"), archive_bytes=500)
    assert manifest.count() > 3                             # archives roll over
    got = wc.read_warc(manifest)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected()
    by = {r["page_id"]: r for r in got.collect()}
    assert all(r["verified"] for r in by.values())
    assert by[1]["url"] == ROWS[0][1] and by[2]["url"] == ROWS[1][1] and bytes(by[10]["payload"]) == b"y" * 300_000
    assert by[1]["payload"] is None and bytes(by[7]["payload"]).decode() == BIG and by[3]["url"] == "urn:none"


def test_one_member_per_record(spark, pages):
    manifest = wc.write_warc(pages.coalesce(1), scratch(spark, "warc-test"))
    row = manifest.first()
    path = row["path"].removeprefix("file://").removeprefix("file:")
    data, members = open(path, "rb").read(), 0
    import zlib
    while data:
        d = zlib.decompressobj(31)
        text = d.decompress(data)
        assert d.eof and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and text.count(b"WARC-Record-ID") == 1
        data, members = d.unused_data, members + 1
    assert members == row["records"] + 1 == len(ROWS) + 1 and os.path.getsize(path) == row["bytes"]


def whole(*records):
    return io.BytesIO(b"".join(gzip.compress(r) for r in records))


def test_damage_is_found():
    good = wc.record("response", 1, "http://a", b"payload", None, "2024-01-01T00:00:00Z")
    assert [r["verified"] for r in wc.read_records(whole(good, good))] == [True, True]
    assert [r["verified"] for r in wc.read_records(whole(good.replace(b"payload", b"paXload")))] == [False]
    for bad in (whole(good[:-6]), whole(good + b"x"), io.BytesIO(gzip.compress(good)[:-9]), whole(b"no record")):
        with pytest.raises(ValueError):
            list(wc.read_records(bad))


def test_strict_reading_fails_on_a_digest(spark, tmp_path):
    bad = wc.record("response", 1, "u", b"payload", None, "2024-01-01T00:00:00Z").replace(b"payload", b"paXload")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(bad))
    manifest = spark.createDataFrame([(str(tmp_path / "x.warc.gz"),)], "path string")
    assert [r["verified"] for r in wc.read_warc(manifest, strict=False).collect()] == [False]
    with pytest.raises(Exception, match="digest mismatch"):
        wc.read_warc(manifest).collect()


def test_empty_table(spark, pages):
    assert wc.read_warc(wc.write_warc(pages.limit(0), scratch(spark, "warc-test"))).collect() == []
