"""WARC archives: write pages as records, read them back sequentially.

Writing: each Spark task writes its rows to archives of its own in the shared
folder, one gzip member per record, and starts a new archive beyond
ARCHIVE_BYTES.  Names carry the task attempt, and only archives named in the
written manifest are read, so a task that is run again does no harm.  Of rows
with equal payloads of at least REVISIT_BYTES, the one with the largest page
id is written as a response, the others as revisit records that refer to it
and hold the HTTP header alone.

Reading: one task per archive follows it from front to end with an
incremental zlib decoder (a member ends a record), frames the block by
Content-Length and checks block and payload digests.  A record is in memory
at a time, the archive never.

The archives are opened with Arrow's file systems, so the shared folder has to
be one they know (local or mounted paths, hdfs, s3, gs).

Defined cases: a null html is an empty payload; a null url is written as
``urn:none``; a null page_id gives a response with a null id that nothing
refers to; rows that repeat the largest page_id of their payload are all
responses; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from aerolens.llm.common import materialise, prepare, scratch, small, table

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 16
LEVEL = 4
ID = "urn:aerolens:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST_SCHEMA = "path string, records bigint, bytes bigint"
RECORD_SCHEMA = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
                 "payload_digest string, verified boolean, payload binary")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, uncompressed."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if kind == "response" else b"")
    name = lambda i: f"<{ID}{'none' if i is None else i}>"
    uri = urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url is not None else "urn:none"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())),
            ("WARC-Payload-Digest", _b32(hashlib.sha1(payload).digest()))]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    head.append(("Content-Length", str(len(block))))
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def _info(date: str) -> bytes:
    body = b"software: aerolens\r\nformat: WARC File Format 1.1\r\n"
    return (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:aerolens:info>\r\nWARC-Date: {date}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder``; the manifest (path, records, bytes)."""
    prepare(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload")})
    groups = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max("page_id").alias("largest"), F.min("page_id").alias("least")).where("least < largest").select("digest", "largest")
    groups = materialise(groups, "warc-groups")
    rows = rows.join(small(groups, groups.count()), "digest", "left")
    refers = F.when((F.col("bytes") >= REVISIT_BYTES) & (F.col("page_id") < F.col("largest")), F.col("largest"))
    date = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _opened(folder)
        fs.create_dir(base, recursive=True)
        out, path, n, size, k = None, "", 0, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([n]), pa.array([size])], ["path", "records", "bytes"])

        for b in batches:
            for page, url, data, ref in zip(*b.columns):
                if out is None:
                    path = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{k:05d}.warc.gz"
                    out, n, size, k = fs.open_output_stream(f"{base}/{path}", compression=None), 0, 0, k + 1
                    size += out.write(gzip.compress(_info(date), LEVEL))
                to = ref.as_py()
                whole = record("response" if to is None else "revisit", page.as_py(), url.as_py(), data.as_py(), to, date)
                size += out.write(gzip.compress(whole, LEVEL))
                n += 1
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return materialise(rows.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(write, MANIFEST_SCHEMA), "warc-manifest")


class _Members:
    """Reads a stream of gzip members; ``read`` and ``line`` stay within the current member."""

    def __init__(self, stream):
        self.stream, self.raw, self.buf, self.dec = stream, b"", b"", None

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        self.dec, self.buf = zlib.decompressobj(31), b""
        return bool(self.raw)

    def _more(self) -> bool:
        """Decode some more of the member; False at its end."""
        while not self.dec.eof:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    raise ValueError("archive ends within a record")
            got = self.dec.decompress(self.raw, CHUNK)
            self.raw = self.dec.unused_data if self.dec.eof else self.dec.unconsumed_tail
            if got:
                self.buf += got
                return True
        return False

    def line(self) -> bytes:
        while (at := self.buf.find(b"\r\n")) < 0:
            if not self._more():
                raise ValueError("record ends within its header")
        out, self.buf = self.buf[:at], self.buf[at + 2:]
        return out

    def read(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buf and not self._more():
                raise ValueError("record is shorter than its Content-Length")
            part, self.buf = self.buf[:n], self.buf[n:]
            n -= len(part)
            yield part

    def ends(self) -> bool:
        """Whether exactly the closing line ends are left."""
        while self._more():
            pass
        return self.buf == b"\r\n\r\n"


def read_records(stream) -> Iterator[dict]:
    """The records of one archive in order; ValueError where the framing is broken."""
    m = _Members(stream)
    while m.next_member():
        if not m.line().startswith(b"WARC/"):
            raise ValueError("no WARC record at the start of a member")
        head: dict[str, str] = {}
        while line := m.line():
            key, _, value = line.decode("utf-8").partition(":")
            head[key.strip().lower()] = value.strip()
        block_hash, parts = hashlib.sha1(), []
        for part in m.read(int(head["content-length"])):
            block_hash.update(part)
            parts.append(part)
        if not m.ends():
            raise ValueError("record is longer than its Content-Length")
        block = b"".join(parts)
        ok = head.get("warc-block-digest", _b32(block_hash.digest())) == _b32(block_hash.digest())
        if head["warc-type"] in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:]))
            claimed = head.get("warc-payload-digest", "")
            if head["warc-type"] == "response":
                ok = ok and claimed == _b32(hashlib.sha1(payload).digest()) and int(fields.get("content-length", -1)) == len(payload)
            page = lambda k: int(x) if (x := head.get(k, "").strip("<>").removeprefix(ID)).lstrip("-").isdigit() else None
            yield {"page_id": page("warc-record-id"), "url": urllib.parse.unquote(head["warc-target-uri"]), "record_type": head["warc-type"],
                   "refers_to": page("warc-refers-to"), "payload_bytes": int(fields["content-length"]),
                   "payload_digest": base64.b32decode(claimed.removeprefix("sha1:")).hex(), "verified": ok,
                   "payload": payload if head["warc-type"] == "response" else None}


def read_warc(manifest: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """The response and revisit records of the archives that ``manifest(path)`` names; see RECORD_SCHEMA.

    ``strict``: a record whose digests don't match fails the job; otherwise
    its row has verified = false.  Broken framing always fails.
    """
    prepare(manifest.sparkSession)
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = _opened(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream):
                        if strict and not r["verified"]:
                            raise ValueError(f"digest mismatch at page {r['page_id']} of {path}")
                        held += len(r["payload"] or b"") if payloads else 100
                        rows.append(r if payloads else r | {"payload": None})
                        if held > 1 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    spark = manifest.sparkSession
    tasks = max(1, min(manifest.count(), 100_000))
    return manifest.select("path").repartition(tasks).mapInArrow(read, RECORD_SCHEMA).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_warc(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, cast(octet_length(b) as bigint) as payload_bytes, sha1(b) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as largest from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id < largest then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < largest then largest end as refers_to
from m
"""
