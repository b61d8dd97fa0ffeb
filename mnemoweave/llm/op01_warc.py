"""WARC archives (operator 1): writer and splittable reader.

``write_warc`` lets every attempt of a task write gzip archives of its own, one
member a record, and lists them in its manifest rows; what an attempt that failed
or lost a race has left is listed nowhere.  ``read_warc`` plans byte ranges;
a task scans its range for the gzip magic, accepts a place only if a member
there decodes to a WARC header, and then owns all records that start inside its
range, reading the last one past the end.

Cases: a null payload is empty; a null id gives a record without one, which is
always a response; of several rows with the smallest id of an equal payload all
are responses; a null url is an empty target; control characters in urls are
percent-encoded; files that hold no records, or empty ones, give no rows; an
empty table writes no archive; a payload of any length is one record, read in one
piece; repeated rows give a record each; damaged members are skipped up to the next valid
one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ._common import Scratch, table

MIN_REVISIT_BYTES = 100
MAX_FILE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
#: Most tasks of one read.
MAX_TASKS = 100_000
READ_BYTES = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

MANIFEST = "path string, bytes long, records long"
RECORDS = (
    "path string, start long, record_type string, record_id string, target_uri string, refers_to_id string, "
    "payload_digest string, fields map<string,string>, payload binary"
)


def _open(uri: str):
    """(file system, path) of a local, HDFS or object-store address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# ---- writer -----------------------------------------------------------------

def record_id(key: str, digest: str) -> str:
    h = hashlib.md5(f"{key}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def member(kind: str, target: str, payload: bytes, digest: str, fields: dict[str, str], level: int = 6) -> bytes:
    """One record as a gzip member; a revisit carries the HTTP header alone."""
    http = _HTTP % len(payload)
    block = http if kind == "revisit" else http + payload
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", target)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {safe}", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}",
    ]
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def write_warc(rows: DataFrame, uri: str, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Writes ``rows(id string, url, payload binary, digest, refers_to string)``.

    Returns the manifest, one row a file; running it writes the archives.  Write it
    to a table: its rows are those of the attempts that count, whose files no other
    attempt replaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = _open(uri)
        task = TaskContext.get()
        files.create_dir(base, recursive=True)
        out, n, size, records, done = None, 0, 0, 0, []

        def close():
            nonlocal out, n, size, records
            if out is not None:
                out.close()
                final = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz"
                files.move(temp, final)
                done.append((f"{uri}/{final.rsplit('/', 1)[1]}", size, records))
                out, n, size, records = None, n + 1, 0, 0

        for b in batches:
            for key, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    temp = f"{base}/_part-{task.partitionId():06d}-{n:04d}-{task.taskAttemptId()}"
                    out = files.open_output_stream(temp)
                payload = payload or b""
                fields = {"WARC-Record-ID": record_id(key or f"{task.partitionId()}.{n}.{records}", digest)}
                if key is not None:
                    fields["X-Record-Key"] = key
                if refers is not None:
                    fields["WARC-Refers-To"] = record_id(refers, digest)
                    fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    fields["X-Refers-To-Key"] = refers
                fields["X-Payload-Length"] = str(len(payload))
                data = member("response" if refers is None else "revisit", url or "", payload, digest, fields)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= max_file_bytes:
                    close()
        close()
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
            names=["path", "bytes", "records"],
        )

    # in a fixed order, so that every attempt of a task writes the same bytes
    cols = rows.select("id", "url", F.col("payload").cast("binary"), "digest", "refers_to").sortWithinPartitions("id", "digest", "url")
    return cols.mapInArrow(run, MANIFEST)


# ---- reader -----------------------------------------------------------------

class _Reader:
    """Random access with one block kept, for scanning and inflating."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.block = file, size, 0, b""

    def file_chunk(self, pos: int) -> bytes:
        """Bytes from ``pos`` to the end of the block that holds it."""
        if not self.at <= pos < self.at + len(self.block):
            if pos >= self.size:
                return b""
            self.file.seek(pos)
            self.at, self.block = pos, self.file.read(min(READ_BYTES, self.size - pos))
        return self.block[pos - self.at :] if pos > self.at else self.block


def _inflate(src: _Reader, at: int) -> tuple[bytes, int] | None:
    """(content, next place) of the gzip member at a place that holds a WARC
    record; None if it does not decode to one."""
    d, parts, pos = zlib.decompressobj(31), [], at
    got = 0
    try:
        while not d.eof:
            chunk = src.file_chunk(pos)
            if not chunk:
                return None
            parts.append(d.decompress(chunk))
            pos += len(chunk)
            got += len(parts[-1])
            if got >= 5 and not b"".join(parts[:8])[:5] == b"WARC/":
                return None
    except zlib.error:
        return None
    content = b"".join(parts)
    return (content, pos - len(d.unused_data)) if content[:5] == b"WARC/" else None


def _next_magic(r: _Reader, pos: int, end: int) -> int:
    """The next place in [pos, end) where the gzip magic starts, or -1."""
    while pos < end:
        block = r.file_chunk(pos)
        if not block:
            return -1
        i = block.find(_MAGIC)
        if i >= 0:
            return pos + i if pos + i < end else -1
        step = len(block)
        if pos + step >= r.size:
            return -1
        pos += max(1, step - 2)
        if step <= 2:  # a block's last bytes may begin a magic: read afresh from them
            r.block = b""
    return -1


def parse(content: bytes) -> tuple | None:
    """The columns of a record after (path, start), or None if it is no record."""
    head, sep, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not sep or not fields.get("content-length", "").isdigit():
        return None
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        return None
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    digest = fields.get("warc-payload-digest", "")
    return (
        fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"),
        fields.get("warc-refers-to"), digest.rpartition(":")[2] or None, list(fields.items()), block,
    )


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple]:
    """(start, *columns) of all records that start in [start, end)."""
    r, pos = _Reader(file, size), start
    while 0 <= (pos := _next_magic(r, pos, min(end, size))):
        while pos < end and (got := _inflate(r, pos)) and (row := parse(got[0])):
            yield pos, *row
            pos = got[1]
            if r.file_chunk(pos)[:1] != _MAGIC[:1]:
                break
        else:
            if pos >= end:
                return
            pos += 1


def splits(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    step = F.lit(split_bytes).cast("long")
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step))
    return manifest.where("bytes > 0").select("path", "bytes", ranges.alias("from"))


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the files in ``manifest(path, bytes)``; see ``RECORDS``.

    The manifest, a row a file, is read twice: the ranges are counted first, for
    as many tasks, up to ``MAX_TASKS`` (a task takes several of more).
    """

    schema = to_arrow_schema(_parse_datatype_string(RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                files, name = _open(path)
                rows, held = [], 0
                with files.open_input_file(name) as f:
                    for row in records_in(f, size, start, start + split_bytes):
                        rows.append((path, *row))
                        held += len(row[-1])
                        if held >= 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    # a fixed number of tasks: a list of ranges is so small that adaptive execution would merge all into one
    ranges = splits(manifest, split_bytes)
    tasks = max(1, min(ranges.count(), MAX_TASKS))
    return ranges.repartition(tasks, "path", "from").mapInArrow(run, RECORDS)


# ---- query ------------------------------------------------------------------

def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds ``digest`` and ``refers_to`` to ``pages(page_id, url, payload)``.

    Only payloads that occur more than once reach the joined side, so a very
    common payload is one row there; the pages' side may be split.
    """
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    firsts = (
        pages.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return pages.join(firsts, "digest", "left").withColumn("refers_to", refers).drop("first")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", payload.alias("payload"))
    rows = revisits(pages).select(
        F.col("page_id").cast("string").alias("id"), "url", "payload", "digest", F.col("refers_to").cast("string")
    )
    scratch = Scratch(spark, "op1")
    manifest = scratch.write(write_warc(rows, scratch.path("archives")), "manifest")
    found = read_warc(manifest)
    response = F.col("record_type") == "response"
    return found.select(
        F.col("fields")["x-record-key"].cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("fields")["x-payload-length"]).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("fields")["x-refers-to-key"].cast("long").alias("refers_to"),
        (~response | (F.sha2("payload", 256) == F.col("payload_digest"))).alias("digest_holds"),
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to,
       true AS digest_holds
FROM f
"""
