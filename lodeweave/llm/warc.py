"""WARC archives: writing, a normaliser of monolithic gzip files, and reading by offset.

``write`` packs records into archives that are one gzip stream each, as naive crawlers leave them.
``normalise`` inflates such a file once as a stream, rewrites each record as a gzip member of its own
and writes a sidecar index (record's number, type, id, offset, length); readers can then seek.
``read`` takes records back by that index.

Archives lie in the folder that all machines share (spark.checkpoint.dir unless given), opened through
pyarrow's file systems, whatever the scheme. A file is written under a name of its task attempt, and only
names that a committed table lists are ever read: a lost executor or a second attempt leaves at
most files that nobody reads. No file is larger than ``ARCHIVE_BYTES`` and one record (inflated); a
worker holds one record at a time.

Of records with equal payloads of ``REVISIT_BYTES`` or more, the one with the smallest id is the
response and the others are revisits that refer to it and hold no payload. A payload's first id is
found by an aggregation that is summed map-side. Digests that occur twice are stored, and broadcast while they
are few, so that payloads stay where they were read; beyond that they are joined by a shuffle.

Cases: a null payload is an empty one; an empty payload gives a record without a body; repeated ids
stay records of their own: rows with the smallest id of a payload are all responses, so no row refers to
its own id; a null id comes last, and is told apart from any text by a header of its own; ids and urls are
percent-encoded where they hold control characters, ``%``, ``<`` or ``>``; an empty table gives no archive.
Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm._store import arrow, bounded, drop_path, forget, new_path, stored

ARCHIVE_BYTES = 64 << 20
REVISIT_BYTES = 100
LEVEL = 3
_CHUNK = 1 << 20
_INDEX = "path string, record int, record_type string, record_id string, offset bigint, length bigint"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


_UNSAFE = re.compile(r"[\x00-\x1f\x7f%<>]")


def coded(text: str) -> str:
    """A header's value: no character of it ends the line, or the brackets around an id."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", text)


def decoded(text: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text)


def record(kind: str, key: str | None, url: str, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record with its two closing line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'none' if key is None else 'id:' + coded(key)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {coded(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else 'id:' + coded(refers_to)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def stream_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of each record in a stream of inflated bytes."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while (end := held.find(b"\r\n\r\n")) >= 0:
            head = headers(bytes(held[:end]))
            size = end + 4 + int(head["content-length"]) + 4
            if len(held) < size:
                break
            yield head, bytes(held[:size])
            del held[:size]
    if held:
        raise ValueError("the archive ends within a record")


def inflate(source, chunk: int = _CHUNK) -> Iterator[bytes]:
    """Pieces of a gzip file, of one member or of many, read once from the start."""
    z = zlib.decompressobj(31)
    while data := source.read(chunk):
        while data:
            piece = z.decompress(data, _CHUNK * 4)
            if piece:
                yield piece
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
    while not z.eof and (piece := z.decompress(z.unconsumed_tail, _CHUNK * 4)):
        yield piece


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(key, url, payload, digest, size, record_type, refers_to) of each row; ``forget`` deletes the table of digests that it reads."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("string").alias("key"), F.col(page_id).alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload").cast("bigint"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"))
    big = F.col("size") >= REVISIT_BYTES
    first = rows.where(big).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("twice"), "first")
    repeated = stored(first, "warc-repeated")
    # should the digests be too many to broadcast, payloads that can't match are spread by their ids instead of meeting in one task
    joined = rows.join(bounded(repeated), F.when(big, F.col("digest")).otherwise(F.concat(F.lit("small "), F.coalesce("key", F.lit("")))) == F.col("twice"), "left")
    again = big & F.col("first").isNotNull() & ~order.eqNullSafe(F.col("first"))
    out = joined.select("key", "url", "payload", "digest", "size", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first.id").cast("string")).alias("refers_to"))
    out._stored_at = repeated._stored_at
    return out


def write(planned: DataFrame, folder: str) -> DataFrame:
    """(path, records): archives of one gzip stream each in ``folder``, listed in a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _open(folder)
        store.create_dir(at, recursive=True)
        out, name, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for r in (x for i in range(0, batch.num_rows, 64) for x in batch.slice(i, 64).to_pylist()):
                if out is None:
                    name = f"mono-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = gzip.GzipFile(fileobj=store.open_output_stream(f"{at}/{name}", compression=None), mode="wb", compresslevel=LEVEL, mtime=0), 0, 0
                data = record(r["record_type"], r["key"], r["url"], r["digest"], r["size"], r["payload"].encode(), r["refers_to"])
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    raw = out.fileobj
                    out.close(), raw.close()
                    done.append((f"{folder}/{name}", n))
                    out = None
        if out is not None:
            raw = out.fileobj
            out.close(), raw.close()
            done.append((f"{folder}/{name}", n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int32())], ["path", "records"])

    return stored(arrow(planned, run, "path string, records int"), "warc-archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """The sidecar index of archives rewritten with one gzip member a record; also stored beside each as .idx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, top = _open(folder)
        to.create_dir(top, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = _open(path)
                name = f"members-{uuid.uuid4().hex}.warc.gz"
                rows, offset = [], 0
                with store.open_input_stream(at, compression=None) as source, to.open_output_stream(f"{top}/{name}", compression=None) as out:
                    for i, (head, data) in enumerate(stream_records(inflate(source))):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        rows.append((f"{folder}/{name}", i, head["warc-type"], head["warc-record-id"], offset, len(member)))
                        offset += len(member)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()))] if rows else []
                if columns:
                    index = pa.RecordBatch.from_arrays(columns, ["path", "record", "record_type", "record_id", "offset", "length"])
                    with to.open_output_stream(f"{top}/{name}.idx") as side:
                        side.write("".join(f"{r[1]}\t{r[2]}\t{r[3]}\t{r[4]}\t{r[5]}\n" for r in rows).encode())
                    yield index

    spread = archives.repartition(max(1, min(10_000, archives.count())), "path")
    return stored(arrow(spread, run, _INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Each record of the index, read at its offset and checked against its headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            out: list[tuple] = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if path != opened:
                    if source is not None:
                        source.close()
                    store, at = _open(path)
                    source, opened = store.open_input_file(at), path
                source.seek(offset)
                data = gzip.decompress(source.read(length))
                end = data.index(b"\r\n\r\n")
                head = headers(data[:end])
                block = data[end + 4 : end + 4 + int(head["content-length"])]
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                digest, size, kind = head["warc-payload-digest"].removeprefix("sha256:"), int(head["warc-payload-length"]), head["warc-type"]
                if kind == "response":
                    found = hashlib.sha256(payload).hexdigest()
                    if found != digest or len(payload) != size:
                        raise ValueError(f"{path} at {offset}: the payload doesn't match its digest")
                name = lambda x: None if x in (None, "<urn:page:none>") else decoded(x.removeprefix("<urn:page:id:").removesuffix(">"))
                out.append((name(head["warc-record-id"]), decoded(head.get("warc-target-uri", "")), size, digest, kind, name(head.get("warc-refers-to"))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if source is not None:
            source.close()

    return arrow(index, run, "key string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType.simpleString()
    whole, members = new_path(spark, "warc-mono"), new_path(spark, "warc-members")
    planned = plan(pages)
    archives = write(planned, whole)
    forget(planned)
    index = normalise(archives, members)
    drop_path(spark, whole)
    forget(archives)
    id_of = lambda c: F.col(c).cast(kind).alias("page_id" if c == "key" else c)
    return read(index).select(id_of("key"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), d AS (
  SELECT page_id, payload_bytes, sha256(t) AS payload_digest, min(page_id) OVER (PARTITION BY t) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM d
"""
