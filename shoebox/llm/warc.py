"""WARC archives through a chunked record table (operator 8).

Records are rows of chunks, (record, chunk, data), made by a task that streams each payload once for its digest and once
for its chunks, as views of the Arrow batch that Spark hands it: besides that batch a task holds a few megabytes of chunks,
however large a payload is. Chunk rows carry the running digest (SHA-256 of the payload up to and including that chunk)
and the running length; those of the last chunk are the payload's own.

Of records with equal payloads of at least 100 bytes, the one with the smallest id is a response and the
others are revisits, which have no payload but refer to it. Ids and digests are shuffled to decide this, payloads are not: the
digests that occur twice or more are broadcast to the chunk rows, up to BROADCAST_DIGESTS of them; beyond, chunk
rows are shuffled to them once.

`archive` writes the chunks of each Spark partition into WARC files (one gzip member per record, a new
file after `archive_bytes`), and holds each chunk against its running digest; only the names that Spark returns count, so
files of lost tasks are never read. `read_chunks` streams the files back into chunk rows.

Defined cases: null payloads are empty; records without an id are written, and are revisits if an equal
payload has an id, else responses; rows that repeat the smallest id are all responses; an empty
table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, table, work_folder, written

LEAST = 100
CHUNK = 64 << 10
ARCHIVE_BYTES = 256 << 20
#: Repeated digests up to which they are broadcast.
BROADCAST_DIGESTS = 500_000
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


CHUNKS = pa.schema([("record", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()), ("chunk", pa.int32()), ("last", pa.int32()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("data", pa.binary())])


def _chunker(chunk_bytes: int, with_data: bool):
    """Chunk rows of (record, id, url, payload) rows; without data only the last chunk of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(3).cast(pa.large_binary())
            offsets = np.frombuffer(payloads.buffers()[1], np.int64)[payloads.offset : payloads.offset + len(payloads) + 1].tolist()
            whole, rows, size = memoryview(payloads.buffers()[2] or b""), [], 0
            for k, (record, page, url) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                own = whole[offsets[k] : offsets[k + 1]]
                pieces = [own[at : at + chunk_bytes] for at in range(0, max(len(own), 1), chunk_bytes)]
                running, so_far = hashlib.sha256(), []
                for piece in pieces:
                    running.update(piece)
                    if with_data:
                        so_far.append(running.hexdigest())
                digest, last, done = running.hexdigest(), len(pieces) - 1, 0
                for i, piece in enumerate(pieces) if with_data else [(last, b"")]:
                    done += len(piece)
                    rows.append((record, page, url, len(own), digest, i, last, done if with_data else len(own), so_far[i] if with_data else digest, bytes(piece) if with_data else None))
                    size += 300 + len(piece)
                    if size >= 4 << 20:
                        yield _rows(rows, CHUNKS)
                        rows, size = [], 0
            if rows:
                yield _rows(rows, CHUNKS)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def chunked(pages: DataFrame, chunk_bytes: int = CHUNK, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", with_data: bool = True) -> DataFrame:
    """Chunk rows of every record, those of one together and in order; with_data=False gives only the last of each, without data."""
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.mapInArrow(_chunker(chunk_bytes, with_data), "record long, id long, url string, bytes long, digest string, chunk int, last int, bytes_so_far long, digest_so_far string, data binary")


def classified(pages: DataFrame, chunk_bytes: int = CHUNK, least: int = LEAST, **columns: str) -> DataFrame:
    """Chunk rows with kind and refers_to; revisits have one empty chunk."""
    ends = chunked(pages, chunk_bytes, with_data=False, **columns).where(F.col("bytes") >= least)
    again = written(ends.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1 and first is not null").select("digest", "first"), "again")
    rows = chunked(pages, chunk_bytes, **columns)
    if again.count() <= BROADCAST_DIGESTS:
        out = rows.join(F.broadcast(again), "digest", "left")
    else:
        out = rows.join(again.hint("merge"), "digest", "left").sortWithinPartitions("digest", "record", "chunk")
    revisit = F.col("first").isNotNull() & (F.col("bytes") >= least) & ~F.col("id").eqNullSafe(F.col("first"))
    out = out.withColumn("revisit", revisit).where("not revisit or chunk = 0")
    of = lambda c, empty: F.when(F.col("revisit"), F.lit(empty)).otherwise(F.col(c)).alias(c)
    nothing = hashlib.sha256().hexdigest()
    return out.select("id", "url", "bytes", "digest", F.when(F.col("revisit"), "revisit").otherwise("response").alias("kind"), F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "chunk", of("last", 0), of("bytes_so_far", 0), of("digest_so_far", nothing), of("data", b""))


def _record_id(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def _page(record_id: str | None) -> int | None:
    text = (record_id or "").removeprefix("<urn:x-page:").removesuffix(">")
    return None if text in ("", "null") else int(text)


def _head(row: dict) -> bytes:
    """WARC and HTTP headers of a record, up to its payload."""
    url = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", row["url"] or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['kind']}", f"WARC-Record-ID: {_record_id(row['id'])}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{row['digest']}", f"X-Payload-Length: {row['bytes']}", "Content-Type: application/http;msgtype=response"]
    if row["kind"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(row['refers_to'])}"]
    body = len(http) + (row["bytes"] if row["kind"] == "response" else 0)
    return ("\r\n".join([*lines, f"Content-Length: {body}"]) + "\r\n\r\n").encode() + http


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        files, out, packer, digest, size, records, at = 0, None, None, None, 0, 0, ""

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"name": [at], "records": [records], "bytes": [size]})

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
                if row["chunk"] == 0:
                    if out is not None and size >= archive_bytes:
                        yield done()
                        out = None
                    if out is None:
                        at, files, size, records = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.gz", files + 1, 0, 0
                        out = fs.open_output_stream(f"{root}/{at}", compression=None)
                    packer, digest = zlib.compressobj(4, zlib.DEFLATED, 31), hashlib.sha256()
                    size += out.write(packer.compress(_head(row))) or 0
                digest.update(row["data"])
                if digest.hexdigest() != row["digest_so_far"]:
                    raise ValueError(f"chunk {row['chunk']} of {row['id']} differs from its digest")
                packed = packer.compress(row["data"])
                if row["chunk"] == row["last"]:
                    packed += packer.compress(b"\r\n\r\n") + packer.flush()
                    records += 1
                out.write(packed)
                size += len(packed)
        if out is not None:
            yield done()

    return run


def archive(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> list[dict]:
    """Write chunk rows (those of a record together and in order) as WARC files; returns a row per file."""
    made = chunks.select("id", "url", "bytes", "digest", "kind", "refers_to", "chunk", "last", "digest_so_far", "data").mapInArrow(_writer(folder, archive_bytes), "name string, records long, bytes long").collect()
    return sorted((r.asDict() for r in made), key=lambda r: r["name"])


class _Stream:
    """Decompressed bytes of a file of gzip members, by lines and by pieces."""

    def __init__(self, file, piece: int):
        self.file, self.piece, self.left, self.buffer, self.unzip = file, piece, b"", b"", None

    def fill(self) -> bool:
        while True:
            if not self.left:
                self.left = self.file.read(self.piece)
                if not self.left:
                    return False
            if self.unzip is None:
                self.unzip = zlib.decompressobj(31)
            got = self.unzip.decompress(self.left, self.piece)
            self.left = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if self.unzip.eof:
                self.unzip = None
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self.fill():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while not self.buffer:
            if not self.fill():
                raise EOFError("a record is cut off")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


FIELDS = pa.schema([("id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("chunk", pa.int64()), ("is_last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("data", pa.binary())])


def _reader(folder: str, chunk_bytes: int, with_data: bool):
    def records(stream: _Stream) -> Iterator[tuple]:
        while (head := stream.until(b"\r\n\r\n")) is not None:
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            http = stream.until(b"\r\n\r\n")
            left = int(fields["Content-Length"]) - len(http) - 4
            own = (_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"))
            digest, seen, chunk = hashlib.sha256(), 0, 0
            while True:
                data, need = b"", min(chunk_bytes, left)
                while len(data) < need:
                    data += stream.take(need - len(data))
                digest.update(data)
                left, seen = left - need, seen + need
                yield (*own, chunk, left == 0, seen, digest.hexdigest(), data if with_data else None)
                chunk += 1
                if not left:
                    break
            if stream.until(b"\r\n\r\n") != b"":
                raise ValueError("a record does not end where it says")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as file:
                    rows, size = [], 0
                    for row in records(_Stream(file, chunk_bytes)):
                        rows.append(row)
                        size += 300 + len(row[-1] or b"")
                        if size >= 4 << 20:
                            yield _rows(rows, FIELDS)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows, FIELDS)

    return run


def read_chunks(spark: SparkSession, folder: str, files: list[dict], chunk_bytes: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk rows of archives, a task per file, streamed."""
    rows = spark.createDataFrame([(f["name"], k) for k, f in enumerate(files)], "name string, k int")
    schema = "id long, url string, kind string, refers_to long, declared_bytes long, declared_digest string, chunk long, is_last boolean, bytes_so_far long, digest_so_far string, data binary"
    return rows.repartitionById(max(1, len(files)), F.col("k")).select("name").mapInArrow(_reader(folder, chunk_bytes, with_data), schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark)}/warc"
    files = archive(classified(table(spark, sf_dir, "pages")), folder)
    last = read_chunks(spark, folder, files, with_data=False).where("is_last")
    revisit = F.col("kind") == "revisit"
    return last.select(F.col("id").alias("page_id"), F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"), F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""
