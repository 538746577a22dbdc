"""Token ids as binary shards with Elias-Fano document boundaries (operator 7).

Documents are dealt into shards by ranges of their id (Spark samples the ranges), sorted, tokenized, and
appended to one binary file per shard while they stream by. A shard file is

    magic | ids (little-endian, 2 or 4 bytes each) | boundaries | document ids | footer | magic

The boundaries (where each document's ids end) and the sorted document ids are Elias-Fano coded, so an
offset costs a few bits and `EliasFano.select` finds it without a table of 64-bit numbers. Tasks write
under names of their own attempt; only the names that Spark returns enter the manifest, so lost or
repeated tasks leave no trace in it. Only the manifest, one row per shard, reaches the driver.

Tokenizing is done by repeated pieces (piece_encoder). Every text is encoded whole, whatever its length; a long one goes
through memory in parts of a few megabytes.

Defined cases: null and empty texts have the end id only; null ids come first; documents with equal
ids are ordered by their text, and rows that are equal in both are documents each, in any order; an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, table, work_folder
from .elias_fano import EliasFano
from .piece_encoder import GROUP, Encoder, encoder_of

MAGIC = b"SBXTOK01"
FOOTER = "<BQQQQQq"  # bytes per id, documents, ids, bytes of boundaries, of document ids, null ids, smallest id
END_ID = 2
#: Bytes of text of a shard: a SHARDS-th of all texts within these bounds, so that neither shards nor their number (and the manifest) grow without bound.
SHARDS, SHARD_BYTES = 4096, (16 << 20, 512 << 20)


def _parts(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[list, bool, np.ndarray, np.ndarray]]:
    """(ids of the rows that begin, whether the last of them ends, bytes, offsets of the rows) in parts of about GROUP bytes."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP, side="right")) - 1)
            to, begin, end = min(to, len(ids)), int(offsets[at]), int(offsets[min(to, len(ids))])
            if to == at + 1:  # a row of any length, in parts
                begun = ids[at:to]
                while True:
                    own = data[begin:end]
                    n = encoder.part(own)
                    yield begun, n == len(own), own[:n], np.array([0, n])
                    begin, begun = begin + n, []
                    if n == len(own):
                        break
            else:
                yield ids[at:to], True, data[begin:end], offsets[at : to + 1] - begin
            at = to


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = filesystem(folder)
        encoder = encoder_of(tokenizer)
        width = encoder.dtype.itemsize
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        doc_ids: list[int | None] = []
        sizes: list[int] = []  # ids of each document
        open_ = 0  # ids of the document that goes on
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(MAGIC)
            for begun, whole, data, offsets in _parts(batches, encoder):
                ids, counts = encoder.encode(data, offsets)
                doc_ids += begun
                counts[0] += open_
                if whole:
                    out.write(np.insert(ids, np.cumsum(counts) - open_, end_id).tobytes())
                    sizes += (counts + 1).tolist()
                    open_ = 0
                else:
                    out.write(ids.tobytes())
                    open_ = int(counts[0])
            nulls = sum(i is None for i in doc_ids)
            own = np.array(doc_ids[nulls:], dtype=np.int64)
            least = int(own[0]) if len(own) else 0
            ends = EliasFano.encode(np.cumsum(np.array(sizes, dtype=np.uint64), dtype=np.uint64)).to_bytes()
            keys = EliasFano.encode(own.view(np.uint64) - np.array(least, np.int64).view(np.uint64)).to_bytes()
            out.write(ends + keys + struct.pack(FOOTER, width, len(sizes), sum(sizes), len(ends), len(keys), nulls, least) + MAGIC)
        if sizes:
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "name": [name], "n_docs": [len(sizes)], "n_ids": [sum(sizes)]}, pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
        else:
            fs.delete_file(f"{root}/{name}")

    return run


def write_store(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int | None = None) -> dict:
    """Write the shards and the manifest of docs; returns the manifest."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // (shard_bytes or min(max(size // SHARDS, SHARD_BYTES[0]), SHARD_BYTES[1]))))
    # The row number only parts rows that are equal in all else, so that one id cannot fill one shard.
    keyed = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("id"), F.asc("hash"), F.asc("row")]
    ranged = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("id", "text")
    made = ranged.mapInArrow(_writer(folder, tokenizer, end_id), "shard int, name string, n_docs long, n_ids long").collect()
    start, listed = 0, []
    for r in sorted(made, key=lambda r: r["shard"]):
        listed.append(r.asDict() | {"shard": len(listed), "start": start})
        start += r["n_ids"]
    manifest = {"format": MAGIC.decode(), "end_id": end_id, "n_ids": start, "shards": listed}
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class Shard:
    """A shard file opened for reading: its index in memory, its ids read by ranges."""

    def __init__(self, folder: str, name: str):
        fs, root = filesystem(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        tail = struct.calcsize(FOOTER) + len(MAGIC)
        total = self.file.size()
        footer = self.file.read_at(tail, total - tail)
        if footer[-len(MAGIC) :] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is not a whole shard")
        width, self.n_docs, self.n_ids, ends, keys, self.nulls, self.least = struct.unpack_from(FOOTER, footer)
        self.dtype = np.dtype(f"<u{width}")
        self.ends = EliasFano.from_bytes(self.file.read_at(ends, total - tail - keys - ends))
        self.keys = EliasFano.from_bytes(self.file.read_at(keys, total - tail - keys))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.keys.select(i - self.nulls) + self.least

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.keys.decode() + np.array(self.least, np.int64).view(np.uint64)).view(np.int64).tolist()

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, start: int, end: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - start) * w, len(MAGIC) + start * w), self.dtype)


def _reader(folder: str, with_ids: bool, piece: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(folder, r["name"])
                ends = shard.ends.decode().astype(np.int64)
                starts, keys = np.concatenate([[0], ends[:-1]]), shard.doc_ids()
                at = 0
                while at < len(ends):
                    to = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, side="right")))
                    ids = shard.ids(int(starts[at]), int(ends[to - 1])).astype("<u4")
                    cut = [ids[a:b] for a, b in zip((starts[at:to] - starts[at]).tolist(), (ends[at:to] - starts[at]).tolist(), strict=True)]
                    out = {"doc_id": pa.array(keys[at:to], pa.int64()), "start": pa.array(starts[at:to] + r["start"]), "n_tokens": pa.array(ends[at:to] - starts[at:to]), "ids_crc32": pa.array([zlib.crc32(c) for c in cut], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(out)
                    at = to

    return run


def read_store(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, read from the shard files."""
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as file:
        shards = json.loads(file.read())["shards"]
    rows = spark.createDataFrame([(s["shard"], s["name"], s["start"]) for s in shards], "shard int, name string, start long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.repartitionById(max(1, len(shards)), F.col("shard")).mapInArrow(_reader(folder, with_ids), schema)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stored(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write docs as a token store and read its index back."""
    folder = folder or f"{work_folder(docs.sparkSession)}/tokens"
    write_store(docs, folder, tokenizer or byte_bpe_path())
    return read_store(docs.sparkSession, folder)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))
