"""Technical fields of MP4 and QuickTime files from their nested boxes, by ranged reads.

A box is a size (32 bits, 64 bits where that is 1, up to the end where it is 0), a type and a body. The walk reads headers, steps over
bodies and goes into the boxes that hold others, so of a file it reads a few hundred bytes, wherever the index (moov) lies before or
after the media; media bytes are never read. Files that are cut off, whose sizes do not fit their parent, or without an
index or a video track give null.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

_PARENTS = (b"moov", b"trak", b"mdia", b"minf", b"stbl")  # fixed values of the format
PROBE = StructType(
    [StructField(n, StringType()) for n in ("container", "video_codec", "audio_codec")]
    + [StructField(n, IntegerType()) for n in ("width", "height", "rotation")]
    + [StructField(n, DoubleType()) for n in ("duration", "frame_rate", "bitrate")]
    + [StructField("bytes_read", LongType())]
)
Read = Callable[[int, int], bytes]


def boxes(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin of the body, end) of the boxes between two places."""
    while at < end:
        head = read(at, 16)
        size, kind = struct.unpack_from(">I4s", head)
        body = at + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", head, 8)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError("a box does not fit")
        yield kind, body, at + size
        at += size


def _timed(read: Read, at: int) -> tuple[int, int]:
    """(units a second, units) of a movie or media header."""
    if read(at, 1) == b"\1":
        return struct.unpack(">IQ", read(at + 20, 12))
    return struct.unpack(">II", read(at + 12, 8))


def _track(read: Read, at: int, end: int) -> dict:
    got = {}
    for kind, a, b in boxes(read, at, end):
        if kind == b"tkhd":
            tail = read(b - 44, 44)  # matrix, width and height close the header in both versions
            m = struct.unpack(">9i", tail[:36])
            got["turn"] = {(0, 1): 90, (-1, 0): 180, (0, -1): 270}.get((m[0] >> 16, m[1] >> 16), 0)
            got["size"] = tuple(v >> 16 for v in struct.unpack(">II", tail[36:]))
        elif kind == b"mdhd":
            got["time"] = _timed(read, a)
        elif kind == b"hdlr":
            got["kind"] = read(a + 8, 4)
        elif kind == b"stsd":
            got["codec"] = read(a + 12, 4).decode("latin-1")
        elif kind == b"stsz":
            got["samples"] = struct.unpack(">I", read(a + 8, 4))[0]
        elif kind in _PARENTS:
            got |= _track(read, a, b)
    return got


def probe(read: Read, length: int) -> tuple | None:
    """The fields of one file in the order of PROBE, from a function that gives (place, count) bytes of it."""
    seen = 0

    def ranged(at: int, n: int) -> bytes:
        nonlocal seen
        got = read(at, n)
        seen += len(got)
        return got

    try:
        container, movie, tracks = None, None, []
        for kind, a, b in boxes(ranged, 0, length):
            if kind == b"ftyp":
                container = ranged(a, 4).decode("latin-1").strip()
            elif kind == b"moov":
                for inner, c, d in boxes(ranged, a, b):
                    if inner == b"mvhd":
                        movie = _timed(ranged, c)
                    elif inner == b"trak":
                        tracks.append(_track(ranged, c, d))
        video = next((t for t in tracks if t.get("kind") == b"vide"), None)
        audio = next((t for t in tracks if t.get("kind") == b"soun"), {})
        if not movie or not video or not all(video.get("size", (0, 0))):
            return None
        seconds = movie[1] / movie[0] if movie[0] and movie[1] else None
        scale, units = video.get("time", (0, 0))
        rate = video["samples"] * scale / units if units and video.get("samples") else None
        return (container, video.get("codec"), audio.get("codec"), *video["size"], video["turn"], seconds, rate, length * 8 / seconds if seconds else None, seen)
    except (ValueError, struct.error):
        return None


@F.pandas_udf(PROBE)
def _probe_udf(content: pd.Series) -> pd.DataFrame:
    rows = [(probe(lambda at, n, d=d: d[at : at + n], len(d)) if d is not None else None) or (None,) * len(PROBE) for d in content]
    return pd.DataFrame(rows, columns=PROBE.names, dtype=object)


def probed(content):
    """struct of PROBE of a column of file bytes; null where it is no such file."""
    got = _probe_udf(content)
    return F.when(got["bytes_read"].isNotNull(), got)


def probe_files(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """(path, length, *PROBE) of files in a folder.

    Spark lists the files (their content is pruned from the scan) and spreads the paths over the tasks, which read ranges.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    out = StructType([StructField("path", StringType()), StructField("length", LongType()), *PROBE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = None
        for batch in batches:
            rows = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    rows.append((path, length, *(probe(lambda p, n, f=f, length=length: f.read_at(max(0, min(n, length - p)), p), length) or (None,) * len(PROBE))))
            schema = schema or _arrow(out)
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in rows], schema)

    return files.repartition(max(1, min(spark.sparkContext.defaultParallelism, 1000))).mapInArrow(run, out)


def _arrow(schema: StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "integer": pa.int32(), "double": pa.float64(), "long": pa.int64()}
    return pa.schema([(f.name, kinds[f.dataType.typeName()]) for f in schema.fields])
