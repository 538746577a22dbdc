"""Camera fields and movie boxes of made bytes, broken ones among them; ranged reads of files larger than memory should hold."""

import struct

import pytest
from pyspark.sql import functions as F

from shoebox.plans.queries import QUERIES
from shoebox.functions import exif, mp4


def tiff(order="<", entries=(), following=0, extra=b"", start=8):
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, start) + struct.pack(order + "H", len(entries))
    for tag, kind, count, value in entries:
        out += struct.pack(order + "HHI", tag, kind, count) + (value if isinstance(value, bytes) else struct.pack(order + "I", value)).ljust(4, b"\0")
    return out + struct.pack(order + "I", following) + extra


@pytest.mark.parametrize("order", ["<", ">"])
def test_fields_of_either_byte_order(order):
    short = lambda v: struct.pack(order + "H", v)
    blob = tiff(order, [(exif.ORIENTATION, 3, 1, short(6)), (exif.MODEL, 2, 3, b"ab\0"), (exif.DATE, 2, 20, 50)], extra=b"2024:02:03 04:05:06\0")
    got = dict(zip(exif.FIELDS.names, exif.fields(blob), strict=True))
    assert (got["orientation"], got["model"], got["taken"], got["iso"], got["latitude"]) == (6, "ab", "2024-02-03T04:05:06", None, None)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(blob) + 8) + b"Exif\0\0" + blob + b"\xff\xd9"
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", 2, b"IHDR") + b"xxCRC_" + struct.pack(">I4s", len(blob), b"eXIf") + blob
    assert exif.fields(jpeg) == exif.fields(png) == exif.fields(blob)


def test_broken_files_give_null():
    good = tiff("<", [(exif.ORIENTATION, 3, 1, struct.pack("<H", 3))])
    assert exif.fields(good)[3] == 3
    assert all(exif.fields(good[:n]) is None for n in range(len(good)))  # cut off anywhere
    assert exif.fields(tiff("<", [(exif.ORIENTATION, 3, 1, b"\1")], following=8)) is None  # its own successor
    assert exif.fields(tiff("<", [(0x8769, 4, 1, 8)])) is None  # its own sub-directory
    assert exif.fields(tiff("<", [(exif.MAKE, 2, 1 << 30, 26)])) is None  # a value that goes on beyond the file
    assert exif.fields(tiff("<", [(exif.ORIENTATION, 99, 1, 1)])) == (None,) * len(exif.FIELDS)  # of no known type
    assert [exif.fields(x) for x in (None, b"", b"GIF89a", b"\xff\xd8", b"\xff\xd8\xff", b"II*", b"\x89PNG\r\n\x1a\n")] == [None] * 7


def test_zero_denominators_and_odd_dates():
    blob = tiff("<", [(0x8769, 4, 1, 26)], extra=tiff("<", [(exif.EXPOSURE, 5, 1, 56), (exif.TAKEN, 2, 4, b"now\0")])[8:] + struct.pack("<II", 1, 0))
    got = dict(zip(exif.FIELDS.names, exif.fields(blob), strict=True))
    assert got["exposure"] is None and got["taken"] is None


def test_camera_fields_of_columns(spark):
    rows = spark.createDataFrame([(1, tiff("<", [(exif.ISO, 3, 1, b"\1")])), (2, None), (3, b"x"), (4, tiff("<", [(exif.ORIENTATION, 3, 1, struct.pack("<H", 8))]))], "id int, content binary")
    got = {r["id"]: r["f"] for r in rows.select("id", exif.camera_fields(F.col("content")).alias("f")).collect()}
    assert got[1] is None and got[2] is None and got[3] is None and got[4]["orientation"] == 8
    assert rows.limit(0).select(exif.camera_fields(F.col("content")).alias("f")).count() == 0


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def movie(seconds=10, frames=250, wide=False, late=False, media=b"moov" * 100, matrix=(1, 0, 0, 0, 1, 0, 0, 0, 1)):
    time = bytes(12) + struct.pack(">II", 1000, seconds * 1000) + bytes(4)
    tkhd = bytes(40) + struct.pack(">9i", *(v << 16 for v in matrix)) + struct.pack(">II", 1920 << 16, 1080 << 16)
    stbl = box(b"stbl", box(b"stsd", bytes(4), struct.pack(">I", 1), box(b"hvc1", bytes(8))), box(b"stsz", bytes(8), struct.pack(">I", frames)))
    moov = box(b"moov", box(b"mvhd", time), box(b"trak", box(b"tkhd", tkhd), box(b"mdia", box(b"mdhd", time), box(b"hdlr", bytes(8), b"vide", bytes(12)), box(b"minf", stbl))))
    mdat = box(b"mdat", media, wide=wide)
    return box(b"ftyp", b"qt  ", bytes(4)) + (mdat + moov if late else moov + mdat)


def probe(data):
    return (got := mp4.probe(lambda at, n: data[at : at + n], len(data))) and dict(zip(mp4.PROBE.names, got, strict=True))


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("wide", [False, True])
def test_boxes(late, wide):
    got = probe(movie(late=late, wide=wide, matrix=(0, -1, 0, 1, 0, 0, 0, 0, 1)))
    assert (got["container"], got["video_codec"], got["audio_codec"], got["width"], got["height"], got["rotation"], got["duration"], got["frame_rate"]) == ("qt", "hvc1", None, 1920, 1080, 270, 10.0, 25.0)


def test_broken_movies():
    whole = movie(late=True)
    assert all(probe(whole[:n]) is None for n in range(0, len(whole), 3))
    assert probe(b"") is None and probe(b"\0\0\0\1moov") is None and probe(struct.pack(">I4s", 4, b"moov") + bytes(20)) is None
    assert probe(movie(seconds=0))["duration"] is None and probe(movie(seconds=0))["bitrate"] is None
    open_end = movie()
    at = open_end.index(b"mdat") - 4
    assert probe(open_end[:at] + bytes(4) + open_end[at + 4 :])["duration"] == 10.0  # a size of 0: to the end


def test_files_are_read_in_ranges(spark, tmp_path):
    """A sparse file of six GB with its index at the end: only ranges of it can have been read."""
    head, tail = movie(late=True, wide=True, media=b"").split(struct.pack(">I4sQ", 1, b"mdat", 16))
    with open(tmp_path / "large.mp4", "wb") as f:
        f.write(head + struct.pack(">I4sQ", 1, b"mdat", 16 + 6_000_000_000))
        f.seek(6_000_000_000, 1)
        f.write(tail)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "small.mp4").write_bytes(movie())
    (tmp_path / "broken.mp4").write_bytes(b"no")
    (tmp_path / "other.txt").write_bytes(movie())
    got = {r["path"].rsplit("/", 1)[1]: r for r in mp4.probe_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"large.mp4", "small.mp4", "broken.mp4"}
    assert got["large.mp4"]["duration"] == got["small.mp4"]["duration"] == 10.0 and got["large.mp4"]["bytes_read"] < 1000 and got["large.mp4"]["length"] > 6_000_000_000
    assert got["broken.mp4"]["duration"] is None


@pytest.mark.parametrize("name", ["s12_camera_fields", "s12_k13_captured_from_bytes", "k32_final_reasons"])
def test_rows_are_dealt_out_before_costly_work(spark, sf, name):
    """A table in one file of one row group is one task's to read, not to work on."""
    assert QUERIES[name](spark, sf).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
