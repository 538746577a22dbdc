"""Registered queries over media files' bytes, which are made in the JVM from rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exif, media as M, mp4
from .blobs import box, data, text, u
from .queries import dealt, query


def camera_blob():
    """A photo's bytes from a row of orders: TIFF or JPEG of either byte order; some cut off, looping, foreign or null."""
    k, little = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    n = lambda v, size: u(v, size, little)
    entry = lambda tag, kind, count, *value: F.concat(n(tag, 2), n(kind, 2), n(count, 4), *value)
    short = lambda v: F.concat(n(v, 2), F.lit("0000"))
    header = F.concat(F.when(little, text("II")).otherwise(text("MM")), n(42, 2), n(8, 4))
    following = F.when(k % 11 == 1, 8).otherwise(0)  # the first directory again: a loop
    main = F.concat(n(4, 2), entry(exif.MAKE, 2, 6, n(170, 4)), entry(exif.ORIENTATION, 3, 1, short(1 + k % 8)), entry(0x8769, 4, 1, n(62, 4)), entry(0x8825, 4, 1, n(116, 4)), n(following, 4))
    camera = F.concat(n(4, 2), entry(exif.EXPOSURE, 5, 1, n(196, 4)), entry(exif.APERTURE, 5, 1, n(204, 4)), entry(exif.ISO, 3, 1, short(100 + k % 3100)), entry(exif.TAKEN, 2, 20, n(176, 4)), n(0, 4))
    place = F.concat(n(4, 2), entry(1, 2, 2, F.when(k % 3 == 0, text("S", 4)).otherwise(text("N", 4))), entry(2, 5, 3, n(212, 4)), entry(3, 2, 2, text("W", 4)), entry(4, 5, 3, n(236, 4)), n(0, 4))
    pair = lambda a, b: F.concat(n(a, 4), n(b, 4))
    taken = F.when(k % 7 == 0, "0000:00:00 00:00:00").otherwise(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    rest = F.concat(text("maker", 6), text(taken, 20), pair(1, 1 + k % 500), pair(10 + k % 80, F.when(k % 5 == 0, 0).otherwise(10)), pair(k % 90, 1), pair(k % 60, 1), pair(k % 600, 10), pair(k % 180, 1), pair(k % 60, 1), pair(1, 2))
    tiff = F.concat(header, main, camera, place, rest)
    jpeg = F.concat(F.lit("FFD8"), F.lit("FFE00004"), F.lit("4142"), F.lit("FFE1"), u(F.length(tiff) / 2 + 8, 2), text("Exif", 6), tiff, F.lit("FFDA0002FFD9"))
    whole = F.when(k % 4 < 2, jpeg).otherwise(tiff)
    return F.when(k % 11 == 3, F.lit(None)).when(k % 11 == 2, data(text("GIF89a and so on"))).otherwise(F.unhex(F.substring(whole, 1, F.when(k % 11 == 0, 2 * 150).otherwise(2 * 1000))))


_GOOD = "o_orderkey % 11 NOT IN (0, 1, 2, 3)"


@query(f"""SELECT o_orderkey AS id, CASE WHEN {_GOOD} THEN 'maker' END AS make, CASE WHEN {_GOOD} THEN CAST(1 + o_orderkey % 8 AS INTEGER) END AS orientation,
 CASE WHEN {_GOOD} THEN CAST(100 + o_orderkey % 3100 AS INTEGER) END AS iso, CASE WHEN {_GOOD} AND o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS taken,
 round(CASE WHEN {_GOOD} THEN 1.0 / (1 + o_orderkey % 500) END, 9) AS exposure, round(CASE WHEN {_GOOD} AND o_orderkey % 5 > 0 THEN (10 + o_orderkey % 80) / 10.0 END, 9) AS aperture,
 round(CASE WHEN {_GOOD} THEN (o_orderkey % 90 + o_orderkey % 60 / 60.0 + o_orderkey % 600 / 36000.0) * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END END, 9) AS latitude,
 round(CASE WHEN {_GOOD} THEN -(o_orderkey % 180 + o_orderkey % 60 / 60.0 + 0.5 / 3600) END, 9) AS longitude FROM orders""")
def s12_camera_fields(get):
    got = dealt(get, get("orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select(F.col("o_orderkey").alias("id"), camera_blob().alias("content")).select("id", exif.camera_fields(F.col("content")).alias("f"))
    r9 = lambda n: F.round(f"f.{n}", 9).alias(n)
    return got.select("id", "f.make", "f.orientation", "f.iso", "f.taken", r9("exposure"), r9("aperture"), r9("latitude"), r9("longitude"))


@query(f"SELECT o_orderkey AS id, CASE WHEN {_GOOD} AND o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE '2001-02-03 04:05:06' END AS captured FROM orders")
def s12_k13_captured_from_bytes(get):
    got = dealt(get, get("orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select(F.col("o_orderkey").alias("id"), exif.camera_fields(camera_blob()).alias("f"))
    meta = F.to_json(F.struct(F.col("f.taken").alias("DateTimeOriginal")))
    return got.select("id", F.date_format(M.captured_at(meta, F.lit("2001-02-03 04:05:06").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss").alias("captured"))


def movie_blob():
    """A video's bytes from a row of orders: index before or after the media, sizes of 32 or 64 bits, headers of both versions; some broken."""
    k = F.col("o_orderkey")
    late, wide, second = k % 2 == 0, k % 3 == 0, k % 5 == 0
    seconds = 1 + k % 3000
    time = F.when(second, F.concat(F.lit("01000000"), u(0, 16), u(600, 4), u(seconds * 600, 8))).otherwise(F.concat(F.lit("00000000"), u(0, 8), u(600, 4), u(seconds * 600, 4)))
    turn = F.when(k % 4 == 1, F.concat(u(0, 4), u(65536, 4), u(0, 4), F.lit("FFFF0000"), u(0, 20))).otherwise(F.concat(u(65536, 4), u(0, 12), u(65536, 4), u(0, 16)))
    tkhd = lambda w, h: box("tkhd", F.lit("00000007"), u(0, 36), turn, u(w, 2), F.lit("0000"), u(h, 2), F.lit("0000"))
    media = lambda kind, codec, samples: box("mdia", box("mdhd", time, u(0, 4)), box("hdlr", u(0, 8), text(kind), u(0, 12)), box("minf", box("stbl", box("stsd", u(0, 4), u(1, 4), box(codec, u(0, 8))), box("stsz", u(0, 4), u(0, 4), u(samples, 4)))))
    video = box("trak", tkhd(640 + k % 1280, 360 + k % 720), media("vide", "avc1", seconds * (24 + k % 37)))
    audio = F.when(k % 6 > 0, box("trak", tkhd(0, 0), media("soun", "mp4a", seconds * 40))).otherwise("")
    moov = F.when(k % 13 == 2, box("moov", box("mvhd", time, u(0, 80)), audio)).otherwise(box("moov", box("mvhd", time, u(0, 80)), audio, video))
    mdat = box("mdat", F.repeat(F.lit("6D6F6F76"), 500), wide=wide)
    whole = F.concat(box("ftyp", text("isom"), u(512, 4)), F.when(late, F.concat(mdat, moov)).otherwise(F.concat(moov, mdat)))
    return F.when(k % 13 == 3, F.lit(None)).when(k % 13 == 1, data(text("RIFF....AVI LIST"))).otherwise(F.unhex(F.substring(whole, 1, F.when(k % 13 == 0, 2 * 400).otherwise(2 * 9000))))


_MOVIE = "o_orderkey % 13 NOT IN (0, 1, 2, 3)"


@query(f"""SELECT o_orderkey AS id, CASE WHEN {_MOVIE} THEN 'isom' END AS container, CASE WHEN {_MOVIE} THEN 'avc1' END AS video_codec, CASE WHEN {_MOVIE} AND o_orderkey % 6 > 0 THEN 'mp4a' END AS audio_codec,
 CASE WHEN {_MOVIE} THEN CAST(640 + o_orderkey % 1280 AS INTEGER) END AS width, CASE WHEN {_MOVIE} THEN CAST(360 + o_orderkey % 720 AS INTEGER) END AS height,
 CASE WHEN {_MOVIE} THEN CASE WHEN o_orderkey % 4 = 1 THEN 90 ELSE 0 END END AS rotation, CASE WHEN {_MOVIE} THEN CAST(1 + o_orderkey % 3000 AS DOUBLE) END AS duration,
 CASE WHEN {_MOVIE} THEN CAST(24 + o_orderkey % 37 AS DOUBLE) END AS frame_rate, CASE WHEN {_MOVIE} THEN true END AS media_left_alone FROM orders""")
def s13_movie_boxes(get):
    got = get("orders").select(F.col("o_orderkey").alias("id"), mp4.probed(movie_blob()).alias("p"))
    # The media body alone has 2,000 bytes.
    return got.select("id", "p.container", "p.video_codec", "p.audio_codec", "p.width", "p.height", "p.rotation", "p.duration", F.round("p.frame_rate", 6).alias("frame_rate"), (F.col("p.bytes_read") < 1500).alias("media_left_alone"))
