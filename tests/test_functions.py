"""Literal cases of the column functions and kernels."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.functions import hashing, kernels, media as M, numeric as N, text as T


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_hamming(spark):
    rows = [("0" * 16, "f" * 16), ("abcdef0123456789" + "0" * 16, "ABCDEF0123456788"), ("short", "0" * 16), ("zz" + "0" * 14, "0" * 16), (None, "0" * 16), ("f" * 16, "0" * 16)]
    assert values(spark, rows, "a string, b string", hashing.hamming(F.col("a"), F.col("b"))) == [(64,), (1,), (None,), (None,), (None,), (64,)]


def test_rounding(spark):
    rows = [(-0.5, 0), (1.005, 2), (2.5, 0), (-2.5, 0), (float("nan"), 0)]
    got = [spark.range(1).select(N.round_to(F.lit(v), d)).first()[0] for v, d in rows]
    assert got[:4] == [0.0, 1.0, 3.0, -2.0] and np.isnan(got[4])
    assert [spark.range(1).select(N.clamp01(F.lit(v))).first()[0] for v in (-1.0, 0.3, 2.0, float("inf"), float("nan"))] == [0, 0.3, 1, 0, 0]
    assert values(spark, [("30000/1001",), ("25/1",), ("1/0",), ("x",), (None,)], "a string", F.round(N.rational(F.col("a")), 3)) == [(29.97,), (25.0,), (None,), (None,), (None,)]
    assert values(spark, [("12.5 fps",), ("-3",), ("abc",)], "a string", N.leading_number(F.col("a"))) == [(12.5,), (-3.0,), (None,)]


def test_quality(spark):
    rows = [(1.0, 1.0, 1.0), (1.0, 1.0, 0.0), (0.5, 0.5, 0.5), (None, None, None), (None, 0.4, None)]
    got = values(spark, rows, "b double, e double, c double", F.round(M.quality_score(F.col("b"), F.col("e"), F.col("c")), 6))
    assert got == [(1.0,), (0.9,), (0.55,), (None,), (0.4,)]


def test_classes(spark):
    v = [(10.0,), (50.0,), (119.9,), (120.0,), (None,), (float("nan"),)]
    assert [r[0] for r in values(spark, v, "v double", M.blur_class(F.col("v")))] == ["blurry", "maybe-blurry", "maybe-blurry", "sharp", None, None]
    assert [r[0] for r in values(spark, v, "v double", M.is_blurry(F.col("v")))] == [True, None, None, False, None, None]
    e = [(100.0, 0.0, 0.0), (60.0, 0.0, 0.0), (200.0, 0.0, 0.0), (100.0, 0.3, 0.3), (60.0, 0.0, 0.6)]
    assert [r[0] for r in values(spark, e, "m double, d double, b double", M.exposure_class(F.col("m"), F.col("d"), F.col("b")))] == ["well-exposed", "underexposed", "overexposed", "mixed-exposure", "mixed-exposure"]
    c = [(100.0, 100.0, 100.0), (150.0, 100.0, 150.0), (160.0, 100.0, 90.0), (90.0, 160.0, 100.0), (90.0, 100.0, 160.0)]
    assert [r[0] for r in values(spark, c, "r double, g double, b double", M.colour_cast(F.col("r"), F.col("g"), F.col("b")))] == ["balanced", "magenta-cast", "warm-cast", "green-cast", "cool-cast"]


HEADS = {
    "jpeg": b"\xff\xd8\xff\xe0" + b"\0" * 12, "png": b"\x89PNG\r\n\x1a\n" + b"\0" * 8, "webp": b"RIFF\0\0\0\0WEBPVP8 ", "avi": b"RIFF\0\0\0\0AVI LIST", "mkv": b"\x1a\x45\xdf\xa3" + b"\0" * 12,
    "heic": b"\0\0\0\x18ftypheic\0\0\0\0", "mov": b"\0\0\0\x14ftypqt  \0\0\0\0", "m4v": b"\0\0\0\x18ftypM4V \0\0\0\0", "mp4": b"\0\0\0\x18ftypisom\0\0\0\0",
}


def test_magic(spark):
    rows = [(k, bytearray(h)) for k, h in HEADS.items()] + [(None, bytearray(b"")), (None, bytearray(b"RIFF\0\0\0\0WAVE")), (None, None)]
    assert all(a == b for a, b in values(spark, rows, "k string, h binary", "k", M.magic_format(F.col("h"))))


def test_classify(spark):
    rows = [
        ("a.jpg", "image/jpeg; x=1", HEADS["jpeg"], "image", None), ("a.JPEG", None, HEADS["jpeg"], "image", None), ("a.mp4", "video/mp4", HEADS["m4v"], "video", None), ("noext", None, HEADS["png"], "image", None),
        ("", None, HEADS["png"], "unknown", "empty_name"), ("a.png", None, HEADS["jpeg"], "unknown", "extension_of_other_format"), ("a.mp4", None, HEADS["jpeg"], "unknown", "extension_of_other_type"),
        ("a.txt", None, HEADS["jpeg"], "unknown", "extension_not_allowed"), ("a.jpg", "video/mp4", HEADS["jpeg"], "unknown", "mime_of_other_type"), ("a.jpg", "text/plain", HEADS["jpeg"], "unknown", "mime_of_neither_type"),
        ("a.jpg", "application/octet-stream", HEADS["jpeg"], "image", None), ("a.jpg", None, b"", "unknown", "empty_head"), ("a.jpg", None, b"0123456789abcdef", "unknown", "magic_missing_for_extension"),
        ("a.bin", None, b"012", "unknown", "head_too_short"), ("a.bin", None, b"0123456789abcdef", "unknown", "magic_missing"), (".jpg", None, HEADS["jpeg"], "image", None),
    ]
    c = M.classified(F.col("n"), F.col("m"), F.col("h"))
    for t, p, wt, wp in values(spark, [(n, m, bytearray(h), t, p) for n, m, h, t, p in rows], "n string, m string, h binary, t string, p string", c["type"], c["problem"], "t", "p"):
        assert (t, p) == (wt, wp)


def test_text(spark):
    assert values(spark, [("Hello  World!",), ("---",), (None,)], "a string", T.slug(F.col("a"))) == [("hello-world",), ("audio",), ("audio",)]
    ips = {"10.1.2.3": True, "8.8.8.8": False, "172.15.0.1": False, "172.16.0.1": True, "100.64.0.1": True, "224.0.0.1": True, "::1": True, "fe80::1": True, "2001:db8::1": False, "::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False, "nonsense": True, "300.1.1.1": True}
    assert dict(values(spark, [(k,) for k in ips], "a string", "a", T.blocked_ip(F.col("a")))) == ips
    log = "x black_start:5 black_end:6.5 d\nblack_start:1.0 black_end:0.5\nblack_start:0 black_end:2"
    got = values(spark, [(log,), ("",)], "a string", T.black_intervals(F.col("a")))
    assert [[tuple(x) for x in r[0]] for r in got] == [[(0.0, 2.0), (5.0, 6.5)], []]
    assert values(spark, [(1.0, 2.0, 10.0), (0.0, 0.0, 10.0), (0.0, 9.0, 4.0)], "i double, o double, t double", T.fade_filter(F.col("i"), F.col("o"), F.col("t"))) == [("afade=t=in:st=0:d=1.0,afade=t=out:st=8.0:d=2.0",), (None,), ("afade=t=out:st=0.0:d=9.0",)]
    assert values(spark, [("trips/a/x.JPG",), ("etc/x.jpg",), ("trips/../x.jpg",), ("trips/a",)], "a string", T.served_mime(F.col("a"))) == [("image/jpeg",), (None,), (None,), ("application/octet-stream",)]
    assert values(spark, [('{"force":true}',), ('{"force":"true"}',), ("{",), (None,)], "a string", T.forced(F.col("a"))) == [(True,), (False,), (False,), (False,)]
    assert values(spark, [("frame-000012.jpg",)], "a string", T.frame_index(F.col("a"))) == [(12,)]
    probe = '{"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"h264","width":640,"height":360,"r_frame_rate":"0/0","avg_frame_rate":"25/1","duration":"3.5"}],"format":{}}'
    assert tuple(values(spark, [(probe,)], "a string", T.probe_projection(F.col("a")))[0][0]) == (640, 360, "h264", 3.5, 25.0, "aac")


def test_verdicts(spark):
    rows = [('{"blurClass":"sharp","reason":"ok"}',), ('{"blurClass":"odd","reason":"ok"}',), ('{"blurClass":"sharp","reason":" "}',), ("{broken",)]
    assert [r[0] for r in values(spark, rows, "a string", M.blur_verdict(F.col("a"))["blurClass"])] == ["sharp", None, None, None]
    ok = M.pick_verdict(F.col("a"), F.array(F.lit("x"), F.lit("y")))["bestMediaId"]
    assert [r[0] for r in values(spark, [('{"bestMediaId":"x","reason":"r"}',), ('{"bestMediaId":"z","reason":"r"}',)], "a string", ok)] == ["x", None]


def test_kernels(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (32, 32)).astype(np.uint8)
    c = np.cos(np.pi / 32 * (np.arange(32) + 0.5)[None] * np.arange(32)[:, None])
    low = (c @ g.astype(float) @ c.T)[:8, :8].ravel()
    assert kernels.phash(g.ravel()) == f"{int(''.join('1' if v > np.median(low) else '0' for v in low), 2):016x}"
    assert kernels.dhash(np.arange(72, dtype=np.uint8)) == "0" * 16 and kernels.dhash(np.arange(72, dtype=np.uint8)[::-1]) == "f" * 16
    assert kernels.laplacian_variance(np.full(25, 7, np.uint8), 5, 5) == 0 and kernels.laplacian_variance(np.zeros(4, np.uint8), 2, 2) == 0
    assert kernels.brightness(np.array([0, 30, 225, 100], np.uint8)) == (88.75, 0.5, 0.25)
    red = kernels.colour(np.array([255, 0, 0] * 4, np.uint8))
    assert red[:3] == (255, 0, 0) and red[3] == 1 and red[6] == 1 and red[7] == pytest.approx(76.245)
    df = spark.createDataFrame([(bytearray(g.tobytes()), 32, 32), (bytearray(b"x"), 32, 32), (None, 1, 1)], "p binary, w int, h int")
    got = df.select(kernels.phash_udf("p"), kernels.sharpness_udf("p", "w", "h"), kernels.colour_udf("p")["r"], kernels.brightness_udf("p")["mean"]).collect()
    assert got[0][0] == kernels.phash(g.ravel()) and got[1][0] is None and got[2][0] is None and got[0][3] == pytest.approx(g.mean())


def test_text_hash_counts_in_one_sum(spark):
    """Equal to counting bit by bit, also for no text, no tokens, and more tokens than a batch of the count."""
    import hashlib

    words = [f"w{i}" for i in range(9000)]
    texts = [None, "", " .,; ", "One one ONE", "a b", "äß 漢字 x1", " ".join(words), " ".join(words[:4096])]

    def plain(text):
        seen = set(re.findall(r"[^\W_]+", (text or "").lower()))
        own = [int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in seen]
        return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)):016x}"

    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", hashing.text_simhash(F.col("text")).alias("h"))
    assert dict(rows.collect()) == {i: plain(t) for i, t in enumerate(texts)}
    assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()  # no pass over the tokens for each lane of bits


def test_plain_numbers_and_final_reasons_in_one_parse(spark):
    """The short way to write a number equals the formatter; the JSON is parsed once for a row, outside any method of compiled code."""
    xs = [0.0, -0.0, 1.0, 0.45, 100.0, -0.0004, -0.0006, -1.5, 2.0005, 1e7, 123456789.125, 1e12, 1e20, float("nan"), float("inf"), None, 0.1 + 0.2, 999.9996]
    old = lambda d: F.regexp_replace(F.format_string(f"%.{d}f", N.round_to(F.col("x"), d)), r"\.?0+$", "")
    for d in (2, 3):
        got = values(spark, [(x,) for x in xs], "x double", T._plain(F.col("x"), d), F.when(F.col("x").isNotNull(), old(d)))
        assert [a for a, _ in got] == [b for _, b in got]
    reason = T.final_reason(F.col("q"), F.col("q"), F.col("e"), F.lit(None).cast("double"), F.col("raw"))
    df = spark.createDataFrame([(0.5, 0.25, '{"exposure":{"exposureLabel":"dark","meanBrightness":7}}'), (None, None, "{broken")], "q double, e double, raw string").select(reason.alias("r"))
    assert [r[0] for r in df.collect()] == ["final quality 0.5 — blur=0.5 [?] | exposure=0.25 [dark, mean=7] | weights blur=0.45→0.563 exposure=0.35→0.437 (skipped: color)", None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
