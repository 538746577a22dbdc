"""Text helpers of the data model: paths, slugs, addresses, logs, payloads and filter strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .media import lookup
from .numeric import clamp01, leading_number, round_to

#: Audio types and the extension of each.
AUDIO_EXTENSIONS = ("mp3", "m4a", "aac", "wav", "flac", "ogg", "opus")
AUDIO_MIMES = {
    "audio/mpeg": "mp3", "audio/mp3": "mp3", "audio/mp4": "m4a", "audio/m4a": "m4a", "audio/x-m4a": "m4a", "audio/aac": "aac", "audio/wav": "wav",
    "audio/x-wav": "wav", "audio/wave": "wav", "audio/flac": "flac", "audio/x-flac": "flac", "audio/ogg": "ogg", "audio/opus": "opus", "application/ogg": "ogg",
}
#: The media type of each extension.
AUDIO_MIME_OF = {"mp3": "audio/mpeg", "m4a": "audio/mp4", "aac": "audio/aac", "wav": "audio/wav", "flac": "audio/flac", "ogg": "audio/ogg", "opus": "audio/opus"}
#: Media types of served files.
MIMES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "heic": "image/heic", "mp4": "video/mp4", "mov": "video/quicktime", "m4v": "video/x-m4v", "mkv": "video/x-matroska", "avi": "video/x-msvideo", "mp3": "audio/mpeg", "json": "application/json"}


def slug(text: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one hyphen, none at the ends; 'audio' if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "audio").otherwise(F.coalesce(out, F.lit("audio")))


def audio_extension(name: Column, mime: Column) -> Column:
    """An allowed extension of the name, else that of the media type, else null."""
    own = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/]\.([^./]*)$", 1))
    return F.when(own.isin(*AUDIO_EXTENSIONS), own).otherwise(lookup(AUDIO_MIMES, F.lower(mime)))


def safe_segment(text: Column) -> Column:
    """True for path segments of letters, digits, dot, dash and underscore that are not dots only."""
    return text.rlike(r"^[A-Za-z0-9._-]{1,128}$") & ~text.rlike(r"^\.+$")


def original_path(trip: Column, media: Column, ext: Column) -> Column:
    """Logical path of an original; null if a part is not a safe segment."""
    ok = safe_segment(trip) & safe_segment(media) & ext.rlike("^[a-z0-9]{1,10}$")
    return F.when(ok, F.concat(F.lit("trips/"), trip, F.lit("/originals/"), media, F.lit("."), ext))


def derived_path(trip: Column, kind: str, media: Column, ext: str) -> Column:
    return F.when(safe_segment(trip) & safe_segment(media), F.concat(F.lit("trips/"), trip, F.lit(f"/derived/{kind}/"), media, F.lit(f".{ext}")))


def served_mime(path: Column) -> Column:
    """Media type of a path under trips/, null for any other path or one that climbs up."""
    ok = path.startswith("trips/") & ~path.rlike(r"(^|/)\.\.(/|$)")
    return F.when(ok, F.coalesce(lookup(MIMES, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("application/octet-stream")))


def _v4_parts(ip: Column) -> list[Column]:
    return [F.split_part(ip, F.lit("."), F.lit(k)).try_cast("int") for k in range(1, 5)]


def _blocked_v4(ip: Column) -> Column:
    a, b, c, d = _v4_parts(ip)
    bad = (a > 255) | (b > 255) | (c > 255) | (d > 255)
    private = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    return bad | private


V4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def blocked_ip(ip: Column) -> Column:
    """True for addresses that a server must not fetch from: private, local, multicast, reserved, or no address."""
    low = F.lower(ip)
    mapped = F.regexp_extract(low, r"^::ffff:(.*)$", 1)
    v6 = low.isin("::1", "::") | low.rlike("^(fe[89ab]|f[cd]|ff)") | (mapped.rlike(V4) & _blocked_v4(mapped))
    return F.when(ip.rlike(V4), _blocked_v4(ip)).when(low.rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$"), F.coalesce(v6, F.lit(False))).otherwise(F.lit(True))


def black_intervals(log: Column) -> Column:
    """Intervals of a blackdetect log with end after start, by start."""
    starts, ends = (F.regexp_extract_all(log, F.lit(r"black_start:\s*(-?[\d.]+)\s+black_end:\s*(-?[\d.]+)"), F.lit(g)) for g in (1, 2))
    pairs = F.arrays_zip(F.transform(starts, leading_number).alias("s"), F.transform(ends, leading_number).alias("e"))
    named = F.transform(pairs, lambda p: F.struct(p["s"].alias("start"), p["e"].alias("end")))
    return F.array_sort(F.filter(named, lambda p: p["end"] > p["start"]))


def fade_filter(fade_in: Column, fade_out: Column, total: Column) -> Column:
    """Fades as a filter chain, null if there is none; the last starts no earlier than 0."""
    parts = F.array_compact(F.array(
        F.when(fade_in > 0, F.concat(F.lit("afade=t=in:st=0:d="), fade_in.cast("string"))),
        F.when(fade_out > 0, F.concat(F.lit("afade=t=out:st="), F.greatest(F.lit(0.0), total - fade_out).cast("string"), F.lit(":d="), fade_out.cast("string"))),
    ))
    return F.when((total > 0) & (F.size(parts) > 0), F.array_join(parts, ","))


def trim_filter(start: Column, end: Column, duration: Column) -> Column:
    parts = F.array_compact(F.array(F.when(start >= 0, F.concat(F.lit("start="), start.cast("string"))), F.when(end > 0, F.concat(F.lit("end="), end.cast("string"))), F.when(duration > 0, F.concat(F.lit("duration="), duration.cast("string")))))
    return F.when(F.size(parts) > 0, F.concat(F.lit("atrim="), F.array_join(parts, ":"), F.lit(",asetpts=PTS-STARTPTS")))


def selector_scope(payload: Column) -> Column:
    """struct(scope, tripId, groupId) of a selector job's payload; null if malformed or incomplete."""
    got = F.from_json(payload, "scope string, tripId string, groupId string")
    ok = ((got["scope"] == "trip") & (F.length(got["tripId"]) > 0)) | ((got["scope"] == "group") & (F.length(got["groupId"]) > 0))
    return F.when(ok, got)


def forced(payload: Column) -> Column:
    """True only for a payload whose force is the JSON value true."""
    return F.coalesce(F.get_json_object(payload, "$.force") == "true", F.lit(False)) & ~F.coalesce(payload.rlike(r'"force"\s*:\s*"'), F.lit(False))


def frame_index(name: Column) -> Column:
    """Number of a key frame from its file name (frame-000012.jpg is 12)."""
    return F.regexp_extract(name, r"(\d+)\.[A-Za-z0-9]+$", 1).try_cast("long")


def probe_projection(probe_json: Column) -> Column:
    """struct(width, height, codec, duration, fps, audio_codec) of a media probe's JSON: first streams of each kind."""
    from .numeric import rational

    stream = "struct<codec_type:string,codec_name:string,width:bigint,height:bigint,duration:string,r_frame_rate:string,avg_frame_rate:string>"
    got = F.from_json(probe_json, f"streams array<{stream}>, format struct<duration:string>")
    first = lambda kind: F.get(F.filter(got["streams"], lambda s: s["codec_type"] == kind), 0)
    v, a = first("video"), first("audio")
    return F.struct(v["width"].alias("width"), v["height"].alias("height"), v["codec_name"].alias("codec"), F.coalesce(leading_number(got["format"]["duration"]), leading_number(v["duration"])).alias("duration"), F.coalesce(rational(v["r_frame_rate"]), rational(v["avg_frame_rate"])).alias("fps"), a["codec_name"].alias("audio_codec"))


def loudness_filter(level: Column, peak: Column, spread: Column) -> Column:
    """A loudness filter from integrated level, true peak and range; null if one is missing."""
    return F.concat(F.lit("loudnorm=I="), _plain(level, 3), F.lit(":TP="), _plain(peak, 3), F.lit(":LRA="), _plain(spread, 3))


def segment_path(trip: Column, media: Column, segment: Column) -> Column:
    """Logical path of a segment's file; null if a part is not a safe segment."""
    ok = safe_segment(trip) & safe_segment(media) & safe_segment(segment)
    return F.when(ok, F.concat(F.lit("trips/"), trip, F.lit("/derived/"), media, F.lit("/segments/"), segment, F.lit(".mp4")))


def _plain(x: Column, digits: int) -> Column:
    """A number to so many places, without zeros at the end.

    Written from whole numbers; a formatter and a pattern, which take many times as long, serve only what has no such form.
    """
    f = 10**digits
    scaled = F.floor(x.cast("double") * float(f) + 0.5)
    part = F.abs(scaled) % f
    whole = F.concat(F.when(scaled < 0, "-").otherwise(""), F.call_function("div", F.abs(scaled), F.lit(f)).cast("string"))
    text = F.when(part == 0, whole).otherwise(F.concat(whole, F.lit("."), F.rtrim(F.lpad(part.cast("string"), digits, "0"), F.lit("0"))))
    other = F.regexp_replace(F.format_string(f"%.{digits}f", round_to(x, digits)), r"\.?0+$", "")
    return F.when(F.abs(x.cast("double")) < 1e15 / f, text).when(x.isNotNull(), other)


def segment_reason(blur: Column, black: Column, quality: Column, waste: Column, keyframes: Column, recommended: Column) -> Column:
    """How a segment was judged, part by part."""
    three = lambda x: F.when(x.isNull(), "NULL").otherwise(F.format_string("%.3f", round_to(x, 3)))
    parts = [F.concat(F.lit(f"{name}="), three(x)) for name, x in (("blur", blur), ("blackRatio", black), ("quality", quality))]
    parts += [F.concat(F.lit("waste="), waste), F.concat(F.lit("keyframes="), keyframes.cast("string")), F.when(keyframes == 0, "(no keyframes in interval; blur degraded to NULL)"), F.when(recommended, "recommended")]
    return F.concat_ws(" ", *parts)


#: Weights of the dimensions of quality, in their order.
WEIGHTS = {"blur": 0.45, "exposure": 0.35, "color": 0.2}


def final_reason(quality: Column, blur: Column, exposure: Column, color: Column, raw: Column) -> Column:
    """The final quality with what each dimension said (labels from the raw JSON, '?' where it has none), the weights as set and as normalised, and the dimensions left out.

    The JSON is parsed once for a row, and the text is made within a lambda: as plain expressions, the parse and each number would stand
    many times in one method, which gets too large for the JVM to compile.
    """
    got = F.from_json(raw, "blur struct<classification:string,laplacianVariance:double>, exposure struct<exposureLabel:string,meanBrightness:double>, color struct<colorCast:string,labels:array<string>>")
    row = F.struct(*[c.alias(n) for n, c in (("quality", quality), ("blur", blur), ("exposure", exposure), ("color", color), ("got", got))])
    return F.transform(F.array(row), lambda r: _final_reason(r["quality"], r["blur"], r["exposure"], r["color"], r["got"]))[0]


def _final_reason(quality: Column, blur: Column, exposure: Column, color: Column, got: Column) -> Column:
    score = {"blur": blur, "exposure": exposure, "color": color}
    label = lambda x: F.coalesce(x, F.lit("?"))
    more = lambda name, x: F.coalesce(F.concat(F.lit(f", {name}="), _plain(x, 2)), F.lit(""))
    labels = F.array_join(got["color"]["labels"], ",")
    said = {
        "blur": F.concat(F.lit("blur="), _plain(blur, 3), F.lit(" ["), label(got["blur"]["classification"]), more("variance", got["blur"]["laplacianVariance"]), F.lit("]")),
        "exposure": F.concat(F.lit("exposure="), _plain(exposure, 3), F.lit(" ["), label(got["exposure"]["exposureLabel"]), more("mean", got["exposure"]["meanBrightness"]), F.lit("]")),
        "color": F.concat(F.lit("color="), _plain(color, 3), F.lit(" (eff "), _plain(0.5 + 0.5 * clamp01(color), 3), F.lit(") ["), label(got["color"]["colorCast"]), F.when(F.length(labels) > 0, F.concat(F.lit(", labels="), labels)).otherwise(""), F.lit("]")),
    }
    total = sum((F.when(score[d].isNotNull(), w).otherwise(0.0) for d, w in WEIGHTS.items()), F.lit(0.0))
    weights = [F.when(score[d].isNotNull(), F.concat(F.lit(f"{d}={w:g}→"), _plain(F.lit(w) / total, 3))) for d, w in WEIGHTS.items()]
    skipped = F.array_join(F.array_compact(F.array(*[F.when(score[d].isNull(), d) for d in WEIGHTS])), ", ")
    used = [F.when(score[d].isNotNull(), said[d]) for d in WEIGHTS]
    out = F.concat(F.lit("final quality "), _plain(quality, 3), F.lit(" — "), F.concat_ws(" | ", *used), F.lit(" | weights "), F.concat_ws(" ", *weights), F.when(F.length(skipped) > 0, F.concat(F.lit(" (skipped: "), skipped, F.lit(")"))).otherwise(""))
    return F.when(total > 0, out)
