"""Classifiers and scores of media records as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp01, finite, round_to


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


# --- blur ------------------------------------------------------------------------------------------
def blur_class(variance: Column, blurry: float = 50.0, maybe: float = 120.0) -> Column:
    """blurry under 50, sharp from 120 on, maybe-blurry between; null if not finite."""
    return F.when(finite(variance), F.when(variance < blurry, "blurry").when(variance >= maybe, "sharp").otherwise("maybe-blurry"))


def is_blurry(variance: Column, **thresholds: float) -> Column:
    """True, false, or null for what lies between."""
    cls = blur_class(variance, **thresholds)
    return F.when(cls == "blurry", True).when(cls == "sharp", False)


def sharpness(variance: Column, maybe: float = 120.0) -> Column:
    """Variance over twice the sharp threshold, within 0 and 1; 0 for what is not finite."""
    return clamp01(variance / (2 * maybe))


# --- exposure --------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Exposure:
    under: float = 70.0
    over: float = 185.0
    dark: float = 0.5
    bright: float = 0.5
    mixed: float = 0.25


def exposure_class(mean: Column, dark: Column, bright: Column, t: Exposure = Exposure()) -> Column:
    under, over = (mean < t.under) | (dark > t.dark), (mean > t.over) | (bright > t.bright)
    both = (dark > t.mixed) & (bright > t.mixed)
    return F.when(both | (under & over), "mixed-exposure").when(under, "underexposed").when(over, "overexposed").otherwise("well-exposed")


def exposure_score(mean: Column, dark: Column, bright: Column, t: Exposure = Exposure()) -> Column:
    cls = exposure_class(mean, dark, bright, t)
    under = clamp01(mean / t.under) if t.under > 0 else F.lit(0.0)
    over = clamp01((255 - mean) / (255 - t.over)) if t.over < 255 else F.lit(0.0)
    return F.when(cls == "well-exposed", F.lit(1.0)).when(cls == "mixed-exposure", clamp01(1 - F.greatest(dark, bright))).when(cls == "underexposed", under).otherwise(over)


# --- colour ----------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Colour:
    low_saturation: float = 0.1
    high_saturation: float = 0.75
    cast: float = 30.0
    low_contrast: float = 30.0
    high_contrast: float = 90.0


def _level(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, "low").when(x > high, "high").otherwise("normal")


def colour_cast(r: Column, g: Column, b: Column, t: Colour = Colour()) -> Column:
    """balanced, or the cast of the channel means that lie apart by the threshold or more."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    magenta = (g == low) & (F.abs(r - b) < t.cast / 2) & ((r + b) / 2 - g >= t.cast)
    return F.when(top - low < t.cast, "balanced").when(magenta, "magenta-cast").when(top == r, "warm-cast").when(top == g, "green-cast").otherwise("cool-cast")


def colour_labels(r: Column, g: Column, b: Column, saturation: Column, contrast: Column, t: Colour = Colour()) -> Column:
    """Labels of what is off about saturation, cast and contrast, in that order; color-balanced if nothing is."""
    sat, con, cast = _level(saturation, t.low_saturation, t.high_saturation), _level(contrast, t.low_contrast, t.high_contrast), colour_cast(r, g, b, t)
    found = F.array_compact(F.array(
        F.when(sat != "normal", F.concat(F.lit("color-"), sat, F.lit("-saturation"))),
        F.when(cast != "balanced", F.concat(F.lit("color-"), cast)),
        F.when(con != "normal", F.concat(F.lit("color-"), con, F.lit("-contrast"))),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("color-balanced")))


def colour_score(r: Column, g: Column, b: Column, saturation: Column, contrast: Column, t: Colour = Colour()) -> Column:
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    half = lambda level: F.when(level == "normal", 1.0).otherwise(0.5)
    cast = F.when(colour_cast(r, g, b, t) == "balanced", F.lit(1.0)).otherwise(clamp01(1 - F.greatest(F.lit(0.0), spread - t.cast) / 255))
    return F.least(half(_level(saturation, t.low_saturation, t.high_saturation)), cast, half(_level(contrast, t.low_contrast, t.high_contrast)))


# --- overall quality -------------------------------------------------------------------------------
WEIGHTS = {"blur": 0.45, "exposure": 0.35, "color": 0.20}


def quality_score(blur: Column, exposure: Column, color: Column, weights: dict[str, float] | None = None, floor: float = 0.5) -> Column:
    """Weighted mean of the scores that are there, weights scaled anew; colour counts from the floor up; null if none is there."""
    weights = weights or WEIGHTS
    held = min(max(floor, 0.0), 1.0)
    dims = [(blur, blur, weights["blur"]), (exposure, exposure, weights["exposure"]), (color, held + (1 - held) * clamp01(color), weights["color"])]
    dims = [d for d in dims if d[2] > 0]
    total = sum((F.when(finite(raw), F.lit(w)).otherwise(F.lit(0.0)) for raw, _, w in dims), F.lit(0.0))
    score = sum((F.when(finite(raw), value * w).otherwise(F.lit(0.0)) for raw, value, w in dims), F.lit(0.0))
    return F.when(total > 0, clamp01(score / total))


PICK_FACTORS = {"sharp": 1.0, "maybe_blurry": 0.7, "blurry": 0.3}


def pick_score(quality: Column, ai_blur: Column, blurry: Column, duplicate: Column) -> Column:
    """Score of a scene member: quality (0.5 if unknown) by sharpness, less 0.2 for duplicates; not clamped."""
    factor = F.coalesce(lookup(PICK_FACTORS, ai_blur), F.when(blurry.cast("int") == 1, 0.5).otherwise(1.0))
    return F.coalesce(quality, F.lit(0.5)) * factor - F.when(duplicate.cast("int") == 1, 0.2).otherwise(0.0)


# --- files -----------------------------------------------------------------------------------------
#: Fixed values of file formats.
HEIC_BRANDS = ("heic", "heix", "heim", "heis", "mif1", "msf1")
MP4_BRANDS = ("isom", "iso2", "iso3", "iso4", "iso5", "iso6", "mp41", "mp42", "mp4v", "avc1", "mmp4", "dash", "f4v ")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "heic")
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "avi", "mkv")
EXTENSION_FORMATS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "heic": "heic", "mp4": "mp4,m4v", "mov": "mov", "m4v": "m4v,mp4", "avi": "avi", "mkv": "mkv"}
IMAGE_FORMATS = ("jpeg", "png", "webp", "heic")


def magic_format(head: Column) -> Column:
    """Format of the first bytes of a file, or null."""
    digits, part = F.hex(F.substring(head, 1, 16)), lambda a, n: F.decode(F.substring(head, a, n), "ISO-8859-1")
    brand = F.lower(part(9, 4))
    ftyp = F.when(brand.isin(*HEIC_BRANDS), "heic").when(brand == "qt  ", "mov").when(brand == "m4v ", "m4v").when(brand.isin(*MP4_BRANDS), "mp4")
    riff = F.when(part(9, 4) == "WEBP", "webp").when(part(9, 4) == "AVI ", "avi")
    return F.when(digits.startswith("FFD8FF"), "jpeg").when(digits.startswith("89504E470D0A1A0A"), "png").when(digits.startswith("52494646") & riff.isNotNull(), riff).when(digits.startswith("1A45DFA3"), "mkv").when(part(5, 4) == "ftyp", ftyp)


def extension(name: Column) -> Column:
    """Lower-cased extension of a file name: after the last dot, if that is neither first nor last."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    found = F.lower(F.regexp_extract(base, r"^.+\.([^.]+)$", 1))
    return F.when(found != "", found)


def plain_mime(mime: Column) -> Column:
    """Media type without parameters, lower-cased; null if empty or application/octet-stream."""
    main = F.trim(F.split_part(F.lower(F.trim(mime)), F.lit(";"), F.lit(1)))
    return F.when((main != "") & (main != "application/octet-stream"), main)


def classified(name: Column, mime: Column, head: Column) -> Column:
    """struct(type, extension, mime, problem): unknown with the first problem, else the type that the bytes show."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    ext, kind, fmt = extension(trimmed), plain_mime(mime), magic_format(head)
    image = fmt.isin(*IMAGE_FORMATS)
    kind_of = F.when(image, "image").otherwise("video")
    ext_type = F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video").otherwise("none")
    expected = lookup(EXTENSION_FORMATS, ext)
    problem = (
        F.when(trimmed == "", "empty_name")
        .when(fmt.isNull() & (F.coalesce(F.octet_length(head), F.lit(0)) == 0), "empty_head")
        .when(fmt.isNull() & (ext_type != "none"), "magic_missing_for_extension")
        .when(fmt.isNull() & (F.octet_length(head) < 12), "head_too_short")
        .when(fmt.isNull(), "magic_missing")
        .when(ext.isNotNull() & (ext_type != kind_of), F.when(ext_type == "none", "extension_not_allowed").otherwise("extension_of_other_type"))
        .when(expected.isNotNull() & ~F.array_contains(F.split(expected, ","), fmt), "extension_of_other_format")
        .when(kind.isNotNull() & ~kind.startswith(F.concat(kind_of, F.lit("/"))), F.when(kind.rlike("^(image|video)/"), "mime_of_other_type").otherwise("mime_of_neither_type"))
    )
    return F.struct(F.when(problem.isNull(), kind_of).otherwise("unknown").alias("type"), ext.alias("extension"), kind.alias("mime"), problem.alias("problem"))


# --- video -----------------------------------------------------------------------------------------
def cover_seek(duration: Column) -> Column:
    """Where to take a cover: 0 without a duration, the middle of short videos, at most 5 s."""
    d = F.coalesce(duration, F.lit(0.0))
    return F.when(d <= 0, 0.0).when(d < 2, d / 2).otherwise(F.least(d / 2, F.lit(5.0)))


def render_width(height: Column, aspect: Column) -> Column:
    """Width of a rendering: the rounded product, made even."""
    w = F.floor(height * aspect + 0.5).cast("long")
    return w + w % 2


def captured_at(metadata_json: Column, created: Column) -> Column:
    """Time of capture from metadata, or else when the row was made."""
    return F.coalesce(F.try_to_timestamp(F.get_json_object(metadata_json, "$.DateTimeOriginal")).cast("timestamp_ntz"), created)


def audio_policy(mode: Column, wanted_id: Column, found_id: Column, loudnorm: bool = True, fade_in: float = 1.0, fade_out: float = 2.0) -> Column:
    """struct(mode, background_id, remove_original, loudnorm, fade_in, fade_out, loop) of a plan's audio request."""
    asked = F.coalesce(mode, F.when(F.coalesce(wanted_id, F.lit("")) != "", "replace_with_library").otherwise("keep_original"))
    final = F.when((asked == "replace_with_library") & found_id.isNull(), "keep_original").when(asked.isin("mute", "replace_with_library"), asked).otherwise("keep_original")
    library, mute = final == "replace_with_library", final == "mute"
    fade = lambda x: F.when(mute, 0.0).otherwise(x)
    return F.struct(final.alias("mode"), F.when(library, found_id).alias("background_id"), (library | mute).alias("remove_original"), (library & F.lit(loudnorm)).alias("loudnorm"), fade(fade_in).alias("fade_in"), fade(fade_out).alias("fade_out"), library.alias("loop"))


# --- model answers ---------------------------------------------------------------------------------
def blur_verdict(answer: Column) -> Column:
    """struct(blur_class, reason) of a model's JSON answer; null unless the class is known and the reason is not empty."""
    got = F.from_json(answer, "blurClass string, reason string")
    return F.when(got["blurClass"].isin("sharp", "maybe_blurry", "blurry") & (F.length(F.trim(got["reason"])) > 0), got)


def pick_verdict(answer: Column, allowed: Column) -> Column:
    """struct(bestMediaId, reason, confidence) of a model's answer; null unless the choice is allowed and the reason is not empty."""
    got = F.from_json(answer, "bestMediaId string, reason string, confidence double")
    return F.when(F.array_contains(allowed, got["bestMediaId"]) & (F.length(F.trim(got["reason"])) > 0), got)


def mock_blur_class(key: Column) -> Column:
    """A repeatable stand-in for a model: the sum of the first four bytes of a hash, modulo 3."""
    h = F.sha2(key.cast("binary"), 256)
    total = sum((F.conv(F.substring(h, 1 + 2 * k, 2), 16, 10).cast("int") for k in range(4)), F.lit(0))
    return F.element_at(F.array(F.lit("sharp"), F.lit("maybe_blurry"), F.lit("blurry")), (total % 3 + 1).cast("int"))


def mock_embedding(key: Column, dim: int = 16) -> Column:
    """dim numbers in [-1, 1) from the bytes of a hash."""
    h = F.sha2(key.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.conv(F.substring(h, (1 + 2 * (i % 32)).cast("int"), F.lit(2)), 16, 10).cast("double") - 128) / 128)


def reason_of_rank(quality: Column, best: Column, members: Column) -> Column:
    return F.when(quality.isNotNull(), F.format_string("recommended - quality %s (best of %d)", round_to(quality, 3), members)).otherwise(F.format_string("recommended - no quality yet; chosen by tie-breakers among %d", members))
