"""Video segments: interval joins, waste, carried-over decisions, timelines and edit plans."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp01, round_to
from .ranking import first_per

WASTE = ("none", "black", "blurry", "shaky", "duplicate")


#: Seconds of the time slots in which segments and frames meet.
SLOT = 10.0


def frames_in(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """Segments with each frame in [start, end): an equi-join on medium and time slot, then the range, so that a long medium is not compared whole."""
    slot = lambda c: F.floor(F.col(c) / SLOT)
    f = frames.select("media_id", "ts", "sharpness", slot("ts").alias("__slot"))
    s = segments.where(F.col("end") > F.col("start")).withColumn("__slot", F.explode(F.sequence(slot("start"), slot("end"))))
    return s.join(f, ["media_id", "__slot"]).where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))).select(*segments.columns, "ts", "sharpness")


def overlap_seconds(a1, a2, b1, b2):
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))


def covered_before(points: DataFrame, intervals: DataFrame, key: str = "media_id", slot: float = 600.0) -> DataFrame:
    """points (key, t, ...) with `covered`: seconds before t that the key's intervals (key, start, end) cover, each interval counted.

    A sweep instead of a join: the covered time before t is t * (starts - ends) - (sum of starts - sum of ends) over the starts and ends up to t,
    so points and ends are sorted once and running sums do the rest. Sums run within time slots of a key, and what lies in
    earlier slots is carried in from one row per slot: a long medium is spread over many tasks. Times count from their slot's start, so
    large times lose no digits.
    """
    low = F.floor(F.col("t") / slot)
    ends = intervals.where(F.col("end") > F.col("start")).select(key, F.explode(F.array(F.struct(F.col("start").cast("double").alias("t"), F.lit(1).alias("n")), F.struct(F.col("end").cast("double").alias("t"), F.lit(-1).alias("n")))).alias("e")).select(key, "e.*")
    both = points.withColumn("__point", F.lit(True)).withColumn("n", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    both = both.withColumn("__slot", low).withColumn("__rel", F.col("t") - F.col("__slot") * slot)
    sums = lambda w: [F.sum("n").over(w), F.sum(F.col("n") * F.col("__rel")).over(w)]
    # One row per slot: its ends' count and their covered time up to the slot's end, then what earlier slots carry in.
    totals = both.groupBy(key, "__slot").agg(F.sum("n").alias("tn"), F.sum(F.col("n") * (slot - F.col("__rel"))).alias("tc"))
    at = Window.partitionBy(key).orderBy("__slot")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("open", F.coalesce(F.sum("tn").over(before), F.lit(0)))
    # Between two slots with rows, whatever is open covers every second.
    gap = (F.col("__slot") - F.lag("__slot").over(at) - 1) * slot
    totals = totals.withColumn("__gap", F.coalesce(gap, F.lit(0.0)) * F.col("open"))
    base = F.coalesce(F.sum(F.col("tc") + F.col("open") * slot).over(before), F.lit(0.0)) + F.sum("__gap").over(at)
    totals = totals.select(key, "__slot", "open", base.alias("base"))
    within = Window.partitionBy(key, "__slot").orderBy("__rel")
    n, s = sums(within)
    rows = both.withColumn("rn", n).withColumn("rs", s).where("__point").join(totals, [key, "__slot"])
    return rows.withColumn("covered", F.col("base") + (F.col("open") + F.col("rn")) * F.col("__rel") - F.col("rs")).select(*points.columns, "covered")


def holding(points: DataFrame, intervals: DataFrame, key: str = "media_id", slack: float = 1e-9) -> DataFrame:
    """points (key, t, ...) with each interval (key, start, end, ...) that holds t, ends included: an index by size class.

    An interval of up to 2 ** c seconds lies in at most two slots of that width, so it is kept twice at most, and a point looks in one slot
    of each class that occurs. No key's intervals meet all its points.
    """
    width = lambda c: F.pow(F.lit(2.0), c)
    length = F.greatest(F.col("end") - F.col("start") + 2 * slack, F.lit(1e-3))
    kept = intervals.where(F.col("end") >= F.col("start")).withColumn("__class", F.ceil(F.log2(length)).cast("int"))
    slot = lambda t: F.floor(t / width(F.col("__class")))
    kept = kept.withColumn("__slot", F.explode(F.array_distinct(F.array(slot(F.col("start") - slack), slot(F.col("end") + slack)))))
    classes = kept.groupBy(key).agg(F.collect_set("__class").alias("__classes"))  # forty at most: powers of two between milliseconds and years
    probes = points.join(classes, key).withColumn("__class", F.explode("__classes")).drop("__classes").withColumn("__slot", slot(F.col("t")))
    return probes.join(kept, [key, "__class", "__slot"]).where((F.col("t") >= F.col("start") - slack) & (F.col("t") <= F.col("end") + slack)).drop("__class", "__slot")


def measured(segments: DataFrame, frames: DataFrame, black: DataFrame) -> DataFrame:
    """Segments (id, media_id, start, end) with mean sharpness of their frames (null without frames) and covered black seconds."""
    sharp = frames_in(segments, frames).groupBy("id").agg(F.avg("sharpness").alias("blur_score"))
    sides = F.explode(F.array(F.struct(F.col("start").cast("double").alias("t"), F.lit(-1).alias("side")), F.struct(F.col("end").cast("double").alias("t"), F.lit(1).alias("side")))).alias("e")
    points = segments.where(F.col("end") > F.col("start")).select("id", "media_id", sides).select("id", "media_id", "e.*")
    # Below 1e-9 seconds is what rounding leaves.
    total = F.sum(F.col("side") * F.col("covered"))
    dark = covered_before(points, black).groupBy("id").agg(F.when(total > 1e-9, total).otherwise(0.0).alias("black_seconds"))
    return segments.join(sharp, "id", "left").join(dark, "id", "left").withColumn("black_seconds", F.coalesce("black_seconds", F.lit(0.0)))


def judged(rows: DataFrame, black_at: float = 0.5, blurry_at: float = 0.25, good_at: float = 0.5) -> DataFrame:
    """Measured segments with black_ratio, waste_type, quality_score and is_recommended."""
    length = F.col("end") - F.col("start")
    rows = rows.withColumn("black_ratio", F.when(length > 0, clamp01(F.col("black_seconds") / length)).otherwise(0.0))
    waste = F.when(F.col("black_ratio") >= black_at, "black").when(F.col("blur_score") <= blurry_at, "blurry").otherwise("none")
    quality = F.when(F.col("blur_score").isNotNull(), clamp01(F.col("blur_score") * (1 - F.col("black_ratio"))))
    rows = rows.withColumn("waste_type", waste).withColumn("quality_score", quality)
    return rows.withColumn("is_recommended", (F.col("waste_type") == "none") & F.coalesce(F.col("quality_score") >= good_at, F.lit(False)))


def carried_decisions(new: DataFrame, old: DataFrame, least: float = 0.5) -> DataFrame:
    """new segments with user_decision of the decided old segment that overlaps most (share of the new length), if by half."""
    o = old.where("user_decision <> 'undecided'").select("media_id", "start", "end", F.col("id").alias("old_id"), F.col("user_decision").alias("__decision"))
    length = F.col("b") - F.col("a")
    # What covers that share of a segment holds one of the points that cut it into steps of the share: its middle, for a half.
    steps = max(1, math.ceil(1 / least) - 1)
    points = new.where(F.col("end") > F.col("start")).select("id", "media_id", F.col("start").alias("a"), F.col("end").alias("b")).withColumn("t", F.explode(F.array(*[F.col("a") + length * (least * j) for j in range(1, steps + 1)])))
    share = overlap_seconds(F.col("a"), F.col("b"), F.col("start"), F.col("end")) / length
    fits = holding(points, o).withColumn("share", share).where(F.col("share") >= least)
    best = first_per(fits.select("id", "share", F.col("start").alias("o1"), "old_id", "__decision"), ["id"], F.desc("share"), F.asc("o1"), F.asc("old_id"))
    return new.join(best.select("id", "old_id", "__decision"), "id", "left").withColumn("user_decision", F.coalesce("__decision", F.lit("undecided"))).drop("__decision")


def timeline(parts: DataFrame, key: str = "media_id", order: str = "seq", length: str = "seconds") -> DataFrame:
    """Parts of positive length with start and end on a common time line, in milliseconds' precision."""
    rows = parts.where(F.col(length) > 0)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length).over(before), F.lit(0.0))
    return rows.withColumn("start", round_to(start, 3)).withColumn("end", round_to(start + F.col(length), 3))


def edit_plan(candidates: DataFrame, key: str = "trip_id", order: tuple[str, ...] = ("created_at", "id"), length: str = "duration", target: float = 60.0, least_clip: float = 3.0) -> DataFrame:
    """Clips of each trip: an equal share of the target (3 s at least), cut at the target, in order.

    (key, id, clip_order, start, clip_seconds, total); the running sum makes the loop over clips a window.
    """
    w = Window.partitionBy(key)
    cap = F.greatest(F.lit(least_clip), F.lit(target) / F.count(F.lit(1)).over(w))
    rows = candidates.withColumn("__natural", F.least(F.col(length), cap))
    ordered = w.orderBy(*order)
    rows = rows.withColumn("start", F.coalesce(F.sum("__natural").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("clip_seconds", F.least(F.col("__natural"), F.lit(target) - F.col("start"))).where((F.col("start") < target - 1e-6) & (F.col("clip_seconds") > 0))
    rows = rows.withColumn("clip_order", F.row_number().over(ordered) - 1)
    return rows.withColumn("total", F.sum("clip_seconds").over(w)).drop("__natural")


def refined_plan(clips: DataFrame, refiner: Callable[[DataFrame], DataFrame] | None = None, key: str = "trip_id", target: float = 60.0) -> DataFrame:
    """The clips after an optional refiner (DataFrame -> DataFrame of the same columns), with ai_refined.

    A trip's refined plan is taken if it has clips, each once, all of the trip's own, numbered from 0 without gaps, of positive length, and
    within the target together; else the trip keeps its base plan. Without a refiner every plan is the base plan.
    """
    base = clips.withColumn("ai_refined", F.lit(False))
    if refiner is None:
        return base
    new = refiner(clips).select(*clips.columns)
    own = clips.select(key, "id", F.lit(True).alias("__own"))
    n = F.count(F.lit(1))
    checked = new.join(own, [key, "id"], "left").groupBy(key).agg(
        (F.count("__own") == n) & (F.count_distinct("id") == n) & (F.min("clip_order") == 0) & (F.max("clip_order") == n - 1) & (F.count_distinct("clip_order") == n) & (F.min("clip_seconds") > 0) & (F.sum("clip_seconds") <= target + 1e-6)
    ).toDF(key, "__ok")
    good = checked.where("__ok").select(key)
    return new.join(good, key, "left_semi").withColumn("ai_refined", F.lit(True)).unionByName(base.join(good, key, "left_anti"))


def transitions(clips: DataFrame, key: str = "trip_id") -> DataFrame:
    """(key, from_id, to_id, to_order) of neighbouring clips."""
    w = Window.partitionBy(key).orderBy("clip_order")
    return clips.select(key, F.lag("id").over(w).alias("from_id"), F.col("id").alias("to_id"), F.col("clip_order").alias("to_order")).where("from_id is not null")


def keyframe_times(media: DataFrame, interval: float = 1.0, most: int = 300, key: str = "id") -> DataFrame:
    """(key, frame, ts): frames every interval seconds, or fewer apart if there would be too many."""
    d = F.col("duration")
    step = F.when(F.ceil(d / interval) > most, d / most).otherwise(F.lit(interval))
    n = F.greatest(F.least(F.ceil(d / interval), F.lit(most)), F.lit(1)).cast("int")
    rows = media.where(d > 0).select(key, step.alias("step"), F.explode(F.sequence(F.lit(1), n)).alias("frame"))
    return rows.select(key, "frame", ((F.col("frame") - 1) * F.col("step")).alias("ts"))


def first_source(candidates: DataFrame, order: tuple[str, ...] = ("thumbnail", "preview", "ai_refined", "enhanced", "original")) -> DataFrame:
    """(media_id, kind, path): the first kind in order whose file can be read."""
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    ok = candidates.where(F.col("readable") & (place > 0))
    return ok.groupBy("media_id").agg(F.min_by(F.struct("kind", "path"), place).alias("x")).select("media_id", "x.kind", "x.path")


def decode_source(media: DataFrame, proxies: DataFrame) -> DataFrame:
    """(id, source, path): a usable proxy (a path and bytes), else the original."""
    p = proxies.select(F.col("media_id").alias("id"), F.when(F.col("file_path").isNotNull() & (F.col("file_size") > 0), F.col("file_path")).alias("proxy"))
    return media.join(p, "id", "left").select("id", F.when(F.col("proxy").isNotNull(), "proxy").otherwise("original").alias("source"), F.coalesce("proxy", "original_path").alias("path"))
