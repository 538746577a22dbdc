"""Orders, firsts, latest rows and ranks within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import written

SOURCE_ORDER = {"system": 0, "user": 1, "url_import": 2}


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group; Spark prunes to one row per group and task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def top_per(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 0."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col(rank) < k)


def latest_per(df: DataFrame, keys: list[str], time: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest row of each group, as an aggregate (combined before the shuffle, so hot groups do no harm)."""
    best = F.max_by(F.struct(*df.columns), F.struct(time, tie)).alias("r")
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(best).select("r.*")


def first_thumbnail(media: DataFrame) -> DataFrame:
    """(trip_id, media_id, thumbnail_path) of the oldest active image with a thumbnail."""
    rows = media.where("type = 'image' and deleted_at is null and thumbnail_path is not null")
    return rows.groupBy("trip_id").agg(F.min_by(F.struct(F.col("id").alias("media_id"), "thumbnail_path"), F.struct("created_at", "id")).alias("x")).select("trip_id", "x.media_id", "x.thumbnail_path")


def cover_candidates(media: DataFrame, analysis: DataFrame) -> DataFrame:
    """(trip_id, media_id): the best active image of each trip that is not blurry and has a quality."""
    from .filters import not_blurry

    both = media.where("type = 'image' and deleted_at is null").join(analysis.select(F.col("media_id").alias("id"), "quality_score", "is_blurry"), "id").where(F.col("quality_score").isNotNull() & not_blurry())
    best = both.groupBy("trip_id").agg(F.min_by("id", F.struct((-F.col("quality_score")).alias("q"), "created_at", "id")).alias("media_id"))
    return best


def audio_order() -> list[Column]:
    from ..functions.media import lookup

    return [F.coalesce(lookup(SOURCE_ORDER, F.col("source_type")), F.lit(9)), F.asc("name"), F.asc("id")]


EPSILON = 0.01
_SCORES = ("quality", "sharpness", "exposure", "color")
_VALUES = (*_SCORES, "resolution", "file_size")


#: Groups of at most so many members are ranked each within one task, larger ones in rounds over all tasks.
WITHIN = 100_000


def _heads(scores: Column) -> Column:
    """Of an array of distinct scores, those that begin a class: the best, then the best of all more than EPSILON below that ..."""
    none = F.array().cast("array<double>")
    return F.aggregate(F.sort_array(scores, asc=False), none, lambda kept, v: F.when((F.size(kept) == 0) | (F.element_at(kept, -1) - v > EPSILON), F.concat(kept, F.array(v))).otherwise(kept))


def _place(score: str, heads: Column) -> Column:
    """The class of a score: 1 for the best and all within EPSILON of it, 2 for the next best and all within EPSILON of that ...; null scores come last."""
    return F.when(F.col(score).isNull(), F.lit(1 << 30)).otherwise(F.size(F.filter(heads, lambda h: h >= F.col(score))))


def _classed_within(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """rows with the class of each score, one group in one task: all windows start with group_id, so one shuffle serves them all.

    The heads of a class are found in its first row only and spread from there.
    """
    keys = ["group_id"]
    for score in _SCORES:
        same, down = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score))
        whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.select("*", F.row_number().over(down).alias("__at"), F.collect_set(score).over(whole).alias("__all"))
        rows = rows.withColumn("__heads", F.when(F.col("__at") == 1, _heads(F.col("__all")))).drop("__at", "__all")
        rows = rows.withColumn("__heads", F.first("__heads", ignorenulls=True).over(same)).withColumn(f"{score}_class", _place(score, F.col("__heads"))).drop("__heads")
        keys = [*keys, f"{score}_class"]
    return rows, keys


def _classed_across(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The same, over all tasks: a round for each score gathers the heads of each class and joins them to its rows.

    A class's distinct scores are gathered, not its rows. Scores are rounded to four places where they are made, so there
    are 10,001 at most, however large the group. Heads are written, or each round would run all rounds before it twice.
    """
    keys = ["group_id"]
    for score in _SCORES:
        scores = rows.where(F.col(score).isNotNull()).select(*keys, score).distinct()
        heads = written(scores.groupBy(*keys).agg(_heads(F.collect_list(score)).alias("heads")), "heads")
        rows = rows.join(heads, keys, "left").withColumn(f"{score}_class", _place(score, F.col("heads"))).drop("heads")
        keys = [*keys, f"{score}_class"]
    return rows, keys


def _say(x: Column) -> Column:
    """A score to three places, without zeros at the end."""
    from ..functions.text import _plain

    other = F.regexp_replace(F.format_string("%.3f", F.floor(x * 1000 + 0.5) / 1000), r"\.?0+$", "")
    return F.when(x.isNull(), "n/a").when(F.abs(x) < 1e12, _plain(x, 3)).otherwise(other)


def _reasoned(rows: DataFrame) -> DataFrame:
    """rows with reason: why a member is kept or removed, the axis on which it lost. w_... are the winner's.

    Each number is written once, in a column of its own, not in every branch that names it.
    """
    q, w = F.col("quality"), F.col("w_quality")

    def lost(value) -> Column:
        out = F.when(F.lit(False), None)
        for name in _SCORES[1:]:
            x, y = F.col(name), F.col(f"w_{name}")
            out = out.when(y.isNotNull() & (x.isNull() | (y - x > EPSILON)), value(name))
        return out

    rows = rows.withColumns({"__axis": lost(F.lit), "__x": lost(F.col), "__y": lost(lambda name: F.col(f"w_{name}"))})
    rows = rows.withColumns({f"__said_{k}": _say(c) for k, c in (("q", q), ("w", w), ("x", F.col("__x")), ("y", F.col("__y")))})
    said, w_said = F.col("__said_q"), F.col("__said_w")
    best = F.when(q.isNotNull(), F.concat(F.lit("recommended: quality "), said, F.lit(", best of "), F.col("members"))).otherwise(F.concat(F.lit("recommended: no quality yet, first of "), F.col("members"), F.lit(" by tie-breakers")))
    out = F.when(F.col("rank") == 0, best).when(q.isNull() & w.isNotNull(), F.concat(F.lit("no quality yet; winner has "), w_said)).when(q.isNull(), "no quality for either; lost on tie-breakers")
    out = out.when(F.abs(q - w) > EPSILON, F.concat(F.lit("quality "), said, F.lit(" < winner "), w_said))
    tied = lambda name, x, y: F.concat(F.lit("tied on quality "), said, F.lit("; lost on "), name, F.lit(" "), x, F.lit(" < winner "), y)
    out = out.when(F.col("__axis").isNotNull(), tied(F.col("__axis"), F.col("__said_x"), F.col("__said_y")))
    for name in ("resolution", "file_size"):
        x, y = (F.coalesce(F.col(c), F.lit(0)) for c in (name, f"w_{name}"))
        out = out.when(y > x, tied(F.lit(name), x.cast("string"), y.cast("string")))
    return rows.withColumn("reason", out.otherwise(F.concat(F.lit("tied on quality "), said, F.lit("; lost on age or id"))))


def _order() -> list[Column]:
    """The order after the classes of scores."""
    return [*[F.coalesce(F.col(c), F.lit(0)).desc() for c in ("resolution", "file_size")], F.asc_nulls_last("created_at"), F.asc("media_id")]


def _ranked_within(rows: DataFrame) -> DataFrame:
    """rows with rank, members and w_...; each group within one task."""
    rows, keys = _classed_within(rows)
    order = Window.partitionBy("group_id").orderBy(*keys[1:], *_order())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    winner = F.first(F.struct(*[F.col(c).alias(f"w_{c}") for c in _VALUES])).over(whole)
    rows = rows.select("*", (F.row_number().over(order) - 1).alias("rank"), F.count(F.lit(1)).over(whole).alias("members"), winner.alias("w"))
    return rows.select("group_id", "media_id", "rank", "members", *_VALUES, "w.*")


def _ranked_across(rows: DataFrame) -> DataFrame:
    """The same for large groups: sorted class by class of the first two scores, in as many tasks; what ranks before a class is a count."""
    rows, keys = _classed_across(rows)
    rows = written(rows, "classes")  # read three times below
    part = keys[:3]
    order = Window.partitionBy(*part).orderBy(*keys[3:], *_order())
    before = Window.partitionBy("group_id").orderBy(*part[1:]).rowsBetween(Window.unboundedPreceding, -1)
    n = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    n = n.select(*part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("group_id")).alias("members"))
    first = F.struct(*keys[1:], *[-F.coalesce(F.col(c), F.lit(0)) for c in ("resolution", "file_size")], F.col("created_at").isNull(), "created_at", "media_id")
    winner = rows.groupBy("group_id").agg(F.min_by(F.struct(*[F.col(c).alias(f"w_{c}") for c in _VALUES]), first).alias("w")).select("group_id", "w.*")
    rows = rows.withColumn("__place", F.row_number().over(order)).join(n, part).withColumn("rank", (F.col("__before") + F.col("__place") - 1).cast("int"))
    return rows.join(winner, "group_id").select("group_id", "media_id", "rank", "members", *_VALUES, *[f"w_{c}" for c in _VALUES])


def ranked_duplicates(members: DataFrame, within: int = WITHIN) -> DataFrame:
    """(group_id, media_id, rank, recommendation, reason) of the members of duplicate groups; rows without a group are left out.

    Scores downward, with those within EPSILON tied and nulls last, then size, file size, age and id. A chain of scores each
    within EPSILON of the next is no tie of all: a class ends EPSILON below its best, so whoever leads by more stays ahead.
    Columns: group_id, media_id, quality, sharpness, exposure, color, resolution, file_size, created_at.
    Groups of at most `within` members take one shuffle in all; larger ones take rounds. Both ways give the same rows.
    """
    rows = members.where("group_id is not null").select("group_id", "media_id", *_SCORES, "resolution", "file_size", "created_at")
    rows = written(rows, "members")  # counted, then ranked
    large = written(rows.groupBy("group_id").count().where(F.col("count") > within).select("group_id"), "large")
    if large.isEmpty():
        rows = _ranked_within(rows)
    else:
        few = F.broadcast(large)  # one id for more than `within` rows
        rows = _ranked_within(rows.join(few, "group_id", "left_anti")).unionByName(_ranked_across(rows.join(few, "group_id", "left_semi")))
    return _reasoned(rows).select("group_id", "media_id", "rank", F.when(F.col("rank") == 0, "keep").otherwise("remove").alias("recommendation"), "reason")
