"""Upserts, merges, decisions and cascades as rewrites of whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import cover_candidates, first_thumbnail


def upserted(base: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """base with the rows of new: equal keys take new values (except `keep`), others are added; plus outcome.

    outcome is inserted, updated, unchanged, or kept (rows that new does not mention).
    """
    cols = base.columns
    n = new.select(*[F.col(c).alias(f"__n_{c}") for c in cols]).withColumn("__new", F.lit(True))
    b = base.withColumn("__old", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"__n_{k}")) for k in key]
    both = b.join(n, on, "full_outer")
    rest = [c for c in cols if c not in key and c not in keep]
    same = F.lit(True)
    for c in rest:
        same = same & F.col(c).eqNullSafe(F.col(f"__n_{c}"))
    outcome = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    take = lambda c: F.when(F.col("__new").isNull(), F.col(c)).when(F.col("__old").isNull(), F.col(f"__n_{c}")).otherwise(F.col(c) if c in keep or c in key else F.col(f"__n_{c}")).alias(c)
    return both.select(*[take(c) for c in cols], outcome.alias("outcome"))


def merged_dimension(base: DataFrame, new: DataFrame, own: list[str], key: str = "media_id") -> DataFrame:
    """base with the columns that one dimension owns taken from new; other columns stay; absent rows are added."""
    n = new.select(key, *[F.col(c).alias(f"__n_{c}") for c in own], F.lit(True).alias("__new"))
    both = base.join(n, key, "full_outer")
    return both.select(*[F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in base.columns])


def merged_labels(old: Column, new: Column, owned: tuple[str, ...]) -> Column:
    """Old labels that the dimension does not own, with repeats and in order, then its new ones that are not there yet."""
    base = F.coalesce(old, F.array().cast("array<string>"))
    kept = F.filter(base, lambda x: ~x.isin(*owned)) if owned else base
    return F.transform(F.array(kept), lambda k: F.concat(k, F.filter(F.array_distinct(F.coalesce(new, F.array().cast("array<string>"))), lambda x: ~F.array_contains(k, x))))[0]


def labels_of(json: Column) -> Column:
    """Labels from JSON text; none if it is malformed."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def merged_json(raw: Column, name: str, value: Column) -> Column:
    """A JSON object with one member set, and the others as they were; malformed or null begins anew."""
    old = F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, v: k != name), F.create_map(F.lit(name), value.cast("string"))))


def replaced(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base without the rows of keys that new has, and new."""
    return base.join(new.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def confirmed(groups: DataFrame, items: DataFrame, winners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and items after users chose winners (group_id, media_id): the winner is kept, the others are removed.

    A winner that is no member changes nothing.
    """
    w = winners.select("group_id", F.col("media_id").alias("__w")).join(items.select("group_id", F.col("media_id").alias("__w")), ["group_id", "__w"], "left_semi")
    g = groups.join(w.select(F.col("group_id").alias("id"), "__w"), "id", "left").withColumn("recommended_media_id", F.coalesce("__w", "recommended_media_id")).withColumn("user_confirmed", F.col("user_confirmed") | F.col("__w").isNotNull()).select(*groups.columns)
    decision = F.when(F.col("__w").isNull(), F.col("user_decision")).when(F.col("media_id") == F.col("__w"), "keep").otherwise("remove")
    return g, items.join(w, "group_id", "left").withColumn("user_decision", decision).select(*items.columns)


def recommended(groups: DataFrame, ranks: DataFrame) -> DataFrame:
    """Groups with the first of their ranking; groups that a user confirmed are never changed. Adds outcome."""
    first = ranks.where("rank = 0").select(F.col("group_id").alias("id"), F.col("media_id").alias("__best"))
    out = groups.join(first, "id", "left")
    outcome = F.when(F.col("user_confirmed"), "confirmed").when(F.col("__best").isNull(), "empty").otherwise("applied")
    return out.withColumn("outcome", outcome).withColumn("recommended_media_id", F.when(F.col("outcome") == "applied", F.col("__best")).otherwise(F.col("recommended_media_id"))).drop("__best")


def delete_others(groups: DataFrame, items: DataFrame) -> DataFrame:
    """(media_id) to delete: members recommended for removal, in groups that have a winner, except the winner."""
    w = groups.where("recommended_media_id is not null").select(F.col("id").alias("group_id"), "recommended_media_id")
    return items.where("recommendation = 'remove'").join(w, "group_id").where("media_id <> recommended_media_id").select("media_id").distinct()


def auto_cover(trips: DataFrame, media: DataFrame, analysis: DataFrame) -> DataFrame:
    """(id, cover_media_id, status): covers after automatic choice; pinned covers stay."""
    best = cover_candidates(media, analysis).select(F.col("trip_id").alias("id"), F.col("media_id").alias("__best"))
    out = trips.join(best, "id", "left")
    status = F.when(F.col("cover_set_by_user"), "pinned").when(F.col("__best").isNull(), "no_candidate").when(F.col("__best").eqNullSafe(F.col("cover_media_id")), "unchanged").otherwise("applied")
    return out.select("id", F.when(status == "applied", F.col("__best")).otherwise(F.col("cover_media_id")).alias("cover_media_id"), status.alias("status"))


def cover_urls(trips: DataFrame, media: DataFrame, placeholder: str = "/static/placeholder.svg") -> DataFrame:
    """(id, cover_url): the cover's thumbnail, else the first thumbnail of the trip, else a placeholder."""
    own = media.where("deleted_at is null and type = 'image'").select(F.col("id").alias("cover_media_id"), F.col("thumbnail_path").alias("__own"))
    first = first_thumbnail(media).select(F.col("trip_id").alias("id"), F.col("thumbnail_path").alias("__first"))
    return trips.select("id", "cover_media_id").join(own, "cover_media_id", "left").join(first, "id", "left").select("id", F.coalesce("__own", "__first", F.lit(placeholder)).alias("cover_url"))


def soft_deleted(media: DataFrame, groups: DataFrame, trips: DataFrame, gone: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(media, groups, trips, selector jobs) after media (id) are deleted: marks, cleared recommendations and covers, groups to rank anew."""
    ids = gone.select("id").distinct().withColumn("__gone", F.lit(True))
    hit = F.col("__gone").isNotNull() & F.col("deleted_at").isNull()
    m = media.join(ids, "id", "left").withColumn("status", F.when(hit, "deleted").otherwise(F.col("status"))).withColumn("deleted_at", F.when(hit, now).otherwise(F.col("deleted_at"))).select(*media.columns)
    r = ids.withColumnRenamed("id", "recommended_media_id")
    marked = groups.join(r, "recommended_media_id", "left")
    g = marked.withColumn("recommended_media_id", F.when(F.col("__gone").isNull(), F.col("recommended_media_id"))).select(*groups.columns)
    c = ids.withColumnRenamed("id", "cover_media_id")
    t = trips.join(c, "cover_media_id", "left").withColumn("cover_set_by_user", F.col("cover_set_by_user") & F.col("__gone").isNull()).withColumn("cover_media_id", F.when(F.col("__gone").isNull(), F.col("cover_media_id"))).select(*trips.columns)
    jobs = marked.where("__gone").select(F.concat(F.lit("quality_selector_run:"), F.col("id").cast("string")).alias("dedupe_key"), F.col("trip_id")).distinct()
    return m, g, t, jobs


def restored(media: DataFrame, back: DataFrame) -> DataFrame:
    """media with the deleted ones of `back` (id) active again, as pending."""
    ids = back.select("id").distinct().withColumn("__back", F.lit(True))
    hit = F.col("__back").isNotNull() & F.col("deleted_at").isNotNull()
    return media.join(ids, "id", "left").withColumn("__hit", hit).withColumn("status", F.when(F.col("__hit"), "pending").otherwise(F.col("status"))).withColumn("deleted_at", F.when(~F.col("__hit"), F.col("deleted_at"))).select(*media.columns)


def selected_version(media: DataFrame, wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, active_version_type, outcome) after choosing versions: the target must exist; the same one changes nothing."""
    there = versions.where("status = 'ready' and deleted_at is null").select(F.col("media_id").alias("id"), F.col("version_type").alias("target"), F.lit(True).alias("__there"))
    rows = media.join(wanted.select("id", "target"), "id").join(there, ["id", "target"], "left")
    exists = F.coalesce("__there", F.lit(False)) | ((F.col("target") == "original") & F.col("original_path").isNotNull())
    outcome = F.when(~exists, "missing_version").when(F.coalesce("active_version_type", F.lit("original")) == F.col("target"), "unchanged").otherwise("applied")
    return rows.select("id", F.when(outcome == "applied", F.col("target")).otherwise(F.col("active_version_type")).alias("active_version_type"), outcome.alias("outcome"))


def overridden(selections: DataFrame, decisions: DataFrame) -> DataFrame:
    """selections with users' decisions (trip_id, media_id, user_decision) as rows of round 0; the newest wins, null takes it back."""
    rest = selections.where("selection_round <> 0")
    own = selections.where("selection_round = 0").join(decisions.select("trip_id", "media_id"), ["trip_id", "media_id"], "left_anti").select(*selections.columns)
    new = decisions.where("user_decision is not null").select("trip_id", "media_id", F.lit(0).alias("selection_round"), (F.col("user_decision") == "kept").alias("included"), F.lit(False).alias("is_current"), "user_decision")
    return rest.unionByName(own).unionByName(new, allowMissingColumns=True).select(*selections.columns)


def current_round(selections: DataFrame, trip, round_: int) -> DataFrame:
    """selections in which one round of a trip is current, and no other of it."""
    mine = (F.col("trip_id") == F.lit(trip)) & (F.col("selection_round") > 0)
    return selections.withColumn("is_current", F.when(mine, F.col("selection_round") == round_).otherwise(F.col("is_current")))


def pinned_covers(trips: DataFrame, pins: DataFrame, resets: DataFrame) -> DataFrame:
    """trips after users pinned covers (id, media_id) or took their pins back (id)."""
    p = pins.select("id", F.col("media_id").alias("__pin")).withColumn("__pinned", F.lit(True))
    r = resets.select("id").withColumn("__reset", F.lit(True))
    out = trips.join(p, "id", "left").join(r, "id", "left")
    cover = F.when(F.col("__pinned"), F.col("__pin")).when(F.col("__reset").isNull(), F.col("cover_media_id"))
    flag = F.when(F.col("__pinned"), True).when(F.col("__reset"), False).otherwise(F.col("cover_set_by_user"))
    return out.withColumn("cover_set_by_user", flag).withColumn("cover_media_id", cover).select(*trips.columns)


def decided_once(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows with users' decisions (id, decision) and outcome: applied, already_applied, or not_asked."""
    d = decisions.select("id", F.col("decision").alias("__d"))
    out = rows.join(d, "id", "left")
    outcome = F.when(F.col("__d").isNull(), "not_asked").when(F.col("user_decision").eqNullSafe(F.col("__d")), "already_applied").otherwise("applied")
    return out.withColumn("outcome", outcome).withColumn("user_decision", F.coalesce("__d", "user_decision")).drop("__d")
