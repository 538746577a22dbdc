"""Scenes: gap sessions, ranks, best picks, and the current selection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import mock_embedding, pick_score

GAP_SECONDS = 900
#: How a grouping was made; the second is added where an embedding provider is at hand.
VERSION, WITH_EMBEDDINGS = "code-time-1.0", "+scene_embedding-pending"
TOP_K = 5


@dataclass(frozen=True)
class EmbeddingProvider:
    """Embeddings for scenes: `embed` gives (id, embedding) of rows. Grouping by time never asks for them."""

    available: Callable[[], bool]
    embed: Callable[[DataFrame], DataFrame]


def mock_embeddings(dim: int = 16) -> EmbeddingProvider:
    return EmbeddingProvider(lambda: True, lambda rows: rows.select("id", mock_embedding(F.col("id").cast("string"), dim).alias("embedding")))


def versioned(rows: DataFrame, provider: EmbeddingProvider | None = None) -> DataFrame:
    """rows with algorithm_version: of grouping by time, marked if embeddings could have been had."""
    return rows.withColumn("algorithm_version", F.lit(VERSION + (WITH_EMBEDDINGS if provider is not None and provider.available() else "")))


def sessions(rows: DataFrame, key: str = "trip_id", time: str = "captured_at", tie: str = "id", gap: float = GAP_SECONDS) -> DataFrame:
    """rows with group_index from 0: a new group begins where the time since the row before is over the gap."""
    order = Window.partitionBy(key).orderBy(F.col(time), F.col(tie))
    seconds = F.col(time).cast("timestamp").cast("double")
    new = (seconds - F.lag(seconds).over(order) > gap).cast("int")
    return rows.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn("group_index", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def ranked(rows: DataFrame, keys: tuple[str, ...] = ("trip_id", "group_index"), quality: str = "quality") -> DataFrame:
    """rows with rank_in_group from 0: best quality first, unknown last, then by id."""
    return rows.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(quality).desc_nulls_last(), F.col("id"))) - 1)


def summaries(rows: DataFrame, key: str = "trip_id", time: str = "captured_at", quality: str = "quality") -> DataFrame:
    """(key, group_index, start, end, member_count, representative) of sessions."""
    best = F.min_by("id", F.struct(F.col(quality).isNull().alias("n"), (-F.col(quality)).alias("q"), F.col("id").alias("i")))
    return rows.groupBy(key, "group_index").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("member_count"), best.alias("representative"))


def picks(rows: DataFrame, keys: tuple[str, ...] = ("trip_id", "group_index"), k: int = TOP_K) -> DataFrame:
    """The first k members of each scene by pick score, with place from 0.

    Columns used: quality, ai_blur_class, is_blurry, is_duplicate, rank_in_group, created_at, id.
    """
    scored = rows.withColumn("score", pick_score(F.col("quality"), F.col("ai_blur_class"), F.col("is_blurry"), F.col("is_duplicate")))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "rank_in_group", "created_at", "id")
    return scored.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k)


def decided(top: DataFrame, answers: DataFrame, keys: tuple[str, ...] = ("trip_id", "group_index")) -> DataFrame:
    """Drafts: the top members of each scene with included and decision.

    answers: keys, best_id, status ('success', 'failed', 'unsupported', 'malformed'). A model's choice counts if it
    succeeded and is among the top; a scene of one needs no model; else the first member is taken.
    """
    size = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.collect_set("id").alias("__ids"), F.min_by("id", "place").alias("__first"))
    said = size.join(answers, list(keys), "left")
    ok = (F.col("status") == "success") & F.array_contains("__ids", F.col("best_id"))
    decision = F.when(F.col("__n") == 1, "single_member").when(F.col("status").isNull(), "code_fallback_no_model").when(ok, "model").when(F.col("status") == "success", "code_fallback_outside_top").otherwise(F.concat(F.lit("code_fallback_"), "status"))
    chosen = said.select(*keys, decision.alias("decision"), F.when(F.coalesce(ok, F.lit(False)) & (F.col("__n") > 1), F.col("best_id")).otherwise(F.col("__first")).alias("__best"))
    return top.join(chosen, list(keys)).withColumn("included", F.col("id") == F.col("__best")).drop("__best")


def summary(outcomes: DataFrame, column: str = "decision") -> DataFrame:
    """Counts of scenes by how they were decided."""
    c = F.col(column)
    return outcomes.agg(F.count(F.lit(1)).alias("scenes"), F.count_if(c == "model").alias("by_model"), F.count_if(c == "single_member").alias("single"), F.count_if(c.startswith("code_fallback_")).alias("fallback"), F.count_if(c.startswith("skipped_")).alias("skipped"))


def current_selection(selections: DataFrame) -> DataFrame:
    """(trip_id, media_id, origin): members of the latest current round and pinned ones, without the excluded.

    selections: trip_id, media_id, selection_round (0: a user's override), included, is_current, user_decision.
    """
    rounds = selections.where("selection_round >= 1 and is_current")
    last = rounds.groupBy("trip_id").agg(F.max("selection_round").alias("selection_round"))
    model = rounds.where("included").join(last, ["trip_id", "selection_round"]).select("trip_id", "media_id", F.lit("model").alias("origin"))
    user = selections.where("selection_round = 0")
    pins = user.where("user_decision = 'kept'").select("trip_id", "media_id", F.lit("user").alias("origin"))
    out = user.where("user_decision = 'excluded'").select("trip_id", "media_id")
    both = model.unionByName(pins).groupBy("trip_id", "media_id").agg(F.max("origin").alias("origin"))
    return both.join(out, ["trip_id", "media_id"], "left_anti")


def idle_trips(trips: DataFrame, now: Column, quiet_seconds: int = 600) -> DataFrame:
    """Trips whose last upload is old enough and newer than their last curation."""
    t = lambda c: c.cast("timestamp").cast("double")
    last = F.col("last_upload_at")
    return trips.where((t(now) - t(last) >= quiet_seconds) & (F.col("last_curation_at").isNull() | (last > F.col("last_curation_at"))))
