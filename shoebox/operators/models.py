"""Model calls: providers as Arrow UDFs, answers cached by content, quotas and the audit log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import mock_blur_class
from .ranking import latest_per

CACHE_KEY = ("trip_id", "request_type", "target_type", "target_id", "input_hash")


def noop(requests: DataFrame) -> DataFrame:
    """A provider that supports nothing."""
    return requests.withColumn("status", F.lit("failed")).withColumn("response", F.lit(None).cast("string"))


def local_mock(requests: DataFrame) -> DataFrame:
    """A repeatable provider: blur classes from hashes of the input."""
    answer = F.to_json(F.struct(mock_blur_class(F.col("input_hash")).alias("blurClass"), F.lit("mock").alias("reason")))
    known = F.col("request_type") == "ai_blur_check"
    return requests.withColumn("status", F.when(known, "success").otherwise("failed")).withColumn("response", F.when(known, answer))


PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"noop": noop, "local-mock": local_mock}


def provider(name: str) -> Callable[[DataFrame], DataFrame]:
    """A registered provider; unknown names do nothing."""
    return PROVIDERS.get(name, noop)


def cached_answers(requests: DataFrame, log: DataFrame) -> DataFrame:
    """requests with the newest successful answer of equal key (nulls equal nulls), and hit."""
    good = latest_per(log.where("status = 'success'").select("id", *CACHE_KEY, "response_summary", "created_at"), list(CACHE_KEY))
    known = good.select(*[F.col(c).alias(f"__{c}") for c in CACHE_KEY], F.col("response_summary").alias("cached"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in CACHE_KEY]
    return requests.join(known, on, "left").drop(*[f"__{c}" for c in CACHE_KEY]).withColumn("hit", F.col("cached").isNotNull())


def answered(requests: DataFrame, log: DataFrame, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """requests with status, response and hit: cached answers, and one call for each distinct key that is missed."""
    seen = cached_answers(requests, log)
    keys = seen.where("not hit").select(*CACHE_KEY).distinct()
    new = call(keys).select(*[F.col(c).alias(f"__{c}") for c in CACHE_KEY], F.col("status").alias("__status"), F.col("response").alias("__response"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in CACHE_KEY]
    out = seen.join(new, on, "left")
    return out.select(*requests.columns, F.when(F.col("hit"), "success").otherwise(F.col("__status")).alias("status"), F.coalesce("cached", "__response").alias("response"), "hit")


def quotas(log: DataFrame, now: Column, daily: int, per_trip: int) -> DataFrame:
    """(trip_id, used_today, used, daily_reached, trip_reached); a limit of 0 is none. used_today is over all trips."""
    today = F.col("created_at") >= F.date_trunc("DAY", now)
    by = log.groupBy("trip_id").agg(F.count_if(today).alias("today"), F.count(F.lit(1)).alias("used"))
    total = by.agg(F.coalesce(F.sum("today"), F.lit(0)).alias("used_today"))
    reached = lambda c, most: F.lit(False) if most == 0 else F.col(c) >= most
    return by.crossJoin(F.broadcast(total)).select("trip_id", "used_today", "used", reached("used_today", daily).alias("daily_reached"), reached("used", per_trip).alias("trip_reached"))


def invocations_per_trip(log: DataFrame, media: DataFrame) -> DataFrame:
    """(trip_id, n) of calls whose medium is known."""
    m = media.select(F.col("id").alias("media_id"), F.col("trip_id").alias("__trip"))
    return log.join(m, "media_id").groupBy(F.col("__trip").alias("trip_id")).agg(F.count(F.lit(1)).alias("n"))


def audited(log: DataFrame, results: DataFrame) -> DataFrame:
    """log with results (id, status, response_summary, error_message) on rows that are pending; failures carry no summary."""
    r = results.select("id", F.col("status").alias("__s"), F.col("response_summary").alias("__r"), F.col("error_message").alias("__e"))
    hit = (F.col("status") == "pending") & F.col("__s").isin("success", "failed")
    out = log.join(r, "id", "left").withColumn("__hit", F.coalesce(hit, F.lit(False)))
    return out.withColumn("response_summary", F.when(F.col("__hit"), F.when(F.col("__s") == "success", F.col("__r"))).otherwise(F.col("response_summary"))).withColumn("error_message", F.when(F.col("__hit"), F.when(F.col("__s") == "failed", F.col("__e"))).otherwise(F.col("error_message"))).withColumn("status", F.when(F.col("__hit"), F.col("__s")).otherwise(F.col("status"))).select(*log.columns)


def refined_images(jobs: DataFrame, log: DataFrame, media: DataFrame, call: Callable[[DataFrame], DataFrame], available: bool = True) -> DataFrame:
    """(job_id, audit_id, media_id, problem, error_message, output, file_path): what becomes of jobs that refine an image.

    jobs: id, media_id. log: id, job_id, status. call: (media_id, path) -> status, output, error_message for the media that are asked
    for. The first problem that applies is told: no pending audit row, no active medium, not an image, no original, an empty original, no
    provider, the provider's failure, an empty output. Without a problem there is a file path for the new version.
    """
    audit = log.where("status = 'pending'").groupBy(F.col("job_id")).agg(F.min("id").alias("audit_id"))
    m = media.where("deleted_at is null").select(F.col("id").alias("media_id"), "type", "original_path", "file_size", F.lit(True).alias("__known"))
    rows = jobs.select(F.col("id").alias("job_id"), "media_id").join(audit, "job_id", "left").join(m, "media_id", "left")
    early = F.when(F.col("audit_id").isNull(), "no_pending_audit").when(F.col("__known").isNull(), "media_missing").when(F.col("type") != "image", "not_an_image").when(F.col("original_path").isNull(), "no_original").when(F.coalesce("file_size", F.lit(0)) == 0, "empty_original")
    rows = rows.withColumn("early", early if available else F.coalesce(early, F.lit("provider_unavailable")))
    asked = rows.where("early is null").select("media_id", F.col("original_path").alias("path")).distinct()
    made = call(asked).select("media_id", F.col("status").alias("__status"), "output", F.col("error_message").alias("__error"))
    out = rows.join(made, "media_id", "left")
    late = F.when(F.col("__status").isNull() | (F.col("__status") != "success"), "provider_failed").when(F.coalesce(F.octet_length("output"), F.lit(0)) == 0, "empty_output")
    out = out.withColumn("problem", F.coalesce("early", late))
    path = F.when(F.col("problem").isNull(), F.concat(F.lit("derived/"), F.col("media_id").cast("string"), F.lit("/ai_refined")))
    return out.select("job_id", "audit_id", "media_id", "problem", F.when(F.col("problem") == "provider_failed", F.col("__error")).alias("error_message"), F.when(F.col("problem").isNull(), F.col("output")).alias("output"), path.alias("file_path"))


def refined_versions(results: DataFrame) -> DataFrame:
    """(media_id, version_type, file_path, status) of the images that were refined, to be merged by the first two; one for each medium."""
    done = results.where("problem is null").groupBy("media_id").agg(F.min("file_path").alias("file_path"))
    return done.select("media_id", F.lit("ai_refined").alias("version_type"), "file_path", F.lit("ready").alias("status"))


def audit_results(results: DataFrame) -> DataFrame:
    """(id, status, response_summary, error_message) for `audited`, of the jobs that had a pending row."""
    failed = F.col("problem").isNotNull()
    return results.where("audit_id is not null").select(F.col("audit_id").alias("id"), F.when(failed, "failed").otherwise("success").alias("status"), F.col("file_path").alias("response_summary"), F.when(failed, F.coalesce("error_message", "problem")).alias("error_message"))


def audio_in_use(jobs: DataFrame, plans: DataFrame) -> DataFrame:
    """(audio_id): background audio of plans that unfinished render jobs work on; malformed payloads and plans are passed over."""
    work = jobs.where((F.col("job_type") == "video_render") & F.col("status").isin("pending", "running", "retrying"))
    asked = work.select(F.get_json_object("payload", "$.planId").alias("id")).where("id is not null").distinct()
    used = plans.join(asked, "id", "left_semi").select(F.get_json_object("plan_json", "$.audioPolicy.backgroundAudioId").alias("audio_id"))
    return used.where("audio_id is not null").distinct()


def with_analysis(media: DataFrame, analysis: DataFrame) -> DataFrame:
    """media with its analysis as one struct, null where there is none."""
    cols = [c for c in analysis.columns if c != "media_id"]
    a = analysis.select(F.col("media_id").alias("id"), F.struct(*cols).alias("analysis"))
    return media.join(a, "id", "left")


def ordered_items(items: DataFrame, media: DataFrame) -> DataFrame:
    """(group_id, media_id, type, status, place): items of groups in order (most similar first, unknown last, then by id), each with its medium's type and status if it is active.

    A row for each item, numbered by a window that spills, so that a group may have any number.
    """
    active = media.where("deleted_at is null").select(F.col("id").alias("media_id"), "type", "status")
    order = Window.partitionBy("group_id").orderBy(F.col("similarity_score").desc_nulls_last(), "media_id")
    return items.join(active, "media_id", "left").select("group_id", "media_id", "type", "status", (F.row_number().over(order) - 1).alias("place"))


def groups_with_items(groups: DataFrame, items: DataFrame, media: DataFrame) -> DataFrame:
    """Groups with their items in order, each with its medium (null if deleted), gathered in a row; for small groups (ordered_items is the form for any)."""
    active = media.where("deleted_at is null").select(F.col("id").alias("media_id"), F.struct("type", "status").alias("media"))
    rows = items.join(active, "media_id", "left")
    nested = rows.groupBy(F.col("group_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("similarity_score").isNull().alias("last"), (-F.col("similarity_score")).alias("order"), "media_id", "media"))).alias("items"))
    return groups.join(nested, "id", "left")


def groups_containing(groups: DataFrame, items: DataFrame, media_id) -> DataFrame:
    return groups.join(items.where(F.col("media_id") == F.lit(media_id)).select(F.col("group_id").alias("id")), "id", "left_semi")
