"""Filters, validations and conditional rewrites of rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_id(df: DataFrame, value, key: str = "id", any_state: bool = False) -> DataFrame:
    """The row with an id; soft-deleted rows only if any_state."""
    found = df.where(F.col(key) == F.lit(value))
    return found if any_state or "deleted_at" not in df.columns else found.where("deleted_at is null")


def visible(df: DataFrame, include_deleted: bool = False, only_deleted: bool = False) -> DataFrame:
    """Active rows, all rows, or deleted rows only (which beats include_deleted)."""
    if only_deleted:
        return df.where("deleted_at is not null")
    return df if include_deleted else df.where("deleted_at is null")


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows equal in every column given; None leaves a column out."""
    tests = [F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def of_kind(df: DataFrame, prefix: str, column: str = "job_type") -> DataFrame:
    """Rows whose column begins with a prefix and a literal underscore."""
    return df.where(F.col(column).like(prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "\\_%"))


def among(df: DataFrame, ids: DataFrame | Iterable, key: str = "id") -> DataFrame:
    """Rows whose key is in a list or a frame of keys; an empty list gives none."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    values = list(ids)
    return df.where(F.col(key).isin(values)) if values else df.limit(0)


def due(now: Column) -> Column:
    """Pending work, and retries whose time has come or is not set."""
    return (F.col("status") == "pending") | ((F.col("status") == "retrying") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)))


def same_key(**values) -> Column:
    """Null-safe equality on every column."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()])


def not_blurry(column: str = "is_blurry") -> Column:
    """True unless known to be blurry."""
    return ~F.col(column).eqNullSafe(F.lit(True))


def rewritten(df: DataFrame, condition: Column, **new: Column) -> DataFrame:
    """df with new values where the condition holds, and __changed telling where."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumn("__changed", hit).withColumns({c: F.when(F.col("__changed"), v).otherwise(F.col(c)) for c, v in new.items()})


def cleared(df: DataFrame, column: str, gone: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(df with references to gone rows set to null, ids of the rows touched)."""
    lost = gone.select(F.col(key).alias(column)).distinct().withColumn("__gone", F.lit(True))
    marked = df.join(lost, column, "left")
    touched = marked.where("__gone").select("id")
    return marked.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).select(*df.columns), touched


def patched(df: DataFrame, patch: DataFrame, columns: Iterable[str], key: str = "id") -> DataFrame:
    """df with the columns that a patch supplies; patch has, per column c, c and has_c."""
    columns = list(columns)
    side = patch.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns], *[F.col(f"has_{c}").alias(f"__has_{c}") for c in columns])
    return df.join(side, key, "left").withColumns({c: F.when(F.coalesce(F.col(f"__has_{c}"), F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*df.columns)


def problems(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks (false; null holds), in order."""
    return F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))


def trip_rules() -> dict[str, Column]:
    title = F.trim(F.coalesce("title", F.lit("")))
    start, end = (F.try_to_date(F.col(c).cast("string"), "yyyy-MM-dd") for c in ("start_date", "end_date"))
    return {
        "id": F.col("id").cast("string").rlike("^[A-Za-z0-9_-]{1,64}$"), "title": F.length(title).between(1, 200),
        "start_date": F.col("start_date").isNull() | start.isNotNull(), "end_date": F.col("end_date").isNull() | end.isNotNull(), "date_order": start <= end,
    }


def scene_candidates(media: DataFrame) -> DataFrame:
    """Images that are active and neither failed nor deleted."""
    return media.where("type = 'image' and deleted_at is null and status not in ('failed', 'deleted')")


def clip_problem() -> Column:
    """Why a medium cannot be a clip (first that applies), or null."""
    return F.when(F.col("type") != "video", "not_a_video").when(F.col("deleted_at").isNotNull(), "deleted").when(F.coalesce(F.trim("original_path"), F.lit("")) == "", "missing_original").when(F.coalesce("duration", F.lit(0.0)) <= 0, "missing_duration")


def job_problem(wanted_type: str) -> Column:
    """Why a job cannot run on its medium, or null."""
    return F.when(F.col("type").isNull(), "media_not_found").when(F.col("deleted_at").isNotNull(), "media_deleted").when(F.col("type") != wanted_type, f"not_{wanted_type}").when(F.col("original_path").isNull(), "no_original").when(F.coalesce("file_size", F.lit(0)) <= 0, "empty_file")


SELECTABLE = ("original", "enhanced", "ai_refined")


def versions_view(media: DataFrame, versions: DataFrame) -> DataFrame:
    """(media_id, version_type, file_path, is_active): the original as a row of its own, and ready selectable versions."""
    own = media.where("original_path is not null").select(F.col("id").alias("media_id"), F.lit("original").alias("version_type"), F.col("original_path").alias("file_path"))
    made = versions.where(F.col("version_type").isin(*SELECTABLE[1:]) & (F.col("status") == "ready") & F.col("deleted_at").isNull()).select("media_id", "version_type", "file_path")
    active = media.select(F.col("id").alias("media_id"), F.coalesce("active_version_type", F.lit("original")).alias("__active"))
    return own.unionByName(made).join(active, "media_id").withColumn("is_active", F.col("version_type") == F.col("__active")).drop("__active")


def with_parent(child: DataFrame, parents: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Rows whose parent is there and active."""
    return child.join(visible(parents).select(F.col(key).alias(column)), column, "left_semi").select(*child.columns)


def page(df: DataFrame, limit: int = 50, offset: int = 0, most: int = 200, order: tuple[str, str] = ("created_at", "id")) -> DataFrame:
    """Newest first, one page."""
    return df.orderBy(*[F.desc(c) for c in order]).offset(max(offset, 0)).limit(min(max(limit, 1), most))
