"""Reading and writing tables: typed Parquet, keyed merges, ledgers of applied changes, byte sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import classified, lookup
from ..functions.text import original_path
from ..schemas import SCHEMAS


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the model with its schema given, never inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_once(df: DataFrame, path: str) -> None:
    """Originals are never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def write_derived(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Derived tables are replaced; with a partition column, only the partitions that df has."""
    writer = df.write.mode("overwrite")
    (writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition) if partition else writer).parquet(path)


def read_bytes(spark: SparkSession, folder: str, pattern: str = "*", head: int | None = None) -> DataFrame:
    """(path, length, content) of files; with `head`, only that many first bytes go on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    content = F.col("content") if head is None else F.substring("content", 1, head)
    return files.select("path", "length", content.alias("content"))


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(media_id, frame) of key-frame manifests, a JSON file per medium; malformed or missing files give no rows."""
    schema = "mediaId string, frames array<struct<index:int,timestampSec:double,path:string,sharpness:double>>"
    found = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(folder)
    return found.where("mediaId is not null").select(F.col("mediaId").alias("media_id"), F.explode("frames").alias("frame"))


def rebuilt(df: DataFrame, columns: dict[str, Column | None]) -> DataFrame:
    """A table copied into a new form: these columns in this order, each from an expression, or, where that is None, as it was."""
    return df.select(*[(F.col(name) if value is None else value).alias(name) for name, value in columns.items()])


def random_key() -> Column:
    """32 random hex digits, as a default for a key that nothing refers to."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def manifest_frames(rows: DataFrame, column: str) -> DataFrame:
    """rows with each frame of a manifest (JSON in a column); malformed or null manifests give no rows."""
    got = F.from_json(F.col(column), "frames array<struct<index:int,timestampSec:double,path:string,sharpness:double>>")
    return rows.select(*[c for c in rows.columns if c != column], F.explode(got["frames"]).alias("frame"))


def pending_changes(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Changes (name) that the ledger does not have, to be applied in order of their names."""
    return files.join(ledger.select("name"), "name", "left_anti").orderBy("name")


def relinked(child: DataFrame, links: DataFrame, key: str, column: str) -> DataFrame:
    """child with `column` taken from links where they have the key; else as it was."""
    new = links.select(F.col(key), F.col(column).alias("__new")).dropDuplicates([key])
    return child.join(new, key, "left").withColumn(column, F.coalesce("__new", F.col(column))).select(*child.columns)


def upload_outcome(name: Column, mime: Column, head: Column, size: Column, error: Column, truncated: Column) -> Column:
    """struct(outcome, type, extension, mime, problem) of an uploaded file: the first that applies of error, truncated, empty, unknown, accepted."""
    c = classified(name, mime, head)
    outcome = F.when(error.isNotNull(), "upload_error").when(F.coalesce(truncated, F.lit(False)), "file_too_large").when(F.coalesce(size, F.lit(0)) == 0, "empty_file").when(c["type"] == "unknown", "unknown").otherwise("accepted")
    return F.struct(outcome.alias("outcome"), c["type"].alias("type"), c["extension"].alias("extension"), c["mime"].alias("mime"), c["problem"].alias("problem"))


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media rows, first jobs) of uploaded files (id, trip_id, name, mime, head, size, error, truncated).

    Unknown files become media without a job; files that failed to upload become nothing.
    """
    judged = files.withColumn("u", upload_outcome(*[F.col(c) for c in ("name", "mime", "head", "size", "error", "truncated")]))
    media = judged.where("u.outcome in ('accepted', 'unknown')").select(
        "id", "trip_id", F.col("u.type").alias("type"), F.when(F.col("u.outcome") == "accepted", original_path(F.col("trip_id"), F.col("id"), F.col("u.extension"))).alias("original_path"),
        F.col("size").alias("file_size"), F.col("u.mime").alias("mime_type"), F.col("u.extension").alias("extension"), F.when(F.col("u.outcome") == "accepted", "pending").otherwise("failed").alias("status"),
    )
    jobs = media.where("status = 'pending'").select(F.concat(F.lit("job-"), "id").alias("id"), F.col("id").alias("media_id"), "trip_id", F.when(F.col("type") == "image", "image_thumbnail").otherwise("video_metadata").alias("job_type"), F.lit("pending").alias("status"))
    return media, jobs


def audio_seeds(files: DataFrame) -> DataFrame:
    """Seed rows of an audio folder (path, content): no dot files, allowed extensions, checksum, in order of names."""
    from ..functions.text import AUDIO_EXTENSIONS, slug

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    rows = files.withColumn("name", name).withColumn("extension", ext).where(~F.col("name").startswith(".") & F.col("extension").isin(*AUDIO_EXTENSIONS))
    return rows.select("name", slug(F.regexp_replace("name", r"\.[^.]+$", "")).alias("slug"), "extension", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("checksum")).orderBy("name")


def audio_uploads(files: DataFrame, library: DataFrame, most_bytes: int) -> DataFrame:
    """(id, outcome, extension, slug, mime, same_as) of uploaded audio (id, name, mime, size, checksum) against the user's library (id, checksum).

    The first that applies: empty, too_large, unsupported, else existing (the checksum is in the library, or an upload with a smaller id has
    it) or created.
    """
    from ..functions.text import AUDIO_MIME_OF, AUDIO_MIMES, audio_extension, slug

    ext = audio_extension(F.col("name"), F.col("mime"))
    problem = F.when(F.coalesce("size", F.lit(0)) <= 0, "empty").when(F.col("size") > most_bytes, "too_large").when(ext.isNull(), "unsupported")
    rows = files.select("*", ext.alias("extension"), problem.alias("problem"))
    known = library.groupBy("checksum").agg(F.min("id").alias("known"))
    first = rows.where("problem is null").groupBy("checksum").agg(F.min("id").alias("first"))
    rows = rows.join(known, "checksum", "left").join(first, "checksum", "left")
    same = F.coalesce(F.col("known"), F.when(F.col("first") < F.col("id"), F.col("first")))
    outcome = F.when(F.col("problem").isNotNull(), F.col("problem")).when(same.isNotNull(), "existing").otherwise("created")
    low = F.lower("mime")
    mime = F.when(low.isin(*AUDIO_MIMES), low).otherwise(F.coalesce(lookup(AUDIO_MIME_OF, F.col("extension")), F.lit("application/octet-stream")))
    good = F.col("problem").isNull()
    return rows.select("id", outcome.alias("outcome"), "extension", F.when(good, slug(F.regexp_replace("name", r"\.[^.]+$", ""))).alias("slug"), F.when(good, mime).alias("mime"), F.when(good, same).alias("same_as"))
