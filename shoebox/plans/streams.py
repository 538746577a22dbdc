"""Registered queries that run a stream over files made from the given tables to its end, and return what it wrote."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store
from ..sources.work import work_folder, written
from ..streaming import ingest, timers
from .queries import query

DAY = 86_400_000
PARTS, LATE_DAYS, TIMEOUT, BASE, LONGEST, MOST = 6, 1, 2 * DAY, DAY // 4, DAY, 3


FILE_ROWS = 250_000


def arrivals(events: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> int:
    """Writes events in order of arrival: sixths of their time span, but each fortieth event comes two parts late.

    Returns the number of files in each part, which is the same for all and grows with the smallest part, so that no file of a part is empty
    and missing, and a stream that takes as many files at a time takes part by part.
    """
    low, high = events.agg(F.min("ms"), F.max("ms")).first()
    part = F.floor((F.col("ms") - low) * PARTS / (high - low + 1))
    part = F.when(F.col("event_id") % 40 == 0, F.least(part + 2, F.lit(PARTS - 1))).otherwise(part)
    sizes = {r["part"]: r["n"] for r in events.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    files = max(1, min(sizes.get(i, 0) for i in range(PARTS)) // file_rows)
    for i in range(PARTS):  # one after the other: a file stream reads in order of modification time
        rows = events.where(part == i)
        # Dealt out by event: with so many rows a file, none is left without any.
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
        rows.write.option("maxRecordsPerFile", 0).parquet(f"{folder}/part{i}")
    return files


_KIND = "CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'succeed' ELSE 'heartbeat' END"


@query(f"""WITH e AS (SELECT event_id, user_id * 3 + event_id % 3 AS job_id, epoch_us(ts) // 1000 AS ms, {_KIND} AS event FROM events),
p AS (SELECT *, CASE WHEN event_id % 40 = 0 THEN least(s + 2, {PARTS - 1}) ELSE s END AS part FROM (SELECT *, CAST(floor((ms - min(ms) OVER ()) * {PARTS} / (max(ms) OVER () - min(ms) OVER () + 1)) AS INT) AS s FROM e)),
m AS (SELECT part, max(max(ms)) OVER (ORDER BY part) - {LATE_DAYS * DAY} AS mark FROM p GROUP BY part),
f AS (SELECT max(mark) AS mark FROM m),
k AS (SELECT p.* FROM p LEFT JOIN m ON m.part = p.part - 2 CROSS JOIN f WHERE (m.mark IS NULL OR ms > m.mark) AND ms <= f.mark),
n AS (SELECT *, lead(ms) OVER o AS following FROM k WINDOW o AS (PARTITION BY job_id ORDER BY ms, event)),
g AS (SELECT *, CASE WHEN event = 'fail' THEN ms WHEN event = 'heartbeat' AND ms + {TIMEOUT} < coalesce(following, f.mark) THEN ms + {TIMEOUT} END AS struck, f.mark FROM n, f),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ms, event) - 1 AS r FROM g WHERE struck IS NOT NULL),
o AS (SELECT job_id, CASE WHEN r = {MOST} THEN 'failed' ELSE 'zombie' END AS outcome, struck AS at_ms, CASE WHEN r = {MOST} THEN r ELSE r + 1 END AS retry_count FROM r WHERE r = {MOST} OR (r < {MOST} AND event <> 'fail')
 UNION ALL SELECT job_id, 'retry_due', struck + least({BASE} * 2 ** r, {LONGEST}), r + 1 FROM r WHERE r < {MOST} AND struck + least({BASE} * 2 ** r, {LONGEST}) < coalesce(following, mark))
SELECT job_id, outcome, CAST(at_ms AS BIGINT) AS at_ms, CAST(retry_count AS INT) AS retry_count FROM o""")
def q5_q6_supervised_stream(get):
    spark, kind = get.spark, F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "succeed").otherwise("heartbeat")
    events = get("events").select("event_id", (F.col("user_id") * 3 + F.col("event_id") % 3).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event")).withColumn("ms", F.unix_millis("ts"))
    folder = work_folder(spark)
    files = arrivals(events, f"{folder}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    with timers.state_on_disk(spark):
        found = timers.supervised(source, f"{LATE_DAYS} days", TIMEOUT, BASE, LONGEST, MOST, forget_ms=1000 * DAY)
        found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(timers.OUTCOMES).parquet(f"{folder}/out").select("job_id", "outcome", F.unix_millis("at").alias("at_ms"), "retry_count")


class Killed(Exception):
    """Stands for a driver that is lost between a batch's rows and its ledger entry."""


@query("""WITH f AS (SELECT concat('Track ', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.MP3' END) AS name, doc_id % 4 AS part, text FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, sha256(text) AS checksum FROM f WHERE name LIKE '%MP3')
SELECT checksum, arg_min(name, (part, name)) AS first_name, count(*) AS files, CAST(min(part) AS BIGINT) AS batch FROM g GROUP BY checksum""")
def s10_ingested_once(get):
    spark = get.spark
    name = F.concat(F.lit("Track "), F.col("doc_id"), F.when(F.col("doc_id") % 7 == 0, ".txt").otherwise(".MP3"))
    files = get("documents").where("text is not null").select(F.concat(F.lit("/audio/"), name).alias("path"), F.encode("text", "UTF-8").alias("content"), (F.col("doc_id") % 4).alias("part"))
    folder = work_folder(spark)
    source = lambda: spark.readStream.schema("path string, content binary").option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    ledger, killed = ingest.Ledger(spark, f"{folder}/library", ingest.SEEDS), []

    def kill(batch: int) -> None:
        if batch == 2 and not killed:
            killed.append(batch)
            raise Killed(batch)

    def run() -> None:
        ingest.ingest_once(source(), ledger, f"{folder}/state", ingest.seeded, kill)

    for i in range(4):  # a part is all that is there when a run begins, in as many files as its tasks wrote, and so one batch
        files.where(F.col("part") == i).drop("part").write.parquet(f"{folder}/in/part{i}")
        try:
            run()
        except StreamingQueryException as e:
            if "Killed" not in str(e):
                raise
            run()  # goes on with the batch that was killed
    run()  # finds nothing new
    rows = ledger.rows()
    first = rows.where("outcome = 'inserted'").select("checksum", F.col("name").alias("first_name"), "batch")
    return first.join(rows.groupBy("checksum").agg(F.count(F.lit(1)).alias("files")), "checksum")


@query("""SELECT CAST(c_custkey % 20 AS VARCHAR) AS trip_id, CAST(c_custkey AS VARCHAR) AS media_id, CASE WHEN c_custkey % 4 > 1 THEN c_custkey % 5 END AS frames, CASE WHEN c_custkey % 4 > 1 AND c_custkey % 5 > 0 THEN (c_custkey % 5 - 1) * 1.5 END AS last_second
 FROM customer WHERE c_custkey % 20 IN (3, 6, 8)""")
def s1_s6_s14_stored_manifests(get):
    spark, c = get.spark, F.col("c_custkey")
    frames = F.when(c % 5 > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(c % 5 - 1, F.lit(0))), lambda i: F.struct(i.alias("index"), (i * 1.5).alias("timestampSec")))).otherwise(F.array().cast("array<struct<index:bigint,timestampSec:double>>"))
    manifest = F.when(c % 4 == 1, '{"frames":').when(c % 4 > 1, F.to_json(F.struct((c % 5).alias("frameCount"), frames.alias("frames"))))
    root = f"{work_folder(spark)}/store"
    store.write_manifests(get("customer").select((c % 20).cast("string").alias("trip_id"), c.cast("string").alias("media_id"), manifest.alias("manifest")), root)
    rows = store.summaries(store.read_store(spark, root).where(F.col("trip_id").isin("3", "6", "8")))
    return rows.select("trip_id", "media_id", F.size("summary.frames").cast("long").alias("frames"), F.when(F.size("summary.frames") > 0, F.array_max("summary.frames.timestampSec")).alias("last_second"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'invalid' ELSE 'stored' END AS original, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 7 = 0 THEN 'invalid' ELSE 'exists' END END AS again,
 CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 7 > 0 END AS removed, c_custkey % 7 > 0 AND c_custkey % 5 > 0 AS found, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 5 > 0 THEN c_name END AS content,
 CASE WHEN c_custkey % 4 = 0 THEN concat(c_name, ' new') END AS derived FROM customer""")
def s5_s6_stored_objects(get):
    spark, c = get.spark, F.col("c_custkey")
    root = f"{work_folder(spark)}/objects"
    trip = F.when(c % 7 == 0, "..").otherwise((c % 20).cast("string"))
    rows = get("customer").select(c.alias("id"), F.concat(F.lit("trips/"), trip, F.lit("/originals/"), c, F.lit(".bin")).alias("path"), F.concat(F.lit("trips/t/derived/"), c, F.lit(".bin")).alias("derived"), F.col("c_name").alias("name"))
    put = lambda df, path, content, overwrite: written(store.put_objects(df.select(F.col(path).alias("path"), F.encode(content, "UTF-8").alias("content"), F.lit(overwrite).alias("overwrite")), root), "put")
    name, new = F.col("name"), F.concat("name", F.lit(" new"))
    first, again = put(rows, "path", name, False), put(rows.where("id % 3 = 0"), "path", new, False)
    removed = written(store.remove_objects(rows.where("id % 5 = 0"), root), "removed")
    put(rows.where("id % 4 = 0"), "derived", name, True)
    put(rows.where("id % 4 = 0"), "derived", new, True)
    found = store.read_objects(rows, root).select("path", "found", F.decode("content", "UTF-8").alias("content"))
    derived = store.read_objects(rows.where("id % 4 = 0").select(F.col("derived").alias("path")), root).select(F.col("path").alias("d"), F.decode("content", "UTF-8").alias("new"))
    out = rows.join(first.toDF("path", "original"), "path").join(again.toDF("path", "again"), "path", "left").join(removed, "path", "left").join(found, "path").join(derived, rows["derived"] == derived["d"], "left")
    return out.select("id", "original", "again", "removed", "found", "content", F.col("new").alias("derived"))
