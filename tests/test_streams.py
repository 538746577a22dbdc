"""Supervised jobs, ingest that applies once, and the media store's source, on small made input."""

import datetime as dt
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from shoebox.plans import streams
from shoebox.sources import store
from shoebox.streaming import ingest, timers

MINUTE = 60_000
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def supervised(spark, folder, batches, **settings):
    """Outcomes of batches of (job, minute, event), as (job, outcome, minute, retries)."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(j, T0 + dt.timedelta(minutes=m), e) for j, m, e in rows], "job_id long, ts timestamp, event string").coalesce(1).write.parquet(f"{folder}/in/part{i}")
    source = spark.readStream.schema("job_id long, ts timestamp, event string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    with timers.state_on_disk(spark):
        out = timers.supervised(source, "10 minutes", timeout_ms=30 * MINUTE, base_ms=5 * MINUTE, longest_ms=15 * MINUTE, **settings)
        out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    start = T0.timestamp()
    return sorted((r["job_id"], (r["s"] - start) / 60, r["outcome"], r["retry_count"]) for r in spark.read.schema(timers.OUTCOMES).parquet(f"{folder}/out").withColumn("s", F.col("at").cast("double")).collect())


def test_dead_jobs_are_found_by_timers(spark, tmp_path):
    clock = (9, 600, "start")  # moves the watermark
    got = supervised(spark, tmp_path, [[(1, 0, "start"), (1, 20, "heartbeat"), (2, 0, "start"), (2, 10, "succeed"), (3, 0, "start"), (3, 5, "fail")], [clock], [(9, 1200, "heartbeat")]])
    # Job 1 dies 30 minutes after its last sign and waits for a worker once its retry is due; job 2 is done; job 3 failed by itself.
    assert [r for r in got if r[0] < 9] == [(1, 50, "zombie", 1), (1, 55, "retry_due", 1), (3, 10, "retry_due", 1)]


def test_retries_run_out_with_longer_delays(spark, tmp_path):
    events = [(1, m, "heartbeat") for m in (0, 100, 200, 300, 400)]
    got = supervised(spark, tmp_path, [events[:2], events[2:4], events[4:], [(9, 900, "start")]])
    assert [r for r in got if r[0] == 1] == [(1, 30, "zombie", 1), (1, 35, "retry_due", 1), (1, 130, "zombie", 2), (1, 140, "retry_due", 2), (1, 230, "zombie", 3), (1, 245, "retry_due", 3), (1, 330, "failed", 3)]


def test_events_out_of_order_and_late(spark, tmp_path):
    one = [(1, 0, "start"), (1, 25, "heartbeat"), (1, 50, "heartbeat")]
    end = [(9, 300, "start")]
    whole = supervised(spark, tmp_path / "a", [one, end])
    # The heartbeat at 25 comes after that at 50, but before the watermark has passed it.
    assert supervised(spark, tmp_path / "b", [[one[0]], [(1, 34, "heartbeat")], [one[1], one[2]], end]) == whole
    # Once the watermark has passed a time, an event of that time comes too late to save the job.
    late = supervised(spark, tmp_path / "c", [[one[0]], end, [(9, 320, "heartbeat")], [one[1]], [(9, 330, "heartbeat")]])
    assert (1, 30.0, "zombie", 1) in late and (1, 30.0, "zombie", 1) not in whole


def test_jobs_at_rest_are_forgotten(spark, tmp_path):
    lost = [(1, m, "fail") for m in (0, 1, 2, 3)]  # retries run out
    got = supervised(spark, tmp_path, [lost, [(9, 500, "start")], [(1, 520, "fail")], [(9, 900, "start")], [(9, 990, "start")]], forget_ms=60 * MINUTE)
    assert (1, 3, "failed", 3) in got and (1, 525, "retry_due", 1) in got  # a new job of that name begins anew


def test_jobs_of_one_bucket_do_not_mix(spark, tmp_path):
    rng = random.Random(3)
    events = [(j, m, rng.choice(["start", "heartbeat", "fail", "succeed"])) for j in range(1, 30) for m in sorted(rng.sample(range(0, 400), rng.randrange(1, 9)))]
    batches = [[e for e in events if e[1] // 100 == i] for i in range(4)] + [[(99, 900, "start")]]
    got = {b: supervised(spark, tmp_path / str(b), batches, buckets=b) for b in (1, 5, 4096)}
    assert got[1] == got[5] == got[4096] and len(got[1]) > 40


def test_parts_of_several_files_arrive_part_by_part(spark, tmp_path):
    """Each part has the number of files that is told, none empty, and holds its own events only."""
    events = spark.range(6000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("job_id"), F.timestamp_millis("id").alias("ts"), F.lit("start").alias("event"), F.col("id").alias("ms"))
    files = streams.arrivals(events, str(tmp_path / "in"), file_rows=300)
    assert files == 3
    seen = []
    for i in range(streams.PARTS):
        part = spark.read.parquet(f"{tmp_path}/in/part{i}")
        assert len(part.inputFiles()) == files and all(spark.read.parquet(f).count() for f in part.inputFiles())
        seen += [(r["event_id"], i) for r in part.select("event_id").collect()]
    assert sorted(seen) == [(e, min(e // 1000 + 2 * (e % 40 == 0), 5)) for e in range(6000)]


class Lost(Exception):
    pass


def files(spark, folder, part, rows):
    spark.createDataFrame([(f"/d/{n}", c.encode()) for n, c in rows], "path string, content binary").coalesce(1).write.parquet(f"{folder}/in/part{part}")


def source(spark, folder):
    return spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


@pytest.mark.parametrize("killed_at", [None, 0, 1])
def test_a_killed_ingest_gives_the_same_rows(spark, tmp_path, killed_at):
    files(spark, tmp_path, 0, [("b.mp3", "one"), ("a.mp3", "one"), (".hidden.mp3", "x"), ("notes.txt", "y")])
    files(spark, tmp_path, 1, [("c.wav", "one"), ("d.wav", "two")])
    ledger, deaths = ingest.Ledger(spark, str(tmp_path / "library"), ingest.SEEDS), []

    def kill(batch):
        if batch == killed_at and not deaths:
            deaths.append(batch)
            raise Lost

    assert ledger.rows().count() == 0
    if killed_at is not None:
        with pytest.raises(StreamingQueryException):
            ingest.ingest_once(source(spark, tmp_path), ledger, str(tmp_path / "state"), ingest.seeded, kill)
        assert {r["batch"] for r in ledger.rows().collect()} == set(range(killed_at))  # half a batch is never seen
    ingest.ingest_once(source(spark, tmp_path), ledger, str(tmp_path / "state"), ingest.seeded, kill)
    files(spark, tmp_path, 2, [("e.wav", "two"), ("f.mp3", "three")])
    for _ in range(2):
        ingest.ingest_once(source(spark, tmp_path), ledger, str(tmp_path / "state"), ingest.seeded)
        got = sorted((r["name"], r["outcome"], r["batch"]) for r in ledger.rows().collect())
        assert got == [("a.mp3", "inserted", 0), ("b.mp3", "known", 0), ("c.wav", "known", 1), ("d.wav", "inserted", 1), ("e.wav", "known", 2), ("f.mp3", "inserted", 2)]


def test_a_batch_replayed_after_its_ledger_entry_changes_nothing(spark, tmp_path):
    ledger = ingest.Ledger(spark, str(tmp_path), "x int")
    ledger.apply(4, spark.createDataFrame([(1,)], "x int"))
    assert ledger.has(4) and not ledger.has(5) and [tuple(r) for r in ledger.rows().select("x", "batch").collect()] == [(1, 4)]
    calls = []
    files(spark, tmp_path, 0, [("a.mp3", "one")])
    for checkpoint in ("one", "two"):  # another checkpoint: Spark gives the same batch again
        ingest.ingest_once(source(spark, tmp_path), ledger, str(tmp_path / checkpoint), lambda b, e: calls.append(1) or b.select(F.lit(2).alias("x")))
    assert len(calls) == 1 and ledger.rows().count() == 2


def test_named_changes_are_applied_once_in_order(spark, tmp_path):
    done = []

    def broken(_):
        raise Lost

    step = lambda name: lambda _: done.append(name)
    with pytest.raises(Lost):
        ingest.apply_changes(spark, str(tmp_path), {"003_c": step("c"), "001_a": step("a"), "002_b": broken})
    assert done == ["a"]
    assert ingest.apply_changes(spark, str(tmp_path), {"003_c": step("c"), "001_a": step("a"), "002_b": step("b")}) == (["002_b", "003_c"], ["001_a"])
    assert ingest.apply_changes(spark, str(tmp_path), {"001_a": step("a")}) == ([], ["001_a"]) and done == ["a", "b", "c"]
    assert ingest.apply_changes(spark, str(tmp_path), {}) == ([], [])


@pytest.fixture
def media_root(spark, tmp_path):
    rows = [(str(t), f"m{i}", [None, "{broken", '{"frames":[{"index":0}],"frameCount":1}', "[1]", '{"frameCount":2}'][i]) for t in range(150) for i in range(5)]
    store.write_manifests(spark.createDataFrame([*rows, ("..", "m9", "{}"), ("a/b", "m9", "{}")], "trip_id string, media_id string, manifest string"), str(tmp_path))
    return str(tmp_path)


def test_store_rows(spark, media_root):
    rows = store.read_store(spark, media_root)
    assert rows.count() == 750 and rows.rdd.getNumPartitions() == 3
    got = {r["media_id"]: r["summary"] for r in store.summaries(rows.where("trip_id = '7'")).collect()}
    assert got["m2"]["frameCount"] == 1 and [got[m] for m in ("m0", "m1", "m3", "m4")] == [None] * 4
    assert store.read_store(spark, f"{media_root}/none").count() == 0


def test_store_filters_are_pushed(spark, media_root, monkeypatch):
    rows = store.read_store(spark, media_root)
    one = rows.where("trip_id = '7' and media_id in ('m0', 'm2', 'm99') and manifest is not null")
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "EqualTo(trip_id,7)" in pushed and "In(media_id, [m0,m2,m99])" in pushed
    assert "Condition : isnotnull(manifest" in plan  # what is left for Spark
    assert [r["media_id"] for r in one.collect()] == ["m2"]
    assert sorted(r["media_id"] for r in rows.where("trip_id = '7' and media_id in ('m0', 'm99')").collect()) == ["m0"]
    assert rows.where("trip_id = '7' and trip_id = '8'").count() == 0 and rows.where("trip_id = '../trips/7'").count() == 0 and rows.where("trip_id = 'nowhere'").count() == 0
    reader = store.MediaReader(media_root)
    assert list(reader.pushFilters([store.In(("trip_id",), ("7", "8")), store.EqualTo(("trip_id",), "8")])) == []
    monkeypatch.setattr(store, "_folders", lambda *a: pytest.fail("listed"))
    assert [p.names for p in reader.partitions()] == [["8"]]  # no folder was listed


def test_parts_are_written_by_as_many_tasks_as_read_them(spark, tmp_path, monkeypatch):
    from shoebox.plans import streams
    from shoebox.plans.queries import QUERIES

    rows = [(i, f"text {i % 30}", "en", "s", 7) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6).write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(streams, "work_folder", lambda spark: f"file://{tmp_path}/work")
    key = "spark.sql.files.openCostInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "128m")  # a task for each file
    try:
        out = QUERIES["s10_ingested_once"](spark, f"{tmp_path}/in").collect()
    finally:
        spark.conf.set(key, old)
    assert all(len(list((tmp_path / f"work/in/part{i}").glob("*.parquet"))) > 1 for i in range(4))
    kept = {i: i % 4 for i in range(120) if i % 7}
    want = {}
    for i, part in sorted(kept.items(), key=lambda x: (x[1], f"Track {x[0]}.MP3")):
        want.setdefault(i % 30, [f"Track {i}.MP3", 0, part])[1] += 1
    assert sorted((r["first_name"], r["files"], r["batch"]) for r in out) == sorted(tuple(w) for w in want.values())
