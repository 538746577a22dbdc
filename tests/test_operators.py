"""Cases of the operators that the table queries do not reach."""

import random

import pytest
from pyspark.sql import functions as F

from shoebox.operators import dedup, jobs, merge, ranking, scenes, video
from shoebox.operators.components import components
from shoebox.schemas import SCHEMAS, conform
from shoebox.sources import tables
from shoebox.streaming import sessions


def images(spark, rows):
    return spark.createDataFrame([(*r, "image", None) for r in rows], "trip_id string, id string, perceptual_hash string, type string, deleted_at string")


def flip(bits, *places):
    for p in places:
        bits ^= 1 << p
    return f"{bits:016x}"


def test_transitive_cohort_and_trips_apart(spark):
    """Distances 3, 7 and 10 at a threshold of 8 merge; other trips, videos and short hashes do not."""
    base = 0xABCDEF0123456789
    rows = [("t", "a", flip(base)), ("t", "b", flip(base, 0, 1, 2)), ("t", "c", flip(base, 0, 1, 2, *range(30, 37))), ("u", "d", flip(base)), ("t", "e", "xyz"), ("t", "f", flip(base ^ 0xFFFFFFFF))]
    m = images(spark, rows)
    got = dedup.similar_cohorts(m)
    assert sorted((r["component"], r["id"]) for r in got.collect()) == [("a", "a"), ("a", "b"), ("a", "c")]
    score = dedup.cohort_scores(got).first()
    assert (score["n"], score["max_distance"], score["confidence"]) == (3, 10, 1 - 10 / 64)
    assert dedup.fresh_cohorts(got, spark.createDataFrame([("b",)], "id string")).count() == 0


@pytest.mark.parametrize("threshold", [1, 4, 8, 11])
def test_bands_against_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    centers = [rng.getrandbits(64) for _ in range(6)]
    rows = [(f"t{i % 2}", f"m{i:03d}", flip(rng.choice(centers), *rng.sample(range(64), rng.randrange(0, 8)))) for i in range(150)]
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (int(a[2], 16) ^ int(b[2], 16)).bit_count() <= threshold)
    got = dedup.image_pairs(images(spark, rows), threshold)
    assert sorted((r["trip_id"], r["a"], r["b"]) for r in got.collect()) == want


def test_components_of_strings(spark):
    edges = spark.createDataFrame([("b", "c"), ("c", "d"), ("x", "y"), ("z", "z")], "a string, b string")
    assert {tuple(r) for r in components(edges).collect()} == {("b", "b"), ("c", "b"), ("d", "b"), ("x", "x"), ("y", "x")}
    assert components(edges.limit(0)).count() == 0


def member(i, q, sharp=None, color=None, size=None, **more):
    return dict(group_id="g", media_id=i, similarity=None, quality=q, sharpness=sharp, exposure=None, color=color, resolution=size, file_size=None, created_at=None) | more


RANKED = "group_id string, media_id string, similarity double, quality double, sharpness double, exposure double, color double, resolution long, file_size long, created_at string"


def ranks(spark, rows):
    names = [c.split()[0] for c in RANKED.split(", ")]
    got = ranking.ranked_duplicates(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RANKED)).orderBy("rank").collect()
    return [r["media_id"] for r in got], [r["reason"] for r in got]


def test_ranking(spark):
    assert ranks(spark, [member("a", 0.3), member("b", 0.9), member("c", None), member("d", 0.6)])[0] == ["b", "d", "a", "c"]
    order, why = ranks(spark, [member("a", 0.875, sharp=0.9), member("b", 0.879, sharp=0.2)])
    assert order == ["a", "b"] and "lost on sharpness 0.2 < winner 0.9" in why[1]
    assert ranks(spark, [member("b", None), member("a", None)])[0] == ["a", "b"]
    assert ranks(spark, [member("a", 0.5, size=10), member("b", 0.5, size=20)])[0] == ["b", "a"]


def ranks_by_loops(rows):
    """(group_id, media_id, rank), class by class and score by score."""

    def ordered(rows, scores):
        if not scores:
            return sorted(rows, key=lambda r: (-(r["resolution"] or 0), -(r["file_size"] or 0), r["created_at"] is None, r["created_at"] or "", r["media_id"]))
        left, out = sorted((r for r in rows if r[scores[0]] is not None), key=lambda r: -r[scores[0]]), []
        while left:
            tied = [r for r in left if not left[0][scores[0]] - r[scores[0]] > 0.01]
            out, left = out + ordered(tied, scores[1:]), left[len(tied) :]
        none = [r for r in rows if r[scores[0]] is None]
        return out + (ordered(none, scores[1:]) if none else [])

    groups = {g: [r for r in rows if r["group_id"] == g] for g in {r["group_id"] for r in rows} - {None}}
    return sorted((g, r["media_id"], i) for g, of in groups.items() for i, r in enumerate(ordered(of, ["quality", "sharpness", "exposure", "color"])))


def test_ranking_within_tasks_and_across_them(spark):
    """Members are computed once, small groups are shuffled once, and large groups come out the same way (bounds between sizes and at 0)."""
    rng = random.Random(5)
    score = lambda: rng.choice([None, 0.5, 0.505, 0.51, 0.515, 0.52, 0.53, 0.9, round(rng.random(), 4)])
    rows = [
        member(f"m{i:03d}", score(), score(), score(), rng.choice([None, 1, 2]), group_id=g, exposure=score(), file_size=rng.choice([None, 3]), created_at=rng.choice([None, "2020", "2021"]))
        for i, g in enumerate(["a"] * 90 + ["b"] * 30 + ["c"] * 7 + ["d", None, None])
    ]
    names, seen = [c.split()[0] for c in RANKED.split(", ")], spark.sparkContext.accumulator(0)

    def ticked(x):
        seen.add(1)
        return x

    made = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RANKED)
    got = ranking.ranked_duplicates(made.withColumn("quality", F.udf(ticked, "double")("quality")))
    all_rows = sorted(map(tuple, got.collect()))
    assert [r[:3] for r in all_rows] == ranks_by_loops(rows)
    assert seen.value == len(rows) - 2  # those without a group are left out first
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1
    for within in (40, 0):
        assert sorted(map(tuple, ranking.ranked_duplicates(made, within=within).collect())) == all_rows


def test_reasons_write_numbers_as_the_formatter_does(spark):
    xs = [0.0, -0.0, 0.5, 0.0004, -0.0006, 1.0, 100.0, 999.9996, 2.0005, 1e7, 1e13, float("inf"), float("nan"), None]
    x = F.col("x")
    old = F.when(x.isNull(), "n/a").otherwise(F.regexp_replace(F.format_string("%.3f", F.floor(x * 1000 + 0.5) / 1000), r"\.?0+$", ""))
    got = spark.createDataFrame([(v,) for v in xs], "x double").select(ranking._say(x).alias("a"), old.alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_gap_is_strict(spark):
    rows = [("t", i, f"2024-01-01 10:{m:02d}:00") for i, m in enumerate((0, 15, 31))]
    df = spark.createDataFrame(rows, "trip_id string, id int, t string").withColumn("captured_at", F.col("t").cast("timestamp"))
    assert [r["group_index"] for r in scenes.sessions(df).orderBy("id").collect()] == [0, 0, 1]


def test_edit_plan(spark):
    df = spark.createDataFrame([("t", i, float(d)) for i, d in enumerate((20, 2, 40, 50))], "trip_id string, id int, duration double").withColumn("created_at", F.col("id"))
    got = [(r["id"], r["start"], r["clip_seconds"]) for r in video.edit_plan(df, target=40.0).orderBy("clip_order").collect()]
    assert got == [(0, 0.0, 10.0), (1, 10.0, 2.0), (2, 12.0, 10.0), (3, 22.0, 10.0)]
    got = [(r["id"], r["clip_seconds"]) for r in video.edit_plan(df, target=5.0).orderBy("clip_order").collect()]
    assert got == [(0, 3.0), (1, 2.0)]


def test_confirmed_groups_are_left_alone(spark):
    groups = spark.createDataFrame([("g", "x", True), ("h", None, False), ("i", "y", False)], "id string, recommended_media_id string, user_confirmed boolean")
    r = spark.createDataFrame([("g", "z", 0), ("h", "w", 0), ("h", "v", 1)], "group_id string, media_id string, rank int")
    got = {x["id"]: (x["recommended_media_id"], x["outcome"]) for x in merge.recommended(groups, r).collect()}
    assert got == {"g": ("x", "confirmed"), "h": ("w", "applied"), "i": ("y", "empty")}


def test_labels_and_json(spark):
    df = spark.createDataFrame([(["a", "a", "own"], ["own", "b", "b", "a"]), (None, ["b"]), (["a"], None)], "o array<string>, n array<string>")
    assert [r[0] for r in df.select(merge.merged_labels(F.col("o"), F.col("n"), ("own",))).collect()] == [["a", "a", "own", "b"], ["b"], ["a"]]
    j = spark.createDataFrame([('{"x":"1"}',), ("{bad",), (None,)], "j string").select(merge.merged_json(F.col("j"), "y", F.lit("2"))).collect()
    assert [r[0] for r in j] == ['{"x":"1","y":"2"}', '{"y":"2"}', '{"y":"2"}']


def test_restore_and_handlers(spark):
    m = spark.createDataFrame([("a", "deleted", "t"), ("b", "processed", None)], "id string, status string, deleted_at string")
    got = {r["id"]: (r["status"], r["deleted_at"]) for r in merge.restored(m, m.select("id")).collect()}
    assert got == {"a": ("pending", None), "b": ("processed", None)}

    @jobs.handles("noop")
    def handler(df):
        return df

    assert jobs.HANDLERS.pop("noop") is handler
    s = spark.createDataFrame([("t", "m", 1, True), ("t", "m", 2, False)], "trip_id string, media_id string, selection_round int, is_current boolean")
    assert sorted((r["selection_round"], r["is_current"]) for r in merge.current_round(s, "t", 2).collect()) == [(1, False), (2, True)]


EVENTS = ["start", "fail", "retry", "start", "retry_later", "start", "succeed", "start", "cancel", "cancel"]


def test_fold_batch_and_stream(spark, tmp_path):
    rows = [(j, f"2024-01-01 00:00:{i:02d}", i, e) for j in (1, 2) for i, e in enumerate(EVENTS[: 5 * j])]
    df = spark.createDataFrame(rows, "job_id int, ts string, seq int, event string")
    want = {r["job_id"]: tuple(r)[1:] for r in jobs.fold(df).collect()}
    assert want == {1: ("retrying", 1, 5, 0), 2: ("success", 1, 7, 3)}
    for part in range(2):
        df.where(f"seq between {part * 5} and {part * 5 + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sessions.fold_stream(sessions.event_stream(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("folded").collect():
        got[r["job_id"]] = max(got.get(r["job_id"], (None, 0, 0, 0)), tuple(r)[1:], key=lambda t: t[2] + t[3])
    assert got == want


def test_session_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    gap = 86_400
    stream = sessions.session_stream(sessions.event_stream(spark, str(tmp_path / "in"), e.schema, 3), "user_id", "ts", gap, "0 seconds")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    rows = scenes.sessions(e.withColumn("id", F.lit(0)).withColumn("captured_at", F.col("ts").cast("timestamp")), key="user_id", gap=gap)
    want = rows.groupBy("user_id", "group_index").agg(F.min("captured_at").alias("start"), F.max("captured_at").alias("end"), F.count("*").alias("n")).drop("group_index")
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select("user_id", "start", "end", "n").collect())
    assert key(spark.table("sessions")) == key(want)


def test_sources(spark, tmp_path):
    (tmp_path / "audio").mkdir()
    for name in ("b song.MP3", "a.wav", ".hidden.mp3", "note.txt"):
        (tmp_path / "audio" / name).write_bytes(name.encode())
    files = tables.read_bytes(spark, str(tmp_path / "audio"))
    seeds = tables.audio_seeds(files.withColumn("path", F.regexp_replace("path", "%20", " "))).collect()
    assert [(r["name"], r["slug"], r["extension"]) for r in seeds] == [("a.wav", "a", "wav"), ("b song.MP3", "b-song", "mp3")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.json").write_text('{"mediaId":"x","frames":[{"index":1,"timestampSec":0.5,"path":"p","sharpness":0.2}]}')
    (tmp_path / "m" / "2.json").write_text("{broken")
    assert [(r["media_id"], r["frame"]["timestampSec"]) for r in tables.read_manifests(spark, str(tmp_path / "m")).collect()] == [("x", 0.5)]
    df = conform(spark.createDataFrame([("t1", "T")], "id string, title string"), "trips")
    tables.write_once(df, str(tmp_path / "db" / "trips.parquet"))
    assert tables.read_table(spark, str(tmp_path / "db"), "trips").count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_once(df, str(tmp_path / "db" / "trips.parquet"))
    assert tables.pending_changes(spark.createDataFrame([("002",), ("001",)], "name string"), spark.createDataFrame([("001",)], "name string")).first()[0] == "002"


def test_ingest(spark):
    jpeg = bytearray(b"\xff\xd8\xff\xe0" + b"\0" * 12)
    rows = [("m1", "t", "a.jpg", "image/jpeg", jpeg, 16, None, False), ("m2", "t", "a.txt", None, jpeg, 16, None, False), ("m3", "t", "a.jpg", None, jpeg, 16, "boom", False), ("m4", "t", "a.jpg", None, jpeg, 0, None, False)]
    media, first = tables.ingest(spark.createDataFrame(rows, "id string, trip_id string, name string, mime string, head binary, size long, error string, truncated boolean"))
    assert sorted((r["id"], r["type"], r["original_path"], r["status"]) for r in media.collect()) == [("m1", "image", "trips/t/originals/m1.jpg", "pending"), ("m2", "unknown", None, "failed")]
    assert [(r["media_id"], r["job_type"]) for r in first.collect()] == [("m1", "image_thumbnail")]


def test_all_schemas_parse(spark):
    for name in SCHEMAS:
        assert conform(spark.range(0), name).columns


def test_schemes_lose_no_pair():
    """Any way to spread threshold differing bits over the blocks leaves one block within its radius."""
    from itertools import product

    for threshold in range(13):
        known = dedup.schemes(threshold)
        assert known and all(probes <= dedup.PROBES or m == threshold + 1 for m, (probes, _) in known.items())
        for m in known:
            own = dedup._scheme(threshold, m)
            assert own[0][0] == 0 and sum(bits for _, bits, _ in own) == 64 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:], strict=False))
            assert sum(radius + 1 for _, _, radius in own) > threshold  # the cheapest way to be beyond every radius
            if m <= 4:
                assert all(any(d <= r for d, (_, _, r) in zip(split, own, strict=True)) for split in product(range(threshold + 1), repeat=m) if sum(split) <= threshold)


@pytest.mark.parametrize("threshold", [0, 1, 3, 5, 8, 12])
def test_near_hashes_of_small_and_large_trips(spark, threshold):
    r = random.Random(threshold)
    rows = []
    for trip, n in (("small", 40), ("large", 900), (None, 30)):
        own = [r.getrandbits(64) for _ in range(n // 3)]
        for x in list(own):
            for _ in range(2):
                y = x
                for b in r.sample(range(64), r.randint(0, threshold + 2)):
                    y ^= 1 << b
                own.append(y)
        rows += [(trip, x - (1 << 64) if x >> 63 else x, i + 10_000 * n) for i, x in enumerate(sorted(set(own)))]
    nodes = spark.createDataFrame(rows, "trip_id string, bits long, node long")
    want = {(t, min(a, b), max(a, b), d) for t in ("small", "large") for i, (u, x, a) in enumerate(rows) if u == t for v, y, b in rows[i + 1 :] if v == t and (d := ((x ^ y) & (1 << 64) - 1).bit_count()) <= threshold}
    got = [tuple(x) for x in dedup.near_hashes(nodes, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    for m in list(dedup.schemes(threshold))[:2]:
        assert {tuple(x) for x in dedup.near_hashes(nodes, threshold, blocks=m).collect()} == want


def test_near_hashes_have_no_branch_per_scheme(spark):
    """Blocks come by a join: an expression with a branch for each scheme and block exceeds what Spark compiles well."""
    nodes = spark.createDataFrame([("t", 1, 1), ("t", 3, 2)], "trip_id string, bits long, node long")
    found = dedup.near_hashes(nodes)
    assert [tuple(x) for x in found.collect()] == [("t", 1, 2, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_count") < 10  # 42 radii of blocks are in a table


def test_classes_of_equal_hashes(spark):
    rows = spark.createDataFrame([(i, "t", "image", None, f"{h:016x}") for i, h in enumerate([5] * 50 + [7, 1 << 40])], "id long, trip_id string, type string, deleted_at string, perceptual_hash string")
    got = sorted(tuple(x) for x in dedup.similar_classes(rows).collect())
    assert got == [("t", 0, 0, 0, 50, 50), ("t", 0, 50, 1, 50, 1), ("t", 0, 51, 3, 50, 1), ("t", 50, 51, 4, 1, 1)]


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_fold_by_slots_is_the_fold(spark, width):
    r = random.Random(width)
    rows = [(j, t, t, r.choice([*jobs.MOVES, "unknown", None])) for j in range(12) for t in range(r.randrange(1, 60))]
    want = {}
    for j, _, _, e in rows:
        status, retries, applied, ignored = want.get(j, ("pending", 0, 0, 0))
        move = jobs.MOVES.get(e)
        if move and status in move[0]:
            status, retries, applied = move[1], 0 if e == "retry" else retries + (e == "retry_later"), applied + 1
        else:
            ignored += 1
        want[j] = status, retries, applied, ignored
    df = spark.createDataFrame(rows, "job_id int, ts int, seq int, event string")
    assert {x["job_id"]: tuple(x)[1:] for x in jobs.fold(df, slot=F.floor(F.col("ts") / width)).collect()} == want
    assert {x["job_id"]: tuple(x)[1:] for x in jobs.fold(df).collect()} == want


def test_classes_with_their_members(spark):
    rows = spark.createDataFrame([(i, "t", "image", None, f"{h:016x}") for i, h in enumerate([5, 5, 5, 7, 1 << 40, 1 << 40])], "id long, trip_id string, type string, deleted_at string, perceptual_hash string")
    got = [tuple(x)[1:4] for x in dedup.similar_classes(rows, members=True).collect()]
    of = {b: a for a, b, d in got if d == 0}
    pairs = {(min(x, y), max(x, y), d) for a, b, d in got for x in range(6) for y in range(6) if x != y and (of.get(x, x), of.get(y, y)) == ((a, b) if d else (a, a))}
    assert pairs == {tuple(x)[1:] for x in dedup.image_pairs(rows).collect()} and (0, 2, 0) in pairs


def test_few_probes_for_a_hash():
    """Both sides flip half of a radius: three blocks took 718 rows for a hash when one side flipped all."""
    probes = {m: x for m, (x, _) in dedup.schemes(8).items()}
    assert probes[3] < 150 and probes[9] == 18
