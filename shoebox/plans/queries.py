"""The registered queries of the library's own operators, each with the SQL that DuckDB must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, media as M, numeric, text as T
from ..operators import dedup, filters, jobs as J, merge, models, ranking, scenes, video
from ..schemas import orphans, repeated, violations
from ..sources import tables as S
from .frames import frame, with_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
def now():
    return F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")


NOW_SQL = "TIMESTAMP '1998-06-01 00:00:00'"


def query(sql: str | None = None):
    """Register fn(get) as a query; get(name) gives a frame or a table."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            def get(name: str) -> DataFrame:
                try:
                    return frame(spark, folder, name)
                except KeyError:
                    return S.read_parquet(spark, folder, name)

            get.spark = spark
            return fn(get)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = with_frames(sql)
        return fn

    return register


r6 = lambda c: F.round(c, 6)


# --- filters ---------------------------------------------------------------------------------------
@query("SELECT id, type, status FROM media WHERE id = 77 OR id = 78")
def f1_point_lookup(get):
    m = get("media")
    return filters.by_id(m, 77, any_state=True).unionByName(filters.by_id(m, 78)).select("id", "type", "status")


@query("SELECT 'active' AS view, count(*) AS n FROM media WHERE deleted_at IS NULL UNION ALL SELECT 'all', count(*) FROM media UNION ALL SELECT 'deleted', count(*) FROM media WHERE deleted_at IS NOT NULL")
def f2_visibility(get):
    m = get("media")
    one = lambda df, v: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("view"), "n")
    return one(filters.visible(m), "active").unionByName(one(filters.visible(m, include_deleted=True), "all")).unionByName(one(filters.visible(m, True, only_deleted=True), "deleted"))


@query("SELECT j.id, j.status, m.trip_id FROM jobs j LEFT JOIN media m ON m.id = j.media_id WHERE j.status = 'failed' AND m.trip_id = 7 AND j.job_type = 'image_hash'")
def f3_j3_job_list(get):
    view = get("jobs").join(get("media").select(F.col("id").alias("media_id"), "trip_id"), "media_id", "left")
    return filters.matching(view, status="failed", trip_id=7, job_type="image_hash", media_id=None).select("id", "status", "trip_id")


@query("SELECT job_type, count(*) AS n FROM jobs WHERE starts_with(job_type, 'image_') GROUP BY job_type")
def f4_literal_prefix(get):
    return filters.of_kind(get("jobs"), "image").groupBy("job_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, trip_id FROM media WHERE id IN (SELECT media_id FROM analysis WHERE quality_score > 0.5) AND id IN (1, 2, 3, 40, 50, 60, 700)")
def f5_among(get):
    good = get("analysis").where("quality_score > 0.5").select("media_id")
    return filters.among(filters.among(get("media"), good), [1, 2, 3, 40, 50, 60, 700]).select("id", "trip_id")


@query(f"SELECT id, status FROM jobs WHERE status = 'pending' OR (status = 'retrying' AND (next_run_at IS NULL OR next_run_at <= {NOW_SQL}))")
def f6_due_work(get):
    return get("jobs").where(filters.due(now())).select("id", "status")


@query("SELECT id, is_blurry IS DISTINCT FROM true AS usable, status FROM media LEFT JOIN analysis ON media_id = id WHERE is_blurry IS DISTINCT FROM true AND deleted_at IS NULL")
def f8_not_blurry(get):
    both = get("media").join(get("analysis").withColumnRenamed("media_id", "id"), "id", "left").where("deleted_at is null")
    return both.where(filters.not_blurry()).select("id", filters.not_blurry().alias("usable"), "status")


@query("SELECT id, CASE WHEN status = 'running' THEN 'success' ELSE status END AS status, status = 'running' AS changed FROM jobs")
def f9_conditional_update(get):
    return filters.rewritten(get("jobs"), F.col("status") == "running", status=F.lit("success")).select("id", "status", F.col("__changed").alias("changed"))


@query("WITH gone AS (SELECT id FROM media WHERE deleted_at IS NOT NULL) SELECT g.id, CASE WHEN gone.id IS NULL THEN recommended_media_id END AS recommended_media_id, gone.id IS NOT NULL AS touched FROM groups g LEFT JOIN gone ON gone.id = recommended_media_id")
def f10_cleared_references(get):
    groups, touched = filters.cleared(get("groups"), "recommended_media_id", filters.visible(get("media"), only_deleted=True))
    return groups.join(touched.withColumn("touched", F.lit(True)), "id", "left").select("id", "recommended_media_id", F.coalesce("touched", F.lit(False)).alias("touched"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'new' ELSE title END AS title, cover_media_id FROM trips")
def f11_patch(get):
    t = get("trips")
    patch = t.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 1, "new").alias("title"), F.lit(True).alias("has_title"), F.lit(None).cast("long").alias("cover_media_id"), F.lit(False).alias("has_cover_media_id"))
    return filters.patched(t, patch, ["title", "cover_media_id"]).select("id", "title", "cover_media_id")


@query("""WITH v AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN '  ' ELSE c_name END AS title, CASE WHEN c_custkey % 5 = 0 THEN '2020-02-30' ELSE '2020-03-10' END AS s, CASE WHEN c_custkey % 4 = 0 THEN '2020-01-01' ELSE '2020-05-01' END AS e FROM customer)
SELECT id, concat_ws(',', CASE WHEN length(trim(title)) NOT BETWEEN 1 AND 200 THEN 'title' END, CASE WHEN try_cast(s AS DATE) IS NULL THEN 'start_date' END, CASE WHEN try_cast(s AS DATE) > try_cast(e AS DATE) THEN 'date_order' END) AS problems FROM v""")
def f12_validation(get):
    c = get("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 6 == 0, "  ").otherwise(F.col("c_name")).alias("title"), F.when(F.col("c_custkey") % 5 == 0, "2020-02-30").otherwise("2020-03-10").alias("start_date"), F.when(F.col("c_custkey") % 4 == 0, "2020-01-01").otherwise("2020-05-01").alias("end_date"))
    return c.select("id", F.array_join(filters.problems(filters.trip_rules()), ",").alias("problems"))


@query("SELECT trip_id, count(*) AS n FROM media WHERE type = 'image' AND deleted_at IS NULL AND status NOT IN ('failed', 'deleted') GROUP BY trip_id")
def f13_scene_candidates(get):
    return filters.scene_candidates(get("media")).groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN type <> 'video' THEN 'not_a_video' WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN original_path IS NULL THEN 'missing_original' WHEN duration <= 0 THEN 'missing_duration' END AS problem FROM media")
def f14_clip_problems(get):
    return get("media").select("id", filters.clip_problem().alias("problem"))


@query("""WITH v AS (SELECT id AS media_id, 'original' AS version_type, original_path AS file_path FROM media WHERE original_path IS NOT NULL
 UNION ALL SELECT media_id, version_type, file_path FROM versions WHERE version_type IN ('enhanced', 'ai_refined') AND status = 'ready' AND deleted_at IS NULL)
SELECT v.*, v.version_type = coalesce(m.active_version_type, 'original') AS is_active FROM v JOIN media m ON m.id = v.media_id""")
def f15_versions_view(get):
    return filters.versions_view(get("media"), get("versions"))


@query("SELECT j.id, CASE WHEN m.id IS NULL THEN 'media_not_found' WHEN m.deleted_at IS NOT NULL THEN 'media_deleted' WHEN m.type <> 'image' THEN 'not_image' WHEN m.original_path IS NULL THEN 'no_original' WHEN m.file_size <= 0 THEN 'empty_file' END AS problem FROM jobs j LEFT JOIN media m ON m.id = j.media_id")
def f16_preconditions(get):
    m = get("media").select(F.col("id").alias("media_id"), "type", "deleted_at", "original_path", "file_size")
    return get("jobs").join(m, "media_id", "left").select("id", filters.job_problem("image").alias("problem"))


@query("SELECT m.id, m.trip_id FROM media m WHERE trip_id IN (SELECT id FROM trips WHERE deleted_at IS NULL)")
def f17_active_parent(get):
    return filters.with_parent(get("media"), get("trips"), "trip_id").select("id", "trip_id")


@query("SELECT id FROM media ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 10")
def o1_page(get):
    return filters.page(get("media"), 25, 10).select("id")


# --- joins -----------------------------------------------------------------------------------------
@query("SELECT m.id, a.quality_score, a.media_id IS NOT NULL AS analysed FROM media m LEFT JOIN analysis a ON a.media_id = m.id")
def j1_with_analysis(get):
    return models.with_analysis(get("media"), get("analysis")).select("id", F.col("analysis.quality_score").alias("quality_score"), F.col("analysis").isNotNull().alias("analysed"))


@query("SELECT trip_id, id AS media_id FROM (SELECT m.*, row_number() OVER (PARTITION BY trip_id ORDER BY quality_score DESC, created_at, id) AS k FROM media m JOIN analysis a ON a.media_id = m.id WHERE type = 'image' AND deleted_at IS NULL AND quality_score IS NOT NULL AND is_blurry IS DISTINCT FROM true) WHERE k = 1")
def j2_o4_cover_candidates(get):
    return ranking.cover_candidates(get("media"), get("analysis"))


@query("SELECT id FROM groups WHERE id IN (SELECT group_id FROM members WHERE media_id IN (5, 500))")
def j4_a20_groups_containing(get):
    g, m = get("groups"), get("members")
    return models.groups_containing(g, m, 5).unionByName(models.groups_containing(g, m, 500)).select("id").distinct()


@query("SELECT m.id, a.quality_score, v.file_path FROM media m LEFT JOIN analysis a ON a.media_id = m.id LEFT JOIN versions v ON v.media_id = m.id AND v.version_type = 'metadata' WHERE m.type = 'image' AND m.deleted_at IS NULL")
def j5_scene_source(get):
    m = get("media").where("type = 'image' and deleted_at is null").select("id")
    v = get("versions").where("version_type = 'metadata'").select(F.col("media_id").alias("id"), "file_path")
    return m.join(get("analysis").select(F.col("media_id").alias("id"), "quality_score"), "id", "left").join(v, "id", "left")


@query("SELECT m.trip_id, count(*) AS n FROM calls c JOIN media m ON m.id = c.media_id GROUP BY m.trip_id")
def j6_calls_per_trip(get):
    return models.invocations_per_trip(get("calls"), get("media"))


@query("SELECT group_id, media_id, CASE WHEN m.deleted_at IS NULL THEN m.type END AS type, row_number() OVER (PARTITION BY group_id ORDER BY similarity_score DESC NULLS LAST, media_id) - 1 AS place FROM members i LEFT JOIN media m ON m.id = i.media_id")
def j7_j8_o2_ordered_items(get):
    return models.ordered_items(get("members"), get("media")).select("group_id", "media_id", "type", F.col("place").cast("long").alias("place"))


@query("SELECT group_id, media_id, CASE WHEN m.deleted_at IS NULL THEN m.type END AS type, row_number() OVER (PARTITION BY group_id ORDER BY similarity_score DESC NULLS LAST, media_id) - 1 AS place FROM members i LEFT JOIN media m ON m.id = i.media_id")
def j7_j8_o2_groups_with_items(get):
    nested = models.groups_with_items(get("groups"), get("members"), get("media"))
    return nested.select(F.col("id").alias("group_id"), F.posexplode("items").alias("place", "i")).select("group_id", F.col("i.media_id").alias("media_id"), F.col("i.media.type").alias("type"), F.col("place").cast("long").alias("place"))


_SIM = """h AS (SELECT id, trip_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda t: t <> '')) AS w FROM hashes),
x AS (SELECT id, trip_id, len(w) AS n, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h FROM h, unnest(w) AS u(t)),
b AS (SELECT id, trip_id, k, 2 * count(*) FILTER (((h >> k) & 1) = 1) > any_value(n) AS one FROM x, range(64) AS r(k) GROUP BY id, trip_id, k),
s AS (SELECT h.id, h.trip_id, coalesce(sum(CASE WHEN one THEN (1::UBIGINT << k) ELSE 0 END), 0)::UBIGINT AS bits FROM h LEFT JOIN b USING (id, trip_id) GROUP BY h.id, h.trip_id),
p AS (SELECT a.trip_id, a.id AS a, b.id AS b, bit_count(xor(a.bits, b.bits))::INT AS distance FROM s a JOIN s b ON a.trip_id = b.trip_id AND a.id < b.id WHERE bit_count(xor(a.bits, b.bits)) <= 8)"""


def dealt(get, rows: DataFrame, *keys: str) -> DataFrame:
    """rows in as many tasks as the cluster runs, before something costly is derived: a file of few row groups would be read by as few tasks."""
    return rows.repartition(4 * get.spark.sparkContext.defaultParallelism, *keys)


def _hashed(get):
    texts = dealt(get, get("hashes").select("id", "trip_id", "type", "text"), "id")
    return texts.select("id", "trip_id", "type", hashing.text_simhash(F.col("text")).alias("perceptual_hash"), F.lit(None).cast("long").alias("deleted_at"))


@query(f"""WITH {_SIM}, n AS (SELECT trip_id, bits, min(id) AS node, count(*) AS n FROM s GROUP BY trip_id, bits)
SELECT x.trip_id, x.node AS a, y.node AS b, bit_count(xor(x.bits, y.bits))::INT AS distance, x.n AS n_a, y.n AS n_b FROM n x JOIN n y ON x.trip_id = y.trip_id AND x.node < y.node AND bit_count(xor(x.bits, y.bits)) <= 8
UNION ALL SELECT n.trip_id, n.node, s.id, 0, n.n, n.n FROM n JOIN s ON s.trip_id = n.trip_id AND s.bits = n.bits WHERE n.n > 1""")
def j9_k1_near_pairs(get):
    return dedup.similar_classes(_hashed(get), members=True)


@query(f"WITH {_SIM} SELECT * FROM p")
def j9_expanded_pairs(get):
    return dedup.image_pairs(_hashed(get))


_SEG = "s AS (SELECT id, media_id, start, end_time, user_decision FROM segments)"


def _segments(get):
    return get("segments").withColumnRenamed("end_time", "end")


@query("SELECT s.id, count(f.ts) AS frames, round(avg(f.sharpness), 6) AS sharpness FROM segments s JOIN frames f ON f.media_id = s.media_id AND f.ts >= s.start AND f.ts < s.end_time GROUP BY s.id")
def j10_frames_in_segments(get):
    return video.frames_in(_segments(get), get("frames")).groupBy("id").agg(F.count("ts").alias("frames"), r6(F.avg("sharpness")).alias("sharpness"))


_JUDGED = """sh AS (SELECT s.id, avg(f.sharpness) AS blur FROM segments s JOIN frames f ON f.media_id = s.media_id AND f.ts >= s.start AND f.ts < s.end_time GROUP BY s.id),
bl AS (SELECT s.id, sum(greatest(0, least(s.end_time, b.end_time) - greatest(s.start, b.start))) AS dark FROM segments s JOIN black b ON b.media_id = s.media_id GROUP BY s.id),
j AS (SELECT s.id, sh.blur, least(1.0, coalesce(bl.dark, 0) / (s.end_time - s.start)) AS ratio FROM segments s LEFT JOIN sh USING (id) LEFT JOIN bl ON bl.id = s.id),
w AS (SELECT id, ratio, CASE WHEN ratio >= 0.5 THEN 'black' WHEN blur <= 0.25 THEN 'blurry' ELSE 'none' END AS waste, CASE WHEN blur IS NOT NULL THEN least(1.0, blur * (1 - ratio)) END AS q FROM j)"""


@query(f"WITH {_JUDGED} SELECT id, round(ratio, 6) AS black_ratio, waste AS waste_type, round(q, 6) AS quality_score, waste = 'none' AND coalesce(q >= 0.5, false) AS is_recommended FROM w")
def j11_a12_a13_segment_quality(get):
    black = get("black").withColumnRenamed("end_time", "end")
    out = video.judged(video.measured(_segments(get).drop("user_decision"), get("frames"), black))
    return out.select("id", r6("black_ratio").alias("black_ratio"), "waste_type", r6("quality_score").alias("quality_score"), "is_recommended")


@query(f"WITH {_JUDGED} SELECT k AS waste_type, count(w.id) AS n FROM (VALUES ('none'), ('black'), ('blurry'), ('shaky'), ('duplicate')) AS v(k) LEFT JOIN w ON w.waste = k GROUP BY k")
def a14_waste_histogram(get):
    black = get("black").withColumnRenamed("end_time", "end")
    return dedup.histogram(video.judged(video.measured(_segments(get), get("frames"), black)), "waste_type", video.WASTE)


@query("""WITH n AS (SELECT * FROM segments WHERE id % 2 = 0), o AS (SELECT * FROM segments WHERE id % 2 = 1 AND user_decision <> 'undecided'),
f AS (SELECT n.id, o.id AS old_id, o.user_decision AS d, o.start AS o1, greatest(0, least(n.end_time, o.end_time) - greatest(n.start, o.start)) / (n.end_time - n.start) AS share FROM n JOIN o USING (media_id)),
b AS (SELECT * FROM f WHERE share > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY share DESC, o1, old_id) = 1)
SELECT n.id, CASE WHEN b.share >= 0.5 THEN b.old_id END AS old_id, CASE WHEN b.share >= 0.5 THEN b.d ELSE 'undecided' END AS user_decision FROM n LEFT JOIN b USING (id)""")
def j12_x7_carried_decisions(get):
    s = _segments(get)
    return video.carried_decisions(s.where("id % 2 = 0").drop("user_decision"), s.where("id % 2 = 1")).select("id", "old_id", "user_decision")


_COMP = f"""WITH RECURSIVE {_SIM}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a), m AS (SELECT s.trip_id, c.component, s.id, s.bits FROM c JOIN s USING (id))"""


@query(f"{_COMP} SELECT trip_id, component, id FROM m")
def a6_similar_components(get):
    return dedup.similar_cohorts(_hashed(get)).select("trip_id", "component", "id")


@query(f"{_COMP}, d AS (SELECT x.component, max(bit_count(xor(x.bits, y.bits)))::INT AS max_distance FROM m x JOIN m y USING (component) GROUP BY x.component) SELECT m.trip_id, component, count(*) AS n, max_distance, 1 - max_distance / 64.0 AS confidence FROM m JOIN d USING (component) GROUP BY ALL")
def a7_a8_cohort_scores(get):
    return dedup.cohort_scores(dedup.similar_cohorts(_hashed(get)))


@query(f"{_COMP}, t AS (SELECT component, arg_min(bits, id) AS head FROM m GROUP BY component) SELECT trip_id, component, id, 1 - bit_count(xor(bits, head)) / 64.0 AS similarity FROM m JOIN t USING (component)")
def a8_item_similarity(get):
    return dedup.item_similarity(dedup.similar_cohorts(_hashed(get)))


@query(f"{_COMP}, hit AS (SELECT DISTINCT component FROM m WHERE id % 10 = 3) SELECT trip_id, component, id FROM m WHERE component NOT IN (SELECT component FROM hit)")
def j13_fresh_cohorts(get):
    members = dedup.similar_cohorts(_hashed(get))
    return dedup.fresh_cohorts(members, get("hashes").where("id % 10 = 3").select("id")).select("trip_id", "component", "id")


@query("""SELECT DISTINCT concat('a', CAST(p.o_orderkey % 9 AS STRING)) AS audio_id FROM orders p JOIN orders j ON j.o_custkey = p.o_orderkey WHERE j.o_orderstatus <> 'F' AND j.o_orderkey % 3 > 0""")
def j14_audio_in_use(get):
    o = get("orders")
    plans = o.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit('{"audioPolicy":{"backgroundAudioId":"a'), F.col("o_orderkey") % 9, F.lit('"}}')).alias("plan_json"))
    jobs = o.select(F.lit("video_render").alias("job_type"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("pending").alias("status"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit('{"planId":"'), F.col("o_custkey"), F.lit('"}'))).otherwise(F.lit("{broken")).alias("payload"))
    return models.audio_in_use(jobs, plans)


@query("SELECT media_id, arg_min(version_type, k) AS kind, arg_min(file_path, k) AS path FROM (SELECT *, CASE version_type WHEN 'preview' THEN 2 WHEN 'ai_refined' THEN 3 WHEN 'enhanced' THEN 4 END AS k FROM versions WHERE status = 'ready' AND version_type IN ('preview', 'ai_refined', 'enhanced')) GROUP BY media_id")
def j15_first_source(get):
    return video.first_source(get("versions").select("media_id", F.col("version_type").alias("kind"), F.col("file_path").alias("path"), (F.col("status") == "ready").alias("readable")))


@query("SELECT m.id, CASE WHEN v.file_size > 0 THEN 'proxy' ELSE 'original' END AS source, CASE WHEN v.file_size > 0 THEN v.file_path ELSE m.original_path END AS path FROM media m LEFT JOIN versions v ON v.media_id = m.id AND v.version_type = 'proxy' WHERE m.type = 'video'")
def j16_decode_source(get):
    return video.decode_source(get("media").where("type = 'video'"), get("versions").where("version_type = 'proxy'"))


# --- aggregates ------------------------------------------------------------------------------------
@query("SELECT status, count(*) AS n FROM jobs GROUP BY status")
def a1_status_counts(get):
    return J.status_counts(get("jobs"))


@query("""WITH c AS (SELECT media_id, count(*) FILTER (status IN ('pending', 'running', 'retrying')) AS a, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'success') AS s FROM jobs GROUP BY media_id)
SELECT m.id, CASE WHEN c.media_id IS NULL THEN m.status WHEN a > 0 THEN 'processing' WHEN f > 0 THEN 'failed' WHEN s > 0 THEN 'processed' ELSE 'failed' END AS status FROM media m LEFT JOIN c ON c.media_id = m.id""")
def a2_media_status(get):
    return J.media_status(get("media"), get("jobs"))


@query(f"SELECT trip_id, selection_round, count(*) AS n, count(*) FILTER (included) AS included FROM picked GROUP BY trip_id, selection_round")
def a3_scalar_counts(get):
    return get("picked").groupBy("trip_id", "selection_round").agg(F.count(F.lit(1)).alias("n"), F.count_if("included").alias("included"))


@query("SELECT lang AS trip_id, sha256(text) AS file_hash, string_agg(CAST(doc_id AS STRING), ',' ORDER BY doc_id) AS members, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY lang, sha256(text) HAVING count(*) >= 2")
def a4_exact_cohorts(get):
    d = get("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("trip_id"), F.sha2("text", 256).alias("file_hash"), F.lit(0).alias("created_at"), F.lit(None).cast("long").alias("deleted_at"))
    return dedup.exact_cohorts(d).select("trip_id", "file_hash", F.array_join("members", ",").alias("members"), "n")


@query("SELECT lang AS trip_id, sha256(text) AS file_hash, doc_id AS id, n FROM (SELECT *, count(*) OVER (PARTITION BY lang, sha256(text)) AS n FROM documents WHERE text IS NOT NULL) WHERE n >= 2")
def a4_exact_members(get):
    d = get("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("trip_id"), F.sha2("text", 256).alias("file_hash"), F.lit(None).cast("long").alias("deleted_at"))
    return dedup.exact_members(d)


@query("WITH g AS (SELECT trip_id, file_hash, count(*) AS n FROM media WHERE deleted_at IS NULL GROUP BY trip_id, file_hash) SELECT trip_id, CAST(sum(n) AS BIGINT) AS scanned, count(*) AS distinct_hashes, count(*) FILTER (n >= 2) AS cohorts, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS members FROM g GROUP BY trip_id")
def a5_exact_counts(get):
    return dedup.exact_counts(get("media"))


@query("SELECT source AS reason, count(*) AS n FROM documents GROUP BY source")
def a9_skip_histogram(get):
    return dedup.histogram(get("documents").select(F.col("source").alias("reason")), "reason")


@query("""WITH d AS (SELECT media_id, sharpness_score AS b, exposure_score AS e, CASE WHEN color_score IS NOT NULL THEN 0.5 + 0.5 * greatest(0, least(1, color_score)) END AS c FROM analysis),
w AS (SELECT media_id, CASE WHEN b IS NULL THEN 0 ELSE 0.45 * b END + CASE WHEN e IS NULL THEN 0 ELSE 0.35 * e END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 * c END AS s, CASE WHEN b IS NULL THEN 0 ELSE 0.45 END + CASE WHEN e IS NULL THEN 0 ELSE 0.35 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END AS t FROM d)
SELECT media_id, round(CASE WHEN t > 0 THEN greatest(0, least(1, s / t)) END, 6) AS quality FROM w""")
def a11_quality_score(get):
    return get("analysis").select("media_id", r6(M.quality_score(F.col("sharpness_score"), F.col("exposure_score"), F.col("color_score"))).alias("quality"))


@query(f"WITH u AS (SELECT count(*) AS used_today FROM calls WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00') SELECT trip_id, used_today, count(*) AS used, used_today >= 100 AS daily_reached, count(*) >= 500 AS trip_reached FROM calls, u GROUP BY trip_id, used_today")
def a18_quotas(get):
    return models.quotas(get("calls"), F.lit("2024-01-10 13:00:00").cast("timestamp"), 100, 500)


# --- windows ---------------------------------------------------------------------------------------
_GAP = 86_400
_SES = f"""g AS (SELECT *, CASE WHEN epoch(captured_at) - epoch(lag(captured_at) OVER o) > {_GAP} THEN 1 ELSE 0 END AS n FROM points WINDOW o AS (PARTITION BY trip_id ORDER BY captured_at, id)),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY trip_id ORDER BY captured_at, id) AS INT) AS group_index FROM g)"""


@query(f"WITH {_SES} SELECT id, trip_id, group_index FROM s")
def w1_sessions(get):
    return scenes.sessions(get("points"), gap=_GAP).select("id", "trip_id", "group_index")


@query(f"WITH {_SES} SELECT id, CAST(row_number() OVER (PARTITION BY trip_id, group_index ORDER BY quality DESC NULLS LAST, id) - 1 AS INT) AS rank_in_group FROM s")
def w2_rank_in_scene(get):
    return scenes.ranked(scenes.sessions(get("points"), gap=_GAP)).select("id", "rank_in_group")


@query(f"WITH {_SES}, k AS (SELECT *, row_number() OVER (PARTITION BY trip_id, group_index ORDER BY quality DESC NULLS LAST, id) AS k FROM s) SELECT trip_id, group_index, count(*) AS member_count, min(id) FILTER (k = 1) AS representative, CAST(min(captured_at) AS STRING) = CAST(max(captured_at) AS STRING) AS instant FROM k GROUP BY trip_id, group_index")
def a19_scene_summaries(get):
    out = scenes.summaries(scenes.sessions(get("points"), gap=_GAP))
    return out.select("trip_id", "group_index", "member_count", "representative", (F.col("start") == F.col("end")).alias("instant"))


def _classes() -> str:
    """The classes of ranking in SQL: heads[k] are the scores that begin one, by group and the classes before."""
    out = """s0 AS (SELECT m.group_id, m.media_id, a.quality_score AS q1, a.sharpness_score AS q2, a.exposure_score AS q3, a.color_score AS q4, coalesce(x.width * x.height, 0) AS res, coalesce(x.file_size, 0) AS fs, CAST(x.created_at AS VARCHAR) AS age
        FROM members m LEFT JOIN analysis a USING (media_id) LEFT JOIN media x ON x.id = m.media_id)"""
    keys = "group_id"
    for k in range(1, 5):
        out += f""", d{k} AS (SELECT {keys}, max(q{k}) AS h FROM s{k - 1} WHERE q{k} IS NOT NULL GROUP BY {keys}
          UNION ALL SELECT {", ".join("d." + c for c in keys.split(", "))}, (SELECT max(s.q{k}) FROM s{k - 1} s WHERE {" AND ".join(f"s.{c} = d.{c}" for c in keys.split(", "))} AND d.h - s.q{k} > 0.01) AS h FROM d{k} d WHERE d.h IS NOT NULL),
        s{k} AS (SELECT s.*, CASE WHEN q{k} IS NULL THEN 1073741824 ELSE (SELECT count(*) FROM d{k} d WHERE {" AND ".join(f"d.{c} = s.{c}" for c in keys.split(", "))} AND d.h >= s.q{k}) END AS c{k} FROM s{k - 1} s)"""
        keys += f", c{k}"
    return out


_RANKED = f"""WITH RECURSIVE {_classes()},
r AS (SELECT *, row_number() OVER o - 1 AS rank, first_value(q1) OVER o AS w1, first_value(q2) OVER o AS w2, first_value(q3) OVER o AS w3, first_value(q4) OVER o AS w4, first_value(res) OVER o AS wres, first_value(fs) OVER o AS wfs, count(*) OVER (PARTITION BY group_id) AS n
      FROM s4 WINDOW o AS (PARTITION BY group_id ORDER BY c1, c2, c3, c4, res DESC, fs DESC, age NULLS LAST, media_id))"""


@query(f"{_RANKED} SELECT count(*) AS n, count(*) FILTER (rank = 0) AS n_groups FROM r")
def w3_counts_of_ranked(get):
    ranked = ranking.ranked_duplicates(_members(get))
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") == 0).alias("n_groups"))


def _members(get):
    a = get("analysis").select("media_id", F.col("quality_score").alias("quality"), F.col("sharpness_score").alias("sharpness"), F.col("exposure_score").alias("exposure"), F.col("color_score").alias("color"))
    m = get("media").select(F.col("id").alias("media_id"), (F.col("width") * F.col("height")).alias("resolution"), "file_size", F.col("created_at").cast("string").alias("created_at"))
    return get("members").select("group_id", "media_id", F.col("similarity_score").alias("similarity")).join(a, "media_id", "left").join(m, "media_id", "left")


def _said(x: str) -> str:
    return f"coalesce(regexp_replace(printf('%.3f', floor({x} * 1000 + 0.5) / 1000), '\\.?0+$', ''), 'n/a')"


_LOST = " ".join(f"WHEN w{k} IS NOT NULL AND (q{k} IS NULL OR w{k} - q{k} > 0.01) THEN 'tied on quality ' || {_said('q1')} || '; lost on {name} ' || {_said(f'q{k}')} || ' < winner ' || {_said(f'w{k}')}" for k, name in ((2, "sharpness"), (3, "exposure"), (4, "color")))
_LOST += " ".join(f" WHEN w{c} > {c} THEN 'tied on quality ' || {_said('q1')} || '; lost on {name} ' || {c} || ' < winner ' || w{c}" for c, name in (("res", "resolution"), ("fs", "file_size")))


@query(f"""{_RANKED} SELECT group_id, media_id, CAST(rank AS INT) AS rank, CASE WHEN rank = 0 THEN 'keep' ELSE 'remove' END AS recommendation,
CASE WHEN rank = 0 AND q1 IS NOT NULL THEN 'recommended: quality ' || {_said("q1")} || ', best of ' || n WHEN rank = 0 THEN 'recommended: no quality yet, first of ' || n || ' by tie-breakers'
  WHEN q1 IS NULL AND w1 IS NOT NULL THEN 'no quality yet; winner has ' || {_said("w1")} WHEN q1 IS NULL THEN 'no quality for either; lost on tie-breakers'
  WHEN abs(q1 - w1) > 0.01 THEN 'quality ' || {_said("q1")} || ' < winner ' || {_said("w1")} {_LOST} ELSE 'tied on quality ' || {_said("q1")} || '; lost on age or id' END AS reason FROM r""")
def w3_w4_ranked_duplicates(get):
    return ranking.ranked_duplicates(_members(get))


_PICK = f"""{_SES}, k AS (SELECT *, row_number() OVER (PARTITION BY trip_id, group_index ORDER BY quality DESC NULLS LAST, id) AS rank_in_group FROM s),
c AS (SELECT *, coalesce(quality, 0.5) * CASE ai_blur_class WHEN 'sharp' THEN 1.0 WHEN 'maybe_blurry' THEN 0.7 WHEN 'blurry' THEN 0.3 ELSE CASE WHEN is_blurry THEN 0.5 ELSE 1.0 END END - CASE WHEN is_duplicate THEN 0.2 ELSE 0.0 END AS score FROM k),
t AS (SELECT *, row_number() OVER (PARTITION BY trip_id, group_index ORDER BY score DESC, rank_in_group, created_at, id) - 1 AS place FROM c QUALIFY place < 5)"""


def _picks(get):
    return scenes.picks(scenes.ranked(scenes.sessions(get("points"), gap=_GAP)))


@query(f"WITH {_PICK} SELECT id, round(score, 6) AS score, CAST(place AS INT) AS place FROM t")
def w5_w6_top_picks(get):
    return _picks(get).select("id", r6("score").alias("score"), "place")


@query(f"""WITH {_PICK}, a AS (SELECT trip_id, group_index, max(id) FILTER (place <= 5) AS best_id, count(*) AS cnt, CASE (trip_id + group_index) % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'malformed' END AS status FROM t GROUP BY trip_id, group_index),
b AS (SELECT t.*, a.cnt, a.best_id, a.status, min(CASE WHEN place = 0 THEN id END) OVER (PARTITION BY t.trip_id, t.group_index) AS first FROM t JOIN a USING (trip_id, group_index))
SELECT id, CASE WHEN cnt = 1 THEN 'single_member' WHEN status IS NULL THEN 'code_fallback_no_model' WHEN status = 'success' THEN 'model' ELSE 'code_fallback_' || status END AS decision,
 id = CASE WHEN cnt > 1 AND coalesce(status, '') = 'success' THEN best_id ELSE first END AS included FROM b""")
def w7_decisions(get):
    top = _picks(get)
    said = F.element_at(F.array(F.lit("success"), F.lit("failed"), F.lit("malformed"), F.lit(None)), ((F.col("trip_id") + F.col("group_index")) % 4 + 1).cast("int"))
    answers = top.groupBy("trip_id", "group_index").agg(F.max("id").alias("best_id")).withColumn("status", said).where("status is not null")
    return scenes.decided(top, answers).select("id", "decision", "included")


_CLIPS = "v AS (SELECT id, trip_id, created_at, duration, count(*) OVER (PARTITION BY trip_id) AS n FROM media WHERE type = 'video' AND deleted_at IS NULL AND original_path IS NOT NULL AND duration > 0), l AS (SELECT *, least(duration, greatest(3.0, 60.0 / n)) AS c FROM v), p AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY trip_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)"


def _clips(get):
    ok = get("media").where(filters.clip_problem().isNull())
    return video.edit_plan(ok)


@query(f"WITH {_CLIPS} SELECT id, round(start, 4) AS start, round(least(c, 60.0 - start), 4) AS clip_seconds, row_number() OVER (PARTITION BY trip_id ORDER BY created_at, id) - 1 AS clip_order FROM p WHERE start < 60.0 - 1e-6")
def w8_edit_plan(get):
    return _clips(get).select("id", F.round("start", 4).alias("start"), F.round("clip_seconds", 4).alias("clip_seconds"), F.col("clip_order").cast("long").alias("clip_order"))


@query(f"WITH {_CLIPS}, q AS (SELECT trip_id, id, row_number() OVER (PARTITION BY trip_id ORDER BY created_at, id) - 1 AS o FROM p WHERE start < 60.0 - 1e-6) SELECT * FROM (SELECT trip_id, lag(id) OVER (PARTITION BY trip_id ORDER BY o) AS from_id, id AS to_id, o AS to_order FROM q) WHERE from_id IS NOT NULL")
def w9_transitions(get):
    return video.transitions(_clips(get)).withColumn("to_order", F.col("to_order").cast("long"))


@query("WITH l AS (SELECT l_orderkey AS media_id, l_linenumber AS seq, max(l_quantity) - 5 AS seconds FROM lineitem GROUP BY 1, 2), p AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l WHERE seconds > 0) SELECT media_id, seq, s AS start, s + seconds AS end_time FROM p")
def w10_timeline(get):
    parts = get("lineitem").groupBy(F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").alias("seq")).agg((F.max("l_quantity") - 5).alias("seconds"))
    return video.timeline(parts).select("media_id", "seq", "start", F.col("end").alias("end_time"))


@query("SELECT media_id, job_type, id, status FROM (SELECT *, row_number() OVER (PARTITION BY media_id, job_type ORDER BY created_at DESC, id DESC) AS k FROM jobs) WHERE k = 1")
def w11_latest_job(get):
    return ranking.latest_per(get("jobs").select("id", "media_id", "job_type", "status", "created_at"), ["media_id", "job_type"]).select("media_id", "job_type", "id", "status")


@query("SELECT id, k AS frame, round((k - 1) * CASE WHEN ceil(duration / 2) > 8 THEN duration / 8 ELSE 2 END, 9) AS ts FROM (SELECT id, duration, unnest(range(1, CAST(greatest(1, least(8, ceil(duration / 2))) AS BIGINT) + 1))::INT AS k FROM media WHERE duration > 0 AND type = 'video')")
def w12_keyframes(get):
    out = video.keyframe_times(get("media").where("type = 'video'"), 2.0, 8)
    return out.select("id", "frame", F.round("ts", 9).alias("ts"))


# --- orders ----------------------------------------------------------------------------------------
@query("SELECT DISTINCT l_suppkey AS id, CASE l_returnflag WHEN 'A' THEN 'system' WHEN 'N' THEN 'user' ELSE 'other' END AS source_type FROM lineitem ORDER BY CASE source_type WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 9 END, id LIMIT 40")
def o3_source_order(get):
    kind = F.when(F.col("l_returnflag") == "A", "system").when(F.col("l_returnflag") == "N", "user").otherwise("other")
    rows = get("lineitem").select(F.col("l_suppkey").alias("id"), kind.alias("source_type"), F.lit("n").alias("name")).distinct()
    return rows.orderBy(*ranking.audio_order()).limit(40).select("id", "source_type")


@query("SELECT trip_id, arg_min(id, struct_pack(a := created_at, b := id)) AS media_id FROM media WHERE type = 'image' AND deleted_at IS NULL AND thumbnail_path IS NOT NULL GROUP BY trip_id")
def o5_first_thumbnail(get):
    return ranking.first_thumbnail(get("media")).select("trip_id", "media_id")


_CH = "ch(channel, job_type, concurrency) AS (VALUES ('image', 'image_hash', 9000), ('image', 'image_thumbnail', 9000), ('video', 'video_metadata', 3))"


@query(f"WITH {_CH}, b AS (SELECT channel, count(*) AS busy FROM jobs JOIN ch USING (job_type) WHERE status = 'running' GROUP BY channel), r AS (SELECT ch.channel, j.id, j.job_type, concurrency - coalesce(busy, 0) AS free, row_number() OVER (PARTITION BY ch.channel ORDER BY created_at, j.id) AS turn FROM jobs j JOIN ch USING (job_type) LEFT JOIN b ON b.channel = ch.channel WHERE status = 'pending' OR (status = 'retrying' AND (next_run_at IS NULL OR next_run_at <= {NOW_SQL}))) SELECT channel, id, job_type, CAST(turn AS INT) AS turn FROM r WHERE turn <= free")
def o6_q2_q3_claims(get):
    channels = get.spark.createDataFrame([("image", "image_hash", 9000), ("image", "image_thumbnail", 9000), ("video", "video_metadata", 3)], "channel string, job_type string, concurrency int")
    return J.claims(get("jobs"), channels, now())


# --- merges and cascades ---------------------------------------------------------------------------
@query("""WITH cur AS (SELECT trip_id, media_id FROM picked p WHERE selection_round >= 1 AND is_current AND included AND selection_round = (SELECT max(selection_round) FROM picked q WHERE q.trip_id = p.trip_id AND q.selection_round >= 1 AND q.is_current)),
u AS (SELECT trip_id, media_id, 'model' AS origin FROM cur UNION ALL SELECT trip_id, media_id, 'user' FROM picked WHERE selection_round = 0 AND user_decision = 'kept')
SELECT trip_id, media_id, max(origin) AS origin FROM u WHERE (trip_id, media_id) NOT IN (SELECT (trip_id, media_id) FROM picked WHERE selection_round = 0 AND user_decision = 'excluded') GROUP BY ALL""")
def x1_current_selection(get):
    return scenes.current_selection(get("picked"))


@query("""WITH b AS (SELECT * FROM analysis WHERE media_id % 3 > 0), n AS (SELECT media_id, quality_score + 1 AS sharpness_score FROM analysis WHERE media_id % 2 = 0)
SELECT coalesce(b.media_id, n.media_id) AS media_id, round(b.quality_score, 6) AS quality_score, round(CASE WHEN n.media_id IS NOT NULL THEN n.sharpness_score ELSE b.sharpness_score END, 6) AS sharpness_score FROM b FULL JOIN n ON n.media_id = b.media_id""")
def x2_merged_dimension(get):
    a = get("analysis")
    out = merge.merged_dimension(a.where("media_id % 3 > 0").select("media_id", "quality_score", "sharpness_score"), a.where("media_id % 2 = 0").select("media_id", (F.col("quality_score") + 1).alias("sharpness_score")), ["sharpness_score"])
    return out.select("media_id", r6("quality_score").alias("quality_score"), r6("sharpness_score").alias("sharpness_score"))


@query("""WITH b AS (SELECT doc_id, source, lang FROM documents WHERE doc_id % 3 > 0), n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE source END AS source, 'xx' AS lang FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, coalesce(n.source, b.source) AS source, coalesce(b.lang, n.lang) AS lang, CASE WHEN n.doc_id IS NULL THEN 'kept' WHEN b.doc_id IS NULL THEN 'inserted' WHEN b.source = n.source THEN 'unchanged' ELSE 'updated' END AS outcome FROM b FULL JOIN n ON n.doc_id = b.doc_id""")
def x3_x5_upsert(get):
    d = get("documents").select("doc_id", "source", "lang")
    new = d.where("doc_id % 2 = 0").withColumn("source", F.when(F.col("doc_id") % 4 == 0, "new").otherwise(F.col("source"))).withColumn("lang", F.lit("xx"))
    return merge.upserted(d.where("doc_id % 3 > 0"), new, ["doc_id"], keep=("lang",))


@query("""WITH d AS (SELECT DISTINCT trip_id, media_id, CASE media_id % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'excluded' END AS d FROM picked WHERE media_id % 5 = 0)
SELECT trip_id, media_id, selection_round, user_decision FROM picked WHERE selection_round <> 0 OR (trip_id, media_id) NOT IN (SELECT (trip_id, media_id) FROM d) UNION ALL SELECT trip_id, media_id, 0, d FROM d WHERE d IS NOT NULL""")
def x4_overrides(get):
    p = get("picked")
    wanted = p.where("media_id % 5 = 0").select("trip_id", "media_id").distinct().withColumn("user_decision", F.when(F.col("media_id") % 3 == 0, "kept").when(F.col("media_id") % 3 == 1, "excluded"))
    return merge.overridden(p, wanted).select("trip_id", "media_id", "selection_round", "user_decision")


@query("""SELECT doc_id, array_to_string(list_concat(list_filter(o, lambda x: x NOT IN ('blurry', 'sharp')), list_filter(n, lambda x: NOT list_contains(list_filter(o, lambda y: y NOT IN ('blurry', 'sharp')), x))), ',') AS labels FROM
 (SELECT doc_id, [lang, source, lang, 'blurry'] AS o, CASE WHEN doc_id % 2 = 0 THEN ['sharp', source] ELSE ['blurry'] END AS n FROM documents)""")
def x6_merged_labels(get):
    old = F.array("lang", "source", "lang", F.lit("blurry"))
    new = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("sharp"), F.col("source"))).otherwise(F.array(F.lit("blurry")))
    return get("documents").select("doc_id", F.array_join(merge.merged_labels(old, new, ("blurry", "sharp")), ",").alias("labels"))


@query("SELECT l_orderkey AS k, min(l_linenumber) AS v FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1 UNION ALL SELECT l_orderkey, 99 FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1")
def x7_replace_all(get):
    base = get("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linenumber").alias("v"))
    return merge.replaced(base, base.where("k % 3 = 0").withColumn("v", F.lit(99)), "k")


@query("""WITH w AS (SELECT group_id, max(media_id) AS m FROM members WHERE group_id % 3 = 0 GROUP BY group_id)
SELECT i.group_id, i.media_id, CASE WHEN w.m IS NULL THEN 'undecided' WHEN w.m = i.media_id THEN 'keep' ELSE 'remove' END AS user_decision, g.user_confirmed OR w.m IS NOT NULL AS confirmed FROM members i JOIN groups g ON g.id = i.group_id LEFT JOIN w ON w.group_id = i.group_id""")
def x8_confirmed(get):
    items = get("members")
    groups, after = merge.confirmed(get("groups"), items, items.where("group_id % 3 = 0").groupBy("group_id").agg(F.max("media_id").alias("media_id")))
    return after.join(groups.select(F.col("id").alias("group_id"), F.col("user_confirmed").alias("confirmed")), "group_id").select("group_id", "media_id", "user_decision", "confirmed")


@query("""WITH d AS (SELECT id FROM media WHERE id % 10 = 1) SELECT 'media' AS what, count(*) AS n FROM media WHERE id IN (SELECT id FROM d) AND deleted_at IS NULL
 UNION ALL SELECT 'groups', count(*) FROM groups WHERE recommended_media_id IN (SELECT id FROM d) UNION ALL SELECT 'covers', count(*) FROM trips WHERE cover_media_id IN (SELECT id FROM d)""")
def x9_soft_delete(get):
    m, g, t = get("media"), get("groups"), get("trips")
    m2, g2, t2, jobs = merge.soft_deleted(m, g, t, m.where("id % 10 = 1").select("id"), now())
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    lost = lambda a, b, c: a.where(F.col(c).isNotNull()).select("id").join(b.where(F.col(c).isNull()).select("id"), "id")
    return n(m2.where("status = 'deleted'"), "media").unionByName(n(lost(g, g2, "recommended_media_id"), "groups")).unionByName(n(lost(t, t2, "cover_media_id"), "covers"))


@query("SELECT DISTINCT media_id FROM members JOIN groups ON groups.id = group_id WHERE recommendation = 'remove' AND recommended_media_id IS NOT NULL AND media_id <> recommended_media_id")
def x10_delete_others(get):
    return merge.delete_others(get("groups"), get("members"))


_BEST = "b AS (SELECT trip_id, id AS best FROM (SELECT m.*, row_number() OVER (PARTITION BY trip_id ORDER BY quality_score DESC, created_at, id) AS k FROM media m JOIN analysis a ON a.media_id = m.id WHERE type = 'image' AND deleted_at IS NULL AND quality_score IS NOT NULL AND is_blurry IS DISTINCT FROM true) WHERE k = 1)"


@query(f"WITH {_BEST}, s AS (SELECT t.*, b.best, CASE WHEN cover_set_by_user THEN 'pinned' WHEN best IS NULL THEN 'no_candidate' WHEN best IS NOT DISTINCT FROM cover_media_id THEN 'unchanged' ELSE 'applied' END AS status FROM trips t LEFT JOIN b ON b.trip_id = t.id) SELECT id, CASE WHEN status = 'applied' THEN best ELSE cover_media_id END AS cover_media_id, status FROM s")
def x11_auto_cover(get):
    return merge.auto_cover(get("trips"), get("media"), get("analysis"))


@query("WITH f AS (SELECT trip_id, arg_min(thumbnail_path, struct_pack(a := created_at, b := id)) AS p FROM media WHERE type = 'image' AND deleted_at IS NULL AND thumbnail_path IS NOT NULL GROUP BY trip_id) SELECT t.id, coalesce(m.thumbnail_path, f.p, '/static/placeholder.svg') AS cover_url FROM trips t LEFT JOIN media m ON m.id = t.cover_media_id AND m.deleted_at IS NULL AND m.type = 'image' LEFT JOIN f ON f.trip_id = t.id")
def x12_cover_urls(get):
    return merge.cover_urls(get("trips"), get("media"))


@query("""WITH w AS (SELECT id, CASE id % 3 WHEN 0 THEN 'enhanced' WHEN 1 THEN 'ai_refined' ELSE 'original' END AS t FROM media), v AS (SELECT media_id, version_type FROM versions WHERE status = 'ready' AND deleted_at IS NULL),
o AS (SELECT m.id, m.active_version_type AS a, w.t, CASE WHEN v.media_id IS NULL AND NOT (w.t = 'original' AND m.original_path IS NOT NULL) THEN 'missing_version' WHEN coalesce(m.active_version_type, 'original') = w.t THEN 'unchanged' ELSE 'applied' END AS outcome FROM media m JOIN w USING (id) LEFT JOIN v ON v.media_id = m.id AND v.version_type = w.t)
SELECT id, CASE WHEN outcome = 'applied' THEN t ELSE a END AS active_version_type, outcome FROM o""")
def x16_selected_version(get):
    m = get("media")
    wanted = m.select("id", F.when(F.col("id") % 3 == 0, "enhanced").when(F.col("id") % 3 == 1, "ai_refined").otherwise("original").alias("target"))
    return merge.selected_version(m, wanted, get("versions"))


@query("SELECT id, CASE WHEN status = 'pending' THEN CASE WHEN id % 2 = 0 THEN 'success' ELSE 'failed' END ELSE status END AS status, CASE WHEN status = 'pending' THEN CASE WHEN id % 2 = 0 THEN 'done' END ELSE response_summary END AS response_summary FROM calls")
def x18_audited(get):
    c = get("calls").withColumn("error_message", F.lit(None).cast("string"))
    results = c.select("id", F.when(F.col("id") % 2 == 0, "success").otherwise("failed").alias("status"), F.lit("done").alias("response_summary"), F.lit("bad").alias("error_message"))
    return models.audited(c, results).select("id", "status", "response_summary")


# --- functions -------------------------------------------------------------------------------------
@query("""WITH v AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity * 5 AS v, l_extendedprice / 400 AS mean, l_discount * 7 AS dark, l_tax * 9 AS bright FROM lineitem),
e AS (SELECT *, mean < 70 OR dark > 0.5 AS u, mean > 185 OR bright > 0.5 AS o FROM v), c AS (SELECT *, CASE WHEN (dark > 0.25 AND bright > 0.25) OR (u AND o) THEN 'mixed-exposure' WHEN u THEN 'underexposed' WHEN o THEN 'overexposed' ELSE 'well-exposed' END AS exposure FROM e)
SELECT k, n, CASE WHEN v < 50 THEN 'blurry' WHEN v >= 120 THEN 'sharp' ELSE 'maybe-blurry' END AS blur, round(least(1.0, v / 240), 6) AS sharpness, exposure,
 round(CASE exposure WHEN 'well-exposed' THEN 1.0 WHEN 'mixed-exposure' THEN greatest(0, 1 - greatest(dark, bright)) WHEN 'underexposed' THEN least(1, mean / 70) ELSE greatest(0, least(1, (255 - mean) / 70)) END, 9) AS exposure_score FROM c""")
def k5_k8_blur_and_exposure(get):
    v, mean, dark, bright = F.col("l_quantity") * 5, F.col("l_extendedprice") / 400, F.col("l_discount") * 7, F.col("l_tax") * 9
    return get("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), M.blur_class(v).alias("blur"), r6(M.sharpness(v)).alias("sharpness"), M.exposure_class(mean, dark, bright).alias("exposure"), F.round(M.exposure_score(mean, dark, bright), 9).alias("exposure_score"))


@query("""WITH v AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity * 5 AS r, CAST(l_partkey % 256 AS DOUBLE) AS g, CAST(l_suppkey % 256 AS DOUBLE) AS b, l_discount * 10 AS s, l_tax * 1500 AS c FROM lineitem),
x AS (SELECT *, greatest(r, g, b) AS t, least(r, g, b) AS l FROM v),
y AS (SELECT *, CASE WHEN s < 0.1 THEN 'low' WHEN s > 0.75 THEN 'high' ELSE 'normal' END AS sat, CASE WHEN c < 30 THEN 'low' WHEN c > 90 THEN 'high' ELSE 'normal' END AS con, CASE WHEN t - l < 30 THEN 'balanced' WHEN g = l AND abs(r - b) < 15 AND (r + b) / 2 - g >= 30 THEN 'magenta-cast' WHEN t = r THEN 'warm-cast' WHEN t = g THEN 'green-cast' ELSE 'cool-cast' END AS cc FROM x),
z AS (SELECT *, concat_ws(',', CASE WHEN sat <> 'normal' THEN 'color-' || sat || '-saturation' END, CASE WHEN cc <> 'balanced' THEN 'color-' || cc END, CASE WHEN con <> 'normal' THEN 'color-' || con || '-contrast' END) AS lab FROM y)
SELECT k, n, CASE WHEN lab = '' THEN 'color-balanced' ELSE lab END AS labels, round(least(CASE WHEN sat = 'normal' THEN 1.0 ELSE 0.5 END, CASE WHEN con = 'normal' THEN 1.0 ELSE 0.5 END, CASE WHEN cc = 'balanced' THEN 1.0 ELSE greatest(0, 1 - greatest(0, t - l - 30) / 255) END), 6) AS score FROM z""")
def k9_k10_colour(get):
    c = [F.col("l_quantity") * 5, (F.col("l_partkey") % 256).cast("double"), (F.col("l_suppkey") % 256).cast("double"), F.col("l_discount") * 10, F.col("l_tax") * 1500]
    return get("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.array_join(M.colour_labels(*c), ",").alias("labels"), r6(M.colour_score(*c)).alias("score"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, floor((l_discount - 0.05) * 37.5 * 100.0 + 0.5) / 100.0 AS rounded, greatest(0.0, least(1.0, l_extendedprice / 50000 - 0.2)) AS clamped, CAST(least(1000.0 * pow(2.0, l_linenumber), 60000.0) AS BIGINT) AS delay FROM lineitem")
def k11_k12_k25_numbers(get):
    return get("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), numeric.round_to((F.col("l_discount") - 0.05) * 37.5, 2).alias("rounded"), numeric.clamp01(F.col("l_extendedprice") / 50000 - 0.2).alias("clamped"), numeric.backoff_ms(F.col("l_linenumber")).alias("delay"))


@query("SELECT page_id, nullif(lower(regexp_extract(regexp_extract(url, '([^/\\\\]*)$', 1), '^.+\\.([^.]+)$', 1)), '') AS ext, CASE WHEN s = '' THEN 'audio' ELSE s END AS slug FROM (SELECT *, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM pages)")
def k16_k17_names(get):
    return get("pages").select("page_id", M.extension(F.col("url")).alias("ext"), T.slug(F.col("url")).alias("slug"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def k26_json_members(get):
    return get("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("SELECT doc_id, sha256(text) AS sha, substr(sha256(text), 1, 16) AS head FROM documents")
def k4_sha256(get):
    return get("documents").select("doc_id", hashing.file_hash(F.col("text")).alias("sha"), F.substring(hashing.file_hash(F.col("text")), 1, 16).alias("head"))


@query("SELECT o_orderkey AS id, CASE WHEN d <= 0 THEN 0.0 WHEN d < 2 THEN d / 2 ELSE least(d / 2, 5.0) END AS seek, w + w % 2 AS width FROM (SELECT o_orderkey, (o_orderkey % 15) - 1.0::DOUBLE AS d, CAST(floor(720 * (1 + o_orderkey % 7 / 10.0::DOUBLE) + 0.5) AS BIGINT) AS w FROM orders)")
def k22_k23_geometry(get):
    o = get("orders")
    return o.select(F.col("o_orderkey").alias("id"), M.cover_seek((F.col("o_orderkey") % 15) - 1.0).alias("seek"), M.render_width(F.lit(720), 1 + F.col("o_orderkey") % 7 / 10.0).alias("width"))


@query("""WITH a AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'mute' WHEN 1 THEN 'replace_with_library' WHEN 2 THEN 'keep_original' END AS mode, CASE WHEN o_orderkey % 3 > 0 THEN 'x' END AS w, CASE WHEN o_orderkey % 5 > 0 THEN 'x' END AS f FROM orders),
b AS (SELECT *, coalesce(mode, CASE WHEN w IS NOT NULL THEN 'replace_with_library' ELSE 'keep_original' END) AS asked FROM a)
SELECT id, CASE WHEN asked = 'replace_with_library' AND f IS NULL THEN 'keep_original' ELSE asked END AS mode, CASE WHEN asked = 'replace_with_library' THEN f END AS background_id, asked = 'mute' OR (asked = 'replace_with_library' AND f IS NOT NULL) AS remove_original, CASE WHEN asked = 'mute' THEN 0.0 ELSE 2.0 END AS fade_out FROM b""")
def k24_audio_policy(get):
    k = F.col("o_orderkey")
    mode = F.when(k % 4 == 0, "mute").when(k % 4 == 1, "replace_with_library").when(k % 4 == 2, "keep_original")
    p = get("orders").select(k.alias("id"), M.audio_policy(mode, F.when(k % 3 > 0, "x"), F.when(k % 5 > 0, "x")).alias("p"))
    return p.select("id", "p.mode", "p.background_id", "p.remove_original", "p.fade_out")


@query("""WITH h AS (SELECT doc_id, sha256(CAST(doc_id AS STRING)) AS h FROM documents), b AS (SELECT doc_id, [('0x' || substr(h, 1 + 2 * k, 2))::INT FOR k IN range(4)] AS b FROM h)
SELECT doc_id, ['sharp', 'maybe_blurry', 'blurry'][CAST(list_sum(b) % 3 + 1 AS BIGINT)] AS blur_class, (b[1] - 128) / 128.0::DOUBLE AS first FROM b""")
def k29_mock_model(get):
    key = F.col("doc_id").cast("string")
    return get("documents").select("doc_id", M.mock_blur_class(key).alias("blur_class"), M.mock_embedding(key)[0].alias("first"))


# --- models ----------------------------------------------------------------------------------------
@query("""WITH r AS (SELECT * FROM calls WHERE id % 5 = 1), l AS (SELECT * FROM calls WHERE status = 'success' AND id % 2 = 0),
k AS (SELECT trip_id, target_id, input_hash, response_summary, row_number() OVER (PARTITION BY trip_id, target_id, input_hash ORDER BY created_at DESC, id DESC) AS n FROM l)
SELECT r.id, k.response_summary AS cached, k.response_summary IS NOT NULL AS hit FROM r LEFT JOIN k ON k.n = 1 AND k.trip_id IS NOT DISTINCT FROM r.trip_id AND k.target_id IS NOT DISTINCT FROM r.target_id AND k.input_hash = r.input_hash""")
def u3_f7_cached_answers(get):
    c = get("calls")
    return models.cached_answers(c.where("id % 5 = 1").select("id", *models.CACHE_KEY), c.where("status = 'success' and id % 2 = 0")).select("id", "cached", "hit")


@query("""WITH r AS (SELECT * FROM calls WHERE id % 5 = 1), l AS (SELECT DISTINCT trip_id, target_id, input_hash FROM calls WHERE status = 'success' AND id % 2 = 0)
SELECT r.id, 'success' AS status, l.input_hash IS NOT NULL AS hit FROM r LEFT JOIN l ON l.trip_id IS NOT DISTINCT FROM r.trip_id AND l.target_id IS NOT DISTINCT FROM r.target_id AND l.input_hash = r.input_hash""")
def u1_u2_answered(get):
    c = get("calls")
    out = models.answered(c.where("id % 5 = 1").select("id", *models.CACHE_KEY), c.where("status = 'success' and id % 2 = 0"), models.provider("local-mock"))
    return out.select("id", "status", "hit")


# --- queue -----------------------------------------------------------------------------------------
@query(f"SELECT id, CASE WHEN retry_count < 3 THEN 'retrying' ELSE 'failed' END AS status, CAST(CASE WHEN retry_count < 3 THEN retry_count + 1 ELSE retry_count END AS INT) AS retry_count FROM jobs WHERE status = 'running' AND (started_at IS NULL OR started_at <= {NOW_SQL} - INTERVAL 30 MINUTE)")
def q5_q6_o7_zombies(get):
    return J.zombies(get("jobs"), now())


@query("""WITH l AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY media_id, job_type ORDER BY created_at DESC, id DESC) = 1), w AS (SELECT o_orderkey AS media_id, 'image_hash' AS job_type FROM orders WHERE o_orderkey % 2 = 0)
SELECT w.media_id, w.job_type, l.id AS job_id, CASE WHEN l.id IS NULL THEN 'created' WHEN l.status IN ('pending', 'running') THEN 'skipped' ELSE 'reset' END AS outcome FROM w LEFT JOIN l USING (media_id, job_type)""")
def q7_enqueue_outcomes(get):
    wanted = get("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("media_id"), F.lit("image_hash").alias("job_type"))
    return J.enqueue_outcomes(wanted, get("jobs"))


@query("SELECT o_orderkey AS media_id, t AS job_type, CAST(k - 1 AS INT) AS ms FROM orders, (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS v(k, t)")
def q8_chain(get):
    out = J.chained(get("orders").select(F.col("o_orderkey").alias("media_id")), ("a", "b", "c"), now())
    ms = F.round((F.col("created_at").cast("timestamp").cast("double") - now().cast("timestamp").cast("double")) * 1000).cast("int")
    return out.select("media_id", "job_type", ms.alias("ms"))


_EVENT = "CASE event_id % 6 WHEN 0 THEN 'start' WHEN 1 THEN 'start' WHEN 2 THEN 'succeed' WHEN 3 THEN 'retry_later' WHEN 4 THEN 'fail' ELSE 'retry' END"


_MOVE = "CASE WHEN e.ev = 'start' AND s.st IN ('pending', 'retrying') THEN 'running' WHEN e.ev = 'succeed' AND s.st = 'running' THEN 'success' WHEN e.ev = 'fail' AND s.st = 'running' THEN 'failed' WHEN e.ev = 'retry_later' AND s.st = 'running' THEN 'retrying' WHEN e.ev = 'retry' AND s.st IN ('failed', 'success', 'cancelled', 'retrying') THEN 'retrying' END"


@query(f"""WITH e AS (SELECT user_id AS job_id, list({{ev: {_EVENT}, st: '', r: 0, a: 0, i: 0}} ORDER BY ts, event_id) AS es FROM events GROUP BY user_id),
f AS (SELECT job_id, list_reduce(list_prepend({{ev: '', st: 'pending', r: 0, a: 0, i: 0}}, es), lambda s, e: {{ev: '', st: coalesce({_MOVE}, s.st),
  r: CASE WHEN {_MOVE} IS NULL THEN s.r WHEN e.ev = 'retry' THEN 0 WHEN e.ev = 'retry_later' THEN s.r + 1 ELSE s.r END, a: s.a + CASE WHEN {_MOVE} IS NULL THEN 0 ELSE 1 END, i: s.i + CASE WHEN {_MOVE} IS NULL THEN 1 ELSE 0 END}}) AS s FROM e)
SELECT job_id, s.st AS status, s.r AS retry_count, s.a AS applied, s.i AS ignored FROM f""")
def q4_fold(get):
    e = get("events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.expr(_EVENT).alias("event"))
    return J.fold(e, slot=F.to_date("ts"))


# --- integrity -------------------------------------------------------------------------------------
@query("SELECT 'size' AS rule, count(*) FILTER (NOT (file_size > 10)) AS n FROM media UNION ALL SELECT 'path', count(*) FILTER (NOT (length(original_path) > 3)) FROM media")
def s2_violations(get):
    return violations(get("media"), {"size": "file_size > 10", "path": "length(original_path) > 3"})


@query("SELECT id FROM groups WHERE recommended_media_id IS NOT NULL AND recommended_media_id NOT IN (SELECT id FROM media)")
def s2_orphans(get):
    return orphans(get("groups"), "recommended_media_id", get("media")).select("id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def s2_repeated_keys(get):
    return repeated(get("lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT t.id, coalesce(n.m, t.cover_media_id) AS cover_media_id FROM trips t LEFT JOIN (SELECT trip_id, min(id) AS m FROM media GROUP BY trip_id) n ON n.trip_id = t.id AND t.id % 2 = 0")
def s4_relinked(get):
    links = get("media").groupBy(F.col("trip_id").alias("id")).agg(F.min("id").alias("cover_media_id")).where("id % 2 = 0")
    return S.relinked(get("trips"), links, "id", "cover_media_id").select("id", "cover_media_id")


@query("""WITH f AS (SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN 'x.jpg' WHEN 1 THEN 'clip.MP4' WHEN 2 THEN '' WHEN 3 THEN 'a.png' WHEN 4 THEN 'b.txt' WHEN 5 THEN 'noext' ELSE 'c.jpeg' END AS name, CASE doc_id % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'mp4' WHEN 2 THEN NULL ELSE 'jpeg' END AS fmt, CASE WHEN doc_id % 4 = 0 THEN 'video/mp4' WHEN doc_id % 4 = 1 THEN 'image/jpeg' END AS mime, doc_id % 31 = 0 AS bad, doc_id % 29 = 0 AS big FROM documents),
e AS (SELECT *, CASE WHEN name LIKE '%.jpg' THEN 'jpg' WHEN name LIKE '%.MP4' THEN 'mp4' WHEN name LIKE '%.png' THEN 'png' WHEN name LIKE '%.txt' THEN 'txt' WHEN name LIKE '%.jpeg' THEN 'jpeg' END AS ext, CASE fmt WHEN 'jpeg' THEN 'image' WHEN 'mp4' THEN 'video' END AS t FROM f),
p AS (SELECT *, name <> '' AND t IS NOT NULL AND (ext IS NULL OR (t = 'image' AND ext IN ('jpg', 'jpeg')) OR (t = 'video' AND ext = 'mp4')) AND (mime IS NULL OR starts_with(mime, t)) AS ok FROM e)
SELECT CASE WHEN bad THEN 'upload_error' WHEN big THEN 'file_too_large' WHEN ok THEN 'accepted' ELSE 'unknown' END AS outcome, CASE WHEN ok THEN t ELSE 'unknown' END AS type, count(*) AS n FROM p GROUP BY ALL""")
def s8_s9_k14_k15_uploads(get):
    k = F.col("doc_id")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % n + 1).cast("int"))
    jpeg, mp4, none = F.unhex(F.lit("FFD8FFE000104A46494600010101")), F.unhex(F.lit("000000186674797069736F6D00000200")), F.unhex(F.lit("00112233445566778899AABBCC"))
    head = F.when(k % 5 == 1, mp4).when(k % 5 == 2, none).otherwise(jpeg)
    u = S.upload_outcome(pick(7, "x.jpg", "clip.MP4", "", "a.png", "b.txt", "noext", "c.jpeg"), pick(4, "video/mp4", "image/jpeg", None, None), head, F.lit(10), F.when(k % 31 == 0, "e"), k % 29 == 0)
    return get("documents").select(u.alias("u")).groupBy("u.outcome", "u.type").agg(F.count(F.lit(1)).alias("n"))


# --- further writes, functions and lists -------------------------------------------------------------
@query("SELECT id, CASE WHEN deleted_at IS NULL THEN 100 ELSE width END AS width, deleted_at IS NULL AS changed FROM media")
def x13_guarded_write(get):
    m = get("media")
    return filters.rewritten(m, F.col("deleted_at").isNull(), width=F.lit(100).cast("long")).select("id", "width", F.col("__changed").alias("changed"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN id * 4 WHEN 1 THEN NULL ELSE cover_media_id END AS cover_media_id, CASE id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE cover_set_by_user END AS cover_set_by_user FROM trips")
def x14_pin_and_reset_cover(get):
    t = get("trips")
    pins = t.where("id % 4 = 0").select("id", (F.col("id") * 4).alias("media_id"))
    return merge.pinned_covers(t, pins, t.where("id % 4 = 1").select("id")).select("id", "cover_media_id", "cover_set_by_user")


@query("SELECT id, CASE WHEN id % 4 = 1 THEN 'keep' ELSE user_decision END AS user_decision, CASE WHEN id % 4 <> 1 THEN 'not_asked' WHEN user_decision = 'keep' THEN 'already_applied' ELSE 'applied' END AS outcome FROM segments")
def x15_segment_decision(get):
    s = get("segments")
    return merge.decided_once(s, s.where("id % 4 = 1").select("id", F.lit("keep").alias("decision"))).select("id", "user_decision", "outcome")


@query(f"WITH {_SES}, sizes AS (SELECT trip_id, group_index, count(*) AS k FROM s GROUP BY trip_id, group_index) SELECT z.trip_id, z.group_index, k AS member_count, t.id IS NOT NULL AS trip_known FROM sizes z LEFT JOIN trips t ON t.id = z.trip_id")
def x17_scene_rows(get):
    groups = scenes.summaries(scenes.sessions(get("points"), gap=_GAP))
    known = get("trips").select(F.col("id").alias("trip_id"), F.lit(True).alias("trip_known"))
    return groups.join(known, "trip_id", "left").select("trip_id", "group_index", "member_count", F.coalesce("trip_known", F.lit(False)).alias("trip_known"))


@query("SELECT id, CASE WHEN status IN ('failed', 'cancelled') THEN 'pending' ELSE status END AS status, CASE WHEN status IN ('failed', 'cancelled') THEN 0 ELSE retry_count END AS retry_count FROM jobs")
def x19_reset_jobs(get):
    jobs = get("jobs").withColumn("retry_count", F.col("retry_count").cast("int"))
    return filters.rewritten(jobs, F.col("status").isin("failed", "cancelled"), retry_count=F.lit(0), status=F.lit("pending")).select("id", "status", "retry_count")


@query("SELECT id FROM jobs WHERE status = 'running' ORDER BY started_at NULLS FIRST, id LIMIT 30")
def o7_zombie_order(get):
    return get("jobs").where("status = 'running'").orderBy(F.asc_nulls_first("started_at"), "id").limit(30).select("id")


@query("SELECT media_id, string_agg(version_type, ',' ORDER BY version_type) AS types FROM versions GROUP BY media_id")
def o8_versions_by_type(get):
    return get("versions").groupBy("media_id").agg(F.array_join(F.array_sort(F.collect_list("version_type")), ",").alias("types"))


@query("""WITH v AS (SELECT user_id AS id, max(ts) AS up, min(ts) AS cur FROM events GROUP BY user_id) SELECT id FROM v WHERE up <= TIMESTAMP '2030-01-01 00:00:00' - INTERVAL 600 SECOND AND up > cur""")
def q10_idle_trips(get):
    t = get("events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_upload_at"), F.min("ts").alias("last_curation_at"))
    return scenes.idle_trips(t, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).select("id")


@query("SELECT event_id, event_id % 3 = 0 AS forced FROM events")
def q12_payload_flags(get):
    k = F.col("event_id") % 3
    payload = F.when(k == 0, '{"force": true}').when(k == 1, '{"force": "true"}').otherwise("{broken")
    return get("events").select("event_id", T.forced(payload).alias("forced"))


@query("SELECT page_id, concat('trips/t', CAST(page_id % 7 AS STRING), '/originals/', CAST(page_id AS STRING), '.jpg') AS path, 'image/jpeg' AS mime, NULL::VARCHAR AS climbing FROM pages")
def s7_s15_paths(get):
    p = get("pages")
    path = T.original_path(F.concat(F.lit("t"), F.col("page_id") % 7), F.col("page_id").cast("string"), F.lit("jpg"))
    return p.select("page_id", path.alias("path"), T.served_mime(path).alias("mime"), T.served_mime(F.concat(F.lit("trips/../"), path)).alias("climbing"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2024-05-06 07:08:09' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS captured FROM events")
def k13_captured_at(get):
    k = F.col("event_id") % 3
    meta = F.when(k == 0, '{"DateTimeOriginal":"2024-05-06T07:08:09"}').when(k == 1, '{"DateTimeOriginal":"never"}').otherwise("{broken")
    return get("events").select("event_id", F.date_format(M.captured_at(meta, F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("captured"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'mp3' WHEN 1 THEN 'wav' WHEN 2 THEN 'm4a' END AS ext FROM documents")
def k18_audio_extension(get):
    k = F.col("doc_id") % 4
    name = F.when(k == 0, "Song.MP3").when(k == 1, "dir/no.txt").otherwise("plain")
    mime = F.when(k == 1, "audio/X-WAV").when(k == 2, "audio/mp4").otherwise("text/plain")
    return get("documents").select("doc_id", T.audio_extension(name, mime).alias("ext"))


@query("""SELECT o_orderkey AS id, CASE WHEN a > 255 OR a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) THEN true ELSE false END AS blocked
FROM (SELECT o_orderkey, o_orderkey % 260 AS a, o_custkey % 256 AS b FROM orders)""")
def k19_blocked_addresses(get):
    ip = F.concat_ws(".", F.col("o_orderkey") % 260, F.col("o_custkey") % 256, F.lit(3), F.lit(4))
    return get("orders").select(F.col("o_orderkey").alias("id"), T.blocked_ip(ip).alias("blocked"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 < 5 THEN 2 ELSE 1 END AS n, CAST(0 AS DOUBLE) AS first FROM orders")
def k20_black_intervals(get):
    k = F.col("o_custkey") % 10
    log = F.concat(F.lit("[x] black_start:4 black_end:"), (4 + F.when(k < 5, 1).otherwise(0)).cast("string"), F.lit(" black_duration:1\n[x] black_start:0 black_end:1.5 black_duration:1.5"))
    found = T.black_intervals(log)
    return get("orders").select(F.col("o_orderkey").alias("id"), F.size(found).alias("n"), found[0]["start"].alias("first"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS number, CASE WHEN l_linenumber > 1 THEN round(l_quantity / (l_linenumber - 1), 9) END AS ratio FROM lineitem")
def k21_number_parsers(get):
    q, n = F.col("l_quantity").cast("string"), F.col("l_linenumber")
    return get("lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), numeric.leading_number(F.concat(q, F.lit(" fps"))).alias("number"), F.round(numeric.rational(F.concat(q, F.lit("/"), n - 1)), 9).alias("ratio"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'sharp' END AS blur_class, CASE WHEN doc_id % 4 = 0 THEN 'trip' END AS scope FROM documents")
def k30_k31_answers(get):
    k = F.col("doc_id")
    answer = F.when(k % 3 == 0, '{"blurClass":"sharp","reason":"ok"}').when(k % 3 == 1, '{"blurClass":"odd","reason":"ok"}').otherwise('{"blurClass":"sharp","reason":""}')
    payload = F.when(k % 4 == 0, '{"scope":"trip","tripId":"7"}').when(k % 4 == 1, '{"scope":"trip"}').when(k % 4 == 2, '{"scope":"group","tripId":"7"}').otherwise("{broken")
    return get("documents").select("doc_id", M.blur_verdict(answer)["blurClass"].alias("blur_class"), T.selector_scope(payload)["scope"].alias("scope"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('afade=t=in:st=0:d=', CAST(o_orderkey % 3 AS STRING)) END AS fade, concat('atrim=start=0:end=', CAST(1 + o_orderkey % 9 AS STRING), ',asetpts=PTS-STARTPTS') AS trim FROM orders")
def k28_filters(get):
    k = F.col("o_orderkey")
    return get("orders").select(k.alias("id"), T.fade_filter(k % 3, F.lit(0), F.lit(9)).alias("fade"), T.trim_filter(F.lit(0), 1 + k % 9, F.lit(None).cast("int")).alias("trim"))


@query("SELECT l_orderkey * 10 + l_linenumber AS k, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, k LIMIT 20")
def o8_largest_keys(get):
    return get("lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(20)


@query("""WITH v AS (SELECT id, quality_score AS q FROM media JOIN analysis ON media_id = id WHERE type = 'image' AND deleted_at IS NULL) SELECT 'applied' AS outcome, count(*) FILTER (q IS NOT NULL) AS n FROM v UNION ALL SELECT 'missing', count(*) FILTER (q IS NULL) FROM v""")
def a10_outcome_histogram(get):
    both = get("media").where("type = 'image' and deleted_at is null").join(get("analysis").withColumnRenamed("media_id", "id"), "id")
    return dedup.histogram(both.select(F.when(F.col("quality_score").isNull(), "missing").otherwise("applied").alias("outcome")), "outcome", ("applied", "missing"))


# --- sources, hooks and handlers ---------------------------------------------------------------------
@query("""SELECT concat('track-', CAST(doc_id AS VARCHAR), '.', CASE doc_id % 4 WHEN 0 THEN 'mp3' WHEN 1 THEN 'FLAC' ELSE 'wav' END) AS name, concat('track-', CAST(doc_id AS VARCHAR)) AS slug, CASE doc_id % 4 WHEN 0 THEN 'mp3' WHEN 1 THEN 'flac' ELSE 'wav' END AS extension,
octet_length(encode(coalesce(text, '')))::BIGINT AS size_bytes, sha256(coalesce(text, '')) AS checksum FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 5 <> 0""")
def s10_audio_seeds(get):
    ext = F.expr("CASE doc_id % 4 WHEN 0 THEN 'mp3' WHEN 1 THEN 'FLAC' WHEN 2 THEN 'wav' ELSE 'txt' END")
    path = F.concat(F.lit("file:/audio/"), F.when(F.col("doc_id") % 5 == 0, ".").otherwise(""), F.lit("track-"), "doc_id", F.lit("."), ext)
    return S.audio_seeds(get("documents").select(path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))


_UPLOAD = """f AS (SELECT doc_id AS id, concat('My Song ', CAST(doc_id % 10 AS STRING), CASE doc_id % 4 WHEN 0 THEN '.MP3' WHEN 1 THEN '' WHEN 2 THEN '.wav' ELSE '.txt' END) AS name, CASE doc_id % 3 WHEN 0 THEN 'audio/OGG' WHEN 1 THEN 'text/plain' END AS mime,
n_chars AS size, concat('c', CAST(n_chars % 400 AS STRING)) AS checksum FROM documents)"""


@query(f"""WITH {_UPLOAD}, l AS (SELECT concat('c', CAST(doc_id % 90 AS VARCHAR)) AS checksum, min(doc_id) AS known FROM documents GROUP BY 1),
e AS (SELECT *, CASE WHEN name LIKE '%.MP3' THEN 'mp3' WHEN name LIKE '%.wav' THEN 'wav' WHEN mime = 'audio/OGG' THEN 'ogg' END AS extension FROM f),
p AS (SELECT *, CASE WHEN coalesce(size, 0) <= 0 THEN 'empty' WHEN size > 5000 THEN 'too_large' WHEN extension IS NULL THEN 'unsupported' END AS problem FROM e),
w AS (SELECT p.*, l.known, min(id) FILTER (problem IS NULL) OVER (PARTITION BY p.checksum) AS first FROM p LEFT JOIN l USING (checksum)),
s AS (SELECT *, CASE WHEN problem IS NULL THEN coalesce(known, CASE WHEN first < id THEN first END) END AS same_as FROM w)
SELECT id, coalesce(problem, CASE WHEN same_as IS NOT NULL THEN 'existing' ELSE 'created' END) AS outcome, extension, CASE WHEN problem IS NULL THEN concat('my-song-', CAST(id % 10 AS VARCHAR)) END AS slug,
  CASE WHEN problem IS NULL THEN CASE WHEN mime = 'audio/OGG' THEN 'audio/ogg' ELSE CASE extension WHEN 'mp3' THEN 'audio/mpeg' WHEN 'wav' THEN 'audio/wav' END END END AS mime, same_as FROM s""")
def s11_audio_uploads(get):
    d = get("documents")
    files = d.selectExpr("doc_id AS id", "concat('My Song ', doc_id % 10, CASE doc_id % 4 WHEN 0 THEN '.MP3' WHEN 1 THEN '' WHEN 2 THEN '.wav' ELSE '.txt' END) AS name", "CASE doc_id % 3 WHEN 0 THEN 'audio/OGG' WHEN 1 THEN 'text/plain' END AS mime", "n_chars AS size", "concat('c', n_chars % 400) AS checksum")
    return S.audio_uploads(files, d.selectExpr("doc_id AS id", "concat('c', doc_id % 90) AS checksum"), 5000)


@query("SELECT o_orderkey AS id, 640 + o_orderkey % 1280 AS width, 'h264' AS codec, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 0.5 ELSE 12.25 END AS duration, CASE WHEN o_orderkey % 2 = 0 THEN 30.0 ELSE 25.0 END AS fps, CASE WHEN o_orderkey % 5 > 0 THEN 'aac' END AS audio_codec FROM orders WHERE o_orderkey % 7 > 0 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 7 = 0")
def s13_probes(get):
    o = get("orders")
    k = F.col("o_orderkey")
    video_ = F.concat(F.lit('{"codec_type":"video","codec_name":"h264","height":720,"duration":"12.25","width":'), 640 + k % 1280, F.lit(',"r_frame_rate":"'), F.when(k % 2 == 0, "30/1").otherwise("0/0"), F.lit('","avg_frame_rate":"25/1"}'))
    audio = F.when(k % 5 > 0, '{"codec_type":"audio","codec_name":"aac"},').otherwise("")
    text = F.when(k % 7 == 0, "{broken").otherwise(F.concat(F.lit('{"streams":['), audio, video_, F.lit('],"format":{'), F.when(k % 3 == 0, F.concat(F.lit('"duration":"'), "o_custkey", F.lit('.5"'))).otherwise(""), F.lit("}}")))
    got = o.select(k.alias("id"), T.probe_projection(text).alias("p"))
    return got.select("id", "p.width", "p.codec", "p.duration", "p.fps", "p.audio_codec")


@query("SELECT c_custkey AS media_id, i AS frame, i * 1.5 AS ts, concat('k/', CAST(c_custkey AS VARCHAR), '/', CAST(i AS VARCHAR)) AS path FROM customer, range(0, 3) AS r(i) WHERE c_custkey % 4 > 0 AND i <= c_custkey % 3")
def s14_manifests(get):
    c = F.col("c_custkey")
    frames = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), c % 3), lambda i: F.concat(F.lit('{"index":'), i, F.lit(',"timestampSec":'), i * 1.5, F.lit(',"path":"k/'), c, F.lit("/"), i, F.lit('"}'))), ",")
    text = F.when(c % 4 == 0, "{broken").otherwise(F.concat(F.lit('{"frames":['), frames, F.lit("]}")))
    return S.manifest_frames(get("customer").select(c.alias("media_id"), text.alias("m")), "m").select("media_id", F.col("frame.index").cast("long").alias("frame"), F.col("frame.timestampSec").alias("ts"), F.col("frame.path").alias("path"))


def _refine(asked):
    k = F.col("media_id") % 6
    return asked.select("media_id", F.when(k < 4, "success").otherwise("failed").alias("status"), F.when(k == 0, b"").when(k < 4, F.encode(F.concat(F.lit("webp "), "path"), "UTF-8")).alias("output"), F.when(k >= 4, "limit reached").alias("error_message"))


_REFINED = """WITH j AS (SELECT event_id AS job_id, user_id % 1500 AS media_id FROM events), a AS (SELECT id AS job_id, id AS audit_id FROM calls WHERE status = 'pending'),
r AS (SELECT j.job_id, a.audit_id, j.media_id, CASE WHEN a.audit_id IS NULL THEN 'no_pending_audit' WHEN m.id IS NULL THEN 'media_missing' WHEN m.type <> 'image' THEN 'not_an_image' WHEN m.original_path IS NULL THEN 'no_original' WHEN m.file_size = 0 THEN 'empty_original'
  WHEN j.media_id % 6 >= 4 THEN 'provider_failed' WHEN j.media_id % 6 = 0 THEN 'empty_output' END AS problem FROM j LEFT JOIN a USING (job_id) LEFT JOIN (SELECT * FROM media WHERE deleted_at IS NULL) m ON m.id = j.media_id)"""


def _refined(get):
    jobs = get("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 1500).alias("media_id"))
    return models.refined_images(jobs, get("calls").withColumn("job_id", F.col("id")), get("media"), _refine)


@query(f"{_REFINED} SELECT job_id, audit_id, media_id, problem, CASE WHEN problem = 'provider_failed' THEN 'limit reached' END AS error_message, CASE WHEN problem IS NULL THEN concat('derived/', CAST(media_id AS VARCHAR), '/ai_refined') END AS file_path FROM r")
def s17_refined_images(get):
    return _refined(get).drop("output")


@query(f"""{_REFINED}, n AS (SELECT DISTINCT media_id FROM r WHERE problem IS NULL)
SELECT v.media_id, v.version_type, v.file_path, v.status, 'kept' AS outcome FROM versions v WHERE v.version_type <> 'ai_refined' OR v.media_id NOT IN (SELECT media_id FROM n)
UNION ALL SELECT n.media_id, 'ai_refined', concat('derived/', CAST(n.media_id AS VARCHAR), '/ai_refined'), 'ready', CASE WHEN v.media_id IS NULL THEN 'inserted' ELSE 'updated' END FROM n LEFT JOIN versions v ON v.media_id = n.media_id AND v.version_type = 'ai_refined'""")
def s17_refined_versions(get):
    base = get("versions").select("media_id", "version_type", "file_path", "status")
    return merge.upserted(base, models.refined_versions(_refined(get)), ["media_id", "version_type"])


@query(f"""{_REFINED} SELECT c.id, CASE WHEN r.audit_id IS NULL THEN c.status WHEN r.problem IS NULL THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN r.audit_id IS NULL THEN c.response_summary WHEN r.problem IS NULL THEN concat('derived/', CAST(r.media_id AS VARCHAR), '/ai_refined') END AS response_summary FROM calls c LEFT JOIN r ON r.audit_id = c.id""")
def s17_audited(get):
    log = get("calls").select("id", "status", "response_summary", F.lit(None).cast("string").alias("error_message"))
    return models.audited(log, models.audit_results(_refined(get))).drop("error_message")


@query(f"WITH {_SES} SELECT trip_id, group_index, count(*) AS n, 'code-time-1.0+scene_embedding-pending' AS algorithm_version FROM s GROUP BY trip_id, group_index")
def u4_scene_versions(get):
    rows = scenes.sessions(get("points"), gap=_GAP)
    return scenes.versioned(rows.groupBy("trip_id", "group_index").agg(F.count(F.lit(1)).alias("n")), scenes.mock_embeddings())


@query(f"""WITH {_CLIPS}, q AS (SELECT trip_id, id, least(c, 60.0 - start) AS s, row_number() OVER (PARTITION BY trip_id ORDER BY created_at, id) - 1 AS o FROM p WHERE start < 60.0 - 1e-6)
SELECT trip_id, id, round(CASE WHEN trip_id % 3 = 0 THEN s / 2 ELSE s END, 4) AS clip_seconds, o AS clip_order, trip_id % 3 = 0 AS ai_refined FROM q""")
def u5_refined_plans(get):
    """A refiner that halves clips; its plans of two trips in three break the rules, so these keep their base plan."""
    k = F.col("trip_id") % 3

    def refiner(clips):
        return clips.withColumn("clip_seconds", F.when(k == 0, F.col("clip_seconds") / 2).when(k == 1, -F.col("clip_seconds")).otherwise(F.col("clip_seconds") + 60))

    out = video.refined_plan(_clips(get), refiner)
    return out.select("trip_id", "id", F.round("clip_seconds", 4).alias("clip_seconds"), F.col("clip_order").cast("long").alias("clip_order"), "ai_refined")


@query("SELECT id, media_id, 'media' AS target_type, CAST(media_id AS VARCHAR) AS target_id, job_type, status, 0 AS progress, retry_count, 32 AS key_length FROM jobs")
def s3_rebuilt_jobs(get):
    new = S.rebuilt(get("jobs"), {"id": None, "media_id": None, "target_type": F.lit("media"), "target_id": F.col("media_id").cast("string"), "dedupe_key": S.random_key(), "job_type": None, "status": None, "progress": F.lit(0), "retry_count": None})
    return new.withColumn("key_length", F.length("dedupe_key")).drop("dedupe_key")


@query("SELECT c_custkey, length(trim(c_name)) > 0 AS named, concat(trim(c_name), '/', CAST(c_custkey AS VARCHAR)) AS label, concat('1998-06-', lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0'), 'T12:30:00.250Z') AS at FROM customer")
def k27_strings(get):
    at = F.make_timestamp_ntz(F.lit(1998), F.lit(6), (1 + F.col("c_custkey") % 28).cast("int"), F.lit(12), F.lit(30), F.lit(0.25).cast("decimal(8,6)"))
    return get("customer").select("c_custkey", (F.length(F.trim("c_name")) > 0).alias("named"), F.concat(F.trim("c_name"), F.lit("/"), "c_custkey").alias("label"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"))


@query("SELECT c_custkey, concat('loudnorm=I=-', CAST(10 + c_custkey % 14 AS VARCHAR), ':TP=-1.5:LRA=', CAST(c_custkey % 20 AS VARCHAR)) AS filter, concat('trips/t', CAST(c_custkey % 7 AS VARCHAR), '/derived/m', CAST(c_custkey AS VARCHAR), '/segments/s1.mp4') AS path FROM customer")
def k28_k32_loudness_and_paths(get):
    k = F.col("c_custkey")
    return get("customer").select("c_custkey", T.loudness_filter(-(10 + k % 14).cast("double"), F.lit(-1.5), (k % 20).cast("double")).alias("filter"), T.segment_path(F.concat(F.lit("t"), k % 7), F.concat(F.lit("m"), k), F.lit("s1")).alias("path"))


def _number(x: str, digits: int) -> str:
    return f"regexp_replace(printf('%.{digits}f', floor(({x}) * {10**digits} + 0.5) / {10**digits}), '\\.?0+$', '')"


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN l_discount * 10 END AS b, l_tax * 5 AS d FROM lineitem), w AS (SELECT *, b * (1 - d) AS q FROM v)
SELECT l_orderkey, l_linenumber, concat('blur=', coalesce(printf('%.3f', floor(b * 1000 + 0.5) / 1000), 'NULL'), ' blackRatio=', printf('%.3f', floor(d * 1000 + 0.5) / 1000), ' quality=', coalesce(printf('%.3f', floor(q * 1000 + 0.5) / 1000), 'NULL'), ' waste=none keyframes=', CAST(l_linenumber % 3 AS VARCHAR),
  CASE WHEN l_linenumber % 3 = 0 THEN ' (no keyframes in interval; blur degraded to NULL)' ELSE '' END, CASE WHEN coalesce(q >= 0.5, false) THEN ' recommended' ELSE '' END) AS reason FROM w""")
def k32_segment_reasons(get):
    n = F.col("l_linenumber") % 3
    rows = get("lineitem").select("l_orderkey", "l_linenumber", F.when(n > 0, F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 5).alias("d"), n.alias("n"))
    rows = rows.withColumn("q", F.col("b") * (1 - F.col("d")))
    return rows.select("l_orderkey", "l_linenumber", T.segment_reason(F.col("b"), F.col("d"), F.col("q"), F.lit("none"), F.col("n"), F.coalesce(F.col("q") >= 0.5, F.lit(False))).alias("reason"))


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS b, CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 4 END AS e, CASE WHEN l_linenumber % 3 = 0 THEN l_discount * 8 END AS c FROM lineitem),
w AS (SELECT *, 0.45 + CASE WHEN e IS NULL THEN 0 ELSE 0.35 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END AS t FROM v)
SELECT l_orderkey, l_linenumber, concat('final quality ', {_number("b", 3)}, ' — blur=', {_number("b", 3)}, ' [sharp, variance=', {_number("b * 100", 2)}, ']', CASE WHEN e IS NULL THEN '' ELSE concat(' | exposure=', {_number("e", 3)}, ' [?]') END,
  CASE WHEN c IS NULL THEN '' ELSE concat(' | color=', {_number("c", 3)}, ' (eff ', {_number("0.5 + 0.5 * c", 3)}, ') [warm, labels=a,b]') END, ' | weights blur=0.45→', {_number("0.45 / t", 3)}, CASE WHEN e IS NULL THEN '' ELSE concat(' exposure=0.35→', {_number("0.35 / t", 3)}) END, CASE WHEN c IS NULL THEN '' ELSE concat(' color=0.2→', {_number("0.2 / t", 3)}) END,
  CASE WHEN e IS NULL AND c IS NULL THEN ' (skipped: exposure, color)' WHEN e IS NULL THEN ' (skipped: exposure)' WHEN c IS NULL THEN ' (skipped: color)' ELSE '' END) AS reason FROM w""")
def k32_final_reasons(get):
    n, b = F.col("l_linenumber"), F.col("l_discount") * 5
    raw = F.concat(F.lit('{"blur":{"classification":"sharp","laplacianVariance":'), (b * 100).cast("string"), F.lit('},"color":{"colorCast":"warm","labels":["a","b"]}}'))
    reason = T.final_reason(b, b, F.when(n % 2 == 0, F.col("l_tax") * 4), F.when(n % 3 == 0, F.col("l_discount") * 8), raw)
    rows = dealt(get, get("lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), "l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query("""WITH r AS (SELECT id, job_type, retry_count, media_id FROM jobs WHERE status = 'running'),
e AS (SELECT *, CASE WHEN job_type NOT IN ('image_thumbnail', 'image_hash') THEN concat('no handler for job type ', job_type) WHEN job_type = 'image_hash' AND media_id % 3 = 0 THEN 'unreadable'
 WHEN job_type = 'image_thumbnail' AND media_id % 5 = 0 THEN 'the handler gave no result' END AS error, job_type IN ('image_thumbnail', 'image_hash') AS known FROM r)
SELECT id, CASE WHEN error IS NULL THEN 'success' WHEN known AND retry_count < 3 THEN 'retrying' ELSE 'failed' END AS status, CAST(CASE WHEN error IS NOT NULL AND known AND retry_count < 3 THEN retry_count + 1 ELSE retry_count END AS BIGINT) AS retry_count,
 CASE WHEN error IS NOT NULL AND known AND retry_count < 3 THEN least(1000 * CAST(pow(2, retry_count) AS BIGINT), 60000) END AS delay_ms, error AS error_message FROM e""")
def u6_dispatched_jobs(get):
    handlers = {
        "image_hash": lambda own: own.select("id", F.when(F.col("media_id") % 3 == 0, "unreadable").alias("error")),
        "image_thumbnail": lambda own: own.where("media_id % 5 <> 0").select("id", F.lit(None).cast("string").alias("error")),
    }
    out = J.dispatched(get("jobs"), handlers)
    return out.withColumn("retry_count", F.col("retry_count").cast("long")).withColumn("delay_ms", F.col("delay_ms").cast("long"))


from . import grids, media_files, streams  # noqa: E402, F401  they register their own queries
