"""Frames of the data model over the driver's tables, in SQL that Spark and DuckDB both read.

`frame(spark, folder, name)` gives a DataFrame; `with_frames(sql)` puts the frames that a query names before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FRAMES = {
    "media": """SELECT o_orderkey AS id, o_custkey % 50 AS trip_id, CASE WHEN o_orderkey % 5 = 0 THEN 'video' ELSE 'image' END AS type,
        CASE WHEN o_orderkey % 13 <> 0 THEN concat('p/', CAST(o_orderkey AS STRING)) END AS original_path,
        CASE WHEN o_orderkey % 3 <> 0 THEN concat('t/', CAST(o_orderkey AS STRING)) END AS thumbnail_path,
        o_orderkey * 7 % 1000 AS file_size, o_orderkey % 37 AS width, o_orderkey % 41 AS height, o_totalprice / 10000 AS duration,
        CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'processed' ELSE 'failed' END AS status, o_orderdate AS created_at,
        CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS deleted_at, CASE WHEN o_orderkey % 4 = 0 THEN 'enhanced' END AS active_version_type,
        o_custkey * 31 % 400 AS file_hash FROM {orders}""",
    "analysis": """SELECT l_orderkey AS media_id, CASE WHEN l_orderkey % 7 <> 0 THEN min(l_quantity) / 50 END AS quality_score,
        CASE WHEN l_orderkey % 5 <> 1 THEN max(l_discount) * 10 END AS sharpness_score, CASE WHEN l_orderkey % 6 <> 2 THEN max(l_tax) * 10 END AS exposure_score,
        CASE WHEN l_orderkey % 4 <> 3 THEN min(l_discount) * 10 END AS color_score, CASE WHEN l_orderkey % 3 = 0 THEN true WHEN l_orderkey % 3 = 1 THEN false END AS is_blurry,
        l_orderkey % 9 = 0 AS is_duplicate, CASE l_orderkey % 5 WHEN 0 THEN 'sharp' WHEN 1 THEN 'maybe_blurry' WHEN 2 THEN 'blurry' WHEN 3 THEN 'unknown' END AS ai_blur_class
        FROM {lineitem} GROUP BY l_orderkey""",
    "jobs": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS media_id, CASE l_linenumber % 4 WHEN 0 THEN 'image_thumbnail' WHEN 1 THEN 'image_hash' WHEN 2 THEN 'video_metadata' ELSE 'imagexhash' END AS job_type,
        CASE min(concat(l_returnflag, l_linestatus)) WHEN 'AF' THEN 'success' WHEN 'AO' THEN 'pending' WHEN 'NF' THEN 'running' WHEN 'NO' THEN 'retrying' WHEN 'RF' THEN 'failed' ELSE 'cancelled' END AS status,
        l_linenumber % 5 AS retry_count, min(l_shipdate) AS created_at, CASE WHEN l_orderkey % 3 > 0 THEN max(l_shipdate) END AS next_run_at,
        CASE WHEN l_orderkey % 4 > 0 THEN max(l_shipdate) END AS started_at FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "versions": """SELECT l_orderkey AS media_id, CASE l_linenumber WHEN 1 THEN 'enhanced' WHEN 2 THEN 'ai_refined' WHEN 3 THEN 'metadata' WHEN 4 THEN 'proxy' WHEN 5 THEN 'preview' ELSE concat('view_', CAST(l_linenumber AS STRING)) END AS version_type,
        min(concat('v/', CAST(l_partkey AS STRING))) AS file_path, min(CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'ready' END) AS status, max(CAST(l_quantity AS BIGINT)) % 7 AS file_size,
        CASE WHEN l_orderkey % 8 = 0 THEN min(l_shipdate) END AS deleted_at FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "trips": """SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 4 END AS cover_media_id, c_custkey % 7 = 0 AS cover_set_by_user,
        CASE WHEN c_custkey % 10 = 0 THEN c_custkey END AS deleted_at FROM {customer}""",
    "points": """SELECT event_id AS id, user_id % 200 AS trip_id, ts AS captured_at, ts AS created_at, CASE WHEN event_id % 6 <> 0 THEN value END AS quality,
        CASE event_type WHEN 'view' THEN 'sharp' WHEN 'click' THEN 'maybe_blurry' WHEN 'purchase' THEN 'blurry' END AS ai_blur_class, event_id % 4 = 0 AS is_blurry, event_id % 9 = 0 AS is_duplicate FROM {events}""",
    "hashes": """SELECT doc_id AS id, lang AS trip_id, 'image' AS type, text, source, n_chars FROM {documents}""",
    "segments": """SELECT o_orderkey AS id, o_custkey AS media_id, CAST(o_orderkey % 100 AS DOUBLE) AS start, CAST(o_orderkey % 100 AS DOUBLE) + 1 + o_orderkey % 17 AS end_time,
        CASE o_orderkey % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'undecided' ELSE 'remove' END AS user_decision FROM {orders}""",
    "frames": """SELECT o_custkey AS media_id, CAST(l_orderkey % 120 AS DOUBLE) + l_linenumber AS ts, l_discount * 10 AS sharpness FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "black": """SELECT o_custkey AS media_id, CAST(o_orderkey % 90 AS DOUBLE) AS start, CAST(o_orderkey % 90 AS DOUBLE) + 5 AS end_time FROM {orders} WHERE o_orderkey % 4 = 0""",
    "calls": """SELECT event_id AS id, CASE WHEN user_id % 9 > 0 THEN user_id % 20 END AS trip_id, 'ai_blur_check' AS request_type, 'media' AS target_type, CASE WHEN user_id % 4 > 0 THEN user_id % 30 END AS target_id,
        CAST(event_id % 13 AS STRING) AS input_hash, CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' ELSE 'pending' END AS status, concat('r', CAST(event_id AS STRING)) AS response_summary,
        ts AS created_at, user_id % 1500 AS media_id, props FROM {events}""",
    "picked": """SELECT o_custkey % 50 AS trip_id, o_orderkey % 60 AS media_id, CAST(o_orderkey % 4 AS INT) AS selection_round, min(o_orderstatus) <> 'O' AS included, o_orderkey % 4 > 1 AS is_current,
        CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN min(o_orderkey) % 8 = 0 THEN 'kept' ELSE 'excluded' END END AS user_decision FROM {orders} GROUP BY o_custkey % 50, o_orderkey % 60, o_orderkey % 4""",
    "groups": """SELECT c_custkey AS id, c_custkey % 50 AS trip_id, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 11 + 1 END AS recommended_media_id, c_custkey % 5 = 0 AS user_confirmed FROM {customer}""",
    "members": """SELECT o_custkey AS group_id, o_orderkey AS media_id, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 500000 END AS similarity_score, CASE WHEN o_orderkey % 2 = 0 THEN 'remove' ELSE 'keep' END AS recommendation,
        'undecided' AS user_decision FROM {orders}""",
}
_NAME = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    sql = FRAMES[name]
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in set(_NAME.findall(sql))}
    return spark.sql(sql, **tables)


def with_frames(sql: str) -> str:
    used = [n for n in FRAMES if re.search(rf"\b(FROM|JOIN)\s+{n}\b|,\s*{n}\b", sql)]
    heads = [f"{n} AS ({_NAME.sub(lambda m: m[1], FRAMES[n])})" for n in used]
    if not heads:
        return sql
    recursive, body = "", sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = "RECURSIVE ", body[15:]
        return f"WITH {recursive}{', '.join(heads)}, {body}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(heads)}, {body[5:]}"
    return f"WITH {', '.join(heads)} {body}"
