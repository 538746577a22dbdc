"""Streaming forms: gap sessions over event time, and the fold of job events with state per job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import MOVES


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; a processing-time trigger is the polling queue's timer."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def session_stream(events: DataFrame, key: str, time: str, gap_seconds: int, late: str = "1 day") -> DataFrame:
    """(key, start, end, n) of gap sessions; a gap of exactly gap_seconds does not split, as in the batch form."""
    stamped = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    # Sessions merge while events are less than the gap apart; one microsecond more keeps equality inside.
    window = F.session_window("__time", f"{gap_seconds} seconds 1 microsecond")
    return stamped.groupBy(key, window.alias("w")).agg(F.min("__time").alias("start"), F.max("__time").alias("end"), F.count(F.lit(1)).alias("n")).select(key, "start", "end", "n")


def _folded(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, retries, applied, ignored = state.get if state.exists else ("pending", 0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
    for event in rows["event"]:
        move = MOVES.get(event)
        if move and status in move[0]:
            status, applied = move[1], applied + 1
            retries = 0 if event == "retry" else retries + (event == "retry_later")
        else:
            ignored += 1
    state.update((status, retries, applied, ignored))
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "retry_count": [retries], "applied": [applied], "ignored": [ignored]})


def fold_stream(events: DataFrame) -> DataFrame:
    """Latest state of each job after each micro-batch (update mode). events: job_id, ts, seq, event, in order between batches."""
    kind = dict(events.dtypes)["job_id"]
    return events.select("job_id", "ts", "seq", "event").groupBy("job_id").applyInPandasWithState(_folded, f"job_id {kind}, status string, retry_count int, applied int, ignored int", "status string, retry_count int, applied int, ignored int", "update", GroupStateTimeout.NoTimeout)
