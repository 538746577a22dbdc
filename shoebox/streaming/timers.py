"""Job supervision on a stream: a running job without a sign of life is found dead while the stream runs, and is retried or given up.

A job has a state (status, retries, due time) and the events that the watermark has not reached yet; it is next looked at at the first of
these events or at the due time: a running job's last sign plus the timeout, a retry's time, or
the time when a job at rest is forgotten. Then the events up to the watermark are applied in order, and what falls due
before each of them and before the watermark is settled. So the outcomes depend neither on the order in which events came nor on how
they were cut into batches; events that are late for the watermark are dropped by Spark.

Jobs are dealt over buckets by a hash of their ids. A bucket is one group with one event-time timer, at the first time one of its jobs is to be looked at, and
its state is read and written once a batch: state calls leave Python, and with a group for each job they were most of the time. A bucket's jobs are
in memory together, so the number of buckets (`buckets`, which must not change while a stream lives) goes with the number of jobs; a few hundred jobs
a bucket take some tens of KB. A batch rewrites the buckets that it touches.

State is on disk (RocksDB), so it may exceed memory. A job holds only its events of the last `late` interval; a job at rest
is forgotten after `forget`, so state does not grow for ever.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOMES = "job_id long, outcome string, at timestamp, retry_count int"
#: The jobs of a bucket as JSON: by id, [status, retries, due] or null, and the events that wait.
_STATE = "jobs string"
BUCKETS = 4096
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Supervisor(StatefulProcessor):
    """The jobs of a bucket. Times are in milliseconds. Events: job_id, ms, event (start and heartbeat are signs of life; fail, succeed)."""

    def __init__(self, timeout: int, base: int, longest: int, most: int, forget: int):
        self.timeout, self.base, self.longest, self.most, self.forget = timeout, base, longest, most, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state, self.alarm = handle.getValueState("jobs", _STATE), handle.getValueState("alarm", "at long")

    def _strike(self, retries: int, at: int, kind: str, out: list) -> tuple[str, int, int]:
        """The state after a failure or a death at a time: a retry while there are some left."""
        if retries >= self.most:
            out.append(("failed", at, retries))
            return "failed", retries, at + self.forget
        if kind == "zombie":
            out.append(("zombie", at, retries + 1))
        return "retrying", retries + 1, at + min(self.base * 2**retries, self.longest)

    def _settled(self, state: tuple[str, int, int] | None, until: int, out: list) -> tuple[str, int, int] | None:
        """The state after all that fell due before a time."""
        while state and state[2] < until:
            status, retries, due = state
            if status == "running":
                state = self._strike(retries, due, "zombie", out)
            elif status == "retrying":
                out.append(("retry_due", due, retries))
                state = "waiting", retries, due + self.forget
            else:
                state = None
        return state

    def _after(self, state: tuple[str, int, int] | None, ms: int, event: str, out: list) -> tuple[str, int, int] | None:
        state = self._settled(state, ms, out)
        if state and state[0] == "failed":
            return state
        retries = state[1] if state else 0
        if event == "fail":
            return self._strike(retries, ms, "fail", out)
        return ("done", retries, ms + self.forget) if event == "succeed" else ("running", retries, ms + self.timeout)

    def _set_alarm(self, at: int | None, fired: int | None = None) -> None:
        """Moves the bucket's one timer."""
        old = self.alarm.get()[0] if self.alarm.exists() else None
        if old == at:
            return
        if old is not None and old != fired:
            self.handle.deleteTimer(old)
        if at is None:
            self.alarm.clear()
        else:
            self.alarm.update((at,))
            self.handle.registerTimer(at)

    def _jobs(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def _advance(self, jobs: dict, mark: int, fired: int | None) -> Iterator[pd.DataFrame]:
        """Brings each job up to the watermark, keeps what is left and sets the timer."""
        found, left, alarm = [], {}, None
        for job, (state, waiting) in jobs.items():
            waiting.sort()
            out, rest = [], []
            state = tuple(state) if state else None
            for ms, event in waiting:
                if ms <= mark:
                    state = self._after(state, ms, event, out)
                else:
                    rest.append((ms, event))
            state = self._settled(state, mark + 1, out)
            found += [(int(job), *o) for o in out]
            if state or rest:
                left[job] = state, rest
                for at in ([state[2]] if state else []) + ([rest[0][0]] if rest else []):
                    alarm = at if alarm is None else min(alarm, at)
        self.state.update((json.dumps(left),)) if left else self.state.clear()
        self._set_alarm(alarm, fired)
        if found:
            job, outcome, at, retries = zip(*found, strict=True)
            yield pd.DataFrame({"job_id": job, "outcome": outcome, "at": pd.to_datetime(list(at), unit="ms", utc=True), "retry_count": retries})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        jobs = self._jobs()
        for part in rows:
            for job, ms, event in zip(part["job_id"].astype(str).tolist(), part["ms"].astype(int).tolist(), part["event"].tolist(), strict=True):
                jobs.setdefault(job, (None, []))[1].append([ms, event])
        return self._advance(jobs, timerValues.getCurrentWatermarkInMs(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        return self._advance(self._jobs(), max(timerValues.getCurrentWatermarkInMs(), fired), fired)


@contextmanager
def state_on_disk(spark: SparkSession):
    """State stores that hold timers, for the streams started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def supervised(events: DataFrame, late: str, timeout_ms: int = 1_800_000, base_ms: int = 1000, longest_ms: int = 60_000, most: int = 3, forget_ms: int = 7 * 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """(job_id, outcome, at, retry_count) of a stream of job_id, ts, event: zombie and failed when found, retry_due when a retry may run.

    To be started within state_on_disk.
    """
    stamped = events.select(F.col("job_id").cast("long").alias("job_id"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"), "event").withWatermark("ts", late)
    rows = stamped.select(F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"), "job_id", "ts", F.unix_millis("ts").alias("ms"), "event")
    return rows.groupBy("bucket").transformWithStateInPandas(Supervisor(timeout_ms, base_ms, longest_ms, most, forget_ms), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")
