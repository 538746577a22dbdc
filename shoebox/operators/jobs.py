"""Job queue: roll-ups, claims, retries, zombies, enqueue decisions and the fold of job events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import backoff_ms
from .filters import due
from .ranking import latest_per

STATES = ("pending", "running", "success", "failed", "retrying", "cancelled")
ACTIVE = ("pending", "running", "retrying")


def status_counts(jobs: DataFrame, *keys: str) -> DataFrame:
    return jobs.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))


def media_status(media: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, status) of media from their jobs: active, then failed, then success count; archived and deleted ones stay."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    by = jobs.groupBy(F.col("media_id").alias("id")).agg(n(*ACTIVE).alias("active"), n("failed").alias("failed"), n("success").alias("success"), F.count(F.lit(1)).alias("jobs"))
    new = F.when(F.col("status").isin("archived", "deleted") | F.col("jobs").isNull(), F.col("status")).when(F.col("active") > 0, "processing").when(F.col("failed") > 0, "failed").when(F.col("success") > 0, "processed").otherwise("failed")
    return media.select("id", "status").join(by, "id", "left").select("id", new.alias("status"))


def claims(jobs: DataFrame, channels: DataFrame, now: Column) -> DataFrame:
    """Jobs to run now: the oldest due ones of each channel, up to what its concurrency leaves free.

    channels: channel, job_type, concurrency. Only as many rows as a channel may run leave each task.
    """
    named = jobs.join(channels, "job_type")
    busy = named.where("status = 'running'").groupBy("channel").agg(F.count(F.lit(1)).alias("busy"))
    order = Window.partitionBy("channel").orderBy("created_at", "id")
    ready = named.where(due(now)).join(busy, "channel", "left").withColumn("free", F.col("concurrency") - F.coalesce("busy", F.lit(0)))
    most = channels.agg(F.max("concurrency")).first()[0] or 0
    return ready.withColumn("turn", F.row_number().over(order)).where((F.col("turn") <= most) & (F.col("turn") <= F.col("free"))).select("channel", "id", "job_type", "turn")


def after_failure(retries: Column, most: Column, base: int = 1000, longest: int = 60_000) -> Column:
    """struct(status, retry_count, delay_ms) after a job failed."""
    again = retries < most
    return F.struct(F.when(again, "retrying").otherwise("failed").alias("status"), F.when(again, retries + 1).otherwise(retries).alias("retry_count"), F.when(again, backoff_ms(retries, base, longest)).alias("delay_ms"))


def zombies(jobs: DataFrame, now: Column, timeout_seconds: int = 1800, most: int = 3) -> DataFrame:
    """(id, status, retry_count): running jobs that began too long ago, or never, after recovery."""
    t = lambda c: c.cast("timestamp").cast("double")
    lost = jobs.where((F.col("status") == "running") & (F.col("started_at").isNull() | (t(F.col("started_at")) <= t(now) - timeout_seconds)))
    after = after_failure(F.col("retry_count"), F.lit(most))
    return lost.select("id", after["status"].alias("status"), after["retry_count"].alias("retry_count"))


def enqueue_outcomes(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """(media_id, job_type, job_id, outcome) of asking for jobs: created, skipped (one is waiting or runs), or reset."""
    last = latest_per(jobs.select("id", "media_id", "job_type", "status", "created_at"), ["media_id", "job_type"])
    rows = wanted.join(last, ["media_id", "job_type"], "left")
    return rows.select("media_id", "job_type", F.col("id").alias("job_id"), F.when(F.col("id").isNull(), "created").when(F.col("status").isin("pending", "running"), "skipped").otherwise("reset").alias("outcome"))


def chained(media: DataFrame, types: tuple[str, ...], now: Column) -> DataFrame:
    """Jobs of a medium in a fixed order: each is made a millisecond after the one before."""
    steps = F.posexplode(F.array(*[F.lit(t) for t in types])).alias("step", "job_type")
    return media.select("media_id", steps).withColumn("created_at", now + F.make_dt_interval(secs=F.col("step").cast("decimal(18,6)") / 1000))


def retryable(status: Column) -> Column:
    """Whether a user may run a job again."""
    return status.isin("failed", "success", "cancelled", "retrying")


def cancellable(status: Column) -> Column:
    return status.isin("pending", "retrying", "running")


#: Event -> (states from which it applies, state after it).
MOVES = {
    "start": (("pending", "retrying"), "running"), "succeed": (("running",), "success"), "fail": (("running",), "failed"), "retry_later": (("running",), "retrying"),
    "cancel": (("pending", "retrying", "running"), "cancelled"), "retry": (("failed", "success", "cancelled", "retrying"), "retrying"),
}


def fold(events: DataFrame, key: str = "job_id", time: str = "ts", tie: str = "seq", slot: Column | None = None) -> DataFrame:
    """(key, status, retry_count, applied, ignored) of jobs after their events in order.

    Events that do not apply in a state are ignored, as a conditional update would change no row. What some events in a row do
    is a map from each of the six states to a state and counts, and such maps can be put together: the events of a slot of
    time (slot, a column that rises with the time: a day, say) become one map, in as many tasks as there are slots, and a job's maps are applied in order.
    So a row holds a slot's events or a job's slots, never all events of a job. Without a slot a job's events are one.
    """
    zero = lambda st: F.struct(F.lit(st).alias("status"), F.lit(False).alias("reset"), F.lit(0).alias("added"), F.lit(0).alias("applied"), F.lit(0).alias("ignored"))

    def step(s: Column, event: Column) -> Column:
        to = F.lit(None).cast("string")
        for name, (sources, target) in MOVES.items():
            to = F.when((event == name) & s["status"].isin(*sources), target).otherwise(to)

        def after(to: Column) -> Column:
            hit, again = to.isNotNull(), to.isNotNull() & (event == "retry")
            added = F.when(again, 0).when(hit & (event == "retry_later"), s["added"] + 1).otherwise(s["added"])
            return F.struct(F.coalesce(to, s["status"]).alias("status"), (s["reset"] | again).alias("reset"), added.alias("added"), (s["applied"] + hit.cast("int")).alias("applied"), (s["ignored"] + (~hit).cast("int")).alias("ignored"))

        return F.transform(F.array(to), after)[0]

    slotted = events.select(key, (F.lit(0) if slot is None else slot).alias("__slot"), time, tie, "event")
    by = slotted.groupBy(key, "__slot").agg(F.array_sort(F.collect_list(F.struct(time, tie, F.coalesce("event", F.lit("")).alias("event")))).alias("e"))
    maps = by.select(key, "__slot", F.aggregate("e", F.array(*[zero(st) for st in STATES]), lambda all_, e: F.transform(all_, lambda s: step(s, e["event"]))).alias("map"))
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), F.lit(0).alias("applied"), F.lit(0).alias("ignored"))

    def applied(s: Column, x: Column) -> Column:
        made = F.element_at(x["map"], F.array_position(F.array(*map(F.lit, STATES)), s["status"]).cast("int"))
        retries = lambda m: F.when(m["reset"], m["added"]).otherwise(s["retry_count"] + m["added"])
        return F.transform(F.array(made), lambda m: F.struct(m["status"].alias("status"), retries(m).alias("retry_count"), (s["applied"] + m["applied"]).alias("applied"), (s["ignored"] + m["ignored"]).alias("ignored")))[0]

    jobs = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__slot", "map"))).alias("maps"))
    return jobs.select(key, F.aggregate("maps", start, applied).alias("s")).select(key, "s.*")


HANDLERS: dict = {}


def handles(job_type: str):
    """Register a DataFrame -> DataFrame function as the handler of a job type."""

    def register(fn):
        HANDLERS[job_type] = fn
        return fn

    return register


def dispatched(jobs: DataFrame, handlers: dict | None = None, base: int = 1000, longest: int = 60_000, most: int = 3) -> DataFrame:
    """(id, status, retry_count, delay_ms, error_message) of running jobs after their handlers have run.

    A handler gets all jobs of its type at once and gives (id, error): null for success. A type without a handler fails at once; a job with
    an error, or that its handler has left out, is retried while it may be. Each handler reads only its own type.
    """
    handlers = HANDLERS if handlers is None else handlers
    running = jobs.where("status = 'running'")
    results = None
    for kind, handler in handlers.items():
        own = running.where(F.col("job_type") == kind)
        done = own.select("id", "retry_count").join(handler(own).select("id", F.col("error").alias("__error"), F.lit(True).alias("__ran")), "id", "left")
        error = F.when(F.col("__ran").isNull(), "the handler gave no result").otherwise(F.col("__error"))
        part = done.select("id", "retry_count", error.alias("error_message"), F.lit(True).alias("__known"))
        results = part if results is None else results.unionByName(part)
    none = running.where(~F.coalesce(F.col("job_type").isin(*handlers), F.lit(False)) if handlers else F.lit(True))
    none = none.select("id", "retry_count", F.concat(F.lit("no handler for job type "), F.coalesce("job_type", F.lit("null"))).alias("error_message"), F.lit(False).alias("__known"))
    results = none if results is None else results.unionByName(none)
    after = after_failure(F.col("retry_count"), F.lit(most), base, longest)
    good, known = F.col("error_message").isNull(), F.col("__known")
    pick = lambda name: F.when(known, after[name])
    return results.select("id", F.when(good, "success").otherwise(F.coalesce(pick("status"), F.lit("failed"))).alias("status"), F.when(good, F.col("retry_count")).otherwise(F.coalesce(pick("retry_count"), F.col("retry_count"))).alias("retry_count"), F.when(~good, pick("delay_ms")).alias("delay_ms"), "error_message")
