"""Ingest that applies each file once: micro-batches written under their number, and a ledger that says which of them count.

The stream's checkpoint knows which files were read, so a later run reads new files only. A batch's rows go to their own folder, replacing what an
earlier attempt has left there; then its number enters the ledger; then Spark commits the batch. Killed before the ledger entry, the batch runs
again and replaces its rows; killed after it, the replayed batch is recognised and changes nothing. Readers see only batches of the ledger,
so they never see half a batch. The same ledger, by name instead of number, applies named changes of tables (migrations) once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import audio_seeds


class Ledger:
    """Rows by batch and the batches that count, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str):
        self.spark, self.folder = spark, folder
        self.schema = spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long")).schema

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def has(self, batch: int) -> bool:
        return self._exists(f"{self.folder}/ledger/batch={batch}/_SUCCESS")

    def rows(self) -> DataFrame:
        """The rows of all batches that count, with their batch."""
        if not self._exists(f"{self.folder}/ledger"):
            return self.spark.createDataFrame([], self.schema)
        counted = self.spark.read.schema("at timestamp, batch long").parquet(f"{self.folder}/ledger").select("batch")
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows").join(counted, "batch", "left_semi")

    def apply(self, batch: int, rows: DataFrame, before_commit: Callable[[int], None] | None = None) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        if before_commit:
            before_commit(batch)
        self.spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")


def ingest_once(stream: DataFrame, ledger: Ledger, checkpoint: str, change: Callable[[DataFrame, DataFrame], DataFrame], before_commit: Callable[[int], None] | None = None) -> None:
    """Applies all that is there to be read, then ends. change(batch, rows so far) gives the rows to add; it must give the same for a batch that runs again.

    before_commit is called between a batch's rows and its ledger entry (tests stop the run there).
    """

    def each(batch: DataFrame, number: int) -> None:
        if not ledger.has(number):
            ledger.apply(number, change(batch, ledger.rows()), before_commit)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


SEEDS = "name string, slug string, extension string, size_bytes long, checksum string, outcome string"


def seeded(files: DataFrame, library: DataFrame) -> DataFrame:
    """Rows of SEEDS of audio files (path, content): inserted for the first file (by name) of a checksum that the library does not have, else known."""
    rows = audio_seeds(files).drop("path", "content")
    known = library.select("checksum").distinct().withColumn("__known", F.lit(True))
    first = rows.groupBy("checksum").agg(F.min("name").alias("__first"))
    rows = rows.join(first, "checksum").join(known, "checksum", "left")
    outcome = F.when(F.col("__known").isNull() & (F.col("name") == F.col("__first")), "inserted").otherwise("known")
    return rows.select("name", "slug", "extension", "size_bytes", "checksum", outcome.alias("outcome"))


def apply_changes(spark: SparkSession, folder: str, changes: Mapping[str, Callable[[SparkSession], None]]) -> tuple[list[str], list[str]]:
    """(applied now, applied before) of named changes, in order of their names; each is recorded after it was made, so one that fails is tried again next time.

    A change that is killed halfway runs again from its start: it should replace what it writes.
    """
    done, before = [], []
    for name in sorted(changes):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/changes/{name}")
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(at):
            before.append(name)
            continue
        changes[name](spark)
        store.create(at, False).close()
        done.append(name)
    return done, before
