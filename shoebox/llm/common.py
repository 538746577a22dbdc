"""Shared helpers: files of the shared work folder, text expressions."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import work_folder, written  # noqa: F401

#: Java regular expressions for the words [^\x20\x09-\x0D]+ and the gaps between them.
WORD = r"[^ \t-\r]+"
GAP = r"[ \t-\r]+"


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a URI, for use within tasks."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body mentions it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run in the shared folder; the caller removes a table once its successor is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, work_folder(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
