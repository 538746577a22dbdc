"""The media store as a Spark data source: one row for each medium with its key-frame manifest.

    spark.dataSource.register(MediaStore)
    spark.read.format("media_store").load(root).where("trip_id = '7'")

Layout: root/trips/<trip>/derived/<medium>/frames/manifest.json. Only trips are listed when the query is planned, many to a
partition; each task lists its trips' media and reads their manifests. Filters on trip_id and media_id are pushed: a
trip that the query names is not searched for, other trips are never listed, and a named medium is opened without a listing.

Rows: trip_id, media_id, manifest (text, null if there is none). `summaries` reads the text in the JVM: a manifest that is no JSON object
with a list of frames gives null, as a missing one does. Safe segments only: a name with a slash or dots that climb never leaves the root.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

SCHEMA = "trip_id string, media_id string, manifest string"
#: Trips of a partition.
TRIPS = 64


def opened(uri: str):
    """(pyarrow filesystem, path in it)."""
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _safe(name) -> bool:
    return isinstance(name, str) and bool(re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]*", name))


def _folders(store, path: str) -> list[str]:
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)


@dataclass
class Trips(InputPartition):
    names: list

    def __init__(self, names: list):
        self.names = names


class MediaReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.trips, self.media = root.rstrip("/"), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("trip_id",):
                self.trips = values if self.trips is None else self.trips & values
            elif values is not None and f.attribute == ("media_id",):
                self.media = values if self.media is None else self.media & values
            elif not (isinstance(f, IsNotNull) and f.attribute in (("trip_id",), ("media_id",))):  # both are always there
                yield f

    def partitions(self) -> list[Trips]:
        store, root = opened(self.root)
        names = _folders(store, f"{root}/trips") if self.trips is None else sorted(filter(_safe, self.trips))
        return [Trips(names[i : i + TRIPS]) for i in range(0, len(names), TRIPS)] or [Trips([])]

    def read(self, partition: Trips) -> Iterator[tuple]:
        store, root = opened(self.root)
        for trip in partition.names:
            base = f"{root}/trips/{trip}/derived"
            named = None if self.media is None else sorted(filter(_safe, self.media))
            for medium in _folders(store, base) if named is None else named:
                try:
                    with store.open_input_stream(f"{base}/{medium}/frames/manifest.json") as f:
                        yield trip, medium, f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    if named is None or medium in _folders(store, base):
                        yield trip, medium, None


class MediaStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"])


_MANIFEST = "workerVersion string, intervalSec double, frameCount int, sourceDurationSec double, frames array<struct<index:int,timestampSec:double,filePath:string,width:int,height:int,fileSize:long>>"


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The data source over a root, with filters pushed into it."""
    spark.dataSource.register(MediaStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("media_store").load(root)


def summaries(rows: DataFrame) -> DataFrame:
    """(trip_id, media_id, summary): the manifest's fields; null for a missing or broken one."""
    got = F.from_json("manifest", _MANIFEST)
    return rows.select("trip_id", "media_id", F.when(got["frames"].isNotNull(), got).alias("summary"))


def write_manifests(rows: DataFrame, root: str) -> None:
    """Writes the manifests of (trip_id, media_id, manifest) rows, from the tasks; null makes the medium's folder only. A task that runs again replaces its files."""

    def put(batches):
        import pyarrow as pa

        store, base = opened(root.rstrip("/"))
        for batch in batches:
            for trip, medium, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if _safe(trip) and _safe(medium):
                    store.create_dir(f"{base}/trips/{trip}/derived/{medium}/frames")
                    if text is not None:
                        with store.open_output_stream(f"{base}/trips/{trip}/derived/{medium}/frames/manifest.json") as f:
                            f.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.select("trip_id", "media_id", "manifest").mapInArrow(put, "n long").agg(F.sum("n")).collect()


def _valid(path) -> bool:
    return isinstance(path, str) and bool(path) and all(map(_safe, path.split("/")))


def _each(rows: DataFrame, root: str, columns: list[str], out: str, work) -> DataFrame:
    """work(filesystem, place, *row) for each row, in the tasks."""

    def run(batches):
        import pandas as pd

        files, base = opened(root.rstrip("/"))
        for batch in batches:
            made = [work(files, f"{base}/{row[0]}" if _valid(row[0]) else None, *row) for row in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")], dtype=object)

    return rows.select(*columns).mapInPandas(run, out)


def put_objects(rows: DataFrame, root: str) -> DataFrame:
    """Writes objects (path, content, overwrite) and gives (path, outcome): stored, exists, or invalid for a path that is not safe or without content.

    An object that is there is replaced only with overwrite; one that holds the same bytes counts as stored, so a task that runs again
    gives the same outcomes. Of two rows with one path either may come first.
    """

    def put(files, at, path, content, overwrite):
        from pyarrow import fs

        if at is None or content is None:
            return path, "invalid"
        if not overwrite and files.get_file_info(at).type != fs.FileType.NotFound:
            with files.open_input_stream(at) as f:
                return path, "stored" if f.read() == bytes(content) else "exists"
        files.create_dir(at.rpartition("/")[0])
        with files.open_output_stream(at) as f:
            f.write(content)
        return path, "stored"

    return _each(rows, root, ["path", "content", "overwrite"], "path string, outcome string", put)


def read_objects(rows: DataFrame, root: str) -> DataFrame:
    """(path, found, content) of paths; whether it is there, and its bytes."""

    def read(files, at, path):
        try:
            with files.open_input_stream(at or "") as f:
                return path, True, f.read()
        except OSError:  # not there, or a folder
            return path, False, None

    return _each(rows, root, ["path"], "path string, found boolean, content binary", read)


def remove_objects(rows: DataFrame, root: str) -> DataFrame:
    """Removes objects and gives (path, removed). To be written once: a second run finds nothing left to remove."""

    def remove(files, at, path):
        try:
            files.delete_file(at or "")
            return path, True
        except OSError:
            return path, False

    return _each(rows, root, ["path"], "path string, removed boolean", remove)
