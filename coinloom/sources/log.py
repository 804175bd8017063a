"""Tables as Parquet files under a log of commits.

Commit n is the file `log/<n>.json`. It is put in place whole and only if it isn't there
yet, so of two writers that both saw commit n - 1 one gets n and the other learns of it. A
commit adds files, names lists of ids whose earlier rows are gone, or replaces all before it.
Files are laid out by time; the log holds the time range of each, so that a reader who knows
the times it needs opens only these. An unfinished write leaves files that no commit names.

A commit's entries are as many as its files, and a file holds about ROWS_PER_FILE rows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from typing import NamedTuple
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 1_000_000


class DataFile(NamedTuple):
    """A file of a table: its place under the table, rows, first and last time (none if no row has one), and the commit that added it."""

    path: str
    rows: int
    first_ms: int | None
    last_ms: int | None
    version: int = 0

    def meets(self, ranges: Iterable[tuple[int, int]]) -> bool:
        return self.first_ms is not None and any(self.first_ms <= last and first <= self.last_ms for first, last in ranges)


class Change(NamedTuple):
    """What a commit does; `batch` is (stream, number) of a micro-batch."""

    files: tuple[DataFile, ...] = ()
    gone: tuple[str, ...] = ()
    replaces: bool = False
    batch: tuple[str, int] | None = None


class Snapshot(NamedTuple):
    """A table as of a commit: its files, the id lists with the commits they came with, and each stream's last micro-batch."""

    version: int = 0
    files: tuple[DataFile, ...] = ()
    gone: tuple[tuple[str, int], ...] = ()
    batches: tuple[tuple[str, int], ...] = ()

    def after(self, version: int, change: Change) -> Snapshot:
        files = tuple(f._replace(version=version) for f in change.files)
        gone = tuple((path, version) for path in change.gone)
        batches = {**dict(self.batches), **({change.batch[0]: change.batch[1]} if change.batch else {})}
        kept = ((), ()) if change.replaces else (self.files, self.gone)
        return Snapshot(version, kept[0] + files, kept[1] + gone, tuple(sorted(batches.items())))

    def within(self, ranges: Iterable[tuple[int, int]]) -> Snapshot:
        """The files that may hold rows of these times (first, last)."""
        ranges = list(ranges)
        return self._replace(files=tuple(f for f in self.files if f.meets(ranges)))


class TableLog:
    """One table's commits and files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known = Snapshot()

    def _hadoop(self, *parts: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, version: int) -> Change | None:
        at, fs = self._hadoop("log", f"{version:012d}.json")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Change(tuple(DataFile(*f) for f in found["files"]), tuple(found["gone"]), found["replaces"], tuple(found["batch"]) if found["batch"] else None)

    def snapshot(self) -> Snapshot:
        while change := self._read(self._known.version + 1):
            self._known = self._known.after(self._known.version + 1, change)
        return self._known

    def at(self, version: int) -> Snapshot:
        """The table as of a commit."""
        found = Snapshot()
        for number in range(1, version + 1):
            found = found.after(number, self._read(number))
        return found

    def replaced(self, after: int, upto: int) -> bool:
        """Whether a commit after one, up to another, replaced all before it."""
        return any(self._read(number).replaces for number in range(after + 1, upto + 1))

    def ids(self, lists: Iterable[str]) -> DataFrame:
        """The ids of these lists."""
        return self.spark.read.schema("id string").parquet(*[f"{self.path}/{p}" for p in lists]).distinct()

    def put(self, version: int, change: Change) -> bool:
        """Make the change commit `version`; false, and nothing done, if there is one."""
        body = json.dumps({"files": [list(f[:4]) for f in change.files], "gone": list(change.gone), "replaces": change.replaces, "batch": change.batch})
        target, fs = self._hadoop("log", f"{version:012d}.json")
        draft, _ = self._hadoop("log", f".{version}-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(body.encode()))
        out.close()
        try:
            return self._rename(draft, target, fs)
        finally:
            fs.delete(draft, False)

    def _rename(self, draft, target, fs) -> bool:
        """Rename unless the target exists: one step of the file system, which of two writers lets one through."""
        if fs.getUri().getScheme() == "file":
            where = [unquote(urlparse(fs.makeQualified(p).toString()).path) for p in (draft, target)]
            try:
                os.link(*where)
            except FileExistsError:
                return False
            return True
        jvm = self.spark._jvm
        options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def commit(self, change: Change) -> int:
        """Add a change that is right after any other one; the number it got."""
        version = self.snapshot().version + 1
        while not self.put(version, change):
            version = self.snapshot().version + 1
        return version

    def write(self, rows: DataFrame, schema: T.StructType, ms: Column | None = None) -> tuple[DataFile, ...]:
        """Files with the rows, by time where `ms` gives one; no commit names them yet."""
        folder = f"data/{uuid.uuid4().hex}"
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        rows = rows.select(*columns)
        if ms is not None:
            # rows of one time may be most of a table: their content deals them out
            rows = rows.withColumn("__ms", ms).withColumn("__tie", F.xxhash64(*schema.names)).repartitionByRange("__ms", "__tie").sortWithinPartitions("__ms").drop("__ms", "__tie")
        rows.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{self.path}/{folder}")
        name = F.element_at(F.split("_metadata.file_path", "/"), -1)
        when = ms if ms is not None else F.lit(None).cast("long")
        found = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").withColumn("__ms", when).groupBy(name.alias("name"))
        return tuple(DataFile(f"{folder}/{r.name}", r.n, r.first, r.last) for r in found.agg(F.count("*").alias("n"), F.min("__ms").alias("first"), F.max("__ms").alias("last")).collect())

    def write_ids(self, ids: DataFrame) -> str:
        folder = f"gone/{uuid.uuid4().hex}"
        ids.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct().write.parquet(f"{self.path}/{folder}")
        return folder

    def read(self, snapshot: Snapshot, schema: T.StructType) -> DataFrame:
        """The rows of a snapshot's files but those of ids that a later commit lists."""
        if not snapshot.files:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f.path}" for f in snapshot.files])
        oldest = min(f.version for f in snapshot.files)
        gone = {path: version for path, version in snapshot.gone if version > oldest}
        if not gone:
            return rows
        folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
        numbered = lambda of: self.spark.createDataFrame(sorted(of), "__folder string, __version long").distinct()  # noqa: E731  a row a commit
        listed = self.spark.read.schema("id string").parquet(*[f"{self.path}/{p}" for p in gone]).select("id", folder.alias("__folder"))
        listed = listed.join(F.broadcast(numbered((p.split("/")[-1], v) for p, v in gone.items())), "__folder")
        last = listed.groupBy("id").agg(F.max("__version").alias("__gone"))
        rows = rows.withColumn("__folder", folder).join(F.broadcast(numbered((f.path.split("/")[-2], f.version) for f in snapshot.files)), "__folder")
        left = rows.join(last, (rows["id"] == last["id"]) & (rows["__version"] < last["__gone"]), "left_anti")
        return left.select(*schema.names)
