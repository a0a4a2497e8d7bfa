"""Python data sources: a store of sorted files that answers key ranges, and polls of a tree as a stream of changes.

The store's files hold rows in the order of a key, each file a range of its own; a list of files with their first and last
key is written when all tasks have ended well, and names the files that count.  A scan's conditions on the key (equality,
lists, ranges, prefixes) choose the files before any task starts.

A poll is a listing of paths and hashes, kept in ``BUCKETS`` parts by path.  The stream's offset is the number of the last
poll; a task compares one part of one poll with the same part of the poll before.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FILES = "_files.json"
BUCKETS = 16
POLLED = "poll long, path string, change string, hash string"


def _at(path: str):
    """(file system, root) of a folder that all executors see."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def _list(path: str) -> dict:
    files, root = _at(path)
    with files.open_input_stream(f"{root}/{FILES}") as f:
        return json.loads(f.read())


# ---------------------------------------------------------------- sorted store


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, key: str, rows: int, schema: StructType):
        self.path, self.key, self.rows, self.schema = path, key, rows, schema.json()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _at(self.path)
        files.create_dir(root, recursive=True)
        held, n, made = [], 0, []

        def close(table: pa.Table) -> None:
            name = f"{uuid.uuid4().hex}.parquet"
            with files.open_output_stream(f"{root}/{name}") as out:
                pq.write_table(table, out)
            keys = table.column(self.key)
            made.append([name, keys[0].as_py(), keys[-1].as_py(), table.num_rows])

        for b in iterator:
            while b.num_rows:
                part = b.slice(0, self.rows - n)
                held.append(part)
                b, n = b.slice(part.num_rows), n + part.num_rows
                if n == self.rows:
                    close(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            close(pa.Table.from_batches(held))
        return _Written(made)

    def commit(self, messages: list) -> None:
        files, root = _at(self.path)
        files.create_dir(root, recursive=True)
        rows = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        with files.open_output_stream(f"{root}/{FILES}") as out:
            out.write(json.dumps({"key": self.key, "schema": self.schema, "files": rows}).encode())

    def abort(self, messages: list) -> None:
        files, root = _at(self.path)
        for m in messages:
            for f in m.files if m else ():
                files.delete_file(f"{root}/{f[0]}")


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, listed = path, _list(path)
        self.key, self.files = listed["key"], listed["files"]

    def _may(self, f: Filter, low: str, high: str) -> bool | None:
        """Whether a file from low to high may have a row that meets the filter; None for filters on something else."""
        if tuple(getattr(f, "attribute", ())) != (self.key,):
            return None
        v = f.value
        if isinstance(f, EqualTo):
            return low <= v <= high
        if isinstance(f, In):
            return any(low <= x <= high for x in v if x is not None)
        if isinstance(f, GreaterThan):
            return high > v
        if isinstance(f, GreaterThanOrEqual):
            return high >= v
        if isinstance(f, LessThan):
            return low < v
        if isinstance(f, LessThanOrEqual):
            return low <= v
        if isinstance(f, StringStartsWith):
            return high >= v and (low < v or low.startswith(v))
        return None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            # a file may have other rows as well, so Spark looks at the condition again
            if hasattr(f, "value"):
                self.files = [x for x in self.files if self._may(f, x[1], x[2]) is not False]
            yield f

    def partitions(self) -> list[_File]:
        return [_File(x[0]) for x in self.files] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.name:
            files, root = _at(self.path)
            with files.open_input_file(f"{root}/{partition.name}") as f:
                yield from pq.ParquetFile(f).iter_batches()


class SortedStore(DataSource):
    """Rows in the order of the option ``key`` (a string column without nulls), at most ``rows`` in a file, below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "loomery_sorted"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(_list(self.options["path"])["schema"]))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options["key"], int(self.options["rows"]), schema)


def write(rows: DataFrame, path: str, key: str, file_rows: int = 1_000_000) -> None:
    """Store ``rows``; those before, if any, are replaced once all are written."""
    rows.sparkSession.dataSource.register(SortedStore)
    rows.filter(F.col(key).isNotNull()).orderBy(key).write.format("loomery_sorted").option("path", path).option("key", key).option("rows", str(file_rows)).mode("overwrite").save()


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; conditions on the key choose files."""
    spark.dataSource.register(SortedStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("loomery_sorted").option("path", path).load()


# ---------------------------------------------------------------- polls


@dataclass
class _Part(InputPartition):
    poll: int
    bucket: int


class _Polls(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"poll": -1}

    def latestOffset(self) -> dict:
        """The last poll with a mark that it is whole."""
        from pyarrow import fs

        files, root = _at(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        done = [int(x.base_name.removeprefix("whole-")) for x in found if x.base_name.startswith("whole-")]
        return {"poll": max(done, default=-1)}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return [_Part(n, b) for n in range(start["poll"] + 1, end["poll"] + 1) for b in range(BUCKETS)]

    def _listing(self, poll: int, bucket: int) -> dict[str, str]:
        from pyarrow import fs

        files, root = _at(self.path)
        out: dict[str, str] = {}
        for x in files.get_file_info(fs.FileSelector(f"{root}/{poll}/bucket={bucket}", allow_not_found=True)):
            if x.base_name.endswith(".parquet"):
                with files.open_input_file(x.path) as f:
                    table = pq.ParquetFile(f).read(["path", "hash"])
                out.update(zip(table.column("path").to_pylist(), table.column("hash").to_pylist()))
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        n, b = partition.poll, partition.bucket
        before, now = self._listing(n - 1, b) if n else {}, self._listing(n, b)
        for path, digest in now.items():
            if path not in before:
                yield n, path, "new", digest
            elif before[path] != digest:
                yield n, path, "modified", digest
        for path, digest in before.items():
            if path not in now:
                yield n, path, "deleted", digest


class Polls(DataSource):
    """Changes from poll to poll of the listings that ``record_poll`` has written below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "loomery_polls"

    def schema(self) -> str:
        return POLLED

    def streamReader(self, schema: StructType) -> _Polls:
        return _Polls(self.options["path"])


def record_poll(listing: DataFrame, path: str, poll: int) -> None:
    """Keep a listing (path, hash) as poll number ``poll``."""
    parts = listing.select("path", "hash", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    parts.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/{poll}")
    files, root = _at(path)
    with files.open_output_stream(f"{root}/whole-{poll}") as out:
        out.write(b"")


def poll_stream(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Polls)
    return spark.readStream.format("loomery_polls").option("path", path).load()
