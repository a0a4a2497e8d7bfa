"""Shared plumbing of the training-data operators: table access, durable cuts, Arrow kernels, row numbering."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sessions of cuts that still exist, by path; a cut's frame holds its path.
_CUTS: dict[str, SparkSession] = {}
#: Where ``cuts_of`` notes the paths of cuts made inside it.
_NOTES: list[list[str]] = []
#: Settings of a cut's write: its shuffle files go when it ends, and rows of whole texts go to Python in smaller batches.
_WRITE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1500"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's reader opens it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.  Only a local session may do without and gets one temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomery.cut.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomery-")
        spark.conf.set("loomery.cut.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from those files.

    The lineage ends there, a lost executor costs a re-read only, and values that depend on how a
    scan was split (partition numbers) stay as they were drawn.  The write's own shuffle files go as soon as it has
    ended; the cut's files go with ``release``, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomery/{uuid.uuid4().hex}/{label}"
    schema = df.schema
    before = {k: spark.conf.get(k) for k in _WRITE}
    try:
        for k, v in _WRITE.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _CUTS[path] = spark
    for note in _NOTES:
        note.append(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def shared_path(spark: SparkSession, label: str) -> str:
    """A folder for files other than cuts in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/loomery/{uuid.uuid4().hex}/{label}"
    _CUTS[path] = spark
    return path


def _delete(path: str) -> None:
    spark = _CUTS.pop(path, None)
    if spark is None:
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder's owner clears it
        return


def release(*frames: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more."""
    for df in frames:
        _delete(getattr(df, "_cut_path", ""))


@contextlib.contextmanager
def cuts_of() -> Iterator[list[str]]:
    """The paths of all cuts made inside, as they are made."""
    made: list[str] = []
    _NOTES.append(made)
    try:
        yield made
    finally:
        _NOTES.remove(made)


def release_paths(paths: list[str], but_for: DataFrame) -> None:
    """Delete cuts by path, except those that ``but_for`` reads."""
    read = but_for.inputFiles() if any(p in _CUTS for p in paths) else []
    for p in paths:
        if not any(p.split("/")[-2] in f for f in read):
            _delete(p)


@atexit.register
def _drop_cuts() -> None:
    for path in list(_CUTS):
        _delete(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever its characters."""
    return f"`{name.replace('`', '``')}`"


def give_back() -> None:
    """Return free memory to the system: a worker that is kept for other stages would hold on to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        return


def arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``kernel`` over Arrow batches, one pass over each partition."""

    @functools.wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        give_back()

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of ``column``, so that a kernel's memory doesn't follow Spark's batch size."""
    for b in batches:
        if not b.num_rows:
            continue
        # even parts
        parts = max(1, -(-b.column(column).nbytes // most_bytes))
        at, step = 0, max(1, -(-b.num_rows // parts))
        while at < b.num_rows:
            part = b.slice(at, step)
            # rows may be uneven: halve until the slice fits, one row at least
            while part.num_rows > 1 and part.column(column).nbytes > 4 * most_bytes:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def gapless(rows: DataFrame, group: str, local: str, out: str) -> DataFrame:
    """Add ``out``: a number from 0 without gaps within each ``group``.

    ``rows`` is a cut frame with ``_pid`` (where a row was first read) and ``local`` (its number from 0 among the rows
    of its ``_pid`` and ``group``).  Each (group, _pid) contributes one count row; running sums over those give every
    block its start.  No task ever holds a whole group, however hot.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(group, "_pid").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long").alias("_start"))
    starts = starts.withColumnRenamed(group, "_g").withColumnRenamed("_pid", "_p")
    joined = rows.join(starts, rows[group].eqNullSafe(starts["_g"]) & (rows["_pid"] == starts["_p"]), "left")
    return joined.withColumn(out, (F.col("_start") + F.col(local)).cast("long")).drop("_g", "_p", "_start")
