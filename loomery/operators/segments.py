"""A stored index of postings that follows changes: segments, tombstones, merges by size.

Each batch of changes becomes one segment: the postings of the rows it puts, and tombstones for all ids it names, which hide
those ids' rows in every earlier segment.  Statistics follow from sums: a tombstone notes the row and the words it hides.
When the newest segments together are as large as the one before them, they are merged with it, without their hidden
rows: sizes at least halve from one segment to the next, so there are some log2(size) segments and a posting is rewritten as
often at most.  Only neighbours are merged, so a tombstone's reach stays a comparison of numbers.

Within a segment postings are dealt by ranges of (term, id) and sorted: a term lies in one file or, if it is common, in
several that are full of it.  The first and last term of each file are kept beside it, so a search for prefixes names the
few files that it opens.

A state of the index is a version of its manifest, written last: a batch that fails leaves the version before it, and
readers keep theirs until ``vacuum``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import text as T

from .search import bm25_of, postings, ts_rank, word_count

#: Postings of a file, about.
FILE_ROWS = 2_000_000
#: Words of a segment for which another core sorts and writes.
AT_WORK = 200_000

_POSTINGS, _DOCS, _TOMBSTONES, _RANGES = "term string, id long, tf long, dl long", "id long, dl long", "id long, upto long, dl long", "file string, low string, high string, number long"
_MANIFEST = "version long, kind string, number long, folder string, postings long, docs long, words long"


@dataclass(frozen=True)
class Part:
    """A segment, or the tombstones of a batch (``docs`` and ``words`` are then what they hide)."""

    kind: str
    number: int
    folder: str
    postings: int
    docs: int
    words: int


@dataclass(frozen=True)
class PostingsIndex:
    """One version of the index below ``path``; ``apply`` and ``merge`` return the next."""

    spark: SparkSession
    path: str
    fields: tuple[str, ...]
    version: int = 0
    parts: tuple[Part, ...] = ()
    file_rows: int = FILE_ROWS

    @staticmethod
    def open(spark: SparkSession, path: str, fields: Sequence[str]) -> PostingsIndex:
        """The last version that was written."""
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/*")
        # one row for each part of the last version
        last = rows.join(F.broadcast(rows.agg(F.max("version").alias("_v"))), F.col("version") == F.col("_v")).collect()
        return PostingsIndex(spark, path, tuple(fields), last[0]["version"], tuple(sorted((Part(*(r[c] for c in Part.__dataclass_fields__)) for r in last if r["kind"] != "none"), key=lambda p: (p.kind, p.number))))

    # ------------------------------------------------------------ what is in it

    @property
    def segments(self) -> list[Part]:
        return [p for p in self.parts if p.kind == "segment"]

    @property
    def n_docs(self) -> int:
        return sum(p.docs if p.kind == "segment" else -p.docs for p in self.parts)

    @property
    def mean_words(self) -> float:
        return sum(p.words if p.kind == "segment" else -p.words for p in self.parts) / max(self.n_docs, 1)

    def _tombstones(self, below: int) -> DataFrame | None:
        """(id, upto): rows of the id in segments before ``upto`` are hidden; those that can't meet a segment after ``below`` are left out."""
        own = [p.folder for p in self.parts if p.kind == "tombstones" and p.number > below]
        return self.spark.read.schema(_TOMBSTONES).parquet(*own).select(F.col("id").alias("_id"), "upto") if own else None

    def _alive(self, rows: DataFrame, below: int) -> DataFrame:
        """``rows`` (id, number, ...) without those that tombstones hide."""
        hidden = self._tombstones(below)
        return rows if hidden is None else rows.join(hidden, (F.col("id") == F.col("_id")) & (F.col("number") < F.col("upto")), "left_anti")

    def _read(self, name: str, of: Sequence[Part]) -> DataFrame | None:
        out, schema = None, _DOCS if name == "docs" else _POSTINGS
        for p in of:
            rows = self.spark.read.schema(schema).parquet(f"{p.folder}/{name}").withColumn("number", F.lit(p.number).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def files(self, prefixes: Sequence[str]) -> list[tuple[Part, str]]:
        """The files whose terms' range meets a prefix's."""
        if not self.segments:
            return []
        ranges = self.spark.read.schema(_RANGES).parquet(*(f"{p.folder}/ranges" for p in self.segments))
        met = ranges.filter(_any(*((F.col("low") < p + "\U0010ffff") & (F.col("high") >= p) for p in prefixes)))
        by = {p.number: p for p in self.segments}
        return [(by[r["number"]], r["file"]) for r in met.orderBy("number", "file").collect()]

    def find(self, prefixes: Sequence[str]) -> DataFrame:
        """(term, id, tf, dl) of live postings whose term begins with one of the prefixes; opens only files that may have some."""
        by: dict[int, list[str]] = {}
        for p, file in self.files(prefixes):
            by.setdefault(p.number, []).append(file)
        own = _any(*((F.col("term") >= p) & (F.col("term") < p + "\U0010ffff") for p in prefixes))
        out = None
        for number, files in by.items():
            rows = self.spark.read.schema(_POSTINGS).parquet(*files).filter(own).withColumn("number", F.lit(number).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], _POSTINGS)
        return self._alive(out, min(by)).drop("number")

    def rows(self) -> DataFrame:
        """All live postings."""
        out = self._read("postings", self.segments)
        if out is None:
            return self.spark.createDataFrame([], _POSTINGS)
        return self._alive(out, self.segments[0].number).drop("number")

    def bm25(self, query: str) -> DataFrame:
        """(id, score), as a scan of the live rows would give."""
        prefixes = _prefixes(query)
        if not prefixes:
            return self.spark.createDataFrame([], "id long, score double")
        return bm25_of(self.find(prefixes), prefixes, self.n_docs, self.mean_words)

    def ts_rank(self, query: str) -> DataFrame:
        """(id, score) by the database's rank."""
        prefixes = _prefixes(query)
        if not prefixes:
            return self.spark.createDataFrame([], "id long, score double")
        return ts_rank(self.find(prefixes), prefixes)

    # ------------------------------------------------------------ changes

    def build(self, docs: DataFrame, id_col: str) -> PostingsIndex:
        """The first segment, of all rows."""
        return self.apply(docs.select(F.col(id_col).cast("long").alias("id"), F.lit("put").alias("op"), F.lit(0).alias("seq"), *self.fields))

    def apply(self, changes: DataFrame, merged: bool = True) -> PostingsIndex:
        """Take in (id, op, seq, fields): ``put`` sets a row, ``delete`` removes it; of several changes to an id the one with the greatest seq counts."""
        number = 1 + max((p.number for p in self.parts), default=0)
        folder = self._folder(f"batch-{number}")
        last = changes.groupBy("id").agg(F.max_by(F.struct("op", *self.fields), "seq").alias("_c")).select("id", "_c.*")
        last.write.parquet(f"{folder}/changes")
        last = self.spark.read.schema(last.schema).parquet(f"{folder}/changes")
        parts = [*self.parts]
        if self.segments:
            live = self._alive(self._read("docs", self.segments), self.segments[0].number).select(F.col("id").alias("_id"), "dl")
            # ids that no segment has need no tombstone
            gone = last.select("id").join(live, F.col("id") == F.col("_id")).select("id", F.lit(number).cast("long").alias("upto"), "dl")
            gone.write.parquet(f"{folder}/tombstones")
            docs, words = self.spark.read.schema(_TOMBSTONES).parquet(f"{folder}/tombstones").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).head()
            if docs:
                parts.append(Part("tombstones", number, f"{folder}/tombstones", 0, docs, words))
        put = last.filter("op = 'put'")
        rows = postings(put, "id", self.fields)
        segment = self._write(folder, number, rows, put.select("id", word_count(self.fields).alias("dl")))
        if segment.docs:
            parts.append(segment)
        after = replace(self, version=self.version + 1, parts=tuple(parts))
        if merged:
            after = after._merged()
        after = replace(after, parts=tuple(sorted(after.parts, key=lambda p: (p.kind, p.number))))
        after._commit()
        return after

    def _write(self, folder: str, number: int, rows: DataFrame, docs: DataFrame) -> Part:
        docs.write.parquet(f"{folder}/docs")
        n_docs, words = self.spark.read.schema(_DOCS).parquet(f"{folder}/docs").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).head()
        # there are no more postings than words; a small segment still keeps all cores at work
        files = max(1, -(-words // self.file_rows), min(self.spark.sparkContext.defaultParallelism, words // AT_WORK))
        rows.repartitionByRange(files, "term", "id").sortWithinPartitions("term", "id").write.parquet(f"{folder}/postings")
        n = self.spark.read.schema(_POSTINGS).parquet(f"{folder}/postings").count()
        by_file = self.spark.read.schema(rows.schema).parquet(f"{folder}/postings").groupBy(F.col("_metadata.file_path").alias("file"))
        by_file.agg(F.min("term").alias("low"), F.max("term").alias("high"), F.lit(number).cast("long").alias("number")).write.parquet(f"{folder}/ranges")
        return Part("segment", number, folder, n, n_docs, words)

    def _merged(self) -> PostingsIndex:
        """The newest segments merged as far back as they are as large as the next one."""
        run = _run(self.segments)
        if len(run) < 2:
            return self
        number, below = run[-1].number, run[0].number
        folder = self._folder(f"merge-{number}")
        live = self._alive(self._read("postings", run), below).drop("number")
        docs = self._alive(self._read("docs", run), below).drop("number")
        segment = self._write(folder, number, live, docs)
        rest = [p for p in self.segments if p not in run] + ([segment] if segment.docs else [])
        # what tombstones hid within the run is out of the sums on both sides now
        hidden = sum(p.docs for p in run) - segment.docs, sum(p.words for p in run) - segment.words
        stones = [p for p in self.parts if p.kind == "tombstones"]
        return replace(self, parts=tuple([*rest, *_less(stones, rest, *hidden)]))

    def _commit(self) -> None:
        rows = [(self.version, *(getattr(p, c) for c in Part.__dataclass_fields__)) for p in self.parts] or [(self.version, "none", 0, "", 0, 0, 0)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{self.version}")

    def _folder(self, label: str) -> str:
        return f"{self.path}/{label}-{uuid.uuid4().hex}"

    def vacuum(self) -> int:
        """Delete the folders that this version doesn't read; the number deleted.  Readers of earlier versions lose theirs."""
        read = {f"{p.folder}/{name}" for p in self.segments for name in ("postings", "docs", "ranges")} | {p.folder for p in self.parts if p.kind == "tombstones"}
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = 0
        for name in (s.getPath().getName() for s in fs.listStatus(top)):
            if name == "manifest":
                continue
            own = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(top, name))]
            old = [x for x in own if f"{self.path}/{name}/{x}" not in read]
            for x in [""] if old == own else old:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{x}".rstrip("/")), True)
            gone += len(old)
        return gone


def _prefixes(query: str) -> list[str]:
    return [p.lower() for p in T.query_terms(query)]


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _less(stones: list[Part], segments: list[Part], docs: int, words: int) -> list[Part]:
    """Tombstones after a merge that removed so many hidden rows: the sums of all go down by as much, and those that reach no segment go."""
    first = min((p.number for p in segments), default=math.inf)
    kept = [p for p in stones if p.number > first]
    gone = [p for p in stones if p.number <= first]
    # sums are of all tombstones together, so it doesn't matter which of them carries what is left
    docs, words = sum(p.docs for p in gone) - docs, sum(p.words for p in gone) - words
    if kept:
        return [replace(kept[0], docs=kept[0].docs + docs, words=kept[0].words + words), *kept[1:]]
    return []


def _run(segments: list[Part]) -> list[Part]:
    """The newest segments, and those before them that are no larger than all after."""
    start, total = len(segments), 0
    for k in range(len(segments) - 1, -1, -1):
        if start < len(segments) and segments[k].postings > total:
            break
        start, total = k, total + segments[k].postings
    return segments[start:]
