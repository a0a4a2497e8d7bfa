"""A stored view of edge degrees, kept up by counting, and its staleness.

The view holds how often each (src, dst) pair is there, as a log of signed counts, and for each node the number of distinct
pairs that end or begin at it.  A batch of edges added and removed touches the pairs it names: a pair that appears or
vanishes changes two degrees, any other only its count.  What a batch writes are the rows that it changes.

Both logs are partitioned by a hash of their key, and a batch reads the buckets that it touches; ``compact`` rewrites the logs
as one row a key.  A version is whole once its mark is written, so a batch that fails leaves the one before.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_PAIRS, _DEGREES, _MARKS = "src long, dst long, n long, version long, bucket int", "id long, in_degree long, out_degree long, version long, bucket int", "version long, base long, refreshed_ms long, changed long"


@dataclass(frozen=True)
class DegreeView:
    """One version below ``path``; log rows before ``base`` are history."""

    spark: SparkSession
    path: str
    version: int = 0
    base: int = 1
    buckets: int = BUCKETS

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DegreeView:
        """The last whole version."""
        last = spark.read.schema(_MARKS).parquet(f"{path}/marks").orderBy(F.desc("version")).head()
        return DegreeView(spark, path, last["version"], last["base"], buckets)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _log(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        if self.version < self.base:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/version={v}" for v in range(self.base, self.version + 1)))
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def pairs(self, buckets: list[int] | None = None) -> DataFrame:
        """(src, dst, n) of the pairs that are there."""
        return self._log("pairs", _PAIRS, buckets).groupBy("src", "dst").agg(F.sum("n").alias("n")).filter("n > 0")

    def degrees(self, buckets: list[int] | None = None) -> DataFrame:
        """(id, in_degree, out_degree) of the nodes that have an edge: the last row of each."""
        last = self._log("degrees", _DEGREES, buckets).groupBy("id").agg(F.max_by(F.struct("in_degree", "out_degree"), "version").alias("_d"))
        return last.select("id", "_d.*").filter("in_degree + out_degree > 0")

    def apply(self, changes: DataFrame, now_ms: int) -> DegreeView:
        """Take in (src, dst, sign): +1 for an edge added, -1 for one removed; removing what isn't there does nothing."""
        after = replace(self, version=self.version + 1)
        keyed = changes.groupBy("src", "dst").agg(F.sum("sign").alias("_d")).filter("_d <> 0")
        keyed = self._cut(keyed, f"batch/{after.version}")
        # as many numbers as there are buckets at most
        touched = [r[0] for r in keyed.select(self._bucket(F.col("dst"))).distinct().collect()]
        had = self.pairs(touched).withColumnsRenamed({"src": "_s", "dst": "_t", "n": "_had"})
        met = keyed.join(had, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_t")), "left").withColumn("_had", F.coalesce("_had", F.lit(0)))
        met = met.withColumn("n", F.greatest(F.col("_d"), -F.col("_had"))).filter("n <> 0")
        rows = met.select("src", "dst", "n", (F.col("_had") + F.col("n") > 0).cast("int").alias("_is"), (F.col("_had") > 0).cast("int").alias("_was"), self._bucket(F.col("dst")).alias("bucket"))
        rows = self._cut(rows, f"changed/{after.version}")
        after._write(rows.select("src", "dst", "n", "bucket"), "pairs")
        step = (F.col("_is") - F.col("_was")).cast("long")
        ends = F.explode(F.array(F.struct(F.col("dst").alias("id"), step.alias("i"), F.lit(0).cast("long").alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).cast("long").alias("i"), step.alias("o"))))
        moved = rows.filter("_is <> _was").select(ends.alias("_e")).groupBy("_e.id").agg(F.sum("_e.i").alias("_i"), F.sum("_e.o").alias("_o")).filter("_i <> 0 OR _o <> 0")
        moved = self._cut(moved, f"moved/{after.version}")
        touched = [r[0] for r in moved.select(self._bucket(F.col("id"))).distinct().collect()]
        old = self.degrees(touched).withColumnRenamed("id", "_id")
        new = moved.join(old, F.col("id") == F.col("_id"), "left").select("id", (F.coalesce("in_degree", F.lit(0)) + F.col("_i")).alias("in_degree"), (F.coalesce("out_degree", F.lit(0)) + F.col("_o")).alias("out_degree"), self._bucket(F.col("id")).alias("bucket"))
        after._write(new, "degrees")
        after._mark(now_ms, moved.count())
        return after

    def compact(self, now_ms: int) -> DegreeView:
        """The same state as one row a key, in a version that begins a new log."""
        after = replace(self, version=self.version + 1, base=self.version + 1)
        after._write(self.pairs().select("src", "dst", "n", self._bucket(F.col("dst")).alias("bucket")), "pairs")
        after._write(self.degrees().select("id", "in_degree", "out_degree", self._bucket(F.col("id")).alias("bucket")), "degrees")
        after._mark(now_ms, 0)
        return after

    def changed(self, version: int) -> DataFrame:
        """The degree rows that a version has written."""
        return self.spark.read.schema(_DEGREES).option("basePath", f"{self.path}/degrees").parquet(f"{self.path}/degrees/version={version}").select("id", "in_degree", "out_degree")

    def refreshes(self) -> DataFrame:
        """(version, refreshed_ms, changed) of every version."""
        return self.spark.read.schema(_MARKS).parquet(f"{self.path}/marks").select("version", "refreshed_ms", "changed")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/version={self.version}")

    def _cut(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def _mark(self, now_ms: int, changed: int) -> None:
        self.spark.createDataFrame([(self.version, self.base, now_ms, changed)], _MARKS).coalesce(1).write.mode("append").parquet(f"{self.path}/marks")


def staleness(refreshes: DataFrame, by: str, at: str, now: Column, most: int) -> DataFrame:
    """(view, last refresh, age, whether it is older than ``most``), times in one unit."""
    last = refreshes.groupBy(by).agg(F.max(at).alias("last_refresh"))
    return last.withColumn("age", now - F.col("last_refresh")).withColumn("is_stale", F.col("age") > most)
