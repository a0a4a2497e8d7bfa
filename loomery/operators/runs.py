"""Runs of an embedding job: batches in order up to a ceiling of cost, a ledger of runs, and going on after a stop.

A run takes the texts (by content address) that the store has no vector for, in order of their address, in batches of
``batch`` texts.  A batch runs if the tokens of all batches up to it stay within the ceiling, so a run stops before the
first that doesn't.  Its vectors are one part of the store and count once its line in the ledger is written; a run that
failed before has neither, and the next run does its work.

Places in the order come without one window over all rows: sorted files know each row's place in them, and the files' sums
before them are a window over as many rows as there are files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ingest

_LEDGER = "run long, provider string, dimension int, status string, total long, completed long, batches long, tokens long, cost double, token string"


def numbered(rows: DataFrame, path: str, order: str, weight: str) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order``) and ``upto`` (the weights of all rows up to it), written below ``path``."""
    spark, schema = rows.sparkSession, rows.schema
    rows.repartitionByRange(order).sortWithinPartitions(order).write.parquet(path)
    held = spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = held.groupBy("_file").agg(F.min(order).alias("_first"), F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("_file").alias("_f"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_sum"))
    own = F.sum(weight).over(Window.partitionBy("_file").orderBy("_at"))
    out = held.withColumn("_own", own).join(files, F.col("_file") == F.col("_f"))
    return out.withColumn("place", F.col("_rows") + F.col("_at")).withColumn("upto", F.col("_sum") + F.col("_own")).drop("_file", "_at", "_f", "_rows", "_sum", "_own")


@dataclass(frozen=True)
class EmbeddingRuns:
    """The store and ledger below ``path``; ``price`` is that of 1,000 tokens."""

    spark: SparkSession
    path: str
    dim: int
    provider: str = "hash"
    batch: int = 100
    price: float = 0.00013

    def ledger(self) -> DataFrame:
        """One row a run: status is completed, or stopped where the ceiling left batches over."""
        return self._read("ledger", _LEDGER)

    def vectors(self) -> DataFrame:
        """(blob, embedding) of the runs that are in the ledger."""
        rows = self._read("vectors", "blob string, embedding array<float>, token string")
        return rows.join(self.ledger().select("token"), "token", "left_semi").select("blob", "embedding")

    def pending(self, texts: DataFrame) -> DataFrame:
        """(blob, text, tokens) of the distinct texts without a vector; four bytes are a token, as an estimate."""
        text = F.coalesce("text", F.lit(""))
        rows = texts.select(F.sha2(text, 256).alias("blob"), text.alias("text"), F.ceil(F.octet_length(text) / 4).cast("long").alias("tokens"))
        return rows.dropDuplicates(["blob"]).join(self.vectors().select("blob"), "blob", "left_anti")

    def run(self, texts: DataFrame, provide: Callable[[list[str]], list[list[float]]], ceiling: float | None = None) -> DataFrame:
        """Embed what is pending, within ``ceiling`` of cost, and return the run's line of the ledger; without anything pending there is no run."""
        last = self.ledger().agg(F.max("run")).head()[0]
        number, token = 0 if last is None else last + 1, uuid.uuid4().hex
        rows = numbered(self.pending(texts), f"{self.path}/pending-{token}", "blob", "tokens").withColumn("batch", F.floor(F.col("place") / self.batch))
        ends = rows.groupBy("batch").agg(F.max("upto").alias("_upto"), F.count("*").alias("_n"))
        within = F.lit(True) if ceiling is None else F.col("_upto") * self.price / 1000 <= ceiling
        # five numbers
        total, done, n, tokens, left = ends.agg(F.sum("_n"), F.max(F.when(within, F.col("batch"))), F.sum(F.when(within, F.col("_n"))), F.max(F.when(within, F.col("_upto"))), F.count_if(~within)).head()
        if total is None:
            return self.ledger().filter("false")
        if done is not None:
            chosen = rows.filter(F.col("batch") <= done)
            ingest.embed(chosen, provide, self.dim, key="blob", batch=self.batch).withColumn("token", F.lit(token)).write.mode("append").parquet(f"{self.path}/vectors")
        line = (number, self.provider, self.dim, "stopped" if left else "completed", total, n or 0, 0 if done is None else done + 1, tokens or 0, (tokens or 0) * self.price / 1000, token)
        self.spark.createDataFrame([line], _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return self.ledger().filter(F.col("run") == number)

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
