"""Sinks: JSON, CSV, agent lines and range-partitioned key-value files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def agent_lines(hits: DataFrame) -> DataFrame:
    """relpath:start-end kind symbol (score)."""
    where = F.concat("relpath", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return hits.select(F.concat_ws(" ", where, "kind", "symbol_name", F.format_string("(%.3f)", F.col("score"))).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_sorted(cells: DataFrame, path: str, key: str = "k", partitions: int | None = None) -> None:
    """Ordered key-value files: ranges of keys, sorted within, so that stored minima and maxima prune a range read."""
    dealt = cells.repartitionByRange(partitions, key) if partitions else cells.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.parquet(path)
