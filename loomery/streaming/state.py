"""Structured Streaming forms: graph merge, message dedup, tumbling buckets, change sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators import crdt

_CELL = "soul string, key string, vtype string, v_text string, v_num double, v_bool boolean, v_link string, state double"


def ham_stream(ops: DataFrame) -> DataFrame:
    """Cells that change, from a stream of ops: the state per (soul, key) is the winner so far, by the rule of the batch merge.

    Lengths and texts that break ties are computed by the same expressions as in the batch form, before the state.
    """
    rows = ops.filter(crdt.valid_state(F.col("state"))).withColumn("length", crdt.json_length()).withColumn("canon", crdt.canonical())
    names = [c.split()[0] for c in _CELL.split(", ")]

    def merge(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        before = best
        for b in batches:
            for r in b[["state", "length", "canon", *names]].itertuples(index=False, name=None):
                own = (float(r[0]), int(r[1]), str(r[2]))
                if best is None or own > tuple(best[:3]):
                    cell = r[3:]
                    best = (*own, *(None if x is None or x != x else x for x in cell))
        if best is not None and best != before:
            state.update(best)
            yield pd.DataFrame([best[3:]], columns=names)

    return rows.groupBy("soul", "key").applyInPandasWithState(merge, _CELL, f"s_state double, s_length int, s_canon string, {_CELL}", "append", "NoTimeout")


def dedup_stream(ops: DataFrame, ts: str, ttl: str = "9 seconds") -> DataFrame:
    """Each message once; memory of it ends with the watermark and isn't renewed by later sightings."""
    return ops.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["msg_id"])


def bucket_stream(events: DataFrame, ts: str, width: str, late: str, *aggs) -> DataFrame:
    """Tumbling buckets, closed once the watermark passes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(*aggs)


def merge_sink(apply: Callable[[DataFrame, int], None]):
    """For foreachBatch: each micro-batch goes to ``apply`` with its number; a batch that comes again has the same number."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            apply(batch, number)

    return write


def run_available(stream: DataFrame, sink: str, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and end."""
    q = stream.writeStream.format(sink).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand what there is to ``apply``, batch by batch, and end."""
    q = stream.writeStream.foreachBatch(merge_sink(apply)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
