"""Keyed timers: the rules by hand, and a stream that stops and goes on."""

import json

import pytest
from pyspark.sql import functions as F

from loomery.streaming import state, timers


def run(rule, rows, upto=10**9):
    return timers.advance(rule, {}, [(t, {"id": k, **r}) for k, (t, r) in enumerate(rows)], upto)


def test_debounce_counts_from_what_was_let_through():
    out, left = run(timers.throttled(10), [(t, {}) for t in (0, 6, 11, 13, 21, 100, 101)], 100)
    assert [t for _, t in out] == [0, 11, 21, 100] and [t for t, _ in left] == [101]


def test_open_fires_at_once_then_in_windows():
    # the default is nine milliseconds
    out, _ = run(timers.opened(9), [(t, {}) for t in (0, 1, 5, 9, 10, 40)])
    assert out == [(0, 1, 0), (9, 3, 3), (18, 1, 4), (40, 1, 5)]
    # the window isn't over yet
    assert run(timers.opened(9), [(0, {}), (1, {})], 8)[0] == [(0, 1, 0)]


def task(change="modified", priority=1):
    return {"kind": "task", "change": change, "priority": priority}


def test_queue_merges_waits_fails_and_revives():
    rule, fail = timers.queued(100), {"kind": "failed"}
    assert run(rule, [(0, task("new", 1)), (50, task("modified", 3)), (99, task(priority=2))])[0] == [("run", 100, "new", 3, 0)]
    assert run(rule, [(0, task("new")), (50, task("deleted"))])[0] == []
    # a second, then two; the third failure is the last
    out = run(rule, [(0, task()), (200, fail), (1300, fail), (4000, fail), (5000, fail), (6000, {"kind": "revive"}), (7000, fail)], 7900)[0]
    assert [x[:2] for x in out] == [("run", 100), ("run", 1200), ("run", 3300), ("dead", 4000), ("run", 6000)]
    assert [x[4] for x in out] == [0, 1, 2, 3, 0]
    # a new task for a waiting path is a fresh attempt, at the time that was set
    assert run(rule, [(0, task()), (200, fail), (300, task("deleted", 2))])[0] == [("run", 100, "modified", 1, 0), ("run", 1200, "deleted", 2, 0)]
    # nothing runs any more
    assert len(run(rule, [(0, task()), (200, {"kind": "done"}), (300, fail), (400, {"kind": "revive"})])[0]) == 1


@pytest.mark.parametrize("pair, want", [(("new", "deleted"), "none"), (("deleted", "new"), "modified"), (("new", "modified"), "new"), (("modified", "modified"), "modified"), (("modified", "deleted"), "deleted"), (("none", "new"), "new")])
def test_changes_merge(pair, want):
    assert timers.merged_change(*pair) == want


def test_a_stream_in_pieces_equals_the_rule(spark, tmp_path):
    """Rows out of order within what the watermark allows, three runs from one checkpoint, null columns."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rule = timers.queued(3_000, backoff_ms=1_000)
    rows = [(p, 1_000 * t + 7 * p, t, ("task", "failed", "task", "revive", "done")[(t * p) % 5], None if (t * p) % 5 in (1, 3, 4) else ("new", "modified", "deleted")[t % 3], t % 4) for t in range(60) for p in (1, 2, 3)]
    schema = "path long, ms long, id long, kind string, change string, priority int"
    timers.state_store(spark)
    try:
        for lo, hi in ((0, 25), (25, 40), (40, 60)):
            part = [r for r in rows if lo <= r[2] < hi]
            spark.createDataFrame(part[::-1], schema).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("ms"))
            out = timers.follow(stream, rule, "path", "ts", "20 seconds")
            state.run_available(out, "parquet", str(tmp_path / "out"), str(tmp_path / "check"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(map(tuple, spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()))
    upto, want = max(r[1] for r in rows) - 20_000, []
    for p in (1, 2, 3):
        mine = [(r[1], json.loads(json.dumps(dict(zip(("id", "kind", "change", "priority"), r[2:]))))) for r in rows if r[0] == p]
        want += [(p, *x) for x in timers.advance(rule, {}, mine, upto)[0]]
    assert got == sorted(want) and len(want) > 20
