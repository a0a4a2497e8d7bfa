"""Keyed timers over streams: debounced events, coalesced opens, a task queue with backoff and dead letters.

A rule is a fold over a key's rows and its own alarms in order of event time.  ``follow`` runs it on a stream: rows wait in the
key's state until the watermark has passed them, one timer a key wakes it, and rows and alarms up to the watermark are then
taken in order; what comes out doesn't depend on how the stream was cut into batches.  A key holds the rows of the time
between watermark and now, and the rule's memory.  Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A step takes the memory (changed in place), the time in ms and a row, or None at an alarm; it returns rows to emit and sets
#: ``memory["alarm"]`` to the time at which it wants to be called next, or to None.
Step = Callable[[dict, int, "dict | None"], list[tuple]]


@dataclass(frozen=True)
class Rule:
    """``columns`` of the rows it wants (besides the time), the schema of what it emits (after the key), and the step."""

    columns: str
    emits: str
    step: Step


# ---------------------------------------------------------------- rules


def throttled(wait_ms: int) -> Rule:
    """Events at least ``wait_ms`` after the last one that was let through."""

    def step(memory: dict, now: int, row: dict | None) -> list[tuple]:
        if "last" in memory and now - memory["last"] < wait_ms:
            return []
        memory["last"] = now
        return [(row["id"], now)]

    return Rule("id long", "id long, fired_ms long", step)


def opened(wait_ms: int) -> Rule:
    """A document's callbacks: the first change fires at once, changes within ``wait_ms`` of the last callback are batched and fire together when that time is over."""

    def fire(memory: dict, now: int) -> list[tuple]:
        out = [(now, memory["changes"], memory["newest"])]
        memory.update(last=now, changes=0, alarm=None)
        return out

    def step(memory: dict, now: int, row: dict | None) -> list[tuple]:
        if row is not None:
            memory["changes"], memory["newest"] = memory.get("changes", 0) + 1, row["id"]
            if "last" in memory and now - memory["last"] < wait_ms:
                memory["alarm"] = memory["last"] + wait_ms
                return []
        return fire(memory, now)

    return Rule("id long", "fired_ms long, changes long, newest long", step)


def merged_change(first: str, second: str) -> str:
    """What two changes of a path amount to."""
    if first == "none":
        return second
    if (first, second) == ("new", "deleted"):
        return "none"
    if (first, second) == ("deleted", "new"):
        return "modified"
    if first == "new" and second == "modified":
        return "new"
    if first == "deleted" and second == "modified":
        return "deleted"
    return second


def queued(settle_ms: int, retries: int = 3, backoff_ms: int = 1000) -> Rule:
    """One task a path: tasks within ``settle_ms`` of the first are merged (changes by their algebra, the highest priority), then run.

    A run that ``failed`` comes back after ``backoff_ms``, then twice that, and so on; the ``retries``-th failure puts the task
    among the dead.  A new task for a waiting path is a fresh attempt: failures so far are forgotten.  ``revive`` queues a dead
    task again, without failures.  Rows have ``kind`` (task, failed, done, revive), ``change`` and ``priority``.
    """

    def put(memory: dict, change: str, priority: int, failures: int, due: int) -> None:
        waiting = memory.get("waiting")
        if waiting is None:
            memory["waiting"] = {"change": change, "priority": priority, "failures": failures}
            memory["alarm"] = due
        else:
            waiting.update(change=merged_change(waiting["change"], change), priority=max(waiting["priority"], priority), failures=0)

    def step(memory: dict, now: int, row: dict | None) -> list[tuple]:
        if row is None:
            task = memory.pop("waiting")
            memory["alarm"] = None
            if task["change"] == "none":
                return []
            memory["running"] = task
            return [("run", now, task["change"], task["priority"], task["failures"])]
        if row["kind"] == "task":
            put(memory, row["change"], row["priority"], 0, now + settle_ms)
        elif row["kind"] == "done":
            memory.pop("running", None)
        elif row["kind"] == "failed" and "running" in memory:
            task = memory.pop("running")
            failures = task["failures"] + 1
            if failures >= retries:
                memory["dead"] = task
                return [("dead", now, task["change"], task["priority"], failures)]
            put(memory, task["change"], task["priority"], failures, now + backoff_ms * 2 ** (failures - 1))
        elif row["kind"] == "revive" and "dead" in memory:
            task = memory.pop("dead")
            put(memory, task["change"], task["priority"], 0, now)
        return []

    return Rule("id long, kind string, change string, priority int", "outcome string, at_ms long, change string, priority int, failures int", step)


# ---------------------------------------------------------------- streams


def advance(rule: Rule, memory: dict, rows: list[tuple[int, dict]], upto: int) -> tuple[list[tuple], list[tuple[int, dict]]]:
    """Take rows (time, row) and alarms up to ``upto`` in order of time, rows before alarms of one time; what is emitted, and the rows left."""
    out, rows = [], sorted(rows, key=lambda r: (r[0], r[1].get("id")))
    at = 0
    while True:
        alarm = memory.get("alarm")
        due = alarm if alarm is not None and alarm <= upto else None
        if at < len(rows) and rows[at][0] <= upto and (due is None or rows[at][0] <= due):
            out += rule.step(memory, *rows[at])
            at += 1
        elif due is not None:
            out += rule.step(memory, due, None)
        else:
            return out, rows[at:]


class _Timeline(StatefulProcessor):
    def __init__(self, rule: Rule, key: str, names: list[str], emitted: list[str]):
        self.rule, self.key, self.names, self.emitted = rule, key, names, emitted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_ms long, row string")
        self.memory = handle.getValueState("memory", "memory string")

    def _wake(self, times: list[int]) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(min(times))

    def _memory(self) -> dict:
        return json.loads(self.memory.get()[0]) if self.memory.exists() else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r[0]), json.dumps(dict(zip(self.names, (None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in r[1:]))))) for b in rows for r in b[["at_ms", *self.names]].itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList(new)
            alarm = self._memory().get("alarm")
            self._wake([t for t, _ in new] + [t for t in self.handle.listTimers()] + ([] if alarm is None else [alarm]))
        yield pd.DataFrame(columns=[self.key, *self.emitted])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, memory = timerValues.getCurrentWatermarkInMs(), self._memory()
        rows = [(t, json.loads(r)) for t, r in self.waiting.get()] if self.waiting.exists() else []
        out, left = advance(self.rule, memory, rows, upto)
        self.memory.update((json.dumps(memory),))
        if left:
            self.waiting.put([(t, json.dumps(r)) for t, r in left])
        else:
            self.waiting.clear()
        self._wake([t for t, _ in left] + ([] if memory.get("alarm") is None else [memory["alarm"]]))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, *self.emitted])

    def close(self) -> None:
        pass


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def follow(stream: DataFrame, rule: Rule, key: str, ts: str, late: str = "0 seconds") -> DataFrame:
    """What ``rule`` emits for each ``key`` of a stream, in order of ``ts`` (cut to ms), up to the watermark ``late`` behind the newest row."""
    names = _names(rule.columns)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(ts, late).select(key, ts, F.unix_millis(ts).alias("at_ms"), *names)
    return rows.groupBy(key).transformWithStateInPandas(_Timeline(rule, key, names, _names(rule.emits)), f"{key} {kind}, {rule.emits}", "append", "EventTime")


def state_store(spark: SparkSession) -> None:
    """Timers need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
