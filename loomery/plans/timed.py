"""Queries: streams with keyed timers, each against the same rule as recursive SQL over the whole table.

A twin takes rows and alarms up to the watermark, the time of the newest row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.sources.durable import shared_folder
from loomery.sources.tables import read
from loomery.streaming import state, timers

from .catalog import query

HOUR = 3_600_000
#: Spark's time of an event in ms, whatever the session's time zone.
_MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
#: Numbered rows of each user, and the watermark.
_ROWS = """e AS (SELECT user_id, event_id AS id, event_type, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t,
    row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch_us(ts) / 1000) AS BIGINT), event_id) AS n FROM events), m AS (SELECT max(t) AS w FROM e)"""


def followed(spark, d, rule: timers.Rule, *columns):
    """What ``rule`` emits for each user over events that come in two halves: the stream stops between them and goes on from its checkpoint."""
    where = shared_folder(spark)
    rows = read(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.expr(_MS).alias("ms"), *columns)
    # two numbers
    first, last = rows.agg(F.min("ms"), F.max("ms")).head()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.state_store(spark)
    try:
        for early in (True, False):
            rows.filter((F.col("ms") < ((first or 0) + (last or 0)) / 2) == early).write.mode("append").parquet(f"{where}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{where}/in").withColumn("ts", F.timestamp_millis("ms"))
            out = timers.follow(stream, rule, "user_id", "ts")
            state.run_available(out, "parquet", f"{where}/out", f"{where}/check")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(out.schema).parquet(f"{where}/out")


@query("A189_debounce", f"""WITH RECURSIVE {_ROWS}, r AS (SELECT user_id, n, id, t FROM e WHERE n = 1
    UNION ALL SELECT r.user_id, min(x.n), arg_min(x.id, x.n), arg_min(x.t, x.n) FROM r JOIN e x ON x.user_id = r.user_id AND x.n > r.n AND x.t - r.t >= {6 * HOUR} GROUP BY r.user_id)
    SELECT user_id, id, t AS fired_ms FROM r""")
def _(spark, d):
    # at least six hours after the last event that was let through
    return followed(spark, d, timers.throttled(6 * HOUR))


@query("B76_coalesced_open", f"""WITH RECURSIVE {_ROWS}, r AS (SELECT user_id, n AS upto, t AS fired_ms, CAST(1 AS BIGINT) AS changes FROM e WHERE n = 1
    UNION ALL SELECT user_id, upto, fired_ms, upto - had FROM (SELECT r.user_id, r.upto AS had,
            CASE WHEN min(x.t) - r.fired_ms >= {8 * HOUR} THEN min(x.n) ELSE coalesce(min(x.n) FILTER (x.t = r.fired_ms + {8 * HOUR}), max(x.n) FILTER (x.t < r.fired_ms + {8 * HOUR})) END AS upto,
            greatest(min(x.t), r.fired_ms + {8 * HOUR}) AS fired_ms FROM r JOIN e x ON x.user_id = r.user_id AND x.n > r.upto GROUP BY r.user_id, r.upto, r.fired_ms) s, m WHERE s.fired_ms <= m.w)
    SELECT r.user_id, fired_ms, changes, e.id AS newest FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.upto""")
def _(spark, d):
    # hours stand for the milliseconds of the default
    return followed(spark, d, timers.opened(8 * HOUR))


_CHANGE = "CASE WHEN w_change = 'none' THEN {0} WHEN w_change = 'new' AND {0} = 'deleted' THEN 'none' WHEN w_change = 'deleted' AND {0} = 'new' THEN 'modified' WHEN w_change = 'new' AND {0} = 'modified' THEN 'new' WHEN w_change = 'deleted' AND {0} = 'modified' THEN 'deleted' ELSE {0} END"


def _queue_sql(settle: int, backoff: int) -> str:
    """One row or alarm a step: what waits (w), runs (r) and is dead (d), the number of rows taken, and what the step says."""
    # what a step puts among the waiting: a task, one that failed, one that is revived
    put = "CASE op WHEN 'task' THEN change WHEN 'again' THEN r_change WHEN 'revive' THEN d_change END"
    prio = "CASE op WHEN 'task' THEN priority WHEN 'again' THEN r_priority WHEN 'revive' THEN d_priority END"
    return f"""WITH RECURSIVE {_ROWS}, k AS (SELECT user_id, n, t, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'revive' ELSE 'task' END AS kind,
        ['new', 'modified', 'deleted', 'modified'][id % 4 + 1] AS change, CAST(id % 3 + 1 AS INTEGER) AS priority FROM e),
    s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS w_change, CAST(NULL AS INTEGER) AS w_priority, CAST(NULL AS INTEGER) AS w_failures, CAST(NULL AS BIGINT) AS alarm,
        CAST(NULL AS VARCHAR) AS r_change, CAST(NULL AS INTEGER) AS r_priority, CAST(NULL AS INTEGER) AS r_failures, CAST(NULL AS VARCHAR) AS d_change, CAST(NULL AS INTEGER) AS d_priority,
        CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS at_ms, CAST(NULL AS VARCHAR) AS change, CAST(NULL AS INTEGER) AS priority, CAST(NULL AS INTEGER) AS failures FROM e
    UNION ALL SELECT user_id, n + CASE WHEN op = 'alarm' THEN 0 ELSE 1 END,
        CASE WHEN op = 'alarm' THEN NULL WHEN put IS NULL THEN w_change WHEN w_change IS NULL THEN put ELSE {_CHANGE.format("put")} END,
        CASE WHEN op = 'alarm' THEN NULL WHEN put IS NULL THEN w_priority WHEN w_change IS NULL THEN prio ELSE greatest(w_priority, prio) END,
        CASE WHEN op = 'alarm' THEN NULL WHEN put IS NULL THEN w_failures WHEN w_change IS NULL AND op = 'again' THEN r_failures + 1 ELSE 0 END,
        CASE WHEN op = 'alarm' THEN NULL WHEN put IS NULL OR w_change IS NOT NULL THEN alarm WHEN op = 'again' THEN now + CAST({backoff} * pow(2, r_failures) AS BIGINT) WHEN op = 'task' THEN now + {settle} ELSE now END,
        CASE WHEN op IN ('done', 'again', 'dead') THEN NULL WHEN op = 'alarm' AND w_change <> 'none' THEN w_change ELSE r_change END,
        CASE WHEN op IN ('done', 'again', 'dead') THEN NULL WHEN op = 'alarm' AND w_change <> 'none' THEN w_priority ELSE r_priority END,
        CASE WHEN op IN ('done', 'again', 'dead') THEN NULL WHEN op = 'alarm' AND w_change <> 'none' THEN w_failures ELSE r_failures END,
        CASE WHEN op = 'dead' THEN r_change WHEN op = 'revive' THEN NULL ELSE d_change END, CASE WHEN op = 'dead' THEN r_priority WHEN op = 'revive' THEN NULL ELSE d_priority END,
        CASE WHEN op = 'dead' THEN 'dead' WHEN op = 'alarm' AND w_change <> 'none' THEN 'run' END, now,
        CASE WHEN op = 'dead' THEN r_change ELSE w_change END, CASE WHEN op = 'dead' THEN r_priority ELSE w_priority END, CASE WHEN op = 'dead' THEN r_failures + 1 ELSE w_failures END
        FROM (SELECT *, {put} AS put, {prio} AS prio FROM (SELECT s.user_id, s.n, w_change, w_priority, w_failures, alarm, r_change, r_priority, r_failures, d_change, d_priority, k.change, k.priority,
                CASE WHEN alarm IS NOT NULL AND (k.t IS NULL OR alarm < k.t) THEN alarm ELSE k.t END AS now,
                CASE WHEN alarm IS NOT NULL AND (k.t IS NULL OR alarm < k.t) THEN 'alarm' WHEN kind = 'failed' AND r_change IS NULL THEN 'skip' WHEN kind = 'failed' AND r_failures + 1 >= 3 THEN 'dead'
                    WHEN kind = 'failed' THEN 'again' WHEN kind = 'revive' AND d_change IS NULL THEN 'skip' ELSE kind END AS op
            FROM s LEFT JOIN k ON k.user_id = s.user_id AND k.n = s.n + 1) a) b, m WHERE now <= m.w)
    SELECT user_id, outcome, at_ms, change, priority, failures FROM s WHERE outcome IS NOT NULL"""


@query("A188_task_queue", _queue_sql(2 * HOUR, HOUR))
def _(spark, d):
    # hours stand for the seconds of the default
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "revive").otherwise("task")
    change = F.element_at(F.array(*map(F.lit, ("new", "modified", "deleted", "modified"))), (F.col("event_id") % 4 + 1).cast("int"))
    return followed(spark, d, timers.queued(2 * HOUR, backoff_ms=HOUR), kind.alias("kind"), change.alias("change"), (F.col("event_id") % 3 + 1).cast("int").alias("priority"))
