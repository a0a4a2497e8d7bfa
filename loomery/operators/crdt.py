"""Property graph of cells (soul, key, vtype, v_text, v_num, v_bool, v_link, state): merge, ranges, links, documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x1b"
MAX_DRIFT_MS = 600_000.0


def number_text(x: Column) -> Column:
    """A finite double in plain decimal form, whole numbers without a point."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.format_string("%d", x.cast("long"))).otherwise(x.cast("string"))


def canonical() -> Column:
    """The cell's value as text that orders values of one length."""
    t = F.col("vtype")
    return (
        F.when(t == "text", F.concat(F.lit('"'), "v_text", F.lit('"')))
        .when(t == "num", number_text(F.col("v_num")))
        .when(t == "bool", F.col("v_bool").cast("string"))
        .when(t == "link", F.concat(F.lit('{"#":"'), "v_link", F.lit('"}')))
        .otherwise("null")
    )


def json_length() -> Column:
    """UTF-8 bytes of the value's text, quotes included, nothing escaped."""
    return F.octet_length(canonical())


def valid_state(state: Column) -> Column:
    return state.isNotNull() & ~F.isnan(state) & (state < float("inf"))


def ham(ops: DataFrame, machine_state: float | None = None, drift_ms: float = MAX_DRIFT_MS) -> DataFrame:
    """The cell each (soul, key) converges to, whatever the order of ``ops``.

    The greatest state wins; of equal states the longer value, of equal lengths the greater text.  States that are no
    number or endless are refused; states further ahead of ``machine_state`` than ``drift_ms`` wait.
    """
    rows = ops.filter(valid_state(F.col("state")))
    if machine_state is not None:
        rows = rows.filter(F.col("state") <= machine_state + drift_ms)
    value = F.struct(*(F.col(c) for c in ("vtype", "v_text", "v_num", "v_bool", "v_link", "state")))
    order = F.struct("state", json_length(), canonical())
    return rows.groupBy("soul", "key").agg(F.max_by(value, order).alias("_v")).select("soul", "key", "_v.*")


def deferred(ops: DataFrame, machine_state: float, drift_ms: float = MAX_DRIFT_MS) -> DataFrame:
    return ops.filter(valid_state(F.col("state")) & (F.col("state") > machine_state + drift_ms))


def ham_outcome(state: Column, length: Column, text: Column, cur_state: Column, cur_length: Column, cur_text: Column, machine_state: float) -> Column:
    """What one incoming cell does to the current one: future, old, same or accept."""
    missing = cur_state.isNull()
    return (
        F.when(state > machine_state, "future")
        .when(missing | (state > cur_state), "accept")
        .when(state < cur_state, "old")
        .when((text == cur_text) | (length < cur_length) | ((length == cur_length) & (text <= cur_text)), "same")
        .otherwise("accept")
    )


def lex(key: Column, exact: str | None = None, prefix: str | None = None, gte: str | None = None, lte: str | None = None) -> Column:
    """Lexical match: exact, prefix, then range; a key that starts with ``gte`` passes even above ``lte``."""
    first = next((x for x in (exact, prefix, gte, lte) if x is not None), None)
    hit = key == first if first is not None else F.lit(False)
    if exact is not None:
        return hit
    start = prefix if prefix is not None else gte
    if start is not None:
        hit = hit | key.startswith(start)
    if prefix is not None:
        return hit
    if gte is not None and lte is not None:
        return hit | ((key >= gte) & (key <= lte))
    if gte is not None:
        return hit | (key >= gte)
    return hit | (key <= lte) if lte is not None else F.lit(False)


def lex_page(cells: DataFrame, match: Column, limit: int, reverse: bool = False) -> DataFrame:
    """The first keys of each soul that match."""
    w = Window.partitionBy("soul").orderBy(F.desc("key") if reverse else F.asc("key"))
    return cells.filter(match).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def storage_key(soul: Column, key: Column) -> Column:
    return F.concat(soul, F.lit(SEPARATOR), key)


def prefix_range(key: Column, prefix: str) -> Column:
    """Keys with this prefix as a range, so that minimum and maximum of stored blocks prune."""
    return (key >= prefix) & (key < prefix + "\U0010ffff")


def follow(cells: DataFrame, start: DataFrame, path: Sequence[str]) -> DataFrame:
    """(soul, and the cell at the end of ``path``): every step but the last goes through a link."""
    now = start.select(F.col("soul").alias("root"), F.col("soul").alias("at"))
    steps = [p for p in path if p]
    for i, k in enumerate(steps):
        c = cells.filter(F.col("key") == k).select(F.col("soul").alias("_s"), "vtype", "v_text", "v_num", "v_bool", "v_link")
        now = now.join(c, F.col("at") == F.col("_s")).drop("_s", "at")
        if i + 1 < len(steps):
            now = now.filter("vtype = 'link'").select("root", F.col("v_link").alias("at"))
    return now


def absent(souls: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Souls whose ``key`` is missing or a tombstone."""
    there = cells.filter((F.col("key") == key) & (F.col("vtype") != "null")).select("soul")
    return souls.join(there, "soul", "left_anti")


def nodes(cells: DataFrame) -> DataFrame:
    """(soul, data): each node's live cells as a map of texts."""
    live = cells.filter("vtype <> 'null'")
    return live.groupBy("soul").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", canonical().alias("value"))))).alias("data"))


def documents(cells: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(soul, document): linked nodes as nested JSON up to ``depth``; what lies deeper or closes a circle stays ``{"#":soul}``.

    Nodes open from the roots down, each with the souls and keys on its way; documents then close from the deepest up.
    """
    plain = cells.filter("vtype <> 'null'").select("soul", "key", "v_link", canonical().alias("value"))
    there = plain.select(F.col("soul").alias("_t")).distinct()
    edges = plain.filter("v_link IS NOT NULL").join(there, F.col("v_link") == F.col("_t")).select(F.col("soul").alias("_s"), F.col("key").alias("_k"), F.col("v_link").alias("_to"))
    levels = [roots.select("soul").distinct().join(there, F.col("soul") == F.col("_t")).select(F.array("soul").alias("way"), F.array("soul").alias("souls"), "soul")]
    for _ in range(depth - 1):
        step = levels[-1].join(edges, F.col("soul") == F.col("_s")).filter(~F.array_contains("souls", F.col("_to")))
        levels.append(step.select(F.concat("way", F.array("_k", "_to")).alias("way"), F.concat("souls", F.array("_to")).alias("souls"), F.col("_to").alias("soul")))
    below = None
    for level in reversed(levels):
        rows = level.select("way", "soul").join(plain, "soul")
        if below is not None:
            rows = rows.withColumn("_w", F.concat("way", F.array("key", "v_link"))).join(below, F.col("_w") == F.col("_way"), "left")
            rows = rows.withColumn("value", F.coalesce("_doc", "value"))
        parts = F.array_sort(F.collect_list(F.concat(F.lit('"'), "key", F.lit('":'), "value")))
        below = rows.groupBy(F.col("way").alias("_way")).agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("_doc"))
    return below.select(F.element_at("_way", 1).alias("soul"), F.col("_doc").alias("document"))


def dedup_messages(ops: DataFrame, ttl_ms: float = 9000.0) -> DataFrame:
    """First sighting of each message, and later ones after a silence of ``ttl_ms``; a sighting renews the memory."""
    w = Window.partitionBy("msg_id").orderBy("state", "soul", "key")
    gap = F.col("state") - F.lag("state").over(w)
    return ops.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") >= ttl_ms)).drop("_gap")


def evict(access: DataFrame, capacity: int, pinned: DataFrame) -> DataFrame:
    """Souls to drop: if there are more than ``capacity``, a tenth of them, least recently used first, never pinned ones."""
    n = access.agg(F.count("*").alias("n"))
    # a bounded sort: the limit follows from the capacity
    oldest = access.join(pinned, "soul", "left_anti").orderBy("last", "soul").limit(-(-capacity // 10))
    return oldest.join(F.broadcast(n)).filter(F.col("n") > capacity).select("soul")


def route(ops: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(msg_id, peer): every peer that subscribed to the soul, but the one it came from and those that saw it."""
    met = ops.join(subscriptions, "soul").filter((F.col("peer") != F.col("origin")) & ~F.array_contains("seen_by", F.col("peer")))
    return met.select("msg_id", "peer").distinct()


def may(certificate_who: Column, who: Column, certificate_what: Column, what: Column, expires: Column, now: float) -> Column:
    """Access by certificate: not expired, for this holder or all, for this exact name, prefix* or all."""
    fits = (certificate_what == "*") | (certificate_what == what) | (certificate_what.endswith("*") & what.startswith(F.rtrim(certificate_what, F.lit("*"))))
    return (expires.isNull() | (expires > now)) & ((certificate_who == "*") | (certificate_who == who)) & fits


def clock(ts_ms: Column, order: Sequence[Column]) -> Column:
    """A strictly rising clock: milliseconds, and a fraction for rows of one millisecond."""
    return ts_ms + (F.row_number().over(Window.partitionBy(ts_ms).orderBy(*order)) - 1) / 999.0


def disconnect_writes(writes: DataFrame, gone: DataFrame, now: float, most: int = 100, most_bytes: int = 1 << 20) -> DataFrame:
    """Cells that peers left to be written when they go: of each peer in ``gone`` (peer) its first ``most`` writes, as long as they have ``most_bytes`` together, with state ``now``.

    writes: peer, seq and the columns of a cell.  Souls of user namespaces (~) are never written this way.
    """
    w = Window.partitionBy("peer").orderBy("seq")
    size = F.octet_length("soul") + F.octet_length("key") + json_length()
    # the limit on rows is one of the task's own before rows are shuffled
    kept = writes.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)
    kept = kept.withColumn("_sum", F.sum(size).over(w)).filter(F.col("_sum") <= most_bytes)
    own = kept.filter(~F.col("soul").startswith("~")).join(gone.select("peer").distinct(), "peer", "left_semi")
    return own.select("peer", "seq", "soul", "key", "vtype", "v_text", "v_num", "v_bool", "v_link", F.lit(now).alias("state"))
