"""Upserts, cascades, change detection and change algebra over keyed frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = (), keep_old: Sequence[str] = ()) -> DataFrame:
    """``incoming`` over ``current``: the last incoming row per key wins; ``keep_old`` columns keep the old value where the new one is null."""
    rest = [c for c in current.columns if c not in keys]
    if order:
        w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
        incoming = incoming.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    new = incoming.select(*keys, F.struct(*rest).alias("_new"))
    old = current.select(*keys, F.struct(*rest).alias("_old"))
    both = old.join(new, list(keys), "full")

    def pick(c: str) -> Column:
        n, o = F.col("_new")[c], F.col("_old")[c]
        return F.when(F.col("_new").isNull(), o).otherwise(F.coalesce(n, o) if c in keep_old else n).alias(c)

    return both.select(*keys, *(pick(c) for c in rest)).select(*current.columns)


def insert_missing(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows whose key is new."""
    return current.unionByName(incoming.dropDuplicates(list(keys)).join(current.select(*keys), list(keys), "left_anti"))


def without(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A step of a cascade."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def cascade(files: DataFrame, chunks: DataFrame, junction: DataFrame, edges: DataFrame, gone_files: DataFrame) -> dict[str, DataFrame]:
    """What stays after files go: their chunks, the chunks' junction rows and edges go with them."""
    gone = chunks.join(gone_files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
    left_edges = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return {"files": without(files, gone_files, ["id"]), "chunks": without(chunks, gone, ["id"]), "junction": junction.join(gone.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti"), "edges": left_edges.select(*edges.columns)}


def clean_ignored(chunks: DataFrame, junction: DataFrame, edges: DataFrame, ignored: DataFrame) -> dict[str, DataFrame]:
    """What stays of chunks (by ``relpath``), junction rows and edges once the files of ``ignored`` (path) are out of the index."""
    gone = chunks.join(ignored.select(F.col("path").alias("relpath")), "relpath", "left_semi").select("id")
    left_edges = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return {"chunks": without(chunks, gone, ["id"]), "junction": junction.join(gone.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti"), "edges": left_edges.select(*edges.columns)}


def drop_worktree(chunks: DataFrame, junction: DataFrame, worktree: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, junction) without a worktree and without chunks that no other one holds."""
    left = junction.filter(F.col("worktree_id") != worktree)
    return chunks.join(left.select(F.col("chunk_id").alias("id")), "id", "left_semi"), left


def detect_changes(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(path, change, old_hash, new_hash): new, modified, deleted or none."""
    a = old.select(F.col(key).alias("_a"), F.col(digest).alias("old_hash"))
    b = new.select(F.col(key).alias("_b"), F.col(digest).alias("new_hash"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("none")
    return both.select(F.coalesce("_a", "_b").alias(key), change.alias("change"), "old_hash", "new_hash")


def detect_moves(changes: DataFrame, key: str = "path") -> DataFrame:
    """(from_path, to_path): a deleted and a new path of one content, first by name on both sides."""

    def numbered(df: DataFrame, digest: str, name: str) -> DataFrame:
        w = Window.partitionBy(digest).orderBy(key)
        return df.select(F.col(digest).alias("hash"), F.col(key).alias(name), F.row_number().over(w).alias("_rn"))

    gone = numbered(changes.filter("change = 'deleted'"), "old_hash", "from_path")
    come = numbered(changes.filter("change = 'new'"), "new_hash", "to_path")
    return gone.join(come, ["hash", "_rn"]).select("from_path", "to_path", "hash")


def merge_changes(events: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """One change per path from a sequence of them, null where they cancel out.

    new+deleted: none; deleted+new: modified; new+modified: new; modified+deleted: deleted; modified+new or modified:
    modified; deleted+anything else: deleted.  One fold over the path's own changes in order.
    """
    steps = F.transform(F.array_sort(F.collect_list(F.struct(order, "change"))), lambda x: x["change"])

    def fold(acc: Column, x: Column) -> Column:
        return (
            F.when(acc == "none", x)
            .when((acc == "new") & (x == "deleted"), "none")
            .when(acc == "new", "new")
            .when((acc == "modified") & (x == "deleted"), "deleted")
            .when(acc == "modified", "modified")
            .when((acc == "deleted") & (x == "new"), "modified")
            .otherwise("deleted")
        )

    return events.groupBy(key).agg(F.nullif(F.aggregate(steps, F.lit("none"), fold), F.lit("none")).alias("change"))


def coalesce_tasks(tasks: DataFrame, key: str = "path", max_retries: int = 3) -> DataFrame:
    """One task per path: highest priority, backoff of 1 s doubled by each retry; beyond ``max_retries`` it is dead."""
    one = tasks.groupBy(key).agg(F.max("priority").alias("priority"), F.max("retries").alias("retries"))
    backoff = F.when(F.col("retries") > 0, 1000 * F.pow(F.lit(2), F.col("retries") - 1)).otherwise(0).cast("long")
    return one.select(key, "priority", "retries", backoff.alias("backoff_ms"), (F.col("retries") > max_retries).alias("dead"))


def expire(entries: DataFrame, now: float, capacity: int) -> DataFrame:
    """Entries that stay in a cache: unexpired, the most recently used ``capacity`` of them."""
    live = entries.filter(F.col("expires_at") > now)
    return live.orderBy(F.desc("accessed_at"), F.asc("cache_key")).limit(capacity)


#: Larger files are not indexed.
MOST_BYTES = 10 * 1024 * 1024


def process_files(current: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index after, outcomes) of one batch of file events (path, change, hash, bytes) over ``current`` (path, hash).

    new and modified files take their new hash unless they are too large, in which case the index keeps what it has;
    one whose hash is already there is unchanged; deleted files go.  The last event of a path in a batch is given.
    """
    known = current.select(F.col("path").alias("_p"), F.col("hash").alias("_old"))
    met = events.join(known, F.col("path") == F.col("_p"), "left")
    outcome = (
        F.when(F.col("change") == "deleted", F.when(F.col("_p").isNull(), "unknown").otherwise("removed"))
        .when(F.col("bytes") > MOST_BYTES, "skipped")
        .when(F.col("_p").isNull(), "indexed")
        .when(F.col("_old") == F.col("hash"), "unchanged")
        .otherwise("updated")
    )
    done = met.select("path", "hash", outcome.alias("outcome"))
    moved = done.filter(F.col("outcome").isin("removed", "indexed", "updated"))
    after = without(current, moved, ["path"]).select("path", "hash").unionByName(moved.filter("outcome <> 'removed'").select("path", "hash"))
    return after, done.select("path", "outcome")


def poll_changes(polls: DataFrame) -> DataFrame:
    """(poll, path, change): what differs from one poll to the next.  polls: poll, path, hash; the first poll reports nothing."""
    numbers = polls.select("poll").distinct()
    before = polls.select((F.col("poll") + 1).alias("poll"), "path", F.col("hash").alias("_old")).join(numbers, "poll", "left_semi")
    now = polls.join(numbers.select((F.col("poll") + 1).alias("poll")), "poll", "left_semi").select("poll", "path", F.col("hash").alias("_new"))
    both = before.join(now, ["poll", "path"], "full")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return both.select("poll", "path", change.alias("change")).filter("change IS NOT NULL")
