"""Bounded traversal of typed edges (src, dst, type)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.sources.durable import cut

HARD_DEPTH, DECAY = 10, 0.7


def paths(edges: DataFrame, seeds: DataFrame, types: Sequence[str], depth: int = 3, reverse: bool = False, id_col: str = "id") -> DataFrame:
    """(seed, id, depth, path) of all walks from each seed that repeat no node after their first step, one row per walk.

    One equi-join a step, on the walks of the step before as they were written; the seed itself may come back at depth two
    or later, as a walk is checked from its first neighbour on.  ``reverse``: against the edges.  Where walks aren't asked
    for, ``depths`` has each node once.
    """
    depth = min(depth, HARD_DEPTH)
    e = _steps(edges, types, reverse)
    now = seeds.select(F.col(id_col).alias("seed")).distinct().join(e, F.col("seed") == F.col("_from")).select("seed", F.col("_to").alias("id"), F.lit(1).alias("depth"), F.array("_to").alias("path"))
    out = now = cut(now) if depth > 1 else now
    for k in range(2, depth + 1):
        now = now.join(e, F.col("id") == F.col("_from")).filter(~F.array_contains("path", F.col("_to"))).select("seed", F.col("_to").alias("id"), F.lit(k).alias("depth"), F.concat("path", F.array("_to")).alias("path"))
        now = cut(now) if k < depth else now
        out = out.unionByName(now)
    return out


def _steps(edges: DataFrame, types: Sequence[str], reverse: bool) -> DataFrame:
    near, far = ("dst", "src") if reverse else ("src", "dst")
    return edges.filter(F.col("type").isin(*types)).select(F.col(near).alias("_from"), F.col(far).alias("_to")).distinct()


def depths(edges: DataFrame, seeds: DataFrame, types: Sequence[str], depth: int = 3, reverse: bool = False, id_col: str = "id") -> DataFrame:
    """(seed, id, depth): every node on a walk of at most ``depth`` steps, with its least depth; the seed itself if a walk comes back to it.

    A frontier of pairs not known before: a node is followed once for each seed, however many walks lead to it.
    """
    e = _steps(edges, types, reverse)
    first = seeds.select(F.col(id_col).alias("seed")).distinct().join(e, F.col("seed") == F.col("_from")).select("seed", F.col("_to").alias("id"), F.lit(1).alias("depth"))
    known = frontier = cut(first)
    for k in range(2, min(depth, HARD_DEPTH) + 1):
        step = frontier.join(e, F.col("id") == F.col("_from")).select("seed", F.col("_to").alias("id")).distinct()
        frontier = cut(step.join(known, ["seed", "id"], "left_anti").withColumn("depth", F.lit(k)))
        known = known.unionByName(frontier)
    return known


def paths_recursive(spark, edges: DataFrame, seed: int, type_: str, depth: int = 3) -> DataFrame:
    """The same for one seed and type as a recursive common table expression."""
    return spark.sql(
        """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {edges} WHERE type = {type_}),
        walk(id, depth, path) AS (
          SELECT dst, 1, array(dst) FROM e WHERE src = {seed}
          UNION ALL
          SELECT e.dst, walk.depth + 1, concat(walk.path, array(e.dst)) FROM walk JOIN e ON e.src = walk.id
          WHERE walk.depth < {depth} AND NOT array_contains(walk.path, e.dst))
        SELECT id, depth, path FROM walk""",
        edges=edges,
        type_=type_,
        seed=seed,
        depth=min(depth, HARD_DEPTH),
    )


def direct(edges: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, neighbour, type, direction) of depth one, all types."""
    own = ids.select(F.col(id_col).alias("id")).distinct()
    out = edges.join(own, F.col("src") == F.col("id")).select("id", F.col("dst").alias("neighbour"), "type", F.lit("out").alias("direction"))
    back = edges.join(own, F.col("dst") == F.col("id")).select("id", F.col("src").alias("neighbour"), "type", F.lit("in").alias("direction"))
    return out.unionByName(back)


def related(edges: DataFrame, seeds: DataFrame, types: Sequence[str], depth: int = 2) -> DataFrame:
    """(seed, id, relevance, direction): .7 to the power of the least depth, both ways.  Two equi-joins a step, no OR-join."""
    out = depths(edges, seeds, types, depth).withColumn("direction", F.lit("out"))
    back = depths(edges, seeds, types, depth, reverse=True).withColumn("direction", F.lit("in"))
    return out.unionByName(back).select("seed", "id", "direction", F.pow(F.lit(DECAY), F.col("depth")).alias("relevance"))


def expand_related(walks: DataFrame, kind_weight: Column, same_dir: Column, k: int = 5) -> DataFrame:
    """The k most relevant related rows of each seed: .7^depth times kind, times 1.2 in the same folder."""
    from pyspark.sql import Window

    rel = F.pow(F.lit(DECAY), F.col("depth")) * kind_weight * F.when(same_dir, 1.2).otherwise(1.0)
    w = Window.partitionBy("seed").orderBy(F.desc("relevance"), F.asc("id"))
    return walks.withColumn("relevance", rel).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def reachable(links: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, id) of all nodes reached, or of those at most ``depth`` links away, each once: a frontier that leaves out what is known keeps every step small."""
    e = cut(links.select(F.col("src").alias("_from"), F.col("dst").alias("_to")).distinct())
    frontier = cut(seeds.select(F.col("id").alias("seed"), F.col("id")).distinct())
    known = frontier
    for k in count() if depth is None else range(depth):
        step = frontier.join(e, F.col("id") == F.col("_from")).select("seed", F.col("_to").alias("id")).distinct()
        # files of every step, now and then gathered: the plan doesn't grow with the depth
        frontier = cut(step.join(known, ["seed", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if k % 16 == 15:
            known = cut(known)
    return known
