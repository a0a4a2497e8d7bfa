"""Connected components of an edge list by alternating large and small stars; nothing is collected.

Defined cases: an edge from a node to itself is no edge, so a node that has no other is in no row; repeated edges count
once; null ends are left out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

ROWS_A_FILE = 200_000


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; ``edges``: (a, b) longs.  A component is named by its least node.

    Every round replaces edges by edges to the least neighbour, first among larger nodes, then among smaller ones, until
    each component is a star around its least node; O(log^2 n) rounds.  Minima are combined before the shuffle, and a
    node with many neighbours is split by the skew handling of joins.
    """
    whole = edges.filter(F.col("a") != F.col("b"))
    now = cut(whole.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _print(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("m", "n").alias("m"))
        # every node hands its larger neighbours on to the least of all
        large = both.join(least, F.col("u") == F.col("n")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # few rows need few files and tasks
        parts = 1 + seen[0] // ROWS_A_FILE
        large = cut(large.coalesce(parts), "large")
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        before, now = now, cut(small.select("e.u", "e.v").filter("u <> v").distinct().coalesce(parts), "small")
        release(before, large)
        after = _print(now)
        if after == seen:
            break
        seen = after
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = named.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._cut_path = now._cut_path  # what `release` deletes
    return out
