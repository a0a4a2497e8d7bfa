"""Sharding by a hierarchical weighted hash tree (operator 2), built-in functions only.

A row descends region, rack and shard.  At every level each child draws ``-ln(u) / weight`` with ``u`` hashed from the
key and the child's name; the least draw wins, so a child gets rows in proportion to its weight.  A child's draw depends
on nothing but key, name and weight: changing a weight moves rows only into or out of the subtree that carries it.  A new
shard is hung as a branch of its own, hence one more shard takes rows only into itself.

Defined cases: a null key is one key like any other; equal keys share a shard; a null text has size 1 and the checksum
of the empty text; repeated rows get slots of their own; an empty table gives no rows; further columns are ignored;
a text is measured whole, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, gapless


@dataclass(frozen=True)
class Node:
    """``name`` is unique among all nodes.  A leaf has a shard number; another node weighs what its leaves weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(n_shards: int, racks: int = 2, regions: int = 4, base: int = 16) -> Node:
    """``n_shards`` of equal weight: the first ``base`` spread over regions and racks, each further one on a branch of its own."""

    def leaf(s: int) -> Node:
        return Node(f"shard{s}", shard=s)

    def branch(r: int, groups: list[list[int]]) -> Node:
        return Node(f"region{r}", tuple(Node(f"region{r}/rack{k}", tuple(map(leaf, g))) for k, g in enumerate(groups) if g))

    first = min(n_shards, base)
    of_region = [[s for s in range(first) if s * regions // base == r] for r in range(regions)]
    halves = [branch(r, [[s for i, s in enumerate(own) if i * racks // max(1, base // regions) == k] for k in range(racks)]) for r, own in enumerate(of_region) if own]
    return Node("root", (*halves, *(branch(regions + s - base, [[s]]) for s in range(base, n_shards))))


def _draw(key: Column, node: Node) -> Column:
    # 53 hashed bits, never 0
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double")
    return -F.log((bits + 0.5) / float(1 << 53)) / node.weight


def descend(key: Column, node: Node) -> Column:
    """Shard number of ``key`` under ``node``."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [_draw(key, c) for c in node.children]
    least = F.least(*draws)
    found = None
    for c, d in zip(node.children[:-1], draws):
        found = (F.when if found is None else found.when)(d == least, descend(key, c))
    return found.otherwise(descend(key, node.children[-1]))


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard, its slot there, and its shard if there were one more."""
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        id_col,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        descend(key, tree(n_shards)).cast("int").alias("shard"),
        descend(key, tree(n_shards + 1)).cast("int").alias("grown_shard"),
        F.spark_partition_id().alias("_pid"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    narrow = cut(narrow, "shards")
    # numbers within one scan partition and shard: bounded by the size of a scan partition
    local = narrow.withColumn("_local", F.row_number().over(Window.partitionBy("shard", "_pid").orderBy("_mid")) - 1)
    out = gapless(local, "shard", "_local", "slot")
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
