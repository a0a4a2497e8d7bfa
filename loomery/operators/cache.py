"""A layered cache as keyed rows: lookups by layer, invalidation, warming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Layers in the order in which they are asked.
LAYERS = ("query", "embedding", "context", "parse")


def put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """``entries`` (layer, key, value, stored_at) with ``new`` ones over those of the same layer and key."""
    both = entries.unionByName(new)
    latest = both.groupBy("layer", "key").agg(F.max_by(F.struct("value", "stored_at"), "stored_at").alias("e"))
    return latest.select("layer", "key", "e.value", "e.stored_at")


def live(entries: DataFrame, now: float, ttl: dict[str, float], capacity: dict[str, int]) -> DataFrame:
    """Entries that have not expired, the latest ``capacity`` of each layer.  The four layers are one task each; what they keep is bounded."""
    age = F.create_map(*(x for k, v in ttl.items() for x in (F.lit(k), F.lit(float(v)))))
    room = F.create_map(*(x for k, v in capacity.items() for x in (F.lit(k), F.lit(v))))
    young = entries.filter(F.col("stored_at") + F.element_at(age, F.col("layer")) > now)
    w = Window.partitionBy("layer").orderBy(F.desc("stored_at"), F.asc("key"))
    most = max(capacity.values())
    # cut to the largest capacity first, which every task does for itself
    ranked = young.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)
    return ranked.filter(F.col("_rn") <= F.element_at(room, F.col("layer"))).drop("_rn")


def lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """(request, layer, key, hit, value): every request's answer of its layer, or a miss."""
    return requests.join(entries.select("layer", "key", "value"), ["layer", "key"], "left").select("request", "layer", "key", F.col("value").isNotNull().alias("hit"), "value")


def rates(found: DataFrame) -> DataFrame:
    """(layer, requests, hits, rate, healthy): at least 60 % of the requests of a layer should hit."""
    n, hits = F.count("*"), F.count_if("hit")
    return found.groupBy("layer").agg(n.alias("requests"), hits.alias("hits"), (hits / n).alias("rate"), (hits / n >= 0.6).alias("healthy"))


def invalidate(entries: DataFrame, keys: DataFrame, layers: Sequence[str] = LAYERS) -> DataFrame:
    """Without the entries of ``layers`` whose key is in ``keys`` (key)."""
    gone = F.col("layer").isin(*layers)
    return entries.filter(~gone).unionByName(entries.filter(gone).join(keys.select("key").distinct(), "key", "left_anti").select(*entries.columns))


def to_warm(log: DataFrame, entries: DataFrame, layer: str, k: int) -> DataFrame:
    """(key, n): the ``k`` keys asked most often that the layer doesn't hold, ties by key."""
    missing = log.groupBy("key").agg(F.count("*").alias("n")).join(entries.filter(F.col("layer") == layer).select("key"), "key", "left_anti")
    return missing.orderBy(F.desc("n"), F.asc("key")).limit(k)
