"""Rank fusion, re-ranking, importance, de-duplication and confidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as T

# fixed values: multipliers by kind of symbol when results are ranked again, anything else 1.0
KIND_MULTIPLIERS = {"function": 1.2, "method": 1.2, "class": 1.1, "struct": 1.1, "interface": 1.1, "trait": 1.1, "enum": 1.0, "module": 1.0, "constant": 0.9, "variable": 0.8, "import": 0.7}
# fixed values: weights by kind when related chunks are added, anything else 1.0
RELATED_WEIGHTS = {"func": 2.5, "class": 2.0, "component": 2.3, "hook": 2.2, "method": 2.2, "module": 1.4, "var": 0.6, "variable": 0.6, "heading_1": 0.6, "heading_2": 0.5, "heading_3": 0.4}
# fixed values: weights of the sources
WEIGHTS = {"fts": 0.4, "vector": 0.35, "graph": 0.1, "signals": 0.15}
# fixed values: quality of an edge by type, anything else 1.0; times this if it comes from test code
EDGE_QUALITY, FROM_TEST = {"calls": 1.0}, 0.5


def by_value(table: Mapping[str, float], key: Column, default: float = 1.0) -> Column:
    """A small literal table as CASE."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def check_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """The weights scaled to a sum of one; negative ones or a sum of zero are refused."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()}


def override_graph(weights: Mapping[str, float], graph: float) -> dict[str, float]:
    """A given weight for the graph; the others share what is left in proportion."""
    rest = sum(w for k, w in weights.items() if k != "graph")
    return {k: graph if k == "graph" else w * (1 - graph) / rest for k, w in weights.items()}


def scaled_weights(requests: DataFrame, sources: Sequence[str], graph: float | None = None) -> DataFrame:
    """``requests`` with ``valid`` and the weights of ``sources`` scaled to a sum of one, the graph's set to ``graph`` if given; those of a refused request are null."""
    total = sum((F.col(c) for c in sources[1:]), F.col(sources[0]))
    least = F.least(*(F.col(c) for c in sources))
    rest = sum((F.col(c) for c in sources if c != "graph"), F.lit(0.0))
    valid = (least >= 0) & (total > 0) & (F.lit(graph is None) | (rest > 0))
    out = {}
    for c in sources:
        share = F.col(c) / total if graph is None else F.lit(graph) if c == "graph" else F.col(c) * (1 - graph) / rest
        out[c] = F.when(valid, share)
    return requests.withColumns({**out, "valid": F.coalesce(valid, F.lit(False))})


def rrf_weighted(fts: DataFrame, vector: DataFrame, w_fts: float = 0.3, w_vec: float = 0.7, k: int = 60) -> DataFrame:
    """(id, score, source) from two rankings (id, rank from 0): sum of w / (k + rank)."""
    a = fts.select(F.col("id").alias("ia"), F.col("rank").alias("ra"))
    b = vector.select(F.col("id").alias("ib"), F.col("rank").alias("rb"))
    part = F.coalesce(w_fts / (k + F.col("ra")), F.lit(0.0)) + F.coalesce(w_vec / (k + F.col("rb")), F.lit(0.0))
    source = F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), "both").when(F.col("ra").isNotNull(), "fts").otherwise("vector")
    return a.join(b, F.col("ia") == F.col("ib"), "full").select(F.coalesce("ia", "ib").alias("id"), part.alias("score"), source.alias("source"))


def rrf(sources: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """(id, score) from rankings (id, rank from 0): sum of 1 / (k + rank + 1)."""
    return _union(sources, "id", "rank").groupBy("id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def _union(frames: Sequence[DataFrame], *cols: str) -> DataFrame:
    out = frames[0].select(*cols)
    for f in frames[1:]:
        out = out.unionByName(f.select(*cols))
    return out


def weighted(sources: Mapping[str, DataFrame], weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """(id, score, source_count, parts) of sources (id, score); a source that lacks a row adds nothing."""
    tagged = [df.select("id", F.lit(name).alias("source"), F.col("score").cast("double").alias("s")) for name, df in sources.items()]
    rows = _union(tagged, "id", "source", "s").groupBy("id", "source").agg(F.max("s").alias("s"))
    part = F.col("s") * by_value(weights, F.col("source"), 0.0)
    return rows.groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("source_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", part.alias("part"))))).alias("parts"))


def breakdown(parts: Column, score: Column) -> Column:
    """Share of each source in percent; empty if the whole is next to nothing."""
    return F.when(score < 1e-4, F.create_map().cast("map<string,double>")).otherwise(F.transform_values(parts, lambda _, v: v / score * 100.0))


def rerank(df: DataFrame, query: str, score: str = "score") -> DataFrame:
    """score times kind, times 1.5 where the symbol's name holds the query's, times 1 + recency / 10."""
    name = T.normalise_identifier_text(query)
    named = F.when(F.coalesce(T.normalise_identifier(F.col("symbol_name")), F.lit("")).contains(name), 1.5).otherwise(1.0)
    return df.withColumn(score, F.col(score) * by_value(KIND_MULTIPLIERS, F.col("kind")) * named * (1.0 + 0.1 * F.col("recency_score")))


def edge_counts(edges: DataFrame) -> DataFrame:
    """Per target: incoming calls, imports and tests."""
    return edges.groupBy(F.col("dst").alias("id")).agg(*(F.count_if(F.col("type") == t).alias(n) for t, n in (("calls", "callers"), ("imports", "importers"), ("test_of", "tests"))))


def graph_importance(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """.3 ln(2 + callers) + .2 ln(2 + importers) + .1 ln(2 + tests) of every chunk."""
    joined = chunks.select("id").join(edge_counts(edges), "id", "left")
    score = sum((w * F.log(2.0 + F.coalesce(F.col(c), F.lit(0))) for c, w in (("callers", 0.3), ("importers", 0.2), ("tests", 0.1))), F.lit(0.0))
    return joined.select("id", score.alias("score"))


def quality_importance(chunks: DataFrame, edges: DataFrame, from_test: DataFrame) -> DataFrame:
    """ln(2 + sum of edge qualities); an edge from test code counts half.  from_test: (id, is_test)."""
    return chunks.select("id").join(quality_sums(edges, from_test), "id", "left").select("id", F.log(2.0 + F.coalesce("q", F.lit(0.0))).alias("score"))


def quality_sums(edges: DataFrame, from_test: DataFrame) -> DataFrame:
    """(id, q): sum of the qualities of edges from known chunks.  from_test: (id, is_test)."""
    side = edges.join(from_test.select(F.col("id").alias("src"), "is_test"), "src")
    q = by_value(EDGE_QUALITY, F.col("type")) * F.when(F.coalesce("is_test", F.lit(False)), FROM_TEST).otherwise(1.0)
    return side.groupBy(F.col("dst").alias("id")).agg(F.sum(q).alias("q"))


def signal_score(recency: Column, churn: Column, w_recency: float = 0.3, w_churn: float = 0.2, inverted: bool = False) -> Column:
    """Recency and churn; ``inverted``: little churn counts more."""
    return recency * w_recency + (w_churn / (1.0 + churn) if inverted else churn * w_churn)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree), each side aggregated before they meet."""
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("in_degree"))
    outs = edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("out_degree"))
    return ins.join(outs, "id", "full").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def chunk_importance(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """.4 in-degree + .3 recency + .3 / (1 + churn)."""
    joined = chunks.join(degrees(edges), "id", "left")
    return joined.select("id", (F.coalesce("in_degree", F.lit(0)) * 0.4 + F.col("recency_score") * 0.3 + 0.3 / (1.0 + F.col("churn_score"))).alias("importance"))


def dedup(df: DataFrame, score: str = "score", distinct_null: bool = False) -> DataFrame:
    """The best row of each (relpath, symbol, start line); a missing symbol counts as '' unless ``distinct_null``."""
    symbol = F.coalesce("symbol_name", F.lit("")) if not distinct_null else F.struct(F.col("symbol_name").isNull(), F.coalesce("symbol_name", F.lit("")))
    w = Window.partitionBy("relpath", symbol, "start_line").orderBy(F.desc(score), F.asc("id"))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def confidence(df: DataFrame, score: str = "score", exact: str = "exact_mult") -> DataFrame:
    """Of a cut result: score_gap to the next row (last: 0) and is_exact."""
    w = Window.orderBy(F.desc(score), F.asc("id"))
    gap = F.coalesce(F.col(score) - F.lead(score).over(w), F.lit(0.0))
    return df.withColumn("score_gap", gap).withColumn("is_exact", F.coalesce(F.col(exact) >= 2.9, F.lit(False)))


def context_importance(base: Column, relation: Column, distance: Column, importance: Column, recency: Column, churn: Column, same_dir: Column, kind: Column) -> Column:
    """Importance of a related chunk, 0 to 100."""
    low = F.lit(0.1)
    score = base * relation * F.pow(F.lit(0.7), distance) * F.greatest(importance, low) * F.greatest(recency, low) * F.greatest(1.0 / (1.0 + churn), low)
    score = score * F.when(same_dir, 1.3).otherwise(1.0) * F.when(kind == "test", 1.5).when(kind == "config", 1.1).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def lexical_semantic(lexical: Column, code: Column, text: Column, recency: Column, churn: Column) -> Column:
    zero = F.lit(0.0)
    return 0.55 * F.coalesce(lexical, zero) + 0.30 * F.coalesce(code, zero) + 0.10 * F.coalesce(text, zero) + 0.03 * recency + 0.02 / (1.0 + churn)
