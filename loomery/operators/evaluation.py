"""Retrieval metrics, statistics and experiments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.sources.durable import cut


def precision_at(df: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """Relevant rows of rank 1 to k, over k.  df: (query, rank, relevant)."""
    hits = F.count_if((F.col("rank") <= k) & F.col("relevant"))
    return df.groupBy(query).agg((hits / float(k) if k else F.lit(0.0)).alias("precision"))


def recall_at(df: DataFrame, totals: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """The same over all relevant rows there are; 0 if none.  totals: (query, total)."""
    hits = df.groupBy(query).agg(F.count_if((F.col("rank") <= k) & F.col("relevant")).alias("_h"))
    return hits.join(totals, query, "left").select(query, F.when(F.col("total") > 0, F.col("_h") / F.col("total")).otherwise(0.0).alias("recall"))


def ndcg_at(df: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """Discounted gain of the first k grades over that of the returned list sorted by grade; 0 if that is 0."""
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), F.asc("rank")))
    rows = df.withColumn("_ideal", ideal)

    def gain(rank: str) -> Column:
        return F.sum(F.when(F.col(rank) <= k, F.col("grade") / F.log2(F.col(rank) + 1.0)).otherwise(0.0))

    sums = rows.groupBy(query).agg(gain("rank").alias("_d"), gain("_ideal").alias("_i"))
    return sums.select(query, F.when(F.col("_i") > 0, F.col("_d") / F.col("_i")).otherwise(0.0).alias("ndcg"))


def reciprocal_rank(df: DataFrame, query: str = "query_id") -> DataFrame:
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return df.groupBy(query).agg(F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"))


def lower_percentiles(df: DataFrame, col: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles at index floor((n - 1) p).

    Equal values are counted first; counts are dealt to ranges of values and numbered from the ranges' sums, so no task
    holds a group, however hot.
    """
    keys = [F.col(c) for c in by]
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = cut(counts.repartitionByRange(*keys, F.col("_v")).withColumn("_r", F.spark_partition_id()))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range and group
    sums = ranged.groupBy(*by, "_r").agg(F.sum("_n").alias("_s"))
    starts = sums.select(*by, "_r", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_from"), F.sum("_s").over(Window.partitionBy(*by, F.lit(0))).alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_r").orderBy("_v"))
    same = F.col("_r") == F.col("_q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    numbered = ranged.withColumn("_to", upto).join(starts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_r").alias("_q"), "_from", "_all"), same)
    picks = []
    for p in ps:
        at = F.floor((F.col("_all") - 1) * p)
        hit = (at < F.col("_from") + F.col("_to")) & (at >= F.col("_from") + F.col("_to") - F.col("_n"))
        picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"p{round(p * 100)}"))
    return numbered.groupBy(*by).agg(*picks)


def metric_delta(old: Column, new: Column) -> Column:
    return new - old


def significant(deltas: Sequence[Column], least: float = 0.02) -> Column:
    return F.greatest(*(F.abs(d) for d in deltas)) > least


def moments(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.var_samp(col).alias("var_samp"), F.var_pop(col).alias("var_pop"), F.stddev_samp(col).alias("sd"), F.min(col).alias("least"), F.max(col).alias("most"))


def welch(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> tuple[Column, Column]:
    """(t, degrees of freedom)."""
    a, b = v1 / n1, v2 / n2
    return (m1 - m2) / F.sqrt(a + b), (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of a 2 x 2 table; 0 if a margin is empty."""
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins > 0, n * (a * d - b * c) * (a * d - b * c) / margins).otherwise(0.0)


def chi_square_p(x: Column) -> Column:
    """p-value by the table of one degree of freedom."""
    # fixed values: critical values
    return F.when(x < 0, 1.0).when(x > 10.83, 0.001).when(x > 6.63, 0.01).when(x > 3.84, 0.05).when(x > 2.71, 0.1).otherwise(0.5)


def z_value(confidence: float) -> float:
    # fixed values: two-sided normal quantiles
    return {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}[confidence]


def proportion_interval(p: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    half = z_value(confidence) * F.sqrt(p * (1.0 - p) / n)
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def mean_interval(mean: Column, sd: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Normal interval, for more than 30 rows."""
    half = z_value(confidence) * sd / F.sqrt(n)
    return mean - half, mean + half


def sample_size(p1: float, p2: float, z_alpha: float = 1.96, z_beta: float = 0.8416) -> int:
    """Rows per side that tell two proportions apart."""
    mean = (p1 + p2) / 2
    top = z_alpha * math.sqrt(2 * mean * (1 - mean)) + z_beta * math.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return math.ceil(top * top / (p1 - p2) ** 2)


def sample_size_of(p1: Column, p2: Column, z_alpha: float = 1.96, z_beta: float = 0.8416) -> Column:
    """``sample_size`` of columns; null where both are equal."""
    mean = (p1 + p2) / 2
    top = z_alpha * F.sqrt(2 * mean * (1 - mean)) + z_beta * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return F.when(p1 != p2, F.ceil(top * top / F.pow(p1 - p2, F.lit(2)))).cast("long")


def cohens_d(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.when(pooled > 0, (m1 - m2) / pooled).otherwise(0.0)


def effect_band(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").when(a < 1.3, "large").otherwise("very large")


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26."""
    a = F.abs(x)
    t = 1.0 / (1.0 + 0.3275911 * a)
    # fixed values: the published coefficients, from t to t^5
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1.0 - poly * F.exp(-a * a))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / math.sqrt(2.0)))


def share_over(df: DataFrame, by: str, col: str, least: float = 0.7) -> DataFrame:
    """Transferability: share of rates above ``least``, and their variance, per task."""
    return df.groupBy(by).agg(F.avg((F.col(col) > least).cast("double")).alias("share"), F.var_pop(col).alias("variance"))


def time_buckets(df: DataFrame, ts: str, hours: int, *aggs: Column) -> DataFrame:
    """Tumbling buckets of epoch hours, floor(h / b) * b."""
    bucket = (F.floor(F.unix_timestamp(ts) / 3600 / hours) * hours).cast("long")
    return df.groupBy(bucket.alias("bucket")).agg(*aggs)


def split_bucket(experiment: str, user: Column, query: Column, seed: int = 0) -> Column:
    """0 to 99, the same for the same experiment, user and query: 32 bits of their SHA-256."""
    text = F.concat_ws(":", F.lit(experiment), user, query, F.lit(str(seed)))
    return (F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("long") % 100).cast("long")


def compare_results(old: DataFrame, new: DataFrame, query: str = "query_id") -> DataFrame:
    """Per query: overlap, only_old, only_new, moved ranks, mean score difference of shared rows."""
    a = old.select(query, "id", F.col("rank").alias("ra"), F.col("score").alias("sa"))
    b = new.select(F.col(query).alias("_q"), F.col("id").alias("_i"), F.col("rank").alias("rb"), F.col("score").alias("sb"))
    both = a.join(b, (F.col(query) == F.col("_q")) & (F.col("id") == F.col("_i")), "full").withColumn("q", F.coalesce(query, "_q"))
    shared = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    return both.groupBy(F.col("q").alias(query)).agg(
        F.count_if(shared).alias("overlap"),
        F.count_if(F.col("rb").isNull()).alias("only_old"),
        F.count_if(F.col("ra").isNull()).alias("only_new"),
        F.count_if(shared & (F.col("ra") != F.col("rb"))).alias("moved"),
        F.coalesce(F.avg(F.when(shared, F.col("sb") - F.col("sa"))), F.lit(0.0)).alias("score_diff"),
    )


def leaderboard(df: DataFrame, by: str, score: str, key: str, keep: int = 10) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= keep)


def gates(recall: Column, precision: Column, ndcg: Column, latency_diff: Column, error_diff: Column) -> Column:
    """Whether quality gates hold."""
    return (recall >= 0.80) & (precision >= 0.70) & (ndcg >= 0.75) & (latency_diff <= 10) & (error_diff <= 0.01)


# fixed values: upper bounds of the buckets of search metrics
LATENCY_SECONDS = (0.001, 0.005, 0.010, 0.025, 0.050, 0.075, 0.100, 0.250, 0.500, 1.0, 2.5, 5.0)
FUSION_SECONDS = (0.0005, 0.001, 0.002, 0.005, 0.010, 0.025, 0.050)
RESULT_COUNTS = (0.0, 1.0, 5.0, 10.0, 20.0, 50.0, 100.0)


def histogram(df: DataFrame, col: str, bounds: Sequence[float]) -> DataFrame:
    """(bound, n): cumulative counts up to each bound, and of all rows under a null bound; one pass, no join."""
    counts = [F.count_if(F.col(col) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    row = df.agg(*counts, F.count(col).alias("all"))
    pairs = [F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return row.select(F.explode(F.array(*pairs, F.struct(F.lit(None).cast("double").alias("bound"), F.col("all").alias("n")))).alias("x")).select("x.bound", "x.n")
