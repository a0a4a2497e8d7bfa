"""Queries: retrieval metrics, statistics, experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import evaluation as E
from loomery.sources.tables import read, twin

from .catalog import query


def _ranked(spark, d):
    return read(spark, d, "ranked")


@query("C01_precision_at_k", twin("SELECT query_id, round(CAST(count(*) FILTER (WHERE rank <= 10 AND relevant) AS DOUBLE) / 10, 6) AS precision FROM ranked GROUP BY query_id", "ranked"))
def _(spark, d):
    return E.precision_at(_ranked(spark, d), 10).select("query_id", F.round("precision", 6).alias("precision"))


@query("C02_recall_at_k", twin("SELECT query_id, round(CASE WHEN count(*) FILTER (WHERE relevant) > 0 THEN CAST(count(*) FILTER (WHERE rank <= 10 AND relevant) AS DOUBLE) / count(*) FILTER (WHERE relevant) ELSE 0 END, 6) AS recall FROM ranked GROUP BY query_id", "ranked"))
def _(spark, d):
    totals = _ranked(spark, d).groupBy("query_id").agg(F.count_if("relevant").alias("total"))
    return E.recall_at(_ranked(spark, d), totals, 10).select("query_id", F.round("recall", 6).alias("recall"))


_NDCG = "WITH i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal FROM ranked), s AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN grade / log2(ideal + 1.0) ELSE 0 END) AS idcg FROM i GROUP BY query_id)"


@query("C03_ndcg_at_k", twin(f"{_NDCG} SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM s", "ranked"))
def _(spark, d):
    return E.ndcg_at(_ranked(spark, d), 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("C04_reciprocal_rank", twin("SELECT query_id, round(coalesce(1.0 / min(rank) FILTER (WHERE relevant), 0), 6)::DOUBLE AS rr FROM ranked GROUP BY query_id", "ranked"))
def _(spark, d):
    return E.reciprocal_rank(_ranked(spark, d)).select("query_id", F.round("rr", 6).alias("rr"))


@query("C05_quality_percentiles", "WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(CASE WHEN i = floor((n - 1) * 0.5) THEN value END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.95) THEN value END) AS p95, max(CASE WHEN i = floor((n - 1) * 0.99) THEN value END) AS p99 FROM n GROUP BY event_type")
def _(spark, d):
    return E.lower_percentiles(read(spark, d, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])


_HALF = "SELECT query_id % 2 AS side, avg(CASE WHEN relevant THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share, avg(score) AS mean FROM ranked WHERE rank <= 5 GROUP BY query_id % 2"


@query("C06_metric_comparison", twin(f"WITH h AS ({_HALF}) SELECT round(b.share - a.share, 6) AS share_delta, greatest(abs(b.share - a.share), abs(b.mean - a.mean)) > 0.02 AS significant, round(least(10 * greatest(abs(b.share - a.share), abs(b.mean - a.mean)), 1), 6) AS confidence FROM h a, h b WHERE a.side = 0 AND b.side = 1", "ranked"))
def _(spark, d):
    top = _ranked(spark, d).filter("rank <= 5")

    def mean(side: int, c):
        return F.avg(F.when(F.col("query_id") % 2 == side, c))

    hit = F.col("relevant").cast("double")
    row = top.agg(*(mean(s, c).alias(f"{n}{s}") for s in (0, 1) for n, c in (("share", hit), ("mean", F.col("score")))))
    deltas = [E.metric_delta(F.col("share0"), F.col("share1")), E.metric_delta(F.col("mean0"), F.col("mean1"))]
    most = F.greatest(*(F.abs(x) for x in deltas))
    return row.select(F.round(deltas[0], 6).alias("share_delta"), E.significant(deltas).alias("significant"), F.round(F.least(10 * most, F.lit(1.0)), 6).alias("confidence"))


@query("C07_segments", "SELECT coalesce(CAST(nullif(user_id % 10, 3) AS VARCHAR), 'anonymous') AS segment, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(spark, d):
    segment = F.coalesce(F.nullif(F.col("user_id") % 10, F.lit(3)).cast("string"), F.lit("anonymous"))
    return read(spark, d, "events").groupBy(segment.alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("C08_C16_moments", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var_samp, round(var_pop(value), 6) AS var_pop, round(stddev_samp(value), 6) AS sd, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def _(spark, d):
    m = E.moments(read(spark, d, "events"), "value", ["event_type"])
    return m.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "var_samp", "var_pop", "sd")), "least", "most")


_SIDES = """SELECT event_type, avg(CASE WHEN user_id % 2 = 0 THEN value END) AS m1, var_samp(CASE WHEN user_id % 2 = 0 THEN value END) AS v1, CAST(count(CASE WHEN user_id % 2 = 0 THEN value END) AS DOUBLE) AS n1,
avg(CASE WHEN user_id % 2 = 1 THEN value END) AS m2, var_samp(CASE WHEN user_id % 2 = 1 THEN value END) AS v2, CAST(count(CASE WHEN user_id % 2 = 1 THEN value END) AS DOUBLE) AS n2 FROM events GROUP BY event_type"""


def _sides(spark, d):
    def of(s: int):
        x = F.when(F.col("user_id") % 2 == s, F.col("value"))
        return F.avg(x).alias(f"m{s + 1}"), F.var_samp(x).alias(f"v{s + 1}"), F.count(x).cast("double").alias(f"n{s + 1}")

    return read(spark, d, "events").groupBy("event_type").agg(*of(0), *of(1))


_ARGS = ("m1", "v1", "n1", "m2", "v2", "n2")


def _cols():
    return [F.col(c) for c in _ARGS]


@query("C09_welch", f"SELECT event_type, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 4) AS df FROM ({_SIDES}) s")
def _(spark, d):
    t, df = E.welch(*_cols())
    return _sides(spark, d).select("event_type", F.round(t, 6).alias("t"), F.round(df, 4).alias("df"))


_TABLE = "SELECT count(*) FILTER (WHERE user_id % 2 = 0 AND event_type = 'click') AS a, count(*) FILTER (WHERE user_id % 2 = 0 AND event_type = 'view') AS b, count(*) FILTER (WHERE user_id % 2 = 1 AND event_type = 'click') AS c, count(*) FILTER (WHERE user_id % 2 = 1 AND event_type = 'view') AS d FROM events"


@query("C10_chi_square", f"WITH t AS (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d FROM ({_TABLE}) x), y AS (SELECT (a + b + c + d) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d)) AS x FROM t) SELECT round(x, 6) AS chi2, CASE WHEN x > 10.83 THEN 0.001::DOUBLE WHEN x > 6.63 THEN 0.01::DOUBLE WHEN x > 3.84 THEN 0.05::DOUBLE WHEN x > 2.71 THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS p FROM y")
def _(spark, d):
    def n(side: int, kind: str):
        return F.count_if((F.col("user_id") % 2 == side) & (F.col("event_type") == kind)).cast("double")

    row = read(spark, d, "events").agg(n(0, "click").alias("a"), n(0, "view").alias("b"), n(1, "click").alias("c"), n(1, "view").alias("d"))
    x = E.chi_square(*(F.col(c) for c in "abcd"))
    return row.select(F.round(x, 6).alias("chi2"), E.chi_square_p(x).alias("p"))


@query("C11_intervals", "WITH s AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY event_type) SELECT event_type, round(greatest(0, p - 1.96 * sqrt(p * (1 - p) / n)), 6) AS p_low, round(least(1, p + 1.96 * sqrt(p * (1 - p) / n)), 6) AS p_high, round(m - 1.96 * sd / sqrt(n), 6) AS m_low, round(m + 1.96 * sd / sqrt(n), 6) AS m_high FROM s")
def _(spark, d):
    s = read(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.avg((F.col("value") > 100).cast("double")).alias("p"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    low, high = E.proportion_interval(F.col("p"), F.col("n"))
    m_low, m_high = E.mean_interval(F.col("m"), F.col("sd"), F.col("n"))
    return s.select("event_type", *(F.round(x, 6).alias(k) for k, x in (("p_low", low), ("p_high", high), ("m_low", m_low), ("m_high", m_high))))


# shares of clicks and of purchases among a user's events; those that are equal tell nothing apart
_SHARES = "s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id), q AS (SELECT user_id, c / n::DOUBLE AS p1, p / n::DOUBLE AS p2 FROM s)"


@query("C12_sample_size", f"WITH {_SHARES} SELECT user_id, CASE WHEN p1 <> p2 THEN CAST(ceil(pow(1.96::DOUBLE * sqrt(2 * ((p1 + p2) / 2) * (1 - (p1 + p2) / 2)) + 0.8416::DOUBLE * sqrt(p1 * (1 - p1) + p2 * (1 - p2)), 2) / pow(p1 - p2, 2)) AS BIGINT) END AS n FROM q")
def _(spark, d):
    rate = [F.count_if(F.col("event_type") == k) / F.count("*") for k in ("click", "purchase")]
    shares = read(spark, d, "events").groupBy("user_id").agg(rate[0].alias("p1"), rate[1].alias("p2"))
    return shares.select("user_id", E.sample_size_of(F.col("p1"), F.col("p2")).alias("n"))


_COHEN = "(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))"


@query("C13_cohens_d", f"SELECT event_type, round({_COHEN}, 6) AS d, CASE WHEN abs({_COHEN}) < 0.2 THEN 'negligible' WHEN abs({_COHEN}) < 0.5 THEN 'small' WHEN abs({_COHEN}) < 0.8 THEN 'medium' WHEN abs({_COHEN}) < 1.3 THEN 'large' ELSE 'very large' END AS band FROM ({_SIDES}) s")
def _(spark, d):
    x = E.cohens_d(*_cols())
    return _sides(spark, d).select("event_type", F.round(x, 6).alias("d"), E.effect_band(x).alias("band"))


@query("C14_difference_interval", f"SELECT event_type, round(m1 - m2 - 1.96 * sqrt(v1 / n1 + v2 / n2), 6) AS low, round(m1 - m2 + 1.96 * sqrt(v1 / n1 + v2 / n2), 6) AS high FROM ({_SIDES}) s")
def _(spark, d):
    half = 1.96 * F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))
    m = F.col("m1") - F.col("m2")
    return _sides(spark, d).select("event_type", F.round(m - half, 6).alias("low"), F.round(m + half, 6).alias("high"))


_T = "(1 / (1 + 0.3275911 * abs(z / sqrt(2.0))))"


@query("C15_normal_cdf", f"WITH x AS (SELECT event_id, (value - 100.0) / 50.0 AS z FROM events) SELECT event_id, round(0.5 * (1 + sign(z) * (1 - ((((1.061405429 * {_T} - 1.453152027) * {_T} + 1.421413741) * {_T} - 0.284496736) * {_T} + 0.254829592) * {_T} * exp(-z * z / 2))), 6) AS cdf FROM x")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.round(E.normal_cdf((F.col("value") - 100.0) / 50.0), 6).alias("cdf"))


@query("C17_transferability", "SELECT user_id, round(avg(CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share, round(var_pop(value), 4) AS variance FROM events GROUP BY user_id")
def _(spark, d):
    return E.share_over(read(spark, d, "events"), "user_id", "value", 100.0).select("user_id", F.round("share", 6).alias("share"), F.round("variance", 4).alias("variance"))


@query("C18_gap_consistency", "WITH a AS (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'view' GROUP BY user_id), b AS (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT count(*) AS n, round(avg(b.m - a.m), 6) AS gap, round(var_pop(b.m - a.m), 4) AS variance FROM a JOIN b ON a.user_id = b.user_id")
def _(spark, d):
    def mean(kind: str, name: str):
        return read(spark, d, "events").filter(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias(name))

    gap = F.col("b") - F.col("a")
    return mean("view", "a").join(mean("click", "b"), "user_id").agg(F.count("*").alias("n"), F.round(F.avg(gap), 6).alias("gap"), F.round(F.var_pop(gap), 4).alias("variance"))


@query("C19_advantage", "SELECT round(avg(CASE WHEN user_id % 2 = 0 THEN value END) - avg(CASE WHEN user_id % 2 = 1 THEN value END), 6) AS saved, round((avg(CASE WHEN user_id % 2 = 0 THEN value END) - avg(CASE WHEN user_id % 2 = 1 THEN value END)) / avg(CASE WHEN user_id % 2 = 0 THEN value END) * 100, 6) AS percent FROM events")
def _(spark, d):
    a, b = (F.avg(F.when(F.col("user_id") % 2 == s, F.col("value"))) for s in (0, 1))
    return read(spark, d, "events").agg(F.round(a - b, 6).alias("saved"), F.round((a - b) / a * 100, 6).alias("percent"))


@query("C20_tier_score", "SELECT user_id, round(0.4 * coalesce(avg(CASE WHEN event_type = 'view' THEN value END), 0) + 0.4 * coalesce(avg(CASE WHEN event_type = 'click' THEN value END), 0) + 0.2 * coalesce(avg(CASE WHEN event_type = 'purchase' THEN value END), 0), 6) AS score FROM events GROUP BY user_id")
def _(spark, d):
    parts = [w * F.coalesce(F.avg(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0)) for k, w in (("view", 0.4), ("click", 0.4), ("purchase", 0.2))]
    return read(spark, d, "events").groupBy("user_id").agg(F.round(parts[0] + parts[1] + parts[2], 6).alias("score"))


@query("C21_median_paired_t", "WITH p AS (SELECT user_id, avg(CASE WHEN event_type = 'view' THEN value END) - avg(CASE WHEN event_type = 'click' THEN value END) AS x FROM events GROUP BY user_id) SELECT round(median(x), 6) AS median, round(avg(x) / (stddev_samp(x) / sqrt(count(x))), 6) AS t FROM p")
def _(spark, d):
    def mean(kind: str):
        return F.avg(F.when(F.col("event_type") == kind, F.col("value")))

    p = read(spark, d, "events").groupBy("user_id").agg((mean("view") - mean("click")).alias("x"))
    return p.agg(F.round(F.median("x"), 6).alias("median"), F.round(F.avg("x") / (F.stddev_samp("x") / F.sqrt(F.count("x"))), 6).alias("t"))


@query("C30_leaderboard", "SELECT event_type, event_id, value, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) x WHERE place <= 10")
def _(spark, d):
    return E.leaderboard(read(spark, d, "events"), "event_type", "value", "event_id").select("event_type", "event_id", "value", "place")


@query("C40_selection", "WITH b AS (SELECT user_id, max(value) AS best FROM events GROUP BY user_id) SELECT user_id, best, place <= 2 AS elite FROM (SELECT *, row_number() OVER (ORDER BY best DESC, user_id) AS place FROM b) x WHERE place <= 8")
def _(spark, d):
    b = read(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("best"))
    top = b.orderBy(F.desc("best"), "user_id").limit(8).withColumn("g", F.lit(0))
    return E.leaderboard(top, "g", "best", "user_id", 8).select("user_id", "best", (F.col("place") <= 2).alias("elite"))


@query("C50_traffic_split", "SELECT event_id, b AS bucket, b < 20 AS treated FROM (SELECT event_id, CAST('0x' || left(sha256('exp:' || user_id || ':' || event_type || ':0'), 8) AS BIGINT) % 100 AS b FROM events) x")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", E.split_bucket("exp", F.col("user_id").cast("string"), F.col("event_type")).alias("bucket"))
    return e.withColumn("treated", F.col("bucket") < 20)


@query("C51_time_buckets", "SELECT CAST(floor(epoch(ts) / 3600 / 6) * 6 AS BIGINT) AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(spark, d):
    return E.time_buckets(read(spark, d, "events"), "ts", 6, F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_OLDNEW = "o AS (SELECT query_id, id, rank, score FROM ranked WHERE rank <= 10), w AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS rank, score + grade AS score FROM ranked), n AS (SELECT * FROM w WHERE rank <= 10)"


def _old_new(spark, d):
    from pyspark.sql import Window

    r = _ranked(spark, d)
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    new = r.select("query_id", "id", F.row_number().over(w).alias("rank"), (F.col("score") + F.col("grade")).alias("score"))
    return r.filter("rank <= 10"), new.filter("rank <= 10")


@query("C52_shadow_comparison", twin(f"WITH {_OLDNEW} SELECT coalesce(o.query_id, n.query_id) AS query_id, count(*) FILTER (WHERE o.id IS NOT NULL AND n.id IS NOT NULL) AS overlap, count(*) FILTER (WHERE n.id IS NULL) AS only_old, count(*) FILTER (WHERE o.id IS NULL) AS only_new, count(*) FILTER (WHERE o.rank <> n.rank) AS moved, round(coalesce(avg(n.score - o.score), 0), 6) AS score_diff FROM o FULL JOIN n ON o.query_id = n.query_id AND o.id = n.id GROUP BY 1", "ranked"))
def _(spark, d):
    out = E.compare_results(*_old_new(spark, d))
    return out.withColumn("score_diff", F.round("score_diff", 6))


@query("C31_rank_diff", twin(f"WITH {_OLDNEW} SELECT o.query_id, o.id, n.rank - o.rank AS diff FROM o JOIN n ON o.query_id = n.query_id AND o.id = n.id WHERE n.rank <> o.rank", "ranked"))
def _(spark, d):
    o, n = _old_new(spark, d)
    both = o.select("query_id", "id", F.col("rank").alias("a")).join(n.select("query_id", "id", F.col("rank").alias("b")), ["query_id", "id"])
    return both.filter("a <> b").select("query_id", "id", (F.col("b") - F.col("a")).cast("long").alias("diff"))


@query("C53_interactions", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS dwell FROM events GROUP BY event_type")
def _(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("dwell"))


@query("C54_quality_gates", twin(f"{_NDCG}, m AS (SELECT query_id, CAST(count(*) FILTER (WHERE rank <= 5 AND relevant) AS DOUBLE) / 5 AS p FROM ranked GROUP BY query_id) SELECT s.query_id, (1.0 >= 0.8 AND p >= 0.7 AND CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END >= 0.75) AS passed FROM s JOIN m ON m.query_id = s.query_id", "ranked"))
def _(spark, d):
    r = _ranked(spark, d)
    both = E.ndcg_at(r, 10).join(E.precision_at(r, 5), "query_id")
    return both.select("query_id", E.gates(F.lit(1.0), F.col("precision"), F.col("ndcg"), F.lit(0.0), F.lit(0.0)).alias("passed"))


def _buckets(column: str, bounds: str) -> str:
    values = ", ".join(f"({b}::DOUBLE)" for b in bounds.split())
    return f"SELECT bound, (SELECT count(*) FROM events WHERE bound IS NULL OR {column} <= bound) AS n FROM (VALUES {values}, (NULL)) b(bound)"


@query("A208_latency_histogram", _buckets("value / 100", "0.001 0.005 0.01 0.025 0.05 0.075 0.1 0.25 0.5 1 2.5 5"))
def _(spark, d):
    return E.histogram(read(spark, d, "events").withColumn("value", F.col("value") / 100), "value", E.LATENCY_SECONDS)


@query("A208_fusion_histogram", _buckets("value / 1000", "0.0005 0.001 0.002 0.005 0.01 0.025 0.05"))
def _(spark, d):
    return E.histogram(read(spark, d, "events").withColumn("value", F.col("value") / 1000), "value", E.FUSION_SECONDS)


@query("A208_result_histogram", _buckets("event_id % 150", "0 1 5 10 20 50 100"))
def _(spark, d):
    return E.histogram(read(spark, d, "events").withColumn("results", F.col("event_id") % 150), "results", E.RESULT_COUNTS)


@query("C61_first_hit_rank", twin("SELECT query_id, count(*) AS n, min(CASE WHEN rank <= 20 AND grade = 3 THEN rank END) AS hit FROM ranked GROUP BY query_id", "ranked"))
def _(spark, d):
    return _ranked(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.when((F.col("rank") <= 20) & (F.col("grade") == 3), F.col("rank"))).alias("hit"))


@query("C62_tool_counts", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS large FROM events GROUP BY event_type")
def _(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"))


@query("C63_session_timing", "SELECT user_id, round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds FROM events GROUP BY user_id")
def _(spark, d):
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return read(spark, d, "events").groupBy("user_id").agg(F.round(span / 1e6, 3).alias("seconds"))
