"""Queries: changes, upserts, aggregates, windows over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import delta
from loomery.sources.tables import read, twin

from .catalog import query


@query("A180_upsert", "SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.v ELSE n.v END AS v FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0) o FULL JOIN (SELECT l_orderkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey) n ON o.k = n.k")
def _(spark, d):
    old = read(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = read(spark, d, "lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"))
    return delta.upsert(old, new, ["k"], ["v"])


@query("A181_language_kept", twin("SELECT c.id, coalesce(CASE WHEN n.id % 4 = 0 THEN NULL ELSE 'xx' END, c.language) AS language FROM chunks c LEFT JOIN (SELECT id FROM chunks WHERE id % 2 = 0) n ON n.id = c.id WHERE n.id IS NOT NULL UNION ALL SELECT id, language FROM chunks WHERE id % 2 <> 0", "chunks"))
def _(spark, d):
    old = read(spark, d, "chunks").select("id", "language")
    new = old.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.lit(None).cast("string")).otherwise("xx").alias("language"))
    return delta.upsert(old, new, ["id"], keep_old=["language"])


@query("A180_insert_missing", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0")
def _(spark, d):
    old = read(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"))
    return delta.insert_missing(old, read(spark, d, "lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("k")), ["k"])


@query("A182_cascade_delete", twin("WITH gone AS (SELECT id FROM chunks WHERE file_id % 10 = 3) SELECT 'chunks' AS t, count(*) AS n FROM chunks WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'junction', count(*) FROM junction WHERE chunk_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edges', count(*) FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) UNION ALL SELECT 'files', count(DISTINCT file_id) FROM chunks WHERE file_id % 10 <> 3", "chunks", "junction", "edges"))
def _(spark, d):
    c = read(spark, d, "chunks")
    files = c.select(F.col("file_id").alias("id")).distinct()
    left = delta.cascade(files, c, read(spark, d, "junction"), read(spark, d, "edges"), files.filter("id % 10 = 3"))
    out = None
    for name, df in left.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("A183_drop_worktree", twin("SELECT id FROM chunks WHERE id IN (SELECT chunk_id FROM junction WHERE worktree_id <> 1)", "chunks", "junction"))
def _(spark, d):
    return delta.drop_worktree(read(spark, d, "chunks"), read(spark, d, "junction"), 1)[0].select("id")


_DIFF = "d AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'modified' ELSE 'none' END AS change, o.hash AS old_hash, n.hash AS new_hash FROM old_files o FULL JOIN new_files n ON o.path = n.path)"


def _changes(spark, d):
    return delta.detect_changes(read(spark, d, "old_files"), read(spark, d, "new_files"))


@query("A184_change_detection", twin(f"WITH {_DIFF} SELECT * FROM d", "old_files", "new_files"))
def _(spark, d):
    return _changes(spark, d)


@query("A186_state_diff", twin(f"WITH {_DIFF} SELECT change, count(*) AS n FROM d WHERE change <> 'none' GROUP BY change", "old_files", "new_files"))
def _(spark, d):
    return _changes(spark, d).filter("change <> 'none'").groupBy("change").agg(F.count("*").alias("n"))


@query("A185_move_detection", twin(f"WITH {_DIFF}, g AS (SELECT old_hash AS hash, path, row_number() OVER (PARTITION BY old_hash ORDER BY path) AS rn FROM d WHERE change = 'deleted'), c AS (SELECT new_hash AS hash, path, row_number() OVER (PARTITION BY new_hash ORDER BY path) AS rn FROM d WHERE change = 'new') SELECT g.path AS from_path, c.path AS to_path, g.hash FROM g JOIN c ON g.hash = c.hash AND g.rn = c.rn", "old_files", "new_files"))
def _(spark, d):
    return delta.detect_moves(_changes(spark, d))


_FOLD = """CASE WHEN a = 'none' THEN x WHEN a = 'new' AND x = 'deleted' THEN 'none' WHEN a = 'new' THEN 'new' WHEN a = 'modified' AND x = 'deleted' THEN 'deleted' WHEN a = 'modified' THEN 'modified' WHEN a = 'deleted' AND x = 'new' THEN 'modified' ELSE 'deleted' END"""


@query("A187_change_algebra", f"SELECT CAST(user_id AS VARCHAR) AS path, nullif(list_reduce(list_prepend('none', list(CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'modified' ELSE 'deleted' END ORDER BY event_id)), lambda a, x: {_FOLD}), 'none') AS change FROM events GROUP BY user_id")
def _(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), F.element_at(F.array(F.lit("new"), F.lit("modified"), F.lit("deleted")), (F.col("event_id") % 3 + 1).cast("int")).alias("change"))
    return delta.merge_changes(e)


@query("A188_task_coalescing", "SELECT user_id AS path, max(event_id % 10) AS priority, max(event_id % 5) AS retries, CAST(CASE WHEN max(event_id % 5) > 0 THEN 1000 * pow(2, max(event_id % 5) - 1) ELSE 0 END AS BIGINT) AS backoff_ms, max(event_id % 5) > 3 AS dead FROM events GROUP BY user_id")
def _(spark, d):
    return delta.coalesce_tasks(read(spark, d, "events").select(F.col("user_id").alias("path"), (F.col("event_id") % 10).alias("priority"), (F.col("event_id") % 5).alias("retries")))


@query("A193_cache_eviction", "SELECT event_id FROM events WHERE value > 50 ORDER BY ts DESC, event_id LIMIT 1000")
def _(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("cache_key"), F.col("value").alias("expires_at"), F.col("ts").alias("accessed_at"))
    return delta.expire(e, 50.0, 1000).select(F.col("cache_key").alias("event_id"))


@query("A191_incremental_update", twin(f"WITH {_DIFF} SELECT path, new_hash AS hash FROM d WHERE change <> 'deleted'", "old_files", "new_files"))
def _(spark, d):
    changes = _changes(spark, d)
    current = read(spark, d, "old_files")
    merged = delta.upsert(current, changes.filter("change in ('new', 'modified')").select("path", F.col("new_hash").alias("hash")), ["path"])
    return delta.without(merged, changes.filter("change = 'deleted'"), ["path"])


@query("A73_distinct_counts", twin("SELECT worktree_id, count(DISTINCT chunk_id) AS chunks, count(DISTINCT blob_sha) AS blobs FROM junction j JOIN chunks c ON c.id = j.chunk_id GROUP BY worktree_id", "chunks", "junction"))
def _(spark, d):
    j = read(spark, d, "junction").join(read(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "blob_sha"), "chunk_id")
    return j.groupBy("worktree_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("blob_sha").alias("blobs"))


@query("A74_language_breakdown", "SELECT coalesce(nullif(lang, 'de'), 'unknown') AS language, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, language")
def _(spark, d):
    return read(spark, d, "documents").groupBy(F.coalesce(F.nullif("lang", F.lit("de")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


@query("A75_status_report", twin("SELECT worktree_id, count(*) AS chunks, round(100.0 * count(e.vec_id) / count(*), 4) AS percent, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM junction j JOIN chunks c ON c.id = j.chunk_id LEFT JOIN embeddings e ON e.vec_id = c.id GROUP BY worktree_id", "chunks", "junction"))
def _(spark, d):
    j = read(spark, d, "junction").join(read(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "language"), "chunk_id")
    rows = j.join(read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit(1).alias("has")), "chunk_id", "left")
    return rows.groupBy("worktree_id").agg(F.count("*").alias("chunks"), F.round(F.count("has") * 100.0 / F.count("*"), 4).alias("percent"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


@query("A77_A60_file_metadata", twin("SELECT file_id, count(*) AS chunks, count(*) FILTER (WHERE kind = 'func') AS funcs, max(recency_score) AS recency, max(end_line) AS lines FROM chunks GROUP BY file_id", "chunks"))
def _(spark, d):
    return read(spark, d, "chunks").groupBy("file_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("kind") == "func").alias("funcs"), F.max("recency_score").alias("recency"), F.max("end_line").alias("lines"))


@query("A78_test_links", twin("SELECT dst AS id, count(DISTINCT src) AS tests, string_agg(DISTINCT CAST(src AS VARCHAR), ',' ORDER BY CAST(src AS VARCHAR)) AS test_ids FROM edges WHERE type = 'test_of' GROUP BY dst", "edges"))
def _(spark, d):
    e = read(spark, d, "edges").filter("type = 'test_of'")
    return e.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("tests"), F.array_join(F.array_sort(F.collect_set(F.col("src").cast("string"))), ",").alias("test_ids"))


@query("A79_A207_cache_stats", "SELECT count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(*) FILTER (WHERE event_type = 'view') AS fresh, CASE WHEN count(*) FILTER (WHERE event_type = 'view') * 1.0 / count(*) >= 0.6 THEN 'good' ELSE 'low' END AS health FROM events")
def _(spark, d):
    hit = F.count_if(F.col("event_type") == "view")
    return read(spark, d, "events").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), hit.alias("fresh"), F.when(hit / F.count("*") >= 0.6, "good").otherwise("low").alias("health"))


@query("A81_select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("A82_encoding_progress", "SELECT user_id AS run_id, round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 4) AS percent, count(*) FILTER (WHERE event_type = 'error') AS remaining, round(count(*) FILTER (WHERE event_type <> 'error') / (epoch(max(ts)) - epoch(min(ts))), 8) AS rate FROM events GROUP BY user_id")
def _(spark, d):
    done = F.count_if(F.col("event_type") != "error")
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return read(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.round(done * 100.0 / F.count("*"), 4).alias("percent"), (F.count("*") - done).alias("remaining"), F.round(done / seconds, 8).alias("rate"))


@query("A83_cost_and_hit_rate", "SELECT lang, CAST(sum(CAST(ceil(strlen(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens, round(sum(CAST(ceil(strlen(text) / 4.0) AS BIGINT)) / 1000.0 * 0.02, 6)::DOUBLE AS cost, round(1 - count(DISTINCT text) * 1.0 / count(*), 6)::DOUBLE AS hit_rate FROM documents GROUP BY lang")
def _(spark, d):
    from loomery.functions import text as T

    tokens = F.sum(T.token_estimate(F.col("text")))
    return read(spark, d, "documents").groupBy("lang").agg(tokens.alias("tokens"), F.round(tokens / 1000.0 * 0.02, 6).alias("cost"), F.round(1 - F.countDistinct(F.sha2("text", 256)) / F.count("*"), 6).alias("hit_rate"))


@query("A53_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, d):
    big = read(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey")


@query("A54_A62_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("A51_vector_metadata_join", twin("SELECT e.vec_id, c.id, c.file_id FROM embeddings e JOIN chunks b ON b.id = e.vec_id JOIN chunks c ON c.blob_sha = b.blob_sha", "chunks"))
def _(spark, d):
    c = read(spark, d, "chunks")
    own = read(spark, d, "embeddings").select("vec_id").join(c.select(F.col("id").alias("vec_id"), "blob_sha"), "vec_id")
    return own.join(c.select("id", "file_id", "blob_sha"), "blob_sha").select("vec_id", "id", "file_id")


@query("A56_enclosing_chunk", twin("SELECT call_id, min(id) AS chunk_id FROM (SELECT x.id AS call_id, c.id FROM (SELECT id, file_id, start_line + 5 AS line FROM chunks) x JOIN chunks c ON c.file_id = x.file_id AND x.line BETWEEN c.start_line AND c.end_line) y GROUP BY call_id", "chunks"))
def _(spark, d):
    from loomery.operators.ingest import enclosing

    c = read(spark, d, "chunks")
    return enclosing(c.select(F.col("id").alias("call_id"), "file_id", (F.col("start_line") + 5).alias("line")), c)


@query("A61_symbol_resolution", twin("SELECT symbol_name, max(id) AS id, count(*) AS n FROM chunks WHERE symbol_name IS NOT NULL GROUP BY symbol_name HAVING count(*) > 1", "chunks"))
def _(spark, d):
    return read(spark, d, "chunks").filter("symbol_name IS NOT NULL").groupBy("symbol_name").agg(F.max("id").alias("id"), F.count("*").alias("n")).filter("n > 1")


@query("A59_search_view", twin("SELECT c.id, count(DISTINCT j.worktree_id) AS worktrees, count(DISTINCT e.src) AS in_degree FROM chunks c LEFT JOIN junction j ON j.chunk_id = c.id LEFT JOIN edges e ON e.dst = c.id GROUP BY c.id", "chunks", "junction", "edges"))
def _(spark, d):
    zero = F.lit(0)
    j = read(spark, d, "junction").groupBy(F.col("chunk_id").alias("id")).agg(F.countDistinct("worktree_id").alias("worktrees"))
    e = read(spark, d, "edges").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("in_degree"))
    return read(spark, d, "chunks").select("id").join(j, "id", "left").join(e, "id", "left").select("id", F.coalesce("worktrees", zero).alias("worktrees"), F.coalesce("in_degree", zero).alias("in_degree"))


@query("A109_ordered_sample", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(100)


@query("A111_union_all", twin("SELECT src AS id, 'out' AS direction FROM edges UNION ALL SELECT dst, 'in' FROM edges", "edges"))
def _(spark, d):
    e = read(spark, d, "edges")
    return e.select(F.col("src").alias("id"), F.lit("out").alias("direction")).unionAll(e.select(F.col("dst").alias("id"), F.lit("in").alias("direction")))
