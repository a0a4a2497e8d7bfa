"""Queries: query processing, maintenance, logs and the remaining graph-database operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators import cache, context, crdt, delta, fusion, ingest, markdown, migrate, search, views
from loomery.sources.durable import shared_folder
from loomery.sources.tables import DERIVED, read, twin
from loomery.streaming import state

from .catalog import query
from .ingestion import marked

#: A query for each document: from the first two words of three small letters or more, in six forms.
_FORMS = ("{0}", "{0}::{1}", "how {0} the {1}", "{0}_{1} {1}", "{0} {1}", " ! ")
_WORDS = "w AS (SELECT doc_id, doc_id % 6 AS form, coalesce(nullif(regexp_extract_all(text, '[a-z]{3,}')[1], ''), 'none') AS a, coalesce(nullif(regexp_extract_all(text, '[a-z]{3,}')[2], ''), 'none') AS b FROM documents), s AS (SELECT doc_id, form, a, b, CASE form " + " ".join(
    f"WHEN {k} THEN " + " || ".join(f"'{x}'" if x not in ("0", "1") else "ab"[int(x)] for x in f.replace("{", "|").replace("}", "|").split("|") if x) for k, f in enumerate(_FORMS)) + " END AS query FROM w)"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _asked(spark, d):
    words = F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))
    a, b = (F.coalesce(F.get(words, F.lit(k)), F.lit("none")) for k in (0, 1))
    form = F.lit(None)
    for k, f in enumerate(_FORMS):
        parts = [a if x == "0" else b if x == "1" else F.lit(x) for x in f.replace("{", "|").replace("}", "|").split("|") if x]
        form = F.when(F.col("doc_id") % 6 == k, F.concat(*parts)).otherwise(form)
    return read(spark, d, "documents").select("doc_id", form.alias("query"))


@query("A120_match_expression", f"WITH {_WORDS} SELECT doc_id, CASE form WHEN 0 THEN a || '*' WHEN 1 THEN a || '* OR ' || b || '*' WHEN 2 THEN 'how* OR ' || a || '* OR the* OR ' || b || '*' WHEN 3 THEN a || '_' || b || '* OR ' || b || '*' WHEN 4 THEN a || '* OR ' || b || '*' ELSE '' END AS match FROM s")
def _(spark, d):
    return _asked(spark, d).select("doc_id", T.match_of(F.col("query")).alias("match"))


@query("A144_A148_tokens", f"WITH {_WORDS}, t AS (SELECT doc_id, CASE form WHEN 0 THEN [a] WHEN 1 THEN [a, '::', b] WHEN 2 THEN ['how', a, 'the', b] WHEN 3 THEN [a || '_' || b, b] WHEN 4 THEN [a, b] ELSE [] END AS t FROM s) SELECT doc_id, array_to_string(list_filter(t, lambda x: x NOT IN ({_STOP})), ' & ') AS tsquery FROM t")
def _(spark, d):
    return _asked(spark, d).select("doc_id", F.array_join(T.tokens_of(F.col("query")), " & ").alias("tsquery"))


@query("A146_A147_mode", f"WITH {_WORDS} SELECT doc_id, ['code', 'code', 'text', 'code', 'auto', 'code'][form + 1] AS mode, form < 5 AS valid FROM s")
def _(spark, d):
    return _asked(spark, d).select("doc_id", T.mode_of(F.col("query")).alias("mode"), T.valid_of(F.col("query")).alias("valid"))


_REQUESTS = "r AS (SELECT p_partkey AS id, CAST(p_partkey % 5 AS DOUBLE) AS fts, CAST(p_partkey % 3 AS DOUBLE) AS vector, CAST(p_partkey % 2 AS DOUBLE) AS graph, CAST(p_partkey % 7 - 1 AS DOUBLE) AS signals FROM part)"


@query("A138_weights", f"""WITH {_REQUESTS}, v AS (SELECT *, least(fts, vector, graph, signals) >= 0 AND fts + vector + graph + signals > 0 AND fts + vector + signals > 0 AS valid FROM r)
SELECT id, valid, {', '.join(f"CASE WHEN valid THEN round({c} / (fts + vector + graph + signals), 6) END AS {c}, CASE WHEN valid THEN round({'0.2::DOUBLE' if c == 'graph' else f'{c} * 0.8::DOUBLE / (fts + vector + signals)'}, 6) END AS {c}_set" for c in ('fts', 'vector', 'graph', 'signals'))} FROM v""")
def _(spark, d):
    sources = ("fts", "vector", "graph", "signals")
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(k.alias("id"), *((v).cast("double").alias(c) for c, v in zip(sources, (k % 5, k % 3, k % 2, k % 7 - 1))))
    # a request that leaves nothing beside the graph can't be overridden
    rows = rows.withColumns({c: F.when(F.col("fts") + F.col("vector") + F.col("signals") > 0, F.col(c)) for c in sources})
    plain = fusion.scaled_weights(rows, sources).select("id", "valid", *(F.round(c, 6).alias(c) for c in sources))
    over = fusion.scaled_weights(rows, sources, 0.2).select("id", *(F.round(c, 6).alias(f"{c}_set") for c in sources))
    return plain.join(over, "id")


@query("A43_hash_fetch", twin("SELECT c.id, c.blob_sha FROM chunks c WHERE c.id IN (SELECT vec_id FROM embeddings)", "chunks"))
def _(spark, d):
    ids = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return read(spark, d, "chunks").join(ids, "id", "left_semi").select("id", "blob_sha")


@query("A94_neighbour_frame", "SELECT conv_id, turn, count(*) OVER w AS n, min(turn) OVER w AS first FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 2)
    return read(spark, d, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("n"), F.min("turn").over(w).alias("first"))


@query("A101_overfetch_then_cut", twin("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rn, score FROM (SELECT id, source, recency_score AS score FROM chunks ORDER BY recency_score DESC, id LIMIT 30) k) x WHERE rn = 1 ORDER BY score DESC, id LIMIT 10", "chunks"))
def _(spark, d):
    k = search.top(read(spark, d, "chunks").select("id", "source", F.col("recency_score").alias("score")), 30)
    return search.top(search.first_per_key(k, ["source"], F.desc("score"), F.asc("id")), 10).select("id")


@query("A115_term_set_operations", r"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(string_split_regex(lower(text), '\s+')), lambda x: x NOT IN ('the', 'of', 'and', 'a', 'to'))), ' ') AS terms FROM documents")
def _(spark, d):
    stop = F.array(*(F.lit(x) for x in ("the", "of", "and", "a", "to")))
    terms = F.array_except(F.split(F.lower("text"), r"\s+"), stop)
    return read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(terms), " ").alias("terms"))


_SNIPPETS = ("using System;", "import java.util.List;", "#include <x> namespace a", "class A < B end", "def f import os", "pub fn a()", "x: string", "const a = 1", "func a() package b", "plain words", "namespace a class B", "public class A")


@query("A202_context_language", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'rs' WHEN 1 THEN ['rs', 'rb', 'java', 'cpp', 'unknown'][doc_id % 5 + 1] ELSE ['cs', 'java', 'cpp', 'rb', 'py', 'rs', 'ts', 'js', 'go', 'unknown', 'cs', 'java'][doc_id % 12 + 1] END AS language FROM documents""")
def _(spark, d):
    def pick(values, k):
        return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % k + 1).cast("int"))

    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "src/a.rs").alias("path"), F.when(F.col("doc_id") % 3 == 1, pick(("impl", "module", "constructor", "namespace", "func"), 5)).alias("kind"), pick(_SNIPPETS, 12).alias("content"))
    by_content = F.when(F.col("kind").isNull(), T.language_of_content(F.col("content")))
    return rows.select("doc_id", F.coalesce(T.language(F.col("path")), T.language_of_kind(F.col("kind")), by_content, F.lit("unknown")).alias("language"))


@query("A209_dimension_filter", "SELECT len(embedding) AS dim, count(*) AS n FROM embeddings WHERE len(embedding) IN (64, 768, 1024, 1536) GROUP BY 1")
def _(spark, d):
    dim = F.size("embedding").cast("long")
    return read(spark, d, "embeddings").filter(dim.isin(64, 768, 1024, 1536)).groupBy(dim.alias("dim")).agg(F.count("*").alias("n"))


#: Batches of edges added and removed, some twice, some that aren't there.
DERIVED["edge_changes"] = """SELECT 0 AS batch, src, dst, 1 AS sign FROM {edges} UNION ALL SELECT 1 AS batch, src, dst, -1 AS sign FROM {edges} WHERE src % 3 = 0 AND type = 'calls'
    UNION ALL SELECT 1 AS batch, src, dst + 1 AS dst, 1 AS sign FROM {edges} WHERE src % 10 = 1 UNION ALL SELECT 2 AS batch, dst AS src, src AS dst, -1 AS sign FROM {edges} WHERE src % 2 = 0
    UNION ALL SELECT 3 AS batch, src, dst, 1 AS sign FROM {edges} WHERE src % 6 = 0"""
BATCHES = 4


def upkept(spark, d) -> views.DegreeView:
    """The view after all batches, compacted once on the way."""
    view, changes = views.DegreeView(spark, f"{shared_folder(spark)}/view", buckets=4), read(spark, d, "edge_changes")
    for n in range(BATCHES):
        view = view.apply(changes.filter(F.col("batch") == n).drop("batch"), 1000 * n)
        if n == 1:
            view = view.compact(1500)
    return views.DegreeView.open(spark, view.path, view.buckets)


# a batch takes away no more of a pair than there is
_UPKEPT = """k AS (SELECT batch, src, dst, sum(sign) AS d FROM edge_changes GROUP BY ALL), b AS (SELECT src, dst, sum(d) FILTER (batch = 0) AS b0, coalesce(sum(d) FILTER (batch = 1), 0) AS b1, coalesce(sum(d) FILTER (batch = 2), 0) AS b2, coalesce(sum(d) FILTER (batch = 3), 0) AS b3 FROM k GROUP BY src, dst),
p AS (SELECT src, dst FROM b WHERE greatest(greatest(greatest(coalesce(b0, 0) + b1, 0) + b2, 0) + b3, 0) > 0)"""


@query("A194_view_refresh", twin(f"WITH {_UPKEPT} SELECT coalesce(i.id, o.id) AS id, coalesce(n_in, 0) AS in_degree, coalesce(n_out, 0) AS out_degree FROM (SELECT dst AS id, count(*) AS n_in FROM p GROUP BY dst) i FULL JOIN (SELECT src AS id, count(*) AS n_out FROM p GROUP BY src) o ON i.id = o.id", "edges", "edge_changes"))
def _(spark, d):
    return upkept(spark, d).degrees()


@query("A194_view_staleness", "SELECT event_type AS view, max(epoch_ms(ts) // 1000) AS last_refresh, m.now - max(epoch_ms(ts) // 1000) AS age, m.now - max(epoch_ms(ts) // 1000) > 3600 AS is_stale FROM events, (SELECT max(epoch_ms(ts) // 1000) AS now FROM events) m GROUP BY event_type, m.now")
def _(spark, d):
    # a refresh is an event of its type; now is the time of the newest
    e = read(spark, d, "events").select(F.col("event_type").alias("view"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"))
    now = e.agg(F.max("at").alias("_now"))
    return views.staleness(e, "view", "at", F.lit(now.head()[0]), 3600)


@query("A210_rechunk", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE doc_id % 4 = 0),
h AS (SELECT doc_id, n, (n - 1) % 4 + 1 AS level, CAST(max(n) OVER (PARTITION BY doc_id) AS INTEGER) AS most FROM (SELECT doc_id, n, max(n) OVER (PARTITION BY doc_id) AS most FROM l) x WHERE (n - 1) % 3 = 0),
m AS (SELECT doc_id, max(n) AS most FROM l GROUP BY doc_id)
SELECT doc_id AS file_id, n AS start_line, coalesce((SELECT min(g.n) FROM h g WHERE g.doc_id = h.doc_id AND g.n > h.n AND g.level <= h.level) - 1, m.most) AS end_line FROM h JOIN m USING (doc_id)
UNION ALL SELECT doc_id, 1, 1 FROM documents WHERE doc_id % 4 <> 0""")
def _(spark, d):
    files = marked(spark, d).select(F.col("doc_id").alias("file_id"), "text")
    old = read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))

    def parse(some):
        return markdown.sections(some, "file_id").select("file_id", F.col("start").cast("int").alias("start_line"), F.col("end").alias("end_line"))

    after, stats = migrate.rechunk(old, files.filter("file_id % 4 = 0"), parse, shared_folder(spark))
    return after if not stats["rolled_back"] else after.filter("false")


@query("A192_incremental_files", twin("""WITH e AS (SELECT coalesce(n.path, o.path) AS path, n.hash, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'new' ELSE 'modified' END AS change, o.hash AS old,
  strlen(coalesce(n.path, o.path)) % 3 = 0 AS large FROM old_files o FULL JOIN new_files n ON n.path = o.path WHERE n.hash IS DISTINCT FROM o.hash)
SELECT path, hash FROM old_files WHERE path NOT IN (SELECT path FROM e) UNION ALL SELECT path, CASE WHEN large THEN old ELSE hash END FROM e WHERE change <> 'deleted' AND (NOT large OR old IS NOT NULL)""", "old_files", "new_files"))
def _(spark, d):
    where = shared_folder(spark)
    changed = delta.detect_changes(read(spark, d, "old_files"), read(spark, d, "new_files")).filter("change <> 'none'")
    size = F.when(F.length("path") % 3 == 0, delta.MOST_BYTES + 1).otherwise(1000)
    events = changed.select("path", "change", F.col("new_hash").alias("hash"), size.cast("long").alias("bytes"))
    events.repartition(2, "path").write.parquet(f"{where}/events")
    read(spark, d, "old_files").select("path", "hash").write.parquet(f"{where}/index0")
    done = []

    def apply(batch, number):
        # each batch writes the next version of the index from the one before; a batch that comes again writes it again
        now = spark.read.parquet(f"{where}/index{number}")
        delta.process_files(now, batch)[0].write.mode("overwrite").parquet(f"{where}/index{number + 1}")
        done.append(number)

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/events")
    state.run_batches(stream, apply, f"{where}/check")
    return spark.read.parquet(f"{where}/index{max(done, default=-1) + 1}")


_POLLS = "p AS (SELECT 0 AS poll, path, hash FROM old_files UNION ALL SELECT 1, path, hash FROM new_files UNION ALL SELECT 2, path, hash FROM new_files WHERE strlen(path) % 2 = 0)"


@query("A190_polled_changes", twin(f"WITH {_POLLS} SELECT b.poll + 1 AS poll, b.path, CASE WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM p b LEFT JOIN p a ON a.path = b.path AND a.poll = b.poll + 1 WHERE b.poll < 2 AND (a.path IS NULL OR a.hash <> b.hash) UNION ALL SELECT a.poll, a.path, 'new' FROM p a WHERE a.poll > 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.path = a.path AND b.poll = a.poll - 1)", "old_files", "new_files"))
def _(spark, d):
    old, new = (read(spark, d, t).select("path", "hash") for t in ("old_files", "new_files"))
    polls = old.withColumn("poll", F.lit(0)).unionByName(new.withColumn("poll", F.lit(1))).unionByName(new.filter(F.length("path") % 2 == 0).withColumn("poll", F.lit(2)))
    return delta.poll_changes(polls)


@query("A19_C65_event_log", "SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    where = shared_folder(spark)
    read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type")).write.parquet(f"{where}/in")
    stream = spark.readStream.schema("id long, type string").parquet(f"{where}/in")
    state.run_available(stream, "json", f"{where}/log", f"{where}/check")
    follow = spark.readStream.schema("id long, type string").json(f"{where}/log/*.json")
    state.run_available(follow, "parquet", f"{where}/seen", f"{where}/check2")
    return spark.read.parquet(f"{where}/seen").groupBy("type").agg(F.count("*").alias("n"))


@query("B75_subscription", twin("SELECT soul, key, max(state) AS state FROM cells WHERE soul IN ('1', '2', '3') GROUP BY soul, key", "cells"))
def _(spark, d):
    where = shared_folder(spark)
    own = read(spark, d, "cells").filter(F.col("soul").isin("1", "2", "3"))
    # a subscriber gets what there is, then every change that wins
    snapshot = crdt.ham(own.filter("event_id < 5000"))
    ops = own.filter("event_id >= 5000").drop("msg_id", "event_id")
    ops.write.parquet(f"{where}/ops")
    stream = spark.readStream.schema(ops.schema).parquet(f"{where}/ops")
    state.run_available(state.ham_stream(stream), "parquet", f"{where}/seen", f"{where}/check")
    cols = ops.columns
    heard = snapshot.select(cols).unionByName(spark.read.schema(ops.schema).parquet(f"{where}/seen").select(cols))
    return crdt.ham(heard).select("soul", "key", "state")


@query("B04_hydrate", twin("SELECT soul, key, max(state) AS state FROM cells GROUP BY soul, key", "cells"))
def _(spark, d):
    where = f"{shared_folder(spark)}/cells"
    crdt.ham(read(spark, d, "cells")).write.parquet(where)
    return crdt.ham(spark.read.parquet(where)).select("soul", "key", "state")


@query("B82_encrypt_round_trip", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    key = F.lit("0123456789abcdef").cast("binary")
    sealed = F.aes_encrypt(F.col("text").cast("binary"), key, F.lit("GCM"))
    opened = F.aes_decrypt(sealed, key, F.lit("GCM"))
    return read(spark, d, "documents").select("doc_id", F.sha2(opened, 256).alias("digest"))


@query("B83_namespace_filter", twin("SELECT soul, key FROM cells WHERE NOT (soul LIKE '1%' AND vtype = 'text') GROUP BY soul, key", "cells"))
def _(spark, d):
    signed = F.col("soul").startswith("1") & (F.col("vtype") == "text") & ~F.coalesce(F.col("v_text"), F.lit("")).startswith("SEA{")
    return read(spark, d, "cells").filter(~signed).select("soul", "key").distinct()


@query("B85_time_ids", "SELECT event_id, array_to_string(list_transform(range(7, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((CAST(floor(epoch(ts)) AS BIGINT) * 1000 // CAST(pow(36, i) AS BIGINT)) % 36 + 1 AS BIGINT), 1)), '') || left(sha256(CAST(event_id AS VARCHAR)), 12) AS uuid FROM events")
def _(spark, d):
    ms = (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).cast("string")
    return read(spark, d, "events").select("event_id", F.concat(F.lower(F.conv(ms, 10, 36)), F.left(F.sha2(F.col("event_id").cast("string"), 256), F.lit(12))).alias("uuid"))


@query("B90_alias_lookup", "SELECT c_name AS alias, c_custkey AS pub FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    users = read(spark, d, "customer").select(F.col("c_name").alias("alias"), F.col("c_custkey").alias("pub"))
    return users.join(read(spark, d, "orders").select(F.col("o_custkey").alias("pub")), "pub", "left_semi").select("alias", "pub")


@query("B81_disconnect_writes", twin("""WITH w AS (SELECT soul AS peer, event_id AS seq, CASE WHEN event_id % 10 = 0 THEN '~' || key ELSE key END AS target, key, row_number() OVER (PARTITION BY soul ORDER BY event_id) AS rn FROM cells),
g AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS peer FROM events WHERE event_type = 'error')
SELECT peer, count(*) AS n, min(seq) AS first, 7.0::DOUBLE AS state FROM w JOIN g USING (peer) WHERE rn <= 100 AND target NOT LIKE '~%' GROUP BY peer""", "cells"))
def _(spark, d):
    key = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("~"), "key")).otherwise(F.col("key"))
    writes = read(spark, d, "cells").select(F.col("soul").alias("peer"), F.col("event_id").alias("seq"), key.alias("soul"), "key", "vtype", "v_text", "v_num", "v_bool", "v_link")
    gone = read(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("peer"))
    return crdt.disconnect_writes(writes, gone, 7.0).groupBy("peer").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("state").alias("state"))


@query("C60_tool_log", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0")
def _(spark, d):
    line = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    got = F.from_json(line, "k long", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return read(spark, d, "events").select("event_id", got["k"].alias("k")).filter("k IS NOT NULL")


@query("C64_csv_rows", "SELECT concat(CAST(n_nationkey AS VARCHAR), ',', n_name, ',', CAST(n_regionkey AS VARCHAR)) AS value FROM nation")
def _(spark, d):
    return read(spark, d, "nation").select(F.to_csv(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("value"))


_TREE = (".gitignore", "src/a.rs", "src/b.tsx", "docs/c.mdx", "node_modules/d.js", "x/target/e.rs", "dist/f.py", "g.log", "Gemfile", "go.mod", "notes.txt", "secret/h.py", "lib/i.c++", "lib/j.py", "k.html")


@query("A01_source_tree", """SELECT t.relpath, t.language, sha256(CASE WHEN t.relpath = '.gitignore' THEN 'secret/' ELSE 'text of ' || t.relpath END) AS hash FROM
(VALUES ('src/a.rs', 'rs'), ('src/b.tsx', 'tsx'), ('docs/c.mdx', 'mdx'), ('Gemfile', 'rb'), ('go.mod', 'gomod'), ('lib/i.c++', 'cpp'), ('lib/j.py', 'py')) t(relpath, language)""")
def _(spark, d):
    root = f"{shared_folder(spark)}/tree"
    jvm = spark.sparkContext._jvm
    for name in _TREE:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(("secret/" if name == ".gitignore" else f"text of {name}").encode()))
        out.close()
    return ingest.scan(spark, root).select("relpath", "language", "hash")


_ERRORS = ("Query is empty or contains only whitespace", "Query is too long: 2000 characters", "search timed out after 5 s", "repository not found: x", "Embedding generation failed: rate limit", "database is locked", "connection refused", "something odd")


@query("A212_error_classes", "SELECT ['validation', 'validation', 'timeout', 'not_found', 'embedding_provider', 'database', 'database', 'unknown'][event_id % 8 + 1] AS class, count(*) AS n, count(*) AS advised FROM events GROUP BY 1")
def _(spark, d):
    message = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 8 + 1).cast("int"))
    rows = read(spark, d, "events").select(T.error_class(message).alias("e"))
    return rows.groupBy("e.class").agg(F.count("*").alias("n"), F.count("e.suggestion").alias("advised"))


@query("A63_candidate_join", twin("SELECT c.id, e.label FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.id WHERE c.id IN (SELECT id FROM chunks WHERE kind = 'func' UNION SELECT vec_id FROM embeddings WHERE label = 2)", "chunks"))
def _(spark, d):
    c, e = read(spark, d, "chunks"), read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    ids = c.filter("kind = 'func'").select("id").union(e.filter("label = 2").select("id")).distinct()
    return c.select("id").join(ids, "id", "left_semi").join(e, "id", "left")


@query("A206_layered_cache", """WITH e AS (SELECT ['query', 'embedding', 'context', 'parse'][user_id % 4 + 1] AS layer, event_type || (event_id % 40) AS key, max(event_id) AS stored FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY stored DESC, key) AS rn FROM e WHERE stored + (CASE layer WHEN 'query' THEN 1000 ELSE 1000000 END) > 5000),
l AS (SELECT * FROM y WHERE rn <= CASE layer WHEN 'query' THEN 20 ELSE 60 END),
r AS (SELECT ['query', 'embedding', 'context', 'parse'][user_id % 4 + 1] AS layer, event_type || (event_id % 40) AS key FROM events WHERE event_id % 2 = 1 OR event_id % 3 = 0)
SELECT r.layer, count(*) AS requests, count(l.key) AS hits, round(count(l.key) / count(*), 6) AS rate, count(l.key) / count(*) >= 0.6 AS healthy FROM r LEFT JOIN l ON l.layer = r.layer AND l.key = r.key GROUP BY r.layer""")
def _(spark, d):
    e = read(spark, d, "events")
    layer = F.element_at(F.array(*map(F.lit, cache.LAYERS)), (F.col("user_id") % 4 + 1).cast("int"))
    key = F.concat("event_type", (F.col("event_id") % 40).cast("string"))
    new = e.filter("event_id % 2 = 0").select(layer.alias("layer"), key.alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").cast("double").alias("stored_at"))
    ttl = {"query": 1000, "embedding": 10**6, "context": 10**6, "parse": 10**6}
    held = cache.live(cache.put(new.limit(0), new), 5000.0, ttl, {"query": 20, "embedding": 60, "context": 60, "parse": 60})
    asked = e.filter("event_id % 2 = 1 OR event_id % 3 = 0").select(F.col("event_id").alias("request"), layer.alias("layer"), key.alias("key"))
    return cache.rates(cache.lookup(asked, held)).withColumn("rate", F.round("rate", 6))


@query("A206_invalidation", "WITH e AS (SELECT event_type || (event_id % 40) AS key, CASE WHEN event_id % 2 = 0 THEN 'context' ELSE 'query' END AS layer FROM events) SELECT DISTINCT layer, key FROM e WHERE layer <> 'context' OR key NOT LIKE 'click%'")
def _(spark, d):
    e = read(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, "context").otherwise("query").alias("layer"), F.concat("event_type", (F.col("event_id") % 40).cast("string")).alias("key")).distinct()
    return cache.invalidate(e, e.filter(F.col("key").startswith("click")), ["context"])


@query("A206_warming", "SELECT event_type || (event_id % 40) AS key, count(*) AS n FROM events WHERE event_id % 40 >= 5 GROUP BY 1 ORDER BY n DESC, key LIMIT 12")
def _(spark, d):
    key = F.concat("event_type", (F.col("event_id") % 40).cast("string"))
    e = read(spark, d, "events")
    held = e.filter("event_id % 40 < 5").select(F.lit("query").alias("layer"), key.alias("key")).distinct()
    return cache.to_warm(e.select(key.alias("key")), held, "query", 12)


_CODE = """SELECT n_nationkey AS id, 'app/c' || n_nationkey || '.tsx' AS relpath, 'C' || n_nationkey AS symbol_name, 'component' AS kind, 'tsx' AS language, 'function C' || n_nationkey || '() { useH' || (n_nationkey % 3) || '(); return <C' || ((n_nationkey + 1) % 25) || ' /> }' AS text FROM nation
UNION ALL SELECT 100 + r_regionkey, 'app/h.tsx', 'useH' || r_regionkey, 'hook', 'tsx', 'const x = 1' FROM region
UNION ALL SELECT 200 + n_nationkey, 'crates/k' || (n_nationkey % 5) || '/src/s.rs', 'S' || n_nationkey, 'struct', 'rs', 'struct S' || n_nationkey || ';' FROM nation
UNION ALL SELECT 300 + n_nationkey, 'crates/z/src/i.rs', NULL, 'impl', 'rs', 'impl Show for S' || n_nationkey || ' {}' FROM nation
UNION ALL SELECT 400 + n_nationkey, 'py/p' || (n_nationkey % 5) || '/m.py', 'P' || n_nationkey, 'class', 'py', 'class P' || n_nationkey || '(P' || ((n_nationkey + 7) % 25) || '): pass' FROM nation"""
_FILES = """SELECT 1000 + r_regionkey AS id, 'crates/k' || r_regionkey || '/Cargo.toml' AS relpath FROM region UNION ALL SELECT 1010, 'Cargo.toml' UNION ALL SELECT 1020 + r_regionkey, 'crates/k' || r_regionkey || '/src/lib.rs' FROM region
UNION ALL SELECT 1030 + r_regionkey, 'py/p' || r_regionkey || '/__init__.py' FROM region UNION ALL SELECT 1040, 'pyproject.toml'"""


@query("A170_language_context", """SELECT n_nationkey AS id, 'hook' AS role, 100 + n_nationkey % 3 AS other FROM nation
UNION ALL SELECT n_nationkey, 'jsx_child', (n_nationkey + 1) % 25 FROM nation UNION ALL SELECT (n_nationkey + 1) % 25, 'jsx_parent', n_nationkey FROM nation
UNION ALL SELECT 200 + n_nationkey, 'trait_impl', 300 + n_nationkey FROM nation UNION ALL SELECT 200 + n_nationkey, 'manifest', 1000 + n_nationkey % 5 FROM nation UNION ALL SELECT 300 + n_nationkey, 'manifest', 1010 FROM nation
UNION ALL SELECT 200 + n_nationkey, 'module', 1020 + n_nationkey % 5 FROM nation UNION ALL SELECT 400 + n_nationkey, 'init', 1030 + n_nationkey % 5 FROM nation
UNION ALL SELECT 400 + n_nationkey, 'dependencies', 1040 FROM nation UNION ALL SELECT 400 + n_nationkey, 'parent_class', 400 + (n_nationkey + 7) % 25 FROM nation""")
def _(spark, d):
    chunks = spark.sql(_CODE.replace("{", "{{").replace("}", "}}").replace("FROM nation", "FROM {nation}").replace("FROM region", "FROM {region}"), nation=read(spark, d, "nation"), region=read(spark, d, "region"))
    files = spark.sql(_FILES.replace("FROM region", "FROM {region}"), region=read(spark, d, "region"))
    return context.by_language(chunks, files).select(F.col("id").cast("long").alias("id"), "role", F.col("other").cast("long").alias("other"))
