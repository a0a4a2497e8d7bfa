"""Queries: property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import crdt, wire
from loomery.sources.tables import read, twin

from .catalog import query

_CANON = """CASE vtype WHEN 'text' THEN concat('"', v_text, '"') WHEN 'num' THEN CAST(CAST(v_num AS BIGINT) AS VARCHAR) WHEN 'link' THEN concat('{"#":"', v_link, '"}') ELSE 'null' END"""
_HAM = f"m AS (SELECT * FROM (SELECT *, {_CANON} AS canon, row_number() OVER (PARTITION BY soul, key ORDER BY state DESC, strlen({_CANON}) DESC, {_CANON} DESC) AS rn FROM cells) x WHERE rn = 1)"


def _merged(spark, d):
    return crdt.ham(read(spark, d, "cells"))


@query("B70_ham_merge", twin(f"WITH {_HAM} SELECT soul, key, canon, state FROM m", "cells"))
def _(spark, d):
    return _merged(spark, d).select("soul", "key", crdt.canonical().alias("canon"), "state")


@query("B71_drift_gate", twin(f"WITH c AS (SELECT * FROM cells WHERE state <= 500 + 100), n AS (SELECT *, {_CANON} AS canon, row_number() OVER (PARTITION BY soul, key ORDER BY state DESC, strlen({_CANON}) DESC, {_CANON} DESC) AS rn FROM c) SELECT soul, key, canon, state FROM n WHERE rn = 1", "cells"))
def _(spark, d):
    return crdt.ham(read(spark, d, "cells"), 500.0, 100.0).select("soul", "key", crdt.canonical().alias("canon"), "state")


@query("B71_deferred", twin("SELECT msg_id, state FROM cells WHERE state > 500 + 100", "cells"))
def _(spark, d):
    return crdt.deferred(read(spark, d, "cells"), 500.0, 100.0).select("msg_id", "state")


_STEP = "x AS (SELECT *, strlen(c) AS l, lag(state) OVER w AS ps, lag(c) OVER w AS pc FROM (SELECT *, {0} AS c FROM cells) y WINDOW w AS (PARTITION BY soul, key ORDER BY event_id))".replace("{0}", _CANON)


@query("B72_put_outcomes", twin(f"WITH {_STEP} SELECT msg_id, CASE WHEN state > 900 THEN 'future' WHEN ps IS NULL OR state > ps THEN 'accept' WHEN state < ps THEN 'old' WHEN c = pc OR l < strlen(pc) OR (l = strlen(pc) AND c <= pc) THEN 'same' ELSE 'accept' END AS outcome FROM x", "cells"))
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("soul", "key").orderBy("event_id")
    x = read(spark, d, "cells").withColumn("c", crdt.canonical())
    x = x.withColumn("ps", F.lag("state").over(w)).withColumn("pc", F.lag("c").over(w))
    out = crdt.ham_outcome(F.col("state"), F.octet_length("c"), F.col("c"), F.col("ps"), F.octet_length("pc"), F.col("pc"), 900.0)
    return x.select("msg_id", out.alias("outcome"))


@query("B10_follow_links", twin(f"WITH {_HAM} SELECT a.soul AS root, b.canon FROM m a JOIN m b ON a.v_link = b.soul AND b.key = 'view0' WHERE a.vtype = 'link' AND a.key = 'click2'", "cells"))
def _(spark, d):
    cells = _merged(spark, d)
    return crdt.follow(cells, cells.select("soul").distinct(), ["click2", "view0"]).select("root", crdt.canonical().alias("canon"))


@query("B13_path_segments", twin(f"WITH {_HAM} SELECT soul AS root, canon FROM m WHERE key = 'view1'", "cells"))
def _(spark, d):
    cells = _merged(spark, d)
    return crdt.follow(cells, cells.select("soul").distinct(), "..view1.".split(".")).select("root", crdt.canonical().alias("canon"))


@query("B11_B12_node_data", twin(f"WITH {_HAM} SELECT soul, string_agg(key || '=' || canon, ';' ORDER BY key) AS data FROM m WHERE vtype <> 'null' GROUP BY soul", "cells"))
def _(spark, d):
    data = F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return crdt.nodes(_merged(spark, d)).select("soul", data.alias("data"))


for _name, _args, _sql in (
    ("B14_lex_exact", {"exact": "view1"}, "key = 'view1'"),
    ("B14_lex_prefix", {"prefix": "cl"}, "starts_with(key, 'cl')"),
    ("B14_lex_range", {"gte": "click1", "lte": "purchase0"}, "key = 'click1' OR starts_with(key, 'click1') OR key BETWEEN 'click1' AND 'purchase0'"),
    ("B14_lex_gte", {"gte": "purchase1"}, "key >= 'purchase1'"),
    ("B14_lex_lte", {"lte": "error1"}, "key <= 'error1'"),
    ("B14_lex_quirk", {"gte": "view", "lte": "error1"}, "starts_with(key, 'view') OR (key >= 'view' AND key <= 'error1')"),
):

    @query(_name, twin(f"WITH {_HAM} SELECT soul, key FROM m WHERE {_sql}", "cells"))
    def _(spark, d, a=_args):
        return _merged(spark, d).filter(crdt.lex(F.col("key"), **a)).select("soul", "key")


@query("B15_lex_limit_reverse", twin(f"WITH {_HAM} SELECT soul, key FROM (SELECT soul, key, row_number() OVER (PARTITION BY soul ORDER BY key DESC) AS r2 FROM m WHERE starts_with(key, 'c')) x WHERE r2 <= 2", "cells"))
def _(spark, d):
    return crdt.lex_page(_merged(spark, d), crdt.lex(F.col("key"), prefix="c"), 2, reverse=True).select("soul", "key")


@query("B16_map_keys", twin(f"WITH {_HAM} SELECT soul, key, state FROM m WHERE starts_with(key, 'view') AND vtype <> 'null'", "cells"))
def _(spark, d):
    return _merged(spark, d).filter(crdt.lex(F.col("key"), prefix="view") & (F.col("vtype") != "null")).select("soul", "key", "state")


@query("B17_absent", twin(f"WITH {_HAM} SELECT DISTINCT soul FROM m WHERE soul NOT IN (SELECT soul FROM m WHERE key = 'view2' AND vtype <> 'null')", "cells"))
def _(spark, d):
    cells = _merged(spark, d)
    return crdt.absent(cells.select("soul").distinct(), cells, "view2")


@query("B18_B20_prefix_scan", twin(f"WITH {_HAM} SELECT soul || chr(27) || key AS k FROM m WHERE starts_with(soul || chr(27) || key, '12')", "cells"))
def _(spark, d):
    k = crdt.storage_key(F.col("soul"), F.col("key"))
    return _merged(spark, d).select(k.alias("k")).filter(crdt.prefix_range(F.col("k"), "12"))


@query("B19_radix_range", twin(f"WITH {_HAM} SELECT soul || chr(27) || key AS k FROM m WHERE soul || chr(27) || key BETWEEN '1' AND '3' ORDER BY k DESC", "cells"))
def _(spark, d):
    return _merged(spark, d).select(crdt.storage_key(F.col("soul"), F.col("key")).alias("k")).filter(F.col("k").between("1", "3")).orderBy(F.desc("k"))


@query("B30_link_join", twin(f"WITH {_HAM} SELECT a.soul, a.key, b.key AS target_key FROM m a JOIN m b ON a.v_link = b.soul WHERE a.vtype = 'link'", "cells"))
def _(spark, d):
    cells = _merged(spark, d)
    a, b = cells.filter("vtype = 'link'").select("soul", "key", "v_link"), cells.select(F.col("soul").alias("v_link"), F.col("key").alias("target_key"))
    return a.join(b, "v_link").select("soul", "key", "target_key")


@query("B40_totals", twin(f"WITH {_HAM} SELECT count(DISTINCT soul) AS nodes, count(*) AS keys, count(*) FILTER (WHERE vtype = 'null') AS tombstones FROM m", "cells"))
def _(spark, d):
    return _merged(spark, d).agg(F.countDistinct("soul").alias("nodes"), F.count("*").alias("keys"), F.count_if(F.col("vtype") == "null").alias("tombstones"))


@query("B50_set_members", twin(f"WITH {_HAM} SELECT soul, count(*) AS members FROM m WHERE vtype = 'link' GROUP BY soul", "cells"))
def _(spark, d):
    return _merged(spark, d).filter("vtype = 'link'").groupBy("soul").agg(F.count("*").alias("members"))


@query("B60_documents", twin(f"""WITH {_HAM}, d AS (SELECT soul, '{{' || string_agg('"' || key || '":' || canon, ',' ORDER BY '"' || key || '":' || canon) || '}}' AS document FROM m WHERE vtype <> 'null' GROUP BY soul),
v AS (SELECT m.soul, '"' || m.key || '":' || CASE WHEN m.v_link IS NOT NULL AND m.v_link <> m.soul AND d.document IS NOT NULL THEN d.document ELSE canon END AS part FROM m LEFT JOIN d ON d.soul = m.v_link WHERE m.vtype <> 'null')
SELECT soul, '{{' || string_agg(part, ',' ORDER BY part) || '}}' AS document FROM v GROUP BY soul""", "cells"))
def _(spark, d):
    cells = _merged(spark, d)
    return crdt.documents(cells, cells.select("soul").distinct(), 2)


@query("B60_document_depth_one", twin(f"WITH {_HAM} SELECT soul, '{{' || string_agg('\"' || key || '\":' || canon, ',' ORDER BY '\"' || key || '\":' || canon) || '}}' AS document FROM m WHERE vtype <> 'null' GROUP BY soul", "cells"))
def _(spark, d):
    cells = _merged(spark, d)
    return crdt.documents(cells, cells.select("soul").distinct(), 1)


@query("B61_reachable", twin(f"WITH RECURSIVE {_HAM}, l AS (SELECT DISTINCT soul AS src, v_link AS dst FROM m WHERE vtype = 'link'), r AS (SELECT DISTINCT soul AS seed, soul AS id FROM m UNION SELECT r.seed, l.dst FROM r JOIN l ON l.src = r.id) SELECT seed, count(*) AS n FROM r GROUP BY seed", "cells"))
def _(spark, d):
    from loomery.operators import graph

    cells = _merged(spark, d)
    links = cells.filter("vtype = 'link'").select(F.col("soul").alias("src"), F.col("v_link").alias("dst"))
    return graph.reachable(links, cells.select(F.col("soul").alias("id")).distinct()).groupBy("seed").agg(F.count("*").alias("n"))


@query("B73_message_dedup", twin("SELECT msg_id, state FROM (SELECT *, lag(state) OVER (PARTITION BY CAST(event_id % 100 AS VARCHAR) ORDER BY state, soul, key) AS p FROM cells) x WHERE p IS NULL OR state - p >= 20", "cells"))
def _(spark, d):
    c = read(spark, d, "cells").withColumnRenamed("msg_id", "own").withColumn("msg_id", (F.col("event_id") % 100).cast("string"))
    return crdt.dedup_messages(c, 20.0).select(F.col("own").alias("msg_id"), "state")


@query("B74_content_dedup", twin(f"SELECT soul, key, {_CANON} AS canon, min(event_id) AS first FROM cells GROUP BY ALL", "cells"))
def _(spark, d):
    return read(spark, d, "cells").withColumn("canon", crdt.canonical()).groupBy("soul", "key", "canon").agg(F.min("event_id").alias("first"))


@query("B77_event_tags", twin("SELECT tag, count(*) AS n FROM (SELECT 'put' AS tag FROM cells UNION ALL SELECT soul FROM cells UNION ALL SELECT soul || chr(27) || key FROM cells) x GROUP BY tag", "cells"))
def _(spark, d):
    tags = F.array(F.lit("put"), F.col("soul"), crdt.storage_key(F.col("soul"), F.col("key")))
    return read(spark, d, "cells").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("B78_lru_eviction", twin("WITH a AS (SELECT soul, max(event_id) AS last FROM cells GROUP BY soul), f AS (SELECT soul, row_number() OVER (ORDER BY last, soul) AS rn FROM a WHERE soul NOT IN (SELECT soul FROM cells WHERE v_text = 'v0')) SELECT soul FROM f WHERE (SELECT count(*) FROM a) > 40 AND rn <= 4", "cells"))
def _(spark, d):
    c = read(spark, d, "cells")
    return crdt.evict(c.groupBy("soul").agg(F.max("event_id").alias("last")), 40, c.filter("v_text = 'v0'").select("soul").distinct())


@query("B79_clock", "SELECT event_id, round(floor(epoch(ts)) * 1000 + (row_number() OVER (PARTITION BY floor(epoch(ts)) ORDER BY event_id) - 1) / 999.0::DOUBLE, 6) AS state FROM events")
def _(spark, d):
    ms = (F.floor(F.unix_timestamp("ts")) * 1000).cast("double")
    return read(spark, d, "events").select("event_id", F.round(crdt.clock(ms, [F.col("event_id")]), 6).alias("state"))


@query("B80_routing", twin("SELECT DISTINCT msg_id, p.peer FROM cells c JOIN (SELECT DISTINCT soul, CAST(event_id % 4 AS VARCHAR) AS peer FROM cells) p ON p.soul = c.soul WHERE p.peer <> CAST(c.event_id % 4 AS VARCHAR) AND p.peer <> CAST(c.event_id % 3 AS VARCHAR)", "cells"))
def _(spark, d):
    c = read(spark, d, "cells")
    subscriptions = c.select("soul", (F.col("event_id") % 4).cast("string").alias("peer")).distinct()
    ops = c.select("soul", "msg_id", (F.col("event_id") % 4).cast("string").alias("origin"), F.array((F.col("event_id") % 3).cast("string")).alias("seen_by"))
    return crdt.route(ops, subscriptions)


@query("B84_certificates", twin("SELECT event_id, (event_id % 7 = 0 OR event_id % 1000 > 500) AND (soul = '3' OR event_id % 2 = 0) AND (starts_with(key, 'view') OR event_id % 3 = 0) AS allowed FROM cells", "cells"))
def _(spark, d):
    e = F.col("event_id")
    who = F.when(e % 2 == 0, "*").otherwise("3")
    what = F.when(e % 3 == 0, "*").otherwise("view*")
    expires = F.when(e % 7 == 0, F.lit(None).cast("double")).otherwise((e % 1000).cast("double"))
    return read(spark, d, "cells").select("event_id", crdt.may(who, F.col("soul"), what, F.col("key"), expires, 500.0).alias("allowed"))


@query("B01_kv_scan", twin(f"WITH {_HAM} SELECT soul || chr(27) || key AS k, canon AS v, state FROM m", "cells"))
def _(spark, d):
    return _merged(spark, d).select(crdt.storage_key(F.col("soul"), F.col("key")).alias("k"), crdt.canonical().alias("v"), "state")


@query("B03_last_write_wins", twin(f"SELECT soul || chr(27) || key AS k, max(event_id) AS event_id FROM cells GROUP BY 1", "cells"))
def _(spark, d):
    k = crdt.storage_key(F.col("soul"), F.col("key"))
    return read(spark, d, "cells").groupBy(k.alias("k")).agg(F.max("event_id").alias("event_id"))


@query("B05_wire_round_trip", twin(f"WITH {_HAM} SELECT soul, key, vtype, canon, state FROM m", "cells"))
def _(spark, d):
    sent = wire.encode(_merged(spark, d))
    heard = wire.decode(sent, "soul", "json").drop("id")
    return heard.select("soul", "key", "vtype", crdt.canonical().alias("canon"), "state")


@query("B05_wire_rejects", """SELECT user_id AS id, 'a' AS soul, 'k' AS key, 'num' AS vtype FROM events WHERE event_id % 6 = 0
UNION ALL SELECT user_id, 'a', 'k', 'link' FROM events WHERE event_id % 6 = 1 UNION ALL SELECT user_id, 'b', 'k', 'text' FROM events WHERE event_id % 6 = 2""")
def _(spark, d):
    kinds = (
        '{"a":{"_":{"#":"a",">":{"k":1}},"k":2.5,"bad":[1]}}',
        '{"a":{"_":{"#":"a",">":{"k":1}},"k":{"#":"b"},"bad":{"x":1}}}',
        '{"a":{"_":{"#":"other",">":{"k":1}},"k":"x"},"b":{"_":{"#":"b",">":{"k":1}},"k":"y"}}',
        "not json",
        '{"a":{"k":"no metadata"}}',
        "[]",
    )
    text = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 6 + 1).cast("int"))
    events = read(spark, d, "events")
    heard = wire.decode(events.select("event_id", text.alias("json")), "event_id", "json")
    return heard.join(events.select(F.col("event_id").alias("id"), "user_id"), "id").select(F.col("user_id").alias("id"), "soul", "key", "vtype")


@query("B91_peer_health", "SELECT user_id AS peer, count(*) FILTER (WHERE event_type = 'view') AS sent, count(*) FILTER (WHERE event_type = 'click') AS received, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'error') > 40 AS stale FROM events GROUP BY user_id")
def _(spark, d):
    def n(kind: str):
        return F.count_if(F.col("event_type") == kind)

    return read(spark, d, "events").groupBy(F.col("user_id").alias("peer")).agg(n("view").alias("sent"), n("click").alias("received"), n("error").alias("failed"), (n("error") > 40).alias("stale"))
