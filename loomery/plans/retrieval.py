"""Queries: search, ranking, fusion and graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.functions import vectors as V
from loomery.operators import fusion, graph, search
from loomery.operators.segments import PostingsIndex
from loomery.sources.durable import drop_folder, shared_folder
from loomery.sources.tables import read, twin

from .catalog import query

ASKED = "the er on"

_W = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_BM25 = f"""t AS (SELECT doc_id AS id, {_W} AS w FROM documents),
c AS (SELECT id, CAST(len(w) AS DOUBLE) AS dl, {', '.join(f"CAST(len(list_filter(w, lambda x: starts_with(x, '{p}'))) AS DOUBLE) AS tf{i}" for i, p in enumerate(ASKED.split()))} FROM t),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {', '.join(f"CAST(count(*) FILTER (WHERE tf{i} > 0) AS DOUBLE) AS n{i}" for i in range(3))} FROM c),
fts AS (SELECT id, {' + '.join(f"CASE WHEN tf{i} > 0 THEN greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(3))} AS score
  FROM c, s WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0)"""
_L2 = "sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) * (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)))))"
_KNN = f"near AS (SELECT e.vec_id AS id, e.label, {_L2} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


#: The index of each application's tables, with the state of the files that it was built from.
_INDEXES: dict[tuple, tuple] = {}


def index_of(spark, d) -> PostingsIndex:
    """The documents' index, written for the present state of their files and read by every search after; that of an earlier state goes."""
    docs = read(spark, d, "documents")
    state = docs.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct().agg(F.count("*"), F.max("file_modification_time"), F.sum("file_size")).head()
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES or _INDEXES[key][0] != state:
        if key in _INDEXES:
            drop_folder(spark, _INDEXES[key][1].path)
        _INDEXES[key] = (state, PostingsIndex(spark, f"{shared_folder(spark)}/postings", ("text",)).build(docs, "doc_id"))
    return _INDEXES[key][1]


def _fts(spark, d):
    return index_of(spark, d).bm25(ASKED)


def asked_vector(spark, d):
    return read(spark, d, "embeddings").filter("vec_id = 0").select("embedding").head()[0]


def _near(spark, d, k):
    return search.knn(read(spark, d, "embeddings"), asked_vector(spark, d), k)


@query("A102_knn_top_k", f"WITH {_KNN} SELECT id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM near ORDER BY near.distance, id LIMIT 10")
def _(spark, d):
    return _near(spark, d, 10).select(F.col("vec_id").alias("id"), F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query("A34_similarity_threshold", f"WITH {_KNN} SELECT id, round(1 / (1 + distance), 6) AS similarity FROM near WHERE 1 / (1 + distance) >= 0.45")
def _(spark, d):
    q = F.array(*(F.lit(float(x)) for x in asked_vector(spark, d)))
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.similarity(V.l2(F.col("embedding"), q)).alias("score"))
    return search.scoped(rows, least=0.45).select("id", F.round("score", 6).alias("similarity"))


@query("A126_knn_prefilter", f"WITH {_KNN} SELECT id, round(distance, 6) AS distance FROM near WHERE label = 3 ORDER BY near.distance, id LIMIT 20")
def _(spark, d):
    return search.knn(read(spark, d, "embeddings"), asked_vector(spark, d), 20, F.col("label") == 3).select(F.col("vec_id").alias("id"), F.round("distance", 6).alias("distance"))


@query("A126_knn_postfilter", f"WITH {_KNN}, k AS (SELECT * FROM near ORDER BY distance, id LIMIT 50) SELECT id, round(distance, 6) AS distance FROM k WHERE label = 3")
def _(spark, d):
    return search.knn(read(spark, d, "embeddings"), asked_vector(spark, d), 50, F.col("label") == 3, prefilter=False).select(F.col("vec_id").alias("id"), F.round("distance", 6).alias("distance"))


@query("A121_bm25", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM fts")
def _(spark, d):
    return _fts(spark, d).select("id", F.round("score", 6).alias("score"))


_POSTINGS = f"WITH t AS (SELECT doc_id AS id, {_W} AS w FROM documents), u AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM t) SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM u GROUP BY term, id"


@query("A121_index_build", _POSTINGS)
def _(spark, d):
    # the rows as stored; the index is written by whichever search comes first
    return index_of(spark, d).rows()


@query("A121_bm25_scanned", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM fts")
def _(spark, d):
    return search.bm25(read(spark, d, "documents").withColumnRenamed("doc_id", "id"), ASKED, fields=("text",)).select("id", F.round("score", 6).alias("score"))


@query("A123_ts_rank", f"""WITH t AS (SELECT doc_id AS id, unnest({_W}) AS term FROM documents), c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
h AS (SELECT id, list_sum(list_transform(range(1, least(tf, 255) + 1), lambda k: 1.0::DOUBLE / (k * k))) AS places FROM c, (VALUES ('the'), ('er'), ('on')) p(prefix) WHERE starts_with(term, prefix))
SELECT id, round(sum(places) * 0.1::DOUBLE / 1.64493406685::DOUBLE / 3, 6) AS score FROM h GROUP BY id""")
def _(spark, d):
    return index_of(spark, d).ts_rank(ASKED).select("id", F.round("score", 6).alias("score"))


@query("A57_edge_self_join", twin("SELECT a.src AS id, count(*) AS walks, count(DISTINCT b.dst) AS reached FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'calls' AND b.type = 'calls' GROUP BY a.src", "edges"))
def _(spark, d):
    e = read(spark, d, "edges").filter("type = 'calls'")
    second = e.select(F.col("src").alias("_mid"), F.col("dst").alias("_end"))
    return e.join(second, F.col("dst") == F.col("_mid")).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("walks"), F.countDistinct("_end").alias("reached"))


@query("A50_postings", _POSTINGS)
def _(spark, d):
    return search.postings(read(spark, d, "documents"), "doc_id", ("text",))


@query("A76_match_count", f"WITH {_BM25} SELECT count(DISTINCT id) AS total FROM fts")
def _(spark, d):
    return _fts(spark, d).agg(F.countDistinct("id").alias("total"))


@query("A100_order_limit", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM fts ORDER BY fts.score DESC, id LIMIT 25")
def _(spark, d):
    return search.top(_fts(spark, d), 25).select("id", F.round("score", 6).alias("score"))


@query("A90_fts_position", f"WITH {_BM25}, k AS (SELECT * FROM fts ORDER BY score DESC, id LIMIT 30) SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS position FROM k")
def _(spark, d):
    return search.ranked(search.top(_fts(spark, d), 30), out="position", base=0).select("id", "position")


@query("A91_source_rank", f"WITH {_KNN}, k AS (SELECT * FROM near ORDER BY distance, id LIMIT 30) SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM k")
def _(spark, d):
    return search.ranked(_near(spark, d, 30).select(F.col("vec_id").alias("id"), "similarity"), "similarity").select("id", "rank")


_TWO = f"""{_BM25}, {_KNN}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT * FROM fts ORDER BY score DESC, id LIMIT 60) x),
b AS (SELECT id, row_number() OVER (ORDER BY distance, id) - 1 AS rank FROM (SELECT * FROM near ORDER BY distance, id LIMIT 60) x)"""


def _two(spark, d):
    a = search.ranked(search.top(_fts(spark, d), 60), base=0).select("id", "rank")
    b = search.ranked(_near(spark, d, 60).select(F.col("vec_id").alias("id"), "similarity"), "similarity", base=0).select("id", "rank")
    return a, b


_RRF = f"""{_TWO}, rrf AS (SELECT coalesce(a.id, b.id) AS id, coalesce(0.3 / (60 + a.rank), 0) + coalesce(0.7 / (60 + b.rank), 0) AS score,
  CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN a.id IS NOT NULL THEN 'fts' ELSE 'vector' END AS source FROM a FULL JOIN b ON a.id = b.id)"""


@query("A127_weighted_rrf", f"WITH {_RRF} SELECT id, round(score, 9) AS score, source FROM rrf")
def _(spark, d):
    return fusion.rrf_weighted(*_two(spark, d)).select("id", F.round("score", 9).alias("score"), "source")


@query("A137_rrf", f"WITH {_TWO} SELECT id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY id")
def _(spark, d):
    return fusion.rrf(_two(spark, d)).select("id", F.round("score", 9).alias("score"))


@query("A55_full_outer_ranks", f"WITH {_TWO} SELECT coalesce(a.id, b.id) AS id, a.rank AS fts_rank, b.rank AS vector_rank FROM a FULL JOIN b ON a.id = b.id")
def _(spark, d):
    a, b = _two(spark, d)
    return a.select("id", F.col("rank").alias("fts_rank")).join(b.select("id", F.col("rank").alias("vector_rank")), "id", "full")


@query("A110_union_candidates", f"WITH {_TWO} SELECT id FROM a UNION SELECT id FROM b")
def _(spark, d):
    a, b = _two(spark, d)
    return a.select("id").union(b.select("id")).distinct()


@query("A112_intersect_except", f"WITH {_TWO} SELECT id, 'both' AS side FROM (SELECT id FROM a INTERSECT SELECT id FROM b) x UNION ALL SELECT id, 'old' AS side FROM (SELECT id FROM a EXCEPT SELECT id FROM b) y")
def _(spark, d):
    a, b = (x.select("id") for x in _two(spark, d))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("old")))


_NORM = r"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z])([A-Z])', '\1_\2', 'g'), '([0-9])([A-Z])', '\1_\2', 'g'), '[\s\-.]+', '_', 'g')), '_+', '_', 'g'), '^_|_$', '', 'g')"
_KIND = "CASE WHEN kind IN ('function', 'method') THEN 1.2 WHEN kind IN ('class', 'struct', 'interface', 'trait') THEN 1.1 WHEN kind = 'constant' THEN 0.9 WHEN kind = 'variable' THEN 0.8 WHEN kind = 'import' THEN 0.7 ELSE 1.0 END"
_RANKED = f"{_RRF}, r AS (SELECT rrf.id, c.symbol_name, c.kind, c.relpath, c.start_line, score * {_KIND} * CASE WHEN contains(coalesce({_NORM.format(x='c.symbol_name')}, ''), 'the') THEN 1.5 ELSE 1.0 END * (1.0 + 0.1 * recency_score) AS score FROM rrf JOIN chunks c ON c.id = rrf.id)"


def _reranked(spark, d):
    return fusion.rerank(fusion.rrf_weighted(*_two(spark, d)).join(read(spark, d, "chunks"), "id"), "the")


@query("A129_semantic_rerank", twin(f"WITH {_RANKED} SELECT id, round(score, 9) AS score FROM r", "chunks"))
def _(spark, d):
    return _reranked(spark, d).select("id", F.round("score", 9).alias("score"))


@query("A130_ranked_hybrid", twin(f"WITH {_RANKED} SELECT id, kind, relpath, round(score, 9) AS score FROM r ORDER BY r.score DESC, id LIMIT 10", "chunks"))
def ranked_hybrid(spark, d):
    return search.top(_reranked(spark, d), 10).select("id", "kind", "relpath", F.round("score", 9).alias("score"))


@query("A128_hybrid_search", twin(f"WITH {_RRF} SELECT rrf.id, rrf.source, kind, relpath, round(score, 9) AS score FROM rrf JOIN chunks c ON c.id = rrf.id ORDER BY rrf.score DESC, rrf.id LIMIT 20", "chunks"))
def _(spark, d):
    fused = fusion.rrf_weighted(*_two(spark, d)).withColumnRenamed("source", "found_by")
    rows = fused.join(read(spark, d, "chunks"), "id")
    return search.top(rows, 20).select("id", F.col("found_by").alias("source"), "kind", "relpath", F.round("score", 9).alias("score"))


@query("A125_normalise_identifier", twin(f"SELECT id, {_NORM.format(x='symbol_name')} AS name FROM chunks WHERE symbol_name IS NOT NULL", "chunks"))
def _(spark, d):
    return read(spark, d, "chunks").filter("symbol_name IS NOT NULL").select("id", T.normalise_identifier(F.col("symbol_name")).alias("name"))


@query("A124_exact_multiplier", twin(f"SELECT id, CASE WHEN {_NORM.format(x='symbol_name')} = 'the' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS exact_mult FROM chunks", "chunks"))
def _(spark, d):
    return read(spark, d, "chunks").select("id", search.exact_multiplier(F.col("symbol_name"), "The").alias("exact_mult"))


@query("A122_normalised_rank", f"WITH {_BM25} SELECT id, round(1 / (1 + abs(-score)), 9) AS score FROM fts")
def _(spark, d):
    return _fts(spark, d).select("id", F.round(search.normalised_rank(-F.col("score")), 9).alias("score"))


@query("A30_A31_scope_filters", twin("SELECT id, kind, language FROM chunks WHERE kind IN ('func', 'class') AND language IN ('en', 'de')", "chunks"))
def _(spark, d):
    return search.scoped(read(spark, d, "chunks"), ["func", "class"], ["en", "de"]).select("id", "kind", "language")


@query("A33_worktree_scope", twin("SELECT id FROM chunks WHERE id IN (SELECT chunk_id FROM junction WHERE worktree_id = 1)", "chunks", "junction"))
def _(spark, d):
    j = read(spark, d, "junction").filter("worktree_id = 1").select(F.col("chunk_id").alias("id"))
    return read(spark, d, "chunks").join(j, "id", "left_semi").select("id")


@query("A32_repo_resolution", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_name = 'NATION_3' OR (n_name LIKE '%/NATION_3' AND NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'NATION_3'))")
def _(spark, d):
    return search.resolve_repo(read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "NATION_3")


_TEST = r"regexp_matches(relpath, '(?is)/tests?/|/__tests__/|\.test\.[jt]sx?|\.spec\.[jt]s|test\.(rs|py)')"
_PATHS = "p AS (SELECT id, kind, concat(CASE id % 4 WHEN 0 THEN 'a/tests/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'a/Test/' ELSE 'src/' END, CASE id % 9 WHEN 0 THEN 'x.test.tsx' WHEN 1 THEN 'x.spec.js' WHEN 2 THEN 'x_test.py' WHEN 3 THEN 'x_test.go' WHEN 4 THEN 'test_x.py' WHEN 5 THEN 'x.spec.jsx' WHEN 6 THEN 'tsconfig.json' WHEN 7 THEN 'vite.config.ts' ELSE 'data.json' END) AS relpath FROM chunks)"


def _paths(spark, d):
    return spark.sql(_PATHS[len("p AS (") : -1].replace("FROM chunks", "FROM {chunks}"), chunks=read(spark, d, "chunks"))


@query("A35_test_predicate", twin(f"WITH {_PATHS} SELECT id, (contains(kind, 'test') OR id % 4 IN (0, 2) OR id % 9 IN (0, 1, 2, 5)) AS is_test FROM p", "chunks"))
def _(spark, d):
    return _paths(spark, d).select("id", search.is_test(F.col("relpath"), F.col("kind")).alias("is_test"))


@query("A36_file_class", twin(f"WITH {_PATHS} SELECT id, CASE WHEN id % 4 IN (0, 1) OR id % 9 IN (0, 1, 2, 3, 5) THEN 'test' WHEN id % 9 IN (6, 7) THEN 'config' ELSE 'regular' END AS class FROM p", "chunks"))
def _(spark, d):
    return _paths(spark, d).select("id", T.file_class(F.col("relpath")).alias("class"))


@query("A37_optional_parameter", twin("SELECT count(*) AS n FROM junction WHERE NULL IS NULL OR worktree_id = NULL", "junction"))
def _(spark, d):
    worktree = None
    j = read(spark, d, "junction")
    return (j if worktree is None else j.filter(F.col("worktree_id") == worktree)).agg(F.count("*").alias("n"))


@query("A38_symbol_lookup", twin("SELECT symbol_name, max(id) AS id FROM chunks WHERE symbol_name IS NOT NULL GROUP BY symbol_name", "chunks"))
def _(spark, d):
    return read(spark, d, "chunks").filter("symbol_name IS NOT NULL").groupBy("symbol_name").agg(F.max("id").alias("id"))


@query("A39_chunks_of_file", twin("SELECT id, start_line FROM chunks WHERE file_id = 7 ORDER BY start_line, id", "chunks"))
def _(spark, d):
    return read(spark, d, "chunks").filter("file_id = 7").orderBy("start_line", "id").select("id", "start_line")


@query("A40_surrounding", "WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) SELECT a.turn + 100000 * a.conv_id AS id, b.turn + 100000 * b.conv_id AS neighbour, b.rn - a.rn AS position FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.rn <> b.rn AND abs(b.rn - a.rn) <= 2")
def _(spark, d):
    c = read(spark, d, "conversations").withColumn("id", F.col("turn") + 100000 * F.col("conv_id"))
    return search.neighbours(c, "conv_id", ["turn"], "id", 2)


@query("A41_first_file_by_hash", twin("SELECT blob_sha, min(id) AS id, count(*) AS n FROM chunks GROUP BY blob_sha", "chunks"))
def _(spark, d):
    return read(spark, d, "chunks").groupBy("blob_sha").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("A42_metadata_fetch", twin(f"WITH {_TWO} SELECT chunks.id, kind, relpath FROM chunks WHERE chunks.id IN (SELECT id FROM a)", "chunks"))
def _(spark, d):
    a, _b = _two(spark, d)
    return read(spark, d, "chunks").join(F.broadcast(a.select("id")), "id", "left_semi").select("id", "kind", "relpath")


@query("A44_ordered_listing", "SELECT n_nationkey AS id, n_name AS name FROM nation ORDER BY n_name")
def _(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).orderBy("name")


@query("A45_latest_run", "SELECT event_id, user_id FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 1")
def _(spark, d):
    return read(spark, d, "events").filter("event_type = 'view'").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id")


@query("A52_left_edge_counts", twin("SELECT c.id, coalesce(callers, 0) AS callers, coalesce(importers, 0) AS importers, coalesce(tests, 0) AS tests FROM chunks c LEFT JOIN (SELECT dst, count(*) FILTER (WHERE type = 'calls') AS callers, count(*) FILTER (WHERE type = 'imports') AS importers, count(*) FILTER (WHERE type = 'test_of') AS tests FROM edges GROUP BY dst) e ON e.dst = c.id", "chunks", "edges"))
def _(spark, d):
    zero = F.lit(0)
    return read(spark, d, "chunks").select("id").join(fusion.edge_counts(read(spark, d, "edges")), "id", "left").select("id", *(F.coalesce(c, zero).alias(c) for c in ("callers", "importers", "tests")))


@query("A70_edge_counts", twin("SELECT dst AS id, sum(CASE WHEN type = 'calls' THEN 1 ELSE 0 END)::BIGINT AS callers, sum(CASE WHEN type = 'imports' THEN 1 ELSE 0 END)::BIGINT AS importers, sum(CASE WHEN type = 'test_of' THEN 1 ELSE 0 END)::BIGINT AS tests FROM edges GROUP BY dst", "edges"))
def _(spark, d):
    return fusion.edge_counts(read(spark, d, "edges"))


@query("A71_counts_both_ways", twin("SELECT id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, sum(ci)::BIGINT AS calls_in, sum(co)::BIGINT AS calls_out FROM (SELECT dst AS id, 1 AS i, 0 AS o, CASE WHEN type = 'calls' THEN 1 ELSE 0 END AS ci, 0 AS co FROM edges UNION ALL SELECT src, 0, 1, 0, CASE WHEN type = 'calls' THEN 1 ELSE 0 END FROM edges) x GROUP BY id", "edges"))
def _(spark, d):
    e = read(spark, d, "edges")
    sides = e.select(F.col("dst").alias("id"), "type", F.lit(True).alias("i")).unionByName(e.select(F.col("src").alias("id"), "type", F.lit(False).alias("i")))
    call = F.col("type") == "calls"
    return sides.groupBy("id").agg(F.count_if("i").alias("n_in"), F.count_if(~F.col("i")).alias("n_out"), F.count_if(F.col("i") & call).alias("calls_in"), F.count_if(~F.col("i") & call).alias("calls_out"))


@query("A131_graph_importance", twin("SELECT c.id, round(0.3 * ln(2.0 + coalesce(a, 0)) + 0.2 * ln(2.0 + coalesce(b, 0)) + 0.1 * ln(2.0 + coalesce(t, 0)), 6) AS score FROM chunks c LEFT JOIN (SELECT dst, count(*) FILTER (WHERE type = 'calls') AS a, count(*) FILTER (WHERE type = 'imports') AS b, count(*) FILTER (WHERE type = 'test_of') AS t FROM edges GROUP BY dst) e ON e.dst = c.id", "chunks", "edges"))
def _(spark, d):
    return fusion.graph_importance(read(spark, d, "chunks"), read(spark, d, "edges")).select("id", F.round("score", 6).alias("score"))


@query("A133_importance_of_ids", twin("SELECT c.id, round(0.3 * ln(2.0 + coalesce(a, 0)) + 0.2 * ln(2.0 + coalesce(b, 0)) + 0.1 * ln(2.0 + coalesce(t, 0)), 6) AS score FROM (SELECT id FROM chunks WHERE kind = 'func') c LEFT JOIN (SELECT dst, count(*) FILTER (WHERE type = 'calls') AS a, count(*) FILTER (WHERE type = 'imports') AS b, count(*) FILTER (WHERE type = 'test_of') AS t FROM edges GROUP BY dst) e ON e.dst = c.id", "chunks", "edges"))
def _(spark, d):
    ids = read(spark, d, "chunks").filter("kind = 'func'").select("id")
    own = read(spark, d, "edges").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return fusion.graph_importance(ids, own).select("id", F.round("score", 6).alias("score"))


_QUALITY = f"SELECT e.dst AS id, sum(CASE WHEN contains(kind, 'test') OR {_TEST} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS q FROM edges e JOIN chunks s ON s.id = e.src GROUP BY e.dst"


@query("A132_quality_importance", twin(f"SELECT c.id, round(ln(2.0 + coalesce(q, 0)), 6) AS score FROM chunks c LEFT JOIN ({_QUALITY}) x ON x.id = c.id", "chunks", "edges"))
def _(spark, d):
    c = read(spark, d, "chunks")
    return fusion.quality_importance(c, read(spark, d, "edges"), c.select("id", search.is_test(F.col("relpath"), F.col("kind")).alias("is_test"))).select("id", F.round("score", 6).alias("score"))


@query("A72_quality_sum", twin(f"SELECT id, round(q, 6) AS q FROM ({_QUALITY}) x", "chunks", "edges"))
def _(spark, d):
    from_test = read(spark, d, "chunks").select("id", search.is_test(F.col("relpath"), F.col("kind")).alias("is_test"))
    return fusion.quality_sums(read(spark, d, "edges"), from_test).select("id", F.round("q", 6).alias("q"))


@query("A134_signal_score", twin("SELECT id, round(recency_score * 0.3::DOUBLE + churn_score * 0.2::DOUBLE, 6) AS score FROM chunks ORDER BY recency_score * 0.3::DOUBLE + churn_score * 0.2::DOUBLE DESC, id LIMIT 1000", "chunks"))
def _(spark, d):
    rows = read(spark, d, "chunks").select("id", fusion.signal_score(F.col("recency_score"), F.col("churn_score")).alias("score"))
    return search.top(rows, 1000).select("id", F.round("score", 6).alias("score"))


_DEG = "(SELECT dst AS id, count(DISTINCT src) AS n FROM edges GROUP BY dst)"


@query("A135_chunk_importance", twin(f"SELECT c.id, round(coalesce(n, 0) * 0.4::DOUBLE + recency_score * 0.3::DOUBLE + 0.3::DOUBLE / (1 + churn_score), 6) AS importance FROM chunks c LEFT JOIN {_DEG} e ON e.id = c.id", "chunks", "edges"))
def _(spark, d):
    return fusion.chunk_importance(read(spark, d, "chunks"), read(spark, d, "edges")).select("id", F.round("importance", 6).alias("importance"))


@query("A58_degrees", twin("SELECT coalesce(i.id, o.id) AS id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM (SELECT dst AS id, count(DISTINCT src) AS n FROM edges GROUP BY dst) i FULL JOIN (SELECT src AS id, count(DISTINCT dst) AS n FROM edges GROUP BY src) o ON i.id = o.id", "edges"))
def _(spark, d):
    return fusion.degrees(read(spark, d, "edges"))


_FUSED = f"""{_BM25}, {_KNN}, f AS (SELECT id, 0.4 * score AS s FROM fts UNION ALL SELECT id, 0.35 / (1 + distance) FROM near UNION ALL
SELECT id, 0.1 * (0.3 * ln(2.0 + count(*) FILTER (WHERE type = 'calls')) + 0.2 * ln(2.0 + count(*) FILTER (WHERE type = 'imports')) + 0.1 * ln(2.0 + count(*) FILTER (WHERE type = 'test_of'))) FROM (SELECT c.id, e.type FROM chunks c LEFT JOIN edges e ON e.dst = c.id) z GROUP BY id
UNION ALL SELECT id, 0.15::DOUBLE * (recency_score * 0.3::DOUBLE + churn_score * 0.2::DOUBLE) FROM chunks)"""


def _fused(spark, d):
    c = read(spark, d, "chunks")
    near = _near(spark, d, 1_000_000).select(F.col("vec_id").alias("id"), F.col("similarity").alias("score"))
    sources = {"fts": _fts(spark, d), "vector": near, "graph": fusion.graph_importance(c, read(spark, d, "edges")), "signals": c.select("id", fusion.signal_score(F.col("recency_score"), F.col("churn_score")).alias("score"))}
    return fusion.weighted(sources)


@query("A136_weighted_fusion", twin(f"WITH {_FUSED} SELECT id, round(sum(s), 6) AS score, count(*) AS source_count FROM f GROUP BY id", "chunks", "edges"))
def _(spark, d):
    return _fused(spark, d).select("id", F.round("score", 6).alias("score"), "source_count")


@query("A139_score_breakdown", twin(f"WITH {_FUSED}, g AS (SELECT id, sum(s) AS t FROM f GROUP BY id) SELECT fts.id, round(0.4 * fts.score / t * 100, 4) AS fts_percent FROM fts JOIN g ON g.id = fts.id", "chunks", "edges"))
def _(spark, d):
    rows = _fused(spark, d).withColumn("b", fusion.breakdown(F.col("parts"), F.col("score")))
    return rows.filter(F.map_contains_key("b", "fts")).select("id", F.round(F.col("b")["fts"], 4).alias("fts_percent"))


@query("A113_multi_source_union", twin(f"WITH {_FUSED} SELECT id, count(*) AS sources FROM f GROUP BY id HAVING count(*) >= 3", "chunks", "edges"))
def _(spark, d):
    return _fused(spark, d).filter("source_count >= 3").select("id", F.col("source_count").alias("sources"))


@query("A114_distinct_over_sources", f"WITH {_TWO} SELECT count(DISTINCT id) AS n FROM (SELECT id FROM a UNION ALL SELECT id FROM b) u")
def _(spark, d):
    a, b = _two(spark, d)
    return a.select("id").union(b.select("id")).agg(F.countDistinct("id").alias("n"))


_SCORED = "s AS (SELECT *, round(recency_score * 0.3::DOUBLE + churn_score * 0.2::DOUBLE, 6) AS score FROM chunks)"


def _scored(spark, d):
    return read(spark, d, "chunks").withColumn("score", F.round(fusion.signal_score(F.col("recency_score"), F.col("churn_score")), 6))


@query("A93_A140_dedup", twin(f"WITH {_SCORED} SELECT id, score FROM (SELECT id, score, row_number() OVER (PARTITION BY source, coalesce(symbol_name, '') ORDER BY score DESC, id) AS rn FROM s) x WHERE rn = 1", "chunks"))
def _(spark, d):
    rows = _scored(spark, d).withColumn("relpath", F.col("source")).withColumn("start_line", F.lit(0))
    return fusion.dedup(rows).select("id", "score")


@query("A93_dedup_null_symbol", twin(f"WITH {_SCORED} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source, symbol_name ORDER BY score DESC, id) AS rn FROM s) x WHERE rn = 1", "chunks"))
def _(spark, d):
    rows = _scored(spark, d).withColumn("relpath", F.col("source")).withColumn("start_line", F.lit(0))
    return fusion.dedup(rows, distinct_null=True).select("id")


@query("A92_A141_confidence", twin(f"WITH {_RANKED}, k AS (SELECT * FROM r ORDER BY score DESC, id LIMIT 40) SELECT id, round(coalesce(score - lead(score) OVER (ORDER BY score DESC, id), 0), 9) AS score_gap, (CASE WHEN {_NORM.format(x='symbol_name')} = 'the' THEN 3.0 ELSE 1.0 END) >= 2.9 AS is_exact FROM k", "chunks"))
def _(spark, d):
    rows = search.top(_reranked(spark, d), 40).withColumn("exact_mult", search.exact_multiplier(F.col("symbol_name"), "the"))
    return fusion.confidence(rows).select("id", F.round("score_gap", 9).alias("score_gap"), "is_exact")


@query("A80_A95_distinct_on", twin("SELECT blob_sha, id FROM (SELECT blob_sha, id, row_number() OVER (PARTITION BY blob_sha ORDER BY recency_score DESC, id) AS rn FROM chunks) x WHERE rn = 1", "chunks"))
def _(spark, d):
    return search.first_per_key(read(spark, d, "chunks"), ["blob_sha"], F.desc("recency_score"), F.asc("id")).select("blob_sha", "id")


_N = "list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"


@query("A149_quantise", "WITH q AS (SELECT vec_id AS id, embedding, list_transform(embedding, lambda x: greatest(-127.0::DOUBLE, least(127.0::DOUBLE, round(CAST(x AS DOUBLE) * 127))) / 127) AS z FROM embeddings), g AS (SELECT id, list_transform(range(1, len(z) + 1), lambda i: abs(CAST(embedding[i] AS DOUBLE) - z[i])) AS g FROM q) SELECT id, round(list_max(g), 6) AS max_error, round(list_avg(g), 6) AS mean_error, round(sqrt(list_avg(list_transform(g, lambda x: x * x))), 6) AS rmse FROM g")
def _(spark, d):
    e = V.errors(F.col("embedding"), V.dequantise(V.quantise(F.col("embedding"))))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e.alias("e")).select("id", *(F.round(f"e.{c}", 6).alias(c) for c in ("max_error", "mean_error", "rmse")))


@query("A149_cosine", f"WITH a AS (SELECT *, {_N} AS n FROM embeddings) SELECT e.vec_id AS id, round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))) / (sqrt(e.n) * sqrt(q.n)), 6) AS cosine FROM a e, (SELECT * FROM a WHERE vec_id = 0) q")
def _(spark, d):
    q = F.array(*(F.lit(float(x)) for x in asked_vector(spark, d)))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(V.cosine(F.col("embedding"), q), 6).alias("cosine"))


@query("A150_lexical_semantic", twin(f"WITH {_BM25}, {_KNN}, l AS (SELECT * FROM fts ORDER BY score DESC, id LIMIT 50), v AS (SELECT *, 1 / (1 + distance) AS sim FROM near ORDER BY distance, id LIMIT 50) SELECT c.id, round(0.55 * coalesce(l.score, 0) + 0.30 * coalesce(v.sim, 0) + 0.03 * recency_score + 0.02 / (1 + churn_score), 6) AS score FROM chunks c LEFT JOIN l ON l.id = c.id LEFT JOIN v ON v.id = c.id WHERE c.id IN (SELECT id FROM l UNION SELECT id FROM v)", "chunks"))
def _(spark, d):
    lex = search.top(_fts(spark, d), 50).select("id", F.col("score").alias("ls"))
    sem = _near(spark, d, 50).select(F.col("vec_id").alias("id"), F.col("similarity").alias("sim"))
    both = lex.join(sem, "id", "full").join(read(spark, d, "chunks"), "id")
    return both.select("id", F.round(fusion.lexical_semantic(F.col("ls"), F.col("sim"), F.lit(None).cast("double"), F.col("recency_score"), F.col("churn_score")), 6).alias("score"))


def _walk(types: str, reverse: bool, depth: int = 3) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges WHERE type IN ({types})),
    walk AS (SELECT a AS seed, b AS id, 1 AS depth, [b] AS path FROM e UNION ALL
    SELECT w.seed, e.b, w.depth + 1, list_append(w.path, e.b) FROM walk w JOIN e ON e.a = w.id WHERE w.depth < {depth} AND NOT list_contains(w.path, e.b))
    SELECT seed, id, depth, list_aggregate(path, 'string_agg', '/') AS path FROM walk"""


def _walk_query(spark, d, types, reverse):
    c = read(spark, d, "chunks").select("id")
    return graph.paths(read(spark, d, "edges"), c, types, 3, reverse).select("seed", "id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


for _name, _types, _back in (("A160_callers", ["calls"], True), ("A161_callees", ["calls"], False), ("A162_imports_in", ["imports"], True), ("A162_imports_out", ["imports"], False), ("A163_extends_in", ["extends"], True), ("A163_extends_out", ["extends"], False), ("A165_traverse_edges", ["calls", "imports"], False)):
    query(_name, twin(_walk(", ".join(f"'{t}'" for t in _types), _back), "edges"))(lambda spark, d, t=_types, b=_back: _walk_query(spark, d, t, b))


@query("A160_recursive_cte", twin(f"SELECT id, depth, path FROM ({_walk(chr(39) + 'calls' + chr(39), False)}) x WHERE seed = 1".replace("WITH RECURSIVE", "WITH RECURSIVE", 1), "edges"))
def _(spark, d):
    rows = graph.paths_recursive(spark, read(spark, d, "edges"), 1, "calls", 3)
    return rows.select("id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query("A164_direct_edges", twin("SELECT src AS id, dst AS neighbour, type, 'out' AS direction FROM edges WHERE src IN (SELECT id FROM chunks WHERE kind = 'func') UNION ALL SELECT dst, src, type, 'in' FROM edges WHERE dst IN (SELECT id FROM chunks WHERE kind = 'func')", "chunks", "edges"))
def _(spark, d):
    return graph.direct(read(spark, d, "edges"), read(spark, d, "chunks").filter("kind = 'func'"))


_REL = "SELECT seed, id, direction, round(pow(0.7, min(depth)), 6) AS relevance FROM (SELECT seed, id, depth, 'out' AS direction FROM ({a}) x UNION ALL SELECT seed, id, depth, 'in' FROM ({b}) y) z GROUP BY seed, id, direction"


@query("A166_related", twin(_REL.format(a=_walk("'calls', 'imports'", False, 2), b=_walk("'calls', 'imports'", True, 2)), "edges"))
def _(spark, d):
    return graph.related(read(spark, d, "edges"), read(spark, d, "chunks"), ["calls", "imports"], 2).select("seed", "id", "direction", F.round("relevance", 6).alias("relevance"))


@query("A167_decay_top20", twin(f"SELECT seed, id, relevance FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY relevance DESC, id) AS rn FROM (SELECT seed, id, max(relevance) AS relevance FROM ({_REL.format(a=_walk(chr(39) + 'calls' + chr(39), False, 2), b=_walk(chr(39) + 'calls' + chr(39), True, 2))}) w GROUP BY seed, id) v) u WHERE rn <= 20", "edges"))
def _(spark, d):
    rows = graph.related(read(spark, d, "edges"), read(spark, d, "chunks"), ["calls"], 2).groupBy("seed", "id").agg(F.round(F.max("relevance"), 6).alias("relevance"))
    w = Window.partitionBy("seed").orderBy(F.desc("relevance"), F.asc("id"))
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 20").drop("rn")


@query("A168_A169_relations", twin("SELECT dst AS id, type, count(*) AS n, min(src) AS first FROM edges GROUP BY dst, type", "edges"))
def _(spark, d):
    return read(spark, d, "edges").groupBy(F.col("dst").alias("id"), "type").agg(F.count("*").alias("n"), F.min("src").alias("first"))


_RELATED = "CASE c.kind WHEN 'func' THEN 2.5 WHEN 'class' THEN 2.0 WHEN 'method' THEN 2.2 WHEN 'variable' THEN 0.6 WHEN 'heading_1' THEN 0.6 ELSE 1.0 END"


@query("A142_expand_related", twin(f"SELECT seed, id, round(relevance, 6) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY relevance DESC, id) AS rn FROM (SELECT w.seed, w.id, pow(0.7, w.depth) * ({_RELATED})::DOUBLE * CASE WHEN s.source = c.source THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS relevance FROM (SELECT seed, id, min(depth) AS depth FROM ({_walk(chr(39) + 'calls' + chr(39), False, 2)}) x GROUP BY seed, id) w JOIN chunks s ON s.id = w.seed JOIN chunks c ON c.id = w.id) y) z WHERE rn <= 5", "chunks", "edges"))
def _(spark, d):
    c = read(spark, d, "chunks")
    near = graph.depths(read(spark, d, "edges"), c, ["calls"], 2)
    rows = near.join(c.select("id", "kind", "source"), "id").join(c.select(F.col("id").alias("seed"), F.col("source").alias("own")), "seed")
    out = graph.expand_related(rows, fusion.by_value(fusion.RELATED_WEIGHTS, F.col("kind")), F.col("source") == F.col("own"))
    return out.select("seed", "id", F.round("relevance", 6).alias("relevance"))


@query("A143_context_importance", twin(f"SELECT e.src, e.dst, round(greatest(0, least(100, 50 * 0.8 * 0.7 * greatest(c.recency_score, 0.1) * greatest(0.5, 0.1) * greatest(1 / (1 + c.churn_score), 0.1) * CASE WHEN s.source = c.source THEN 1.3 ELSE 1.0 END * CASE WHEN c.kind LIKE '%test%' THEN 1.5 ELSE 1.0 END)), 6) AS score FROM edges e JOIN chunks s ON s.id = e.src JOIN chunks c ON c.id = e.dst", "chunks", "edges"))
def _(spark, d):
    c = read(spark, d, "chunks")
    rows = read(spark, d, "edges").join(c.select(F.col("id").alias("src"), F.col("source").alias("own")), "src").join(c.withColumnRenamed("id", "dst"), "dst")
    kind = F.when(F.col("kind").like("%test%"), "test").otherwise("regular")
    score = fusion.context_importance(F.lit(50.0), F.lit(0.8), F.lit(1), F.lit(0.5), F.col("recency_score"), F.col("churn_score"), F.col("source") == F.col("own"), kind)
    return rows.select("src", "dst", F.round(score, 6).alias("score"))
