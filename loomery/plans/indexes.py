"""Queries: near neighbours by an inverted file, and a text index that follows changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import ivf
from loomery.operators.segments import PostingsIndex
from loomery.sources.durable import drop_folder, shared_folder
from loomery.sources.tables import DERIVED, read, twin

from .catalog import query
from .retrieval import _BM25, _KNN, _L2, ASKED, asked_vector

DIM = 64

#: The vector index of each application's tables, with the state of the files that it was built from.
_VECTORS: dict[tuple, tuple] = {}


def vectors_of(spark, d) -> ivf.VectorIndex:
    """The embeddings' index, written for the present state of their files and read by every search after."""
    rows = read(spark, d, "embeddings")
    state = rows.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct().agg(F.count("*"), F.max("file_modification_time"), F.sum("file_size")).head()
    key = (spark.sparkContext.applicationId, d)
    if key not in _VECTORS or _VECTORS[key][0] != state:
        if key in _VECTORS:
            drop_folder(spark, _VECTORS[key][1])
        path = f"{shared_folder(spark)}/vectors"
        _VECTORS[key] = (state, path, ivf.build(rows, path, DIM))
    return _VECTORS[key][2]


def _found(near):
    return near.select(F.col("vec_id").alias("id"), F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query("A102_ivf_build", "SELECT label, count(*) AS n, count(DISTINCT vec_id) AS ids FROM embeddings GROUP BY label")
def _(spark, d):
    # every row is in one cell
    return vectors_of(spark, d).rows.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"))


@query("A102_ivf_exact", f"WITH {_KNN} SELECT id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM near ORDER BY near.distance, id LIMIT 10")
def _(spark, d):
    return _found(ivf.search(vectors_of(spark, d), asked_vector(spark, d), 10, exact=True))


@query("A102_ivf_all_probes", f"WITH {_KNN} SELECT id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM near ORDER BY near.distance, id LIMIT 10")
def _(spark, d):
    index = vectors_of(spark, d)
    return _found(ivf.search(index, asked_vector(spark, d), 10, probes=len(index.centres)))


@query("A126_ivf_prefilter", f"WITH {_KNN} SELECT id, round(distance, 6) AS distance FROM near WHERE label = 3 ORDER BY near.distance, id LIMIT 20")
def _(spark, d):
    return _found(ivf.search(vectors_of(spark, d), asked_vector(spark, d), 20, keep=F.col("label") == 3, exact=True)).drop("similarity")


_ASKING = "SELECT vec_id AS query_id, embedding FROM {embeddings} WHERE vec_id % 100 = 0"


@query("A102_ivf_many", f"""WITH near AS (SELECT q.vec_id AS query, e.vec_id AS id, {_L2} AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM near) SELECT query, id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def _(spark, d):
    index = vectors_of(spark, d)
    asking = spark.sql(_ASKING, embeddings=read(spark, d, "embeddings"))
    return ivf.search_many(index, asking, 10, len(index.centres)).select("query", "id", F.round("distance", 6).alias("distance"), "rank")


@query("A102_ivf_recall", "SELECT count(*) AS queries, 10 * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def _(spark, d):
    # the default probes; enough: at least 0.95 of the ten nearest
    found = ivf.recall(vectors_of(spark, d), spark.sql(_ASKING, embeddings=read(spark, d, "embeddings")), 10)
    return found.select("queries", "wanted", (F.col("found") >= 0.95 * F.col("wanted")).alias("enough"))


#: Batches of changes to documents: inserts, updates, deletes, rows that come back, two changes to one row in a batch.
DERIVED["doc_changes"] = """SELECT 0 AS batch, doc_id AS id, 'put' AS op, 1 AS seq, text FROM {documents} WHERE doc_id % 5 <> 4
    UNION ALL SELECT 1 AS batch, doc_id AS id, 'put' AS op, 1 AS seq, concat(lang, ' the on ', text) AS text FROM {documents} WHERE doc_id % 5 = 1
    UNION ALL SELECT 1 AS batch, doc_id AS id, 'delete' AS op, 2 AS seq, CAST(NULL AS STRING) AS text FROM {documents} WHERE doc_id % 7 = 0
    UNION ALL SELECT 2 AS batch, doc_id AS id, 'put' AS op, 1 AS seq, text FROM {documents} WHERE doc_id % 5 = 4
    UNION ALL SELECT 3 AS batch, doc_id AS id, 'put' AS op, 1 AS seq, concat(source, ' error') AS text FROM {documents} WHERE doc_id % 21 = 0
    UNION ALL SELECT 3 AS batch, doc_id AS id, 'delete' AS op, 2 AS seq, CAST(NULL AS STRING) AS text FROM {documents} WHERE doc_id % 11 = 3
    UNION ALL SELECT 4 AS batch, doc_id AS id, 'put' AS op, 1 AS seq, concat(text, ' erosion one') AS text FROM {documents} WHERE doc_id % 13 = 5
    UNION ALL SELECT 5 AS batch, doc_id AS id, 'put' AS op, 1 AS seq, concat('onward ', source) AS text FROM {documents} WHERE doc_id % 17 = 2"""
BATCHES = 6
#: The text index after all batches; its folder goes with the application.
_FOLLOWED: dict[tuple, PostingsIndex] = {}


def followed(spark, d) -> PostingsIndex:
    """The index after all batches, one segment a batch and merges by size on the way."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOLLOWED:
        index = PostingsIndex(spark, f"{shared_folder(spark)}/followed", ("text",))
        changes = read(spark, d, "doc_changes")
        for n in range(BATCHES):
            index = index.apply(changes.filter(F.col("batch") == n).drop("batch"))
        index.vacuum()
        _FOLLOWED[key] = index
    return _FOLLOWED[key]


_LAST = "last AS (SELECT id AS doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch DESC, seq DESC) AS rn FROM doc_changes) x WHERE rn = 1 AND op = 'put')"


@query("A121_index_upkeep", twin(f"WITH {_LAST}, {_BM25.replace('FROM documents', 'FROM last')} SELECT id, round(score, 6) AS score FROM fts", "doc_changes"))
def _(spark, d):
    return PostingsIndex.open(spark, followed(spark, d).path, ("text",)).bm25(ASKED).select("id", F.round("score", 6).alias("score"))


_W = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query("A121_index_followed", twin(f"WITH {_LAST}, t AS (SELECT doc_id AS id, {_W} AS w FROM last), u AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM t) SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM u GROUP BY term, id", "doc_changes"))
def _(spark, d):
    return followed(spark, d).rows()
