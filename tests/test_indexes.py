"""Inverted file and postings that follow changes: against plain scans, and what they open."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import ivf, search
from loomery.operators.segments import PostingsIndex

WORDS = ["the", "then", "error", "erosion", "on", "one", "alpha", "beta", "gamma", "zeta", "mu", "nu"]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8)) * 4
    rows = [(k, [float(x) for x in middles[k % 12] + rng.normal(size=8)], k % 3) for k in range(900)]
    rows += [(900, [0.0] * 5, 0), (901, None, 0), (902, [None] * 8, 0), (903, rows[5][1], 1), (904, rows[5][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return ivf.build(vectors, str(tmp_path_factory.mktemp("ivf") / "index"), 8)


def scanned(vectors, query, k, keep=None):
    return [r["vec_id"] for r in search.knn(ivf.usable(vectors, "embedding", 8), query, k, keep).collect()]


def test_every_usable_row_is_in_one_cell(index):
    assert sorted(r["vec_id"] for r in index.rows.select("vec_id").collect()) == [*range(900), 903, 904]
    assert index.counts.sum() == 902 and 1 < len(index.centres) <= 30


def test_exact_searches_equal_a_scan_and_prune(vectors, index):
    rng = np.random.default_rng(5)
    for k in (1, 10, 60):
        for _ in range(3):
            query = [float(x) for x in rng.normal(size=8) * 3]
            keep = F.col("label") == 1
            for where in (None, keep):
                want = scanned(vectors, query, k, where)
                assert [r["vec_id"] for r in ivf.search(index, query, k, probes=2, keep=where, exact=True).collect()] == want
                assert [r["vec_id"] for r in ivf.search(index, query, k, probes=len(index.centres), keep=where).collect()] == want
    query = vectors.filter("vec_id = 5").head()["embedding"]
    near = ivf.search(index, query, 10, probes=2)
    assert [r["vec_id"] for r in near.collect()][:3] == [5, 903, 904]
    assert 1 <= len({f.split("cell=")[1].split("/")[0] for f in near.inputFiles()}) <= len(index.centres)
    assert "PartitionFilters: [cell" in near._jdf.queryExecution().executedPlan().toString()


def test_more_asked_for_than_there_is(vectors, index):
    assert len(ivf.search(index, [0.0] * 8, 5000, probes=1, exact=True).collect()) == 902


def test_recall(spark, vectors, index):
    asking = vectors.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = ivf.recall(index, asking, 10).head()
    # row 900 has another dimension
    assert got["queries"] == 90 and got["wanted"] == 900 and got["found"] >= 0.95 * 900
    many = ivf.search_many(index, asking.filter("query_id < 30"), 7, len(index.centres)).collect()
    for q in (0, 10, 20):
        own = [r["id"] for r in sorted((r for r in many if r["query"] == q), key=lambda r: r["rank"])]
        assert own == scanned(vectors, vectors.filter(F.col("vec_id") == q).head()["embedding"], 7)


def test_an_index_is_read_again(spark, vectors, index, tmp_path):
    path = str(tmp_path / "few")
    ivf.build(vectors.limit(3), path, 8)
    assert len(ivf.search(ivf.load(spark, path), [0.0] * 8, 10).collect()) == 3
    empty = ivf.build(vectors.limit(0), str(tmp_path / "none"), 8)
    assert ivf.search(empty, [0.0] * 8, 10, exact=True).collect() == []


def test_many_queries_meet_tiles_of_rows(spark, vectors, index, monkeypatch):
    # seven rows or queries a tile: cells lie in several tiles, queries in several parts
    monkeypatch.setattr(ivf, "TILE_BYTES", 7 * 8 * 8)
    asking = vectors.filter("vec_id % 40 = 3 OR vec_id > 899").select(F.col("vec_id").alias("query_id"), "embedding")
    vecs = {r["vec_id"]: r["embedding"] for r in ivf.usable(vectors, "embedding", 8).collect()}
    for probes in (len(index.centres), 3, 1):
        found = ivf.search_many(index, asking, 6, probes)
        # a query goes to tiles with a list of cells, not to each cell as a row
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
            got.setdefault(r["query"], []).append((r["id"], r["distance"]))
        assert sorted(got) == sorted(k for k in vecs if k % 40 == 3 or k > 899)
        for q in sorted(got)[::5] + [903]:
            want = [(r["vec_id"], r["distance"]) for r in ivf.search(index, vecs[q], 6, probes=probes).collect()]
            assert got[q] == want


def test_nearest_in_cells_keeps_ties_and_odd_numbers():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, size=(400, 3)).astype(float)
    x[7, 1], x[300, 0], x[301, 0] = np.nan, np.inf, 1e200
    cell, place = np.sort(rng.integers(0, 9, 400)), rng.permutation(400)
    q = np.concatenate([x[:20], [[0.5, 0.5, 0.5]]])
    opens = rng.random((21, len(np.unique(cell)))) < 0.6
    opens[4] = False
    for k in (1, 5, 1000):
        a, r, d = ivf.nearest_in_cells(x, cell, place, q, opens, k)
        for i in range(21):
            with np.errstate(invalid="ignore", over="ignore"):
                far = np.sqrt(((x - q[i]) ** 2).cumsum(axis=1)[:, -1])
            in_cells = np.flatnonzero(opens[i][np.searchsorted(np.unique(cell), cell)])
            want = in_cells[np.lexsort((place[in_cells], far[in_cells]))][:k]
            assert r[a == i].tolist() == want.tolist() and np.array_equal(d[a == i], far[want], equal_nan=True)


# ---------------------------------------------------------------- postings


def changes(spark, rows):
    return spark.createDataFrame(rows, "id long, op string, seq long, text string")


def text(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(9)))


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


def test_an_index_after_changes_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(11)
    index, live = PostingsIndex(spark, str(tmp_path / "index"), ("text",), file_rows=40), {}
    for batch in range(6):
        rows = []
        for k in range((60, 20, 25, 3, 3, 40)[batch]):
            i = k if batch == 0 else rng.randrange(90)
            for seq in range(rng.choice([1, 1, 1, 2])):
                rows.append((i, "delete" if batch and rng.random() < 0.4 else "put", 10 * k + seq, text(rng)))
        index = index.apply(changes(spark, rows))
        for i, op, _, t in sorted(rows, key=lambda r: r[2]):
            live.pop(i, None)
            if op == "put":
                live[i] = t
        docs = changes(spark, [(i, "put", 0, t) for i, t in live.items()]).select("id", "text")
        assert index.n_docs == len(live) and index.mean_words == pytest.approx(sum(len(t.split()) for t in live.values()) / max(len(live), 1))
        assert scores(index.bm25("er the")) == scores(search.bm25(docs, "er the", fields=("text",)))
        if batch in (2, 5):
            want = sorted(map(tuple, search.postings(docs, "id", ("text",)).collect()))
            assert sorted(map(tuple, index.rows().collect())) == want
            again = PostingsIndex.open(spark, index.path, ("text",))
            assert again.parts == index.parts and scores(again.bm25("on")) == scores(index.bm25("on"))
    # merges kept the segments few, and nothing but named folders stays
    assert len(index.segments) <= 4 and index.vacuum() > 0
    assert scores(index.bm25("er the")) == scores(search.bm25(docs, "er the", fields=("text",)))


def test_a_prefix_opens_few_files(spark, tmp_path):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"{a}{rng.randrange(9)}" for a in "abcdefghij") + " hot") for i in range(200)], "doc_id long, text string")
    index = PostingsIndex(spark, str(tmp_path / "index"), ("text",), file_rows=100).build(docs, "doc_id")
    every = {f for _, f in index.files([""])}
    some = {f for _, f in index.files(["c3"])}
    # a word that all rows have is split over files; a rare one lies in one or two
    assert len(every) > 15 and len(some) <= 3 and len(index.files(["hot"])) >= 2 and index.files(["zz"]) == []
    assert {f.split("/")[-1] for f in index.find(["c3"]).inputFiles()} == {f.split("/")[-1] for f in some}
    assert scores(index.bm25("c3")) == scores(search.bm25(docs, "c3", id_col="doc_id", fields=("text",)))


def test_an_index_may_lose_all_rows(spark, tmp_path):
    index = PostingsIndex(spark, str(tmp_path / "index"), ("text",)).apply(changes(spark, [(1, "put", 0, "the"), (2, "put", 0, None)]))
    assert index.n_docs == 2 and len(scores(index.bm25("the"))) == 1
    index = index.apply(changes(spark, [(1, "delete", 0, None), (2, "delete", 0, None), (7, "delete", 0, None)]))
    assert index.n_docs == 0 and index.bm25("the").collect() == [] and index.rows().collect() == []
    index = index.apply(changes(spark, []))
    index = index.apply(changes(spark, [(1, "put", 0, "the the")]))
    assert index.n_docs == 1 and index.rows().collect()[0]["tf"] == 2 and index.ts_rank("th").count() == 1
    assert index.bm25("!").collect() == []
