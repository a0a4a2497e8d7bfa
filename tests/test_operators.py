"""Operators on small literal frames."""

import itertools

import pytest
from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators import context, crdt, delta, evaluation, fusion, graph, ingest, markdown, search
from loomery.sources import git


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect()) if cols else sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    "name, want",
    [("validateProvider", "validate_provider"), ("XMLParser", "xml_parser"), ("validateHTTPRequest", "validate_http_request"), ("HTTPSHandler", "https_handler"), ("Base64Encoder", "base64_encoder"), ("validate-provider", "validate_provider")],
)
def test_identifiers(spark, name, want):
    assert T.normalise_identifier_text(name) == want
    assert spark.range(1).select(T.normalise_identifier(F.lit(name))).head()[0] == want


@pytest.mark.parametrize("query, want", [("some-function", "some* OR function*"), ("module:function", "module* OR function*"), ("package.json", "package* OR json*"), ("src/main.rs", "src* OR main* OR rs*"), ("array[0]", "array* OR 0*"), ("!!! ---", "")])
def test_match_expression(query, want):
    assert T.match_expression(query) == want


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, rank long")
    b = spark.createDataFrame([(2, 0), (3, 1)], "id long, rank long")
    got = {r["id"]: (r["score"], r["source"]) for r in fusion.rrf_weighted(a, b).collect()}
    assert got[1] == (pytest.approx(0.3 / 60), "fts")
    assert got[2] == (pytest.approx(0.3 / 61 + 0.7 / 60), "both")
    assert got[3] == (pytest.approx(0.7 / 61), "vector")
    got = {r["id"]: r["score"] for r in fusion.rrf([a, b]).collect()}
    assert got[1] == pytest.approx(1 / 61) and got[2] == pytest.approx(1 / 61 + 1 / 62)
    assert sum(fusion.check_weights({"a": 2, "b": 6}).values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        fusion.check_weights({"a": -1})


def test_traversal(spark):
    e = spark.createDataFrame([(1, 2, "calls"), (2, 3, "calls"), (3, 1, "calls"), (4, 4, "calls")], "src long, dst long, type string")
    s = spark.createDataFrame([(1,)], "id long")
    assert rows(graph.paths(e, s, ["calls"], 3), "id", "depth") == [(1, 3), (2, 1), (3, 2)]
    assert rows(graph.paths(e, s, ["calls"], 2, reverse=True), "id", "depth") == [(2, 2), (3, 1)]
    assert rows(graph.paths_recursive(spark, e, 1, "calls", 3), "id", "depth") == [(1, 3), (2, 1), (3, 2)]
    assert rows(graph.reachable(e, s), "id") == [(1,), (2,), (3,)]


def test_reachable_follows_long_chains(spark):
    e = spark.createDataFrame([(i, i + 1, "calls") for i in range(1, 21)], "src long, dst long, type string")
    s = spark.createDataFrame([(1,)], "id long")
    assert rows(graph.reachable(e, s), "id") == [(i,) for i in range(1, 22)]
    assert rows(graph.reachable(e, s, 12), "id") == [(i,) for i in range(1, 14)]


def test_retrieval_metrics(spark):
    df = spark.createDataFrame([(1, i + 1, g, g >= 2) for i, g in enumerate([3, 2, 0, 2, 0])], "query_id long, rank long, grade int, relevant boolean")
    import math

    assert evaluation.precision_at(df, 3).head()["precision"] == pytest.approx(2 / 3)
    dcg = 3 / math.log2(2) + 2 / math.log2(3) + 2 / math.log2(5)
    ideal = 3 / math.log2(2) + 2 / math.log2(3) + 2 / math.log2(4)
    assert evaluation.ndcg_at(df, 5).head()["ndcg"] == pytest.approx(dcg / ideal)
    assert evaluation.reciprocal_rank(df).head()["rr"] == 1.0
    assert evaluation.precision_at(df, 0).head()["precision"] == 0.0


def test_statistics(spark):
    r = spark.range(1).select(evaluation.normal_cdf(F.lit(1.96)).alias("a"), evaluation.chi_square(*(F.lit(float(x)) for x in (10, 20, 30, 40))).alias("b")).head()
    assert r["a"] == pytest.approx(0.975, abs=1e-4)
    assert r["b"] == pytest.approx(100 * (10 * 40 - 20 * 30) ** 2 / (30 * 70 * 40 * 60))
    assert evaluation.sample_size(0.1, 0.12) == 3841


CELL = "soul string, key string, vtype string, v_text string, v_num double, v_bool boolean, v_link string, state double, msg_id string"


def cell(value, state, soul="a", key="k"):
    return (soul, key, "text" if isinstance(value, str) else "null" if value is None else "num", value if isinstance(value, str) else None, float(value) if isinstance(value, (int, float)) else None, None, None, state, "m")


def test_merge_in_any_order(spark):
    ops = [cell("b", 5.0), cell("abc", 5.0), cell("abd", 5.0), cell("zzzz", 4.0), cell("x", float("nan")), cell("x", float("inf"))]
    for order in itertools.islice(itertools.permutations(ops), 0, 720, 97):
        got = crdt.ham(spark.createDataFrame(list(order), CELL)).head()
        assert (got["v_text"], got["state"]) == ("abd", 5.0)
    gone = crdt.ham(spark.createDataFrame([cell("b", 1.0), cell(None, 2.0)], CELL)).head()
    assert gone["vtype"] == "null"
    assert crdt.ham(spark.createDataFrame([cell("b", 1.0), cell("c", 900.0)], CELL), 100.0, 10.0).head()["v_text"] == "b"


def test_json_length(spark):
    df = spark.createDataFrame([cell("é", 1.0), cell(3.0, 1.0), cell(3.5, 1.0), cell(None, 1.0)], CELL)
    assert [r[0] for r in df.select(crdt.json_length()).collect()] == [4, 1, 3, 4]


@pytest.mark.parametrize("args, want", [({"exact": "b"}, ["b"]), ({"prefix": "b"}, ["b", "bc"]), ({"gte": "b", "lte": "c"}, ["b", "bc", "c"]), ({"gte": "c"}, ["c", "d"]), ({"lte": "b"}, ["a", "b"]), ({"gte": "d", "lte": "a"}, ["d"]), ({}, [])])
def test_lex(spark, args, want):
    df = spark.createDataFrame([(k,) for k in ("a", "b", "bc", "c", "d")], "k string")
    assert [r[0] for r in rows(df.filter(crdt.lex(F.col("k"), **args)))] == want


@pytest.mark.parametrize(
    "steps, want",
    [("new deleted", None), ("deleted new", "modified"), ("new modified", "new"), ("modified modified", "modified"), ("modified deleted", "deleted"), ("modified new", "modified"), ("deleted modified", "deleted"), ("deleted deleted", "deleted"), ("new deleted new", "new")],
)
def test_change_algebra(spark, steps, want):
    df = spark.createDataFrame([("p", i, s) for i, s in enumerate(steps.split())], "path string, seq long, change string")
    assert delta.merge_changes(df).head()["change"] == want


def test_upsert_keeps_old_where_asked(spark):
    old = spark.createDataFrame([(1, "en"), (2, "de")], "id long, lang string")
    new = spark.createDataFrame([(1, None), (3, "fr")], "id long, lang string")
    assert rows(delta.upsert(old, new, ["id"], keep_old=["lang"])) == [(1, "en"), (2, "de"), (3, "fr")]


def test_markdown(spark):
    text = "# A\nx\n## B\n```\n# no\n```\n## C\n# D"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = rows(markdown.sections(df, "id"), "start", "level", "title", "end", "path")
    assert got == [(1, 1, "A", 7, "A"), (3, 2, "B", 6, "A > B"), (7, 2, "C", 7, "A > C"), (8, 1, "D", 8, "D")]
    assert rows(markdown.fences(df, "id"), "start", "end") == [(4, 6)]


def test_code_chunks(spark):
    df = spark.createDataFrame([(1, "class A:\n    def f(self):\n        '''Doc'''\n\ndef g(): pass\n", "py"), (2, "pub fn run() {\n}\nstruct S;", "rs"), (3, "plain", "xx")], "id long, text string, language string")
    got = [(r["id"], r["kind"], r["symbol_name"]) for r in ingest.chunks(df, "id").collect()]
    assert got == [(1, "class", "A"), (1, "method", "f"), (1, "func", "g"), (2, "func", "run"), (2, "class", "S"), (3, "module", None)]


def test_git_sources(spark):
    df = spark.createDataFrame([("?? a.py",), (" M b.py",), ("R  old.py -> new.py",), ('A  "sp ace.py"',), (" D ../x",)], "value string")
    got = [tuple(r) for r in git.status(df).collect()]
    assert got == [("a.py", "untracked", None), ("b.py", "modified", None), ("new.py", "renamed", "old.py"), ("sp ace.py", "added", None)]


def test_packing_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, i, t, i) for i, t in enumerate([50, 40, 30, 10])], "bundle long, id long, tokens long, place long")
    assert context.pack(df, 100).head().asDict() == {"bundle": 1, "ids": [0, 1, 3], "used": 100}


def test_knn_filters_before_or_after(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(6)] + [(9, [0.0], 0)], "vec_id long, embedding array<float>, label long")
    assert [r["vec_id"] for r in search.knn(df, [0.0, 0.0], 2, F.col("label") == 1).collect()] == [1, 3]
    assert [r["vec_id"] for r in search.knn(df, [0.0, 0.0], 2, F.col("label") == 1, prefilter=False).collect()] == [1]


# expected values below are typed from the surveyed rules, not taken from the implementation
@pytest.mark.parametrize("query, want", [("authenticate user", ["authenticate", "user"]), ("User::authenticate", ["user", "::", "authenticate"]), ("&mut value", ["&", "mut", "value"]), ("hello world!", ["hello", "world"]), ("he will or this", ["or", "this"]), ("foo.bar_baz(x)", ["foo.bar_baz", "x"]), ("x != y", ["x", "!=", "y"]), ("p->next", ["p", "->", "next"])])
def test_query_tokens(query, want):
    assert T.query_tokens(query) == want


@pytest.mark.parametrize("query, want", [("foo()", "code"), ("array[0] of things", "auto"), ("( open only here", "text"), ("user_id", "code"), ("User login", "code"), ("user auth", "auto"), ("how does it work", "text"), ("a => b", "code"), ("find_user by id", "auto")])
def test_query_modes(query, want):
    assert T.query_mode(query) == want


def test_fixed_values():
    assert set(T.STOP_WORDS) >= {"has", "he", "its", "will"} and not set(T.STOP_WORDS) & {"or", "this"}
    assert fusion.KIND_MULTIPLIERS["function"] == 1.2 and fusion.KIND_MULTIPLIERS["import"] == 0.7 and "func" not in fusion.KIND_MULTIPLIERS
    assert fusion.EDGE_QUALITY == {"calls": 1.0} and fusion.FROM_TEST == 0.5
    assert T.expansions(["function"]) == ["fn", "func", "method"]
    assert T.expansions(["test"]) == ["spec", "unittest"] and T.expansions(["user"]) == []


def test_chi_square_bounds(spark):
    xs = [10.83, 10.84, 6.63, 6.64, 3.84, 3.85, 2.71, 2.72, -1.0]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", evaluation.chi_square_p(F.col("x")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == [0.01, 0.001, 0.05, 0.01, 0.1, 0.05, 0.5, 0.1, 1.0]


def test_percentiles_of_a_hot_group(spark):
    import random

    rng = random.Random(4)
    values = [("hot", float(rng.randrange(50))) for _ in range(900)] + [("cold", float(rng.randrange(50))) for _ in range(7)] + [(None, 1.0), ("cold", None)]
    got = {r["g"]: (r["p50"], r["p95"]) for r in evaluation.lower_percentiles(spark.createDataFrame(values, "g string, v double"), "v", [0.5, 0.95], ["g"]).collect()}
    for g in ("hot", "cold", None):
        own = sorted(v for k, v in values if k == g and v is not None)
        assert got[g] == tuple(own[int((len(own) - 1) * p)] for p in (0.5, 0.95))


def test_wire_values_survive(spark):
    from loomery.operators import wire

    rows = [("a", 'k"q', "text", 'x "y"\n', None, None, None, 1.0), ("a", "n", "num", None, 2.5, None, None, 2.0), ("b", "z", "null", None, None, None, None, 3.0), ("b", "t", "bool", None, None, True, None, 4.0), ("b", "l", "link", None, None, None, "a", 5.0)]
    cells = spark.createDataFrame(rows, "soul string, key string, vtype string, v_text string, v_num double, v_bool boolean, v_link string, state double")
    assert sorted(map(tuple, wire.decode(wire.encode(cells), "soul", "json").drop("id").collect())) == sorted(rows)


def test_rechunking_rolls_back(spark, tmp_path):
    from loomery.operators import migrate

    old = spark.createDataFrame([(1, 1, 5), (2, 1, 9)], "file_id int, start_line int, end_line int")
    files = spark.createDataFrame([(1, "text"), (2, "more")], "file_id int, text string")
    good, stats = migrate.rechunk(old, files.filter("file_id = 1"), lambda f: f.selectExpr("file_id", "1 AS start_line", "2 AS end_line"), f"{tmp_path}/a")
    assert rows(good) == [(1, 1, 2), (2, 1, 9)] and stats["rolled_back"] == 0
    same, stats = migrate.rechunk(old, files, lambda f: f.filter("file_id = 1").selectExpr("file_id", "3 AS start_line", "2 AS end_line"), f"{tmp_path}/b")
    assert rows(same) == rows(old) and stats["bare"] == 1 and stats["wrong"] == 1 and stats["rolled_back"] == 1


def test_file_batches(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    events = spark.createDataFrame([("a", "modified", "2", 10), ("b", "deleted", None, None), ("c", "modified", "9", 10 * 1024 * 1024 + 1), ("d", "new", "4", 1), ("e", "new", "5", 10 * 1024 * 1024 + 1), ("z", "deleted", None, None)], "path string, change string, hash string, bytes long")
    after, outcomes = delta.process_files(current, events)
    assert rows(after) == [("a", "2"), ("c", "1"), ("d", "4")]
    assert dict(rows(outcomes)) == {"a": "updated", "b": "removed", "c": "skipped", "d": "indexed", "e": "skipped", "z": "unknown"}


def test_import_edges_are_made_once_and_not_compared(spark, monkeypatch):
    monkeypatch.setattr(ingest, "LISTED", 4)
    monkeypatch.setattr(ingest, "EDGES_A_TASK", 32)
    # repeated rows, a frequent name, ids of several names, nulls, names that nothing has
    imports = [(i, f"a,{'b' if i % 3 == 0 else 'c'},a") for i in range(40)] + [(0, "a,x"), (50, None), (51, ""), (None, "b")]
    defs = [(100 + i, "a") for i in range(30)] + [(100, "a"), (100, "b"), (101, "c"), (200, "b"), (201, None), (202, ""), (None, "c")]
    edges = ingest.import_edges(spark.createDataFrame(imports, "id long, metadata string"), spark.createDataFrame(defs, "id long, symbol_name string"))
    want = {(s, d, "imports") for s, names in imports if names is not None for d, n in defs if n is not None and n in names.split(",")}
    got = [tuple(r) for r in edges.collect()]
    assert len(got) == len(want) and set(got) == want
    # the edges are neither shuffled nor held to find equal ones, and several tasks make them
    assert "keys=[src" not in edges._jdf.queryExecution().executedPlan().toString()
    assert sum(n > 0 for n in edges.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) >= 4
