"""Ignore rules, source scans, data sources, views that are kept up, reservations."""

import fnmatch
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomery.operators import context, ignores, ingest, runs, views
from loomery.sources import store
from loomery.streaming import state

# ---------------------------------------------------------------- ignore rules


def by_hand(path, rules):
    """git's rule, one path at a time: (folder, n, line) with fnmatch for parts without **."""

    def meets(rel, is_folder, line):
        if line.endswith("/"):
            if not is_folder:
                return False
            line = line[:-1]
        parts = line.lstrip("/").split("/")
        names = rel.split("/")
        if "/" not in line:
            return bool(parts[0]) and fits(names[-1:], parts)
        return fits(names, parts)

    def fits(names, parts):
        if not parts:
            return not names
        if parts[0] == "**":
            if len(parts) == 1:
                return bool(names)
            return any(fits(names[k:], parts[1:]) for k in range(len(names) + 1))
        return bool(names) and fnmatch.fnmatchcase(names[0], parts[0]) and fits(names[1:], parts[1:])

    names = path.split("/")
    for k in range(1, len(names) + 1):
        entry, verdict, best = "/".join(names[:k]), False, None
        for folder, n, line in rules:
            inside = folder == "" or entry.startswith(folder + "/")
            bare = line.removeprefix("!")
            if not line or line.startswith("#") or not inside or not bare.strip("/"):
                continue
            rel = entry if folder == "" else entry[len(folder) + 1 :]
            if meets(rel, k < len(names), bare):
                at = (folder.count("/") + 1 if folder else 0, n)
                if best is None or at > best:
                    best, verdict = at, not line.startswith("!")
        if verdict:
            return True
    return False


def test_ignore_rules_equal_a_walk(spark):
    rng = random.Random(7)
    names = ["a", "b", "keep.log", "x.log", "gen", "src", "a1", "b2", "doc.md"]
    lines = ["*.log", "!keep.log", "/gen", "gen/", "src/gen", "!a", "a?", "[ab]1", "[!a]2", "**/gen", "src/**", "!src/a", "a/**/b", "# no", "", "doc.*", "!/src/gen/keep.log", "*", "!src/", "x.log/"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(250)})
    for _ in range(6):
        rules = [(f, n, rng.choice(lines)) for n, f in enumerate(rng.choice(["", "", "src", "a", "src/gen"]) for _ in range(rng.randrange(1, 8)))]
        got = ignores.ignored(spark.createDataFrame([(p,) for p in [*paths, paths[0], None]], "path string"), spark.createDataFrame(rules, "folder string, n long, pattern string"))
        assert sorted(r["path"] for r in got.collect()) == [p for p in paths if by_hand(p, rules)], rules


def test_patterns(spark):
    cases = [(r"\#a", "#a", "a"), (r"\!a", "x/!a", "a"), (r"a\*", "a*", "ab"), ("a b ", "a b", "a b "), ("[a-c]x", "bx", "dx"), ("[[]x", "[x", "ax"), ("a.b", "a.b", "axb"), ("a**b", "axxb", "a/b"), ("x/**/**/y", "x/y", "xy"), ("a\r", "a", "b"), ("[", "[", "x"), ("/**/z", "z", "zz")]
    rules = spark.createDataFrame([(f"p{k}", 0, line) for k, (line, _, _) in enumerate(cases)], "folder string, n long, pattern string")
    paths = spark.createDataFrame([(f"p{k}/{x}",) for k, (_, *both) in enumerate(cases) for x in both], "path string")
    assert {r[0] for r in ignores.ignored(paths, rules).collect()} == {f"p{k}/{yes}" for k, (_, yes, _) in enumerate(cases)}


def test_a_tree_is_scanned_with_the_rules_of_all_folders(spark, tmp_path):
    tree = {"a.py": "x", "b.log": "", "src/c.rs": "fn", "src/gen/d.rs": "", "src/keep.rs": "k", "lib/e.go": "g", "lib/sub/f.go": "f", "node_modules/g.js": "", "notes.txt": "", "src/.gitignore": "/gen\n*.rs\n!keep.rs\n", ".gitignore": "lib/sub\n", ".loomeryignore": "a.*\n!a.py\n"}
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["relpath"]: (r["language"], r["text"]) for r in ingest.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("py", "x"), "src/keep.rs": ("rs", "k"), "lib/e.go": ("go", "g")}
    rows = ingest.source_rows(spark.createDataFrame(list(tree.items()), "path string, text string"))
    assert {r["path"] for r in rows.collect()} == set(got)
    assert {r["relpath"] for r in ingest.scan(spark, str(tmp_path), ["src/"], ["go", "py", "rs"]).collect()} == {"a.py", "lib/e.go", "lib/sub/f.go"}


# ---------------------------------------------------------------- data sources


def test_a_key_range_opens_its_files_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"{k:04d}", k, None if k % 5 else "x") for k in range(1000)] + [(None, 1, "gone")], "k string, v long, w string").repartition(3)
    store.write(rows, path, "k", 50)
    table = store.scan(spark, path)
    assert table.count() == 1000 and table.rdd.getNumPartitions() >= 20
    for condition, want, most in [(F.col("k").startswith("07"), range(700, 800), 4), ((F.col("k") >= "0120") & (F.col("k") < "0125"), range(120, 125), 2), (F.col("k") == "0500", [500], 2), (F.col("k").isin("0001", "0999"), [1, 999], 2), (F.col("k") > "2", [], 1), ((F.col("k") <= "0049") & (F.col("v") > 40), range(41, 50), 2)]:
        found = table.filter(condition)
        assert sorted(r["v"] for r in found.collect()) == list(want) and found.rdd.getNumPartitions() <= most
    # replaced as a whole, and by nothing
    store.write(rows.filter("v < 3"), path, "k", 2)
    assert sorted(r["k"] for r in store.scan(spark, path).collect()) == ["0000", "0001", "0002"]
    store.write(rows.filter("v < 0"), path, "k")
    assert store.scan(spark, path).count() == 0


def test_polls_go_on_from_their_offset(spark, tmp_path):
    where = str(tmp_path)
    polls = [{"a": "1", "b": "1", "c": "1"}, {"a": "1", "b": "2", "d": "1"}, {}, {"a": "9"}]
    want, seen = [], {}
    for n, listing in enumerate(polls):
        want += [(n, p, "new" if p not in seen else "modified") for p, h in listing.items() if seen.get(p) != h] + [(n, p, "deleted") for p in seen if p not in listing]
        seen = listing
    for some in ([0, 1], [], [2, 3]):
        for n in some:
            store.record_poll(spark.createDataFrame(list(polls[n].items()), "path string, hash string"), f"{where}/polls", n)
        state.run_available(store.poll_stream(spark, f"{where}/polls"), "parquet", f"{where}/out", f"{where}/check")
    got = spark.read.schema(store.POLLED).parquet(f"{where}/out").select("poll", "path", "change").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# ---------------------------------------------------------------- views


def test_a_view_after_batches_equals_a_count(spark, tmp_path):
    rng, view, pairs = random.Random(3), views.DegreeView(spark, str(tmp_path / "view"), buckets=3), {}
    for batch in range(5):
        rows = [(rng.randrange(8), rng.randrange(8), 1 if batch == 0 or rng.random() < 0.5 else -1) for _ in range((40, 3, 12, 0, 25)[batch])]
        before = {i: d for i, *d in map(tuple, view.degrees().collect())}
        net = {}
        for s, t, sign in rows:
            net[s, t] = net.get((s, t), 0) + sign
        for p, d in net.items():
            pairs[p] = max(0, pairs.get(p, 0) + d)
        view = view.apply(spark.createDataFrame(rows, "src long, dst long, sign int"), batch * 10)
        want = {}
        for (s, t), n in pairs.items():
            if n:
                want.setdefault(t, [0, 0])[0] += 1
                want.setdefault(s, [0, 0])[1] += 1
        assert {i: d for i, *d in map(tuple, view.degrees().collect())} == want
        # only what changed is written
        written = {r["id"]: [r["in_degree"], r["out_degree"]] for r in view.changed(view.version).collect()}
        assert written == {i: want.get(i, [0, 0]) for i in {*want, *before} if want.get(i) != before.get(i)}
        if batch == 2:
            view = views.DegreeView.open(spark, view.path, 3).compact(25)
            assert {i: d for i, *d in map(tuple, view.degrees().collect())} == want
    assert views.DegreeView.open(spark, view.path, 3) == view
    stale = views.staleness(view.refreshes().withColumn("view", F.lit("degrees")), "view", "refreshed_ms", F.lit(100), 50).head()
    assert (stale["last_refresh"], stale["age"], stale["is_stale"]) == (40, 60, True)


def test_reservations(spark):
    rows = [("reserve", "primary", 400), ("reserve", "tests", 300), ("reserve", "callers", 400), ("reserve", "primary", 600), ("reserve", "primary", 800), ("release", "tests", 0), ("release", "tests", 0), ("reserve", "callers", 400), ("reserve", "primary", 600)]
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)] + [(2, 0, "reserve", "x", 1001)], "bundle long, seq long, action string, category string, tokens long")
    got = [(r["accepted"], r["used"]) for r in context.reservations(df, 1000).orderBy("bundle", "seq").collect()]
    assert got == [(True, 400), (True, 700), (False, 700), (True, 900), (False, 900), (True, 600), (True, 600), (True, 1000), (True, 1000), (False, 0)]
    assert re.match("bundle", context.reservations(df.limit(0), 5).columns[0]) and context.reservations(df.limit(0), 5).count() == 0


def test_a_stopped_run_goes_on(spark, tmp_path):
    """Stopped and continued equals run through; costs are those of the batches that ran; nothing runs twice."""
    texts = spark.createDataFrame([("x" * (4 * k),) for k in range(1, 31)] + [("x" * 8,), (None,)], "text string")
    one = runs.EmbeddingRuns(spark, str(tmp_path / "one"), 4, batch=7, price=1.0)
    one.run(texts, ingest.hash_provider(4))
    two = runs.EmbeddingRuns(spark, str(tmp_path / "two"), 4, batch=7, price=1.0)
    asked = []
    for ceiling in (0.0001, 0.15, 0.15, None, None):
        asked += [tuple(r)[3:8] for r in two.run(texts, ingest.hash_provider(4), ceiling).collect()]
    order = sorted((hashlib.sha256(t.encode()).hexdigest(), len(t) // 4) for t in {"x" * (4 * k) for k in range(31)})
    left, want = [n for _, n in order], []
    for ceiling in (0.0001, 0.15, 0.15, 1e9):
        cuts = [left[k : k + 7] for k in range(0, len(left), 7)]
        ran = [c for k, c in enumerate(cuts) if sum(map(sum, cuts[: k + 1])) / 1000 <= ceiling]
        n = sum(map(len, ran))
        want.append(("completed" if n == len(left) else "stopped", len(left), n, len(ran), sum(map(sum, ran))))
        left = left[n:]
    assert asked == want and not left
    first, second = (sorted(map(str, s.vectors().collect())) for s in (one, two))
    assert first == second and len(first) == 31

    def fails(batch):
        raise RuntimeError("no provider")

    more = texts.union(spark.createDataFrame([("new",)], "text string"))
    with pytest.raises(Exception):
        two.run(more, fails)
    assert two.ledger().count() == 4 and two.run(more, ingest.hash_provider(4)).head()["completed"] == 1
