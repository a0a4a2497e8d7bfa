"""Archives and their merged index, divergence of sources, periodic runs: against brute force, and on odd rows."""

import base64
import gzip
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomery.llm import divergence, periods, warc

CLASHING = ("archive", "offset", "_key", "_sha1", "first", "range", "term", "n", "_docs", "runs", "collapsed", "_best", "a.b", "with `tick`", " ")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def with_clashes(df):
    return df.select("*", *(F.lit(c).alias(c) for c in CLASHING))


# ---------------------------------------------------------------- archives


def page_key(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)[^/?#]*", url or "")
    host, rest = (m[1].lower(), url[m.end() :]) if m else ("", url or "")
    return ",".join(reversed(re.sub(r"^www[0-9]*\.", "", host).split("."))) + ")" + (rest.split("#")[0].lower() or "/")


def expected_pages(rows):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    order = sorted((page_key(u), 1704067200 + (i or 0) % 10**8, i is not None, i or 0, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), len((h or "").encode()), least.get(h or "")) for i, u, h in rows)
    out, seen = [], Counter()
    for rank, (k, _, known, i, digest, size, first) in enumerate(order):
        seen[k] += 1
        i = i if known else None
        same = first is None or first == i
        out.append((i, size, digest, "response" if same else "revisit", None if same else first, k, seen[k], rank))
    return sorted(out, key=repr)


def pages_of(rng, n):
    hosts = ["http://a.example.com", "https://www.a.example.com:8080", "HTTP://B.example.org", "https://www2.c.net", "no scheme", ""]
    bodies = ["", None, "<p>é 🙂</p>", "x" * 70_000, "\r\n\r\n", "WARC/1.1\r\n\r\n", *(f"<b>{k}</b>" for k in range(5))]
    rows = [(k, rng.choice(hosts) + rng.choice(["", "/", "/P?q=1#f", "/ü"]), rng.choice(bodies) if k % 3 else "<hot>") for k in range(n)]
    return rows + [rows[4], rows[4], (None, None, None), (None, "http://a.example.com/", "<hot>"), (3 * 10**8, rows[1][1], "late"), (-5, "http://a.example.com/", "below zero")]


@pytest.mark.parametrize("archive_bytes, range_rows", [(1 << 30, 100_000), (3000, 7), (1, 1)])
def test_archives_equal_brute_force(spark, archive_bytes, range_rows):
    rows = pages_of(random.Random(5), 60)
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    got = warc.histories(df, archive_bytes=archive_bytes, range_rows=range_rows).drop("captured").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected_pages(rows)


def test_a_hot_payload_is_apart_from_others(spark):
    rows = [(k, f"http://h.com/{k}", "same" if k < 1500 else f"own {k // 2}") for k in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = warc.histories(df).drop("captured").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected_pages(rows)


def test_no_pages(spark):
    assert warc.histories(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_archives_are_plain_warc(spark, tmp_path):
    """Each member is one record; an archive's run is sorted and its offsets are those of its members."""
    rows = [(k, f"http://h.com/{9 - k}", f"text {k % 4}", 1704067200 + k, None if k < 4 else k % 4, f"com,h)/{9 - k}") for k in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, captured long, first long, url_key string").coalesce(1)
    runs = warc.write(df, str(tmp_path / "archives")).orderBy("seq").collect()
    assert [r["url_key"] for r in runs] == sorted(r["url_key"] for r in runs)
    data = (tmp_path / "archives" / runs[0]["archive"]).read_bytes()
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 11
    for r in runs:
        headers, http, payload = warc.parse(gzip.decompress(data[r["offset"] : r["offset"] + r["size"]]))
        assert headers[b"WARC-Record-ID"] == b"<urn:page:%d>" % r["page_id"] and int(http[b"Content-Length"]) == 6
        assert (headers[b"WARC-Type"], payload) == ((b"response", b"text %d" % r["page_id"]) if r["page_id"] < 4 else (b"revisit", b""))


def test_loser_tree_merges_like_a_sort():
    rng = random.Random(2)
    for k in [0, 1, 2, 3, 5, 8, 13]:
        for _ in range(40):
            runs = [sorted((rng.randrange(9), rng.randrange(3)) for _ in range(rng.randrange(12))) for _ in range(k)]
            assert list(warc.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


# ---------------------------------------------------------------- divergence


def expected_divergence(rows, least=10):
    docs = [((l or ""), (s or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", x or "")]) for l, s, x in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df, total, by = Counter(), Counter(), defaultdict(Counter)
        for _, s, terms in mine:
            df.update(set(terms))
            by[s].update(terms)
        terms = [t for t in df if df[t] >= least]
        for _, _, ts in mine:
            total.update(ts)

        def shares(c):
            n = sum(c[t] for t in terms)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(terms)) for t in terms}

        p, q = {s: shares(c) for s, c in by.items()}, shares(total)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in by:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in terms), o.encode()) for o in by if o != s))
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in terms if by[s][t] and p[s][t] > q[t])[:10]
            for part, best in (("pair", pair), ("term", term)):
                out += [(lang, s, part, x.decode(), -v, k + 1) for k, (v, x) in enumerate(best)]
    return sorted(out)


def docs_of(spark, rows):
    return with_clashes(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string"))


def divergence_rows(rng):
    words = ["the", "The", "é", "É", "z", "Ω漢", *(f"w{chr(97 + k)}" for k in range(25))]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "B", "é", "z", None]), " 1,2;".join(rng.choice(words[: 6 + k % 26]) for _ in range(rng.randrange(40)))) for k in range(160)]
    return rows + [("en", "silent", None), ("en", "silent2", "12 34"), ("xx", "one", "only here"), ("xx", "two", ""), ("yy", "alone", "x")] + rows[:12]


@pytest.mark.parametrize("cells, pairs", [(divergence.CELLS, divergence.PAIRS), (12, 3), (1, 1)])
def test_divergence_equals_brute_force(spark, monkeypatch, cells, pairs):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    rows = divergence_rows(random.Random(8))
    got = sorted(tuple(r) for r in divergence.audit(docs_of(spark, rows).repartition(5)).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == expected_divergence(rows)


def test_divergence_joined_by_shuffle_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_LANGS", 0)
    rows = divergence_rows(random.Random(9))
    got = sorted(tuple(r) for r in divergence.audit(docs_of(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == expected_divergence(rows)


def test_divergence_of_nothing(spark):
    assert divergence.audit(docs_of(spark, [("en", "a", "x")]).limit(0)).collect() == []


def test_shares_are_exact_for_large_counts():
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 8 * 10**15)
        c, v = rng.randrange(n + 1), rng.randrange(1, 10**6)
        assert divergence._shares(np.array([c]), np.int64(n), v)[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)


# ---------------------------------------------------------------- periodic runs


def brute_runs(w, least=12):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            # the smallest period of a stretch is met first
            if j + p - i >= max(least, 2 * p) and not any((j + p - i, p % q) == (size, 0) for (s, q), size in found.items() if s == i):
                found[i, p] = j + p - i
            i = max(j, i + 1)
    return sorted((s, size, p) for (s, p), size in found.items())


def periodic(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        at, p = rng.randrange(n), 1 + rng.randrange(12)
        w[at : at + 30] = (w[at : at + p] * 30)[: len(w[at : at + 30])]
    return w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for k in range(700):
        w = periodic(rng, 1 + rng.randrange(90), (1, 2, 3, 6)[k % 4])
        assert periods.runs(w, least) == brute_runs(w, least), w


def test_runs_hold_where_hashes_lie(monkeypatch):
    """All hashes equal: every answer then comes from the words themselves."""
    monkeypatch.setattr(periods, "_PRIME", 1)
    rng = random.Random(4)
    for k in range(200):
        w = periodic(rng, 100 + rng.randrange(90), (1, 2, 3)[k % 3])
        assert periods.runs(w) == brute_runs(w)


def test_long_texts_of_one_word_take_one_pass():
    assert periods.runs([0] * 100_000) == [(0, 100_000, 1)]
    assert periods.runs([0, 1, 2] * 30_000 + [0, 0]) == [(0, 90_001, 3)]


def expected_runs(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, size, p in found for i in range(s + p, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *four, sha("".join(f"{s},{size},{p}\n" for s, size, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_run_digests_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "a", "a " * 40, "x\x0by\x0cz\r" * 9, "é é é é " * 12, "word\x1c " * 15]
    texts += [" ".join(f"w{x}" for x in periodic(rng, 1 + rng.randrange(140), 1 + rng.randrange(40))) for _ in range(250)]
    rows = [*enumerate(texts), (None, "b " * 30), (7, texts[7]), (4, texts[4])]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    key = repr
    assert sorted((tuple(r) for r in periods.digests(df).collect()), key=key) == sorted((expected_runs(*r) for r in rows), key=key)
    assert periods.digests(df.limit(0)).collect() == []
    found = {r["doc_id"]: r for r in periods.find(df.where("doc_id = 4").limit(1)).collect()}[4]
    assert [tuple(r) for r in found["runs"]] == [(0, 40, 1)] and found["collapsed"] == "a" and found["n_words"] == 40
