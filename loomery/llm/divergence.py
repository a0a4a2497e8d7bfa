"""Divergence of sources within a language (operator 12).

Terms (runs of ASCII letters, A-Z lower-cased, and of characters beyond ASCII) are counted per (language, source); a language
keeps those in at least ``LEAST_DOCS`` of its documents.  With shares p, q in billionths, two sources differ by the sum of
f = floor((p - q)^2 / (p + q)) over all kept terms of their language, and a source's terms stand out by f against the
language's own share.

Kept terms are dealt by hash into blocks.  A block and the groups (sources) of its language make a dense int64 tile, groups
by terms, with zeros where a group lacks a term; all pairs of its rows are formed by broadcasting one row against the rest.
Partial pair sums of the tiles are added up by shuffle; each tile's best terms are sorted heaps of ``TOP`` entries a group,
merged first within a partition, then by group.  A tile has about ``CELLS`` cells and ``PAIRS`` pairs at most, whatever the
input: blocks follow terms times groups, and where groups are many, the pairs of a block are split over several tiles.

Shares are exact: a long division by 1000 in three steps of int64, right while a language has fewer than 9 * 10^15 words.
Pair sums are int64 as well: a sum of f over terms is below the sum of all p, some 10^9.

Defined cases: a null text, language or source is the empty one; a group without kept terms has equal shares of all of
them; in a language without kept terms all pairs have 0; repeated rows count as documents of their own; an empty table
gives no rows; further columns are ignored, whatever their names; texts are counted whole.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, cut, slices

LEAST_DOCS, TOP = 10, 10
#: Cells and pairs of a tile at most; distinct terms that a counting task holds before it hands them on.
CELLS, PAIRS, HELD = 1 << 18, 1 << 20, 400_000
#: Rows of per-language figures up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST_LANGS = 10_000
# fixed values: bytes that make up terms, the rest being separators
_FOLD = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_TILES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_TILES_DDL = "lang string, source string, part string, item string, value long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and document counts per (lang, source, term), and one row with a null term per group and its documents."""
    words: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    rows: Counter = Counter()

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in rows.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "source": [source], "term": [None], "n": [0], "docs": [n]}, schema=_COUNTS)
        for (lang, source), times in words.items():
            terms = list(times)
            seen = docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(times.values()), pa.int64()), pa.array([seen[t] for t in terms], pa.int64())],
                schema=_COUNTS,
            )
        words.clear(), docs.clear(), rows.clear()

    for b in slices(batches):
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary())):
            group = lang or "", source or ""
            rows[group] += 1
            terms = (text.as_py() or b"").translate(_FOLD).split()
            if terms:
                words.setdefault(group, Counter()).update(terms)
                docs.setdefault(group, Counter()).update(set(terms))
        if sum(map(len, words.values())) > HELD:
            yield from hand_on()
    yield from hand_on()


def _shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), by long division with base 1000."""
    below = totals + 2 * terms
    rest = counts + 2
    out = np.zeros(np.broadcast(rest, below).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _tile(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial pair sums and best terms of one block; the tile's own rows are groups lo to hi of the language, by name."""
    lang, tile = key[0].as_py(), key[2].as_py()
    names = sorted(groups.column("source").to_pylist(), key=str.encode)
    at = {s: k for k, s in enumerate(names)}
    total, size = np.zeros(len(names), np.int64), {}
    for s, n in zip(groups.column("source").to_pylist(), groups.column("n_group").to_pylist()):
        total[at[s]] = n
    n_lang, n_terms, tiles = (groups.column(c)[0].as_py() for c in ("n_lang", "n_terms", "tiles"))
    all_terms = cells.column("term").to_pylist()
    terms = sorted(set(all_terms), key=str.encode)
    size = {t: k for k, t in enumerate(terms)}
    where = np.array([size[t] for t in all_terms], np.int64)
    rows = np.array([at[s] for s in cells.column("source").to_pylist()], np.int64)
    counts = np.zeros((len(names), len(terms)), np.int64)
    in_lang = np.zeros(len(terms), np.int64)
    if len(terms):
        counts[rows, where] = cells.column("n").to_numpy()
        in_lang[where] = cells.column("n_all").to_numpy()
    sources, parts, items, values = [], [], [], []
    p = _shares(counts, total[:, None], n_terms)
    q = _shares(in_lang, np.int64(n_lang), n_terms) if len(terms) else in_lang
    for a in range(tile, len(names), tiles):
        if a + 1 < len(names):
            sums = _f(p[a + 1 :], p[a]).sum(axis=1)
            sources += [names[a]] * len(sums)
            parts += ["pair"] * len(sums)
            items += names[a + 1 :]
            values += sums.tolist()
        stands_out = np.flatnonzero((counts[a] > 0) & (p[a] > q))
        if len(stands_out):
            f = _f(p[a, stands_out], q[stands_out])
            # terms are in order, so a stable sort leaves ties in it
            best = np.argsort(-f, kind="stable")[:TOP]
            sources += [names[a]] * len(best)
            parts += ["term"] * len(best)
            items += [terms[k] for k in stands_out[best].tolist()]
            values += f[best].tolist()
    return pa.Table.from_arrays([pa.array([lang] * len(sources), pa.string()), pa.array(sources, pa.string()), pa.array(parts, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], schema=_TILES)


def _heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The TOP best terms of each group among a partition's rows, best first: sorted heaps, merged batch by batch."""
    held: dict[tuple[str, str], list[tuple[int, bytes]]] = {}
    for b in batches:
        new: dict[tuple[str, str], list[tuple[int, bytes]]] = {}
        for lang, source, item, value in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "item", "value"))):
            new.setdefault((lang, source), []).append((-value, item.encode()))
        for group, entries in new.items():
            held[group] = list(islice(heapq.merge(held.get(group, ()), sorted(entries)), TOP))
    for (lang, source), entries in held.items():
        n = len(entries)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), pa.array(["term"] * n), pa.array([x.decode() for _, x in entries]), pa.array([-v for v, _ in entries], pa.int64())], schema=_TILES)


def _ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(w).alias("rank"))


def counted(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, n_all) of kept terms, and one row with a null term for each group; ``first`` marks one row of each term."""
    found = arrow(docs.select("lang", "source", "text"), _count, "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # the rows of groups go the same way, so the texts are read once; a language's are as many as its sources
    w = Window.partitionBy("lang", "term")
    rows = found.select("lang", "source", "term", "n", F.sum("docs").over(w).alias("_docs"), F.sum("n").over(w).alias("n_all"), F.min("source").over(w).alias("_one"))
    kept = rows.where(F.col("term").isNull() | (F.col("_docs") >= least_docs))
    return kept.select("lang", "source", "term", "n", "n_all", (F.col("term").isNotNull() & (F.col("source") == F.col("_one"))).cast("long").alias("first"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language, part ``term`` the TOP terms that stand out."""
    # the counts are read three times
    cells = cut(counted(docs, least_docs), "counts")
    groups = cut(cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum("first").alias("_first")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("n_group").alias("n_lang"), F.sum("_first").alias("n_terms"), F.count("*").alias("_groups"))
    langs = langs.select(
        "lang", "n_lang", "n_terms", F.greatest(F.lit(1), F.ceil(F.col("n_terms") * F.col("_groups") / CELLS)).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("_groups") * F.col("_groups") / 2 / PAIRS)).cast("int").alias("tiles")
    )
    langs = cut(langs, "languages")
    few = langs.count() <= BROADCAST_LANGS
    beside = F.broadcast(langs) if few else langs
    dealt = cells.where("term IS NOT NULL").join(beside, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "source", "term", "n", "n_all")
    around = groups.join(beside, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "n_group", "n_lang", "n_terms", "tiles")
    around = around.select("lang", "block", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "source", "n_group", "n_lang", "n_terms", "tiles")
    tiles = cut(dealt.groupBy("lang", "block", "tile").cogroup(around.groupBy("lang", "block", "tile")).applyInArrow(_tile, _TILES_DDL), "tiles")
    sums = tiles.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", "part", "value", sides.alias("_s")).select("lang", "_s.source", "part", "_s.item", "value")
    heaps = arrow(tiles.where("part = 'term'"), _heaps, _TILES_DDL).repartition("lang", "source")
    return _ranked(pairs).unionByName(_ranked(arrow(heaps, _heaps, _TILES_DDL)))
