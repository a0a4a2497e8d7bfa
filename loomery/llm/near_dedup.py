"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles (operator 7).

1. Document frequencies of all word shingles are counted over every document, each shingle by itself: blocks of documents
   send their distinct shingles to ranges of hashes, where they are added up, and get the sums back.
2. A document's shingles get TF-IDF weights, and ``bands * rows`` independent weighted samples are drawn, each over all
   shingles of the document: the earliest of random points that lie evenly on its weight.  Two documents agree in a
   sample with exactly their weighted Jaccard similarity.  ``rows`` samples make a band; documents that share a band are
   candidates.
3. In every shared band the first document is compared with the others by exact weighted Jaccard over stored vectors.
   Links make components.  Bands that then still hold several components are looked at again: the documents they chain
   together are compared in blocks, each with each, and links between different components join the others.
Exact copies are one node from the start, so a group of copies costs one vector however large it is.

Weights: (1 + ln tf) * (1 + ln((1 + N) / (1 + df)) / ln(1 + N)), in tenths, 255 of them at most
(which a shingle exceeds that comes more than 127,000 times in one text).  With the defaults a pair of similarity 0.8
shares no band with probability 2e-5, a closer one less often.

Defined cases: a null text is the empty one; texts without words are alike only if equal; a text of fewer words than a
shingle is one shingle; equal texts are one class whatever their ids; repeated rows are copies; a class is named by the
id of the row read first, which is the one kept; an empty table gives no rows; further columns are ignored or kept,
whatever their names; a text is shingled whole, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut, give_back, quoted, release, slices, unused
from .components import components

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 28, 5
#: log2 of the documents whose shingles are counted together; at most 256, as a block's own count is one byte.
BLOCK_BITS = 8
#: Characters of text for each range of hashes: some million shingles.
RANGE_CHARS = 6 << 20
_SCALE = 10.0
#: Bounds of the ranges of weight that have points of their own; a shingle needs the ranges that begin below its weight.
_EDGES = (0, 10, 20, 40, 80, 160, 256)
#: Documents that are sampled at a time.
TOGETHER = 64
#: Documents that are compared with as many others at a time where a band holds several components.
BLOCK_DOCS = 128
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts: (text number, hash, times in that text), by text and hash."""
    split = [(t or "").lower().encode().split() for t in texts]
    lens = np.fromiter(map(len, split), np.int64, len(split))
    total = int(lens.sum())
    w = _mix(np.fromiter((crc32(x) for words in split for x in words), _U, total) + _U(0x9E3779B97F4A7C15))
    start = np.cumsum(lens) - lens
    doc = np.repeat(np.arange(len(split)), lens)
    left = np.repeat(start + lens, lens) - np.arange(total)  # words from here to the end of the text
    full = left >= size
    # a short text is one shingle of all its words
    short = np.zeros(total, bool)
    short[start[(lens > 0) & (lens < size)]] = True
    at = np.flatnonzero(full | short)
    h = np.zeros(len(at), _U)
    for k in range(size):
        inside = left[at] > k
        h = np.where(inside, _mix(h * _U(31) + w[np.minimum(at + k, max(0, total - 1))]), h)
    doc = doc[at]
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def shingled(texts: list[str | None], most_chars: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingles`` of a block of texts, some at a time."""
    out, at = [(np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))], 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < most_chars):
            chars += len(texts[end] or "")
            end += 1
        doc, h, times = shingles(texts[at:end])
        out.append((doc + at, h, times))
        at = end
    doc, h, times = (np.concatenate(x) for x in zip(*out))
    return doc, h, times


def numbered(docs: DataFrame, *cols: str) -> DataFrame:
    """``cols`` with _mid and the _block of documents that a row belongs to."""
    return docs.select(*cols, F.monotonically_increasing_id().alias("_mid")).withColumn("_block", F.shiftright("_mid", BLOCK_BITS))


def steady(docs: DataFrame) -> DataFrame:
    """``docs``, with rows in the same partitions and order whenever it is read: after a shuffle they are written first."""
    return cut(docs, "texts") if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def short(counts: np.ndarray) -> bytes:
    """Counts from 1, a byte each; those of 255 and more follow as 32 bits."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return len(counts).to_bytes(4, "little") + small.tobytes() + counts[small == 255].astype("<u4").tobytes()


def unshort(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    small = np.frombuffer(raw, np.uint8, n, 4)
    out = small.astype(np.int64)
    out[small == 255] = np.frombuffer(raw, "<u4", -1, 4 + n)
    return out


def n_ranges(chars: int) -> int:
    return max(32, -(-chars // RANGE_CHARS))


def document_frequencies(docs: DataFrame, text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(block, range, df): of each block's distinct shingles in ascending order the documents of the whole table that have them, as ``short`` writes them.

    A shingle is told from others of its range by 40 bits of its hash; there are at least 32 ranges, and one for each
    RANGE_CHARS of text, so that a range's rows fit in one task's memory however large the table is.
    """
    if ranges is None:
        ranges = n_ranges(docs.agg(F.sum(F.length(text_col))).head()[0] or 0)

    def one(block: int, texts: list[str | None]) -> pa.RecordBatch:
        h, n = np.unique(shingled(texts)[1], return_counts=True)
        low = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        at = np.searchsorted((h >> _U(40)) * _U(ranges) >> _U(24), np.arange(ranges + 1, dtype=_U))
        some = np.flatnonzero(at[1:] > at[:-1])
        own = (n - 1).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), block), pa.int64()), pa.array(some, pa.int32()), pa.array([low[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()), pa.array([own[at[i] : at[i + 1]].tobytes() for i in some], pa.binary())], ["block", "range", "hashes", "n"]
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = -1, []
        for b in slices(batches, text_col, 1 << 20):
            for k, text in zip(b.column("_block").to_pylist(), b.column(text_col).to_pylist()):
                if k != block:
                    if held:
                        yield one(block, held)
                    block, held = k, []
                held.append(text)
        if held:
            yield one(block, held)

    def add(group: pa.Table) -> pa.Table:
        raw = b"".join(group.column("hashes").to_pylist())
        wide = np.zeros((len(raw) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        n = np.frombuffer(b"".join(group.column("n").to_pylist()), np.uint8).astype(np.int64) + 1
        _, at = np.unique(wide.view("<u8")[:, 0], return_inverse=True)
        df = np.bincount(at, n).astype("<u4")[at]
        ends = np.cumsum([len(x) // 5 for x in group.column("hashes").to_pylist()])
        out = pa.table({"block": group.column("block"), "range": group.column("range"), "df": pa.array([short(x) for x in np.split(df, ends[:-1])], pa.binary())})
        give_back()
        return out

    sent = arrow(numbered(docs, text_col), send, "block long, range int, hashes binary, n binary")
    return sent.groupBy("range").applyInArrow(add, "block long, range int, df binary")


def weights(times: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF weights in tenths, 1 to 255; the second factor goes from 1 (in all ``n`` documents) to 2."""
    idf = 1.0 + np.log((1.0 + max(n, 1)) / (1.0 + np.minimum(df, n))) / np.log(1.0 + max(n, 1))
    return np.clip(np.rint((1.0 + np.log(times)) * idf * _SCALE), 1, 255).astype(np.uint8)


def points(h: np.ndarray, q: np.ndarray, until: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Points of shingles with weight q before their time ``until``: (shingle number, draw, time, identity).

    On each unit of a shingle's weight lies a Poisson process of rate ``k``, and every point belongs to one of ``k`` draws.
    The points follow from the hash alone; weight and time only say which of them are looked at.
    """
    for lo, hi in zip(_EDGES, _EDGES[1:]):
        at = np.flatnonzero(q > lo)
        base, time, limit = _mix(h[at] ^ _U(0xD1B54A32D192ED03 * (lo + 1) % (1 << 64))), np.zeros(len(at)), until[at] * (k * (hi - lo))
        done, some = 0, 1
        while len(at):
            key = _mix(base[:, None] + np.arange(done + 1, done + some + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
            gaps = -np.log(((key >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53))
            gaps[:, 0] += time
            times = np.cumsum(gaps, axis=1)
            early = times < limit[:, None]
            row, col = np.nonzero(early)
            sample = _mix(key[row, col] ^ _U(0x94D049BB133111EB))
            level = lo + ((sample >> _U(40)) * _U(hi - lo) >> _U(24)).astype(np.int64)
            own = level < q[at[row]]
            row, sample = row[own], sample[own]
            draw = ((sample & _U(0xFFFFFFFF)) * _U(k) >> _U(32)).astype(np.int64)
            yield at[row], draw, times[row, col[own]] / (k * (hi - lo)), sample
            live = early[:, -1]
            at, base, time, limit = at[live], base[live], times[live, -1], limit[live]
            done, some = done + some, max(some, done)


def sketches(doc: np.ndarray, h: np.ndarray, q: np.ndarray, n: int, k: int) -> np.ndarray:
    """[text, draw]: the earliest point of each draw over all weight of each of ``n`` texts.  A text without shingles gets zeros."""
    best, out = np.full(n * k, np.inf), np.zeros(n * k, _U)
    mass = np.bincount(doc, q, n)
    # a draw has no point before this time with probability exp(-3) / k
    until = (np.log(k) + 3.0) / np.maximum(mass, 1.0)
    open_ = mass > 0
    while open_.any():
        own = np.flatnonzero(open_[doc])
        found = [(doc[own[i]] * k + draw, time, sample) for i, draw, time, sample in points(h[own], q[own], until[doc[own]], k)]
        cell, time, sample = (np.concatenate(x) for x in zip(*found))
        np.minimum.at(best, cell, time)
        first = time == best[cell]
        np.maximum.at(out, cell[first], sample[first])
        open_ &= np.isinf(best).reshape(n, k).any(1)
        until[open_] *= 2.0
    return out.reshape(n, k)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(sketch), bands), _U) + np.arange(1, bands + 1, dtype=_U)
    for r in range(rows):
        key = _mix(key * _U(31) + sketch[:, r * bands : (r + 1) * bands])
    return key.view(np.int64)


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Of two vectors: distinct ascending 32-bit hashes, then as many weights."""
    (ha, wa), (hb, wb) = _vector(a), _vector(b)
    total = int(wa.sum()) + int(wb.sum())
    if not len(ha) or not len(hb):
        return 0.0
    i = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    same = hb[i] == ha
    both = int(np.minimum(wa[same], wb[i[same]]).sum())
    return both / (total - both)


def _vector(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 5
    return np.frombuffer(raw, "<u4", n), np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.int64)


def vectors(doc: np.ndarray, h: np.ndarray, q: np.ndarray, n: int) -> list[bytes]:
    """Stored form of each text's weighted shingles; the odd pair of one text that shares 32 bits is merged."""
    bounds = np.searchsorted(doc, np.arange(n + 1))
    low = (h & _U(0xFFFFFFFF)).astype("<u4")
    out = []
    for i in range(n):
        own, w = low[bounds[i] : bounds[i + 1]], q[bounds[i] : bounds[i + 1]]
        own, at = np.unique(own, return_index=True)
        out.append(own.tobytes() + w[at].tobytes())
    return out


def signed(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, _mid, digest of the text; and for the first row of a text in its block: bands and vector."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = steady(docs.select(id_col, text_col))
    n, chars = docs.agg(F.count("*"), F.sum(F.length(text_col))).head()

    def kernel(block: pa.Table, counts: pa.Table) -> pa.Table:
        block = block.sort_by("_mid")
        texts = block.column(text_col).to_pylist()
        digests = [hashlib.sha256((t or "").encode()).digest()[:16] for t in texts]
        first: dict[bytes, int] = {}
        for i, d in enumerate(digests):
            first.setdefault(d, i)
        fresh = {i: j for j, i in enumerate(first.values())}
        doc, h, times = shingled([texts[i] for i in fresh])
        df = np.concatenate([np.zeros(0, np.int64), *map(unshort, counts.sort_by("range").column("df").to_pylist())])
        distinct = np.unique(h)
        if len(distinct) != len(df):
            raise ValueError("a block of documents was read in two ways")
        q = weights(times, df[np.searchsorted(distinct, h)], n)
        keys = np.zeros((len(fresh), bands), np.int64)
        for lo in range(0, len(fresh), TOGETHER):
            hi = min(lo + TOGETHER, len(fresh))
            i, j = np.searchsorted(doc, (lo, hi))
            keys[lo:hi] = band_keys(sketches(doc[i:j] - lo, h[i:j], q[i:j], hi - lo, bands * rows), bands, rows)
        mass = np.bincount(doc, q, len(fresh)).astype(np.int64)
        vec = vectors(doc, h, q, len(fresh))
        at = [fresh.get(i, -1) for i in range(len(texts))]
        cols = [
            block.column(id_col),
            block.column("_mid"),
            pa.array(digests, pa.binary()),
            # a text without words meets no other
            pa.array([None if j < 0 else keys[j] if mass[j] else [] for j in at], pa.list_(pa.int64())),
            pa.array([None if j < 0 else vec[j] for j in at], pa.binary()),
        ]
        out = pa.table(cols, names=[id_col, "_mid", "digest", "bands", "vector"])
        give_back()
        return out

    counted = document_frequencies(docs, text_col, n_ranges(chars or 0)).groupBy("block")
    return numbered(docs, id_col, text_col).groupBy("_block").cogroup(counted).applyInArrow(kernel, f"`{id_col}` {kind}, _mid long, digest binary, bands array<long>, vector binary")


def verified(pairs: DataFrame, involved: DataFrame) -> DataFrame:
    """(a, b, j): exact weighted Jaccard similarity of each pair."""
    full = pairs.join(involved.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a").join(involved.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, "va"):
            got = [weighted_jaccard(p, q) for p, q in zip(x.column("va").to_pylist(), x.column("vb").to_pylist())]
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(got, pa.float64())], ["a", "b", "j"])

    return arrow(full.select("a", "b", "va", "vb"), compare, "a long, b long, j double")


def block_links(clusters: DataFrame, comp: DataFrame, involved: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join components within each cluster (node, component: the cluster's name), enough of them to join all that belong together.

    A cluster is dealt to blocks of about BLOCK_DOCS; every pair of its blocks is one small group, compared by matrix, so
    no pair becomes a row, and a group gives fewer links than it has documents.
    """
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("n"))
    rows = clusters.withColumnRenamed("component", "cluster").join(sizes.withColumnRenamed("component", "cluster"), "cluster")
    rows = rows.join(comp, "node", "left").select("cluster", "node", F.coalesce("component", "node").alias("component"), F.pmod(F.xxhash64("node"), "n").cast("int").alias("block"), "n")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "component").join(involved, "node")

    def compare(group: pa.Table) -> pa.Table:
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        block, node, component = (group.column(c).to_numpy() for c in ("block", "node", "component"))
        parts = [_vector(raw) for raw in group.column("vector").to_pylist()]
        mass = np.array([w.sum() for _, w in parts])
        xs, ys = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        names, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        cols = np.split(at, np.cumsum([len(h) for h, _ in parts])[:-1])
        top: dict[int, int] = {int(c): int(c) for c in component}

        def find(c: int) -> int:
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        out: list[tuple[int, int]] = []
        step = max(1, (32 << 20) // max(1, len(names)))
        for i in range(0, len(ys), step):
            some = ys[i : i + step]
            dense = np.zeros((len(some), len(names)), np.uint8)
            for k, y in enumerate(some):
                dense[k, cols[y]] = parts[y][1]
            for x in xs:
                both = np.minimum(dense[:, cols[x]], parts[x][1].astype(np.uint8)).sum(1, dtype=np.int64)
                near = both >= least * (mass[some] + mass[x] - both)
                for y in some[near & (component[some] != component[x])]:
                    p, q = find(int(component[x])), find(int(component[y]))
                    if p != q:
                        top[max(p, q)] = min(p, q)
                        out.append((int(node[x]), int(node[y])))
        del parts, names, at, cols
        give_back()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("cluster", "lo", "hi").applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, digest, class_id and whether it is the row kept of its class."""
    signed_ = cut(signed(docs, bands, rows, id_col, text_col), "signed")
    nodes = cut(signed_.groupBy("digest").agg(F.min("_mid").alias("node"), F.min_by(id_col, "_mid").alias("_id")), "nodes")
    # the first row of a text is also first in its block, so it has bands and a vector
    own = signed_.filter(F.col("bands").isNotNull()).select(F.col("_mid").alias("node"), "bands", "vector")
    dealt = cut(own.select("node", "bands").join(nodes.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("key")), "bands")
    shared = dealt.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    met = cut(dealt.join(shared, "key"), "met")
    release(dealt)
    meeting = cut(met.select("node").distinct(), "meeting")
    # vectors of texts that meet no other are not shuffled
    likely, _ = told_apart(own.select("node", "vector"), [F.col("node")], meeting, [F.col("node")])
    involved = cut(likely.join(meeting, "node", "left_semi"), "involved")
    release(meeting)
    rows_ = cut(signed_.select(id_col, "_mid", "digest"), "rows")
    release(signed_)
    first = cut(verified(met.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), involved), "first")
    links = first.filter(F.col("j") >= least).select("a", "b")
    found = components(links)
    comp = cut(found, "components")
    release(found)
    # bands of three or more that still hold several components: what they chain together is compared in blocks
    named = met.filter("size > 2").join(comp, "node", "left").select("key", "node", "leader", F.coalesce("component", "node").alias("component"))
    several = named.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo <> _hi").select("key")
    left = cut(named.join(several, "key").filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "left")
    release(met)
    chains = components(left)
    second = cut(block_links(chains, comp, involved, least), "second")
    release(chains, left, involved)
    if not second.isEmpty():
        found, before = components(links.unionByName(second)), comp
        comp = cut(found, "components")
        release(found, before)
    release(first, second)
    top = nodes.select(F.col("node").alias("component"), F.col("_id").alias("_class"))
    # only nodes with links have another name than their own
    linked = comp.join(top, "component").select(F.col("node").alias("_n"), "component", "_class")
    of = cut(nodes.join(linked, F.col("node") == F.col("_n"), "left").select(F.col("digest").alias("_d"), F.coalesce("component", "node").alias("_top"), F.when(F.col("component").isNull(), F.col("_id")).otherwise(F.col("_class")).alias("class_id")), "classes")
    release(nodes, comp)
    return rows_.join(of, F.col("digest") == F.col("_d")).select(id_col, "digest", "class_id", (F.col("_mid") == F.col("_top")).alias("kept"))


#: Bits of the table of hashes that ``told_apart`` broadcasts: at most 2**20 words of 64 bits, whatever the input.
HASH_BITS = 26


def told_apart(rows: DataFrame, key: list[Column], keys: DataFrame, of: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be one of ``keys``, and those whose key is none of them; nothing of ``rows`` is shuffled.

    ``keys`` are hashed into a bounded table of bits.  Once that is too full to tell rows apart, more of them are in the
    first part, so what follows must look at them exactly.
    """
    word, set_ = unused(rows, "_word", "_set")

    def bits(x: list[Column]) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*x), 64 - HASH_BITS)

    at = bits(of)
    each = keys.select(F.shiftright(at, 6).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("_bit"))
    # at most 2 ** (HASH_BITS - 6) rows
    words = cut(each.groupBy(word).agg(F.bit_or("_bit").alias(set_)), "words")
    at = bits(key)
    told = rows.join(F.broadcast(words), F.shiftright(at, 6) == words[word], "left")
    may = F.coalesce(F.getbit(F.col(set_), at.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return told.filter(may).drop(word, set_), told.filter(~may).drop(word, set_)


def keep(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, all columns as they are.

    Most rows stay and are not shuffled: a bounded table of hash bits tells them from the rows that may have to go.  Only
    those, and the few whose bit is set by another row, meet the decisions by a join.  Once the table is too full to tell
    them apart, more rows take the join, with the same result.
    """
    decided = classes(docs, least, id_col=id_col, text_col=text_col)
    # a pair of id and text with a row that goes; `_stays` where another row of the same pair is the one kept
    pairs = cut(decided.groupBy(F.col(id_col).alias("_i"), "digest").agg(F.max("kept").alias("_stays"), F.min("kept").alias("_all")).filter("NOT _all").select("_i", "digest", "_stays"), "going")

    digest_, i_, d_, stays = unused(docs, "_digest", "_i", "_d", "_stays")
    digest = F.upper(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32))
    doubtful, clear = told_apart(docs.withColumn(digest_, digest), [F.col(id_col), F.col(digest_)], pairs, [F.col("_i"), F.hex("digest")])
    doubtful = cut(doubtful, "doubtful")
    going = pairs.select(F.col("_i").alias(i_), F.hex("digest").alias(d_), F.col("_stays").alias(stays))
    met = doubtful.join(going, F.col(id_col).eqNullSafe(F.col(i_)) & (F.col(digest_) == F.col(d_)), "left")
    free = met.filter(F.col(stays).isNull())
    # rows that repeat an id and its text are told apart by neither: one of them stays
    one = met.filter(F.col(stays)).dropDuplicates([id_col, digest_])
    own = [F.col(quoted(c)) for c in docs.columns]
    return clear.select(own).unionByName(free.select(own)).unionByName(one.select(own))
