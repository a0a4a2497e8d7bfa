"""Document fingerprints by spot signatures (operator 3).

Anchors are the commonest words of the corpus by document frequency, counted over every document.  Each anchor starts a
signature: the anchor and the chain of the next content words (words that aren't anchors).  A fingerprint is the set of
a text's signatures.  Fingerprints are compared by Jaccard similarity; a pair whose set sizes alone rule out the wanted
similarity isn't compared, and a comparison stops once the rest can't reach it.

Defined cases: a null text is the empty one; a text without a signature has one for its whole word sequence, so equal
texts always have equal fingerprints; rows are taken by descending id, null ids last, equal ids by text; repeated rows
are documents of their own; a single document is its own successor; an empty table gives no rows; further columns are ignored;
a text is fingerprinted whole, however long.  Rows with one and the same id are one range, which one task sorts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, slices

ANCHORS, CHAIN = 64, 2
#: Characters of text for each task that compares successors; how finely ids are split at most (a driver's list of a few MB).
CHARS_A_TASK, MOST_ACCURACY = 32 << 20, 1_000_000
#: Distinct words that a counting task holds before it hands on its counts.
WORDS_HELD = 400_000
_BARE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates like white space."""
    return text.lower().encode().translate(_BARE).split()


def anchors(docs: DataFrame, n: int = ANCHORS, text_col: str = "text") -> list[bytes]:
    """The ``n`` words that occur in most documents, ties by the word."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in slices(batches, text_col):
            for text in b.column(text_col).to_pylist():
                held.update(set(words_of(text or "")))
                if len(held) > WORDS_HELD:
                    yield hand_on()
        if held:
            yield hand_on()

    counts = arrow(docs.select(text_col), kernel, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(n).collect()]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(text: str, common: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit spot signatures.  common: sorted CRC-32 of the anchors."""
    words = words_of(text)
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    if len(h):
        at = np.searchsorted(common, h)
        is_anchor = common[np.minimum(at, len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)
        content = np.flatnonzero(~is_anchor)
        starts = np.flatnonzero(is_anchor)
        first = np.searchsorted(content, starts)
        fits = first + chain <= len(content)
        starts, first = starts[fits], first[fits]
        if len(starts):
            sig = _mix(h[starts])
            for k in range(chain):
                sig = _mix(sig * np.uint64(31) + h[content[first + k]])
            return np.unique((sig >> np.uint64(32)).astype(np.uint32))
    whole = hashlib.sha256(b" ".join(words)).digest()
    return np.frombuffer(whole[:4], "<u4").copy()


def shown(sig: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits for each signature, in ascending order."""
    return sig.astype(">u4").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets, or 0.0 where it is below ``least``; sizes alone may show that."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large) or len(small) < least * len(large):
        return 0.0
    i = np.searchsorted(large, small)
    both = int((large[np.minimum(i, len(large) - 1)] == small).sum())
    j = both / (len(a) + len(b) - both)
    return j if j >= least else 0.0


def length_classes(n: int, least: float) -> tuple[int, int]:
    """The partition of a set of ``n`` signatures, and the last partition of partners at least as large that can be similar enough."""
    import math

    def cls(x: float) -> int:
        return int(math.floor(math.log(max(x, 1.0)) / -math.log(least) + 1e-9))

    return cls(n), cls(n / least)


def similar_pairs(prints: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """(a, b, likeness) of all pairs of distinct fingerprints of ``prints`` (id_col, fingerprint) with likeness of at least ``least``.

    Ids that share a fingerprint are one class, named by its smallest id.  Sets are partitioned by length; a set meets
    its own and following partitions only as far as ``least`` lets it, and there only sets that share one of the rare
    signatures that any partner must share (a set of n needs one of its n - ceil(least * n) + 1 rarest).
    """
    one = prints.groupBy("fingerprint").agg(F.min(id_col).alias("id"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "fingerprint"):
            ids, keys, sides = [], [], []
            for k, (i, f) in enumerate(zip(b.column("id").to_pylist(), b.column("fingerprint").to_pylist())):
                sig = parsed(f)
                # a fixed random order stands for rarity: signatures are spread evenly
                order = np.argsort(_mix(sig.astype(np.uint64)), kind="stable")
                head = sig[order[: len(sig) - int(np.ceil(least * len(sig))) + 1]].astype(np.int64)
                own, last = length_classes(len(sig), least)
                for c in range(own, last + 1):
                    # side 0 looks for partners in partition c; side 1 stands in its own
                    for side in (0, 1) if c == own else (0,):
                        ids += [i] * len(head)
                        keys += (head * 4096 + c).tolist()
                        sides += [side] * len(head)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sides, pa.int8())], ["id", "key", "side"])

    heads = arrow(one, parts, "id long, key long, side byte")
    a = heads.filter("side = 0").select(F.col("id").alias("a"), "key")
    b = heads.filter("side = 1").select(F.col("id").alias("b"), "key")
    met = a.join(b, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = met.join(one.select(F.col("id").alias("a"), F.col("fingerprint").alias("fa")), "a").join(one.select(F.col("id").alias("b"), F.col("fingerprint").alias("fb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, "fa"):
            got = [likeness(parsed(p), parsed(q), least) for p, q in zip(x.column("fa").to_pylist(), x.column("fb").to_pylist())]
            out = pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(got, pa.float64())], ["a", "b", "likeness"])
            yield out.filter(pa.array([g > 0 for g in got], pa.bool_()))

    return arrow(full.select("a", "b", "fa", "fb"), compare, "a long, b long, likeness double")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of ``following``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_LOW = -(1 << 63)


def compare_successors(docs: DataFrame, n_anchors: int = ANCHORS, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and the likeness to that and to the next document's.

    The next document is the next by descending id.  Ids are dealt into ranges; a range's tasks also get the first row of
    the range below (of the topmost range, for the lowest), so each row finds its successor where it is, and texts are
    shuffled once.
    """
    spark = docs.sparkSession
    common = np.unique(np.array([crc32(w) for w in anchors(docs, n_anchors, text_col)], np.uint64))
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("_k"))
    # tasks follow the input, so that what one of them reads doesn't
    chars = docs.agg(F.sum(F.length(text_col))).head()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-chars // CHARS_A_TASK))
    n = 4 * tasks
    splits = ids.agg(F.percentile_approx("_k", [k / n for k in range(1, n)], min(100 * n, MOST_ACCURACY))).head()[0]
    splits = np.unique(np.array(splits or [], np.int64))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for b in batches:
            k = b.column("_k").to_numpy()
            r = np.searchsorted(splits, k, "left")
            order = np.lexsort((k, r))
            r, k = r[order], k[order]
            last = np.flatnonzero(np.append(r[1:] != r[:-1], True)) if len(r) else []
            for i in last:
                top[int(r[i])] = max(top.get(int(r[i]), _LOW), int(k[i]))
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array(list(top.values()), pa.int64())], ["r", "k"])

    # one row for each range that has rows
    first = {row["r"]: row["k"] for row in arrow(ids, heads, "r long, k long").groupBy("r").agg(F.max("k").alias("k")).collect()}
    ranges = sorted(first)
    # who also needs the first row of a range: the range above it; the lowest needs the topmost's
    guest_of = {first[r]: ranges[(i + 1) % len(ranges)] if i + 1 < len(ranges) else ranges[0] for i, r in enumerate(ranges)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, 16 << 20):
            k = b.column("_k").to_numpy()
            out = b.append_column("_range", pa.array(np.searchsorted(splits, k, "left"), pa.int64())).append_column("_guest", pa.array(np.zeros(len(k), np.int8)))
            yield out
            i = [j for j, x in enumerate(k.tolist()) if x in guest_of]
            if i:
                g = b.take(pa.array(i))
                yield g.append_column("_range", pa.array([guest_of[x] for x in k[i].tolist()], pa.int64())).append_column("_guest", pa.array(np.ones(len(i), np.int8)))

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    dealt = arrow(rows, deal, f"_k long, `{text_col}` string, _range long, _guest byte").repartition(tasks, "_range").sortWithinPartitions("_range", "_guest", F.desc("_k"), text_col)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: (range, guest, key, text, signatures)
        for b in slices(batches, text_col):
            out: list[tuple] = []
            for k, text, r, guest in zip(*(b.column(c).to_pylist() for c in ("_k", text_col, "_range", "_guest"))):
                if guest and held and held[0] == r and held[1]:
                    continue  # further rows with the first row's id
                sig = signatures(text, common, chain)
                if held and held[0] == r and not held[1]:
                    p_text, p_sig = held[3], held[4]
                    changed = edited(p_text, text)
                    e_sig = signatures(changed, common, chain)
                    out.append((None if held[2] == _LOW else held[2], len(p_text), hashlib.sha256(changed.encode()).hexdigest(), shown(p_sig), shown(e_sig), likeness(p_sig, e_sig), likeness(p_sig, sig)))
                held = (r, guest, k, text, sig)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return arrow(dealt, prints, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
