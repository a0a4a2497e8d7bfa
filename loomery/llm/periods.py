"""Periodic runs of words (operator 13).

A run is a stretch of words with smallest period q and a length of at least ``max(least, 2 * q)`` that no neighbour extends.
Every run holds a Lyndon root: the longest Lyndon word at its place under an order of words or under the reverse of it.  A
stack scanned right to left gives each place the end of its longest Lyndon word under both orders, which makes two
candidates a place; each is extended to both sides, and those long enough are runs.  Suffixes are compared by their longest
common extension: a few words directly, then a binary search over rolling hashes whose answer is verified on the words
themselves, or found anew by them if it was wrong.  An extension already verified for the same distance is carried on.

Each text is scanned whole by itself, so nothing is shuffled; memory is some 200 bytes a word of the longest text.

Defined cases: a null text has no words; a null id is kept and its text is not edited by ``probe``; repeated rows give equal
results; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, slices

#: Words compared one by one before hashes are asked.
NEAR = 8
_PRIME, _BASE = (1 << 61) - 1, 1_000_003_919_237


class Extensions:
    """Longest common extensions of places of one sequence of ids."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.array = np.array(ids, np.int64)
        self._sums: list[int] | None = None
        self._known: dict[int, tuple[int, int]] = {}

    def _hashes(self) -> tuple[list[int], list[int]]:
        if self._sums is None:
            self._sums = list(accumulate(self.ids, lambda h, v: (h * _BASE + v + 1) % _PRIME, initial=0))
            self._powers = list(accumulate(repeat(_BASE, self.n), lambda a, b: a * b % _PRIME, initial=1))
        return self._sums, self._powers

    def _search(self, i: int, j: int, low: int, high: int, back: bool) -> int:
        """The greatest length whose hashes agree, from i and j on or back from them."""
        sums, powers = self._hashes()
        while low < high:
            size = (low + high + 1) // 2
            a, b = (i - size, j - size) if back else (i, j)
            if (sums[a + size] - sums[b + size] - (sums[a] - sums[b]) * powers[size]) % _PRIME:
                high = size - 1
            else:
                low = size
        return low

    def _words(self, i: int, j: int, most: int, back: bool) -> int:
        """The common extension by the words alone, in blocks that double."""
        done, block = 0, 64
        while done < most:
            step = min(block, most - done)
            if back:
                same = self.array[i - done - step : i - done][::-1] == self.array[j - done - step : j - done][::-1]
            else:
                same = self.array[i + done : i + done + step] == self.array[j + done : j + done + step]
            if not same.all():
                return done + int(same.argmin())
            done, block = done + step, 2 * block
        return most

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on (i < j)."""
        ids, most = self.ids, self.n - j
        size, near = 0, min(NEAR, most)
        while size < near and ids[i + size] == ids[j + size]:
            size += 1
        if size < near or size == most:
            return size
        d = j - i
        at, known = self._known.get(d, (-1, 0))
        if at <= i <= at + known:
            return at + known - i
        gap = at - i if at > i else most
        if gap <= NEAR:
            # the next verified stretch of this distance begins within the words just compared
            size = gap + known
        else:
            size = self._search(i, j, size, most, False)
            direct = min(gap, size)
            right = np.array_equal(self.array[i : i + direct], self.array[j : j + direct])
            if not right or (size > gap and size != gap + known) or (size <= gap and size < most and ids[i + size] == ids[j + size]):
                size = self._words(i, j, most, False)
        self._known[d] = (i, size)
        return size

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j (i < j)."""
        ids = self.ids
        size, near = 0, min(NEAR, i)
        while size < near and ids[i - 1 - size] == ids[j - 1 - size]:
            size += 1
        if size < near or size == i:
            return size
        size = self._search(i, j, size, i, True)
        if not np.array_equal(self.array[i - size : i], self.array[j - size : j]) or (size < i and ids[i - size - 1] == ids[j - size - 1]):
            size = self._words(i, j, i, True)
        return size


def lyndon_ends(keys: list[int], common: Extensions) -> list[int]:
    """Where the longest Lyndon word that begins at each place ends: the next smaller suffix, the end being smallest."""
    n = len(keys)
    ends, stack, right = [n] * n, [n], common.right
    for i in range(n - 1, -1, -1):
        x, top = keys[i], stack[-1]
        while top < n:
            y = keys[top]
            if y < x:
                break
            if y == x:
                size = right(i, top)
                if top + size == n or keys[top + size] < keys[i + size]:
                    break
            stack.pop()
            top = stack[-1]
        ends[i] = top
        stack.append(i)
    return ends


def runs(ids: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words, by start, then period."""
    n = len(ids)
    if n < max(least, 2):
        return []
    common, found = Extensions(ids), set()
    # a run with period p has max(least - p, p) pairs of equal words p apart, so it has this many on one side of its root
    side = max(1, -(-((least + 1) // 2) // 2))
    padded = np.concatenate([np.full(side, -1), common.array, np.full(side, -2)])
    places = np.arange(n) + side
    for keys in (ids, [-x for x in ids]):
        ends = lyndon_ends(keys, common)
        others = np.array(ends) + side
        after, before = np.ones(n, bool), np.ones(n, bool)
        for k in range(side):
            after &= padded[places + k] == padded[others + k]
            before &= padded[places - 1 - k] == padded[others - 1 - k]
        last: dict[int, tuple[int, int]] = {}
        for i in np.flatnonzero(after | before)[::-1].tolist():
            j = ends[i]
            p = j - i
            start, end = last.get(p, (n, 0))
            if start <= i and j <= end:
                continue
            start, end = i - common.left(i, j), j + common.right(i, j)
            last[p] = (start, end)
            if end - start >= max(least, 2 * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def probe(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of every tenth id (by its checksum), made periodic from some place on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    return words[:at] + (words[at : at + period] * (-(-(n - at) // period)))[: n - at]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def find(docs: DataFrame, least: int = 12, edit: bool = False) -> DataFrame:
    """For each document its id, number of words, runs and the text without the repeats (words joined by one blank).

    With ``edit`` the words are those that ``probe`` makes of them.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, counts, all_runs, texts = b.column("doc_id").to_pylist(), [], [], []
            for doc_id, text in zip(ids, b.column("text").cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if edit:
                    words = probe(doc_id, words)
                number: dict[bytes, int] = {}
                found = runs([number.setdefault(w, len(number)) for w in words], least)
                if found:
                    stays = kept(len(words), found)
                    counts.append(len(words))
                    words = [words[k] for k in np.flatnonzero(stays).tolist()]
                else:
                    counts.append(len(words))
                all_runs.append([{"start": s, "length": size, "period": p} for s, size, p in found])
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(all_runs, _SCHEMA.field("runs").type), pa.array(texts, pa.string())], schema=_SCHEMA)

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), kernel, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one (ties: smallest start, then period) and digests of all runs and of the text without repeats."""
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return find(docs, edit=True).withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
