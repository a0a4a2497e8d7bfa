"""Sequence packing by shortest-pack-first over the length histogram (operator 6).

1. Every document is encoded where it is read; its ids plus the closing id are cut into full sequences and a rest.
   Only narrow piece rows leave the task, each with its rank among the equally long pieces of its scan partition.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to the driver, where packs are planned as *patterns*
   with counts: longest length first, always into the shortest open pattern that still has room.  The plan's size
   depends on ``capacity`` alone: a length adds at most two patterns.
3. A piece finds its pattern by its length and global rank among that length, by binary search in the plan.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed each on its own; equal lengths are
ranked by where they were read; an empty table gives no rows; further columns are ignored; a text is encoded whole and cut
into as many pieces as it needs, however long.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import arrow, cut, gapless, slices


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns [(count, lengths)] that hold ``histogram[length]`` pieces of every length, none longer than ``capacity``."""
    open_: list[tuple[int, int, int, list[int]]] = []  # (tokens, tie, count, lengths), shortest first
    full: list[tuple[int, list[int]]] = []
    tie = 0
    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        left, grown = histogram[length], []
        while left:
            if open_ and open_[0][0] + length <= capacity:
                tokens, _, count, lengths = heapq.heappop(open_)
                take = min(count, left)
                if take < count:
                    heapq.heappush(open_, (tokens, tie := tie + 1, count - take, lengths))
            else:
                tokens, take, lengths = 0, left, []
            left -= take
            new = (tokens + length, tie := tie + 1, take, [*lengths, length])
            if new[0] == capacity:
                full.append((take, new[3]))
            else:
                heapq.heappush(open_, new)
    return full + [(count, lengths) for _, _, count, lengths in sorted(open_)]


class Plan:
    """Where the piece with a given (length, rank) goes."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        rank: dict[int, int] = {}
        rows, sequence = [], 0
        for count, lengths in patterns:
            at = 0
            for length in lengths:
                rows.append((length, rank.get(length, 0), sequence, at))
                rank[length] = rank.get(length, 0) + count
                at += length
            sequence += count
        rows.sort()
        self.n_sequences = sequence
        self.length, self.rank, self.sequence, self.at = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
        self.first = {int(k): int(i) for k, i in zip(*np.unique(self.length, return_index=True))}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        sequence, at = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for k in np.unique(length):
            own = length == k
            lo = self.first[int(k)]
            hi = lo + int(np.searchsorted(self.length[lo:], k, "right"))
            i = lo + np.searchsorted(self.rank[lo:hi], rank[own], "right") - 1
            sequence[own] = self.sequence[i] + rank[own] - self.rank[i]
            at[own] = self.at[i]
        return sequence, at


def pieces(docs: DataFrame, file: str, pattern: str | None, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, with _pid and the piece's _rank among its length there."""
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(file, "tiktoken", pattern) if pattern else bpe.encoder(file, special=True)
        seen = np.zeros(capacity + 1, np.int64)
        closing = np.array([end_id], "<u4").tobytes()
        for b in slices(batches, text_col, bpe.BATCH_BYTES):
            ids, at = enc.batch(b.column(text_col))
            raw, n = memoryview(ids.astype("<u4").tobytes()), np.diff(at) + 1
            each = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), each)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * capacity
            length = np.minimum(capacity, n[row] - start)
            last = start + length == n[row]
            lo = 4 * (at[row] + start)
            hi = lo + 4 * (length - last)
            crc = [zlib.crc32(closing, zlib.crc32(raw[i:j])) if z else zlib.crc32(raw[i:j]) for i, j, z in zip(lo.tolist(), hi.tolist(), last.tolist())]
            order = np.argsort(length, kind="stable")
            runs = length[order]
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.searchsorted(runs, runs, "left") + seen[runs]
            seen += np.bincount(length, minlength=capacity + 1)
            cols = [b.column("_pid").take(pa.array(row)), b.column(id_col).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in (start, length, crc, n[row], rank))]
            yield pa.RecordBatch.from_arrays(cols, ["_pid", id_col, "start", "length", "ids_crc32", "doc_tokens", "_rank"])

    return arrow(docs.select(F.spark_partition_id().alias("_pid"), id_col, text_col), kernel, f"_pid int, `{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, _rank long")


def pack(docs: DataFrame, file: str, pattern: str | None = None, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pieces`` of all documents with sequence_id and offset.  Ids are closed by ``end_id``.

    ``file``: a tokenizers file, whose special tokens in a text have their ids; or with ``pattern`` ranks for tiktoken, to
    which they are ordinary text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = cut(pieces(docs, file, pattern, capacity, end_id, id_col, text_col), "pieces")
    # at most `capacity` rows, whatever the input
    plan = Plan(shortest_pack_first({r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity))
    ranked = gapless(found, "length", "_rank", "_global")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, at = plan.find(b.column("length").to_numpy(), b.column("_global").to_numpy())
            cols = [b.column(c) for c in (id_col, "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(at)], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return arrow(ranked.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "_global"), kernel, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
