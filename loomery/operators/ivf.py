"""Near neighbours by an inverted file: vectors in cells around coarse centres, of which a search opens a few.

Centres are fitted by k-means on a sample of at most ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` bytes (those with the least
hash of their id); every row is then put into the cell of its nearest centre, wherever it lies.  Rows are files partitioned
by cell, large cells in several files, so a search reads its cells alone.  There are at most ``MAX_CELLS`` centres, which
travel to tasks in their closure.

A search opens the ``probes`` nearest cells; how many reach ``TARGET`` of the nearest rows is measured on the sample at the
build and kept (vectors without clusters need many).  An exact one then also opens each cell that may hold a row nearer than the
k-th found: by the triangle inequality none does whose centre is farther than that distance and the cell's radius together.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomery.functions import vectors as V

SAMPLE_ROWS, SAMPLE_BYTES, MAX_CELLS, ROUNDS = 65_536, 64 << 20, 4_096, 12
#: Share of the ``NEAREST`` rows that the kept number of probes finds for ``ASKED`` sampled rows among the sample.
TARGET, NEAREST, ASKED = 0.98, 10, 256
#: Sampled rows a centre is fitted on at least.
ROWS_A_CELL = 8
#: Distances that a task computes at once.
AT_ONCE = 1 << 22
#: Bytes of rows, and of queries, that meet in a task (as doubles).
TILE_BYTES = 16 << 20
#: Part of the distances by which an exact search goes beyond its bound, for rounding.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` has the vectors' columns, ``cell`` and ``away`` (distance to the centre); the others are by cell."""

    rows: DataFrame
    centres: np.ndarray
    counts: np.ndarray
    radii: np.ndarray
    id_col: str
    col: str
    probes: int


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """k-means centres: the first by distance-weighted draws with a fixed seed, then ROUNDS rounds; an empty cell keeps its centre."""
    draw = np.random.default_rng(0)
    cells = max(1, min(cells, len(sample)))
    chosen = [int(draw.integers(len(sample)))]
    squares = (sample * sample).sum(axis=1)

    def to(k: int) -> np.ndarray:
        d = squares - 2 * (sample @ sample[k]) + squares[k]
        # equal rows: no distance but rounding
        return np.where(d > 1e-12 * (squares + squares[k]), d, 0.0)

    near = to(chosen[0])
    while len(chosen) < cells:
        total = near.sum()
        if total <= 0:  # fewer different rows than cells
            break
        chosen.append(int(np.searchsorted(np.cumsum(near), draw.random() * total).clip(0, len(sample) - 1)))
        near = np.minimum(near, to(chosen[-1]))
    centres = sample[chosen].copy()
    step = max(1, AT_ONCE // len(centres))
    for _ in range(ROUNDS):
        own = np.concatenate([_squares(sample[i : i + step], centres).argmin(axis=1) for i in range(0, len(sample), step)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray) -> int:
    """The least number of cells that holds TARGET of the NEAREST rows of some sampled rows, all within the sample."""
    asked = sample[:ASKED]
    own = np.concatenate([_squares(sample[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(sample), 4096)])
    found = []
    for q in asked:
        near = np.argsort(((sample - q) ** 2).sum(axis=1), kind="stable")[:NEAREST]
        place = np.empty(len(centres), np.int64)
        place[np.argsort(((centres - q) ** 2).sum(axis=1), kind="stable")] = np.arange(len(centres))
        found += place[own[near]].tolist()
    found.sort()
    return found[max(0, math.ceil(TARGET * len(found)) - 1)] + 1 if found else 1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, col: str, dim: int) -> DataFrame:
    """Rows of this dimension without a null in the vector; others don't count in a search."""
    return vectors.filter((F.size(col) == dim) & ~F.exists(col, lambda x: x.isNull()))


def build(vectors: DataFrame, path: str, dim: int, id_col: str = "vec_id", col: str = "embedding", cells: int | None = None) -> VectorIndex:
    """Write the index of all usable rows below ``path``; ``cells`` is by default the root of their number."""
    spark = vectors.sparkSession
    rows = usable(vectors, col, dim)
    n = rows.count()
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    sample = rows.orderBy(F.xxhash64(id_col), id_col).limit(most).select(col).toArrow().column(col).combine_chunks()
    sample = _matrix(sample) if len(sample) else np.zeros((1, dim))
    centres = fit(sample, min(MAX_CELLS, cells or max(1, math.isqrt(n)), max(1, len(sample) // ROWS_A_CELL)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, AT_ONCE // len(centres))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x = _matrix(part.column(col))
                cell = _squares(x, centres).argmin(axis=1)
                away = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(away)], names=[*part.schema.names, "cell", "away"])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.mapInArrow(assign, f"{schema}, cell int, away double").hint("rebalance", "cell").sortWithinPartitions("cell", "away")
    dealt.write.partitionBy("cell").parquet(f"{path}/rows")
    # at most MAX_CELLS rows
    figures = spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(centres)], "cell int, centre array<double>")
    held = spark.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    figures.join(held, "cell", "left").select("cell", "centre", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius"), F.lit(dealt.schema.json()).alias("schema"), F.lit(probes_for(sample, centres)).alias("probes")).coalesce(1).write.parquet(f"{path}/centres")
    return load(spark, path, id_col, col)


def load(spark: SparkSession, path: str, id_col: str = "vec_id", col: str = "embedding") -> VectorIndex:
    """An index that ``build`` has written."""
    figures = sorted(spark.read.parquet(f"{path}/centres").collect())
    centres, counts, radii = (np.array([r[k] for r in figures]) for k in ("centre", "n", "radius"))
    rows = spark.read.schema(StructType.fromJson(json.loads(figures[0]["schema"]))).parquet(f"{path}/rows")
    return VectorIndex(rows, centres, counts, radii, id_col, col, figures[0]["probes"])


def _distances(index: VectorIndex, query: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Distances to all centres, and the cells that hold rows, nearest first."""
    d = np.sqrt(((index.centres - np.asarray(query, np.float64)) ** 2).sum(axis=1))
    order = np.argsort(d, kind="stable")
    return d, order[index.counts[order] > 0]


def _nearest(index: VectorIndex, cells: Sequence[int], query: Sequence[float], k: int, keep: Column | None) -> DataFrame:
    rows = index.rows.filter(F.col("cell").isin([int(c) for c in cells]))
    if keep is not None:
        rows = rows.filter(keep)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("distance", V.l2(F.col(index.col), q)).orderBy("distance", index.id_col).limit(k)


def search(index: VectorIndex, query: Sequence[float], k: int, probes: int | None = None, keep: Column | None = None, exact: bool = False) -> DataFrame:
    """The k nearest rows of the ``probes`` nearest cells (default: as many as the index keeps), or with ``exact`` of all; ``keep`` filters before the cut."""
    d, order = _distances(index, query)
    first = order[: probes or index.probes]
    if exact and len(first) < len(order):
        # one number: the k-th distance found, if there are k
        found = _nearest(index, first, query, k, keep).agg(F.count("*").alias("n"), F.max("distance").alias("most")).head()
        if found["n"] < k:
            first = order
        else:
            reach = found["most"] * (1 + SLACK) + SLACK
            first = order[d[order] - index.radii[order] <= reach]
    near = _nearest(index, first, query, k, keep)
    return near.withColumn("similarity", V.similarity(F.col("distance")))


def _tiles(index: VectorIndex) -> tuple[np.ndarray, np.ndarray]:
    """The first tile of each cell, and over how many tiles its rows are dealt (one, unless it is large)."""
    n = max(1, TILE_BYTES // (8 * index.centres.shape[1]))
    return (np.cumsum(index.counts) - index.counts) // n, np.maximum(1, -(-index.counts // n))


def _pair_distances(x: np.ndarray, q: np.ndarray, r: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Distance of each pair, added up element by element as ``V.l2`` does."""
    step = max(1, AT_ONCE // (4 * x.shape[1]))
    return np.concatenate([np.sqrt(np.cumsum((x[r[i : i + step]] - q[of[i : i + step]]) ** 2, axis=1)[:, -1]) for i in range(0, len(r), step)] or [np.zeros(0)])


def nearest_in_cells(x: np.ndarray, cell: np.ndarray, place: np.ndarray, q: np.ndarray, opens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows ``x`` (sorted by ``cell``) to each of ``q`` in the cells that it ``opens``, by distance, then ``place``.

    ``opens`` has a column for each different cell in turn.  Distances by matrix products choose candidates, with room for their
    rounding; those are computed exactly.
    """
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    x2, q2 = (x * x).sum(axis=1), (q * q).sum(axis=1)
    room = 4e-15 * (x.shape[1] + 8) * (q2 + x2.max(initial=0.0))
    bound = np.full(len(q), np.inf)
    of, r = np.zeros(0, np.int64), np.zeros(0, np.int64)
    new: list[tuple[np.ndarray, np.ndarray]] = []

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (np.concatenate([old, *(n[i] for n in new)]) for i, old in enumerate((of, r)))
        d = _pair_distances(x, q, b, a)
        order = np.lexsort((place[b], d, a))
        a, b, d = a[order], b[order], d[order]
        own = np.arange(len(a)) - np.searchsorted(a, a, "left")
        last = own == k - 1
        bound[a[last]] = np.fmin(bound[a[last]], d[last] ** 2)
        return a[own < k], b[own < k], d[own < k]

    held = 0
    for j, (lo, hi) in enumerate(zip(first, [*first[1:], len(cell)])):
        asking = np.flatnonzero(opens[:, j])
        step = max(1, AT_ONCE // (2 * max(1, len(asking))))
        for i in range(lo, hi if len(asking) else lo, step):
            rows = x[i : min(hi, i + step)]
            d = q2[asking][:, None] - 2 * (q[asking] @ rows.T) + x2[i : i + len(rows)]
            # what isn't a number stays a candidate
            near = ~(d > (bound + room)[asking][:, None])
            if len(rows) > k and near.sum() > 4 * k * len(asking):
                bound[asking] = np.fmin(bound[asking], np.partition(d, k - 1, axis=1)[:, k - 1] + room[asking])
                near = ~(d > (bound + room)[asking][:, None])
            a, b = np.nonzero(near)
            new.append((asking[a], b + i))
            held += len(a)
            if held > 8 * k * len(q):
                (of, r, _), new, held = best(), [], 0
    return best()


def search_many(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "query_id") -> DataFrame:
    """(query, id, distance, rank) of the k nearest for each row of ``queries`` (``id_col``, index's vector column) in its ``probes`` nearest cells.

    Neighbouring cells are tiles of about TILE_BYTES.  A query goes once to each tile in which it opens a cell, not once to each
    cell, and brings the cells' numbers; a tile's rows meet at most about TILE_BYTES of queries at a time (beyond that, parts
    of the queries meet them separately).  Each meeting leaves k rows a query at most, of which a window takes the k nearest.
    """
    centres, col, alive, dim = index.centres, index.col, index.counts > 0, index.centres.shape[1]
    probes = min(probes or index.probes, int(alive.sum()))
    tile, pieces = _tiles(index)
    cells_in = {t: np.flatnonzero((tile <= t) & (t < tile + pieces) & alive) for t in range(int((tile + pieces).max(initial=0)))}
    kinds, held = dict(queries.dtypes), dict(index.rows.dtypes)
    asked = usable(queries, col, dim).select(F.col(id_col).alias("_q"), F.col(col).alias("_v"))
    parts = max(1, -(-asked.count() * 8 * dim // TILE_BYTES))

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, AT_ONCE // len(centres))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                d = np.where(alive, _squares(_matrix(b.column(1)), centres), np.inf)
                opens = np.zeros(d.shape, bool)
                np.put_along_axis(opens, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
                for t, cells in cells_in.items():
                    own = opens[:, cells]
                    row = np.flatnonzero(own.any(axis=1))
                    if len(row):
                        ends = np.concatenate([[0], np.cumsum(own[row].sum(axis=1))])
                        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells[np.nonzero(own[row])[1]], pa.int32()))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(np.full(len(row), t), pa.int32()), lists], names=["_q", "_v", "_tile", "_cells"])

    def meet(rows: pa.Table, asking: pa.Table) -> pa.Table:
        found = {"query": [], "id": [], "distance": []}
        ids = rows.column("_i").combine_chunks()
        place = np.empty(len(ids), np.int64)
        place[np.array(pc.sort_indices(ids, null_placement="at_start"))] = np.arange(len(ids))
        cell = rows.column("_cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        x, cell, place = _matrix(rows.column("_x").combine_chunks())[order] if len(ids) else np.zeros((0, dim)), cell[order], place[order]
        here = np.unique(cell)
        # a part of the queries has few candidates at a time
        step = max(1, min(512, AT_ONCE // (64 * k)))
        for i in range(0, asking.num_rows if len(ids) else 0, step):
            some = asking.slice(i, step).combine_chunks()
            lists = some.column("_cells").combine_chunks()
            opens = np.zeros((len(lists), len(here)), bool)
            value, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            # another piece of a large cell may have none of its rows here
            at = np.minimum(np.searchsorted(here, value), len(here) - 1)
            known = here[at] == value
            opens[of[known], at[known]] = True
            a, r, d = nearest_in_cells(x, cell, place, _matrix(some.column("_v").combine_chunks()), opens, k)
            found["query"].append(some.column("_q").combine_chunks().take(pa.array(a)))
            found["id"].append(ids.take(pa.array(order[r])))
            found["distance"].append(pa.array(d, pa.float64()))
        kind = {"query": asking.schema.field("_q").type, "id": ids.type, "distance": pa.float64()}
        return pa.table({c: pa.chunked_array(v, kind[c]) for c, v in found.items()})

    asked = asked.mapInArrow(cells_of, f"_q {kinds[id_col]}, _v {kinds[col]}, _tile int, _cells array<int>").withColumn("_part", F.pmod(F.xxhash64("_q"), F.lit(parts)).cast("int"))
    # at most MAX_CELLS numbers
    firsts, dealt = (F.array(*(F.lit(int(v)) for v in x)) for x in (tile, pieces))
    rows = index.rows.select(F.col(index.id_col).alias("_i"), F.col(col).alias("_x"), F.col("cell").alias("_cell"))
    rows = rows.withColumn("_tile", (F.get(firsts, F.col("_cell")) + F.pmod(F.xxhash64("_i"), F.get(dealt, F.col("_cell")))).cast("int"))
    rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    near = rows.groupBy("_tile", "_part").cogroup(asked.groupBy("_tile", "_part")).applyInArrow(meet, f"query {kinds[id_col]}, id {held[index.id_col]}, distance double")
    w = Window.partitionBy("query").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "query_id") -> DataFrame:
    """(queries, wanted, found): of the k nearest of all rows, how many a search of ``probes`` cells finds."""
    every = search_many(index, queries, k, len(index.centres), id_col).select("query", "id")
    some = search_many(index, queries, k, probes, id_col).select(F.col("query").alias("_q"), F.col("id").alias("_i"), F.lit(1).alias("_hit"))
    met = every.join(some, (F.col("query") == F.col("_q")) & (F.col("id") == F.col("_i")), "left")
    return met.agg(F.countDistinct("query").alias("queries"), F.count("*").alias("wanted"), F.count("_hit").alias("found"))
