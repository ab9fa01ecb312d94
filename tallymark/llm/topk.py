"""Exact top-k search by inner product.

Queries and candidates are dealt to blocks by content and packed into tiles. Each pair of a block of queries and a
block of candidates is a cell, the work of one task: it holds the cell's queries with their best ``k`` so far and
streams the candidates past them as matrix products. Spark merges the cells' lists by query. Nothing is joined, so
nothing is broadcast, and the grid of cells follows the counted rows.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, release, table

TILE = "tile_block int, tile_ids binary, tile_values binary, tile_dim int"
#: At most so many components of a cell's queries (with their lists), which a task holds, of its candidates, which pass by, and of a tile.
HELD, PASSING, PACKED = 1 << 22, 1 << 26, 1 << 18
#: Pairs of a cell: fewer are not worth a task, more take too long.
FEW, MANY = 1 << 27, 1 << 33
#: Columns of scores of which the best is looked at first.
FOLDS = 16
#: A score that no entry of a list has.
NONE = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    """Whether a vector is not null and has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """``matrix`` in the fewest bytes that hold it."""
    low, high = (int(matrix.min()), int(matrix.max())) if matrix.size else (0, 0)
    return matrix.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _tiles(rows: DataFrame, blocks: int, size: int) -> DataFrame:
    """``rows(id, values array<bigint>)``, dealt to ``blocks`` by content, as tiles of at most ``size`` vectors of one block and dimension, sorted by id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, block = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("id", "block"))
            values, ends = batch.column("values"), np.cumsum(pc.list_value_length(batch.column("values")).to_numpy())
            flat = values.flatten().to_numpy().astype(np.int64)
            dims = np.diff(ends, prepend=0)
            order = np.lexsort((ids, block, dims))
            out: list[tuple[int, bytes, bytes, int]] = []
            for at in np.split(order, np.flatnonzero(np.diff(dims[order]) | np.diff(block[order])) + 1) if len(order) else []:
                dim = int(dims[at[0]])
                some = max(1, min(size, PACKED // max(1, dim)))
                for part in (at[i : i + some] for i in range(0, len(at), some)):
                    matrix = flat[(ends[part] - dim)[:, None] + np.arange(dim)]
                    out.append((int(block[part[0]]), ids[part].tobytes(), _narrow(matrix).tobytes(), dim))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["tile_block", "tile_ids", "tile_values", "tile_dim"])

    return rows.select("id", "values", F.pmod(F.xxhash64("id", "values"), F.lit(blocks)).alias("block")).mapInArrow(pack, TILE)


def _unpack(ids: bytes, values: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    wide = len(values) // max(1, len(names) * dim)
    return names, np.frombuffer(values, f"i{wide or 2}").reshape(len(names), dim)


def _peak(matrix: np.ndarray) -> float:
    return float(np.abs(matrix.astype(float)).max()) if matrix.size else 0.0


def _exact(bound: float) -> type:
    """The type in which sums of products up to ``bound`` are exact, and matrices multiply fastest."""
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of all rows of ``a`` and ``b``; by floats where those are exact."""
    kind = _exact(_peak(a) * _peak(b) * a.shape[1])
    return (a.astype(kind) @ b.T.astype(kind)).astype(np.int64)


class Lists:
    """The best ``k`` so far of queries of one dimension, ties to the smaller id, a query's own id left out."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, tile: int) -> None:
        ids, matrix = _joined(queries)
        order = np.argsort(ids, kind="stable")
        self.queries, self.matrix, self.tile = ids[order], matrix[order], tile
        self.peaks = [_peak(self.matrix[at : at + tile]) for at in range(0, len(ids), tile)]
        self.score, self.id = np.full((len(ids), k), NONE), np.zeros((len(ids), k), np.int64)
        self.space: dict[type, np.ndarray] = {}

    def add(self, candidates: list[tuple[np.ndarray, np.ndarray]]) -> None:
        ids, matrix = _joined(candidates)
        first, last = (np.searchsorted(self.queries, ids, side) for side in ("left", "right"))
        own = np.repeat(np.arange(len(ids)), last - first)  # candidates that are queries too, and where
        its = np.arange(len(own)) - np.repeat(np.cumsum(last - first) - last, last - first)
        order = np.argsort(its, kind="stable")
        own, its = own[order], its[order]
        peak, others = _peak(matrix), {}
        matrix = np.concatenate([matrix, np.zeros((-len(ids) % FOLDS, matrix.shape[1]), matrix.dtype)])
        for at, high in zip(range(0, len(self.queries), self.tile), self.peaks, strict=True):
            kind = _exact(high * peak * matrix.shape[1])
            if kind not in others:
                others[kind] = matrix.astype(kind).T
            some = self.matrix[at : at + self.tile].astype(kind)
            size = len(some) * len(matrix)
            if kind not in self.space or self.space[kind].size < size:
                self.space[kind] = np.empty(size, kind)
            found = np.matmul(some, others[kind], out=self.space[kind][:size].reshape(len(some), -1))
            hidden = NONE if kind is np.int64 else -np.inf
            mine = slice(*np.searchsorted(its, (at, at + self.tile)))
            found[its[mine] - at, own[mine]] = hidden
            found[:, len(ids) :] = hidden
            self._merge(at, found, ids)

    def _merge(self, at: int, found: np.ndarray, ids: np.ndarray) -> None:
        k, n = self.score.shape[1], len(found)
        bar, worst = self.score[at : at + n, -1], self.id[at : at + n, -1]
        found = found.reshape(n, FOLDS, -1)
        best = found.max(axis=1)  # of the columns that lie a width apart, so that few columns are looked at one by one
        least = bar.astype(found.dtype)  # a bar that a float rounds lies, also rounded, beyond all scores that floats hold exactly
        if best.shape[1] > k and len(short := np.flatnonzero(bar == NONE)):
            least[short] = np.partition(best[short], best.shape[1] - k, axis=1)[:, best.shape[1] - k]
        row, part = np.nonzero(best >= least[:, None])
        if not len(row):
            return
        some = found[row, :, part]
        each, fold = np.nonzero(some >= least[row, None])
        row, col, score = row[each], fold * found.shape[2] + part[each], some[each, fold]
        row, col = row[real := score > NONE], col[real]
        score, other = score[real].astype(np.int64), ids[col]
        better = (score > bar[row]) | (other < worst[row])
        row, score, other = row[better], score[better], other[better]
        rows = np.unique(row)
        old = at + rows
        row = np.concatenate([np.repeat(rows, k), row])
        score, other = np.concatenate([self.score[old].ravel(), score]), np.concatenate([self.id[old].ravel(), other])
        order = np.lexsort((other, ~score, row))  # ~ turns the order around, that of NONE too
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        self.score[old], self.id[old] = score[order].reshape(-1, k), other[order].reshape(-1, k)

    def rows(self) -> pa.RecordBatch:
        full = self.score > NONE
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.repeat(self.queries, full.sum(axis=1)), self.id[full], self.score[full])], names=["query_id", "vec_id", "score"])


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _best(tiles: Iterator[tuple], k: int, tile: int, shard: int) -> Iterator[pa.RecordBatch]:
    """The lists of one cell, whose ``(side, ids, values, dim)`` have the queries first."""
    queries, waiting, lists = defaultdict(list), defaultdict(list), {}
    for side, ids, values, dim in tiles:
        if side == 0:
            queries[dim].append(_unpack(ids, values, dim))
        elif dim in lists or dim in queries:
            if dim not in lists:
                lists[dim] = Lists(queries.pop(dim), k, tile)
            waiting[dim].append(_unpack(ids, values, dim))
            if sum(len(p[0]) for p in waiting[dim]) >= shard:
                lists[dim].add(waiting.pop(dim))
    for dim, parts in waiting.items():
        lists[dim].add(parts)
    for found in lists.values():
        yield found.rows()


def _grid(queries: DataFrame, candidates: DataFrame, k: int) -> tuple[int, int]:
    """How many blocks of queries and of candidates: a cell is bounded, and among as many cells those in which the fewest vectors travel."""
    each = lambda df, side: df.select(F.lit(side).alias("side"), F.size("values").cast("long").alias("dim"))
    counted = each(queries, 0).unionAll(each(candidates, 1)).groupBy("side").agg(F.count("*").alias("n"), F.sum("dim").alias("components"))
    found = {r.side: (r.n, r.components) for r in counted.collect()}
    (q, held), (c, passing) = (found.get(side, (0, 0)) for side in (0, 1))
    spark = queries.sparkSession
    cells = max(math.ceil(q * c / MANY), min(partitions(spark), max(spark.sparkContext.defaultParallelism, math.ceil(q * c / FEW))))
    rows = max(1, math.ceil((held + 2 * k * q) / HELD), min(cells, round(math.sqrt(cells * q / max(1, c)))))
    return rows, max(1, math.ceil(cells / rows), math.ceil(passing / PASSING))


def search(queries: DataFrame, candidates: DataFrame, k: int, tile: int = 1024, shard: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of ``candidates(id, values)`` for each of ``queries(id, values)``.

    Values are arrays of bigint; scores are their inner products, ties go to the smaller id, and a
    query's own id is no candidate. Vectors of different dimensions are not compared. Fewer candidates
    than ``k`` give all. Scores must fit 64 bits. Empty tables give no rows. Ids name vectors: rows of ``queries`` that share an
    id share one list, in which each of their scores competes, and are no candidates of each other.

    Both tables are counted first. A candidate travels once for each block of queries, a query once for each block of candidates.
    """
    high, wide = _grid(queries, candidates, k)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = _tiles(queries, high, tile).withColumn("at", every(wide)).withColumn("cell", F.col("tile_block") * wide + F.col("at")).withColumn("side", F.lit(0))
    c = _tiles(candidates, wide, shard).withColumn("at", every(high)).withColumn("cell", F.col("at") * wide + F.col("tile_block")).withColumn("side", F.lit(1))
    names = ["cell", "side", "tile_ids", "tile_values", "tile_dim"]
    cells = q.select(names).unionAll(c.select(names)).repartitionById(high * wide, "cell").sortWithinPartitions("cell", "side")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = (t for batch in batches for t in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, own in itertools.groupby(tiles, key=lambda t: t[0]):
            yield from _best((t[1:] for t in own), k, tile, shard)
        release()

    found = cells.mapInArrow(score, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull())
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("values")
    whole = lambda df: df.filter(usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), values)
    return search(whole(rows.filter(F.col("vec_id") % 50 == 0)), whole(rows), 5)


OP7_SQL = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
q as (select * from e where vec_id % 50 = 0),
s as (select q.vec_id as query_id, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2]))::bigint as score
  from q join e on q.vec_id <> e.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 5
"""
