"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors get one more entry that gives all the greatest norm, queries a zero there, so the largest inner product is
the least Euclidean distance, for which Gaussian (2-stable) projections in windows of one width hash. A
table names a bucket by several projections; a query visits, over all tables, the buckets whose windows lie nearest to its own projections:
sets of steps by one window, in the order of the squared distances to cross, which estimates their success. Buckets' members are scored in
double precision as matrix products, and tables merge by Spark's ranked window.

The index holds every row: equal vectors are one entry with their least ids. Buckets are dealt to shards, and a shard that outgrows
its size, be it one bucket, is split by a hash of its members, each part of which is visited. So nothing is capped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .topk import usable
from .words import mix

_U = np.uint64
#: Sets of steps that are ranked in each table; a table of fewer than eight projections has no more.
SETS = 4096
#: Relative slack within which matrix products are decided by summing each pair's products in order.
SLACK = 1e-12
GROUP = "shard int, part int, block int, guest boolean, key long, ids array<long>, codes binary, vector binary"
FOUND = "key long, query_id long, node long, ids array<long>, score double"


def step_sets(projections: int, most: int) -> np.ndarray:
    """Up to ``most`` sets of steps as rows of zeros and ones over the ``2 * projections`` steps by rising distance, likely ones first.

    Step j and step 2K + 1 - j belong to one projection, so a set has one of them at most. The order is by expected
    squared distances of uniform projections; sets grow from their last step by moving it on or adding the next.
    """
    k = projections
    j = np.arange(1, k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    cost = np.concatenate((near, (1 - j / (k + 1) + near)[::-1])) if k else np.zeros(0)
    rows, heap = [np.zeros(2 * k, bool)], [(cost[0], (0,))] if k else []
    while heap and len(rows) < most:
        total, steps = heapq.heappop(heap)
        if not any(2 * k - 1 - s in steps for s in steps):
            row = np.zeros(2 * k, bool)
            row[list(steps)] = True
            rows.append(row)
        last = steps[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*steps[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*steps, last + 1)))
    return np.array(rows).reshape(len(rows), 2 * k)


@dataclass
class Hashing:
    """Fitted tables: ``lines[t, k]`` the projections, ``shifts[t, k]`` where their windows begin, ``width`` the windows' size."""

    scale: float
    norm: float
    width: float
    lines: np.ndarray
    shifts: np.ndarray
    probes: int = 1

    def __post_init__(self) -> None:
        tables, k = self.shifts.shape
        self.weights = mix(np.arange(1, tables * k + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).reshape(tables, k) | _U(1)
        self.seeds = mix(np.arange(tables, dtype=np.uint64) + _U(99))
        self.sets = step_sets(k, SETS)

    def _windows(self, x: np.ndarray) -> np.ndarray:
        return (np.einsum("nd,tkd->tnk", x, self.lines, optimize=True) + self.shifts[:, None, :]) / self.width

    def member(self, x: np.ndarray) -> np.ndarray:
        """``x`` at the greatest norm."""
        x = x / self.scale
        return np.column_stack((x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))))

    def query(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return np.column_stack((x * (self.norm / np.sqrt((x * x).sum(axis=1, keepdims=True))), np.zeros(len(x))))

    def _codes(self, t: int, at: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (at.astype(np.int64).astype(np.uint64) * self.weights[t]).sum(axis=1, dtype=np.uint64) + self.seeds[t]

    def buckets(self, members: np.ndarray) -> np.ndarray:
        """The bucket of each member in each table, as 64-bit names: sums that a step changes by its projection's weight."""
        return np.stack([self._codes(t, np.floor(w)) for t, w in enumerate(self._windows(members))], 1)

    def visits(self, queries: np.ndarray, most: int | None = None) -> np.ndarray:
        """The buckets that each query visits, first ones first (``most`` or ``probes`` of them, if there are so many)."""
        scores, codes = [], []
        for t, w in enumerate(self._windows(queries)):
            at = np.floor(w)
            crossing = np.concatenate((w - at, at + 1 - w), 1) ** 2
            order = np.argsort(crossing, axis=1, kind="stable")
            step = np.concatenate((np.zeros_like(self.weights[t]) - self.weights[t], self.weights[t]))
            scores.append(np.take_along_axis(crossing, order, 1) @ self.sets.T.astype(float))
            codes.append(self._codes(t, at)[:, None] + step[order] @ self.sets.T.astype(np.uint64))
        scores, codes = np.concatenate(scores, 1), np.concatenate(codes, 1)
        order = np.argsort(scores, axis=1, kind="stable")[:, : most or self.probes]
        return np.take_along_axis(codes, order, 1)


def fit_hashing(members: np.ndarray, queries: np.ndarray, neighbours: list[np.ndarray], rows: int, norm: float, scale: float, recall: float, tables: int, bucket_rows: int) -> Hashing:
    """Tables in which the visited buckets hold a share of ``recall`` of ``neighbours[i]``, the true ones of ``queries[i]``.

    ``members``: a sample of the index, for the windows' width (two deviations). Fewer projections are tried until enough
    neighbours lie within the ranked sets; without any projection all rows are one bucket.
    """
    rng = np.random.default_rng(17)
    most = max(0, round(float(np.log2(max(rows, 1) / bucket_rows))))
    for k in range(min(most, 24), -1, -1):
        lines = rng.normal(size=(tables if k else 1, k, members.shape[1] + 1))
        hashing = Hashing(scale, norm, 1.0, lines, np.zeros(lines.shape[:2]))
        width = 2 * float(np.std(hashing._windows(hashing.member(members)), axis=1).mean()) if k and len(members) else 1.0
        hashing.width = width if width > 0 else 1.0
        hashing.shifts = rng.uniform(0, hashing.width, lines.shape[:2])
        place = []
        for q, near in zip(queries, neighbours, strict=True):
            if len(near):
                visits = hashing.visits(hashing.query(q[None]), SETS * tables)[0]
                by = np.argsort(visits, kind="stable")
                own = hashing.buckets(hashing.member(near))
                at = np.minimum(np.searchsorted(visits[by], own), len(by) - 1)
                place.append(np.where(visits[by][at] == own, by[at], len(by)).min(axis=1))
        ranks = np.sort(np.concatenate(place)) if place else np.zeros(1, np.int64)
        bar = ranks[int(np.ceil(recall * len(ranks))) - 1]
        if not k or bar < len(hashing.sets) * tables:
            hashing.probes = int(bar) + 1
            return hashing
    raise AssertionError("one bucket holds all rows")


def best_pairs(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, single: np.ndarray, tie: np.ndarray, visits: list[tuple[np.ndarray, slice]], k: int, room: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, member, score`` of each query's best ``k`` (ties: smaller ``tie``) among the members of the buckets that it visits.

    ``visits``: queries with the slice of ``x`` that they score. ``single``: a member's only id, or -1; a query does not find its own.
    """
    eps = SLACK * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    bar, kept, held = np.full(len(q), -np.inf), [], 0

    def reduce() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, s = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((tie[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        head = np.searchsorted(i, np.arange(len(q) + 1))
        best = np.arange(len(i)) - head[i] < k
        full = np.flatnonzero(np.diff(head) >= k)
        bar[full] = s[head[full] + k - 1]
        return i[best], j[best], s[best]

    for who, part in visits:
        for a in range(part.start, part.stop, 8192):
            span = slice(a, min(a + 8192, part.stop))
            for c in range(0, len(who), 1024):
                w = who[c : c + 1024]
                s = q[w] @ x[span].T
                s[q_ids[w][:, None] == single[span][None, :]] = -np.inf
                least = bar[w]
                if s.shape[1] > k:
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                i, j = np.nonzero((s >= (least - eps)[:, None]) & (s > -np.inf))
                i, j = w[i], j + a
                kept.append((i, j, (q[i] * x[j]).sum(axis=1)))
                held += len(i)
                if held > room:
                    kept = [reduce()]
                    held = len(kept[0][0])
    return reduce()


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Arrow lists as a matrix, shorter ones padded with zeros."""
    size = pc.list_value_length(column).to_numpy()
    x = np.zeros((len(column), dim))
    x[np.arange(dim)[None, :] < size[:, None]] = column.flatten().to_numpy()
    return x


def _usable(v: Column) -> Column:
    return usable(v) & F.exists(v, lambda c: c != 0)


def visited(index: DataFrame, asked: DataFrame, asked_rows: int, hashing: Hashing, rows: int, dim: int, k: int, shard_rows: int, least_shards: int, query_rows: int) -> DataFrame:
    """``key, query_id, best``: for each of ``asked(key, id, v)`` the best ``k`` of ``index(v, ids, node)`` in the buckets that it visits, as structs in order."""
    shards = max(least_shards, -(-rows * hashing.shifts.shape[0] // shard_rows))

    def shard_of(codes: np.ndarray) -> np.ndarray:
        return (mix(codes) % _U(shards)).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shards, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(shard_of(hashing.buckets(hashing.member(_vectors(batch.column("v"), dim)))).ravel(), minlength=shards)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["shard", "n"])

    sizes = np.zeros(shards, np.int64)
    for r in index.select("v").mapInArrow(counted, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).toLocalIterator():  # two numbers a shard of shard_rows
        sizes[r["shard"]] = r["n"]
    parts = np.maximum(1, -(-sizes // (2 * shard_rows)))
    blocks = -(-asked_rows // query_rows)

    def hashed(x: np.ndarray) -> np.ndarray:
        return mix(x.astype(np.uint64) + _U(5))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each member once per table and block of queries."""
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                x, node = _vectors(piece.column("v"), dim), piece.column("node").to_numpy()
                codes = hashing.buckets(hashing.member(x))
                n, tabs = codes.shape
                at = np.repeat(np.arange(n), tabs * blocks)
                code = np.repeat(codes.ravel(), blocks)
                shard = shard_of(code)
                part = (hashed(node)[at] % parts[shard].astype(np.uint64)).astype(np.int32)
                block = np.tile(np.arange(blocks), n * tabs)
                took = piece.take(pa.array(at))
                vectors = pa.array([r.tobytes() for r in x], pa.binary()).take(pa.array(at))
                columns = [pa.array(shard, pa.int32()), pa.array(part), pa.array(block, pa.int32()), pa.array(np.zeros(len(at), bool)), took.column("node"), took.column("ids"), pa.array([c.tobytes() for c in code], pa.binary()), vectors]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in GROUP.split(", ")])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once per part of a shard that it visits, with the buckets to visit there."""
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                x, key = _vectors(piece.column("v"), dim), piece.column("key").to_numpy()
                codes = hashing.visits(hashing.query(x))
                out: list[tuple] = []
                for i, shard in enumerate(shard_of(codes)):
                    order = np.argsort(shard, kind="stable")
                    heads = np.flatnonzero(np.diff(shard[order], prepend=-1))
                    for s, mine in zip(shard[order][heads], np.split(codes[i][order], heads[1:]), strict=True):
                        out += [(s, p, i, mine.tobytes()) for p in range(parts[s]) if sizes[s]]
                if not out:
                    continue
                shard, part, at, mine = zip(*out, strict=True)
                block = (hashed(key) % _U(blocks)).astype(np.int32)[list(at)]
                at = pa.array(at)
                ids = pa.array([[v] for v in piece.column("id").to_pylist()], pa.list_(pa.int64()))
                columns = [pa.array(shard, pa.int32()), pa.array(part, pa.int32()), pa.array(block), pa.array(np.ones(len(at), bool)), piece.column("key").take(at), ids.take(at), pa.array(mine, pa.binary()), pa.array([r.tobytes() for r in x], pa.binary()).take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in GROUP.split(", ")])

    def score(group: pa.Table) -> pa.Table:
        guest = group.column("guest").to_numpy()
        q, m = group.filter(pa.array(guest)).combine_chunks(), group.filter(pa.array(~guest)).combine_chunks()
        matrix = lambda g: np.frombuffer(b"".join(g.column("vector").to_pylist()), float).reshape(-1, dim)
        bucket = np.frombuffer(b"".join(m.column("codes").to_pylist()), np.uint64)
        order = np.argsort(bucket, kind="stable")
        m, bucket = m.take(pa.array(order)), bucket[order]
        ids = m.column("ids").to_pylist()
        single, head = np.array([v[0] if len(v) == 1 else -1 for v in ids], np.int64), np.array([v[0] for v in ids], np.int64)
        mine = q.column("codes").to_pylist()
        who = np.repeat(np.arange(len(mine)), [len(c) // 8 for c in mine])
        wanted = np.frombuffer(b"".join(mine), np.uint64)
        by = np.argsort(wanted, kind="stable")
        wanted, who = wanted[by], who[by]
        names, heads = np.unique(wanted, return_index=True)
        lo, hi = np.searchsorted(bucket, names, "left"), np.searchsorted(bucket, names, "right")
        groups = np.split(who, heads[1:])
        visits = [(groups[n], slice(lo[n], hi[n])) for n in np.flatnonzero(hi > lo)]
        q_ids = np.array([v[0] for v in q.column("ids").to_pylist()], np.int64)
        i, j, s = best_pairs(matrix(q), q_ids, matrix(m), single, head, visits, k)
        return pa.table({"key": q.column("key").take(pa.array(i)), "query_id": pa.array(q_ids[i]), "node": m.column("key").take(pa.array(j)), "ids": m.column("ids").take(pa.array(j)), "score": pa.array(s)})

    met = index.select("v", "ids", "node").mapInArrow(deal, GROUP).unionByName(asked.mapInArrow(ask, GROUP))
    found = met.groupBy("shard", "part", "block").applyInArrow(score, FOUND)
    # a pair that several tables found has one score, so it takes one rank
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0], "node")
    lists = found.withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= k).groupBy("key", "query_id").agg(F.collect_set(F.struct("score", "node", "ids")).alias("s"))
    single = F.flatten(F.transform("s", lambda e: F.transform(F.filter(e["ids"], lambda i: i != F.col("query_id")), lambda i: F.struct((-e["score"]).alias("less"), i.alias("vec_id"), e["score"].alias("score")))))
    return lists.select("key", "query_id", F.slice(F.array_sort(single), 1, k).alias("best"))


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, recall: float = 0.97, tables: int = 4, bucket_rows: int = 256, trials: int = 256, sample: int = 512, shard_rows: int = 16384, least_shards: int = 32, query_rows: int = 32768) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` near rows of ``candidates(id, v)`` for each row of ``queries(id, v)``, nearest first, ties to the smaller id.

    Nearness is the inner product, in double precision on the vectors as they are. All candidates are indexed. The tables are fitted on
    ``sample`` candidates, and the number of buckets that a query visits on ``trials`` different queries, both by the order of a hash: their true
    neighbours among all candidates are found in blocks, and as many buckets are visited as hold the share ``recall`` of those.

    Vectors that are null, zero, empty or hold null or non-finite entries take no part, nor do rows with a null id. Shorter vectors count as padded with zeros. Rows with
    a query's id are not its candidates; repeated rows of candidates are one, and each repeated query has a list of its own. A query whose buckets
    hold fewer than ``k`` candidates is compared with all rows, so only fewer candidates give fewer rows. Empty tables give no rows.
    """
    spark = queries.sparkSession
    clean = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    first = Window.partitionBy("v").orderBy("id")
    index = clean(candidates).withColumn("r", F.dense_rank().over(first)).filter(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    index = cut(index.withColumn("node", F.monotonically_increasing_id()))
    asked = cut(clean(queries).withColumn("key", F.monotonically_increasing_id()))
    greatest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    stats = index.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(greatest).alias("top")).first()
    more = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not stats["n"] or not more["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, dim, scale = stats["n"], max(stats["dim"], more["dim"]), stats["top"]
    norm = float(np.sqrt(index.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / scale) * (c / scale)))).first()[0]))

    def padded(v: list[float]) -> list[float]:
        return v + [0.0] * (dim - len(v))

    some = np.array([padded(r["v"]) for r in index.orderBy(F.xxhash64("v"), "node").limit(sample).select("v").collect()])  # bounded by sample
    trial = asked.groupBy("v").agg(F.min("id").alias("id")).orderBy(F.xxhash64("v"), "id").limit(trials).collect()  # bounded by trials
    t, t_ids = np.array([padded(r["v"]) for r in trial]), np.array([r["id"] for r in trial])

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The true neighbours of the trial queries among a task's rows."""
        for batch in batches:
            if batch.num_rows:
                x, ids = _vectors(batch.column("v"), dim), batch.column("ids")
                size, head = pc.list_value_length(ids).to_numpy(), ids.flatten().to_numpy()[np.cumsum(pc.list_value_length(ids).to_numpy()) - pc.list_value_length(ids).to_numpy()]
                i, j, s = best_pairs(t, t_ids, x, np.where(size == 1, head, -1), head, [(np.arange(len(t)), slice(0, len(x)))], k)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s), pa.array(head[j]), batch.column("v").take(pa.array(j))], names=["t", "s", "id", "v"])

    near: list[list] = [[] for _ in trial]
    best = Window.partitionBy("t").orderBy(F.desc("s"), "id")
    for r in index.mapInArrow(truth, "t long, s double, id long, v array<double>").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).collect():  # trials times k rows
        near[r["t"]].append(padded(r["v"]))
    hashing = fit_hashing(some, t, [np.array(v).reshape(len(v), dim) for v in near], rows, norm, scale, recall, tables, bucket_rows)
    lists = cut(visited(index, asked, more["n"], hashing, rows, dim, k, shard_rows, least_shards, query_rows))
    if hashing.shifts.size:
        # buckets with fewer than k members between them: such queries compare themselves with all rows, in blocks
        short = cut(asked.join(lists.filter(F.size("best") >= k).select("key"), "key", "left_anti"))
        if (n := short.count()) > 0:
            flat = Hashing(scale, norm, 1.0, np.zeros((1, 0, dim + 1)), np.zeros((1, 0)))
            lists = lists.filter(F.size("best") >= k).unionByName(visited(index, short, n, flat, rows, dim, k, shard_rows, least_shards, query_rows))
    ranked = lists.select("query_id", F.posexplode("best").alias("p", "e"))
    return ranked.select("query_id", (F.col("p") + 1).alias("rank"), "e.vec_id", "e.score")


def op11_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search(rows.filter(F.col("id") % 20 == 0), rows, 20)
