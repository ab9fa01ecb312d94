"""Embedding near-dedup by an exact metric range join on the angle between vectors.

Pivots partition the vectors: each goes to the cell of its nearest pivot. A vector must also be
compared with another cell's members unless, for some pivot, its angle differs from all of theirs by more than the range
(triangle inequality): such a pair cannot be in range. The least and largest angle of each cell to each pivot decide that. Of two
cells one sends to the other, so each pair meets once. Cells join independently, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import cut, table
from .components import connected_components, spanning
from .topk import usable

#: Slack of the single-precision filter; pairs within it of the threshold are decided in double precision.
SLACK = 1e-4


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares within range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors that travel as bytes of their own precision, as unit vectors in double precision."""
    return _unit(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64))


def links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (unit vectors) have a cosine of at least ``threshold``, in double precision."""
    rough = a.astype(np.float32) @ b.T.astype(np.float32)
    out = rough >= threshold + SLACK
    i, j = np.nonzero(~out & (rough >= threshold - SLACK))
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[p, q] = (a[p] * b[q]).sum(axis=1) >= threshold
    return out


def near_duplicates(rows: DataFrame, threshold: float = 0.9, cell_rows: int = 8192, block_rows: int = 65536, max_pivots: int = 256) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``rows(vec_id, embedding)``.

    Rows link if their cosine, in double precision, is at least ``threshold``. Vectors that are null, zero,
    empty, or hold null or non-finite components link with nothing; shorter vectors count as padded with
    zeros. Equal vectors are joined once and counted as often as they occur; repeated rows are rows of
    their own. Null vec_ids are linked, but never name a component unless it has no other. An empty table gives an empty result.

    Pivots are as many as cells of ``cell_rows`` need, ``max_pivots`` at most; larger cells split into parts
    that are compared with each other like cells, so no part or block outgrows a task. Where no cell can be ruled out, a vector
    travels once for each ``block_rows`` rows and for half of the parts of about ``cell_rows``.
    """
    single = isinstance(rows.schema["embedding"].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    base = rows.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    good = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    valid = base.filter(good)
    reps = cut(valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    stats = reps.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    total, dim = stats["n"], stats["dim"] or 1
    reach = float(np.arccos(np.clip(threshold, -1, 1)))
    chosen = reps.orderBy(F.xxhash64("v"), "node").limit(min(max_pivots, total // cell_rows + 1)).select("v").collect()  # bounded by max_pivots
    pivots = _unit(np.array([r["v"] + [0.0] * (dim - len(r["v"])) for r in chosen] or [[1.0] * dim]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.list_value_length(batch.column("v")).to_numpy()
            x = np.zeros((batch.num_rows, dim), kind)
            x[np.arange(dim)[None, :] < size[:, None]] = batch.column("v").flatten().to_numpy()
            cell = _angles(_unit(x.astype(np.float64)), pivots).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "n", "pivot", "vector"])

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each cell, and their least and largest angle to each pivot."""
        p = len(pivots)
        count, lo, hi = np.zeros(p, np.int64), np.full((p, p), np.inf), np.full((p, p), -np.inf)
        for batch in batches:
            if batch.num_rows:
                angle, cell = _angles(_matrix(batch.column("vector"), kind), pivots), batch.column("pivot").to_numpy()
                count += np.bincount(cell, minlength=p)
                np.minimum.at(lo, cell, angle)
                np.maximum.at(hi, cell, angle)
        at = np.repeat(np.flatnonzero(count), p)
        other = np.tile(np.arange(p), len(at) // p)
        columns = [pa.array(at, pa.int32()), pa.array(other, pa.int32()), pa.array(count[at]), pa.array(lo[at, other]), pa.array(hi[at, other])]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "other", "n", "lo", "hi"])

    placed = cut(reps.select("node", "n", "v").mapInArrow(place, "node long, n long, pivot int, vector binary"))
    found_cells = placed.mapInArrow(reaches, "cell int, other int, n long, lo double, hi double").groupBy("cell", "other").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sizes, least, most = np.zeros(len(pivots), np.int64), np.full((len(pivots),) * 2, np.inf), np.full((len(pivots),) * 2, -np.inf)
    for r in found_cells.toLocalIterator():  # the square of max_pivots at most
        sizes[r["cell"]], least[r["cell"], r["other"]], most[r["cell"], r["other"]] = r["n"], r["lo"], r["hi"]
    parts = -(-sizes // (2 * cell_rows))
    least, most = least - reach - 1e-9, most + reach + 1e-9
    first = np.cumsum(parts) - parts
    blocks = total // block_rows + 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once per block in its own cell, and in one block of each cell that its range reaches."""
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                angle = _angles(_matrix(part.column("vector"), kind), pivots)
                node, pivot = part.column("node").to_numpy(), part.column("pivot").to_numpy()
                salt = (node ^ (node >> 33)) * 2654435761 % (1 << 31)
                home = first[pivot] + salt % np.maximum(parts[pivot], 1)
                may = np.repeat(parts[None, :] > 0, len(node), axis=0)
                for p in range(len(pivots)):  # the triangle inequality by each pivot
                    may &= (angle[:, p, None] >= least[None, :, p]) & (angle[:, p, None] <= most[None, :, p])
                row, near = np.nonzero(may)
                n = parts[near]
                row, other = np.repeat(row, n), np.repeat(first[near], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = home[row]
                sends = np.where((own + other) % 2 == 1, own > other, own < other)
                row, other = row[sends], other[sends]
                at = np.concatenate((np.repeat(np.arange(len(node)), blocks), row))
                cell = np.concatenate((np.repeat(home, blocks), other))
                block = np.concatenate((np.tile(np.arange(blocks), len(node)), (salt[row] >> 8) % blocks))
                guest = np.concatenate((np.zeros(len(node) * blocks, bool), np.ones(len(row), bool)))
                took = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(block, pa.int64()), pa.array(guest), took.column("node"), took.column("n"), took.column("vector")], names=["cell", "block", "guest", "node", "n", "vector"])

    def join(key, group):
        guest = group.column("guest").to_numpy()
        node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
        x = _matrix(group.column("vector"), kind)
        h = np.flatnonzero(~guest)
        count, ends = np.zeros(len(node), np.int64), []
        block = key[1].as_py()
        for i in range(0, len(h), 1024):
            a = h[i : i + 1024]
            others = [np.flatnonzero(guest)] + ([h[i:]] if block == 0 else [])
            for b_all in others:
                for j in range(0, len(b_all), 4096):
                    b = b_all[j : j + 4096]
                    m = links(x[a], x[b], threshold)
                    if b_all is not others[0]:  # within the cell: each pair once
                        m &= b[None, :] > a[:, None]
                    if m.any():
                        count[a] += m @ n[b]
                        count[b] += n[a] @ m
                        p, q = np.nonzero(m)
                        ends.append(spanning(node[a[p]], node[b[q]]))
        s, t = spanning(*(np.concatenate(e) for e in zip(*ends, strict=True))) if ends else (node[:0], node[:0])
        c = np.flatnonzero(count)
        return pa.table({"a": pa.array(np.concatenate((node[c], s)), pa.int64()), "b": pa.array(np.concatenate((node[c], t)), pa.int64()), "links": pa.array(np.concatenate((count[c], np.zeros(len(s), np.int64))), pa.int64())})

    copies = placed.mapInArrow(spread, "cell long, block long, guest boolean, node long, n long, vector binary")
    found = cut(copies.groupBy("cell", "block").applyInArrow(join, "a long, b long, links long"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("a", "b"))
    linked = reps.join(counts, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = linked.join(names, "component").select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    joined = valid.join(linked, F.col("v") == F.col("_v")).select("vec_id", "n_links", "component_id")
    rest = base.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
with recursive e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
g as (select vec_id, v from e where len(v) > 0 and not list_bool_or(list_transform(v, lambda x: x is null or not isfinite(x))) and list_bool_or(list_transform(v, lambda x: x <> 0))),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9),
r as (select vec_id, vec_id as reach from e union select r.vec_id, l.b from r join l on r.reach = l.a),
c as (select vec_id, min(reach) as component_id from r group by vec_id),
n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from e join c on e.vec_id = c.vec_id left join n on e.vec_id = n.a
"""
