"""Connected components by alternating large-star and small-star rounds over links that tasks have contracted.

A task first replaces the links that it holds by stars, so long chains take few rounds. Once all links that are left fit in one task's
share, that share is fixed and the task ends the job: each round's plans, jobs and tasks cost the driver memory, however few the links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that a task contracts at a time.
TASK_EDGES = 1 << 16


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))


def _stars(task_edges: int, names: tuple[str, str], roots: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's links as stars: each node with the least that it reaches through ``task_edges`` of them; ``roots``: these with themselves too."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, least = spanning(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        if roots:
            least = np.concatenate((least, np.unique(least)))
            node = np.concatenate((node, least[len(node) :]))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(least, pa.int64())], names=[*names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if held and n + batch.num_rows > task_edges:
                yield star(held)
                held, n = [], 0
            held, n = [*held, batch], n + batch.num_rows
        if n:
            yield star(held)

    return run


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, component`` (the smallest node) for each node of ``edges(a, b)``.

    A large-star round links each node's larger neighbours to its least neighbour, a small-star round
    its smaller ones; stars remain. Each round's edges are cut to the shared folder. The least
    neighbour is a sum-like aggregate, merged before the shuffle, so a node with a third of all
    edges is not collected anywhere. Repeated edges and loops are allowed; no edges give no rows.

    A round has about a task for ``task_edges`` links, since each round's shuffles write files for each task, however few its links. As
    many links or fewer need no round: one task has them all.
    """
    dense = lambda df, n: df.coalesce(max(1, math.ceil(n / task_edges)))
    contract = lambda df: df.mapInArrow(_stars(task_edges, ("a", "b")), "a long, b long")
    now = cut(contract(edges.select("a", "b")))
    n = now.count()
    if n > task_edges:
        now = cut(contract(dense(now, n)).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() if n > task_edges else None
        if seen is None or seen["n"] <= task_edges:
            return now.coalesce(1).mapInArrow(_stars(task_edges, ("node", "component"), True), "node long, component long")
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = seen
        now = contract(dense(now, seen["n"]))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.filter("b > a").join(_least(both), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = dense(dense(large, seen["n"]).distinct(), seen["n"])
        small = dense(large.join(_least(large), "a"), seen["n"])
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, least)``: for a task's links a[i] - b[i], each node with the least node it reaches through them."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):  # with a node its star's centre, so whole stars merge
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]
