"""SimHash near-dedup by a binary trie self-join.

Distinct fingerprints form a binary trie. Pairs of its nodes are traversed together: a pair carries
the number of differing bits so far and is dropped once that exceeds the error budget. The upper
levels are one join in Spark: all pairs of prefixes that differ in at most that many bits. Below
each such pair a task goes on with the budget that is left, on sorted arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pack_columns, table, unpack_columns
from .components import connected_components, spanning
from .similar import similar

_U = np.uint64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: each is 1 if set in over half of the shingles' XXH64; repeats count; no words: 0."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    digest, bits, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = ends[shingle - 1 :].tolist()
    for k in range(0, n, 1 << 14):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + (1 << 14)], ends[k : k + (1 << 14)], strict=True)], "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text, as a signed 64-bit number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(of, "doc_id long, fp long")


def trie_pairs(a: np.ndarray, b: np.ndarray, depth: int, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with at most ``budget`` differing bits among the last 64 - ``depth`` of a[i] and b[j].

    ``a``, ``b``: sorted distinct fingerprints under one prefix of ``depth`` bits each. ``same``: a is b,
    and each pair comes once. Whole subtrees within the budget are linked as stars, so the result
    connects what the pairs connect. The traversal holds one level of node pairs.
    """
    lo_a, hi_a = np.array([0]), np.array([len(a)])
    lo_b, hi_b = np.array([0]), np.array([len(b)])
    diff = np.zeros(1, np.int64)
    left, right = [], []
    for d in range(depth, 65):
        size = (hi_a - lo_a) * (hi_b - lo_b)
        small, star = size <= 16, diff + (64 - d) <= budget
        for rows, whole in ((np.flatnonzero(star), True), (np.flatnonzero(small & ~star), False)):
            if not len(rows):
                continue
            n, m = hi_a[rows] - lo_a[rows], hi_b[rows] - lo_b[rows]
            at = np.repeat(np.arange(len(rows)), n * m if not whole else n + m)
            k = np.arange(len(at)) - np.searchsorted(at, np.arange(len(rows)))[at]
            if whole:  # first of a with all of b, first of b with all of a
                i = np.where(k < m[at], lo_a[rows][at], lo_a[rows][at] + k - m[at])
                j = np.where(k < m[at], lo_b[rows][at] + k, lo_b[rows][at])
                ok = np.ones(len(i), bool)
            else:
                i, j = lo_a[rows][at] + k // m[at], lo_b[rows][at] + k % m[at]
                mask = _U((1 << (64 - depth)) - 1)
                ok = np.bitwise_count((a[i] ^ b[j]) & mask) <= budget
            ok &= (a[i] != b[j]) if same else True
            left.append(i[ok])
            right.append(j[ok])
        go = ~small & ~star
        lo_a, hi_a, lo_b, hi_b, diff = (x[go] for x in (lo_a, hi_a, lo_b, hi_b, diff))
        if not len(diff):
            break
        bit = _U(1 << (63 - d))
        clear = ~_U((1 << (64 - d)) - 1) if d else _U(0)
        mid_a = np.clip(np.searchsorted(a, (a[lo_a] & clear) | bit), lo_a, hi_a)
        mid_b = np.clip(np.searchsorted(b, (b[lo_b] & clear) | bit), lo_b, hi_b)
        sides = [(x, y) for x in (0, 1) for y in (0, 1)]
        parts = [((lo_a, mid_a) if x == 0 else (mid_a, hi_a)) + ((lo_b, mid_b) if y == 0 else (mid_b, hi_b)) + (diff + (x != y),) for x, y in sides]
        lo_a, hi_a, lo_b, hi_b, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (lo_a < hi_a) & (lo_b < hi_b) & (diff <= budget)
        if same:
            keep &= lo_a <= lo_b
        lo_a, hi_a, lo_b, hi_b, diff = (x[keep] for x in (lo_a, hi_a, lo_b, hi_b, diff))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def link_fingerprints(distinct: DataFrame, budget: int, node_size: int = 1024) -> DataFrame:
    """``a, b``: links that connect all fingerprints of ``distinct(fp)`` that differ in at most ``budget`` bits.

    The upper levels have as many bits as give nodes of about ``node_size``. A node with more is dealt
    into several by a hash, which meet each other like different nodes.
    """
    n = distinct.count()
    depth = max(0, min(24, math.ceil(math.log2(max(1, n) / node_size))))
    prefix = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    keyed = distinct.select("fp", prefix.alias("prefix"))
    parts = keyed.groupBy("prefix").agg(F.ceil(F.count("*") / (4 * node_size)).alias("parts"))
    nodes = keyed.join(parts, "prefix").groupBy("prefix", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part")).agg(F.collect_list("fp").alias("fps"))
    nodes = cut(nodes)
    masks = [sum(1 << i for i in c) for k in range(budget + 1) for c in combinations(range(depth), k)]
    one = nodes.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).withColumn("other", F.col("prefix").bitwiseXOR(F.col("mask"))).filter("prefix <= other")
    two = nodes.select(F.col("prefix").alias("other"), F.col("part").alias("part2"), F.col("fps").alias("fps2"))
    pairs = one.join(two, "other").filter("prefix < other or part <= part2").select("fps", "fps2", F.bit_count("mask").alias("diff"), ((F.col("prefix") == F.col("other")) & (F.col("part") == F.col("part2"))).alias("same"))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y, diff, same in zip(batch.column("fps"), batch.column("fps2"), batch.column("diff").to_pylist(), batch.column("same").to_pylist(), strict=True):
                a, b = (np.sort(v.values.to_numpy().astype(np.int64).view(np.uint64)) for v in (x, y))
                i, j = trie_pairs(a, b, depth, budget - diff, same)
                found.append((a[i].view(np.int64), b[j].view(np.int64)))
            s, t = spanning(*(np.concatenate(f) for f in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(t, pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(traverse, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs(doc_id, text)``.

    Fingerprints that differ in at most ``budget`` bits link; ``component_id`` is the smallest doc_id
    reachable. Equal fingerprints are one node, so a group of copies costs one. Null texts and texts
    without words have fingerprint 0 and link like any other. Repeated rows stay; null doc_ids name no component unless
    it has no other. An empty table gives an empty result; other columns are ignored.
    """
    prints = cut(fingerprints(docs, shingle, seed))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = connected_components(link_fingerprints(nodes.select("fp"), budget)).withColumnRenamed("node", "fp")
    nodes = nodes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(names, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the first row by doc_id (null last), then by a hash of the row, stays.

    Texts link whose sets of word shingles have a Jaccard similarity of ``threshold`` or more. :func:`near_duplicates` comes first: the trie's
    self-join of the fingerprints gives families, whose texts meet before all others. At 0.8 most fingerprints differ in some 10 bits,
    with which nearly all nodes of the trie would meet; so :mod:`.similar` finds the pairs that are in no family, and checks all exactly.
    Rows are known by a hash of all their columns (none of them a map), so null or repeated doc_ids do not tie unrelated
    texts together; of rows equal in all columns one stays.
    """
    packed = pack_columns(docs).withColumn("key", F.xxhash64("doc_id", "text", "rest"))
    families = near_duplicates(packed.select(F.col("key").alias("doc_id"), "text"), shingle=shingle).select(F.col("doc_id").alias("key"), F.col("component_id").alias("family"))
    placed = similar(packed.select("key", "doc_id", "text"), shingle, threshold, families)
    ids = placed.groupBy("component", "doc_id", "key").agg(F.count("*").alias("n"))
    kept = cut(ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "n")).alias("f")).select("f.key", "f.n"))
    found = packed.join(kept, "key")
    once = found.filter("n > 1").groupBy("key").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "rest")])
    return unpack_columns(found.filter("n = 1").select("doc_id", "text", "rest").unionByName(once.select("doc_id", "text", "rest")), docs.columns)
