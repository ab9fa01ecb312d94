"""Components of texts whose word-shingle sets have a Jaccard similarity of a threshold or more.

Equal sets become one node. Bands of min-hashes, and families that the caller has found, name buckets of candidates; every candidate counts only once its exact
Jaccard similarity is known. No bucket is compared pair by pair: in each of a few rounds all members of a bucket that
are not connected yet meet one of them, its hub, which ties groups of copies together in linear work. Nodes whose buckets
still hold several components then meet block by block inside tasks, first as bitmaps that bound the difference of two sets, then, where these leave
a partner, as sets. That step misses no pair of a bucket, however many texts share it, and makes no pair a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release
from .components import connected_components
from .words import Batch, mix, windows

_U = np.uint64
#: At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8^4)^16 = 0.9998.
BANDS, DEPTH = 16, 4
_FACTORS = mix(np.arange(1, 2 * BANDS * DEPTH + 1, dtype=np.uint64))
#: Rounds of hubs.
ROUNDS = 3
STEP_BYTES = 1 << 20
#: Sketches and bytes of shingle names of a block, and pairs that a task compares at a time.
BLOCK_NODES, BLOCK_BYTES, PAIRS = 4096, 8 << 20, 1 << 19


def shingle_sets(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """``(flat, first)``: the sorted distinct 64-bit names of each text's shingles of lower-case words, and where each text's begin.

    A text of fewer words has one shingle, all its words; a text without words the shingle 0.
    """
    batch = Batch([t.encode().lower() for t in texts])
    names, n = batch.names(1), np.diff(batch.first)
    whole = windows(names, shingle, 0x9E3779B97F4A7C15)
    doc = batch.doc[: len(whole)]
    inside = batch.doc[shingle - 1 :][: len(whole)] == doc
    few = np.flatnonzero(n < shingle)
    short = np.zeros(len(few), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(shingle - 1):
            has = n[few] > k
            short[has] = mix(short[has] * _U(0xD1342543DE82EF95) + names[batch.first[few[has]] + k])
    flat, of = np.concatenate((whole[inside], short)), np.concatenate((doc[inside], few))
    order = np.lexsort((flat, of))
    flat, of = flat[order], of[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
    return flat[new], np.searchsorted(of[new], np.arange(len(texts)))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about STEP_BYTES of ``text``."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, STEP_BYTES + (size[start - 1] if start else 0))))
            yield batch.slice(start, stop - start)
            start = stop


def signatures(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit names of each set and the names of its bands' buckets."""
    with np.errstate(over="ignore"):
        one, two = np.add.reduceat(mix(flat), first), np.add.reduceat(mix(flat ^ _U(0xA5A5A5A5A5A5A5A5)), first)
        bands = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(first), axis=0)
        for k in range(BANDS * DEPTH):
            least = np.minimum.reduceat(flat * (_FACTORS[2 * k] | _U(1)) + _FACTORS[2 * k + 1], first)
            bands[:, k // DEPTH] = mix(bands[:, k // DEPTH] * _U(0x9E3779B97F4A7C15) + least)
    return one, two, bands


def similar(rows: DataFrame, shingle: int = 5, threshold: float = 0.8, families: DataFrame | None = None) -> DataFrame:
    """``key, doc_id, component`` for each row of ``rows(key, doc_id, text)``; ``component`` is a key of the component.

    ``key`` names a row's content: rows of one key are taken to have one text. A null text has no words, and texts without
    words are alike. An empty table gives an empty result. ``families(key, family)``: groups that another method has found. Each is a
    bucket more, and they meet in a round of hubs of their own before all others, so the bands' buckets serve only what that leaves apart.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches):
            flat, first = shingle_sets(part.column("text").to_pylist(), shingle)
            one, two, bands = (x.view(np.int64) for x in signatures(flat, first))
            ends = pa.array(np.arange(len(first) + 1) * BANDS, pa.int32())
            size = pa.array(np.diff(np.append(first, len(flat))), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(one), pa.array(two), size, pa.ListArray.from_arrays(ends, pa.array(bands.ravel()))], names=["key", "doc_id", "one", "two", "n", "bands"])
        release()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                flat, (_, half) = shingle_sets([x.as_py(), y.as_py()], shingle)
                shared = len(np.intersect1d(flat[:half], flat[half:], assume_unique=True))
                ok.append(shared >= threshold * (len(flat) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """``a, b``: the groups of the ``pairs(x, y, a, b)`` of nodes x and y that are as similar as that; cut."""
        both = pairs.join(texts.select(F.col("node").alias("x"), F.col("text").alias("left")), "x").join(texts.select(F.col("node").alias("y"), F.col("text").alias("right")), "y")
        return cut(both.select("a", "b", "left", "right").mapInArrow(judge, "a long, b long"))

    def alike(n, m):
        """Sizes of sets that can be as similar as that."""
        return F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)

    def grouped(state: DataFrame, links: DataFrame) -> DataFrame:
        groups = connected_components(links).withColumnRenamed("node", "group")
        return state.join(groups, "group", "left").select("bucket", "node", "n", "given", F.coalesce("component", "group").alias("group"))

    def buckets(sets: DataFrame) -> DataFrame:
        banded = sets.select("node", "n", F.explode("bands").alias("bucket"), F.lit(False).alias("given"))
        if families is None:
            return banded
        given = families.select(F.col("key").alias("node"), F.xxhash64(F.lit("family"), "family").alias("bucket"), F.lit(True).alias("given")).distinct()
        return banded.unionByName(cut(sets.select("node", "n").join(given, "node")))

    plain = rows.select("key", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = cut(plain.mapInArrow(sign, f"key long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, one long, two long, n long, bands array<long>"))
    # a node is the row of the least key of an equal set
    sets = cut(signed.groupBy("one", "two").agg(F.min(F.struct("key", "n", "bands")).alias("s")).select("one", "two", F.col("s.key").alias("node"), F.col("s.n").alias("n"), F.col("s.bands").alias("bands")))
    banded = buckets(sets)
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    state = cut(banded.join(shared, "bucket"))
    nodes = state.select(F.col("node").alias("key")).distinct()
    texts = cut(plain.join(nodes, "key", "left_semi").groupBy(F.col("key").alias("node")).agg(F.first("text").alias("text")))
    links = rows.sparkSession.createDataFrame([], "a long, b long")
    state = state.withColumn("group", F.col("node"))
    for r in range(ROUNDS if families is None else ROUNDS + 1):
        here = state.filter("given") if families is not None and r == 0 else state
        hub = F.min(F.struct(F.xxhash64(F.lit(r), "node").alias("h"), "node", "n", "group")).alias("hub")
        met = here.join(here.groupBy("bucket").agg(hub), "bucket").filter((F.col("group") != F.col("hub.group")) & alike(F.col("n"), F.col("hub.n")))
        # of the hubs of its buckets a node meets the first: rows are as many as nodes, and what else its buckets hold is left to later rounds and blocks
        met = met.groupBy("node").agg(F.min("hub").alias("hub"), F.min("group").alias("group"))
        # a group is named by its least node, so the links between groups, of this round alone, connect what links between nodes would
        new = verified(met.select(F.col("node").alias("x"), F.col("hub.node").alias("y"), F.col("group").alias("a"), F.col("hub.group").alias("b")), texts)
        links = links.unionByName(new)
        state = grouped(state, new)
        mixed = state.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("bucket")
        state = cut(state.join(mixed, "bucket", "left_semi"))
        if state.isEmpty():
            break
    else:
        links = links.unionByName(_by_blocks(state, texts, shingle, threshold))
    found = sets.select("one", "two", "node").join(connected_components(links), "node", "left").select("one", "two", F.coalesce("component", "node").alias("component"))
    return signed.select("key", "doc_id", "one", "two").join(found, ["one", "two"]).select("key", "doc_id", "component")



def _by_blocks(state: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``a, b``: links that connect all nodes of ``state(bucket, node, n, group)`` of different groups that share a bucket and are
    as similar as ``threshold``.

    Buckets that have the same least member share a home, so the many buckets of one family of texts are one home, and a node travels
    once to each of its homes. The nodes of a home are compared inside a task as blocks of BLOCK_NODES sketches, and each pair of blocks of a larger
    home in a task of its own. Only nodes that a sketch leaves a partner travel again, with the names of all their shingles, and meet
    exactly. A task returns nodes, then spanning links: no pair of texts becomes a row.
    """
    least = F.min(F.struct(F.xxhash64(F.lit(ROUNDS), "node").alias("h"), "node")).alias("least")
    homes = state.groupBy("bucket").agg(least).select("bucket", F.col("least.node").alias("home"))
    members = cut(state.join(homes, "bucket").select("home", "node", "n", "group").distinct())

    def describe(exact: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _steps(batches):
                flat, first = shingle_sets(part.column("text").to_pylist(), shingle)
                ends = np.append(first, len(flat))
                if exact:
                    rows = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                else:
                    rows = [x.tobytes() for x in sketches(flat, ends)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(rows, pa.binary())], names=["node", "names"])
            release()

        return run

    def dealt(some: DataFrame, weight, most: int) -> DataFrame:
        """Rows of ``some`` for each pair of blocks, in order; a block weighs about ``most``."""
        parts = some.groupBy("home").agg(F.ceil(F.sum(weight) / most).alias("parts"))
        own = some.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")))
        met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        met = met.select("home", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "node", "n", "group", "names")
        return met.repartition("home", "x", "y").sortWithinPartitions("home", "x", "y")

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n, group, part = (block.column(c).to_numpy() for c in ("n", "group", "part"))
            seen = np.zeros(len(n), bool)
            for i, j, near in _near(_by_width(block.column("names")), n, group, part, threshold):
                seen[i[near.any(axis=1)]] = True
                seen[j[near.any(axis=0)]] = True
            if seen.any():
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(block.column(c).to_numpy()[at]) for c in ("home", "node")], names=["home", "node"])
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n, group, part, node = (block.column(c).to_numpy() for c in ("n", "group", "part", "node"))
            ends = np.append(0, np.cumsum(n))
            flat = np.frombuffer(b"".join(block.column("names").to_pylist()), np.uint64)
            a, b = _exact(flat, ends, n, group, part, threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])
        release()

    own = texts.join(members.select("node").distinct(), "node", "left_semi").mapInArrow(describe(False), "node long, names binary")
    some = cut(dealt(members.join(own, "node"), F.lit(1), BLOCK_NODES).mapInArrow(partners, "home long, node long").distinct())
    full = texts.join(some.select("node").distinct(), "node", "left_semi").mapInArrow(describe(True), "node long, names binary")
    left = members.join(some, ["home", "node"]).join(full, "node")
    return cut(dealt(left, 8 * F.col("n"), BLOCK_BYTES).mapInArrow(meet, "a long, b long"))


def sketches(flat: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """A bitmap for each set: a bit is the parity of the number of its shingles that hash there.

    Sets whose bitmaps differ in d bits differ in d shingles at least. A bitmap has two to four bits a shingle, a power of two of at
    least 256; half of it XOR the other half is the bitmap of half the bits.
    """
    size = np.diff(ends)
    bits = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    place = (mix(flat ^ _U(0x5851F42D4C957F2D)) % np.repeat(bits, size).astype(np.uint64)).astype(np.int64)
    start = np.append(0, np.cumsum(bits // 64))
    words = np.zeros(start[-1], np.uint64)
    np.bitwise_xor.at(words, np.repeat(start[:-1], size) + place // 64, _U(1) << (place % 64).astype(np.uint64))
    return [words[a:b] for a, b in zip(start, start[1:], strict=False)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each ``home, x, y`` from batches in that order."""
    held, last = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("home", "x", "y")])
        ends = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(ends, ends[1:], strict=False):
            if a == b:
                continue
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held, last = [*held, batch.slice(a, b - a)], key
    if held:
        yield pa.Table.from_batches(held)


def _by_width(names: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``words -> (rows, bitmaps)``: the rows whose bitmaps have so many words."""
    rows = names.to_pylist()
    width = np.array([len(r) // 8 for r in rows])
    found = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        found[w] = at, np.frombuffer(b"".join(rows[i] for i in at), np.uint64).reshape(len(at), w)
    return found


def _near(maps: dict[int, tuple[np.ndarray, np.ndarray]], n: np.ndarray, group: np.ndarray, part: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``i, j, near``: rows against rows; ``near`` marks the pairs of different groups that may be as similar as ``threshold``, each pair once.

    Within one block all pairs meet, else those of the two parts.
    """
    one_block = (part == part[0]).all()
    share = (1 - threshold) / (1 + threshold)
    for low, (rows, own) in maps.items():
        for high, (others, wide) in maps.items():
            if high < low or n[others].min() * threshold > n[rows].max():
                continue
            folded = np.bitwise_xor.reduce(wide.reshape(len(others), high // low, low), axis=1)
            step = max(1, PAIRS // len(others))
            for s in range(0, len(rows), step):
                i = rows[s : s + step]
                differ = np.zeros((len(i), len(others)), np.int32)
                for w in range(low):
                    differ += np.bitwise_count(own[s : s + step, w][:, None] ^ folded[:, w][None, :])
                x, y = n[i][:, None], n[others][None, :]
                near = (differ <= share * (x + y) + 1e-6) & (np.minimum(x, y) >= threshold * np.maximum(x, y)) & (group[i][:, None] != group[others][None, :])
                if not one_block:
                    near &= part[i][:, None] != part[others][None, :]
                if low == high:
                    near &= i[:, None] < others[None, :]
                if near.any():
                    yield i, others, near


def _exact(flat: np.ndarray, ends: np.ndarray, n: np.ndarray, group: np.ndarray, part: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """``i, j``: links that connect the rows of different groups whose sets ``flat[ends[i]:ends[i + 1]]`` are as similar as ``threshold``."""
    maps = _by_width(pa.chunked_array([pa.array([x.tobytes() for x in sketches(flat, ends)], pa.binary())]))
    names, local = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(names), bool)
    label = np.unique(group, return_inverse=True)[1]
    left, right = [], []
    for rows, others, near in _near(maps, n, group, part, threshold):
        for k in np.flatnonzero(near.any(axis=1)):
            i, j = rows[k], others[near[k]]
            j = j[label[j] != label[i]]
            if not len(j):
                continue
            mark[local[ends[i] : ends[i + 1]]] = True
            first = np.append(0, np.cumsum(n[j])[:-1])
            at = np.arange(n[j].sum()) + np.repeat(ends[j] - first, n[j])
            shared = np.add.reduceat(mark[local[at]].astype(np.int64), first)
            mark[local[ends[i] : ends[i + 1]]] = False
            for m in j[shared >= threshold * (n[i] + n[j] - shared)]:
                if label[m] != label[i]:
                    left.append(i)
                    right.append(m)
                    label[label == label[m]] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)
