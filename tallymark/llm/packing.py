"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best fit, largest first. Lengths lie in 1..capacity, so range-sorting the pieces
and the gaps is a distributed count per length, and the state of all open sequences is a table of
gap classes whose size the capacity bounds, whatever the corpus. Each round takes one length
class, sweeps the gap classes upwards for the successor (the smallest gap that holds the length),
lets the pieces claim the gaps in the order of their rank, and updates the gaps. The rounds give
ranges of ranks; the pieces, ranked in parallel, find their place by a range join.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Ranks within a length are counted in this many hash shards, so that no length is one task.
SHARDS = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.cache
def _encoder(name: str):
    """``encode(text) -> ids`` of a byte-level BPE vocabulary.

    Texts that hold a special token's string go through the tokenizer itself. All others go
    through the same vocabulary as ranks, which gives the same ids several times faster.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(f"{name}.json")
    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file).get("added_tokens", [])]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cache
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)  # loaded by the workers that need it

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be shorter than the capacity."""
    head = length % capacity or capacity
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


def tokenize(docs: DataFrame, tokenizer: str = "byte_bpe_50k", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document, closed by ``end_id``; a null text is empty."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            of, rows = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py()), end_id], dtype="<u4")
                cuts = cut_points(len(ids), capacity)
                of += [i] * len(cuts)
                rows += [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts)]
            piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 4
            columns = [batch.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pieces, PIECES)


def rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit rounds over length classes: ``(length, rank_from, rank_to, first_sequence, per_sequence, offset)``.

    ``counts``: pieces by length. Ranks ``rank_from`` to ``rank_to`` - 1 of a length fill the sequences
    from ``first_sequence`` on, ``per_sequence`` in each, from ``offset`` on. Needs memory for the
    classes only.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many)
    events, made = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for gap in range(length, capacity):
            fits = gap // length
            while left and gaps.get(gap):
                first, n = gaps[gap].pop()
                full, rest = divmod(min(left, n * fits), fits)
                for sequences, each in ((full, fits), (1 if rest else 0, rest)):
                    if sequences:
                        events.append((length, rank, rank + sequences * each, first, each, capacity - gap))
                        if gap - each * length:
                            gaps.setdefault(gap - each * length, []).append((first, sequences))
                        rank, left, first, n = rank + sequences * each, left - sequences * each, first + sequences, n - sequences
                if n:
                    gaps[gap].append((first, n))
            if not left:
                break
        fits = capacity // length
        full, rest = divmod(left, fits)
        for sequences, each in ((full, fits), (1 if rest else 0, rest)):
            if sequences:
                events.append((length, rank, rank + sequences * each, made, each, 0))
                if capacity - each * length:
                    gaps.setdefault(capacity - each * length, []).append((made, sequences))
                rank, made = rank + sequences * each, made + sequences
    return events


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces(doc_id, piece, length, ...)``.

    Every piece has a length of 1 to ``capacity``. Repeated rows are pieces of their own. An empty
    table gives an empty one.
    """
    spark = pieces.sparkSession
    rows = cut(pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(SHARDS))))
    counts = rows.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_shard")) - F.col("_n")).drop("_n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    events = spark.createDataFrame(rounds(histogram, capacity), "_length long, _from long, _to long, _first long, _each long, _offset long")
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy("length", "_shard").orderBy("_row"))).join(before, ["length", "_shard"]).withColumn("_rank", F.col("_before") + F.col("_i") - 1)
    # the rounds are as many as the length classes allow, however many pieces there are
    placed = ranked.join(F.broadcast(events), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(
        *pieces.columns,
        (F.col("_first") + F.expr("(_rank - _from) div _each")).alias("sequence_id"),
        (F.col("_offset") + (F.col("_rank") - F.col("_from")) % F.col("_each") * F.col("length")).alias("offset"),
    )


def op5_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenize(table(spark, sf_dir, "documents")))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the placement of every piece of the documents that are left."""
    return pack(tokenize(docs))
