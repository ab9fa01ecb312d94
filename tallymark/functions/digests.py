"""Identity digests of rows and of ordered groups of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallymark.functions.canonical import document_text


def row_digest(columns: Sequence[str | Column]) -> Column:
    """SHA-256 of a row's canonical JSON: the columns by name, nulls included (D3)."""
    named = sorted((c if isinstance(c, str) else c._jc.toString(), c) for c in columns)
    return F.sha2(F.to_json(F.struct(*[c for _, c in named]), {"ignoreNullFields": "false"}), 256)


def ordered_digest(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], name: str) -> DataFrame:
    """One digest a group over its rows in the order of the whole number ``order``.

    Rows are hashed where they are. BLOCK consecutive numbers make a block, whose digest is that of its rows' hashes
    in order, and the group's digest is that of its blocks' digests: so a task gathers BLOCK hashes if numbers are unique, and a
    group of ten billion items some 150,000 of blocks.
    """
    hashed = df.select(*keys, F.expr(f"`{order}` div {BLOCK}").alias("_b"), F.struct(F.col(order), row_digest(columns).alias("h")).alias("_item"))
    lines = F.transform(F.array_sort(F.collect_list("_item")), lambda x: x["h"])
    blocks = hashed.groupBy(*keys, "_b").agg(F.sha2(F.concat_ws("\n", lines), 256).alias("h"), F.count("*").alias("_n"))
    tops = F.transform(F.array_sort(F.collect_list(F.struct("_b", "h"))), lambda x: x["h"])
    return blocks.groupBy(*keys).agg(F.sha2(F.concat_ws("\n", tops), 256).alias(name), F.sum("_n").alias("item_count"))


def set_digest(keys: Column) -> Column:
    """An aggregate that names a multiset of strings, whatever the order: two sums of hashes and the count, merged before the shuffle."""
    one, two = F.xxhash64(keys).cast("decimal(38,0)"), F.xxhash64(F.lit(1), keys).cast("decimal(38,0)")
    return F.sha2(F.concat_ws("/", F.sum(one).cast("string"), F.sum(two).cast("string"), F.count(F.lit(1)).cast("string")), 256)


def document_digest(text: Column, identity: str) -> Column:
    """SHA-256 of a JSON object's canonical text without its top-level field ``identity`` (D1, D2, D6, X12); null if it is none."""
    return F.sha2(document_text(text, identity), 256)


#: Consecutive order numbers that :func:`ordered_digest` digests together.
BLOCK = 1 << 16


def sequence_digest(df: DataFrame, keys: Sequence[str], value: str, name: str = "digest") -> DataFrame:
    """SHA-256 of a group's sorted values, a newline after each, and how many there are as ``n``.

    The digest's format takes all values of a group in order, so a group is one task; it passes through as a sorted
    stream of batches that update one hash, and no task holds a group. Null values are left out of the digest but counted; without any other the digest is that of one newline.
    """
    sorted_rows = df.select(*keys, F.col(value).cast("string").alias("_value")).repartition(*keys).sortWithinPartitions(*keys, "_value")
    return _streamed_digest(sorted_rows, keys, name, "", "\n", "\n")


def joined_digest(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "digest") -> DataFrame:
    """SHA-256 of a group's values by ``order`` with a comma between two, and how many rows there are as ``n``; null values are left out.

    As in :func:`sequence_digest` a group is one task but passes through it as a sorted stream.
    """
    by = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*keys, *[F.col(c).alias(b) for c, b in zip(order, by, strict=True)], F.col(value).cast("string").alias("_value"))
    return _streamed_digest(rows.repartition(*keys).sortWithinPartitions(*keys, *by), keys, name, ",", "", "")


def _streamed_digest(sorted_rows: DataFrame, keys: Sequence[str], name: str, between: str, after: str, nothing: str) -> DataFrame:
    """``keys``, SHA-256 of ``_value`` in the given order, ``between`` two and ``after`` each, and the row count ``n``; ``nothing`` where all are null."""
    types = {f.name: f.dataType for f in sorted_rows.schema.fields}
    schema = StructType([StructField(k, types[k]) for k in keys] + [StructField(name, StringType()), StructField("n", LongType())])

    def digest(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n, empty = hashlib.sha256(), 0, True
        for batch in batches:
            values = batch.column("_value").drop_null()
            n += batch.num_rows
            if len(values):
                state.update((("" if empty else between) + (after + between).join(values.to_pylist()) + after).encode())
            empty = empty and not len(values)
        if empty:
            state.update(nothing.encode())
        yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()], k.type) for k in key], pa.array([state.hexdigest()]), pa.array([n], pa.int64())], names=[*keys, name, "n"])

    return sorted_rows.groupBy(*keys).applyInArrow(digest, schema)


def comparison_key(identity: Column) -> Column:
    """A platform's identity map without its location, as a digest: zones of one machine type agree."""
    entries = F.array_sort(F.map_entries(F.map_filter(identity, lambda k, _: k != "location")))
    return F.sha2(F.concat_ws("\n", F.transform(entries, lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit(""))))), 256)
