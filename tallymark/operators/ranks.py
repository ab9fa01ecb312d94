"""Running sums and ranks of large ordered groups, so that no group is one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.sources.sinks import materialize


def _with_offsets(placed: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds ``name``: the running sum of ``_v`` by ``order`` in each group, from sums within ``_part`` and over the parts before it."""
    totals = placed.groupBy(*keys, "_part").agg(F.sum("_v").alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).alias("_before")
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), before)
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_upto", F.sum("_v").over(within))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & local[k].eqNullSafe(F.col(f"_{k}"))
    return local.join(totals, same).withColumn(name, F.col("_before") + F.col("_upto")).drop("_v", "_part", "_p", "_n", "_before", "_upto", *[f"_{k}" for k in keys])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the running sum of ``value``, this row included, by ``order`` in each group.

    Rows are sorted by range once; sums run within a range, and each range adds the totals of those before it.
    """
    ranged = df.withColumn("_v", value).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    return _with_offsets(materialize(ranged, "ranges"), keys, order, name)


def rank_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], part: Column, name: str) -> DataFrame:
    """Adds the position, from 0, by ``order`` in each group. ``part`` never falls along the order and splits groups into parts of bounded size."""
    out = _with_offsets(df.withColumn("_v", F.lit(1).cast("long")).withColumn("_part", part), keys, order, name)
    return out.withColumn(name, F.col(name) - 1)
