"""Selecting complete, deterministic samples from catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.columns import luminance_sum, salted_hash
from tallymark.operators.ranks import rank_by, running_sum
from tallymark.operators.validate import first_over_limit

PROVENANCES = ("orig", "facebook", "instagram", "telegram", "twitter", "whatsapp")


def complete_groups(df: DataFrame, keys: Sequence[str], observed: Sequence[str] = (), declared: DataFrame | None = None) -> DataFrame:
    """Relational division (J1): keys that have every combination of the observed and the declared values.

    ``observed``: columns whose values in ``df`` count; ``declared``: a small table whose rows count.
    """
    dims = [*observed, *(declared.columns if declared is not None else [])]
    matrix = df.select(*observed).distinct() if observed else None
    if declared is not None:
        matrix = declared.distinct() if matrix is None else matrix.crossJoin(F.broadcast(declared.distinct()))
    whole = matrix.agg(F.count("*").alias("_all"))
    have = df.join(F.broadcast(declared.distinct()), list(declared.columns), "left_semi") if declared is not None else df
    per = have.groupBy(*keys).agg(F.count_distinct(F.struct(*dims)).alias("_have"))
    return per.join(F.broadcast(whole), F.col("_have") == F.col("_all")).select(*keys)


def select_top_hashed(ids: DataFrame, column: str, count: int, seed: int, salt: str) -> DataFrame:
    """``count`` distinct ids, first by a salted hash."""
    if count <= 0:
        raise ValueError("count must be positive")
    key = salted_hash(F.lit(salt), F.lit(seed), F.col(column))
    return ids.select(column).distinct().withColumn("key", key).orderBy("key", column).limit(count)


def seeded_order(df: DataFrame, keys: Sequence[str], column: str, seed: int, salt: str) -> DataFrame:
    """Adds ``position``, from 0, by a hash of salt, seed, group and id."""
    key = salted_hash(F.lit(salt), F.lit(seed), *[F.col(k) for k in keys], F.col(column))
    # the hash is hexadecimal, so its first digits split a group evenly
    return rank_by(df.withColumn("_key", key), keys, ["_key", column], F.substring("_key", 1, 2), "position").drop("_key")


def catalog_order(df: DataFrame, provenances: Sequence[str] = PROVENANCES) -> DataFrame:
    """By scene, device, and provenance in declared order."""
    return df.orderBy("scene_id", "device_id", F.array_position(F.array(*[F.lit(p) for p in provenances]), F.col("provenance")))


def native_view(catalog: DataFrame, original: str = "orig") -> DataFrame:
    """Two workloads of one catalogue: the originals, and all members."""
    return catalog.filter(F.col("provenance") == original).withColumn("workload", F.lit("native")).unionByName(catalog.withColumn("workload", F.lit("mixed")))


def byte_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, limit: int) -> DataFrame:
    """The first row of each group at which the running total passes the limit (W7); groups within it have none."""
    return first_over_limit(running_sum(df, keys, order, F.col(size), "running_bytes"), keys, order, "running_bytes", limit)


def nearest_quality(df: DataFrame, column: str) -> DataFrame:
    """The encoder quality whose scaled luminance table has the nearest sum, ties to the lower.

    The reference has 100 rows whatever the data. Distinct sums are matched once and joined back.
    """
    spark = df.sparkSession
    reference = spark.range(1, 101).select(F.col("id").cast("int").alias("quality"), luminance_sum(F.col("id")).alias("_sum"))
    sums = df.select(column).distinct()
    near = sums.join(F.broadcast(reference)).groupBy(column).agg(F.min_by("quality", F.struct(F.abs(F.col("_sum") - F.col(column)), "quality")).alias("quality_estimate"))
    return df.join(near, column, "left")


def dedup_blobs(items: DataFrame, digest: str, order: Sequence[str], path: str) -> DataFrame:
    """One blob a digest: the path of its first item."""
    return items.groupBy(digest).agg(F.min_by(path, F.struct(*order)).alias("path"), F.count("*").alias("logical_items"))


def resolve_items(pinned: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pinned ids in their order with their items, and the pinned ids that are missing or ambiguous."""
    per = items.groupBy("item_id").agg(F.count("*").alias("_n"))
    checked = pinned.join(per, "item_id", "left")
    bad = checked.filter(F.coalesce("_n", F.lit(0)) != 1).select("item_id", F.coalesce("_n", F.lit(0)).alias("n"))
    return pinned.join(items, "item_id").orderBy("ordinal"), bad
