"""Experiment matrices: expansion, order, memory and what is still to run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.columns import hyphenated_name, salted_hash

STATUSES = ("completed", "skipped", "failed", "timeout", "pending")


def expand_matrix(decoders: DataFrame, workers: DataFrame) -> DataFrame:
    """All cells of an experiment (J13): ``decoders(decoder, requested_threads)`` decoding, and each with every worker level.

    ``workers(num_workers, prefetch_factor, start_method)``. Fields that a protocol or an idle loader has no use for are null.
    """
    decode = decoders.withColumn("protocol_id", F.lit("decode-memory"))
    busy = F.col("num_workers") > 0
    loader = decoders.crossJoin(F.broadcast(workers)).withColumn("protocol_id", F.lit("loader-supply")).withColumn("prefetch_factor", F.when(busy, F.col("prefetch_factor"))).withColumn("start_method", F.when(busy, F.col("start_method")))
    return decode.unionByName(loader, allowMissingColumns=True)


def randomized_blocks(configs: DataFrame, key: str, repetitions: int, seed: int) -> DataFrame:
    """Every repetition is a permutation of all configurations by a seeded hash (W6); ``position`` runs through all.

    A block's order is a window of that block; a block's first position follows from the count of configurations.
    """
    blocks = configs.select(key).crossJoin(F.broadcast(configs.sparkSession.range(repetitions).select(F.col("id").cast("int").alias("repetition"))))
    order = salted_hash(F.lit(seed), F.col("repetition"), F.col(key))
    within = F.row_number().over(Window.partitionBy("repetition").orderBy(order, key)) - 1
    size = configs.agg(F.count("*").alias("_size"))
    return blocks.withColumn("block_position", within).join(F.broadcast(size)).withColumn("position", F.col("repetition") * F.col("_size") + F.col("block_position")).drop("_size")


def estimate_memory(configs: DataFrame, items: DataFrame, limit: float | None = None) -> DataFrame:
    """Peak bytes of each configuration over the items (A15); with ``limit``, ``fits`` says whether it stays below.

    Residents are copied to each worker process unless it forks; images in flight follow the protocol.
    """
    side = lambda c: F.col(c).cast("long")
    total = items.agg(F.sum("compressed_bytes").alias("_bytes"), F.max(side("width") * side("height") * 3).alias("_decoded"))
    c = F.col
    busy = (c("protocol_id") == "loader-supply") & (F.coalesce(c("num_workers"), F.lit(0)) > 0)
    replicas = F.when(busy & ~c("start_method").eqNullSafe(F.lit("fork")), c("num_workers") + 1).otherwise(1).cast("long")
    batch, n = c("batch_size").cast("long"), c("num_workers").cast("long")
    queued = ((n * c("prefetch_factor") + 1) * batch + n) * c("_decoded")
    flight = F.when(c("protocol_id") == "decode-memory", c("_decoded")).when(n == 0, (batch + 1) * c("_decoded")).otherwise(queued)
    out = configs.join(F.broadcast(total)).select(*configs.columns, c("_bytes").cast("long").alias("resident_compressed_bytes"), replicas.alias("resident_replica_count"), flight.cast("long").alias("decoded_inflight_bytes"))
    out = out.withColumn("estimated_peak_bytes", c("resident_compressed_bytes") * c("resident_replica_count") + c("decoded_inflight_bytes"))
    return out if limit is None else out.withColumn("fits", c("estimated_peak_bytes") <= limit)


def wildcard_platform_skip(df: DataFrame, skips: DataFrame) -> DataFrame:
    """Rows that no skip rule matches; ``*`` stands for any system or machine."""
    s = F.broadcast(skips.withColumnsRenamed({c: f"_{c}" for c in ("decoder", "system", "machine")}))
    any_ = lambda c: (F.col(f"_{c}") == "*") | (F.col(f"_{c}") == F.col(c))
    return df.join(s, (F.col("decoder") == F.col("_decoder")) & any_("system") & any_("machine"), "left_anti")


def group_filter(templates: DataFrame, capabilities: DataFrame, group: str) -> DataFrame:
    """Templates whose implementation belongs to a dependency group."""
    return templates.join(F.broadcast(capabilities.filter(F.col("dependency_group") == group).select("decoder")), "decoder", "left_semi")


def package_coverage(implementations: DataFrame, distributions: DataFrame) -> DataFrame:
    """Implementations whose package an environment lacks (J16): ``implementations(decoder, package)``."""
    named = implementations.withColumn("_package", hyphenated_name(F.col("package")))
    environments = distributions.select("environment_id").distinct()
    need = environments.crossJoin(F.broadcast(named))
    return need.join(distributions.select("environment_id", F.col("name").alias("_package")).distinct(), ["environment_id", "_package"], "left_anti").select("environment_id", "decoder", "package")


def pending_runs(specs: DataFrame, committed: DataFrame, key: str = "run_key") -> DataFrame:
    """Planned runs without a committed one."""
    return specs.join(committed.select(key), key, "left_anti")


def status_counts(attempts: DataFrame, keys: Sequence[str], statuses: Sequence[str] = STATUSES, done: Sequence[str] = ("completed", "skipped")) -> DataFrame:
    """Counts of every status, zeros included, and whether all is done."""
    status = F.col("status")
    return attempts.groupBy(*keys).agg(*[F.count_if(status == s).alias(f"n_{s}") for s in statuses], F.bool_and(status.isin(*done)).alias("complete"))


def latest_attempt(attempts: DataFrame, key: str = "run_key") -> DataFrame:
    """The newest attempt of each run, ties to the larger attempt id (W9): an aggregate, so it combines before the shuffle."""
    rest = [c for c in attempts.columns if c not in (key, "finished_at", "attempt_id")]
    top = F.max(F.struct("finished_at", "attempt_id", *rest)).alias("_top")
    return attempts.groupBy(key).agg(top).select(key, "_top.*")
