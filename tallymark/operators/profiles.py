"""Profiles of workloads and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.digests import set_digest
from tallymark.operators.metrics import distribution_quantiles


def manifest_split(items: DataFrame, support: DataFrame, key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Timed and excluded items."""
    return items.join(support, key, "left_semi"), items.join(support, key, "left_anti")


def attach_provenance(items: DataFrame, provenance: DataFrame, digest: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """Items with the last listed provenance of their digest, and the items that have none."""
    rest = [c for c in provenance.columns if c not in (digest, ordinal)]
    last = provenance.groupBy(digest).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("_p")).select(digest, "_p.*")
    return items.join(last, digest), items.join(last, digest, "left_anti")


def workload_profile(timed: DataFrame, excluded: DataFrame, workload: str = "workload_id") -> DataFrame:
    """Counts and sizes of each workload's timed items, with how many are excluded."""
    label = F.col("subsampling")
    per = timed.groupBy(workload).agg(F.count("*").alias("items"), F.count_if("progressive").alias("progressive"), F.sum("compressed_bytes").alias("total_bytes"), *[F.count_if(label == s).alias(n) for s, n in (("4:4:4", "s444"), ("4:2:2", "s422"), ("4:2:0", "s420"), ("grayscale", "gray"))])
    out = excluded.groupBy(workload).agg(F.count("*").alias("excluded"))
    return per.join(out, workload, "full_outer").na.fill(0)


def workload_quantiles(timed: DataFrame, metrics: Sequence[str], workload: str = "workload_id") -> DataFrame:
    return distribution_quantiles(timed, [workload], metrics)


def profile_histograms(timed: DataFrame, columns: Sequence[str], workload: str = "workload_id") -> DataFrame:
    """``workload, metric, value, n``: how timed items spread over each column's values, such as provenance and quality."""
    long = timed.select(workload, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in columns])).alias("m")).select(workload, "m.*")
    return long.groupBy(workload, "metric", "value").agg(F.count("*").alias("n"))


def excluded_histograms(workloads: DataFrame, excluded: DataFrame, columns: Sequence[str], workload: str = "workload_id") -> DataFrame:
    """How excluded items spread over each column's values (A9); a workload without any keeps one row a column with a null value and 0."""
    base = workloads.select(workload).distinct().withColumn("metric", F.explode(F.array(*[F.lit(c) for c in columns])))
    return base.join(profile_histograms(excluded, columns, workload), [workload, "metric"], "left").na.fill(0, ["n"])


def excluded_profile(workloads: DataFrame, excluded: DataFrame, column: str, workload: str = "workload_id") -> DataFrame:
    """How excluded items spread over a column's values (A9); a workload without any keeps one row with a null value and 0."""
    counts = excluded.groupBy(workload, column).agg(F.count("*").alias("n"), F.count_if("progressive").alias("progressive"))
    return workloads.select(workload).distinct().join(counts, workload, "left").na.fill(0, ["n", "progressive"])


def coverage(runs: DataFrame, failures: DataFrame, workload: str = "workload_id", repetition: str | None = None, items: DataFrame | None = None, timed: DataFrame | None = None) -> DataFrame:
    """Runs of each workload, and those with any failure.

    With ``repetition`` also how many different ones there are; with ``items`` and ``timed`` (rows by workload) how many items each
    workload's manifest has and how many of them are timed.
    """
    failed = failures.select("run_key").distinct().withColumn("_failed", F.lit(True))
    more = [F.count_distinct(repetition).alias("repetitions")] if repetition else []
    out = runs.join(failed, "run_key", "left").groupBy(workload).agg(F.count("*").alias("runs"), F.count_if(F.col("_failed").isNotNull()).alias("runs_with_failures"), *more)
    for name, rows in (("manifest_items", items), ("timed_items", timed)):
        if rows is not None:
            out = out.join(rows.groupBy(workload).agg(F.count("*").alias(name)), workload, "left").na.fill(0, [name])
    return out


def versions_consistent(distributions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted packages with the versions found; consistent means exactly one."""
    found = distributions.groupBy("name").agg(F.array_sort(F.collect_set("version")).alias("versions"))
    joined = wanted.join(found, "name", "left").withColumn("versions", F.coalesce("versions", F.array().cast("array<string>")))
    return joined.withColumn("consistent", F.size("versions") == 1)


def same_population(df: DataFrame, group: str, run: str, item: str) -> DataFrame:
    """Groups whose runs do not all have the same item set, and how many sets there are (U4)."""
    sets = df.select(group, run, item).distinct().groupBy(group, run).agg(set_digest(F.col(item).cast("string")).alias("_set"))
    return sets.groupBy(group).agg(F.count_distinct("_set").alias("populations"), F.count("*").alias("runs"))
