"""Summaries of samples and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.columns import STATISTICS, finite_positive, throughput
from tallymark.operators.ranks import running_sum
from tallymark.operators.selection import exact_quantiles, with_quantiles
from tallymark.operators.validate import violation
from tallymark.sources.sinks import materialize

#: Decimals of aggregates over several rows, whose last bits depend on the order of summation.
DIGITS = 6


def rounded(value: Column) -> Column:
    return F.round(value, DIGITS)


def summarize_distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, exact median, minimum, maximum, sample deviation (null for one value) and its ratio to the mean (A1)."""
    v = F.col(value)
    stats = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.stddev_samp(v).alias("sample_std"))
    out = with_quantiles(stats, df, keys, value, {"median": 0.5})
    out = out.withColumn("coefficient_of_variation", rounded(F.try_divide("sample_std", "mean")))
    return out.select(*keys, "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "median")], "minimum", "maximum", rounded(F.col("sample_std")).alias("sample_std"), "coefficient_of_variation")


def invalid_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is not finite and positive, as violations: A1 assumes there are none."""
    return violation(df.filter(~finite_positive(F.col(value))), keys, "value-not-positive", F.col(value))


def summarize_benchmark(samples: DataFrame, keys: Sequence[str] = ("run_key",)) -> DataFrame:
    """A1 of each statistic, computed per sample and then summarised (A2): a mean of ratios, not a ratio of sums.

    All statistics are aggregated in one pass over the samples; only the results are turned into rows.
    """
    v = {s: throughput(F.col("elapsed_seconds"), F.col("items_processed"), s) for s in STATISTICS}
    wide = samples.select(*keys, *[c.alias(f"_{s}") for s, c in v.items()]).groupBy(*keys)
    measures = {"n": F.count, "mean": F.avg, "median": F.median, "minimum": F.min, "maximum": F.max, "sample_std": F.stddev_samp}
    out = wide.agg(*[F.struct(F.lit(s).alias("statistic"), *[f(f"_{s}").alias(n) for n, f in measures.items()]).alias(s) for s in STATISTICS])
    out = out.select(*keys, F.explode(F.array(*STATISTICS)).alias("_s")).select(*keys, "_s.*").withColumn("coefficient_of_variation", rounded(F.try_divide("sample_std", "mean")))
    return out.select(*keys, "statistic", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "median")], "minimum", "maximum", rounded(F.col("sample_std")).alias("sample_std"), "coefficient_of_variation")


def mixed_item_counts(samples: DataFrame) -> DataFrame:
    """Runs whose samples processed different numbers of items, as violations."""
    per = samples.groupBy("run_key").agg(F.min("items_processed").alias("lo"), F.max("items_processed").alias("hi"))
    return violation(per.filter("lo <> hi"), ["run_key"], "mixed-item-counts", F.concat_ws("..", "lo", "hi"))


def run_mean(samples: DataFrame, statistic: str) -> DataFrame:
    """``run_key, run_mean`` (A3)."""
    return samples.groupBy("run_key").agg(F.avg(throughput(F.col("elapsed_seconds"), F.col("items_processed"), statistic)).alias("run_mean"))


def group_members(runs: DataFrame, samples: DataFrame, keys: Sequence[str], statistic: str) -> DataFrame:
    """The runs of each group of :func:`group_runs` with their means, a row each, written once to the shared folder."""
    columns = [c for c in ("repetition", "run_key", "platform_id", "location") if c not in keys]
    return materialize(runs.join(run_mean(samples, statistic), "run_key").select(*keys, *columns, "run_mean"), "members")


def group_statistics(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups of ``members`` (see :func:`group_members`) by ``keys`` (A4) without their runs: no task and no row holds a group.

    Statistics are those of the runs' means, so each run weighs the same; ``repeated`` says whether a repetition occurs twice.
    """
    stats = members.groupBy(*keys).agg(
        F.count("*").alias("n"),
        rounded(F.avg("run_mean")).alias("mean"),
        rounded(F.stddev_samp("run_mean")).alias("sample_std"),
        F.array_sort(F.collect_set("platform_id")).alias("platform_ids"),
        F.array_sort(F.collect_set("location")).alias("platform_locations"),
        F.count("run_mean").alias("_values"),
    )
    kept = materialize(stats, "groups")
    medians = exact_quantiles(members, keys, "run_mean", {"median": 0.5}, kept.select(*keys, F.col("_values").alias("n")))
    repetitions = members.groupBy(*keys).agg(F.count_distinct("repetition").alias("_repetitions"))
    out = by_keys(by_keys(kept, medians, keys), repetitions, keys)
    return out.select(*keys, "n", "mean", rounded(F.col("median")).alias("median"), "sample_std", "platform_ids", "platform_locations", (F.col("n") > F.col("_repetitions")).alias("repeated"))


def by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row of ``left`` with what ``right`` has for its keys, where a null key is a value of its own."""
    named = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(F.col(f"_{k}"))
    return left.join(named, same, "left").drop(*[f"_{k}" for k in keys])


def group_runs(runs: DataFrame, samples: DataFrame, keys: Sequence[str], statistic: str) -> DataFrame:
    """Groups of runs by ``keys`` (A4): statistics of the runs' means, with the runs of each as arrays.

    ``runs`` has ``repetition``, ``platform_id`` and ``location`` beside the keys. The arrays go by repetition, then
    run key; ``repeated`` says whether a repetition occurs twice. A group's runs become one row, so this is for groups that fit one:
    :func:`group_statistics` and :func:`group_members` have the same without arrays for groups of any size.
    """
    members = group_members(runs, samples, keys, statistic)
    held = members.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("repetition", "run_key", "run_mean"))).alias("_rows"))
    pick = lambda name: F.transform("_rows", lambda r: r[name])
    arrays = {"run_keys": pick("run_key"), "repetitions": pick("repetition"), "raw_run_means": F.transform("_rows", lambda r: F.round(r["run_mean"], DIGITS))}
    return by_keys(group_statistics(members, keys), held, keys).withColumns(arrays).drop("_rows")


def result_rows(runs: DataFrame, samples: DataFrame, statistic: str) -> DataFrame:
    """A run's row with its summary and its samples' values in order (A5)."""
    v = throughput(F.col("elapsed_seconds"), F.col("items_processed"), statistic)
    values = samples.select("run_key", "sample_index", v.alias("value"))
    raw = F.transform(F.array_sort(F.collect_list(F.struct("sample_index", "value"))), lambda r: r["value"])
    per = values.groupBy("run_key").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"), rounded(F.stddev_samp("value")).alias("sample_std"), raw.alias("raw_values"))
    return runs.join(per, "run_key")


def aggregate_measurements(measurements: DataFrame, keys: Sequence[str], repetitions: Sequence[int]) -> DataFrame:
    """Configuration cells over their repetitions (A6); a null key is a value of its own.

    Values of one repetition are averaged first. ``complete``: the cell has exactly ``repetitions``.
    """
    per = measurements.groupBy(*keys, "repetition").agg(F.avg("images_per_second").alias("v"))
    rows = F.array_sort(F.collect_list(F.struct("repetition", "v")))
    out = per.groupBy(*keys).agg(F.count("*").alias("n"), rounded(F.avg("v")).alias("mean"), rounded(F.stddev_samp("v")).alias("sample_std"), rows.alias("_r"))
    out = out.withColumn("repetitions", F.transform("_r", lambda r: r["repetition"])).withColumn("raw_run_means", F.transform("_r", lambda r: F.round(r["v"], DIGITS))).drop("_r")
    return out.withColumn("complete", F.col("repetitions") == F.array(*[F.lit(r) for r in sorted(repetitions)]))


def distribution_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Minimum, 10 %, median, 90 % and maximum of each column by linear interpolation at (n - 1) p (A7), one row a column."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select(*keys, "m.*").filter("v is not null")
    by = [*keys, "metric"]
    whole = long.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))
    points = {"q10": 0.1, "median": 0.5, "q90": 0.9}
    return with_quantiles(whole, long, by, "v", points).select(*by, "minimum", *[rounded(F.col(n)).alias(n) for n in points], "maximum")


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """A10."""
    return df.groupBy(*keys, column).agg(F.count("*").alias("n"))


def byte_totals(items: DataFrame, keys: Sequence[str], distinct: Sequence[str] = ()) -> DataFrame:
    """Item count, bytes, and the largest decoded size, where a missing side counts 0.

    ``distinct``: columns, such as provenance and scene, whose different values are counted as ``distinct_<column>``.
    """
    side = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return items.groupBy(*keys).agg(
        F.count("*").alias("items"), F.sum("compressed_bytes").alias("total_bytes"), F.max(side("width") * side("height") * 3).alias("max_decoded_bytes"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in distinct]
    )


def phase_durations(events: DataFrame, phases: Sequence[str]) -> DataFrame:
    """Each run's total duration and count by phase event (A22), one column a phase."""
    agg = events.groupBy("run_key").pivot("event", list(phases)).agg(rounded(F.sum("duration_seconds")).alias("seconds"), F.count(F.lit(1)).alias("n"))
    return agg.na.fill(0, [c for c in agg.columns if c.endswith("_n")])


def ecdf(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """Adds ``fraction``: position / n in ascending order, so ties make several steps."""
    total = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_total"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return running_sum(df, keys, [value, *tie], F.lit(1).cast("long"), "_place").join(total, same).withColumn("fraction", F.col("_place") / F.col("_total")).drop("_place", "_total", *[f"_{k}" for k in keys])


def relative_to_first(per_block: DataFrame, cell: Sequence[str], point: str = "workers", block: str = "repetition", value: str = "v") -> DataFrame:
    """Each point's mean ratio to the first point of its cell, taken within blocks."""
    w = Window.partitionBy(*cell, block).orderBy(point)
    ratio = per_block.filter(F.col(point).isNotNull()).withColumn("ratio", F.try_divide(F.col(value), F.first_value(value).over(w)))
    return ratio.groupBy(*cell, point).agg(rounded(F.avg("ratio")).alias("mean_ratio"), F.count("*").alias("blocks"))


def consecutive_index(samples: DataFrame, index: str = "sample_index", tie: Sequence[str] = ()) -> DataFrame:
    """Runs whose sample indices are not 0 .. n - 1 (W8), with how many rows are out of place."""
    w = Window.partitionBy("run_key").orderBy(index, *tie)
    out = samples.withColumn("expected", F.row_number().over(w) - 1)
    return out.groupBy("run_key").agg(F.count_if(~F.col(index).eqNullSafe(F.col("expected"))).alias("misplaced"), F.count("*").alias("n")).filter("misplaced > 0")
