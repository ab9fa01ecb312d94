"""Rankings and contrasts of configurations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.columns import configuration_label, percent_change
from tallymark.operators.metrics import rounded

CELL = ["workload", "machine_type"]
#: A leader's rivals within this share of its mean are its tier.
PRACTICAL_MARGIN = 0.10


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def in_plans(df: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows of known plans, with the workload their plan stands for (F2); ``plans(plan_id, workload)`` is small."""
    return df.join(F.broadcast(plans), "plan_id")


def controlled_threads(df: DataFrame, controls: DataFrame) -> DataFrame:
    """Rows whose thread setting is their decoder's control value; a decoder without one is controlled at null."""
    joined = df.join(F.broadcast(controls.select("decoder", F.col("requested_threads").alias("_control"))), "decoder", "left")
    return joined.filter(F.col("requested_threads").eqNullSafe(F.col("_control"))).drop("_control")


def best(df: DataFrame, keys: Sequence[str], mean: str = "mean") -> DataFrame:
    """The configuration with the largest mean of each group; ties by label, then workers, where none counts as -1."""
    workers = F.when(F.coalesce("workers", F.lit(0)) == 0, -1).otherwise(F.col("workers"))
    order = F.struct(F.col(mean).isNull(), -F.col(mean), configuration_label(F.col("decoder"), F.col("requested_threads")), workers)
    rest = [c for c in df.columns if c not in keys]
    # an aggregate, unlike a window, leaves one row a group of each task before the shuffle
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_b")).select(*[c if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks by value down; ties share the mean of their places."""
    down = Window.partitionBy(*keys).orderBy(F.desc(value))
    return df.withColumn(name, F.rank().over(down) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2)


def rank_correlation(left: DataFrame, right: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """Spearman's correlation of two rankings of the same items (A13); null where a ranking is constant."""
    a = average_rank(left, keys, value, "_a").select(*keys, item, "_a")
    b = average_rank(right, keys, value, "_b").select(*keys, item, "_b")
    out = a.join(b, [*keys, item]).groupBy(*keys).agg(rounded(F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b"))).alias("rho"), F.count("*").alias("items"))
    return out


def top_tier(df: DataFrame, keys: Sequence[str], mean: str = "mean", margin: float = PRACTICAL_MARGIN) -> DataFrame:
    """Rows within ``margin`` of their group's leader, with their place."""
    w = Window.partitionBy(*keys)
    tier = df.withColumn("_top", F.max(mean).over(w)).filter(F.col(mean) >= F.col("_top") * (1 - margin)).drop("_top")
    return tier.withColumn("place", F.row_number().over(w.orderBy(F.desc(mean), configuration_label(F.col("decoder"), F.col("requested_threads")))))


def paired_ratio(df: DataFrame, left: Column, right: Column, keys: Sequence[str], block: str = "repetition", value: str = "v") -> DataFrame:
    """Two configurations' values of the same blocks, as ratios (J9). ``unpaired`` says where one side lacks the block."""
    a = df.filter(left).select(*keys, block, F.col(value).alias("_l"))
    b = df.filter(right).select(*keys, block, F.col(value).alias("_r"))
    return a.join(b, [*keys, block], "full_outer").select(*keys, block, rounded(F.try_divide(F.col("_l"), F.col("_r"))).alias("ratio"), (F.col("_l").isNull() | F.col("_r").isNull()).alias("unpaired"))


def thread_contrast(agg: DataFrame, decoders: Sequence[str], base_workers: Sequence[int]) -> DataFrame:
    """Default threads against one thread, in percent: decoding directly, loader at its peak over the base workers."""
    keys = [*CELL, "decoder"]
    some = agg.filter(F.col("decoder").isin(*decoders) & (F.col("requested_threads").isNull() | (F.col("requested_threads") == 1)))
    some = some.filter((F.col("protocol") == "decode-memory") | F.col("workers").isin(*base_workers))
    peak = some.groupBy(*keys).agg(*[
        F.max(F.when((F.col("protocol") == p) & (F.col("requested_threads").isNull() if d else F.col("requested_threads") == 1), F.col("mean"))).alias(n)
        for p, d, n in (("decode-memory", True, "_dd"), ("decode-memory", False, "_d1"), ("loader-supply", True, "_ld"), ("loader-supply", False, "_l1"))
    ])
    return peak.select(*keys, rounded(percent_change(F.col("_dd"), F.col("_d1"))).alias("decode_default_vs_one_percent"), rounded(percent_change(F.col("_ld"), F.col("_l1"))).alias("loader_default_vs_one_percent"))


def worker_transfer(agg: DataFrame) -> DataFrame:
    """Decoders whose best worker count differs between the two workloads of a machine."""
    peak = best(agg.filter("protocol = 'loader-supply'"), [*CELL, "decoder"])
    both = peak.groupBy("machine_type", "decoder").pivot("workload", ["native", "mixed"]).agg(F.first("workers"))
    changed = F.array_sort(F.collect_list(F.when(~F.col("native").eqNullSafe(F.col("mixed")), F.col("decoder"))))
    return both.groupBy("machine_type").agg(changed.alias("changed_decoders"), F.count("*").alias("decoders"))


def peak_workers(agg: DataFrame) -> DataFrame:
    """How many decoders peak at each worker count (the histograms of J11)."""
    peak = best(agg.filter("protocol = 'loader-supply'"), [*CELL, "decoder"])
    return peak.groupBy(*CELL, "workers").agg(F.count("*").alias("decoders"))


def boundary_peaks(agg: DataFrame, grid: Sequence[int]) -> DataFrame:
    """Cells whose peak is at the largest tested worker count."""
    tested = agg.filter((F.col("protocol") == "loader-supply") & F.col("workers").isin(*grid))
    return best(tested, [*CELL, "decoder"]).filter(F.col("workers") == max(grid)).select(*CELL, "decoder", "workers", "mean")


def followup_candidates(blocks: DataFrame, cells: DataFrame, grid: Sequence[int], high: int = 12, low: int = 8, minimum_gain: float = 0.05) -> DataFrame:
    """Of ``cells(workload, machine_type, decoder)`` those worth another worker level.

    ``blocks``: per-repetition values ``v`` of the loader. A curve is complete if each of its repetitions has all of ``grid``, so that
    every block at ``high`` workers has its pair at ``low``. A cell qualifies if its curve is complete, its mean
    at ``high`` gains ``minimum_gain`` on ``low`` and no paired block loses. Cells without blocks stay, unselected.
    """
    keys = [*CELL, "decoder"]
    loader = blocks.filter("protocol = 'loader-supply'")
    per = loader.groupBy(*keys, "repetition").agg(F.max(F.when(F.col("workers") == high, F.col("v"))).alias("_h"), F.max(F.when(F.col("workers") == low, F.col("v"))).alias("_l"), F.count_distinct(F.when(F.col("workers").isin(*grid), F.col("workers"))).alias("_points"))
    cell = per.groupBy(*keys).agg((F.try_divide(F.avg("_h"), F.avg("_l")) - 1).alias("_gain"), F.min(F.try_divide(F.col("_h"), F.col("_l"))).alias("_least"), F.min("_points").alias("_points"), F.count("*").alias("_blocks"))
    out = cells.join(cell, keys, "left")
    full = F.coalesce(F.col("_points") == len(set(grid)), F.lit(False))
    chosen = F.coalesce(full & (F.col("_gain") >= minimum_gain) & (F.col("_least") >= 1), F.lit(False))
    return out.select(*keys, rounded(F.col("_gain") * 100).alias("gain_percent"), rounded(F.col("_least")).alias("minimum_ratio"), F.coalesce("_blocks", F.lit(0).cast("long")).alias("blocks"), full.alias("complete"), chosen.alias("selected"))


def followup_totals(candidates: DataFrame) -> DataFrame:
    """How many cells were selected, and how many runs launching them takes, one a block."""
    return candidates.agg(F.count_if("selected").alias("candidate_count"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("blocks"))), F.lit(0).cast("long")).alias("bundle_count_if_launched"))


def decision_rows(agg: DataFrame, blocks: DataFrame) -> DataFrame:
    """The decision table (A14): one row a workload and machine.

    ``agg``: controlled cells (workload, machine_type, protocol, decoder, requested_threads, workers, mean).
    ``blocks``: the same with repetition and ``v``. The regret is what the loader loses by using the decode
    leader instead of its own; ``worst_block_regret_percent`` is its largest over paired blocks.
    """
    decode, loader = agg.filter("protocol = 'decode-memory'"), agg.filter("protocol = 'loader-supply'")
    direct = best(decode, [*CELL, "decoder"])
    peak = best(loader, [*CELL, "decoder"])
    leader = best(direct, CELL).select(*CELL, F.col("decoder").alias("decode_leader"), F.col("mean").alias("decode_leader_mean"))
    winner = best(peak, CELL).select(*CELL, F.col("decoder").alias("loader_leader"), F.col("mean").alias("loader_leader_mean"), F.col("workers").alias("loader_leader_workers"), F.col("requested_threads").alias("_wt"))
    chosen = peak.select(*CELL, F.col("decoder").alias("decode_leader"), F.col("mean").alias("_chosen"), F.col("workers").alias("selected_workers"), F.col("requested_threads").alias("_ct"))
    rows = leader.join(winner, CELL).join(chosen, [*CELL, "decode_leader"])
    series = blocks.filter("protocol = 'loader-supply'").select(*CELL, "decoder", "requested_threads", "workers", "repetition", "v")
    side = lambda who, workers, threads, name: rows.select(*CELL, F.col(who).alias("decoder"), F.col(workers).alias("_w"), F.col(threads).alias("_t")).join(series, [*CELL, "decoder"]).filter(F.col("workers").eqNullSafe(F.col("_w")) & F.col("requested_threads").eqNullSafe(F.col("_t"))).select(*CELL, "repetition", F.col("v").alias(name))
    regret = side("decode_leader", "selected_workers", "_ct", "_a").join(side("loader_leader", "loader_leader_workers", "_wt", "_b"), [*CELL, "repetition"]).groupBy(*CELL).agg(rounded(F.max((1 - F.try_divide(F.col("_a"), F.col("_b"))) * 100)).alias("worst_block_regret_percent"), F.count("*").alias("paired_blocks"))
    rho = rank_correlation(direct, peak, CELL, "decoder", "mean").select(*CELL, "rho")
    tier = top_tier(peak, CELL).groupBy(*CELL).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "decoder"))), lambda r: r["decoder"]).alias("top_tier"))
    out = rows.join(regret, CELL, "left").join(rho, CELL, "left").join(tier, CELL)
    return out.select(
        *CELL, "decode_leader", "decode_leader_mean", "loader_leader", "loader_leader_mean", "loader_leader_workers", "selected_workers",
        rounded((1 - F.try_divide(F.col("_chosen"), F.col("loader_leader_mean"))) * 100).alias("regret_percent"), "worst_block_regret_percent", "paired_blocks",
        F.col("rho").alias("rank_correlation"), (F.col("decode_leader") == F.col("loader_leader")).alias("leaders_match"), "top_tier",
    )


def matrix_gaps(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells whose expected and observed counts differ (J14, V11); keys compare null-safely."""
    e = expected.select(*keys, F.col("n").cast("long").alias("expected"), F.lit(0).cast("long").alias("observed"))
    o = observed.select(*keys, F.lit(0).cast("long").alias("expected"), F.lit(1).cast("long").alias("observed"))
    # grouping, unlike an outer join, compares null keys as equal and shuffles partial sums only
    return e.unionByName(o).groupBy(*keys).agg(F.sum("expected").alias("expected"), F.sum("observed").alias("observed")).filter("expected <> observed")


def scope_check(runs: DataFrame, scopes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs that no allowed row of ``scopes`` matches."""
    return runs.join(F.broadcast(scopes), null_safe(runs, scopes, keys), "left_anti")


def set_gaps(expected: DataFrame, observed: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Cells whose set of whole numbers ``member`` is not the expected one (J14, V11): how many are missing, extra and repeated.

    Repetitions, or items by their ordinals, become bits: one aggregate, merged before the shuffle, makes the bitmaps of each cell and each 32,768
    numbers (a null counts as no number), so a cell is a few bytes of its rows whatever its size. Null keys are cells like others.
    """
    sides = expected.select(*keys, member, F.lit(False).alias("_seen")).unionByName(observed.select(*keys, member, F.lit(True).alias("_seen"))).filter(F.col(member).isNotNull())
    bit, seen = F.bitmap_bit_position(member), F.col("_seen")
    bits = lambda c: F.bitmap_count(F.bitmap_construct_agg(c))
    parts = sides.groupBy(*keys, F.bitmap_bucket_number(member).alias("_bucket")).agg(bits(F.when(~seen, bit)).alias("_e"), bits(F.when(seen, bit)).alias("_o"), bits(bit).alias("_all"), F.count_if(seen).alias("_n"))
    out = parts.groupBy(*keys).agg(F.sum(F.col("_all") - F.col("_o")).alias("missing"), F.sum(F.col("_all") - F.col("_e")).alias("extra"), F.sum(F.col("_n") - F.col("_o")).alias("repeated"))
    return out.filter("missing > 0 or extra > 0 or repeated > 0")
