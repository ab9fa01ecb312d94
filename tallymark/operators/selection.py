"""Exact quantiles of groups of any size, without sorting, writing or gathering their rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.sources.sinks import materialize

#: Rows of a group that one aggregate may hold.
LIMIT = 1 << 18
#: Steps of the sketch that narrows a group down, and its accuracy, which is finer than a step.
STEPS, ACCURACY = 256, 4000


def _same(left: DataFrame, keys: Sequence[str], prefix: str = "_") -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float], stats: DataFrame, limit: int = LIMIT, steps: int = STEPS) -> DataFrame:
    """``keys`` and a column for each of ``points``: the value at (n - 1) p of the sorted group, between two values by interpolation.

    ``stats``: a written table of ``keys`` and ``n``, the non-null values of each group. Groups of at most ``limit`` rows are one aggregate each. A larger
    group is narrowed down: a mergeable sketch of what is left proposes two values about each wanted rank, exact counts tell in which of the parts below, at,
    between and above them the rank lies, and the rank's part is what is left, until it is one value or has at most ``limit`` rows. Each part is
    smaller than the whole, so it ends with certainty; with a good sketch it shrinks some hundred-fold each time. A round reads the rows twice and shuffles sketches and counts.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    wide = stats.filter(F.col("n") > limit)
    names = [f"_{k}" for k in keys]
    by_key = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    any_wide = not wide.isEmpty()
    small = rows.join(F.broadcast(wide.select(*by_key)), _same(rows, keys), "left_anti") if any_wide else rows
    out = small.groupBy(*keys).agg(*[F.percentile("_v", F.lit(p)).alias(n) for n, p in points.items()])
    if not any_wide:
        return out
    sides = F.explode(F.array(*[F.struct(F.lit(f"{n}_{s}").alias("t"), f((F.col("n") - 1) * p).cast("long").alias("r")) for n, p in points.items() for s, f in (("lo", F.floor), ("hi", F.ceil))]))
    none = F.lit(None).cast("double")
    # a target is a rank among the rows between two values, both outside, of its group; ``_x`` is its value once that is known
    now = wide.select(*by_key, "n", sides.alias("_s")).select(*names, F.col("_s.t").alias("_t"), F.col("_s.r").alias("_r"), none.alias("_lo"), none.alias("_hi"), F.col("n").alias("_rows"), none.alias("_x"))
    now = materialize(now, "targets")

    def inside(targets: DataFrame) -> DataFrame:  # two targets a point and group of more than ``limit`` rows
        between = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
        return rows.join(F.broadcast(targets), _same(rows, keys) & between)

    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    target = [*names, "_t", "_r", "_lo", "_hi", "_rows"]
    open_ = F.col("_x").isNull() & (F.col("_rows") > limit)
    while not (todo := now.filter(open_)).isEmpty():
        sketch = inside(todo).groupBy(*target).agg(F.percentile_approx("_v", grid, ACCURACY).alias("_b"))
        step = F.floor(F.col("_r") * steps / F.col("_rows")).cast("int")
        around = materialize(sketch.select(*target, F.get("_b", F.greatest(step - 1, F.lit(0))).alias("_a"), F.get("_b", F.least(step + 2, F.lit(steps))).alias("_z")), "sketch")
        v = F.col("_v")
        parts = {"below": v < F.col("_a"), "at_a": v == F.col("_a"), "mid": (v > F.col("_a")) & (v < F.col("_z")), "at_z": (v == F.col("_z")) & (F.col("_z") > F.col("_a")), "above": v > F.col("_z")}
        counts = inside(around).groupBy(*target, "_a", "_z").agg(*[F.count_if(c).alias(n) for n, c in parts.items()])
        before, choice = F.lit(0), F.lit(None)
        whole = {"below": ("_lo", "_a", none), "at_a": (None, None, F.col("_a")), "mid": ("_a", "_z", none), "at_z": (None, None, F.col("_z")), "above": ("_z", "_hi", none)}
        for n, (lo, hi, x) in whole.items():
            here = F.struct((F.col("_r") - before).alias("_r"), (F.col(lo) if lo else none).alias("_lo"), (F.col(hi) if hi else none).alias("_hi"), F.col(n).alias("_rows"), x.alias("_x"))
            choice = F.coalesce(choice, F.when((F.col("_r") >= before) & (F.col("_r") < before + F.col(n)), here))
            before = before + F.col(n)
        narrowed = counts.select(*names, "_t", choice.alias("_c")).select(*names, "_t", "_c.*")
        now = materialize(now.filter(~open_).unionByName(narrowed), "targets")
    held = inside(now.filter("_x is null")).groupBy(*names, "_t", "_r").agg(F.array_sort(F.collect_list("_v")).alias("_all"))
    found = held.select(*names, "_t", F.get("_all", F.col("_r").cast("int")).alias("_x")).unionByName(now.filter("_x is not null").select(*names, "_t", "_x"))
    ends = [F.max(F.when(F.col("_t") == f"{n}_{s}", F.col("_x"))).alias(f"{n}_{s}") for n in points for s in ("lo", "hi")]
    large = found.groupBy(*names).agg(*ends).join(wide.select(*[F.col(k).alias(f"w_{k}") for k in keys], "n"), _wide(names, keys))
    part = lambda p: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
    lo, hi = (lambda n: F.col(f"{n}_lo")), (lambda n: F.col(f"{n}_hi"))
    between = [F.when(lo(n) == hi(n), lo(n)).otherwise(lo(n) + (hi(n) - lo(n)) * part(p)).alias(n) for n, p in points.items()]
    return out.unionByName(large.select(*[F.col(f"_{k}").alias(k) for k in keys], *between))


def _wide(names: Sequence[str], keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for n, k in zip(names, keys, strict=True):
        out = out & F.col(n).eqNullSafe(F.col(f"w_{k}"))
    return out


def with_quantiles(stats: DataFrame, df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float], limit: int = LIMIT, steps: int = STEPS) -> DataFrame:
    """``stats`` (see :func:`exact_quantiles`) with the quantiles as further columns."""
    kept = materialize(stats, "stats")
    found = exact_quantiles(df, keys, value, points, kept, limit, steps)
    right = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *points)
    return kept.join(right, _same(kept, keys), "left").drop(*[f"_{k}" for k in keys])
