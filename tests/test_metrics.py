from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import decisions, metrics, validate


def values(spark, *numbers):
    numbers = numbers or (1.0,)
    return spark.createDataFrame([("k", float(v)) for v in numbers], "key string, value double")


def test_distribution_equals_its_definition(spark):
    """Five groups of different sizes, by the formulas."""
    rng = np.random.default_rng(12)
    groups = {f"g{n}": rng.uniform(0.5, 90.0, n).tolist() for n in (2, 4, 5, 17, 40)}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "key string, value double")
    for r in metrics.summarize_distribution(df, ["key"], "value").collect():
        x = np.array(groups[r.key])
        deviation = math.sqrt(((x - x.sum() / len(x)) ** 2).sum() / (len(x) - 1))
        assert r.n == len(x) and (r.minimum, r.maximum) == (x.min(), x.max())
        assert (r["mean"], r["median"], r.sample_std, r.coefficient_of_variation) == pytest.approx((x.mean(), np.median(x), deviation, deviation / x.mean()), abs=1e-6)


def test_a_single_value_spreads_nowhere(spark):
    r = metrics.summarize_distribution(values(spark, 0.75), ["key"], "value").first()
    assert (r.n, r["mean"], r["median"], r.minimum, r.maximum, r.sample_std, r.coefficient_of_variation) == (1, 0.75, 0.75, 0.75, 0.75, None, None)


@pytest.mark.parametrize("bad", [0.0, -1.0, math.nan, math.inf])
def test_values_must_be_finite_and_positive(spark, bad):
    assert metrics.invalid_values(values(spark, 1, bad), ["key"], "value").count() == 1


def test_rates_are_averaged_not_divided(spark):
    """Each sample's rate counts the same, so the mean rate is not items over mean time."""
    times, items = [0.4, 0.8, 1.6], 24
    s = spark.createDataFrame([("r", i, t, items) for i, t in enumerate(times)], "run_key string, sample_index int, elapsed_seconds double, items_processed long")
    rows = {r.statistic: r for r in metrics.summarize_benchmark(s).collect()}
    rates = [items / t for t in times]
    assert rows["images_per_second"]["mean"] == pytest.approx(sum(rates) / 3) != pytest.approx(items / (sum(times) / 3))
    assert rows["images_per_second"].sample_std == pytest.approx(np.std(rates, ddof=1), abs=1e-6)
    assert rows["microseconds_per_image"]["median"] == pytest.approx(1e6 * 0.8 / 24, abs=1e-6) and rows["elapsed_seconds"].maximum == 1.6


def test_ties_share_the_mean_of_their_places(spark):
    """Against counting: a rank is one more than the larger values, plus half of the other equal ones."""
    rng = np.random.default_rng(3)
    x = {f"k{i}": float(rng.integers(0, 8)) for i in range(30)}
    df = spark.createDataFrame(list(x.items()), "key string, value double")
    want = {k: 1 + sum(w > v for w in x.values()) + (sum(w == v for w in x.values()) - 1) / 2 for k, v in x.items()}
    assert {r.key: r["rank"] for r in decisions.average_rank(df, [], "value").collect()} == want


def test_quantile_is_linear(spark):
    r = metrics.distribution_quantiles(values(spark, 1, 2, 3), ["key"], ["value"]).first()
    assert (r.minimum, r.q10, r.median, r.q90, r.maximum) == (1.0, 1.2, 2.0, 2.8, 3.0)


#: Three repetitions on machines of their own; runs of a repetition have different numbers of samples.
TIMES = {("left", 0): [0.5], ("left", 1): [0.25, 0.75], ("left", 2): [0.2, 0.3, 0.4], ("right", 0): [1.0, 3.0], ("right", 1): [2.0], ("right", 2): [0.1, 0.1, 0.1, 0.1]}


def measured(spark, places=("north", "south", "south")):
    runs = spark.createDataFrame([(f"{d}-{rep}", d, rep, f"machine-{rep}", places[rep]) for d, rep in TIMES], "run_key string, decoder string, repetition int, platform_id string, location string")
    samples = spark.createDataFrame([(f"{d}-{rep}", i, t, 6) for (d, rep), ts in TIMES.items() for i, t in enumerate(ts)], "run_key string, sample_index int, elapsed_seconds double, items_processed long")
    return runs, samples


def test_groups_weigh_runs_equally(spark):
    rows = {r.decoder: r for r in metrics.group_runs(*measured(spark), ["decoder"], "images_per_second").collect()}
    for d in ("left", "right"):
        means = [np.mean([6 / t for t in TIMES[d, rep]]) for rep in range(3)]
        assert rows[d].raw_run_means == pytest.approx(means, abs=1e-6) and rows[d]["mean"] == pytest.approx(np.mean(means), abs=1e-6)
        assert (rows[d].n, rows[d].repetitions, rows[d].run_keys, rows[d].repeated) == (3, [0, 1, 2], [f"{d}-{k}" for k in range(3)], False)


def test_groups_keep_locations(spark):
    r = metrics.group_runs(*measured(spark), ["decoder"], "elapsed_seconds").first()
    assert r.platform_locations == ["north", "south"] and r.platform_ids == ["machine-0", "machine-1", "machine-2"]


def test_statistics_and_members_need_no_arrays(spark):
    """No row and no aggregate holds a group's runs, whose rows and digests stand beside the statistics instead; null keys are groups too."""
    import hashlib

    from tallymark.functions.digests import joined_digest

    runs, samples = measured(spark)
    runs = runs.withColumn("decoder", F.when(F.col("decoder") == "left", F.col("decoder")))
    members = metrics.group_members(runs, samples, ["decoder"], "images_per_second")
    groups = metrics.group_statistics(members, ["decoder"])
    assert "collect_list" not in groups._jdf.queryExecution().toString()
    found, whole = {r.decoder: r for r in groups.collect()}, {r.decoder: r for r in metrics.group_runs(runs, samples, ["decoder"], "images_per_second").collect()}
    assert found.keys() == whole.keys() == {None, "left"}
    for d, r in found.items():
        assert all(r[c] == whole[d][c] for c in groups.columns)
        means = [np.mean([6 / t for t in TIMES[d or "right", rep]]) for rep in range(3)]
        assert (r["mean"], r["median"], r.sample_std) == pytest.approx((np.mean(means), np.median(means), np.std(means, ddof=1)), abs=1e-6)
        assert sorted((m.repetition, m.run_key) for m in members.collect() if m.decoder == d) == list(zip(whole[d].repetitions, whole[d].run_keys))
    digests = {r.decoder: (r.digest, r.n) for r in joined_digest(members, ["decoder"], ["repetition", "run_key"], "run_key").collect()}
    assert digests == {d: (hashlib.sha256(",".join(r.run_keys).encode()).hexdigest(), 3) for d, r in whole.items()}


def test_repeated_repetition_shows(spark):
    runs, samples = measured(spark)
    again = runs.withColumn("repetition", F.col("repetition") % 2)
    assert all(r.repeated for r in metrics.group_runs(again, samples, ["decoder"], "elapsed_seconds").collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_and_running_sums_over_ranges(spark, parts):
    from tallymark.operators import ranks

    rng = np.random.default_rng(7)
    rows = [(None if g == 2 else f"g{g}", float(rng.integers(0, 40)) if rng.random() < 0.95 else None, i) for g in range(3) for i in range(g * 60 + 1)]
    df = spark.createDataFrame(rows, "key string, value double, i int").repartition(parts)
    got = {r.key: r for r in metrics.distribution_quantiles(df, ["key"], ["value"]).collect()}
    for key in (None, "g0", "g1"):
        x = [v for k, v, _ in rows if k == key and v is not None]
        if x:
            assert [got[key][c] for c in ("minimum", "q10", "median", "q90", "maximum")] == pytest.approx([min(x), *np.quantile(x, [0.1, 0.5, 0.9]), max(x)], abs=1e-6)
    total = {}
    for key, v, i in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        total[key, i] = sum(w or 0 for k, w, j in rows if k == key and ((w is not None, w or 0, j) <= (v is not None, v or 0, i)))
    found = ranks.running_sum(df, ["key"], ["value", "i"], F.coalesce("value", F.lit(0.0)), "upto").collect()
    assert {(r.key, r.i): r.upto for r in found} == total
    assert "value" in found[0].asDict() and len(found) == len(rows)


def test_recheck_of_stored_statistics(spark):
    again = metrics.summarize_benchmark(measured(spark)[1])
    assert validate.summary_recheck(again, again).count() == 0
    for field in validate.FIELDS:
        stored = again.withColumn(field, F.when(F.col("run_key") == "left-2", F.col(field) * 1.001 + 1e-3).otherwise(F.col(field)))
        found = validate.summary_recheck(again, stored).collect()
        assert {(r.key.split("/")[0], r.rule) for r in found} == {("left-2", f"{field.replace('_', '-')}-mismatch")} and len(found) == 3
    gone = again.withColumn("sample_std", F.lit(None).cast("double"))
    assert {r.rule for r in validate.summary_recheck(again, gone).collect()} == {"sample-std-mismatch"}
    assert {r.rule for r in validate.summary_recheck(again, again.filter("run_key <> 'left-0'")).collect()} == {"no-summary"}


def test_ecdf_goes_by_position(spark):
    rows = metrics.ecdf(values(spark, 1, 1, 2, 3), ["key"], "value", []).orderBy("fraction").collect()
    assert [r.fraction for r in rows] == [0.25, 0.5, 0.75, 1.0]


def test_order_of_partitions_changes_nothing(spark):
    runs, samples = measured(spark)
    once = metrics.group_runs(runs, samples, ["decoder"], "elapsed_seconds").collect()
    again = metrics.group_runs(runs.repartition(3, "platform_id"), samples.repartition(5), ["decoder"], "elapsed_seconds").collect()
    assert sorted(once) == sorted(again)


def test_index_must_be_consecutive(spark):
    s = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 1)], "run_key string, sample_index int")
    assert {r.run_key: r.misplaced for r in metrics.consecutive_index(s).collect()} == {"b": 1, "c": 1}


def test_empty_input_gives_no_rows(spark):
    empty = values(spark).limit(0)
    assert metrics.summarize_distribution(empty, ["key"], "value").count() == 0
    with pytest.raises(validate.EvidenceError):
        validate.require_non_empty(empty, "values")
