from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymark.operators import decisions

AGG = "workload string, machine_type string, protocol string, decoder string, requested_threads int, workers int, mean double"


def agg(spark, rows):
    return spark.createDataFrame([("native", "m", *r) for r in rows], AGG)


def test_best_breaks_ties_by_label_then_workers(spark):
    a = agg(spark, [("loader-supply", "b", None, 4, 2.0), ("loader-supply", "a", None, 2, 2.0), ("loader-supply", "a", None, 0, 2.0), ("loader-supply", "c", None, 8, 1.0)])
    r = decisions.best(a, ["workload"]).first()
    assert (r.decoder, r.workers) == ("a", 0)  # 0 workers count as -1, so before 2


def curve(spark, blocks):
    """``blocks``: decoder -> values at 8 workers by repetition (12 workers: 100 each)."""
    rows = []
    for d, at8 in blocks.items():
        for rep, v in enumerate(at8):
            rows += [("native", "m", "loader-supply", d, None, w, rep, float(x)) for w, x in ((0, 10), (2, 30), (4, 60), (8, v), (12, 100))]
    return spark.createDataFrame(rows, AGG.replace("mean double", "repetition int, v double"))


def test_followup_needs_gain_in_mean_and_in_every_block(spark):
    b = curve(spark, {"yes": [90] * 5, "small": [97] * 5, "uneven": [90, 90, 90, 90, 101]})
    b = b.filter("not (decoder = 'gap' and workers = 4)")
    cells = spark.createDataFrame([("native", "m", d) for d in ("yes", "small", "uneven", "none")], "workload string, machine_type string, decoder string")
    rows = {r.decoder: r for r in decisions.followup_candidates(b, cells, [0, 2, 4, 8, 12]).collect()}
    assert [d for d in rows if rows[d].selected] == ["yes"]
    assert rows["yes"].gain_percent == pytest.approx(11.111111) and rows["none"].complete is False and rows["uneven"].minimum_ratio < 1


def test_incomplete_curve_is_not_selected(spark):
    b = curve(spark, {"gap": [90] * 5}).filter("workers <> 4")
    cells = b.select("workload", "machine_type", "decoder").distinct()
    assert not decisions.followup_candidates(b, cells, [0, 2, 4, 8, 12]).first().selected


def test_a_block_without_its_pair_is_not_selected(spark):
    """Other repetitions have the level, this one lacks it: its gain cannot be paired."""
    b = curve(spark, {"whole": [90] * 5, "torn": [90] * 5}).filter("not (decoder = 'torn' and repetition = 3 and workers = 12)")
    cells = b.select("workload", "machine_type", "decoder").distinct()
    found = decisions.followup_candidates(b, cells, [0, 2, 4, 8, 12])
    rows = {r.decoder: r for r in found.collect()}
    assert rows["whole"].selected and rows["whole"].blocks == 5 and not rows["torn"].complete and not rows["torn"].selected
    total = decisions.followup_totals(found).first()
    assert (total.candidate_count, total.bundle_count_if_launched) == (1, 5)


def test_constant_ranks_have_no_correlation(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 1.0)], "g string, item string, v double")
    assert decisions.rank_correlation(df, df, ["g"], "item", "v").first().rho is None


def test_decision_row(spark):
    a = agg(spark, [("decode-memory", "a", None, None, 10.0), ("decode-memory", "b", None, None, 8.0), ("loader-supply", "a", None, 4, 90.0), ("loader-supply", "b", None, 8, 100.0)])
    blocks = a.select(*[c for c in a.columns if c != "mean"], F.explode(F.array(F.lit(0), F.lit(1))).alias("repetition"), F.col("mean").alias("v"))
    r = decisions.decision_rows(a, blocks).first()
    assert (r.decode_leader, r.loader_leader, r.loader_leader_workers, r.selected_workers) == ("a", "b", 8, 4)
    assert r.regret_percent == pytest.approx(10) and r.worst_block_regret_percent == pytest.approx(10) and r.paired_blocks == 2
    assert r.rank_correlation == -1 and not r.leaders_match and r.top_tier == ["b", "a"]


def test_gaps_compare_nulls(spark):
    e = spark.createDataFrame([("a", None, 2), ("b", 1, 1)], "d string, t int, n int")
    o = spark.createDataFrame([("a", None), ("a", None), ("c", None)], "d string, t int")
    rows = {(r.d, r.t): (r.expected, r.observed) for r in decisions.matrix_gaps(e, o, ["d", "t"]).collect()}
    assert rows == {("b", 1): (1, 0), ("c", None): (0, 1)}


def test_scope_check_is_null_safe(spark):
    runs = spark.createDataFrame([("a", None), ("a", 1), ("b", None)], "d string, t int")
    scopes = spark.createDataFrame([("a", None)], "d string, t int")
    assert sorted((r.d, r.t) for r in decisions.scope_check(runs, scopes, ["d", "t"]).collect()) == [("a", 1), ("b", None)]


def test_unpaired_blocks_show(spark):
    b = spark.createDataFrame([("x", 8, 0, 2.0), ("x", 4, 0, 1.0), ("x", 8, 1, 3.0)], "d string, workers int, repetition int, v double")
    rows = {r.repetition: r for r in decisions.paired_ratio(b, F.col("workers") == 8, F.col("workers") == 4, ["d"]).collect()}
    assert rows[0].ratio == 2 and rows[1].unpaired
