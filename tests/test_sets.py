from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import digests
from tallymark.operators import decisions, publish

CELLS = "cell string, r long"


def test_a_cell_with_a_repeated_number_in_place_of_another_is_found(spark):
    expected = spark.createDataFrame([(c, r) for c in ("a", "b", "gone", None) for r in (0, 1, 2)], CELLS)
    observed = spark.createDataFrame([("a", 0), ("a", 0), ("a", 2), ("b", 2), ("b", 1), ("b", 0), (None, 0), (None, 1), (None, 2), (None, 3), ("new", 5), ("new", None)], CELLS)
    got = {r.cell: (r.missing, r.extra, r.repeated) for r in decisions.set_gaps(expected, observed, ["cell"], "r").collect()}
    assert got == {"a": (1, 0, 1), "gone": (3, 0, 0), None: (0, 1, 0), "new": (0, 1, 0)}
    assert decisions.set_gaps(expected, expected, ["cell"], "r").collect() == []
    assert decisions.set_gaps(expected.limit(0), expected.limit(0), ["cell"], "r").collect() == []


def test_sets_over_many_bitmaps_equal_plain_sets(spark):
    rnd = random.Random(2)
    one = [(rnd.choice("xyz"), rnd.randrange(200_000)) for _ in range(3000)] + [("x", 0), ("x", 32768), ("x", 32767)]
    two = [v for v in one if rnd.random() < 0.9] + [(rnd.choice("xyz"), rnd.randrange(200_000)) for _ in range(200)]
    got = {r.cell: (r.missing, r.extra, r.repeated) for r in decisions.set_gaps(spark.createDataFrame(one, CELLS), spark.createDataFrame(two, CELLS), ["cell"], "r").collect()}
    want = {}
    for c in "xyz":
        e, o = {r for k, r in one if k == c}, [r for k, r in two if k == c]
        want[c] = (len(e - set(o)), len(set(o) - e), len(o) - len(set(o)))
    assert got == {c: w for c, w in want.items() if any(w)}


@pytest.mark.parametrize("buckets", [1, 7, 65536])
def test_differences_equal_those_of_whole_tables(spark, buckets):
    rnd = random.Random(3)
    value = lambda: rnd.choice([None, 0.0, -0.0, float("nan"), 1.5])
    rows = [(rnd.randrange(40), rnd.choice(["p", None, "q"]), value()) for _ in range(300)]
    other = [r for r in rows if rnd.random() < 0.97] + rows[:2] + [(99, "new", 1.0)]
    a, b = (spark.createDataFrame(x, "`a.b` int, c string, d double") for x in (rows, other))
    got = publish.differences(a, b.select("d", "c", "`a.b`"), buckets)
    want = a.exceptAll(b).withColumn("side", F.lit("published")).unionByName(b.exceptAll(a).withColumn("side", F.lit("recomputed")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 0
    assert publish.differences(a, a.repartition(3), buckets).count() == 0
    assert publish.differences(a, a.limit(0), buckets).count() == 300


def test_sequences_stream_through_one_hash(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(["x", None]), f"k{rnd.randrange(10**6)}é") for _ in range(30_000)] + [("only nulls", "x", None), ("mixed", "x", None), ("mixed", "x", "v")]
    got = {(r.g, r.h): (r.digest, r.n) for r in digests.sequence_digest(spark.createDataFrame(rows, "g string, h string, v string"), ["g", "h"], "v").collect()}
    want = {}
    for g, h, v in rows:
        want.setdefault((g, h), []).append(v)
    plain = lambda x: (hashlib.sha256(("\n".join(sorted((v for v in x if v is not None), key=str.encode)) + "\n").encode()).hexdigest(), len(x))
    assert got == {k: plain(x) for k, x in want.items()}


def test_designs_name_each_level_once_and_within_bounds(spark):
    from tallymark.operators import validate

    design = spark.createDataFrame(
        [("a", "edge", 32), ("a", "edge", None), ("a", "quality", 50), ("a", "limit", 9), ("b", "edge", 65536), ("b", "edge", 0), ("b", "quality", 96), ("b", "quality", None), ("b", "limit", 0), ("c", "edge", None), ("c", "edge", None), ("d", "quality", 50), ("d", "quality", 50), ("d", "limit", None)],
        "design_id string, kind string, value long",
    )
    sources = spark.createDataFrame([("a", "p", "h"), ("a", "p", "g"), ("a", "q", "h"), ("b", "p", "h"), ("b", "p", "h")], "design_id string, relative_path string, sha256 string")
    found = sorted((r.key, r.rule) for r in validate.design_rules(design, sources).collect())
    assert found == sorted([
        ("b/65536", "edge-out-of-range"), ("b/0", "edge-out-of-range"), ("b/96", "quality-out-of-range"), ("b/", "quality-out-of-range"), ("b/0", "limit-not-positive"), ("d/", "limit-not-positive"),
        ("c/", "repeated-edge"), ("d/50", "repeated-quality"), ("c", "no-quality"), ("d", "no-level"), ("b/p", "repeated-source"),
    ])


def test_selections_hold_as_many_items_as_they_say(spark):
    from tallymark.operators import validate

    items = spark.createDataFrame([("m", "i"), ("m", "j"), ("n", "i"), ("n", "i")], "manifest_id string, item_id string")
    rows = [("fine", "m", "all", 2), ("more", "m", "all", 3), ("none", "m", "all", None), ("zero", "gone", "all", 0), ("gone", "gone", "all", 1), ("some", "m", "first", 2), ("twice", "n", "all", 2)]
    found = sorted((r.key, r.rule) for r in validate.selection_rules(spark.createDataFrame(rows, "selection_id string, manifest_id string, method string, expected_items int"), items).collect())
    assert found == [("gone", "item-count"), ("more", "item-count"), ("none", "expected-items-not-positive"), ("some", "unknown-method"), ("twice", "repeated-items"), ("zero", "expected-items-not-positive")]


def test_evidence_runs_keep_contract_and_manifest(spark):
    from tallymark.operators import validate

    names = "run_key string, workload_id string, items int, runner_revision string, status string, sample_count int, output_contract string, manifest_id string"
    rows = [("ok", "w", 3, "r", "completed", 1, "normalized-rgb", "m"), ("contract", "w", 3, "r", "completed", 1, None, "m"), ("manifest", "w", 3, "r", "completed", 1, "normalized-rgb", None), ("other", "v", 3, "r", "completed", 1, "normalized-rgb", "m")]
    expected = spark.createDataFrame([("w", 3, "r", "m")], "workload_id string, expected_items int, expected_revision string, expected_manifest string")
    runs = spark.createDataFrame(rows, names)
    assert sorted((r.key, r.rule) for r in validate.evidence_rules(runs, expected).collect()) == [("contract", "output-contract"), ("manifest", "manifest"), ("other", "unknown-workload")]
    assert sorted((r.key, r.rule) for r in validate.evidence_rules(runs.drop("output_contract", "manifest_id"), expected).collect()) == [("other", "unknown-workload")]
