from __future__ import annotations

import hashlib

import pytest

from tallymark.functions import columns as X
from tallymark.operators import catalog, matrix, profiles, support, validate
from pyspark.sql import functions as F


def test_only_complete_scenes(spark):
    rows = [(s, d, p) for s in ("s1", "s2") for d in ("d1", "d2") for p in catalog.PROVENANCES if not (s == "s2" and d == "d2" and p == "orig")]
    df = spark.createDataFrame(rows, "scene_id string, device_id string, provenance string")
    declared = spark.createDataFrame([(p,) for p in catalog.PROVENANCES], "provenance string")
    assert [r.scene_id for r in catalog.complete_groups(df, ["scene_id"], ["device_id"], declared).collect()] == ["s1"]
    assert catalog.complete_groups(df.unionByName(df), ["scene_id"], ["device_id"], declared).count() == 1


def test_hashed_selection_is_that_of_hashlib(spark):
    ids = [f"{i:04d}" for i in range(20)]
    got = [r.x for r in catalog.select_top_hashed(spark.createDataFrame([(i,) for i in ids * 2], "x string"), "x", 5, 7, "salt").collect()]
    assert got == sorted(ids, key=lambda i: (hashlib.sha256("\0".join(["salt", "7", i]).encode()).digest(), i))[:5]
    with pytest.raises(ValueError):
        catalog.select_top_hashed(spark.range(1), "id", 0, 7, "salt")


def test_member_names(spark):
    names = ["D01_cam/orig/D01_img_orig_0001.jpg", "D01_cam/orig/D02_img_orig_0001.jpg", "D01_cam/orig/D01_img_facebook_0001.jpg", "D01_cam/inspection/x.jpg"]
    d, p, s = X.member_parts(F.col("n"))
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(d.alias("d"), p.alias("p"), s.alias("s")).collect()
    assert tuple(rows[0]) == ("D01", "orig", "0001") and all(r.s is None for r in rows[1:])


def test_nearest_quality_takes_the_lower_of_equals(spark):
    sums = {q: sum(min(255, max(1, (v * (5000 // q if q < 50 else 200 - 2 * q) + 50) // 100)) for v in X.LUMINANCE_Q50) for q in range(1, 101)}
    observed = [0, 64, 500, 3000, sums[75], 10**6]
    rows = {r.s: r.quality_estimate for r in catalog.nearest_quality(spark.createDataFrame([(o,) for o in observed], "s long"), "s").collect()}
    assert rows == {o: min(sums, key=lambda q: (abs(sums[q] - o), q)) for o in observed}


def test_budget_names_the_first_row_over(spark):
    df = spark.createDataFrame([("a", i, 40) for i in range(5)] + [("b", 0, 100)], "w string, i int, n long")
    rows = catalog.byte_budget(df, ["w"], ["i"], "n", 100).collect()
    assert [(r.w, r.i, r.running_bytes) for r in rows] == [("a", 2, 120)]


def test_shared_blobs(spark):
    items = spark.createDataFrame([("h", "mixed", 0, "m/x"), ("h", "native", 0, "n/x")], "sha256 string, workload_id string, ordinal int, relative_path string")
    r = catalog.dedup_blobs(items, "sha256", ["workload_id", "ordinal"], "relative_path").collect()
    assert len(r) == 1 and r[0].path == "m/x" and r[0].logical_items == 2


def audits(spark):
    return spark.createDataFrame([(a, f"i{k}", not (a == "b" and k == 0)) for a in ("a", "b") for k in range(4)], "audit string, item string, ok boolean")


def test_support_keeps_selection_order(spark):
    selection = spark.createDataFrame([(f"i{k}", 3 - k) for k in range(4)], "item string, ordinal int")
    found = support.ordered_support(support.support_intersection(audits(spark), "audit", "item"), selection, "item")
    assert [(r.item, r.ordinal) for r in found.orderBy("ordinal").collect()] == [("i3", 0), ("i2", 1), ("i1", 2)]
    assert support.operational_support(audits(spark), "audit", "item").count() == 7


def test_coverage_has_a_combined_row(spark):
    rows = [("alpha", "empty", False)] * 276 + [("alpha", "four", False), ("beta", "four", True)] + [("beta", "empty", True)] * 276
    got = {(r.decoder, r.category): (r.accepted, r.total) for r in support.coverage_by_category(spark.createDataFrame(rows, "decoder string, category string, ok boolean")).collect()}
    assert got == {("alpha", "empty"): (0, 276), ("alpha", "four"): (0, 1), ("alpha", "combined"): (0, 277), ("beta", "empty"): (276, 276), ("beta", "four"): (1, 1), ("beta", "combined"): (277, 277)}


def test_a_failing_check_fails_no_job(spark):
    def picky(content):
        if content == b"bad":
            raise RuntimeError("no")
        if content == b"odd":
            raise support.ContractError("shape")

    items = spark.createDataFrame([("1", b"ok"), ("2", b"bad"), ("3", b"odd")], "item_id string, content binary")
    rows = {r.item_id: (r.ok, r.failure_type) for r in support.audit_items(items, {"picky": picky}).collect()}
    assert rows == {"1": (True, None), "2": (False, "decode_error"), "3": (False, "output_contract_error")}


def test_memory_of_spawned_workers(spark):
    items = spark.createDataFrame([(100, 10, 20), (200, 5, 5)], "compressed_bytes long, width int, height int")
    config = "config_id string, protocol_id string, num_workers int, batch_size int, prefetch_factor int, start_method string"
    configs = spark.createDataFrame([("spawn", "loader-supply", 2, 1, 1, "spawn"), ("fork", "loader-supply", 2, 1, 1, "fork"), ("idle", "loader-supply", 0, 4, None, None), ("decode", "decode-memory", None, None, None, None)], config)
    rows = {r.config_id: r for r in matrix.estimate_memory(configs, items, 3000).collect()}
    s = rows["spawn"]
    assert (s.resident_compressed_bytes, s.resident_replica_count, s.decoded_inflight_bytes, s.estimated_peak_bytes, s.fits) == (300, 3, 3000, 3900, False)
    assert rows["fork"].resident_replica_count == 1 and rows["idle"].decoded_inflight_bytes == 3000 and rows["decode"].estimated_peak_bytes == 900


def test_blocks_are_permutations(spark):
    decoders = spark.createDataFrame([("d", None)], "decoder string, requested_threads int")
    workers = spark.createDataFrame([(w, 2, "spawn") for w in (0, 2, 4)], "num_workers int, prefetch_factor int, start_method string")
    m = matrix.expand_matrix(decoders, workers)
    assert m.count() == 4 and m.filter("num_workers = 0 and (prefetch_factor is not null or start_method is not null)").count() == 0
    configs = m.select(F.concat_ws("/", "protocol_id", "num_workers").alias("config_id"))
    rows = matrix.randomized_blocks(configs, "config_id", 2, 5).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(8))
    assert all(len({r.config_id for r in rows if r.repetition == k}) == 4 for k in (0, 1))


def test_resume_runs_what_is_not_committed(spark):
    specs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_key string")
    assert sorted(r.run_key for r in matrix.pending_runs(specs, spark.createDataFrame([("a",), ("x",)], "run_key string")).collect()) == ["b", "c"]
    attempts = spark.createDataFrame([("p", "completed"), ("p", "skipped"), ("q", "failed")], "plan string, status string")
    rows = {r.plan: r for r in matrix.status_counts(attempts, ["plan"]).collect()}
    assert rows["p"].complete and rows["p"].n_completed == 1 and rows["p"].n_timeout == 0 and not rows["q"].complete


def test_timed_and_excluded_profiles(spark):
    items = spark.createDataFrame([("t", "mixed", False, 100, "4:4:4"), ("x", "mixed", True, 50, "4:2:0")], "item_id string, workload_id string, progressive boolean, compressed_bytes long, subsampling string")
    timed, excluded = profiles.manifest_split(items, spark.createDataFrame([("t",)], "item_id string"))
    r = profiles.workload_profile(timed, excluded).first()
    assert (r.items, r.excluded, r.total_bytes, r.s444, r.progressive) == (1, 1, 100, 1, 0)
    e = profiles.excluded_profile(items, excluded, "subsampling").first()
    assert (e.subsampling, e.n, e.progressive) == ("4:2:0", 1, 1)
    none = profiles.excluded_profile(items, excluded.limit(0), "subsampling").first()
    assert (none.subsampling, none.n) == (None, 0)


def test_last_provenance_wins(spark):
    items = spark.createDataFrame([("i", "h"), ("j", "z")], "item_id string, digest string")
    listed = spark.createDataFrame([("h", 0, "first"), ("h", 1, "last")], "digest string, ordinal int, provenance string")
    found, missing = profiles.attach_provenance(items, listed, "digest", "ordinal")
    assert [(r.item_id, r.provenance) for r in found.collect()] == [("i", "last")] and [r.item_id for r in missing.collect()] == ["j"]


def test_versions(spark):
    d = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2")], "name string, version string")
    rows = {r.name: r.consistent for r in profiles.versions_consistent(d, spark.createDataFrame([("a",), ("b",), ("c",)], "name string")).collect()}
    assert rows == {"a": True, "b": False, "c": False}


def test_configuration_rules(spark):
    schema = "config_id string, protocol_id string, decoder_id string, requested_threads int, timed_passes int, warmup_passes int, support_policy string, num_workers int, batch_size int, prefetch_factor int, persistent_workers boolean, start_method string"
    rows = [
        ("good", "decode-memory", "d", None, 1, 0, "common", None, None, None, False, None),
        ("loader", "loader-supply", "d", None, 1, 1, "common", 2, 8, 2, True, "spawn"),
        ("extra", "decode-memory", "d", None, 1, 0, "common", None, 8, None, False, None),
        ("idle", "loader-supply", "d", None, 1, 0, "common", 0, 8, 2, False, None),
        ("cold", "loader-supply", "d", None, 1, 0, "common", 2, 8, 2, True, "spawn"),
        ("null", None, None, 0, None, None, None, None, None, None, None, None),
    ]
    got = {}
    for r in validate.config_rules(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.key, set()).add(r.rule)
    assert "good" not in got and "loader" not in got
    assert got["extra"] == {"decode-with-loader-fields"} and got["idle"] == {"idle-loader-with-worker-fields"} and got["cold"] == {"workers-without-warmup"}
    assert {"unsupported-protocol", "empty-decoder", "threads-not-positive", "passes-not-positive", "unknown-policy"} <= got["null"]


def test_handshakes(spark):
    h = spark.createDataFrame([("r", 2, 1, 10, "spawn", "spawn"), ("r", 2, 1, 10, "spawn", "spawn"), ("s", 2, 1, 1, "fork", "spawn")], "run_key string, expected int, coordinator_pid long, pid long, start_method string, expected_method string")
    assert sorted((r.key, r.rule) for r in validate.handshake_rules(h).collect()) == [("r", "repeated-pid"), ("s", "coordinator-pid"), ("s", "start-method"), ("s", "worker-count")]
