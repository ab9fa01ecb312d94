from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymark.operators import catalog, validate
from tallymark.plans import workflows
from tallymark.sources import sinks


def runs_and_samples(spark):
    runs = spark.createDataFrame([(f"r{i}", "p", i % 2, "decode-memory", f"m{i % 2}", None) for i in range(4)], "run_key string, plan_id string, config_id int, protocol_id string, platform_id string, location string")
    runs = runs.withColumn("repetition", F.when(F.col("run_key").isin("r0", "r1"), 0).otherwise(1))
    samples = spark.createDataFrame([(f"r{i}", k, 1.0 + i, 10) for i in range(4) for k in range(2)], "run_key string, sample_index int, elapsed_seconds double, items_processed long")
    return runs, samples


def test_publication(spark, tmp_path):
    runs, samples = runs_and_samples(spark)
    args = {"scope": "decode", "filters": {"config.plan_id": "p"}, "statistic": "elapsed_seconds", "keys": ["config_id"], "revision": "0" * 40}
    out = workflows.publication(runs, samples, **args)
    groups = out.groups.collect()
    assert [(g.config_id, g.n, g.mean) for g in groups] == [(0, 2, 2.0), (1, 2, 3.0)] and out.rows.count() == 4
    sinks.write_sections(out.sections(), str(tmp_path / "out"))
    sinks.write_sections(workflows.publication(runs.repartition(3), samples.repartition(2), **args).sections(), str(tmp_path / "out"))
    ids = {workflows.publication(runs, s, **args).provenance.first().publication_id for s in (samples, samples.withColumn("elapsed_seconds", F.col("elapsed_seconds") * 2))}
    assert len(ids) == 2


def test_a_publication_has_a_row_for_each_run_of_a_group(spark, tmp_path):
    runs, samples = runs_and_samples(spark)
    out = workflows.publication(runs, samples, scope="decode", filters={}, statistic="elapsed_seconds", keys=["config_id"], revision="r")
    assert not any(t.startswith("array") and c not in ("platform_ids", "platform_locations") for c, t in out.groups.dtypes)
    sinks.write_sections(out.sections(), str(tmp_path / "out"))
    members = spark.read.parquet(str(tmp_path / "out/members"))
    assert sorted(map(tuple, members.select("config_id", "repetition", "run_key", "run_mean").collect())) == [(0, 0, "r0", 1.0), (0, 1, "r2", 3.0), (1, 0, "r1", 2.0), (1, 1, "r3", 4.0)]


@pytest.mark.parametrize("change", [{"elapsed_seconds": 0.0}, {"sample_index": 0}, {"items_processed": 11}])
def test_broken_samples_stop_a_publication(spark, change):
    runs, samples = runs_and_samples(spark)
    first = (F.col("run_key") == "r0") & (F.col("sample_index") == 1)
    for c, v in change.items():
        samples = samples.withColumn("_first", first).withColumn(c, F.when(F.col("_first"), F.lit(v)).otherwise(F.col(c))).drop("_first")
    with pytest.raises(validate.EvidenceError):
        workflows.publication(runs, samples, scope="decode", filters={}, statistic="elapsed_seconds", keys=["config_id"], revision="r")


def test_repeated_repetition_stops_a_publication(spark):
    runs, samples = runs_and_samples(spark)
    with pytest.raises(validate.EvidenceError):
        workflows.publication(runs.withColumn("repetition", F.lit(0)), samples, scope="decode", filters={}, statistic="elapsed_seconds", keys=["config_id"], revision="r")


def test_campaign_resumes(spark, tmp_path):
    decoders = spark.createDataFrame([("a", None), ("b", 1)], "decoder string, requested_threads int")
    workers = spark.createDataFrame([(0, 2, "spawn"), (2, 2, "spawn"), (64, 2, "spawn")], "num_workers int, prefetch_factor int, start_method string")
    items = spark.createDataFrame([(1000, 10, 10)], "compressed_bytes long, width int, height int")
    fixed = {"batch_size": 4, "timed_passes": 1, "warmup_passes": 1, "support_policy": "common"}
    none = spark.createDataFrame([], "run_key string")
    args = {"repetitions": 3, "seed": 1, "memory_bytes": 60_000}
    first = workflows.campaign(decoders, workers, fixed, items, none, **args)
    assert first.violations.count() == 0 and first.too_large.count() == 2
    specs = first.specs.collect()
    assert len(specs) == 6 * 3 and len({s.run_key for s in specs}) == 18 and len({s.audit_key for s in specs}) == 4
    done = spark.createDataFrame([(s.run_key,) for s in specs[:5]], "run_key string")
    left = workflows.campaign(decoders, workers, fixed, items, done, **args).pending.collect()
    assert len(left) == 13 and [r.position for r in left] == sorted(r.position for r in left)
    sinks.write_matrix(first.specs, str(tmp_path / "matrix"))
    assert spark.read.parquet(str(tmp_path / "matrix")).count() == 18
    sinks.append_runs(first.specs.withColumn("plan_id", F.lit("p")), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).filter("plan_id = 'p'").count() == 18
    counts = first.specs.groupBy("repetition").agg(F.count("*").alias("n"))
    sinks.write_campaign_index(counts, str(tmp_path / "index"), ["repetition"])
    assert spark.read.parquet(str(tmp_path / "index")).count() == 3


def test_dataset_is_deterministic(spark):
    rows = [(f"{s:04d}", f"D{d:02d}", p, f"D{d:02d}/{p}/{s}", f"h{s}{d}", 10) for s in range(5) for d in range(2) for p in catalog.PROVENANCES if not (s == 4 and p == "orig" and d == 1)]
    members = spark.createDataFrame(rows, "scene_id string, device_id string, provenance string, zip_member string, sha256 string, jpeg_bytes long")
    a = workflows.dataset(members, scenes=2, seed=3, byte_limit=1000)
    counts = {r.workload: r["count"] for r in a.items.groupBy("workload").count().collect()}
    assert counts == {"native": 4, "mixed": 24} and a.over_budget.count() == 0 and a.blobs.count() == 4
    b = workflows.dataset(members.orderBy(F.rand(1)).repartition(3), scenes=2, seed=3, byte_limit=1000)
    assert sorted(a.identities.collect()) == sorted(b.identities.collect())
    assert sorted(a.identities.collect()) != sorted(workflows.dataset(members, scenes=2, seed=4, byte_limit=1000).identities.collect())
    assert workflows.dataset(members, scenes=2, seed=3, byte_limit=100).over_budget.count() == 1


def test_evidence_document(spark, tmp_path):
    rows = [("native", "m", p, d, None, w, r, float(10 + k + (w or 0) + r)) for p, ws in (("decode-memory", [None]), ("loader-supply", [0, 2])) for w in ws for k, d in enumerate("abc") for r in range(2)]
    m = spark.createDataFrame(rows, "workload string, machine_type string, protocol string, decoder string, requested_threads int, workers int, repetition int, images_per_second double")
    controls = spark.createDataFrame([], "decoder string, requested_threads int")
    audits = spark.createDataFrame([("a", "x", True)], "decoder string, category string, ok boolean")
    doc = workflows.evidence_document(m, controls, m.select("workload", "machine_type", "decoder").distinct(), audits, repetitions=[0, 1], grid=[0, 2], base_workers=[0, 2])
    assert doc["decisions"].first().leaders_match and doc["aggregates"].filter("complete").count() == 9
    sinks.write_sections(doc, str(tmp_path / "doc"))
    assert spark.read.parquet(str(tmp_path / "doc/curves")).count() == 6


def test_materialized_tables_hold_the_rows(spark):
    df = spark.range(5).filter("id > 1")
    assert sorted(sinks.materialize(df, "t").collect()) == sorted(df.collect()) and sinks.materialize(df.limit(0), "t").count() == 0


def test_catalogue_order_is_declared(spark):
    df = spark.createDataFrame([("1", "a", "twitter"), ("1", "a", "orig"), ("0", "b", "whatsapp")], "scene_id string, device_id string, provenance string")
    assert [r.provenance for r in catalog.catalog_order(df).collect()] == ["whatsapp", "orig", "twitter"]


def test_pinned_items_resolve_in_order(spark):
    pinned = spark.createDataFrame([("b", 0), ("a", 1), ("x", 2), ("d", 3)], "item_id string, ordinal int")
    items = spark.createDataFrame([("a", 1), ("b", 2), ("d", 3), ("d", 4)], "item_id string, n int")
    found, bad = catalog.resolve_items(pinned, items)
    assert [r.item_id for r in found.collect()][:2] == ["b", "a"] and {(r.item_id, r.n) for r in bad.collect()} == {("x", 0), ("d", 2)}
