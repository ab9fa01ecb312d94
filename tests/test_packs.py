from __future__ import annotations

from pathlib import Path

import pytest

from tallymark.operators import validate
from tallymark.plans import tree_queries
from tallymark.sources import evidence, files

DOCUMENTS = {
    "runs/r1/COMMITTED.json": '{"bundle_id": "b", "run_key": "r1"}', "runs/r1/config.json": '{\n "plan_id": "größe"\n}', "runs/r1/events.jsonl": '{"event": "a"}\r\n\n{"event": "b"}\nbad',
    "runs/r2/config.json": '{"plan_id": "q"}', "runs/r2/events.jsonl": "", "runs/.r3/COMMITTED.json": "{}", "runs/_r4/events.jsonl": '{"event": "hidden"}\n', "runs/r1/deep/events.jsonl": '{"event": "deep"}',
}


def seen(spark, root):
    good, bad = evidence.read_events(spark, root)
    runs = [(r.run_key, r.marker.bundle_id, r.config.plan_id) for r in evidence.read_runs(spark, root).collect()]
    return runs, sorted((r.run_key, r.event) for r in good.collect()), [(r.key.split("/runs/")[1], r.detail) for r in bad.collect()]


def test_packed_documents_are_read_as_files_are(spark, tmp_path):
    rows = spark.createDataFrame(list(DOCUMENTS.items()), "path string, content string")
    files.write_files(rows, str(tmp_path / "loose"))
    files.pack_files(rows, str(tmp_path / "packed"))
    want = [("r1", "b", "größe")], [("r1", "a"), ("r1", "b")], [("r1/events.jsonl", "bad")]
    assert seen(spark, str(tmp_path / "loose")) == seen(spark, f"file://{tmp_path}/packed") == want
    both = str(tmp_path / "both")
    files.write_files(rows.filter("path like '%r1%'"), both)
    files.pack_files(rows.filter("path not like '%r1%'"), both)
    assert seen(spark, both) == want
    with pytest.raises(validate.EvidenceError):
        evidence.read_events(spark, str(tmp_path / "none"))


def test_trees_of_many_folders_are_few_files(spark, tmp_path):
    """A file for each document took 4 KB of disk, a name and an opening for some 100 bytes, 8 million times on 900,000 customers."""
    from pyspark.sql import functions as F

    spark.range(500).select(F.col("id").alias("c_custkey"), F.lit("m").alias("c_mktsegment"), F.lit(1.5).alias("c_acctbal"), F.lit(1).alias("c_nationkey"), F.lit("n").alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    root = tree_queries._runs(spark, str(tmp_path))
    assert sum(p.is_file() for p in Path(root.removeprefix("file:")).rglob("*")) < 50
    assert evidence.read_events(spark, root)[0].count() == 500 + 167


def test_globs():
    import re

    found = lambda glob, path: re.match(files._expression(glob), path) is not None
    assert found("*/a.json", "x/a.json") and not found("*/a.json", "x/y/a.json") and not found("*/a.json", "x/aXjson")
    assert found("[^._]*.js?n", "k.json") and not found("[^._]*.json", ".k.json") and found("[ab][!c]", "ad") and not found("[ab][!c]", "ac")


def test_bundles_are_marked_by_tasks(spark, tmp_path, monkeypatch):
    """The driver created 900,000 markers one after the other, each with a flush to disk of its own."""
    monkeypatch.setattr(files.BundleWriter, "commit", lambda *_: pytest.fail("the driver commits"))
    rows = spark.createDataFrame([(f"r{i}", "config.json", "{}") for i in range(30)], "run_key string, name string, content string")
    files.write_bundles(rows, str(tmp_path))
    found, missing = evidence.read_remote_layout(spark, str(tmp_path))
    assert found.count() == 30 and missing.count() == 0 and not list(tmp_path.rglob(".*"))
    assert files.create_all([(f"{tmp_path}/runs/r{i}/COMMITTED.json", b"x") for i in range(29, 32)]) == [False, True, True]


def stored(spark, root):
    """Run keys with the ids of their bundles, and what their manifests list."""
    found, missing = evidence.read_remote_layout(spark, str(root))
    assert missing.count() == 0
    rows = found.select("run_key", "bundle_id", "bundle_manifest.run_key", "bundle_manifest.bundle_id", "bundle_manifest.files").collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in rows) and len({r[0] for r in rows}) == len(rows)
    return {r[0]: (r[1], {n: (f.bytes, f.sha256) for n, f in r[4].items()}) for r in rows}


def bundle_rows(spark, keys, text="{}"):
    return spark.createDataFrame([(k, n, c) for k in keys for n, c in (("config.json", f"{text}{k}"), ("failures.jsonl", None))], files.BUNDLE).repartition(3)


def test_packed_bundles_are_read_as_files_are(spark, tmp_path):
    keys = [f"r{i}" for i in range(20)]
    files.write_bundles(bundle_rows(spark, keys), str(tmp_path / "loose"))
    for root in (str(tmp_path / "packed"), f"file://{tmp_path}/uri"):
        files.pack_bundles(bundle_rows(spark, keys), root)
        assert stored(spark, root) == stored(spark, tmp_path / "loose")
    first = stored(spark, tmp_path / "packed")
    files.pack_bundles(bundle_rows(spark, keys[:7]), str(tmp_path / "packed"))  # the same again
    with pytest.raises(validate.EvidenceError, match="2 runs are committed with other contents: r3, r4$"):
        files.pack_bundles(bundle_rows(spark, ["r3", "r4", "s1"], "other"), str(tmp_path / "packed"))
    now = stored(spark, tmp_path / "packed")
    assert {k: now[k] for k in first} == first and set(now) == {*first, "s1"}
    assert sorted(p.name for p in (tmp_path / "packed" / files.COMMITS).iterdir()) == ["commit=1", "commit=2"]


def test_of_two_packed_commits_one_wins(spark, tmp_path, monkeypatch):
    """Another writer takes the first number, and then the second, while this one is about to."""
    rename, others = files.os.rename, iter([bundle_rows(spark, ["r1", "x"], "other"), bundle_rows(spark, ["r2", "y"], "other")])

    def late(*names):
        monkeypatch.setattr(files.os, "rename", rename)
        if (other := next(others, None)) is not None:
            files.pack_bundles(other, str(tmp_path))
            monkeypatch.setattr(files.os, "rename", late)
        rename(*names)

    monkeypatch.setattr(files.os, "rename", late)
    with pytest.raises(validate.EvidenceError, match="2 runs are committed with other contents: r1, r2$"):
        files.pack_bundles(bundle_rows(spark, ["r0", "r1", "r2", "r3"]), str(tmp_path))
    found = {k: v[0] for k, v in stored(spark, tmp_path).items()}
    want = {k: files.bundle_manifest(k, {"config.json": f"{text}{k}".encode(), "failures.jsonl": b""})["bundle_id"] for k, text in (("r0", "{}"), ("r1", "other"), ("r2", "other"), ("r3", "{}"), ("x", "other"), ("y", "other"))}
    assert found == want
    assert sorted(p.name for p in (tmp_path / files.COMMITS).iterdir()) == ["commit=1", "commit=2", "commit=3"]


def test_a_failed_commit_leaves_nothing_and_kinds_do_not_mix(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = bundle_rows(spark, ["r1", "r2"])
    with pytest.raises(Exception, match="a task fails"):
        files.pack_bundles(rows.withColumn("content", F.when(F.col("run_key") == "r2", F.raise_error(F.lit("a task fails"))).otherwise(F.col("content"))), str(tmp_path))
    assert not (tmp_path / files.COMMITS).exists()
    files.write_bundles(rows, str(tmp_path))
    with pytest.raises(validate.EvidenceError, match="has bundles"):
        files.pack_bundles(rows, str(tmp_path))
    files.pack_bundles(rows, str(tmp_path / "packed"))
    with pytest.raises(validate.EvidenceError, match="has _commits"):
        files.write_bundles(rows, str(tmp_path / "packed"))
    assert len(stored(spark, tmp_path)) == len(stored(spark, tmp_path / "packed")) == 2


def test_bundles_of_many_runs_are_few_files(spark, tmp_path, monkeypatch):
    """Four files and two folders a run were 33 million of them for 5.4 million customers, more than the disk has."""
    from pyspark.sql import functions as F

    spark.range(300).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(tree_queries, "shared_folder", lambda *_: f"{tmp_path}/store")
    assert tree_queries.read_remote_layout(spark, str(tmp_path)).filter("bundle_id <> 'missing'").count() == 300
    assert sum(1 for _ in (tmp_path / "store").rglob("*")) < 100


def test_members_of_one_name_in_two_archives(spark):
    """At 513,000 documents names came again in other archives, and each was checked against both."""
    from tallymark.sources import images

    catalog = spark.createDataFrame([("1.zip", "m", 1, "e8b7be43"), ("2.zip", "m", 2, "00000000")], "archive_path string, zip_member string, jpeg_bytes long, crc32 string")
    extracted = spark.createDataFrame([("1.zip", "m", bytearray(b"a")), ("2.zip", "m", bytearray(b"bb"))], "archive_path string, zip_member string, content binary")
    assert [(r.key, r.rule) for r in images.archive_payload_rules(catalog, extracted).collect()] == [("m", "checksum-mismatch")]


def test_sources_are_read_once_and_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver held the status of each file, and contents were read by two branches."""
    from tallymark.sources import images

    (tmp_path / "d/0").mkdir(parents=True)
    (tmp_path / "d/0/a.png").write_bytes(b"")
    (tmp_path / "d/0/b.png").write_bytes(b"")
    _, bad = images.scan_sources(spark, str(tmp_path), 10)
    for file in (tmp_path / "d/0").iterdir():
        file.unlink()
    assert sorted(r.rule for r in bad.collect()) == ["empty", "empty", "not-png", "not-png", "repeated-source"]


def test_doubles_of_few_digits_skip_the_search(spark):
    import json
    import random
    import time

    from pyspark.sql import functions as F

    from tallymark.functions.canonical import json_double

    random.seed(1)
    values = [float(f"{random.uniform(-1e6, 1e6) * 10.0 ** random.randrange(-30, 30):.{k}g}") for k in range(1, 16) for _ in range(300)] + [2e22, 1e15, 3e-310, 1.5e-309, 999999999999999.0, 1e-7, 100.0, 123456789012345680.0, 5e-324, 0.1 + 0.2]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", json_double(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in rows if r.t != json.dumps(r.v)] == []
    few = spark.range(0, 40000, 1, 4).select((F.col("id") / F.lit(100)).alias("v"))
    few.select(F.max(json_double(F.col("v")))).collect()
    start = time.time()
    few.select(F.max(json_double(F.col("v")))).collect()
    assert time.time() - start < 10
