from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tallymark.functions import columns as X
from tallymark.functions import digests
from tallymark.operators import catalog, publish, validate
from tallymark.sources import evidence, images, sinks
from tallymark.streaming import runs as streams


def jpeg(width, height, *, components=3, progressive=False, sampling=0x22, table=None, exif=False, scans=1, cut=False):
    seg = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8"
    if exif:
        out += seg(0xE1, b"Exif\0\0abcd")
    if table:
        out += seg(0xDB, b"\0" + bytes(table))
    out += seg(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, height, width, components) + b"".join(bytes([i + 1, sampling if i == 0 else 0x11, 0]) for i in range(components)))
    out += seg(0xDA, b"\1\1\0\0\x3f\0") * scans
    return out + (b"\xff\xe0\xff\xff" if cut else b"\xff\xd9")


def test_scan_and_profile(spark, tmp_path):
    q75 = [min(255, max(1, (v * 50 + 50) // 100)) for v in X.LUMINANCE_Q50]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.JPG").write_bytes(jpeg(64, 48, table=q75, exif=True))
    (tmp_path / "y.jpeg").write_bytes(jpeg(10, 20, components=1, progressive=True, scans=3))
    (tmp_path / "z.jpg").write_bytes(b"no image")
    (tmp_path / "broken.jpg").write_bytes(jpeg(5, 6, sampling=0x21, cut=True))
    (tmp_path / "note.txt").write_bytes(b"")
    found = images.scan_images(spark, str(tmp_path))
    assert found.count() == 4
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.profile_images(found).collect()}
    x, y = rows["x.JPG"], rows["y.jpeg"]
    assert (x.width, x.height, x.subsampling, x.quality_estimate, x.scan_count, x.exif_bytes, x.exif_before_frame, x.parse_error) == (64, 48, "4:2:0", 75, 1, 10, True, None)
    assert (y.subsampling, y.progressive, y.scan_count, y.quality_estimate) == ("grayscale", True, 3, None)
    assert rows["z.jpg"].parse_error and rows["z.jpg"].width is None
    assert rows["broken.jpg"].parse_error and rows["broken.jpg"].width == 5 and rows["broken.jpg"].subsampling == "4:2:2"
    ids = images.with_identity(found, str(tmp_path)).collect()
    assert len({r.item_id for r in ids}) == 4 and {r.relative_path for r in ids} == {"a/x.JPG", "y.jpeg", "z.jpg", "broken.jpg"}


def test_empty_scan_is_an_error(spark, tmp_path):
    (tmp_path / "note.txt").write_bytes(b"x")
    with pytest.raises(validate.EvidenceError):
        images.scan_images(spark, str(tmp_path))


def test_sources_must_be_distinct_large_pngs(spark, tmp_path):
    png = lambda w, h, tail=b"": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", w, h) + tail
    for name, content in {"a.png": png(80, 60), "b.png": png(96, 64), "c.png": png(80, 60), "small.png": png(8, 8), "d.jpg": b"\xff\xd8"}.items():
        (tmp_path / name).write_bytes(content)
    good, bad = images.scan_sources(spark, str(tmp_path), 48)
    assert sorted((r.width, r.height) for r in good.collect()) == [(8, 8), (80, 60), (80, 60), (96, 64)]
    assert sorted(r.rule for r in bad.collect()) == ["not-png", "repeated-source", "too-small"]


def test_archive_catalog(spark, tmp_path):
    for k in range(2):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for p in catalog.PROVENANCES:
                for scene in ("0001", "0002"):
                    z.writestr(f"D0{k}_cam/{p}/D0{k}_img_{p}_{scene}.jpg", b"x" * (k + 1))
            z.writestr("inspection/other.jpg", b"")
        (tmp_path / f"{k}.zip").write_bytes(buffer.getvalue())
    members, twice = images.scan_archive_catalog(spark, f"{tmp_path}/*.zip")
    assert members.count() == 24 and twice.count() == 0
    declared = spark.createDataFrame([(p,) for p in catalog.PROVENANCES], "provenance string")
    assert sorted(r.scene_id for r in catalog.complete_groups(members, ["scene_id"], ["device_id"], declared).collect()) == ["0001", "0002"]
    extracted = members.select("zip_member", F.when(F.col("scene_id") == "0001", F.lit(b"?")).otherwise(F.repeat(F.lit("x"), F.col("jpeg_bytes").cast("int")).cast("binary")).alias("content"))
    assert {r.rule for r in images.archive_payload_rules(members, extracted).collect()} == {"length-mismatch", "checksum-mismatch"}


def canonical(document):
    """The digest by which documents name themselves: of their other fields, sorted, without spaces."""
    return hashlib.sha256(json.dumps(document, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


SAMPLES = '{"sample_index": 0, "elapsed_seconds": 2.0, "items_processed": 2, "started_at_utc": "2024-01-01T00:00:00Z"}\n{"sample_index": 1, "elapsed_seconds": 1.0, "items_processed": 2}\n'


def write_run(root, key, committed=True, drop=(), bundle=None):
    """A run's bundle: nine documents, the manifest that lists them, and the marker that commits them."""
    folder = bundle or root / "runs" / key
    folder.mkdir(parents=True)
    docs = {
        "config": {"config_id": "c", "protocol_id": "decode-memory", "plan_id": "p", "repetition": 0, "manifest_id": "m", "selection_id": "s", "package_id": "k", "support_policy": "common"},
        "dataset": {"workload_id": "w", "ordered_item_ids": ["a", "b"], "manifest_id": "m", "selection_id": "s", "package_id": "other", "support_policy": "common"},
        "environment": {"environment_id": "e", "dependency_group": "core", "python": {"version": "3.13"}, "platform_tags": ["t1", "t2"], "distributions": [{"name": "n", "version": "1"}], "native_backends": {"lib": "2"}, "lock_sha256": "0" * 64},
        "platform": {"platform_id": "q", "identity": {"machine": "m", "location": "z"}},
        "runtime": {"effective_threads": 1, "process_id": 7},
        "summary": {"num_unique_images": 2, "logical_repeat_factor": 1, "logical_decodes_per_pass": 2, "status": "complete", "statistics": {"elapsed_seconds": {"n": 2, "mean": 1.5}}},
    }
    texts = {f"{n}.json": json.dumps(d, indent=1) for n, d in docs.items()} | {"samples.jsonl": SAMPLES, "failures.jsonl": "", "events.jsonl": '{"event": "warmup"}\n'}
    files = {n: {"bytes": len(t.encode()), "sha256": hashlib.sha256(t.encode()).hexdigest()} for n, t in texts.items()}
    manifest = {"files": files, "run_key": key, "schema_version": "2.0"}
    manifest["bundle_id"] = canonical(manifest)
    texts["bundle_manifest.json"] = json.dumps(manifest, indent=2)
    if committed:
        texts["COMMITTED.json"] = json.dumps({"bundle_id": manifest["bundle_id"], "run_key": key, "schema_version": "2.0", "status": "committed"})
    for name, text in texts.items():
        if name.removesuffix(".json") not in drop:
            (folder / name).write_text(text)
    return manifest["bundle_id"]


def test_only_committed_runs_exist(spark, tmp_path):
    bundle = write_run(tmp_path, "r1")
    write_run(tmp_path, "r2", committed=False)
    write_run(tmp_path, ".r3.staging")
    runs = evidence.read_runs(spark, str(tmp_path))
    rows = runs.collect()
    assert [r.run_key for r in rows] == ["r1"] and rows[0].config.protocol_id == "decode-memory" and rows[0].platform.identity["machine"] == "m"
    r = rows[0]
    assert r.bundle_manifest.bundle_id == bundle == r.marker.bundle_id and r.summary.statistics.elapsed_seconds.mean == 1.5 and r.environment.platform_tags == ["t1", "t2"] and r.environment.python == {"version": "3.13"}
    assert evidence.marker_rules(runs).count() == 0
    assert [(v.key, v.rule) for v in validate.dataset_rules(runs).collect()] == [("r1", "package-id-mismatch")]
    assert publish.filter_runs(runs, {"config.protocol_id": "decode-memory", "dataset.workload_id": "w"}).count() == 1
    with pytest.raises(validate.EvidenceError):
        publish.filter_runs(runs, {"config.protocol_id": "other"})
    with pytest.raises(validate.EvidenceError):
        publish.filter_runs(runs, {"summary.x": 1})


def test_missing_document_shows(spark, tmp_path):
    write_run(tmp_path, "r1", drop=("summary",))
    write_run(tmp_path, "r2")
    assert [(r.key, r.rule, r.detail) for r in evidence.marker_rules(evidence.read_runs(spark, str(tmp_path))).collect()] == [("r1", "document-missing", "summary")]


def test_marker_and_file_set_must_agree(spark, tmp_path):
    for key in ("r1", "r2", "r3"):
        write_run(tmp_path, key)
    folder = tmp_path / "runs"
    marker = json.loads((folder / "r1/COMMITTED.json").read_text())
    (folder / "r1/COMMITTED.json").write_text(json.dumps(marker | {"status": "staged"}))
    manifest = json.loads((folder / "r2/bundle_manifest.json").read_text())
    del manifest["files"]["events.jsonl"]
    (folder / "r2/bundle_manifest.json").write_text(json.dumps(manifest))
    assert sorted((r.key, r.rule) for r in evidence.marker_rules(evidence.read_runs(spark, str(tmp_path))).collect()) == [("r1", "marker-mismatch"), ("r2", "file-set")]
    found = evidence.content_rules(spark, f"{tmp_path}/runs/*/bundle_manifest.json", "bundle_id").collect()
    assert [r.rule for r in found] == ["identity-mismatch"]


def test_payload_of_bundles(spark, tmp_path):
    for key in ("r1", "r2", "r3"):
        write_run(tmp_path, key)
    listed, files = evidence.payload_files(spark, str(tmp_path))
    assert listed.count() == 27 and validate.payload_rules(listed, files).count() == 0
    (tmp_path / "runs/r2/events.jsonl").write_text('{"event": "warmuq"}\n')
    (tmp_path / "runs/r3/platform.json").unlink()
    found = validate.payload_rules(*evidence.payload_files(spark, str(tmp_path))).collect()
    assert sorted((r.key, r.rule) for r in found) == [("r2/events.jsonl", "digest-mismatch"), ("r3/platform.json", "file-missing")]


def test_content_names_its_document(spark, tmp_path):
    """Nested values, other alphabets, escapes and nulls keep one canonical form; each field's change is seen."""
    base = {"name": "größe \"x\" \\ 日本", "n": 12345678901, "no": None, "yes": True, "items": [{"b": 1, "a": []}, {}], "zz": {"k": "v"}}
    for i, change in enumerate([{}, {"n": 1}, {"no": "x"}, {"items": []}, {"zz": {}}, {"name": "other"}]):
        document = {**base, "thing_id": canonical(base), **change}
        (tmp_path / (f"{canonical(base)}.json" if i == 0 else f"bad{i}.json")).write_text(json.dumps(document, indent=i or None, ensure_ascii=bool(i % 2)))
    (tmp_path / "broken.json").write_text("{")
    found = sorted((r.key, r.rule) for r in evidence.content_rules(spark, f"{tmp_path}/*.json", "thing_id", file_named=True).collect())
    assert found == sorted([*((f"bad{i}", rule) for i in range(1, 6) for rule in ("identity-mismatch", "file-name")), ("broken", "not-json")])


def test_identity_and_counts(spark):
    good = ("a" * 64, "b" * 40, "b" * 40, "loader-supply", 2, "spawn", 3, ["x", "y"], "dataloader", "spawn", 6, 2, 3, 6)
    names = "run_key string, runner_revision string, environment_revision string, protocol_id string, num_workers int, start_method string, logical_repeat_factor int, ordered_item_ids array<string>, support_process_context string, support_start_method string, items_processed long, num_unique_images long, summary_repeat_factor int, logical_decodes_per_pass long"
    changes = {2: "c" * 40, 8: "main-process", 9: None, 10: 5, 11: 3, 12: 1, 13: 5}
    rows = [good] + [("%064x" % k, *good[1:k], v, *good[k + 1 :]) for k, v in changes.items()] + [("short", "head", *good[2:7], ["x", "x"], *good[8:])]
    found = {}
    for r in validate.identity_rules(spark.createDataFrame(rows, names)).collect():
        found.setdefault(r.key, set()).add(r.rule)
    rules = {2: "revision-mismatch", 8: "context-mismatch", 9: "start-method-mismatch", 10: "items-processed-mismatch", 11: "unique-images-mismatch", 12: "repeat-factor-mismatch", 13: "decodes-mismatch"}
    assert found == {"%064x" % k: {r} for k, r in rules.items()} | {"short": {"run-key-not-a-digest", "revision-malformed", "revision-mismatch", "repeated-items"}}


def test_committed_runs_have_no_failures(spark):
    f = spark.createDataFrame([("r1", "x"), ("r1", "y")], "run_key string, item_id string")
    assert [(r.key, r.rule, r.detail) for r in validate.committed_failures(f).collect()] == [("r1", "timed-failures", "2")]


def test_output_contract(spark):
    rows = spark.createDataFrame([("uint8", 3, 3, True), ("float32", 3, 3, True), ("uint8", 2, 3, True), ("uint8", 3, 4, True), ("uint8", 3, 3, False)], "t string, r int, c int, k boolean")
    assert [r.x for r in rows.select(validate.output_contract(*map(F.col, "trck")).alias("x")).collect()] == [None, "dtype", "rank", "channels", "contiguity"]


def test_lines(spark, tmp_path):
    write_run(tmp_path, "r1")
    (tmp_path / "runs/r1/events.jsonl").write_text('{"event": "warmup", "duration_seconds": 1.0}\nnot json\n')
    samples, bad = evidence.read_samples(spark, str(tmp_path))
    assert sorted(r.sample_index for r in samples.collect()) == [0, 1] and bad.count() == 0
    assert evidence.read_failures(spark, str(tmp_path))[0].count() == 0
    events, bad = evidence.read_events(spark, str(tmp_path))
    assert [r.event for r in events.collect()] == ["warmup"] and [r.detail for r in bad.collect()] == ["not json"]


def test_remote_layout(spark, tmp_path):
    """Markers by run, bundles by their own id; one marker's bundle never arrived, and one bundle has no marker."""
    for key in ("r1", "unmarked"):
        write_run(tmp_path, key, bundle=tmp_path / "staging" / key)
        bundle = json.loads((tmp_path / "staging" / key / "bundle_manifest.json").read_text())["bundle_id"]
        (tmp_path / "bundles").mkdir(exist_ok=True)
        (tmp_path / "staging" / key).rename(tmp_path / "bundles" / bundle)
        if key == "r1":
            found_id = bundle
    for key, name in (("r1", found_id), ("r2", "gone")):
        (tmp_path / "runs" / key).mkdir(parents=True)
        (tmp_path / "runs" / key / "COMMITTED.json").write_text(json.dumps({"bundle_id": name, "run_key": key, "schema_version": "2.0", "status": "committed"}))
    found, missing = evidence.read_remote_layout(spark, str(tmp_path))
    assert [(r.run_key, r.bundle_manifest.run_key) for r in found.collect()] == [("r1", "r1")] and [(r.key, r.detail) for r in missing.collect()] == [("r2", "gone")]


def test_documents_explode_in_order(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"workload_id": "w", "manifest_id": "m", "items": [{"item_id": "b", "width": 1}, {"item_id": "a"}]}))
    assert [(r.ordinal, r.item_id) for r in evidence.read_manifests(spark, f"{tmp_path}/m.json").orderBy("ordinal").collect()] == [(0, "b"), (1, "a")]
    (tmp_path / "p.json").write_text(json.dumps({"package_id": "p", "provenance": {"items": [{"jpeg_sha256": "h", "jpeg_bytes": 3}]}}))
    assert evidence.read_package_items(spark, f"{tmp_path}/p.json").first().jpeg_bytes == 3
    (tmp_path / "e.json").write_text(json.dumps({"environment_id": "e", "distributions": [{"name": "n", "version": "1"}], "native_backends": {"jpeg": "9"}}))
    assert evidence.read_distributions(spark, f"{tmp_path}/e.json").first().version == "1"
    assert evidence.read_environments(spark, f"{tmp_path}/e.json").first().native_backends == {"jpeg": "9"}


def test_support_store(spark, tmp_path):
    """Audits and sets lie under their own ids; keys commit audits."""
    for folder in ("keys", "audits", "sets"):
        (tmp_path / folder).mkdir()
    ids = []
    for decoder in ("d1", "d2", "d3"):
        audit = {"decoder_id": decoder, "requested_threads": None, "schema_version": "2.0", "successful_item_ids": ["a"], "failures": [{"item_id": "b", "failure_type": "decode_error", "message": "m"}]}
        ids.append(canonical(audit))
        (tmp_path / "audits" / f"{ids[-1]}.json").write_text(json.dumps(audit | {"audit_id": ids[-1]}, indent=2))
    for key, audit_id, status in (("k1", ids[0], "committed"), ("k2", ids[1], "staged"), ("k3", ids[0], "committed")):
        (tmp_path / "keys" / f"{key}.json").write_text(json.dumps({"audit_id": audit_id, "audit_key": key, "schema_version": "2.0", "status": status}))
    assert sorted((r.audit_id, r.decoder_id, r.item_id, r.ok, r.failure_type) for r in evidence.read_audits(spark, str(tmp_path)).collect()) == sorted([(ids[0], "d1", "a", True, None), (ids[0], "d1", "b", False, "decode_error")])
    assert evidence.content_rules(spark, f"{tmp_path}/audits/*.json", "audit_id", file_named=True).count() == 0
    support = {"policy": "common", "manifest_id": "m", "selection_id": "s", "process_context": "main-process", "multiprocessing_start_method": None, "audit_ids": ids[:1], "item_ids": ["x", "y"]}
    name = canonical(support)
    (tmp_path / "sets" / f"{name}.json").write_text(json.dumps(support | {"support_set_id": name}))
    rows = evidence.read_support_sets(spark, f"{tmp_path}/sets/*.json").orderBy("ordinal").collect()
    assert [(r.support_set_id, r.item_id, r.manifest_id) for r in rows] == [(name, "x", "m"), (name, "y", "m")]


def test_write_once(spark, tmp_path):
    df = spark.range(3)
    sinks.write_once(df, f"{tmp_path}/t")
    sinks.write_once(df.repartition(2), f"{tmp_path}/t")
    with pytest.raises(validate.EvidenceError):
        sinks.write_once(spark.range(4), f"{tmp_path}/t")
    publish.check_publication(spark.read.parquet(f"{tmp_path}/t"), df)
    with pytest.raises(validate.EvidenceError):
        publish.check_publication(spark.read.parquet(f"{tmp_path}/t"), spark.range(2))


def test_claims_need_their_protocol_alone(spark):
    runs = spark.createDataFrame([("decode-memory",), ("loader-supply",)], "protocol_id string")
    assert publish.claim_scope_gate(runs.limit(1), "decode").count() == 1
    for bad, scope in ((runs, "decode"), (runs.limit(0), "decode"), (runs.limit(1), "training"), (runs.limit(1), "loader")):
        with pytest.raises(validate.EvidenceError):
            publish.claim_scope_gate(bad, scope)


def test_zones_of_a_machine_compare(spark):
    rows = spark.createDataFrame([({"machine": "m", "location": "a"},), ({"location": "b", "machine": "m"},), ({"machine": "n"},)], "identity map<string,string>")
    keys = [r.k for r in rows.select(digests.comparison_key(F.col("identity")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_each_field_changes_the_id(spark):
    base = {"a": "x", "b": 1, "c": None}
    ids = {spark.createDataFrame([tuple(r.values())], "a string, b int, c string").select(digests.row_digest(["a", "b", "c"]).alias("d")).first().d for r in (base, base | {"a": "y"}, base | {"b": 2}, base | {"c": "z"})}
    assert len(ids) == 4


def test_stream_is_idempotent(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "run_key int, committed boolean")
    for part in (rows, rows.filter("run_key < 4")):
        part.coalesce(1).write.mode("append").parquet(source)
        streams.stream_committed_runs(spark, source, rows.schema, target, f"{tmp_path}/cp", files_per_batch=1).awaitTermination()
    assert sorted(r.run_key for r in spark.read.parquet(target).collect()) == [0, 2, 4, 6, 8]
    cell = streams.cell_statistics(spark.read.parquet(target), ["committed"], "run_key").first()
    assert (cell.runs, cell.total, cell.total_of_squares, cell.least, cell.largest, cell["mean"]) == (5, 20, 120.0, 0, 8, 4.0)
