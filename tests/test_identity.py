from __future__ import annotations

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallymark.functions import canonical, identity
from tallymark.operators import validate
from tallymark.sources import evidence


def dump(value):
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def sha(value):
    return hashlib.sha256(dump(value).encode()).hexdigest()


def test_doubles_print_as_json_dumps_does(spark):
    rnd = random.Random(5)
    values = [1.0, 1e-07, 1.5e300, 1e16, 1e15, 123456789012345680.0, 1e-4, 1e-5, 5e-324, 2.0**-44, 2e23, 1e23, 9007199254740993.0, 0.1 + 0.2, -0.0, 0.0, float("inf"), float("-inf"), float("nan"), 1e22, None]
    values += [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0] for _ in range(4000)] + [rnd.random() * 10 ** rnd.randrange(-8, 24) for _ in range(4000)] + [round(rnd.random() * 1000, rnd.randrange(5)) for _ in range(1000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", canonical.json_double(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in rows if r.t != (None if r.v is None else json.dumps(r.v))] == []


def test_strings_print_as_json_dumps_does(spark):
    rnd = random.Random(6)
    alphabet = [*map(chr, [0, 1, 7, 8, 9, 10, 11, 12, 13, 14, 27, 31, 34, 92, 47, 117, 48, 66, 127, 0x2028, 0xE9, 0x1F600]), "\\u001F", "u001F"]
    values = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(12))) for _ in range(3000)] + [None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", canonical.json_string(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in rows if r.t != (None if r.v is None else json.dumps(r.v, ensure_ascii=False))] == []


def test_nested_types_print_in_key_order(spark):
    kind = "v struct<b:long, a:array<struct<y:double, x:string>>, Z:map<string,boolean>, e:int, `ä`:array<string>>"
    value = (12345678901, [(1.0, "q"), (1e-07, None)], {"k2": True, "K": False, "ö": None}, None, ["\x1f", '"'])
    df = spark.createDataFrame([(value,), (None,)], kind)
    got = [r.t for r in df.select(canonical.canonical_json(F.col("v"), df.schema["v"].dataType).alias("t")).collect()]
    plain = {"b": 12345678901, "a": [{"y": 1.0, "x": "q"}, {"y": 1e-07, "x": None}], "Z": {"k2": True, "K": False, "ö": None}, "e": None, "ä": ["\x1f", '"']}
    assert got == [dump(plain), "null"]
    with pytest.raises(TypeError):
        canonical.canonical_json(F.lit(None), spark.range(1).select(F.current_date()).schema[0].dataType)


def test_documents_of_any_shape_lose_the_field_at_the_top_only(spark):
    docs = [{"id": "x", "n": 1.0, "t": 1e-07, "h": 1.5e300, "deep": {"id": "x", "list": [{"id": 1}]}}, {"id": "x"}, {}, [1], None]
    rows = [(json.dumps(d, indent=i or None),) for i, d in enumerate(docs)] + [("{",), (None,), ("",)]
    got = [r.t for r in spark.createDataFrame(rows, "v string").select(canonical.document_text(F.col("v"), "id").alias("t")).collect()]
    assert got == [dump({k: v for k, v in d.items() if k != "id"}) if isinstance(d, dict) else None for d in docs] + [None, None, None]


def test_content_rules_take_floats_and_nested_names(spark, tmp_path):
    base = {"seconds": 1.0, "tiny": 1e-07, "huge": 1.5e300, "inner": {"thing_id": "a", "n": [2.50]}}
    name = sha(base)
    (tmp_path / f"{name}.json").write_text(json.dumps(base | {"thing_id": name}, indent=3))
    (tmp_path / "whole.json").write_text(json.dumps(base | {"seconds": 1, "thing_id": name}))
    (tmp_path / "inner.json").write_text(json.dumps(base | {"inner": {"thing_id": "b", "n": [2.5]}, "thing_id": name}))
    found = evidence.content_rules(spark, f"{tmp_path}/*.json", "thing_id").collect()
    assert sorted((r.key, r.rule) for r in found) == [("inner", "identity-mismatch"), ("whole", "identity-mismatch")]


def bundle(seconds=1.0, **changes):
    """A run's documents with identities made by plain ``json.dumps``."""
    config = {
        "protocol_id": "loader-supply", "decoder_id": "dec", "package_id": "a" * 64, "manifest_id": "b" * 64, "selection_id": "c" * 64, "requested_threads": None, "num_workers": 2, "batch_size": 8, "prefetch_factor": 2,
        "persistent_workers": True, "multiprocessing_start_method": "spawn", "logical_repeat_factor": 1, "warmup_passes": 1, "timed_passes_per_run": 2, "minimum_timed_seconds": seconds, "output_contract": "normalized-rgb", "support_policy": "common",
    }
    environment = {
        "dependency_group": "g", "distributions": [{"name": "a-b", "version": "1"}, {"name": "z", "version": "2"}], "lock_sha256": "d" * 64, "native_backends": {}, "platform_tags": ["x", "y"], "project_sha256": "e" * 64,
        "python": {"abi": "c", "implementation": "i", "version": "v"}, "runner_revision": "f" * 40, "schema_version": "2.0",
    }
    host = {"machine_type": "m", "cores": 8, "share": 1.0, "drift": 1e-07, "none": None, "list": [1, {"b": 1, "a": 2.5}]}
    config_id, environment_id, platform_id = sha(config), sha(environment), sha({"identity": host, "schema_version": "2.0"})
    dataset = {"workload_id": "w", "support_set_id": "s", "ordered_item_ids": ["i2", 'i"1'], "manifest_id": "b" * 64, "package_id": "a" * 64, "selection_id": "c" * 64, "support_policy": "common"}
    run = {
        "block_position": 4, "configuration": config, "environment_id": environment_id, "package_id": config["package_id"], "plan_id": "p", "platform_id": platform_id, "repetition": 0, "runner_revision": "f" * 40, "schema_version": "2.0",
        "support_item_ids": dataset["ordered_item_ids"], "support_set_id": "s", "workload_id": "w", "workload_manifest_id": config["manifest_id"],
    }
    key = sha(run)
    documents = {
        "config": config | {"config_id": config_id, "run_key": key, "plan_id": "p", "runner_revision": "f" * 40, "repetition": 0, "block_position": 4},
        "dataset": dataset,
        "environment": environment | {"environment_id": environment_id, "distributions": [{"version": "2", "name": "Z"}, {"name": "A._b", "version": "1"}], "platform_tags": ["y", "x", "y"]},
        "platform": {"identity": host, "platform_id": platform_id, "runtime": {"any": 1}, "schema_version": "2.0"},
    }
    for path, value in changes.items():
        name, field = path.split("__")
        if name == "drop":
            del documents[field]
        else:
            documents[name][field] = value
    return key, documents


CHANGES = [
    ({}, set()), ({"seconds": 1}, set()), ({"seconds": 2.5e-07}, set()),
    ({"config__minimum_timed_seconds": 1}, {"config-id-mismatch", "run-key-mismatch"}), ({"config__persistent_workers": False}, {"config-id-mismatch", "run-key-mismatch"}), ({"config__requested_threads": 1}, {"config-id-mismatch", "run-key-mismatch"}),
    ({"config__config_id": "0" * 64}, {"config-id-mismatch"}), ({"config__run_key": "0" * 64}, {"run-key-mismatch"}), ({"config__repetition": 1}, {"run-key-mismatch"}), ({"config__plan_id": "q"}, {"run-key-mismatch"}),
    ({"dataset__ordered_item_ids": ['i"1', "i2"]}, {"run-key-mismatch"}), ({"dataset__workload_id": "v"}, {"run-key-mismatch"}),
    ({"environment__native_backends": {"jpeg": "9"}}, {"environment-id-mismatch", "run-key-mismatch"}), ({"environment__python": {"abi": "c"}}, {"environment-id-mismatch", "run-key-mismatch"}),
    ({"platform__identity": {"machine_type": "m"}}, {"platform-id-mismatch", "run-key-mismatch"}), ({"platform__identity": {}}, {"platform-id-mismatch", "run-key-mismatch"}), ({"drop__platform": 1}, {"platform-id-mismatch", "run-key-mismatch"}),
    ({"drop__config": 1}, {"config-id-mismatch", "run-key-mismatch"}),
]


def test_each_changed_field_of_a_bundle_is_seen(spark, tmp_path):
    want = {}
    for i, (changes, rules) in enumerate(CHANGES):
        key, documents = bundle(**changes)
        folder = tmp_path / f"{i}" / "runs" / key
        folder.mkdir(parents=True)
        (folder / "COMMITTED.json").write_text("{}")
        for name, document in documents.items():
            (folder / f"{name}.json").write_text(json.dumps(document, indent=i % 3 or None, ensure_ascii=bool(i % 2)))
        want[i] = rules
    docs = None
    for i in want:
        part = evidence.run_documents(spark, f"{tmp_path}/{i}").withColumn("i", F.lit(i))
        docs = part if docs is None else docs.unionByName(part)
    docs = docs.cache()
    got = {i: set() for i in want}
    for i in want:
        got[i] = {r.rule for r in validate.run_identity_rules(identity.run_identities(docs.filter(F.col("i") == i).drop("i"))).collect()}
    docs.unpersist()
    assert got == want


def test_typed_rows_have_the_identities_of_their_documents(spark):
    config = bundle()[1]["config"]
    columns = {f: F.lit(config[f]) for f in (*identity.TEXTS, *identity.VALUES) if config[f] is not None}
    assert spark.range(1).select(identity.digest(identity.typed_configuration_text(columns)).alias("d")).first().d == config["config_id"]
    rows = spark.createDataFrame([("m", ["b", "a"])], "m string, items array<string>")
    assert rows.select(identity.selection_text(F.col("m"), F.col("items")).alias("t")).first().t == dump({"item_ids": ["b", "a"], "manifest_id": "m", "method": "all", "schema_version": "2.0"})
    context = {"manifest_id": "m", "multiprocessing_start_method": None, "policy": "common", "process_context": "main-process", "selection_id": "s"}
    text = identity.support_set_text({k: F.lit(v).cast("string") for k, v in context.items()}, F.array(F.lit("z"), F.lit("k")), F.col("items"))
    assert rows.select(text.alias("t")).first().t == dump(context | {"audit_ids": ["k", "z"], "item_ids": ["b", "a"], "schema_version": "2.0"})
    audit = {"decoder_id": "d", "environment_id": "e", "manifest_id": "m", "multiprocessing_start_method": None, "platform_id": "p", "process_context": "main-process", "selection_id": "s"}
    failed = F.array(F.struct(F.lit("i").alias("item_id"), F.lit("decode_error").alias("failure_type"), F.lit("x").alias("message")))
    text = identity.audit_text({k: F.lit(v).cast("string") for k, v in audit.items()} | {"requested_threads": F.lit(2)}, F.col("items"), failed)
    plain = audit | {"requested_threads": 2, "failures": [{"item_id": "i", "failure_type": "decode_error", "message": "x"}], "output_contract": "normalized-rgb", "schema_version": "2.0", "successful_item_ids": ["b", "a"]}
    assert rows.select(text.alias("t")).first().t == dump(plain)


def test_run_reports_must_fit_their_configuration(spark):
    runtime = "struct<effective_threads:int,multiprocessing_start_method:string,process_id:long,persistent_workers_reused:boolean,worker_handshakes:array<struct<process_id:long,effective_threads:int,multiprocessing_start_method:string>>>"
    schema = f"run_key string, config struct<protocol_id:string,num_workers:int,requested_threads:int,multiprocessing_start_method:string>, runtime {runtime}"
    decode, loader, own = ("decode-memory", None, 2, None), ("loader-supply", 2, None, "spawn"), ("loader-supply", 0, None, None)
    hands = [(5, 1, "spawn"), (6, 1, "spawn")]
    cases = {
        "fine decode": (decode, (2, None, 1, None, None), set()), "threads": (decode, (1, None, 1, None, None), {"effective-threads"}), "no threads": (decode, (None, None, 1, None, None), {"effective-threads"}),
        "fine loader": (loader, (1, "spawn", 1, True, hands), set()), "fine own": (own, (1, "in-process", 1, True, [(1, 4, "in-process")]), set()),
        "one worker": (loader, (1, "spawn", 1, True, hands[:1]), {"worker-count"}), "no report": (loader, (1, "spawn", 1, True, None), {"worker-count"}), "twice": (loader, (1, "spawn", 1, True, [hands[0]] * 2), {"repeated-pid"}),
        "own pid": (loader, (1, "spawn", 6, True, hands), {"coordinator-pid"}), "other pid": (own, (1, "in-process", 2, True, [(1, 4, "in-process")]), {"coordinator-pid"}), "no pid": (loader, (1, "spawn", None, True, hands), {"coordinator-pid"}),
        "not reused": (loader, (1, "spawn", 1, None, hands), {"workers-not-reused"}), "method": (loader, (1, "fork", 1, True, hands), {"runtime-start-method"}), "worker method": (loader, (1, "spawn", 1, True, [hands[0], (6, 1, None)]), {"worker-start-method"}),
        "bad pid": (loader, (1, "spawn", 1, True, [hands[0], (-6, 1, "spawn")]), {"worker-pid"}), "worker threads": (loader, (1, "spawn", 1, True, [hands[0], (6, 0, "spawn")]), {"worker-threads"}),
    }
    found = {k: set() for k in cases}
    for r in validate.runtime_rules(spark.createDataFrame([(k, c, r) for k, (c, r, _) in cases.items()], schema)).collect():
        found[r.key].add(r.rule)
    assert found == {k: v[2] for k, v in cases.items()}


def test_samples_and_summaries_must_fit(spark):
    runs = spark.createDataFrame([("a", (2,), ("complete", "2.0")), ("b", (2,), ("complete", "2.0")), ("c", (None,), ("partial", None)), ("d", (1,), None)], "run_key string, config struct<timed_passes_per_run:int>, summary struct<status:string,schema_version:string>")
    samples = spark.createDataFrame([("a", 1.0, 3), ("a", 1.0, 3), ("b", 1.0, 0), ("d", 1.0, 1)], "run_key string, elapsed_seconds double, items_processed long")
    found = {}
    for r in validate.sample_rules(runs, samples).collect():
        found.setdefault(r.key, set()).add(r.rule)
    assert found == {"b": {"sample-count-mismatch", "items-processed-not-positive"}, "c": {"sample-count-mismatch", "summary-status", "summary-schema"}, "d": {"summary-status", "summary-schema"}}
