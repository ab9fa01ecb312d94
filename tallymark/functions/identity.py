"""The identities by which runs, environments, platforms, selections, audits and support sets are named.

Each is the SHA-256 of a canonical JSON object. ``..._text`` functions take typed or parsed columns, so they serve documents that are checked and
rows that Spark itself makes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.canonical import canonical_json, document_text, json_string, json_token, object_text

#: The format's version, and the fields of a configuration, those of text first.
VERSION = "2.0"
TEXTS = ("protocol_id", "decoder_id", "package_id", "manifest_id", "selection_id", "multiprocessing_start_method", "output_contract", "support_policy")
VALUES = (
    "requested_threads", "num_workers", "batch_size", "prefetch_factor", "persistent_workers", "logical_repeat_factor", "warmup_passes", "timed_passes_per_run", "minimum_timed_seconds",
)
SECONDS = "minimum_timed_seconds"
#: Schemas that keep numbers as they are written, whole or not.
RAW_CONFIG = ", ".join(f"{f} string" for f in (*TEXTS, *VALUES, "config_id", "run_key", "plan_id", "runner_revision", "repetition", "block_position"))
RAW_DATASET = "workload_id string, support_set_id string, ordered_item_ids array<string>"
RAW_ENVIRONMENT = (
    "environment_id string, dependency_group string, lock_sha256 string, project_sha256 string, runner_revision string, python map<string,string>, platform_tags array<string>, "
    "distributions array<struct<name:string,version:string>>, native_backends map<string,string>"
)
RAW_PLATFORM = "platform_id string, identity string"
_STRINGS = T.ArrayType(T.StringType())
_MAP = T.MapType(T.StringType(), T.StringType())


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def strings(c: Column) -> Column:
    return canonical_json(c, _STRINGS)


def configuration_text(config: Column) -> Column:
    """A configuration that was read with RAW_CONFIG; of its numbers only ``minimum_timed_seconds`` may have a fraction."""
    return object_text({f: json_string(config[f]) for f in TEXTS} | {f: config[f] for f in VALUES} | {SECONDS: json_token(config[SECONDS])})


def typed_configuration_text(columns: Mapping[str, Column]) -> Column:
    """A configuration from typed columns: texts, whole numbers, a boolean and a double; missing ones are null."""
    kinds = {f: T.StringType() for f in TEXTS} | {f: T.LongType() for f in VALUES} | {"persistent_workers": T.BooleanType(), SECONDS: T.DoubleType()}
    casts = {T.LongType: "long", T.DoubleType: "double", T.BooleanType: "boolean", T.StringType: "string"}
    return object_text({f: canonical_json(columns[f].cast(casts[type(k)]), k) if f in columns else F.lit("null") for f, k in kinds.items()})


def environment_text(env: Column) -> Column:
    """An environment with its names normalised and its lists sorted."""
    named = F.transform(env["distributions"], lambda d: F.struct(F.lower(F.regexp_replace(d["name"], "[-_.]+", "-")).alias("name"), d["version"].alias("version")))
    distributions = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())]))
    return object_text({
        "dependency_group": json_string(env["dependency_group"]), "distributions": canonical_json(F.array_sort(named), distributions), "lock_sha256": json_string(env["lock_sha256"]),
        "native_backends": canonical_json(env["native_backends"], _MAP), "platform_tags": strings(F.array_sort(F.array_distinct(env["platform_tags"]))), "project_sha256": json_string(env["project_sha256"]),
        "python": canonical_json(env["python"], _MAP), "runner_revision": json_string(env["runner_revision"]), "schema_version": json_string(F.lit(VERSION)),
    })


def platform_text(identity: Column) -> Column:
    """A platform from the JSON text of its ``identity``, an object of any shape; null if it is none."""
    text = document_text(identity)
    return F.when(text.isNotNull(), object_text({"identity": text, "schema_version": json_string(F.lit(VERSION))}))


def run_text(plan_id: Column, platform_id: Column, environment_id: Column, configuration: Column, runner_revision: Column, workload_id: Column, support_set_id: Column, items: Column, repetition: Column, position: Column, package_id: Column, manifest_id: Column) -> Column:
    """A run. ``configuration`` is its canonical text, ``repetition`` and ``position`` numbers or their text."""
    return object_text({
        "block_position": position.cast("string"), "configuration": configuration, "environment_id": json_string(environment_id), "package_id": json_string(package_id), "plan_id": json_string(plan_id),
        "platform_id": json_string(platform_id), "repetition": repetition.cast("string"), "runner_revision": json_string(runner_revision), "schema_version": json_string(F.lit(VERSION)),
        "support_item_ids": strings(items), "support_set_id": json_string(support_set_id), "workload_id": json_string(workload_id), "workload_manifest_id": json_string(manifest_id),
    })


def run_identities(documents: DataFrame) -> DataFrame:
    """Stored and recomputed identities of runs ``run_key, texts`` (V4): config_id, environment_id, platform_id and run_key.

    ``texts`` maps document names to their JSON text. A document that is missing or no object gives null identities. Stored ones have the prefix ``stored_``.
    """
    parsed = documents.select(
        F.col("run_key").cast("string").alias("folder"), F.from_json(F.col("texts")["config"], RAW_CONFIG).alias("c"), F.from_json(F.col("texts")["dataset"], RAW_DATASET).alias("d"),
        F.from_json(F.col("texts")["environment"], RAW_ENVIRONMENT).alias("e"), F.from_json(F.col("texts")["platform"], RAW_PLATFORM).alias("p"),
    )
    parsed = parsed.withColumn("configuration", F.when(F.col("c").isNotNull(), configuration_text(F.col("c")))).withColumn("platform_text", platform_text(F.col("p.identity")))
    named = parsed.select(
        "*", digest(F.col("configuration")).alias("config_id"), F.when(F.col("e").isNotNull(), digest(environment_text(F.col("e")))).alias("environment_id"), digest(F.col("platform_text")).alias("platform_id"),
    )
    c, d = F.col("c"), F.col("d")
    text = run_text(c["plan_id"], F.col("platform_id"), F.col("environment_id"), F.col("configuration"), c["runner_revision"], d["workload_id"], d["support_set_id"], d["ordered_item_ids"], c["repetition"], c["block_position"], c["package_id"], c["manifest_id"])
    whole = F.col("config_id").isNotNull() & F.col("environment_id").isNotNull() & F.col("platform_id").isNotNull() & d.isNotNull()
    return named.select(
        "folder", "config_id", "environment_id", "platform_id", F.when(whole, digest(text)).alias("run_key"), c["config_id"].alias("stored_config_id"), F.col("e.environment_id").alias("stored_environment_id"),
        F.col("p.platform_id").alias("stored_platform_id"), c["run_key"].alias("stored_run_key"),
    )


def selection_text(manifest_id: Column, items: Column) -> Column:
    """A selection of all items of a manifest, in its order."""
    return object_text({"item_ids": strings(items), "manifest_id": json_string(manifest_id), "method": json_string(F.lit("all")), "schema_version": json_string(F.lit(VERSION))})


def audit_text(audit: Mapping[str, Column], successful: Column, failures: Column) -> Column:
    """A support audit. ``audit``: decoder_id, environment_id, manifest_id, multiprocessing_start_method, platform_id, process_context, requested_threads, selection_id.

    ``successful``: item ids in order; ``failures``: structs of item_id, failure_type and message, in order.
    """
    names = ("decoder_id", "environment_id", "manifest_id", "multiprocessing_start_method", "platform_id", "process_context", "selection_id")
    failure = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("failure_type", "item_id", "message")]))
    fields = {n: json_string(audit[n]) for n in names} | {"requested_threads": audit["requested_threads"].cast("string")}
    return object_text(fields | {"failures": canonical_json(failures, failure), "output_contract": json_string(F.lit("normalized-rgb")), "schema_version": json_string(F.lit(VERSION)), "successful_item_ids": strings(successful)})


def support_set_text(context: Mapping[str, Column], audit_ids: Column, items: Column) -> Column:
    """A support set. ``context``: manifest_id, multiprocessing_start_method, policy, process_context, selection_id; ``audit_ids`` are sorted here, ``items`` in order."""
    fields = {n: json_string(context[n]) for n in ("manifest_id", "multiprocessing_start_method", "policy", "process_context", "selection_id")}
    return object_text(fields | {"audit_ids": strings(F.array_sort(audit_ids)), "item_ids": strings(items), "schema_version": json_string(F.lit(VERSION))})
