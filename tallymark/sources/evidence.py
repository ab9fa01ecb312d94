"""Reading evidence documents (S5-S11). These are ingest jobs: compact their results into Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.digests import document_digest
from tallymark.operators.validate import rule_rows, union_all, violation
from tallymark.sources import schemas
from tallymark.sources.files import read_documents, read_files


def _json(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def _folder() -> Column:
    """The name of the folder that a document of ``path`` lies in."""
    return F.element_at(F.split(F.col("path"), "/"), -2)


def _stem(path: str = "path") -> Column:
    """A document's file name without its ending."""
    return F.regexp_extract(F.col(path), r"([^/]+)\.[^./]+$", 1)


def _parsed(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """``path`` and the fields of the JSON documents that a glob matches, files or packed; those of a broken one are null."""
    return read_documents(spark, pattern).select("path", F.from_json("value", schema).alias("_d")).select("path", "_d.*")


def run_documents(spark: SparkSession, root: str) -> DataFrame:
    """``run_key, texts``: the JSON documents of each folder under ``root/runs`` by their name, from one scan and one exchange.

    Only folders with a ``COMMITTED.json`` are runs; hidden staging folders are not seen.
    """
    docs = read_documents(spark, f"{root}/runs/*/*.json").select(_folder().alias("run_key"), F.struct(_stem().alias("name"), "value").alias("_d"))
    texts = F.map_from_entries(F.collect_list("_d")).alias("texts")  # a bundle has a fixed set of documents
    return docs.groupBy("run_key").agg(texts).filter(F.map_contains_key("texts", "COMMITTED"))


def parse_runs(documents: DataFrame) -> DataFrame:
    """Runs with their documents as structs; a missing document is a null struct, the bundle's manifest is ``bundle_manifest``."""
    parsed = {"marker": ("COMMITTED", schemas.MARKER)} | {n: (n, s) for n, s in schemas.DOCUMENTS.items()}
    return documents.select("run_key", *[F.from_json(F.col("texts")[name], schema).alias(column) for column, (name, schema) in parsed.items()])


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Committed runs under ``root/runs/<run_key>/`` with their documents as structs."""
    return parse_runs(run_documents(spark, root))


def marker_rules(runs: DataFrame) -> DataFrame:
    """Committed runs whose marker, manifest and folder disagree, lack a document or list other files than a bundle has (V1)."""
    odd = ~F.col("marker.run_key").eqNullSafe(F.col("run_key")) | ~F.col("marker.bundle_id").eqNullSafe(F.col("bundle_manifest.bundle_id")) | ~F.col("marker.schema_version").eqNullSafe(F.col("bundle_manifest.schema_version"))
    odd = odd | ~F.col("bundle_manifest.run_key").eqNullSafe(F.col("run_key")) | ~F.col("marker.status").eqNullSafe(F.lit("committed"))
    gaps = F.concat_ws(",", *[F.when(F.col(n).isNull(), F.lit(n)) for n in schemas.DOCUMENTS])
    files = sorted([f"{n}.json" for n in schemas.DOCUMENTS if n != "bundle_manifest"] + [f"{n}.jsonl" for n in schemas.LINES])
    listed = F.array_sort(F.map_keys("bundle_manifest.files"))
    return union_all([
        violation(runs.filter(odd), ["run_key"], "marker-mismatch"),
        violation(runs.withColumn("_g", gaps).filter("_g <> ''"), ["run_key"], "document-missing", F.col("_g")),
        violation(runs.filter(F.col("bundle_manifest").isNotNull() & ~listed.eqNullSafe(F.array(*[F.lit(f) for f in files]))), ["run_key"], "file-set", F.concat_ws(",", listed)),
    ])


def payload_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(listed, files)`` of committed bundles for :func:`payload_rules` (V2): what manifests say, and the files' bytes, those of empty files too."""
    listed = read_runs(spark, root).select("run_key", F.explode("bundle_manifest.files").alias("_name", "_f"))
    listed = listed.select(F.concat_ws("/", "run_key", "_name").alias("path"), F.col("_f.bytes").alias("bytes"), F.col("_f.sha256").alias("sha256"))
    return listed, read_files(spark, f"{root}/runs").select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "content")


def content_rules(spark: SparkSession, path: str, identity: str, file_named: bool = False) -> DataFrame:
    """Content-addressed JSON documents whose ``identity`` is not the digest of the rest (V1, V4, V9), or not their file name.

    The identity is SHA-256 of the canonical JSON of all other fields, at the document's top level.
    """
    docs = spark.read.text(path, wholetext=True).select(_stem("_metadata.file_path").alias("_stem"), "value")
    docs = docs.select("_stem", document_digest(F.col("value"), identity).alias("_digest"), F.get_json_object("value", f"$.{identity}").alias("_id"))
    good = F.col("_digest").isNotNull()
    return rule_rows(docs, ["_stem"], {
        "not-json": ~good,
        "identity-mismatch": good & ~F.col("_id").eqNullSafe(F.col("_digest")),
        "file-name": F.lit(file_named) & good & ~F.col("_id").eqNullSafe(F.col("_stem")),
    })


def read_lines(spark: SparkSession, root: str, name: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``root/runs/[^._]*/<name>.jsonl`` with their run key, and the malformed lines as violations."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = read_documents(spark, f"{root}/runs/*/{name}.jsonl", lines=True).filter("value <> ''").select(_folder().alias("run_key"), F.col("path").alias("_file"), "value", parsed.alias("_r"))
    broken = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    good = rows.filter(~broken).select("run_key", "_r.*").drop("_corrupt")
    return good, violation(rows.filter(broken), ["_file"], "malformed-line", F.col("value"))


def read_samples(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    good, bad = read_lines(spark, root, "samples", schemas.SAMPLE)
    return good.withColumn("started_at_utc", F.try_to_timestamp("started_at_utc")), bad


def read_events(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return read_lines(spark, root, "events", schemas.EVENT)


def read_failures(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return read_lines(spark, root, "failures", schemas.FAILURE)


def read_remote_layout(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Markers ``runs/<run_key>/COMMITTED.json`` with the manifests of ``bundles/<bundle_id>/`` they name.

    Second: markers whose bundle is missing, as violations. Bundles without a marker are not there.
    """
    markers = _parsed(spark, f"{root}/runs/*/COMMITTED.json", schemas.MARKER).select(_folder().alias("run_key"), "bundle_id")
    manifests = read_documents(spark, f"{root}/bundles/*/bundle_manifest.json")
    bundles = manifests.select(_folder().alias("bundle_id"), F.from_json("value", schemas.MANIFEST).alias("bundle_manifest"))
    return markers.join(bundles, "bundle_id"), violation(markers.join(bundles, "bundle_id", "left_anti"), ["run_key"], "bundle-missing", F.col("bundle_id"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Items of manifest documents in list order."""
    docs = _json(spark, path, f"workload_id string, manifest_id string, items array<struct<{', '.join(':'.join(f.split(' ')) for f in schemas.ITEM.split(', '))}>>")
    return docs.select("workload_id", "manifest_id", F.posexplode("items").alias("ordinal", "_i")).select("workload_id", "manifest_id", "ordinal", "_i.*")


def read_package_items(spark: SparkSession, path: str) -> DataFrame:
    """The nested provenance items of package descriptors."""
    docs = _json(spark, path, "package_id string, provenance struct<items:array<struct<jpeg_sha256:string,jpeg_bytes:long,provenance:string,bits_per_pixel:double>>>")
    return docs.select("package_id", F.posexplode("provenance.items").alias("ordinal", "_i")).select("package_id", "ordinal", "_i.*")


def read_audits(spark: SparkSession, root: str) -> DataFrame:
    """Committed support audits at item grain (S9): ``root/keys/<audit_key>.json`` commits ``root/audits/<audit_id>.json``.

    An audit that no committed key names is not there; several keys may name one audit.
    """
    marks = _parsed(spark, f"{root}/keys/*.json", schemas.AUDIT_MARKER).filter((F.col("status") == "committed") & (F.col("audit_key") == _stem())).select("audit_id").distinct()
    docs = _parsed(spark, f"{root}/audits/*.json", schemas.AUDIT)
    docs = docs.filter(F.col("audit_id") == _stem()).drop("path").join(marks, "audit_id", "left_semi")
    context = [c for c in docs.columns if c not in ("successful_item_ids", "failures")]
    good = docs.select(*context, F.explode("successful_item_ids").alias("item_id"), F.lit(True).alias("ok"))
    bad = docs.select(*context, F.explode("failures").alias("_f")).select(*context, "_f.item_id", F.lit(False).alias("ok"), "_f.failure_type", "_f.message")
    return good.unionByName(bad, allowMissingColumns=True)


def read_support_sets(spark: SparkSession, path: str) -> DataFrame:
    """Items of support sets in order."""
    docs = _parsed(spark, path, schemas.SUPPORT_SET)
    return docs.select("support_set_id", "policy", "manifest_id", "selection_id", "audit_ids", "process_context", "multiprocessing_start_method", F.posexplode("item_ids").alias("ordinal", "item_id"))


def read_platforms(spark: SparkSession, path: str) -> DataFrame:
    """Platform descriptors."""
    return _json(spark, path, schemas.PLATFORM)


def read_environments(spark: SparkSession, path: str) -> DataFrame:
    """Environment descriptors with their Python, tags, lock digests and native backends."""
    return _json(spark, path, schemas.ENVIRONMENT)


def read_distributions(spark: SparkSession, path: str) -> DataFrame:
    """Environment descriptors, one row a distribution."""
    return read_environments(spark, path).select("environment_id", F.explode("distributions").alias("_d")).select("environment_id", "_d.name", "_d.version")
