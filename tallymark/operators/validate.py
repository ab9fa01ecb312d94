"""Validation rules (V1-V16): each gives all violations as rows ``(key, rule, detail)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.columns import finite_positive, is_digest, is_revision, process_context, unsafe_path


class EvidenceError(ValueError):
    """A gate found what must not be there."""


def violation(rows: DataFrame, keys: Sequence[str], rule: str, detail: Column | None = None) -> DataFrame:
    key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return rows.select(key.alias("key"), F.lit(rule).alias("rule"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require_empty(violations: DataFrame, what: str = "violations") -> None:
    """Raise with some of the rows if there are any."""
    some = violations.limit(5).collect()
    if some:
        raise EvidenceError(f"{what}: " + "; ".join(" ".join(map(str, r)) for r in some))


def require_non_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise EvidenceError(f"{what} is empty")
    return df


def rule_rows(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """One scan for many row rules: each condition that holds (null: does not) is a violation."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.select(key.alias("key"), F.explode(broken).alias("rule"), F.lit("").alias("detail"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def config_rules(configs: DataFrame, key: str = "config_id") -> DataFrame:
    """Legality of run configurations (V8): what each protocol needs and excludes."""
    c = F.col
    decode, loader = c("protocol_id") == "decode-memory", c("protocol_id") == "loader-supply"
    loader_fields = c("num_workers").isNotNull() | c("batch_size").isNotNull() | c("prefetch_factor").isNotNull() | c("persistent_workers") | c("start_method").isNotNull()
    idle = c("prefetch_factor").isNotNull() | c("persistent_workers") | c("start_method").isNotNull()
    busy = loader & (c("num_workers") > 0)
    return rule_rows(configs, [key], {
        "unsupported-protocol": ~F.coalesce(decode | loader, F.lit(False)),
        "empty-decoder": F.coalesce(c("decoder_id"), F.lit("")) == "",
        "threads-not-positive": c("requested_threads") <= 0,
        "passes-not-positive": F.coalesce(c("timed_passes"), F.lit(0)) <= 0,
        "warmup-negative": F.coalesce(c("warmup_passes"), F.lit(-1)) < 0,
        "unknown-policy": ~F.coalesce(c("support_policy").isin("common", "operational"), F.lit(False)),
        "decode-with-loader-fields": decode & loader_fields,
        "loader-without-workers": loader & (F.coalesce(c("num_workers"), F.lit(-1)) < 0),
        "loader-without-batch": loader & (F.coalesce(c("batch_size"), F.lit(0)) <= 0),
        "idle-loader-with-worker-fields": loader & (c("num_workers") == 0) & idle,
        "workers-without-prefetch": busy & ((F.coalesce(c("prefetch_factor"), F.lit(0)) <= 0) | ~c("persistent_workers")),
        "workers-without-start-method": busy & ~F.coalesce(c("start_method").isin("fork", "forkserver", "spawn"), F.lit(False)),
        "workers-without-warmup": busy & (c("warmup_passes") == 0),
    })


def identity_rules(runs: DataFrame) -> DataFrame:
    """Digest formats, context and item counts of committed runs.

    ``runs``: run_key, runner_revision, environment_revision, protocol_id, num_workers, start_method, logical_repeat_factor, ordered_item_ids,
    support_process_context, support_start_method, items_processed, and of the summary num_unique_images, summary_repeat_factor, logical_decodes_per_pass.
    """
    c = F.col
    items, decodes = F.size("ordered_item_ids"), F.size("ordered_item_ids") * c("logical_repeat_factor")
    return rule_rows(runs, ["run_key"], {
        "run-key-not-a-digest": ~is_digest(c("run_key")),
        "revision-malformed": ~is_revision(c("runner_revision")),
        "revision-mismatch": ~c("environment_revision").eqNullSafe(c("runner_revision")),
        "context-mismatch": ~c("support_process_context").eqNullSafe(process_context(c("protocol_id"), c("num_workers"))),
        "start-method-mismatch": ~c("support_start_method").eqNullSafe(c("start_method")),
        "items-processed-mismatch": c("items_processed") != decodes,
        "unique-images-mismatch": ~c("num_unique_images").eqNullSafe(items.cast("long")),
        "repeat-factor-mismatch": ~c("summary_repeat_factor").eqNullSafe(c("logical_repeat_factor")),
        "decodes-mismatch": ~c("logical_decodes_per_pass").eqNullSafe(decodes.cast("long")),
        "no-items": items <= 0,
        "repeated-items": items != F.size(F.array_distinct("ordered_item_ids")),
    })


def run_identity_rules(found: DataFrame) -> DataFrame:
    """Identities that runs store but their documents do not have (V4), from ``identity.run_identities``; the key is the run's folder."""
    rules = {f"{n}-id-mismatch": ~F.col(f"stored_{n}_id").eqNullSafe(F.col(f"{n}_id")) | F.col(f"{n}_id").isNull() for n in ("config", "environment", "platform")}
    return rule_rows(found, ["folder"], rules | {"run-key-mismatch": ~F.col("run_key").eqNullSafe(F.col("folder")) | ~F.col("stored_run_key").eqNullSafe(F.col("folder"))})


def sample_rules(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples of committed runs against their configuration, and what their summaries say of themselves (V3).

    ``runs``: run_key and the structs ``config`` and ``summary``; ``samples``: run_key, elapsed_seconds, items_processed.
    """
    counted = samples.groupBy("run_key").agg(F.count("*").alias("_n"), F.count_if(F.col("items_processed") > 0).alias("_items"))
    passes = F.col("config.timed_passes_per_run")
    return rule_rows(runs.join(counted, "run_key", "left"), ["run_key"], {
        "sample-count-mismatch": (F.coalesce(passes, F.lit(0)) <= 0) | (passes != F.coalesce("_n", F.lit(0))),
        "items-processed-not-positive": F.col("_items") != F.col("_n"),
        "summary-status": ~F.col("summary.status").eqNullSafe(F.lit("complete")),
        "summary-schema": ~F.col("summary.schema_version").eqNullSafe(F.lit("2.0")),
    })


def runtime_rules(runs: DataFrame) -> DataFrame:
    """What runs' processes reported against their configuration (V6); ``runs``: run_key and the structs ``config`` and ``runtime``.

    A run that decodes in its own process has the requested number of effective threads. A loader has one handshake of each
    worker, or of the process itself without any: with distinct, positive process ids, the start method, and the threads.
    """
    c, r = F.col("config"), F.col("runtime")
    decode, hands, workers = c["protocol_id"] == "decode-memory", r["worker_handshakes"], F.coalesce(c["num_workers"], F.lit(0))
    wrong = lambda threads: (F.coalesce(threads, F.lit(0)) <= 0) | (c["requested_threads"].isNotNull() & (threads != c["requested_threads"]))
    method = F.when(workers == 0, F.lit("in-process")).otherwise(c["multiprocessing_start_method"])
    pids = F.transform(hands, lambda h: h["process_id"])
    loader = ~decode
    return rule_rows(runs, ["run_key"], {
        "effective-threads": decode & wrong(r["effective_threads"]),
        "runtime-start-method": loader & ~r["multiprocessing_start_method"].eqNullSafe(method),
        "worker-count": loader & (F.coalesce(F.size(hands), F.lit(-1)) != F.greatest(workers, F.lit(1))),
        "worker-threads": loader & F.exists(hands, lambda h: wrong(h["effective_threads"])),
        "worker-pid": loader & F.exists(pids, lambda p: F.coalesce(p, F.lit(0)) <= 0),
        "repeated-pid": loader & (F.size(F.array_distinct(pids)) != F.size(pids)),
        "worker-start-method": loader & F.exists(hands, lambda h: ~h["multiprocessing_start_method"].eqNullSafe(method)),
        "workers-not-reused": loader & ~r["persistent_workers_reused"].eqNullSafe(F.lit(True)),
        "coordinator-pid": loader & (r["process_id"].isNull() | ((workers == 0) & F.exists(pids, lambda p: p != r["process_id"])) | ((workers > 0) & F.array_contains(pids, r["process_id"]))),
    })


def dataset_rules(runs: DataFrame) -> DataFrame:
    """Fields that a run's configuration and dataset documents both name and must agree on (V4); ``runs`` as structs ``config`` and ``dataset``."""
    fields = ("manifest_id", "package_id", "selection_id", "support_policy")
    return rule_rows(runs, ["run_key"], {f"{f.replace('_', '-')}-mismatch": ~F.col(f"config.{f}").eqNullSafe(F.col(f"dataset.{f}")) for f in fields})


def file_sets(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing and extra files."""
    missing = violation(expected.select(*keys).exceptAll(found.select(*keys)), keys, "missing")
    return missing.unionByName(violation(found.select(*keys).exceptAll(expected.select(*keys)), keys, "extra"))


def payload_rules(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed ``path, bytes, sha256`` against the content of ``files(path, content)``."""
    seen = files.select("path", F.length("content").cast("long").alias("_size"), F.sha2("content", 256).alias("_sha"))
    joined = listed.join(seen, "path", "left")
    return rule_rows(joined, ["path"], {"file-missing": F.col("_size").isNull(), "size-mismatch": F.col("bytes") != F.col("_size"), "digest-mismatch": F.col("sha256") != F.col("_sha")})


#: Fields of a stored statistic beside its count.
FIELDS = ("mean", "median", "minimum", "maximum", "sample_std", "coefficient_of_variation")


def summary_recheck(again: DataFrame, stored: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Stored statistics of runs against those of their samples (V3).

    Both have ``run_key, statistic, n`` and FIELDS; ``again`` comes from the samples. A null must meet a null, and numbers
    may differ by ``tolerance`` of the larger, or by half of the sixth decimal, to which ``again`` is rounded.
    """
    names = ["n", *FIELDS]
    right = stored.select("run_key", "statistic", F.lit(True).alias("_stored"), *[F.col(c).alias(f"_{c}") for c in names])
    joined = again.withColumn("_again", F.lit(True)).join(right, ["run_key", "statistic"], "full_outer")
    both = F.col("_again").isNotNull() & F.col("_stored").isNotNull()

    def off(c: str) -> Column:
        x, y = F.col(c), F.col(f"_{c}")
        apart = F.abs(x - y) > F.greatest(F.lit(5e-7), tolerance * F.greatest(F.abs(x), F.abs(y)))
        return both & ((x.isNull() != y.isNull()) | F.coalesce(apart, F.lit(False)))

    rules = {"no-samples": F.col("_again").isNull(), "no-summary": F.col("_stored").isNull(), "count-mismatch": both & ~F.col("n").eqNullSafe(F.col("_n"))}
    return rule_rows(joined, ["run_key", "statistic"], rules | {f"{c.replace('_', '-')}-mismatch": off(c) for c in FIELDS})


def committed_failures(failures: DataFrame) -> DataFrame:
    """A committed run has no timed failures (V3)."""
    return violation(failures.groupBy("run_key").agg(F.count("*").alias("n")), ["run_key"], "timed-failures", F.col("n"))


def required_events(events: DataFrame, required: Sequence[str], key: str = "run_key") -> DataFrame:
    """Runs without some of the required phase events, and which."""
    gap = F.array_except(F.array(*[F.lit(r) for r in sorted(required)]), F.collect_set("event"))
    return events.groupBy(key).agg(gap.alias("missing")).filter(F.size("missing") > 0)


def handshake_rules(handshakes: DataFrame) -> DataFrame:
    """Worker handshakes ``run_key, expected, coordinator_pid, pid, start_method, expected_method`` (V6)."""
    per = handshakes.groupBy("run_key").agg(
        F.count("pid").alias("n"), F.count_distinct("pid").alias("pids"), F.max("expected").alias("expected"),
        F.count_if(F.col("pid") == F.col("coordinator_pid")).alias("own"), F.count_if(~F.col("start_method").eqNullSafe(F.col("expected_method"))).alias("methods"),
    )
    return rule_rows(per, ["run_key"], {"worker-count": F.col("n") != F.col("expected"), "repeated-pid": F.col("pids") != F.col("n"), "coordinator-pid": F.col("own") > 0, "start-method": F.col("methods") > 0})


def contexts_agree(audits: DataFrame, keys: Sequence[str], context: Sequence[str]) -> DataFrame:
    """Groups of audits whose context columns differ."""
    per = audits.groupBy(*keys).agg(F.count_distinct(F.struct(*context)).alias("contexts"))
    return violation(per.filter("contexts <> 1"), keys, "contexts-differ", F.col("contexts"))


def manifest_rules(items: DataFrame, workloads: DataFrame) -> DataFrame:
    """Stored item counts, item order and safe paths of manifests (V9)."""
    per = items.groupBy("workload_id").agg(F.count("*").alias("_n"), F.max("ordinal").alias("_last"), F.count_distinct("ordinal").alias("_d"))
    counts = rule_rows(workloads.join(per, "workload_id", "left"), ["workload_id"], {"item-count": F.col("item_count") != F.coalesce("_n", F.lit(0)), "order-gap": (F.col("_last") + 1 != F.col("_n")) | (F.col("_d") != F.col("_n"))})
    return counts.unionByName(rule_rows(items, ["workload_id", "relative_path"], {"unsafe-path": unsafe_path(F.col("relative_path"))}))


def level_rules(levels: DataFrame, sources: DataFrame, maximum: int = 65535) -> DataFrame:
    """Design levels ``long_edge`` (null: native) and sources ``source_id, width, height``."""
    edge = F.col("long_edge")
    bad = rule_rows(levels, ["long_edge"], {"edge-out-of-range": (edge <= 0) | (edge > maximum)})
    twice = violation(duplicates(levels, ["long_edge"]), ["long_edge"], "repeated-level", F.col("n"))
    largest = levels.agg(F.max("long_edge").alias("largest"))
    side = F.greatest("width", "height")
    small = rule_rows(sources.crossJoin(F.broadcast(largest)), ["source_id"], {"source-too-small": side < F.col("largest"), "source-too-large": side > maximum})
    return union_all([bad, twice, small])


def output_contract(dtype: Column, rank: Column, channels: Column, contiguous: Column) -> Column:
    """What of the decoded-image contract an output breaks (V16); null if nothing."""
    return F.when(~dtype.eqNullSafe(F.lit("uint8")), "dtype").when(~rank.eqNullSafe(F.lit(3)), "rank").when(~channels.eqNullSafe(F.lit(3)), "channels").when(~F.coalesce(contiguous, F.lit(False)), "contiguity")


def evidence_rules(runs: DataFrame, expectations: DataFrame) -> DataFrame:
    """Runs against the expectations of their workload: revision, item count, status, one sample, and output contract and manifest where both sides say."""
    joined = runs.join(F.broadcast(expectations), "workload_id", "left")
    rules = {"unknown-workload": F.col("expected_items").isNull(), "item-count": F.col("items") != F.col("expected_items"), "revision": F.col("runner_revision") != F.col("expected_revision"), "not-completed": F.col("status") != "completed", "sample-count": F.col("sample_count") != 1}
    if "output_contract" in runs.columns:
        rules["output-contract"] = ~F.col("output_contract").eqNullSafe(F.lit("normalized-rgb"))
    if "manifest_id" in runs.columns and "expected_manifest" in expectations.columns:
        rules["manifest"] = F.col("expected_items").isNotNull() & ~F.col("manifest_id").eqNullSafe(F.col("expected_manifest"))
    return rule_rows(joined, ["run_key"], rules)


def selection_rules(selections: DataFrame, items: DataFrame) -> DataFrame:
    """Selections ``selection_id, manifest_id, method, expected_items`` against the items of their manifests."""
    found = items.groupBy("manifest_id").agg(F.count("*").alias("_n"), F.count_distinct("item_id").alias("_d"))
    return rule_rows(selections.join(found, "manifest_id", "left"), ["selection_id"], {
        "unknown-method": ~F.col("method").eqNullSafe(F.lit("all")),
        "expected-items-not-positive": F.coalesce("expected_items", F.lit(0)) <= 0,
        "item-count": F.col("expected_items") != F.coalesce("_n", F.lit(0)),
        "repeated-items": F.col("_d") < F.col("_n"),
    })


def design_rules(design: DataFrame, sources: DataFrame, longest: int = 65535, best: int = 95) -> DataFrame:
    """A controlled design ``design_id, kind, value`` (V14), kind ``edge`` (null: native), ``quality`` or ``limit``, and its sources ``design_id, relative_path, sha256``.

    Edges and qualities are positive, bounded and named once; each design has one of both at least, a positive byte limit, and
    sources that differ in path or content.
    """
    v, kind = F.col("value"), F.col("kind")
    bad = rule_rows(design, ["design_id", "value"], {
        "edge-out-of-range": (kind == "edge") & ((v <= 0) | (v > longest)), "quality-out-of-range": (kind == "quality") & ~F.coalesce(v.between(1, best), F.lit(False)), "limit-not-positive": (kind == "limit") & (F.coalesce(v, F.lit(0)) <= 0),
    })
    twice = duplicates(design.filter(kind.isin("edge", "quality")), ["design_id", "kind", "value"])
    repeated = twice.select(F.concat_ws("/", F.col("design_id").cast("string"), F.coalesce(F.col("value").cast("string"), F.lit(""))).alias("key"), F.concat(F.lit("repeated-"), "kind").alias("rule"), F.col("n").cast("string").alias("detail"))
    per = design.groupBy("design_id").agg(F.count_if(kind == "edge").alias("_e"), F.count_if(kind == "quality").alias("_q"))
    gaps = rule_rows(per, ["design_id"], {"no-level": F.col("_e") == 0, "no-quality": F.col("_q") == 0})
    same = violation(duplicates(sources, ["design_id", "relative_path", "sha256"]), ["design_id", "relative_path"], "repeated-source", F.col("n"))
    return union_all([bad, repeated, gaps, same])


def all_values_valid(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return rule_rows(df, keys, {f"{c}-not-positive": ~finite_positive(F.col(c)) for c in columns})


def first_over_limit(df: DataFrame, keys: Sequence[str], order: Sequence[str], running: str, limit: int) -> DataFrame:
    """The first row of each group whose running total exceeds ``limit``."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.filter(F.col(running) > limit).groupBy(*keys).agg(first.alias("_f")).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest]).select(*df.columns)
