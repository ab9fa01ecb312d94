"""The end-to-end plans: publishing, decisions, campaigns and dataset building (A23 and the lifecycles of the survey)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.digests import ordered_digest, row_digest, sequence_digest
from tallymark.operators import catalog, decisions, matrix, metrics, profiles, publish, support, validate
from tallymark.sources.sinks import materialize

CELL_KEYS = ["workload", "machine_type", "protocol", "decoder", "requested_threads", "workers"]


@dataclass
class Publication:
    """What a claim rests on: rows, groups, the runs behind each group and the sidecar that identifies them (K2, K3).

    ``members`` has a row for each run of a group, in the groups' order, then by repetition and run key, so that a group of any size can be published.
    """

    rows: DataFrame
    groups: DataFrame
    members: DataFrame
    provenance: DataFrame

    def sections(self) -> dict[str, DataFrame]:
        return {"rows": self.rows, "groups": self.groups, "members": self.members, "provenance": self.provenance}


def publication(runs: DataFrame, samples: DataFrame, *, scope: str, filters: Mapping[str, object], statistic: str, keys: Sequence[str], revision: str) -> Publication:
    """Filter, validate, gate, project and group committed runs.

    The filters come first and reach the scan. Samples that are not finite and positive, out of sequence, or of mixed
    item counts stop the publication. The samples of the chosen runs are written once to the shared folder, and every step reads them.
    """
    chosen = publish.claim_scope_gate(publish.filter_runs(runs, filters), scope)
    used = materialize(samples.join(chosen.select("run_key"), "run_key", "left_semi"), "samples")
    out_of_place = validate.violation(metrics.consecutive_index(used), ["run_key"], "index-gap")
    broken = validate.all_values_valid(used, ["elapsed_seconds", "items_processed"], ["run_key", "sample_index"])
    validate.require_empty(validate.union_all([metrics.mixed_item_counts(used), out_of_place, broken]), "samples cannot be published")
    members = metrics.group_members(chosen, used, keys, statistic)
    groups = metrics.group_statistics(members, keys)
    validate.require_empty(validate.violation(groups.filter("repeated"), keys, "repeated-repetition"), "groups cannot be published")
    rows = metrics.result_rows(chosen, used, statistic)
    run = members.select(*keys, *[c for c in ("repetition", "run_key") if c not in keys], metrics.rounded(F.col("run_mean")).alias("run_mean"))
    ordered = publish.publication_order(groups.drop("repeated"), keys), publish.publication_order(run, keys, ["repetition", "run_key"])
    return Publication(rows, *ordered, publish.provenance(chosen, rows, filters, revision))


def evidence_document(
    measurements: DataFrame, controls: DataFrame, cells: DataFrame, audits: DataFrame, *, repetitions: Sequence[int], grid: Sequence[int], base_workers: Sequence[int],
    runs: DataFrame | None = None, failures: DataFrame | None = None, items: DataFrame | None = None, timed: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All sections of an evidence document from one table of measurements.

    ``cells``: the cells asked about further workers; ``audits(decoder, category, ok)``. The per-repetition means are
    written once to the shared folder, and every section reads them. With ``runs(run_key, plan_id, workload_id,
    repetition)`` and ``failures(run_key)`` come the sections ``coverage``, ``matrix`` (which plans and repetitions each workload has) and
    ``digests`` (of each plan's run keys); with ``items`` and ``timed`` (manifest rows) ``workloads`` too.
    """
    blocks = materialize(measurements.groupBy(*CELL_KEYS, "repetition").agg(F.avg("images_per_second").alias("v")), "blocks")
    everything = blocks.groupBy(*CELL_KEYS).agg(metrics.rounded(F.avg("v")).alias("mean"))
    own = decisions.controlled_threads(blocks, controls)
    agg = decisions.controlled_threads(everything, controls)
    candidates = decisions.followup_candidates(own, cells, grid)
    more: dict[str, DataFrame] = {}
    if runs is not None:
        if failures is None:
            failures = runs.select("run_key").limit(0)
        more["coverage"] = profiles.coverage(runs, failures, "workload_id", "repetition", items, timed)
        more["matrix"] = runs.groupBy("workload_id", "plan_id").agg(F.count_distinct("repetition").alias("repetitions"), F.count("*").alias("runs"))
        more["digests"] = sequence_digest(runs, ["plan_id"], "run_key")
    if items is not None and timed is not None:
        excluded = items.join(timed.select("item_id"), "item_id", "left_anti")
        more["workloads"] = profiles.workload_profile(timed, excluded)
    return {
        **more,
        "aggregates": metrics.aggregate_measurements(measurements, CELL_KEYS, repetitions),
        "compatibility": support.coverage_by_category(audits),
        "decisions": decisions.decision_rows(agg, own),
        "threads": decisions.thread_contrast(everything, [r["decoder"] for r in controls.collect()], base_workers),
        "transfer": decisions.worker_transfer(agg),
        "peaks": decisions.peak_workers(agg),
        "candidates": candidates,
        "candidate_totals": decisions.followup_totals(candidates),
        "curves": metrics.relative_to_first(own.filter("protocol = 'loader-supply'"), ["workload", "machine_type", "decoder"]),
    }


@dataclass
class Campaign:
    """Run specifications, what is left to run, and what cannot."""

    specs: DataFrame
    pending: DataFrame
    too_large: DataFrame
    violations: DataFrame


def campaign(decoders: DataFrame, workers: DataFrame, fixed: Mapping[str, object], items: DataFrame, committed: DataFrame, *, repetitions: int, seed: int, memory_bytes: float) -> Campaign:
    """Expand, check, size and order a matrix, and drop what is committed.

    ``fixed`` gives the fields that all configurations share. Configurations over the memory limit are set apart before
    any audit; each remaining one carries its audit key, and each run a digest of configuration and repetition.
    """
    cells = matrix.expand_matrix(decoders.withColumnRenamed("decoder", "decoder_id"), workers)
    cells = cells.withColumns({k: F.lit(v) for k, v in fixed.items()})
    loader = F.col("protocol_id") == "loader-supply"
    cells = cells.withColumn("batch_size", F.when(loader, F.col("batch_size"))).withColumn("persistent_workers", F.coalesce(F.col("num_workers") > 0, F.lit(False)))
    cells = cells.withColumn("config_id", row_digest([c for c in cells.columns]))
    sized = matrix.estimate_memory(cells, items, memory_bytes)
    keyed = support.audit_keys(sized.filter("fits"))
    blocks = matrix.randomized_blocks(keyed, "config_id", repetitions, seed)
    specs = blocks.join(keyed, "config_id").withColumn("run_key", row_digest(["config_id", "repetition"]))
    return Campaign(specs, matrix.pending_runs(specs, committed).orderBy("position"), sized.filter("not fits"), validate.config_rules(cells))


@dataclass
class Dataset:
    """The items of a dataset's workloads in order, their blobs and identities, and budgets that are passed."""

    items: DataFrame
    blobs: DataFrame
    identities: DataFrame
    over_budget: DataFrame


def dataset(members: DataFrame, *, scenes: int, seed: int, byte_limit: int, provenances: Sequence[str] = catalog.PROVENANCES) -> Dataset:
    """From a catalogue to ordered workloads.

    ``members(scene_id, device_id, provenance, zip_member, sha256, jpeg_bytes)``. Scenes must be complete over all
    observed devices and declared provenances.
    """
    spark = members.sparkSession
    declared = spark.createDataFrame([(p,) for p in provenances], "provenance string")
    whole = catalog.complete_groups(members, ["scene_id"], ["device_id"], declared)
    chosen = catalog.select_top_hashed(whole, "scene_id", scenes, seed, "scene").select("scene_id")
    views = catalog.native_view(members.join(F.broadcast(chosen), "scene_id", "left_semi"))
    over = catalog.byte_budget(views, ["workload"], ["scene_id", "device_id", "provenance"], "jpeg_bytes", byte_limit)
    ordered = catalog.seeded_order(views, ["workload"], "zip_member", seed, "item").withColumnRenamed("position", "ordinal")
    blobs = catalog.dedup_blobs(ordered, "sha256", ["workload", "ordinal"], "zip_member")
    ids = ordered_digest(ordered, ["workload"], "ordinal", ["zip_member", "sha256", "jpeg_bytes"], "manifest_id")
    return Dataset(ordered, blobs, ids, over)


def workload_document(items: DataFrame, accepted: DataFrame, key: str, metric_columns: Sequence[str]) -> dict[str, DataFrame]:
    """Profiles of timed and excluded items (A8, A9): ``accepted`` has the keys that every implementation takes."""
    timed, excluded = profiles.manifest_split(items, accepted, key)
    return {"profile": profiles.workload_profile(timed, excluded), "quantiles": profiles.workload_quantiles(timed, metric_columns), "excluded": profiles.excluded_profile(items, excluded, "subsampling")}
