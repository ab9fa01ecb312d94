"""Filtering, gating and publishing results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.validate import EvidenceError, require_non_empty

PREFIXES = ("config", "dataset", "environment", "platform", "runtime")
SCOPES = {"decode": "decode-memory", "loader": "loader-supply"}


def filter_runs(df: DataFrame, filters: Mapping[str, object], check: bool = True) -> DataFrame:
    """Rows that equal all of ``{"config.protocol_id": value, ...}``, where a missing value equals None (F1).

    A path is a struct field of one of the known sections, or a flat column named by its last part. The equalities
    reach the scan as filters. ``check`` raises when nothing is left.
    """
    condition: Column = F.lit(True)
    for path, value in filters.items():
        prefix, _, field = path.partition(".")
        if prefix not in PREFIXES or not field:
            raise EvidenceError(f"filter {path!r} must start with one of {', '.join(PREFIXES)}")
        column = F.col(path) if prefix in df.columns else F.col(field) if field in df.columns else F.lit(None)
        condition = condition & column.eqNullSafe(F.lit(value))
    out = df.filter(condition)
    return require_non_empty(out, "the filtered set of runs") if check else out


def claim_scope_gate(runs: DataFrame, scope: str) -> DataFrame:
    """The runs, if their protocols are exactly what a claim of ``scope`` may rest on (A21); raises otherwise."""
    if scope not in SCOPES:
        raise EvidenceError(f"no claim of scope {scope!r} can be published; one of {', '.join(SCOPES)}")
    found = sorted(str(r[0]) for r in runs.select("protocol_id").distinct().limit(3).collect())
    if found != [SCOPES[scope]]:
        raise EvidenceError(f"scope {scope!r} needs protocol {SCOPES[scope]!r} alone, not {found}")
    return runs


def publication_order(groups: DataFrame, keys: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """By the keys as strings, null as ``None`` (T3), then by the columns ``then`` as they are."""
    return groups.orderBy(*[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys], *then)


def _in_ranges(hashed: DataFrame, order: Sequence[str], name: str, count: str) -> DataFrame:
    """One row: a digest of ``h`` by ``order`` within 4,096 ranges of a hash of the order, then over the ranges' digests.

    So a task gathers a range's hashes and the last one 4,096 digests.
    """
    ranged = hashed.withColumn("_b", F.substring(F.sha2(F.concat_ws("/", *[F.col(c).cast("string") for c in order]), 256), 1, 3))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, "h"))), lambda r: r["h"])
    blocks = ranged.groupBy("_b").agg(F.sha2(F.concat_ws("\n", lines), 256).alias("h"), F.count("*").alias("n"))
    tops = F.transform(F.array_sort(F.collect_list(F.struct("_b", "h"))), lambda r: r["h"])
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias(count), F.sha2(F.concat_ws("\n", tops), 256).alias(name))


def output_digest(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: how many rows, and a digest of their hashes in order (part of K3)."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    return _in_ranges(df.select(*order, h.alias("h")), order, "output_digest", "rows")


def provenance(runs: DataFrame, results: DataFrame, filters: Mapping[str, object], revision: str) -> DataFrame:
    """The one-row sidecar of a publication (K3)."""
    key = F.col("run_key").cast("string")
    side = _in_ranges(runs.select(key.alias("run_key"), key.alias("h")), ["run_key"], "run_keys_digest", "runs")
    out = side.crossJoin(output_digest(results, ["run_key"])).withColumn("filters", F.lit(repr(sorted(filters.items())))).withColumn("revision", F.lit(revision))
    return out.withColumn("publication_id", F.sha2(F.concat_ws("\n", "run_keys_digest", "output_digest", "filters", "revision"), 256))


def differences(published: DataFrame, recomputed: DataFrame, buckets: int = 1 << 16) -> DataFrame:
    """Rows that one side has and the other lacks, repeats counted.

    Both sides are summed up by hash buckets first: a count and two sums of 64-bit hashes of the rows, so only digests are shuffled where nothing
    has changed. Rows are compared only in the buckets whose digests differ, of which there are ``buckets`` at most.
    """
    columns = published.columns
    names = [F.col(f"`{c}`") for c in columns]

    def digests(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(F.xxhash64(*names).alias("h"), F.xxhash64(F.lit(1), *names).alias("g"))
        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        return rows.groupBy(F.pmod("h", F.lit(buckets)).alias(f"b{side}")).agg(F.count("*").alias(f"n{side}"), wide("h").alias(f"h{side}"), wide("g").alias(f"g{side}"))

    both = digests(published, "1").join(digests(recomputed, "2"), F.col("b1") == F.col("b2"), "full_outer")
    same = F.col("n1").eqNullSafe(F.col("n2")) & F.col("h1").eqNullSafe(F.col("h2")) & F.col("g1").eqNullSafe(F.col("g2"))
    changed = F.broadcast(both.filter(~same).select(F.coalesce("b1", "b2").alias("_b")))

    def suspects(df: DataFrame) -> DataFrame:
        rows = df.select(*names, F.pmod(F.xxhash64(*names), F.lit(buckets)).alias("_bucket"))
        return rows.join(changed, F.col("_bucket") == F.col("_b"), "left_semi").select(*names)

    one, two = suspects(published), suspects(recomputed)
    return one.exceptAll(two).withColumn("side", F.lit("published")).unionByName(two.exceptAll(one).withColumn("side", F.lit("recomputed")))


def check_publication(published: DataFrame, recomputed: DataFrame) -> None:
    """Raise unless a publication equals what the evidence gives now (K8)."""
    if set(published.columns) != set(recomputed.columns):
        raise EvidenceError("the publication's columns are stale")
    if not differences(published, recomputed).isEmpty():
        raise EvidenceError("the publication is stale")
