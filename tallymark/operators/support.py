"""Audits and support sets: which items every implementation accepts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.columns import process_context, start_method_of_context
from tallymark.functions.digests import row_digest
from tallymark.operators.decisions import null_safe
from tallymark.operators.ranks import rank_by

OUTCOMES = "item_id string, name string, ok boolean, failure_type string, message string"


class ContractError(ValueError):
    """Raised by a check whose output is decoded but breaks the contract."""


def audit_items(items: DataFrame, checks: Mapping[str, Callable[[bytes], object]]) -> DataFrame:
    """Apply named checks to ``items(item_id, content)`` (H1): one row an item and check; a failing row fails no job.

    Distinct contents should be audited once: give one row a digest and join back. Files come in Arrow batches.
    """
    named = dict(checks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, value in zip(batch.column("item_id").to_pylist(), batch.column("content"), strict=True):
                content = value.as_py()  # one content at a time is copied from the batch
                for name, check in named.items():
                    try:
                        check(content)
                        rows.append((item, name, True, None, None))
                    except ContractError as error:
                        rows.append((item, name, False, "output_contract_error", str(error)))
                    except Exception as error:  # the user's code may raise anything; the row tells
                        rows.append((item, name, False, "decode_error", str(error)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 2 else pa.string()) for i, c in enumerate(columns)], names=["item_id", "name", "ok", "failure_type", "message"])
        pa.default_memory_pool().release_unused()

    return items.select(F.col("item_id").cast("string"), "content").mapInArrow(run, OUTCOMES)


def support_intersection(audits: DataFrame, audit: str, item: str, keys: Sequence[str] = ()) -> DataFrame:
    """Items that all audits (of a group) accept (J2, U1): relational division by count.

    An item counts an audit once, so repeated audit rows change nothing.
    """
    accepted = audits.filter("ok").groupBy(*keys, item).agg(F.count_distinct(audit).alias("_n"))
    if not keys:
        return accepted.join(F.broadcast(audits.agg(F.count_distinct(audit).alias("_all"))), F.col("_n") == F.col("_all")).select(item)
    total = audits.groupBy(*keys).agg(F.count_distinct(audit).alias("_all"))
    return accepted.join(total, list(keys)).filter("_n = _all").select(*keys, item)


def ordered_support(support: DataFrame, selection: DataFrame, item: str, keys: Sequence[str] = ()) -> DataFrame:
    """A support set in the order of ``selection(item, ordinal)``, numbered anew."""
    joined = support.join(selection.select(item, "ordinal"), item)
    return rank_by(joined, keys, ["ordinal", item], F.expr("ordinal div 65536"), "_place").select(*keys, item, F.col("_place").alias("ordinal"))


def operational_support(audits: DataFrame, audit: str, item: str) -> DataFrame:
    """Each audit's accepted items."""
    return audits.filter("ok").select(audit, item).distinct()


def coverage_by_category(audits: DataFrame, decoder: str = "decoder", category: str = "category") -> DataFrame:
    """Accepted and all items of each decoder by category, and over all categories as ``combined``."""
    out = audits.rollup(decoder, category).agg(F.count_if(F.col("ok")).alias("accepted"), F.count("*").alias("total"), F.grouping_id().alias("_level"))
    return out.filter("_level < 2").select(decoder, F.when(F.col("_level") == 1, "combined").otherwise(F.col(category)).alias(category), "accepted", "total")


def with_context(configs: DataFrame) -> DataFrame:
    c = F.col
    return configs.withColumn("process_context", process_context(c("protocol_id"), c("num_workers"))).withColumn("context_start_method", start_method_of_context(c("protocol_id"), c("num_workers"), c("start_method")))


def audit_keys(configs: DataFrame) -> DataFrame:
    """Each configuration with the key of the audit it needs; configurations share audits."""
    return with_context(configs).withColumn("audit_key", row_digest(["decoder_id", "requested_threads", "process_context", "context_start_method"]))


def assign_support_sets(configs: DataFrame, audits: DataFrame) -> DataFrame:
    """How many items each configuration may time.

    ``configs(config_id, support_policy, decoder, process_context)``, ``audits(decoder, process_context, item, ok)``. Policy
    ``operational``: those its own audit accepts. Policy ``common``: those that all audits of common
    configurations accept, over all contexts; the set's identity is per context.
    """
    context = ["decoder", "process_context"]
    common = configs.filter("support_policy = 'common'").select(*context).distinct()
    used = audits.join(common, null_safe(audits, common, context), "left_semi").withColumn("audit", F.concat_ws("/", *context))
    shared = support_intersection(used, "audit", "item").agg(F.count("*").alias("_shared"))
    own = audits.filter("ok").groupBy(*context).agg(F.count_distinct("item").alias("_own"))
    joined = configs.join(own.withColumnsRenamed({k: f"_{k}" for k in context}), configs["decoder"].eqNullSafe(F.col("_decoder")) & configs["process_context"].eqNullSafe(F.col("_process_context")), "left").join(F.broadcast(shared))
    items = F.when(F.col("support_policy") == "common", F.col("_shared")).otherwise(F.coalesce("_own", F.lit(0)))
    set_id = F.when(F.col("support_policy") == "common", F.concat_ws("/", F.lit("common"), "process_context")).otherwise(F.concat_ws("/", F.lit("operational"), *context))
    return joined.select("config_id", "support_policy", set_id.alias("support_set"), items.cast("long").alias("items"))
