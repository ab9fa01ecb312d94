"""Evidence tables as views over the provided tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS = {
    "f_measurements": """
select case when l_linestatus = 'F' then 'native' else 'mixed' end as workload,
       concat('platform-', cast(s_nationkey % 4 as string)) as machine_type,
       case when l_returnflag = 'A' then 'decode-memory' else 'loader-supply' end as protocol,
       concat('dec-', lpad(cast(l_partkey % 12 as string), 2, '0')) as decoder,
       case when l_partkey % 12 in (5, 7, 10) and l_linenumber % 2 = 0 then 1 end as requested_threads,
       case when l_returnflag = 'A' then null
            else case cast(l_quantity as int) % 5 when 0 then 0 when 1 then 2 when 2 then 4 when 3 then 8 else 12 end
       end as workers,
       cast(l_orderkey % 5 as int) as repetition,
       l_extendedprice / l_quantity as images_per_second
from {lineitem} join {supplier} on l_suppkey = s_suppkey""",
    "f_samples": """
select l_orderkey as run_key,
       cast(row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as sample_index,
       l_quantity / 10.0 as elapsed_seconds,
       1 + l_orderkey % 50 as items_processed,
       l_linenumber - 1 as raw_index
from {lineitem}""",
    "f_runs": """
select o_orderkey as run_key,
       o_orderpriority as plan_id,
       o_custkey % 15 as config_id,
       case when o_custkey % 2 = 0 then 'decode-memory' else 'loader-supply' end as protocol_id,
       case when o_custkey % 2 = 0 then null else (o_custkey % 3) * 4 end as num_workers,
       case when c_nationkey % 2 = 0 then 'native' else 'mixed' end as workload_id,
       concat('platform-', cast(c_nationkey % 4 as string)) as machine_type,
       case when c_nationkey % 3 = 0 then '' else concat('zone-', cast(c_nationkey % 3 as string)) end as location,
       o_orderstatus = 'F' as committed
from {orders} join {customer} on o_custkey = c_custkey""",
    "f_items": """
select lang as workload_id, doc_id,
       concat(source, '/', lang, '/', cast(doc_id as string), '.txt') as relative_path,
       text as content, n_chars as compressed_bytes,
       16 + n_chars % 640 as width, 16 + n_chars % 480 as height,
       case when doc_id % 7 = 0 then 1 else 3 end as components,
       1 + doc_id % 2 as h, 1 + doc_id % 3 as v,
       doc_id % 5 = 0 as progressive,
       37 * (doc_id % 211) as luma_sum
from {documents}""",
    "f_audits": """
select d.doc_id, concat('dec-', lpad(cast(k.k as string), 2, '0')) as decoder,
       case when k.k % 2 = 0 then 'main-process' else 'dataloader' end as process_context,
       (d.doc_id + 8 * k.k) % 97 <> 0 as ok,
       case when (d.doc_id + 8 * k.k) % 97 <> 0 then null
            when k.k % 3 = 0 then 'output_contract_error' else 'decode_error' end as failure_type
from {documents} d cross join (select distinct p_partkey % 12 as k from {part}) k""",
    "f_catalog": """
select user_id as device_id, cast(ts as date) as scene_day, event_type as provenance, event_id as member_id, value as jpeg_bytes
from {events}""",
    "f_attempts": """
select user_id as run_key, event_id as attempt_id, event_type as status, ts as finished_at, value as duration_seconds
from {events}""",
    "f_specs": """
select o_orderkey as id, o_orderpriority as workload_id, c_name as machine, c_nationkey as nation, c_mktsegment as segment,
       case when o_custkey % 2 = 0 then 'decode-memory' else 'loader-supply' end as protocol_id,
       concat('dec-', lpad(cast(o_custkey % 12 as string), 2, '0')) as decoder_id,
       case when o_custkey % 3 <> 0 then 1 + o_custkey % 4 end as requested_threads,
       case when o_custkey % 2 = 1 then (o_orderkey % 3) * 4 end as num_workers,
       case when o_custkey % 2 = 1 then 16 end as batch_size,
       case when o_custkey % 2 = 1 and o_orderkey % 3 > 0 then 2 end as prefetch_factor,
       o_custkey % 2 = 1 and o_orderkey % 3 > 0 as persistent_workers,
       case when o_custkey % 2 = 1 and o_orderkey % 3 > 0 then 'spawn' end as start_method,
       1 + o_orderkey % 3 as logical_repeat_factor, 1 + o_orderkey % 2 as warmup_passes, 1 + o_orderkey % 4 as timed_passes,
       case o_orderkey % 4 when 0 then 1.0 when 1 then o_totalprice when 2 then o_totalprice / 1e11 else o_totalprice * 1e17 end as minimum_timed_seconds,
       o_orderkey % 5 as repetition, o_orderkey % 101 as block_position
from {orders} join {customer} on o_custkey = c_custkey""",
    "f_distributions": """
select p_size % 4 as environment_id, p_brand as name, case when p_brand like '%3' then p_type else 'v1' end as version
from {part}""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: read(spark, sf_dir, t) for t in used})


def with_views(body: str) -> str:
    """DuckDB SQL whose ``f_...`` names are defined before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    parts = [f"{v} as ({re.sub(r'[{}]', '', VIEWS[v])})" for v in used]
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {', '.join([*parts, body[5:]])}" if parts else body
    return f"with {', '.join(parts)} {body}" if parts else body
