"""Queries about evidence documents that stand for the rows of the provided tables: their identities, counts and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.functions import identity
from tallymark.operators import decisions, validate
from tallymark.plans.fixtures import read, view
from tallymark.plans.registered import query
from tallymark.sources.files import spread
from tallymark.sources.sinks import shared_folder
from tallymark.streaming import runs as streams


def _sha(*parts: str | Column) -> Column:
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def _text(*parts: str | Column) -> Column:
    return F.concat(F.lit(parts[0]), *[F.col(p) if isinstance(p, str) else p for p in parts[1:]])


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def bundle_parts(spark: SparkSession, d: str) -> DataFrame:
    """The fields of each order's run, in no canonical order: ``id`` and the structs' columns."""
    s = view(spark, d, "f_specs").repartition(spread(spark), "id")  # much work for few bytes
    item = lambda k: F.concat(F.lit(f'{k} "größe" \\ '), F.col("id").cast("string"))
    return s.select(
        "*", _sha("manifest", F.col("workload_id")).alias("manifest_id"), _sha("package").alias("package_id"), _sha("selection", F.col("workload_id")).alias("selection_id"), _sha("plan", F.col("workload_id")).alias("plan_id"),
        _sha("set", F.col("workload_id")).alias("support_set_id"), F.lit("a" * 40).alias("revision"), F.slice(F.array(item(2), item(1), item(3)), F.lit(1), (1 + F.col("id") % 3).cast("int")).alias("items"),
        F.lit("common").alias("support_policy"), _sha("project", F.col("segment")).alias("project"),
    )


def bundle_texts(rows: DataFrame, ids: bool = False) -> DataFrame:
    """``id, run_key, texts`` of runs: their JSON documents, with the identities of the columns ``config_id`` ... ``run_key`` if ``ids``."""
    c = F.col
    named = lambda n: c(n) if ids else F.lit(None).cast("string")
    config = _json(
        support_policy=c("support_policy"), protocol_id=c("protocol_id"), decoder_id=c("decoder_id"), package_id=c("package_id"), manifest_id=c("manifest_id"), selection_id=c("selection_id"), requested_threads=c("requested_threads"),
        num_workers=c("num_workers"), batch_size=c("batch_size"), prefetch_factor=c("prefetch_factor"), persistent_workers=c("persistent_workers"), multiprocessing_start_method=c("start_method"),
        logical_repeat_factor=c("logical_repeat_factor"), warmup_passes=c("warmup_passes"), timed_passes_per_run=c("timed_passes"), minimum_timed_seconds=c("minimum_timed_seconds"), output_contract=F.lit("normalized-rgb"),
        plan_id=c("plan_id"), runner_revision=c("revision"), repetition=c("repetition"), block_position=c("block_position"), config_id=named("config_id"), run_key=named("run_key"), schema_version=F.lit("2.0"),
    )
    dataset = _json(workload_id=c("workload_id"), support_set_id=c("support_set_id"), ordered_item_ids=c("items"), manifest_id=c("manifest_id"), package_id=c("package_id"), selection_id=c("selection_id"), support_policy=c("support_policy"))
    distribution = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("version"))
    environment = _json(
        environment_id=named("environment_id"), schema_version=F.lit("2.0"), dependency_group=F.concat(F.lit('group "'), c("nation").cast("string"), F.lit('"')), lock_sha256=_sha("lock"), project_sha256=c("project"), runner_revision=c("revision"),
        python=F.create_map(F.lit("version"), F.lit("3.13"), F.lit("abi"), F.lit("cp313"), F.lit("implementation"), F.lit("cpython")), platform_tags=F.array(F.lit("t2"), F.lit("t1"), F.lit("t2")),
        distributions=F.array(distribution("Lib_B.x", F.lit("1.0")), distribution("a-lib", c("segment"))), native_backends=F.create_map(F.lit("jpeg"), c("segment"), F.lit("Ä"), F.lit("9")),
    )
    host = F.struct(c("machine").alias("machine_type"), F.lit(8).alias("logical_cpu_count"), F.lit(1.0).alias("share"), (c("nation") / F.lit(1e8)).alias("drift"), F.lit(None).cast("string").alias("cpu_family"), F.array(F.lit(1), F.lit(2)).alias("sockets"))
    platform = _json(platform_id=named("platform_id"), identity=host, runtime=F.create_map(F.lit("kernel"), F.lit("6")), provenance=F.create_map(F.lit("location"), F.lit("z")), schema_version=F.lit("2.0"))
    texts = F.create_map(F.lit("config"), config, F.lit("dataset"), dataset, F.lit("environment"), environment, F.lit("platform"), platform)
    return rows.select("id", named("run_key").alias("run_key"), texts.alias("texts"))


def identified(spark: SparkSession, d: str) -> DataFrame:
    """The runs' fields with the identities that their documents have."""
    rows = bundle_parts(spark, d)
    found = identity.run_identities(bundle_texts(rows).select(F.col("id").alias("run_key"), "texts"))
    return rows.join(found.select(F.col("folder").cast("long").alias("id"), "config_id", "environment_id", "platform_id", "run_key"), "id")


IDENTITY_SQL = """p as (select *, sha256('manifest' || workload_id) as manifest_id, sha256('package') as package_id, sha256('selection' || workload_id) as selection_id, sha256('plan' || workload_id) as plan_id,
  sha256('set' || workload_id) as support_set_id, repeat('a', 40) as revision, [x || ' "größe" \\ ' || id for x in ['2', '1', '3'][1:1 + id % 3]] as items from f_specs),
c as (select *, '{"batch_size":' || coalesce(batch_size::varchar, 'null') || ',"decoder_id":"' || decoder_id || '","logical_repeat_factor":' || logical_repeat_factor || ',"manifest_id":"' || manifest_id ||
  '","minimum_timed_seconds":' || minimum_timed_seconds::double || ',"multiprocessing_start_method":' || coalesce('"' || start_method || '"', 'null') || ',"num_workers":' || coalesce(num_workers::varchar, 'null') ||
  ',"output_contract":"normalized-rgb","package_id":"' || package_id || '","persistent_workers":' || persistent_workers::varchar || ',"prefetch_factor":' || coalesce(prefetch_factor::varchar, 'null') ||
  ',"protocol_id":"' || protocol_id || '","requested_threads":' || coalesce(requested_threads::varchar, 'null') || ',"selection_id":"' || selection_id || '","support_policy":"common","timed_passes_per_run":' || timed_passes ||
  ',"warmup_passes":' || warmup_passes || '}' as config,
  '{"dependency_group":' || to_json('group "' || nation || '"')::varchar || ',"distributions":[{"name":"a-lib","version":' || to_json(segment)::varchar || '},{"name":"lib-b-x","version":"1.0"}],"lock_sha256":"' || sha256('lock') ||
  '","native_backends":{"jpeg":' || to_json(segment)::varchar || ',"Ä":"9"},"platform_tags":["t1","t2"],"project_sha256":"' || sha256('project' || segment) || '","python":{"abi":"cp313","implementation":"cpython","version":"3.13"},"runner_revision":"' || revision || '","schema_version":"2.0"}' as environment,
  '{"identity":{"cpu_family":null,"drift":' || (nation / 1e8)::double || ',"logical_cpu_count":8,"machine_type":' || to_json(machine)::varchar || ',"share":1.0,"sockets":[1,2]},"schema_version":"2.0"}' as platform from p),
i as (select *, sha256(config) as config_id, sha256(environment) as environment_id, sha256(platform) as platform_id, sha256('{"block_position":' || block_position || ',"configuration":' || config || ',"environment_id":"' || sha256(environment) ||
  '","package_id":"' || package_id || '","plan_id":"' || plan_id || '","platform_id":"' || sha256(platform) || '","repetition":' || repetition || ',"runner_revision":"' || revision || '","schema_version":"2.0","support_item_ids":' || to_json(items)::varchar ||
  ',"support_set_id":"' || support_set_id || '","workload_id":' || to_json(workload_id)::varchar || ',"workload_manifest_id":"' || manifest_id || '"}') as run_key from c)"""


@query(f"with {IDENTITY_SQL} select id, config_id, environment_id, platform_id, run_key from i")
def run_identity(spark, d):
    return identified(spark, d).select("id", "config_id", "environment_id", "platform_id", "run_key")


@query(f"""with {IDENTITY_SQL} select run_key as key, unnest(case id % 10 when 0 then ['config-id-mismatch', 'run-key-mismatch'] when 1 then ['environment-id-mismatch', 'run-key-mismatch'] when 2 then ['platform-id-mismatch', 'run-key-mismatch']
  else ['run-key-mismatch'] end) as rule from i where id % 10 in (0, 1, 2, 4) or id % 10 = 3 and id % 3 > 0""")
def run_identity_rules(spark, d):
    """Each order's bundle keeps the identities it was made with, but half of them have one field changed since."""
    rows, at = identified(spark, d), F.col("id") % 10
    other = lambda k, c, v: F.when(at == k, v).otherwise(F.col(c)).alias(c)
    changed = {
        "minimum_timed_seconds": other(0, "minimum_timed_seconds", F.col("minimum_timed_seconds") * 2), "project": other(1, "project", F.lit("0" * 64)), "machine": other(2, "machine", F.concat("machine", F.lit("'"))),
        "items": other(3, "items", F.reverse("items")), "repetition": other(4, "repetition", F.col("repetition") + 1),
    }
    found = identity.run_identities(bundle_texts(rows.withColumns(changed), ids=True))
    return validate.run_identity_rules(found).select("key", "rule")


@query("""with s as (select run_key, count(*) as n from f_samples group by run_key), r as (select id, timed_passes, coalesce(n, 0) as n from f_specs left join s on run_key = id)
select id::varchar as key, unnest(list_filter([case when n <> timed_passes then 'sample-count-mismatch' end, case when id % 7 = 0 then 'summary-status' end, case when id % 11 = 0 then 'summary-schema' end], lambda x: x is not null)) as rule from r""")
def sample_rules(spark, d):
    s, at = view(spark, d, "f_specs"), F.col("id")
    status, version = F.when(at % 7 == 0, "partial").otherwise("complete").alias("status"), F.when(at % 11 == 0, "1.0").otherwise("2.0").alias("schema_version")
    runs = s.select(at.alias("run_key"), F.struct(F.col("timed_passes").alias("timed_passes_per_run")).alias("config"), F.struct(status, version).alias("summary"))
    return validate.sample_rules(runs, view(spark, d, "f_samples")).select("key", "rule")


@query("""with r as (select *, protocol_id = 'loader-supply' as l, coalesce(num_workers, 0) as w from f_specs)
select id::varchar as key, unnest(list_filter([case when not l and (id % 5 = 0 or id % 5 = 1 and requested_threads is not null) then 'effective-threads' end, case when l and id % 7 = 0 then 'runtime-start-method' end,
  case when l and id % 11 = 0 then 'worker-count' end, case when l and (id % 5 = 0 or id % 5 = 1 and requested_threads is not null) then 'worker-threads' end, case when l and id % 13 = 0 and id % 11 > 0 then 'worker-pid' end,
  case when l and id % 17 = 0 and (w > 1 or id % 11 = 0) then 'repeated-pid' end, case when l and id % 19 = 0 then 'worker-start-method' end, case when l and id % 23 = 0 then 'workers-not-reused' end,
  case when l and (id % 29 = 0 or w = 0 and (id % 13 = 0 and id % 11 > 0 or id % 11 = 0 and id % 17 > 0)) then 'coordinator-pid' end], lambda x: x is not null)) as rule from r""")
def runtime_rules(spark, d):
    """Reports that agree with the configurations, but for one change in each of several residues of the order."""
    s, at = view(spark, d, "f_specs"), F.col("id")
    workers = F.coalesce("num_workers", F.lit(0)).cast("int")
    method = F.when(workers == 0, "in-process").otherwise(F.col("start_method"))
    threads = F.when(at % 5 == 0, 0).when((at % 5 == 1) & F.col("requested_threads").isNotNull(), F.col("requested_threads") + 1).otherwise(F.coalesce("requested_threads", F.lit(3))).cast("int")
    n = F.greatest(workers, F.lit(1))
    own = F.when(workers == 0, F.lit(1)).otherwise(F.lit(500)).cast("long")

    def pid(k: Column) -> Column:
        same = F.when((at % 17 == 0) & (k == 2), F.lit(1)).otherwise(k)
        return F.when((at % 13 == 0) & (k == n) & (at % 11 > 0), F.lit(-1)).otherwise(same).cast("long")

    hand = lambda k: F.struct(pid(k).alias("process_id"), threads.alias("effective_threads"), F.when(at % 19 == 0, "other").otherwise(method).alias("multiprocessing_start_method"))
    hands = F.transform(F.sequence(F.lit(1), F.when(at % 11 == 0, n + 1).otherwise(n)), hand)
    if_one = F.when(at % 29 == 0, F.when(workers == 0, F.lit(77)).otherwise(F.lit(1))).otherwise(own).cast("long")
    runtime = F.struct(
        threads.alias("effective_threads"), F.when(at % 7 == 0, "other").otherwise(method).alias("multiprocessing_start_method"), if_one.alias("process_id"), (at % 23 != 0).alias("persistent_workers_reused"), hands.alias("worker_handshakes"),
    )
    config = F.struct("protocol_id", "num_workers", "requested_threads", F.col("start_method").alias("multiprocessing_start_method"))
    return validate.runtime_rules(s.select(at.alias("run_key"), config.alias("config"), runtime.alias("runtime"))).select("key", "rule")


@query("""select id::varchar as key, unnest(list_filter([case when workload_id like '5%' then 'unknown-workload' end, case when id % 9 = 0 and workload_id not like '5%' then 'item-count' end, case when id % 4 = 0 then 'output-contract' end,
  case when id % 6 = 0 and workload_id not like '5%' then 'manifest' end], lambda x: x is not null)) as rule from f_specs""")
def evidence_contract(spark, d):
    """Runs with their contract and manifest; one workload is not expected at all."""
    s, k = view(spark, d, "f_specs"), F.col("id")
    runs = s.select(k.alias("run_key"), "workload_id", F.when(k % 9 == 0, 4).otherwise(3).alias("items"), F.lit("r").alias("runner_revision"), F.lit("completed").alias("status"), F.lit(1).alias("sample_count"),
                    F.when(k % 4 == 0, F.when(k % 8 == 0, "raw")).otherwise("normalized-rgb").alias("output_contract"), F.when(k % 6 == 0, "other").otherwise(_sha("m", F.col("workload_id"))).alias("manifest_id"))
    expected = s.filter("workload_id not like '5%'").select("workload_id").distinct().select("workload_id", F.lit(3).alias("expected_items"), F.lit("r").alias("expected_revision"), _sha("m", F.col("workload_id")).alias("expected_manifest"))
    return validate.evidence_rules(runs, expected).select("key", "rule")


@query("""with c as (select p_brand as m, count(*) as n, count(distinct p_name) as d from part group by all), s as (select m, n, d, row_number() over (order by m) as r from c)
select 'sel ' || m as key, unnest(list_filter([case when r % 3 = 0 then 'item-count' end, case when r % 4 = 0 then 'unknown-method' end, case when d < n then 'repeated-items' end], lambda x: x is not null)) as rule from s
union all select 'sel none', unnest(['expected-items-not-positive'])""")
def selection_rules(spark, d):
    """A selection of the parts of each brand, and one of a manifest without items."""
    p = read(spark, d, "part").select(F.col("p_brand").alias("manifest_id"), F.col("p_name").alias("item_id"))
    per = p.groupBy("manifest_id").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.orderBy("manifest_id")))  # a row a brand
    s = per.select(_text("sel ", "manifest_id"), "manifest_id", F.when(F.col("r") % 4 != 0, "all").alias("method"), (F.col("n") + F.when(F.col("r") % 3 == 0, 1).otherwise(0)).alias("expected_items")).toDF("selection_id", "manifest_id", "method", "expected_items")
    none = spark.createDataFrame([("sel none", "none", "all", 0)], "selection_id string, manifest_id string, method string, expected_items long")
    return validate.selection_rules(s.unionByName(none), p).select("key", "rule")


@query("""with d as (select c_custkey as id, 'edge' as kind, case when c_custkey % 5 = 0 then 70000 when c_custkey % 5 = 1 then null else 100 + c_custkey end as value from customer where c_custkey % 7 > 0 union all select c_custkey, 'quality', case when c_custkey % 6 = 0 then 96 else 50 end from customer
  union all select c_custkey, 'quality', 50 from customer where c_custkey % 9 = 0 union all select c_custkey, 'limit', case when c_custkey % 8 = 0 then 0 else 9 end from customer)
select id || '/' || coalesce(value::varchar, '') as key, case kind when 'edge' then 'edge-out-of-range' when 'quality' then 'quality-out-of-range' else 'limit-not-positive' end as rule from d where kind = 'edge' and value > 65535 or kind = 'quality' and value > 95 or kind = 'limit' and value = 0
union all select id || '/' || coalesce(value::varchar, ''), 'repeated-' || kind from d where kind <> 'limit' group by id, kind, value having count(*) > 1 union all select c_custkey::varchar, 'no-level' from customer where c_custkey % 7 = 0
union all select o_custkey || '/' || o_orderpriority, 'repeated-source' from orders group by o_custkey, o_orderpriority having count(*) > 1""")
def design_rules(spark, d):
    """A design of each customer, whose orders are its sources."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    part = lambda kind, value: c.select(k.alias("design_id"), F.lit(kind).alias("kind"), value.cast("long").alias("value"))
    edge = part("edge", F.when(k % 5 == 0, F.lit(70000)).when(k % 5 != 1, 100 + k)).filter("design_id % 7 > 0")
    quality = part("quality", F.when(k % 6 == 0, 96).otherwise(50)).unionByName(part("quality", F.lit(50)).filter("design_id % 9 = 0"))
    sources = read(spark, d, "orders").select(F.col("o_custkey").alias("design_id"), F.col("o_orderpriority").alias("relative_path"), F.sha2("o_orderpriority", 256).alias("sha256"))
    return validate.design_rules(edge.unionByName(quality).unionByName(part("limit", F.when(k % 8 == 0, 0).otherwise(9))), sources).select("key", "rule")


@query("""with e as (select plan_id, workload_id, r.r from (select distinct plan_id, workload_id from f_runs) cross join range(0, 40000, 7) r(r)), o as (select plan_id, workload_id, run_key % 40000 // 7 * 7 as r from f_runs union all select plan_id, workload_id, 1 from f_runs where run_key % 500 = 3 and workload_id = 'mixed'),
d as (select plan_id, workload_id, r, count(*) as n from o group by all),
j as (select coalesce(e.plan_id, d.plan_id) as plan_id, coalesce(e.workload_id, d.workload_id) as workload_id, case when d.r is null then 1 else 0 end as m, case when e.r is null then 1 else 0 end as x, coalesce(n - 1, 0) as t
  from e full join d on e.plan_id = d.plan_id and e.workload_id = d.workload_id and e.r = d.r)
select plan_id, workload_id, sum(m)::bigint as missing, sum(x)::bigint as extra, sum(t)::bigint as repeated from j group by all having sum(m) + sum(x) + sum(t) > 0""")
def set_gaps(spark, d):
    """Each plan and workload should have every seventh number up to 40,000; the runs bring some of them, often twice, and a few others."""
    runs = view(spark, d, "f_runs")
    expected = runs.select("plan_id", "workload_id").distinct().crossJoin(F.broadcast(spark.range(0, 40000, 7).withColumnRenamed("id", "r")))
    other = runs.filter("run_key % 500 = 3 and workload_id = 'mixed'").select("plan_id", "workload_id", F.lit(1).cast("long").alias("r"))
    observed = runs.select("plan_id", "workload_id", F.expr("run_key % 40000 div 7 * 7").alias("r")).unionByName(other)
    return decisions.set_gaps(expected, observed, ["plan_id", "workload_id"], "r")


# ---- streams ------------------------------------------------------------------------------------


@query("""select o_orderpriority as plan_id, o_custkey % 3 as cell, count(*) as n, round(avg(o_totalprice), 3) as mean, round(stddev_samp(o_totalprice), 3) as sample_std, min(o_totalprice) as least, max(o_totalprice) as largest
from orders where o_orderstatus = 'F' group by all""")
def stream_cell_statistics(spark, d):
    """Orders arrive in four files, one a batch, and the first file's rows once more in a fifth."""
    source, target, checkpoint, kept = (shared_folder(spark, n) for n in ("orders", "runs", "stream", "cells"))
    orders = read(spark, d, "orders").withColumn("cell", F.col("o_custkey") % 3)
    orders.repartition(4, "o_orderkey").write.parquet(source)
    orders.filter("o_orderkey % 4 = 0").coalesce(1).write.mode("append").parquet(source)
    cells = streams.Cells(kept, ["o_orderpriority", "cell"], "o_totalprice")
    streams.stream_committed_runs(spark, source, orders.schema, target, checkpoint, "o_orderstatus = 'F'", "o_orderkey", 1, cells).awaitTermination()
    found = streams.read_cells(spark, cells)
    return found.select(F.col("o_orderpriority").alias("plan_id"), "cell", "n", F.round("mean", 3).alias("mean"), F.round("sample_std", 3).alias("sample_std"), "least", "largest")


@query("""with a as (select run_key, attempt_id, status, case when run_key % 3 = 0 then finished_at + interval 400 year else finished_at end as t from f_attempts)
select run_key, arg_max(status, (t, attempt_id)) as status, count(*) as attempts, run_key % 3 <> 0 as stale from a group by run_key""")
def stream_stale_runs(spark, d):
    """Runs fell silent long ago, but for every third, whose times lie far ahead; timers flag the others."""
    path = f"{d}/events.parque[t]"
    target, checkpoint = shared_folder(spark, "status"), shared_folder(spark, "stream")
    ahead = F.when(F.col("user_id") % 3 == 0, F.col("ts") + F.make_ym_interval(years=F.lit(400))).otherwise(F.col("ts"))
    rename = lambda df: df.select(F.col("user_id").alias("run_key"), F.col("event_id").alias("attempt_id"), F.col("event_type").alias("status"), ahead.alias("finished_at"))
    streams.stream_attempt_status(spark, path, spark.read.parquet(path).schema, target, checkpoint, rename, timeout_seconds=3600).awaitTermination()
    return streams.current_status(spark, target).drop("updated_at")
