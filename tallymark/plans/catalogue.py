"""The registered queries over the provided tables and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.functions import columns as X
from tallymark.functions import digests
from tallymark.operators import catalog, decisions, matrix, metrics, profiles, publish, support, validate
from tallymark.plans import registered
from tallymark.plans.fixtures import read, view
from tallymark.plans.registered import Query, query
from tallymark.sources import images as image_scans
from tallymark.sources.sinks import materialize, shared_folder
from tallymark.streaming import runs as streams

AGG_KEYS = ["workload", "machine_type", "protocol", "decoder", "requested_threads", "workers"]
CONTROLS = [("dec-05", 1), ("dec-07", 1), ("dec-10", 1)]
GRID = [0, 2, 4, 8, 12]


def queries() -> dict[str, Query]:
    from tallymark.plans import evidence_queries, tree_queries  # noqa: F401  they register their own

    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(registered.SQL)


# ---- shared plans -------------------------------------------------------------------------------


def controls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTROLS, "decoder string, requested_threads int")


def blocks(m: DataFrame) -> DataFrame:
    """Mean of each cell and repetition."""
    return m.groupBy(*AGG_KEYS, "repetition").agg(F.avg("images_per_second").alias("v"))


def cells(b: DataFrame) -> DataFrame:
    """Mean of each cell over its repetitions' means, to the digits that ties are decided on."""
    return b.groupBy(*AGG_KEYS).agg(metrics.rounded(F.avg("v")).alias("mean"))


def controlled_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(decisions.controlled_threads(view(spark, d, "f_measurements"), controls(spark)))


CONTROLLED = """controlled as (select m.* from f_measurements m left join (values ('dec-05', 1), ('dec-07', 1), ('dec-10', 1)) c(decoder, t) on m.decoder = c.decoder
  where m.requested_threads is not distinct from c.t),
blocks as (select workload, machine_type, protocol, decoder, requested_threads, workers, repetition, avg(images_per_second) as v from controlled group by all),
agg as (select workload, machine_type, protocol, decoder, requested_threads, workers, round(avg(v), 6) as mean from blocks group by all)"""
ALL_BLOCKS = """blocks as (select workload, machine_type, protocol, decoder, requested_threads, workers, repetition, avg(images_per_second) as v from f_measurements group by all),
agg as (select workload, machine_type, protocol, decoder, requested_threads, workers, round(avg(v), 6) as mean from blocks group by all)"""
LABEL = "decoder || '[threads=' || coalesce(cast(requested_threads as varchar), 'default') || ']'"
BEST = f"order by mean desc, {LABEL}, case when coalesce(workers, 0) = 0 then -1 else workers end"
PEAK = f"peak as (select * from agg where protocol = 'loader-supply' qualify row_number() over (partition by workload, machine_type, decoder {BEST}) = 1)"
DIRECT = f"direct as (select * from agg where protocol = 'decode-memory' qualify row_number() over (partition by workload, machine_type, decoder {BEST}) = 1)"


# ---- metrics ------------------------------------------------------------------------------------


@query("""select decoder, protocol, count(*) as n, round(avg(images_per_second), 6) as mean, round(median(images_per_second), 6) as median, min(images_per_second) as minimum,
  max(images_per_second) as maximum, round(stddev_samp(images_per_second), 6) as sample_std, round(stddev_samp(images_per_second) / avg(images_per_second), 6) as coefficient_of_variation
from f_measurements group by decoder, protocol""")
def summarize_distribution(spark, d):
    return metrics.summarize_distribution(view(spark, d, "f_measurements"), ["decoder", "protocol"], "images_per_second")


@query("""with s as (select run_key, 'images_per_second' as statistic, items_processed / elapsed_seconds as v from f_samples union all select run_key, 'elapsed_seconds', elapsed_seconds from f_samples
  union all select run_key, 'microseconds_per_image', elapsed_seconds * 1e6 / items_processed from f_samples)
select run_key, statistic, count(*) as n, round(avg(v), 6) as mean, round(median(v), 6) as median, min(v)::double as minimum, max(v)::double as maximum, round(stddev_samp(v), 6) as sample_std,
  round(stddev_samp(v) / avg(v), 6) as coefficient_of_variation from s group by run_key, statistic""")
def summarize_benchmark(spark, d):
    return metrics.summarize_benchmark(view(spark, d, "f_samples"))


@query("select run_key, round(avg(items_processed / elapsed_seconds), 6) as run_mean from f_samples group by run_key")
def run_mean(spark, d):
    return metrics.run_mean(view(spark, d, "f_samples"), "images_per_second").withColumn("run_mean", metrics.rounded(F.col("run_mean")))


GROUPS = ["plan_id", "config_id", "workload_id", "comparison_platform"]


@query("""with m as (select run_key, avg(items_processed / elapsed_seconds) as v from f_samples group by run_key),
g as (select plan_id, config_id, workload_id, left(machine_type, 8) as comparison_platform, count(*) as n, round(avg(v), 6) as mean, round(median(v), 6) as median, round(stddev_samp(v), 6) as sample_std,
  list(run_key order by run_key) as keys, list(distinct machine_type order by machine_type) as p, list(distinct location order by location) filter (where location <> '') as l
  from f_runs join m using (run_key) group by all)
select plan_id, config_id, workload_id, comparison_platform, n, mean, median, sample_std, sha256(array_to_string(keys, ',')) as run_keys_digest, array_to_string(p, ',') as platform_ids,
  coalesce(array_to_string(l, ','), '') as platform_locations from g""")
def group_runs(spark, d):
    runs = view(spark, d, "f_runs").withColumns({"comparison_platform": F.substring("machine_type", 1, 8), "platform_id": F.col("machine_type"), "location": X.non_empty(F.col("location")), "repetition": F.col("run_key")})
    members = metrics.group_members(runs, view(spark, d, "f_samples"), GROUPS, "images_per_second")
    named = digests.joined_digest(members, GROUPS, ["repetition", "run_key"], "run_key", "run_keys_digest").drop("n")
    out = metrics.by_keys(metrics.group_statistics(members, GROUPS), named, GROUPS)
    flat = lambda c: F.concat_ws(",", c)
    return out.select(*GROUPS, "n", "mean", "median", "sample_std", "run_keys_digest", flat("platform_ids").alias("platform_ids"), flat("platform_locations").alias("platform_locations"))


@query("""select r.run_key, plan_id, workload_id, count(*) as n, round(avg(elapsed_seconds), 6) as mean, round(stddev_samp(elapsed_seconds), 6) as sample_std,
  sha256(array_to_string(list(cast((elapsed_seconds * 10)::bigint as varchar) order by sample_index), ',')) as raw_digest
from f_runs r join f_samples s on r.run_key = s.run_key group by all""")
def result_rows(spark, d):
    out = metrics.result_rows(view(spark, d, "f_runs").select("run_key", "plan_id", "workload_id"), view(spark, d, "f_samples"), "elapsed_seconds")
    raw = F.transform("raw_values", lambda v: F.round(v * 10).cast("long").cast("string"))
    return out.select("run_key", "plan_id", "workload_id", "n", "mean", "sample_std", F.sha2(F.concat_ws(",", raw), 256).alias("raw_digest"))


@query("""with b as (select workload, machine_type, protocol, decoder, requested_threads, workers, repetition, avg(images_per_second) as v from f_measurements group by all)
select workload, machine_type, protocol, decoder, requested_threads, workers, count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sample_std,
  array_to_string(list(repetition order by repetition), ',') as repetitions, array_to_string(list(repetition order by repetition), ',') = '0,1,2,3,4' as complete
from b group by all""")
def aggregate_measurements(spark, d):
    out = metrics.aggregate_measurements(view(spark, d, "f_measurements"), AGG_KEYS, range(5))
    return out.select(*AGG_KEYS, "n", "mean", "sample_std", F.concat_ws(",", F.col("repetitions").cast("array<string>")).alias("repetitions"), "complete")


@query("""with long as (select workload_id, 'compressed_bytes' as metric, compressed_bytes::double as v from f_items union all select workload_id, 'width', width::double from f_items
  union all select workload_id, 'height', height::double from f_items)
select workload_id, metric, min(v) as minimum, round(quantile_cont(v, 0.1), 6) as q10, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.9), 6) as q90, max(v) as maximum from long group by all""")
def distribution_quantiles(spark, d):
    return metrics.distribution_quantiles(view(spark, d, "f_items"), ["workload_id"], ["compressed_bytes", "width", "height"])


@query("select workload, workers, count(*) as n from f_measurements group by all")
def value_counts(spark, d):
    return metrics.value_counts(view(spark, d, "f_measurements"), ["workload"], "workers")


@query("select workload_id, count(*) as items, sum(compressed_bytes)::bigint as total_bytes, max(coalesce(width, 0) * coalesce(height, 0) * 3)::bigint as max_decoded_bytes, count(distinct components) as distinct_components, count(distinct luma_sum) as distinct_luma_sum from f_items group by all")
def byte_totals(spark, d):
    return metrics.byte_totals(view(spark, d, "f_items"), ["workload_id"], ["components", "luma_sum"])


@query("""select workload, machine_type, protocol, decoder, images_per_second, repetition,
  round(row_number() over (partition by workload, machine_type, protocol, decoder order by images_per_second, repetition) / count(*) over (partition by workload, machine_type, protocol, decoder), 9) as fraction from f_measurements""")
def ecdf(spark, d):
    keys = ["workload", "machine_type", "protocol", "decoder"]
    m = view(spark, d, "f_measurements").select(*keys, "images_per_second", "repetition")
    return metrics.ecdf(m, keys, "images_per_second", ["repetition"]).withColumn("fraction", F.round("fraction", 9))


@query(f"""with {CONTROLLED}, f as (select *, first_value(v) over (partition by workload, machine_type, decoder, repetition order by workers) as base from blocks where protocol = 'loader-supply' and workers is not null)
select workload, machine_type, decoder, workers, round(avg(v / base), 6) as mean_ratio, count(*) as blocks from f group by all""")
def relative_to_first(spark, d):
    return metrics.relative_to_first(controlled_blocks(spark, d).filter("protocol = 'loader-supply'"), ["workload", "machine_type", "decoder"])


@query("""with x as (select run_key, raw_index, row_number() over (partition by run_key order by raw_index) - 1 as expected from f_samples)
select run_key, count(*) filter (where raw_index is distinct from expected) as misplaced, count(*) as n from x group by run_key having misplaced > 0""")
def consecutive_index(spark, d):
    return metrics.consecutive_index(view(spark, d, "f_samples"), "raw_index")


EVENT_NAMES = ["click", "purchase", "view"]


@query("""select run_key, round(sum(duration_seconds) filter (where status = 'click'), 6) as click_seconds, count(*) filter (where status = 'click') as click_n,
  round(sum(duration_seconds) filter (where status = 'purchase'), 6) as purchase_seconds, count(*) filter (where status = 'purchase') as purchase_n,
  round(sum(duration_seconds) filter (where status = 'view'), 6) as view_seconds, count(*) filter (where status = 'view') as view_n from f_attempts group by run_key""")
def phase_durations(spark, d):
    events = view(spark, d, "f_attempts").withColumnRenamed("status", "event")
    return metrics.phase_durations(events, EVENT_NAMES)


@query("with x as (select run_key, items_processed + case when run_key % 7 = 0 then raw_index % 2 else 0 end as i from f_samples) select cast(run_key as varchar) as key, 'mixed-item-counts' as rule, min(i)::varchar || '..' || max(i)::varchar as detail from x group by run_key having min(i) <> max(i)")
def mixed_item_counts(spark, d):
    s = view(spark, d, "f_samples")
    return metrics.mixed_item_counts(s.withColumn("items_processed", F.col("items_processed") + F.when(F.col("run_key") % 7 == 0, F.col("raw_index") % 2).otherwise(0)))


# ---- decisions ----------------------------------------------------------------------------------


@query(f"with {ALL_BLOCKS} select workload, machine_type, protocol, decoder, requested_threads, workers, mean from agg qualify row_number() over (partition by workload, machine_type, protocol {BEST}) = 1")
def best_config(spark, d):
    return decisions.best(cells(blocks(view(spark, d, "f_measurements"))), ["workload", "machine_type", "protocol"])


@query(f"with {ALL_BLOCKS} select workload, machine_type, protocol, decoder, requested_threads, workers, mean, rank() over (partition by workload, machine_type, protocol order by mean desc) + (count(*) over (partition by workload, machine_type, protocol, mean) - 1) / 2 as rank from agg")
def average_rank(spark, d):
    return decisions.average_rank(cells(blocks(view(spark, d, "f_measurements"))), ["workload", "machine_type", "protocol"], "mean")


@query(f"""with {CONTROLLED}, {PEAK}, {DIRECT}, a as (select *, rank() over (partition by workload, machine_type order by mean desc) + (count(*) over (partition by workload, machine_type, mean) - 1) / 2 as r from direct),
b as (select *, rank() over (partition by workload, machine_type order by mean desc) + (count(*) over (partition by workload, machine_type, mean) - 1) / 2 as r from peak)
select workload, machine_type, round(corr(a.r, b.r), 6) as rho, count(*) as items from a join b using (workload, machine_type, decoder) group by all""")
def rank_correlation(spark, d):
    agg = cells(controlled_blocks(spark, d))
    keys = ["workload", "machine_type"]
    a = decisions.best(agg.filter("protocol = 'decode-memory'"), [*keys, "decoder"])
    b = decisions.best(agg.filter("protocol = 'loader-supply'"), [*keys, "decoder"])
    return decisions.rank_correlation(a, b, keys, "decoder", "mean")


@query(f"""with {CONTROLLED}, {PEAK}, t as (select *, max(mean) over (partition by workload, machine_type) as top from peak)
select workload, machine_type, decoder, workers, mean, row_number() over (partition by workload, machine_type order by mean desc, {LABEL}) as place from t where mean >= top * (1 - 0.1)""")
def top_tier(spark, d):
    peak = decisions.best(cells(controlled_blocks(spark, d)).filter("protocol = 'loader-supply'"), ["workload", "machine_type", "decoder"])
    return decisions.top_tier(peak, ["workload", "machine_type"]).select("workload", "machine_type", "decoder", "workers", "mean", "place")


@query(f"""with {CONTROLLED}, {PEAK}, {DIRECT},
l as (select * from direct qualify row_number() over (partition by workload, machine_type {BEST}) = 1),
w as (select * from peak qualify row_number() over (partition by workload, machine_type {BEST}) = 1),
rows as (select l.workload, l.machine_type, l.decoder as dl, l.mean as dm, w.decoder as wl, w.mean as wm, w.workers as ww, w.requested_threads as wt, c.mean as cm, c.workers as cw, c.requested_threads as ct
  from l join w using (workload, machine_type) join peak c on c.workload = l.workload and c.machine_type = l.machine_type and c.decoder = l.decoder),
ld as (select * from blocks where protocol = 'loader-supply'),
reg as (select r.workload, r.machine_type, round(max((1 - a.v / b.v) * 100), 6) as worst, count(*) as n from rows r
  join ld a on a.workload = r.workload and a.machine_type = r.machine_type and a.decoder = r.dl and a.workers is not distinct from r.cw and a.requested_threads is not distinct from r.ct
  join ld b on b.workload = r.workload and b.machine_type = r.machine_type and b.decoder = r.wl and b.workers is not distinct from r.ww and b.requested_threads is not distinct from r.wt and a.repetition = b.repetition group by all),
ra as (select *, rank() over (partition by workload, machine_type order by mean desc) + (count(*) over (partition by workload, machine_type, mean) - 1) / 2 as r from direct),
rb as (select *, rank() over (partition by workload, machine_type order by mean desc) + (count(*) over (partition by workload, machine_type, mean) - 1) / 2 as r from peak),
rho as (select workload, machine_type, round(corr(ra.r, rb.r), 6) as rho from ra join rb using (workload, machine_type, decoder) group by all),
tt as (select *, max(mean) over (partition by workload, machine_type) as top from peak),
tier as (select workload, machine_type, array_to_string(list(decoder order by mean desc, {LABEL}), ',') as top_tier from tt where mean >= top * (1 - 0.1) group by all)
select workload, machine_type, dl as decode_leader, dm as decode_leader_mean, wl as loader_leader, wm as loader_leader_mean, ww as loader_leader_workers, cw as selected_workers,
  round((1 - cm / wm) * 100, 6) as regret_percent, worst as worst_block_regret_percent, n as paired_blocks, rho as rank_correlation, dl = wl as leaders_match, top_tier
from rows left join reg using (workload, machine_type) left join rho using (workload, machine_type) join tier using (workload, machine_type)""")
def decision_rows(spark, d):
    b = materialize(controlled_blocks(spark, d), "blocks")  # a row per cell and repetition, read eight times
    return decisions.decision_rows(cells(b), b).withColumn("top_tier", F.concat_ws(",", "top_tier"))


@query(f"""with {CONTROLLED}, a as (select workload, machine_type, decoder, repetition, v from blocks where protocol = 'loader-supply' and workers = 8), b as (select workload, machine_type, decoder, repetition, v from blocks where protocol = 'loader-supply' and workers = 4)
select workload, machine_type, decoder, repetition, round(a.v / b.v, 6) as ratio, a.v is null or b.v is null as unpaired from a full join b using (workload, machine_type, decoder, repetition)""")
def paired_ratio(spark, d):
    b = controlled_blocks(spark, d).filter("protocol = 'loader-supply'")
    return decisions.paired_ratio(b, F.col("workers") == 8, F.col("workers") == 4, ["workload", "machine_type", "decoder"])


@query(f"""with {ALL_BLOCKS}, p as (select workload, machine_type, decoder, max(mean) filter (where protocol = 'decode-memory' and requested_threads is null) as dd, max(mean) filter (where protocol = 'decode-memory' and requested_threads = 1) as d1,
  max(mean) filter (where protocol = 'loader-supply' and requested_threads is null and workers in (0, 2, 4, 8)) as ld, max(mean) filter (where protocol = 'loader-supply' and requested_threads = 1 and workers in (0, 2, 4, 8)) as l1
  from agg where decoder in ('dec-05', 'dec-07', 'dec-10') group by all)
select workload, machine_type, decoder, round((dd / d1 - 1) * 100, 6) as decode_default_vs_one_percent, round((ld / l1 - 1) * 100, 6) as loader_default_vs_one_percent from p""")
def thread_contrast(spark, d):
    return decisions.thread_contrast(cells(blocks(view(spark, d, "f_measurements"))), [c for c, _ in CONTROLS], [0, 2, 4, 8])


@query(f"""with {CONTROLLED}, {PEAK}, b as (select machine_type, decoder, max(workers) filter (where workload = 'native') as n, max(workers) filter (where workload = 'mixed') as m from peak group by all)
select machine_type, coalesce(array_to_string(list(decoder order by decoder) filter (where n is distinct from m), ','), '') as changed_decoders, count(*) as decoders from b group by all""")
def worker_transfer(spark, d):
    return decisions.worker_transfer(cells(controlled_blocks(spark, d))).withColumn("changed_decoders", F.concat_ws(",", "changed_decoders"))


@query(f"with {CONTROLLED}, {PEAK} select workload, machine_type, workers, count(*) as decoders from peak group by all")
def peak_workers(spark, d):
    return decisions.peak_workers(cells(controlled_blocks(spark, d)))


@query(f"""with {CONTROLLED}, c as (select distinct workload, machine_type, decoder from f_measurements),
p as (select workload, machine_type, decoder, repetition, max(v) filter (where workers = 12) as h, max(v) filter (where workers = 8) as l, count(distinct workers) as points from blocks where protocol = 'loader-supply' group by all),
s as (select workload, machine_type, decoder, avg(h) / avg(l) - 1 as gain, min(h / l) as least, min(points) as points, count(*) as blocks from p group by all)
select workload, machine_type, decoder, round(gain * 100, 6) as gain_percent, round(least, 6) as minimum_ratio, coalesce(blocks, 0) as blocks, coalesce(points = 5, false) as complete, coalesce(points = 5 and gain >= 0.05 and least >= 1, false) as selected
from c left join s using (workload, machine_type, decoder)""")
def followup_candidates(spark, d):
    b = controlled_blocks(spark, d)
    return decisions.followup_candidates(b, view(spark, d, "f_measurements").select("workload", "machine_type", "decoder").distinct(), GRID)


@query(f"""with {CONTROLLED}, peak as (select * from agg where protocol = 'loader-supply' and workers in (0, 2) qualify row_number() over (partition by workload, machine_type, decoder {BEST}) = 1)
select workload, machine_type, decoder, workers, mean from peak where workers = 2""")
def boundary_peaks(spark, d):
    """Over the grid of no and two workers, where many curves still rise."""
    return decisions.boundary_peaks(cells(controlled_blocks(spark, d)), GRID[:2])


@query(f"""with {CONTROLLED}, c as (select distinct workload, machine_type, decoder from f_measurements),
p as (select workload, machine_type, decoder, repetition, max(v) filter (where workers = 2) as h, max(v) filter (where workers = 0) as l, count(distinct workers) filter (where workers in (0, 2)) as points from blocks where protocol = 'loader-supply' group by all),
s as (select workload, machine_type, decoder, avg(h) / avg(l) - 1 as gain, min(h / l) as least, min(points) as points, count(*) as blocks from p group by all)
select count(*) filter (where gain >= 0.05 and least >= 1 and points = 2) as candidate_count, coalesce(sum(blocks) filter (where gain >= 0.05 and least >= 1 and points = 2), 0)::bigint as bundle_count_if_launched
from c left join s using (workload, machine_type, decoder)""")
def followup_totals(spark, d):
    b = controlled_blocks(spark, d)
    c = view(spark, d, "f_measurements").select("workload", "machine_type", "decoder").distinct()
    return decisions.followup_totals(decisions.followup_candidates(b, c, GRID[:2], high=2, low=0))


@query("with c as (select m.* from f_measurements m left join (values ('dec-05', 1), ('dec-07', 1), ('dec-10', 1)) c(decoder, t) on m.decoder = c.decoder where m.requested_threads is not distinct from c.t) select decoder, requested_threads, count(*) as n from c group by all")
def controlled_threads(spark, d):
    return decisions.controlled_threads(view(spark, d, "f_measurements"), controls(spark)).groupBy("decoder", "requested_threads").agg(F.count("*").alias("n"))


@query("select run_key, plan_id, case plan_id when '1-URGENT' then 'native' else 'mixed' end as workload from f_runs where plan_id in ('1-URGENT', '2-HIGH')")
def in_plans(spark, d):
    plans = spark.createDataFrame([("1-URGENT", "native"), ("2-HIGH", "mixed")], "plan_id string, workload string")
    return decisions.in_plans(view(spark, d, "f_runs"), plans).select("run_key", "plan_id", "workload")


@query("""with e as (select distinct decoder, machine_type, 5 as n from f_measurements), r as (select distinct decoder, machine_type, repetition, workload from f_measurements), o as (select decoder, machine_type, count(*) as n from r group by all)
select decoder, machine_type, coalesce(e.n, 0)::bigint as expected, coalesce(o.n, 0) as observed from e full join o using (decoder, machine_type) where coalesce(e.n, 0) <> coalesce(o.n, 0)""")
def matrix_gaps(spark, d):
    m = view(spark, d, "f_measurements")
    keys = ["decoder", "machine_type"]
    return decisions.matrix_gaps(m.select(*keys).distinct().withColumn("n", F.lit(5)), m.select(*keys, "repetition", "workload").distinct(), keys)


@query("select decoder, requested_threads, workers, repetition, workload, machine_type, count(*) as n from f_measurements where not (machine_type = 'platform-0' and workload = 'native' and requested_threads is null or machine_type = 'platform-1' and workload = 'mixed' and requested_threads is not distinct from 1) group by all")
def scope_check(spark, d):
    scopes = spark.createDataFrame([("platform-0", "native", None), ("platform-1", "mixed", 1)], "machine_type string, workload string, requested_threads int")
    out = decisions.scope_check(view(spark, d, "f_measurements"), scopes, ["machine_type", "workload", "requested_threads"])
    return out.groupBy("decoder", "requested_threads", "workers", "repetition", "workload", "machine_type").agg(F.count("*").alias("n"))


# ---- catalogues ---------------------------------------------------------------------------------


@query("select device_id, cast(scene_day as varchar) as scene_day from f_catalog where provenance in (select distinct provenance from f_catalog) group by all having count(distinct provenance) = (select count(distinct provenance) from f_catalog)")
def complete_groups(spark, d):
    return catalog.complete_groups(view(spark, d, "f_catalog"), ["device_id", "scene_day"], ["provenance"]).withColumn("scene_day", F.col("scene_day").cast("string"))


@query("select device_id, sha256('scene' || chr(0) || '20260729' || chr(0) || cast(device_id as varchar)) as key from (select distinct device_id from f_catalog) order by key, device_id limit 12")
def select_top_hashed(spark, d):
    return catalog.select_top_hashed(view(spark, d, "f_catalog"), "device_id", 12, 20260729, "scene")


@query("select workload_id, doc_id, row_number() over (partition by workload_id order by sha256('item' || chr(0) || '7' || chr(0) || workload_id || chr(0) || cast(doc_id as varchar)), doc_id) - 1 as position from f_items")
def seeded_order(spark, d):
    return catalog.seeded_order(view(spark, d, "f_items").select("workload_id", "doc_id"), ["workload_id"], "doc_id", 7, "item")


@query("""with r as (select workload_id, doc_id, compressed_bytes, sum(compressed_bytes) over (partition by workload_id order by doc_id rows unbounded preceding)::bigint as running_bytes from f_items)
select * from r where running_bytes > 100000 qualify row_number() over (partition by workload_id order by doc_id) = 1""")
def byte_budget(spark, d):
    return catalog.byte_budget(view(spark, d, "f_items").select("workload_id", "doc_id", "compressed_bytes"), ["workload_id"], ["doc_id"], "compressed_bytes", 100000)


@query("""with t as (select unnest([16,11,10,16,24,40,51,61,12,12,14,19,26,58,60,55,14,13,16,24,40,57,69,56,14,17,22,29,51,87,80,62,18,22,37,56,68,109,103,77,24,35,55,64,81,104,113,92,49,64,78,87,103,121,120,101,72,92,95,98,112,100,103,99]) as v),
q as (select q, case when q < 50 then 5000 // q else 200 - 2 * q end as s from range(1, 101) r(q)), ref as (select q, sum(least(255, greatest(1, (v * s + 50) // 100))) as total from q, t group by q),
n as (select luma_sum, arg_min(q, {'a': abs(total - luma_sum), 'b': q}) as quality from (select distinct luma_sum from f_items), ref group by luma_sum)
select doc_id, luma_sum, quality::int as quality_estimate from f_items join n using (luma_sum)""")
def nearest_quality(spark, d):
    return catalog.nearest_quality(view(spark, d, "f_items").select("doc_id", "luma_sum"), "luma_sum")


@query("select sha256(content) as digest, arg_min(relative_path, {'a': workload_id, 'b': doc_id}) as path, count(*) as logical_items from f_items where content is not null group by 1")
def dedup_blobs(spark, d):
    items = view(spark, d, "f_items").filter("content is not null").withColumn("digest", F.sha2("content", 256))
    return catalog.dedup_blobs(items, "digest", ["workload_id", "doc_id"], "relative_path")


@query("select provenance, 'native' as workload, count(*) as n from f_catalog where provenance = 'view' group by all union all select provenance, 'mixed', count(*) from f_catalog group by all")
def native_view(spark, d):
    return catalog.native_view(view(spark, d, "f_catalog"), "view").groupBy("provenance", "workload").agg(F.count("*").alias("n"))


@query("select device_id, cast(scene_day as varchar) as scene_day, provenance, count(*) as n from f_catalog group by all having count(*) > 1")
def repeated_members(spark, d):
    return validate.duplicates(view(spark, d, "f_catalog"), ["device_id", "scene_day", "provenance"]).withColumn("scene_day", F.col("scene_day").cast("string"))


@query("""select doc_id, sha256(relative_path || chr(0) || sha256(content)) as item_id, round(width * height / 1e6, 9) as megapixels, round(compressed_bytes * 8 / (width * height), 9) as bits_per_pixel,
  case when components = 1 then 'grayscale' when h = 1 and v = 1 then '4:4:4' when h = 2 and v = 1 then '4:2:2' when h = 2 and v = 2 then '4:2:0' else 'other' end as subsampling,
  greatest(1, (height * 48 + width // 2) // width)::bigint as short_edge, 'controlled-le' || lpad((width % 9000)::varchar, 4, '0') || '-q' || lpad((doc_id % 100)::varchar, 3, '0') as workload_name from f_items where content is not null""")
def item_identity(spark, d):
    c = F.col
    i = view(spark, d, "f_items").filter("content is not null")
    return i.select(
        "doc_id", X.item_id(c("relative_path"), F.sha2("content", 256)).alias("item_id"), F.round(X.megapixels(c("width"), c("height")), 9).alias("megapixels"),
        F.round(X.bits_per_pixel(c("compressed_bytes"), c("width"), c("height")), 9).alias("bits_per_pixel"), X.subsampling_label(c("components"), c("h"), c("v")).alias("subsampling"),
        X.scaled_short_edge(c("width"), c("height"), F.lit(48)).alias("short_edge"), X.workload_name((c("width") % 9000).cast("int"), (c("doc_id") % 100).cast("int")).alias("workload_name"),
    )


# ---- support ------------------------------------------------------------------------------------


@query("select doc_id from f_audits where ok group by doc_id having count(distinct decoder) = (select count(distinct decoder) from f_audits)")
def support_intersection(spark, d):
    return support.support_intersection(view(spark, d, "f_audits"), "decoder", "doc_id")


@query("""with n as (select process_context, count(distinct decoder) as n from f_audits group by all), s as (select process_context, doc_id, count(distinct decoder) as k from f_audits where ok group by all)
select process_context, doc_id, row_number() over (partition by process_context order by doc_id desc) - 1 as ordinal from s join n using (process_context) where k = n""")
def common_support(spark, d):
    a = view(spark, d, "f_audits")
    found = support.support_intersection(a, "decoder", "doc_id", ["process_context"])
    selection = read(spark, d, "documents").select("doc_id", (-F.col("doc_id")).alias("ordinal"))
    return support.ordered_support(found, selection, "doc_id", ["process_context"])


@query("select decoder, count(distinct doc_id) as items from f_audits where ok group by all")
def operational_support(spark, d):
    return support.operational_support(view(spark, d, "f_audits"), "decoder", "doc_id").groupBy("decoder").agg(F.count("*").alias("items"))


@query("""select decoder, 'c' || (doc_id % 3)::varchar as category, count(*) filter (where ok) as accepted, count(*) as total from f_audits group by all
union all select decoder, 'combined', count(*) filter (where ok), count(*) from f_audits group by all""")
def coverage_by_category(spark, d):
    a = view(spark, d, "f_audits").withColumn("category", F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")))
    return support.coverage_by_category(a)


def run_configs(spark: SparkSession, d: str) -> DataFrame:
    """Run configurations with the fields that orders stand for."""
    r = view(spark, d, "f_runs").select("config_id", "protocol_id", F.col("num_workers").cast("int").alias("num_workers")).distinct()
    return r.select("config_id", "protocol_id", "num_workers", F.when(F.col("num_workers") > 0, "spawn").alias("start_method"), F.concat(F.lit("dec-"), F.lpad((F.col("config_id") % 12).cast("string"), 2, "0")).alias("decoder"))


CONFIGS = """configs as (select distinct config_id, protocol_id, num_workers::int as num_workers, case when num_workers > 0 then 'spawn' end as start_method, 'dec-' || lpad((config_id % 12)::varchar, 2, '0') as decoder from f_runs),
ctx as (select *, case when protocol_id = 'loader-supply' and coalesce(num_workers, 0) > 0 then 'dataloader' else 'main-process' end as process_context from configs)"""


@query(f"""with {CONFIGS}, k as (select decoder, process_context, case when process_context = 'dataloader' then start_method end as context_start_method, count(*) as configs from ctx group by all)
select *, sha256(json_object('context_start_method', context_start_method, 'decoder_id', decoder, 'process_context', process_context, 'requested_threads', null)::varchar) as audit_key from k""")
def audit_keys(spark, d):
    c = support.audit_keys(run_configs(spark, d).withColumns({"decoder_id": F.col("decoder"), "requested_threads": F.lit(None).cast("int")}))
    return c.groupBy("audit_key", "decoder", "process_context", "context_start_method").agg(F.count("*").alias("configs"))


@query(f"""with {CONFIGS}, p as (select *, case when config_id % 2 = 0 then 'common' else 'operational' end as support_policy from ctx), k as (select distinct decoder, process_context from p where support_policy = 'common'),
u as (select a.* from f_audits a join k using (decoder, process_context)), sh as (select count(*) as n from (select doc_id from u where ok group by doc_id having count(distinct decoder || process_context) = (select count(distinct decoder || process_context) from u))),
own as (select decoder, process_context, count(distinct doc_id) as n from f_audits where ok group by all)
select config_id, protocol_id, num_workers, support_policy, case when support_policy = 'common' then 'common/' || process_context else 'operational/' || decoder || '/' || process_context end as support_set,
  case when support_policy = 'common' then sh.n else coalesce(own.n, 0) end as items from p left join own using (decoder, process_context) cross join sh""")
def assign_support_sets(spark, d):
    c = support.with_context(run_configs(spark, d)).withColumn("support_policy", F.when(F.col("config_id") % 2 == 0, "common").otherwise("operational"))
    c = c.withColumn("config_key", F.struct("config_id", "protocol_id", "num_workers"))
    audits = view(spark, d, "f_audits").withColumnRenamed("doc_id", "item")
    out = support.assign_support_sets(c.select(F.col("config_key").alias("config_id"), "support_policy", "decoder", "process_context"), audits)
    return out.select("config_id.*", "support_policy", "support_set", "items")


@query("select decoder, process_context, count(distinct coalesce(failure_type, 'none')) as failure_types from f_audits group by all having count(distinct process_context) = 1")
def context_agreement(spark, d):
    a = view(spark, d, "f_audits")
    bad = validate.contexts_agree(a, ["decoder"], ["process_context"]).select(F.col("key").alias("decoder"))
    return a.join(bad, "decoder", "left_anti").groupBy("decoder", "process_context").agg(F.count_distinct(F.coalesce("failure_type", F.lit("none"))).alias("failure_types"))


# ---- matrices -----------------------------------------------------------------------------------


def level_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Levels from the data: brands as decoders, distinct container-size levels as worker profiles."""
    decoders = read(spark, d, "part").select(F.col("p_brand").alias("decoder"), (F.col("p_size") % 2).cast("int").alias("requested_threads")).distinct()
    workers = read(spark, d, "part").select(((F.col("p_size") % 5) * 2).cast("int").alias("num_workers")).distinct().withColumns({"prefetch_factor": F.lit(2), "start_method": F.lit("spawn")})
    return decoders, workers


LEVELS = "dec as (select distinct p_brand as decoder, (p_size % 2)::int as requested_threads from part), wrk as (select distinct ((p_size % 5) * 2)::int as num_workers from part)"
MATRIX = f"""{LEVELS}, matrix as (select decoder, requested_threads, 'decode-memory' as protocol_id, null::int as num_workers, null::int as prefetch_factor, null::varchar as start_method from dec
  union all select decoder, requested_threads, 'loader-supply', num_workers, case when num_workers > 0 then 2 end, case when num_workers > 0 then 'spawn' end from dec, wrk)"""


@query(f"with {MATRIX} select * from matrix")
def expand_matrix(spark, d):
    return matrix.expand_matrix(*level_tables(spark, d))


@query("""with c as (select distinct p_brand as config_id from part), b as (select config_id, r::int as repetition from c, range(3) t(r)),
o as (select config_id, repetition, row_number() over (partition by repetition order by sha256('11' || chr(0) || repetition::varchar || chr(0) || config_id), config_id) - 1 as block_position from b)
select config_id, repetition, block_position::int as block_position, (repetition * (select count(*) from c) + block_position)::bigint as position from o""")
def randomized_blocks(spark, d):
    return matrix.randomized_blocks(read(spark, d, "part").select(F.col("p_brand").alias("config_id")).distinct(), "config_id", 3, 11)


@query(f"""with {MATRIX}, m as (select *, decoder || '/' || requested_threads::varchar || '/' || coalesce(num_workers::varchar, '') as key from matrix),
v as (select key, case when requested_threads <= 0 then 'threads-not-positive' end as r from m union all select key, case when protocol_id = 'loader-supply' and num_workers > 6 then 'workers-without-warmup' end from m)
select key, r as rule from v where r is not null""")
def config_legality(spark, d):
    m = matrix.expand_matrix(*level_tables(spark, d))
    c = m.withColumns({
        "config_id": F.concat(F.col("decoder"), F.lit("/"), F.col("requested_threads").cast("string"), F.lit("/"), F.coalesce(F.col("num_workers").cast("string"), F.lit(""))),
        "decoder_id": F.col("decoder"), "batch_size": F.when(F.col("protocol_id") == "loader-supply", 8), "persistent_workers": F.coalesce(F.col("num_workers") > 0, F.lit(False)),
        "timed_passes": F.lit(1), "warmup_passes": F.when(F.col("num_workers") > 6, 0).otherwise(1), "support_policy": F.lit("common"),
    })
    return validate.config_rules(c).select("key", "rule")


@query(f"""with {MATRIX}, t as (select sum(compressed_bytes)::bigint as b, max(width * height * 3)::bigint as dec from f_items)
select decoder, requested_threads, protocol_id, num_workers, b as resident_compressed_bytes, case when protocol_id = 'loader-supply' and coalesce(num_workers, 0) > 0 then num_workers + 1 else 1 end::bigint as resident_replica_count,
  case when protocol_id = 'decode-memory' then dec when num_workers = 0 then 9 * dec else ((num_workers * 2 + 1) * 8 + num_workers) * dec end::bigint as decoded_inflight_bytes,
  (b * case when protocol_id = 'loader-supply' and coalesce(num_workers, 0) > 0 then num_workers + 1 else 1 end + case when protocol_id = 'decode-memory' then dec when num_workers = 0 then 9 * dec else ((num_workers * 2 + 1) * 8 + num_workers) * dec end)::bigint as estimated_peak_bytes
from matrix, t""")
def estimate_memory(spark, d):
    c = matrix.expand_matrix(*level_tables(spark, d)).withColumn("batch_size", F.when(F.col("protocol_id") == "loader-supply", 8))
    return matrix.estimate_memory(c, view(spark, d, "f_items")).drop("prefetch_factor", "start_method", "batch_size")


@query("select o_orderkey as run_key, plan_id, config_id from f_runs join orders on run_key = o_orderkey where not committed")
def pending_runs(spark, d):
    r = view(spark, d, "f_runs")
    return matrix.pending_runs(r.select("run_key", "plan_id", "config_id"), r.filter("committed"))


@query("""select decoder, machine_type, count(*) as n from f_measurements where not (decoder = 'dec-03' or decoder = 'dec-04' and machine_type = 'platform-2') group by all""")
def wildcard_platform_skip(spark, d):
    skips = spark.createDataFrame([("dec-03", "*", "*"), ("dec-04", "*", "platform-2"), ("dec-05", "other", "*")], "decoder string, system string, machine string")
    m = view(spark, d, "f_measurements").withColumns({"system": F.lit("linux"), "machine": F.col("machine_type")})
    return matrix.wildcard_platform_skip(m, skips).groupBy("decoder", "machine_type").agg(F.count("*").alias("n"))


@query("select decoder, count(*) as n from f_measurements where right(decoder, 1) in ('0', '3', '6', '9') group by all")
def group_filter(spark, d):
    m = view(spark, d, "f_measurements")
    capabilities = m.select("decoder").distinct().withColumn("dependency_group", F.when(F.substring("decoder", -1, 1).isin("0", "3", "6", "9"), "core").otherwise("extra"))
    return matrix.group_filter(m, capabilities, "core").groupBy("decoder").agg(F.count("*").alias("n"))


@query("""with i as (select distinct 'dec-' || lpad((p_partkey % 12)::varchar, 2, '0') as decoder, p_brand || case when p_partkey % 5 = 0 then '_x' else '' end as package from part),
e as (select distinct environment_id from f_distributions), h as (select distinct environment_id, name from f_distributions)
select environment_id, decoder, package from e, i where not exists (select 1 from h where h.environment_id = e.environment_id and h.name = regexp_replace(lower(i.package), '[_.]', '-', 'g'))""")
def package_coverage(spark, d):
    p = read(spark, d, "part")
    implementations = p.select(F.concat(F.lit("dec-"), F.lpad((F.col("p_partkey") % 12).cast("string"), 2, "0")).alias("decoder"), F.concat("p_brand", F.when(F.col("p_partkey") % 5 == 0, "_x").otherwise("")).alias("package")).distinct()
    return matrix.package_coverage(implementations, view(spark, d, "f_distributions"))


@query("""select run_key, count(*) filter (where status = 'click') as n_click, count(*) filter (where status = 'purchase') as n_purchase, count(*) filter (where status = 'view') as n_view, count(*) filter (where status = 'absent') as n_absent,
  bool_and(status in ('click', 'view')) as complete from f_attempts group by run_key""")
def status_counts(spark, d):
    return matrix.status_counts(view(spark, d, "f_attempts"), ["run_key"], [*EVENT_NAMES, "absent"], ["click", "view"])


@query("select run_key, attempt_id, status, duration_seconds, strftime(finished_at, '%Y-%m-%d %H:%M:%S') as finished_at from f_attempts qualify row_number() over (partition by run_key order by finished_at desc, attempt_id desc) = 1")
def latest_attempt(spark, d):
    return matrix.latest_attempt(view(spark, d, "f_attempts")).withColumn("finished_at", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss"))


# ---- profiles -----------------------------------------------------------------------------------


@query("""with s as (select doc_id from f_audits where ok group by doc_id having count(distinct decoder) = (select count(distinct decoder) from f_audits))
select 'timed' as side, workload_id, count(*) as items from f_items join s using (doc_id) group by all union all select 'excluded', workload_id, count(*) from f_items anti join s using (doc_id) group by all""")
def manifest_split(spark, d):
    timed, excluded = profiles.manifest_split(view(spark, d, "f_items"), support_intersection(spark, d), "doc_id")
    part = lambda df, side: df.groupBy("workload_id").agg(F.count("*").alias("items")).select(F.lit(side).alias("side"), "workload_id", "items")
    return part(timed, "timed").unionByName(part(excluded, "excluded"))


@query("""with p as (select sha256(content) as digest, arg_max(relative_path, doc_id) as origin from f_items where content is not null and doc_id % 3 <> 0 group by 1)
select i.doc_id, origin from f_items i join p on sha256(i.content) = p.digest""")
def attach_provenance(spark, d):
    i = view(spark, d, "f_items").filter("content is not null").withColumn("digest", F.sha2("content", 256))
    provenance = i.filter("doc_id % 3 <> 0").select("digest", F.col("relative_path").alias("origin"), F.col("doc_id").alias("ordinal"))
    return profiles.attach_provenance(i.select("doc_id", "digest"), provenance, "digest", "ordinal")[0].select("doc_id", "origin")


TIMED = """s as (select doc_id from f_audits where ok group by doc_id having count(distinct decoder) = (select count(distinct decoder) from f_audits)),
i as (select *, case when components = 1 then 'grayscale' when h = 1 and v = 1 then '4:4:4' when h = 2 and v = 1 then '4:2:2' when h = 2 and v = 2 then '4:2:0' else 'other' end as subsampling from f_items),
timed as (select * from i semi join s using (doc_id)), excluded as (select * from i anti join s using (doc_id))"""


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = view(spark, d, "f_items").withColumn("subsampling", X.subsampling_label(F.col("components"), F.col("h"), F.col("v")))
    return profiles.manifest_split(items, support_intersection(spark, d), "doc_id")


@query(f"""with {TIMED}, t as (select workload_id, count(*) as items, count(*) filter (where progressive) as progressive, sum(compressed_bytes)::bigint as total_bytes, count(*) filter (where subsampling = '4:4:4') as s444,
  count(*) filter (where subsampling = '4:2:2') as s422, count(*) filter (where subsampling = '4:2:0') as s420, count(*) filter (where subsampling = 'grayscale') as gray from timed group by all),
e as (select workload_id, count(*) as excluded from excluded group by all)
select workload_id, coalesce(items, 0) as items, coalesce(progressive, 0) as progressive, coalesce(total_bytes, 0) as total_bytes, coalesce(s444, 0) as s444, coalesce(s422, 0) as s422, coalesce(s420, 0) as s420, coalesce(gray, 0) as gray, coalesce(excluded, 0) as excluded
from t full join e using (workload_id)""")
def workload_profile(spark, d):
    return profiles.workload_profile(*_split(spark, d))


@query(f"""with {TIMED}, c as (select workload_id, subsampling, count(*) as n, count(*) filter (where progressive) as progressive from excluded group by all)
select workload_id, subsampling, coalesce(n, 0) as n, coalesce(progressive, 0) as progressive from (select distinct workload_id from f_items) left join c using (workload_id)""")
def excluded_profile(spark, d):
    return profiles.excluded_profile(view(spark, d, "f_items"), _split(spark, d)[1], "subsampling")


@query(f"""with {TIMED}, x as (select workload_id, subsampling, progressive from excluded), w as (select distinct workload_id from f_items),
c as (select workload_id, 'subsampling' as metric, subsampling as value, count(*) as n from x group by all union all select workload_id, 'progressive', progressive::varchar, count(*) from x group by all)
select workload_id, metric, value, coalesce(n, 0) as n from (select workload_id, unnest(['subsampling', 'progressive']) as metric from w) left join c using (workload_id, metric)""")
def excluded_histograms(spark, d):
    return profiles.excluded_histograms(view(spark, d, "f_items"), _split(spark, d)[1], ["subsampling", "progressive"])


@query(f"""with {TIMED} select workload_id, 'subsampling' as metric, subsampling as value, count(*) as n from timed group by all union all select workload_id, 'components', components::varchar, count(*) from timed group by all""")
def profile_histograms(spark, d):
    return profiles.profile_histograms(_split(spark, d)[0], ["subsampling", "components"])


@query("""with r as (select *, run_key % 5 as repetition, case when workload_id = 'native' then 'en' else 'de' end as items_of from f_runs),
i as (select workload_id as items_of, count(*) as n, count(*) filter (where doc_id % 3 <> 0) as t from f_items group by all)
select items_of as workload_id, count(*) as runs, count(*) filter (where run_key in (select run_key from f_samples where elapsed_seconds >= 4.9)) as runs_with_failures, count(distinct repetition) as repetitions,
  coalesce(any_value(n), 0) as manifest_items, coalesce(any_value(t), 0) as timed_items from r left join i using (items_of) group by all""")
def coverage(spark, d):
    r = view(spark, d, "f_runs").withColumn("repetition", F.col("run_key") % 5).withColumn("workload_id", F.when(F.col("workload_id") == "native", "en").otherwise("de"))
    i = view(spark, d, "f_items")
    return profiles.coverage(r, view(spark, d, "f_samples").filter("elapsed_seconds >= 4.9"), "workload_id", "repetition", i, i.filter("doc_id % 3 <> 0"))


@query("""with w as (select distinct name from f_distributions union select 'Brand#none'), v as (select name, list(distinct version order by version) as versions from f_distributions group by all)
select name, coalesce(array_to_string(versions, ','), '') as versions, coalesce(len(versions), 0) = 1 as consistent from w left join v using (name)""")
def versions_consistent(spark, d):
    x = view(spark, d, "f_distributions")
    wanted = x.select("name").distinct().unionByName(spark.createDataFrame([("Brand#none",)], "name string"))
    return profiles.versions_consistent(x, wanted).withColumn("versions", F.concat_ws(",", "versions"))


@query("""with s as (select decoder, process_context, sha256(array_to_string(list(doc_id::varchar order by doc_id::varchar), chr(10))) as d from f_audits where ok group by all)
select process_context, count(distinct d) as populations, count(*) as runs from s group by all""")
def same_population(spark, d):
    return profiles.same_population(view(spark, d, "f_audits").filter("ok"), "process_context", "decoder", "doc_id")


# ---- validation and publication -----------------------------------------------------------------


@query("select run_key, array_to_string(list_sort(list_filter(['click', 'purchase', 'view'], lambda x: not list_contains(e, x))), ',') as missing from (select run_key::varchar || '/' || strftime(finished_at, '%Y-%m-%d %H') as run_key, list(distinct status) as e from f_attempts group by all) where len(list_filter(['click', 'purchase', 'view'], lambda x: not list_contains(e, x))) > 0")
def required_events(spark, d):
    a = view(spark, d, "f_attempts").withColumnRenamed("status", "event").withColumn("run_key", F.concat_ws("/", F.col("run_key").cast("string"), F.date_format("finished_at", "yyyy-MM-dd HH")))
    return validate.required_events(a, EVENT_NAMES).withColumn("missing", F.concat_ws(",", F.array_sort("missing")))


@query("""with s as (select run_key, count(*) as n from f_samples group by run_key), t as (select unnest(['elapsed_seconds', 'images_per_second', 'microseconds_per_image']) as statistic),
x as (select cast(run_key as varchar) || '/' || statistic as key, run_key, statistic, n from s, t)
select key, 'count-mismatch' as rule from x where run_key % 40 = 0 and statistic = 'elapsed_seconds' union all select key, 'mean-mismatch' from x where run_key % 50 = 1 and statistic = 'images_per_second'
union all select key, 'median-mismatch' from x where run_key % 50 = 2 and statistic = 'microseconds_per_image' union all select key, 'sample-std-mismatch' from x where run_key % 50 = 3 and n > 1 and statistic = 'elapsed_seconds'
union all select key, 'no-summary' from x where run_key % 50 = 4""")
def summary_recheck(spark, d):
    again = materialize(metrics.summarize_benchmark(view(spark, d, "f_samples")), "again")
    at = lambda k, s: (F.col("run_key") % 50 == k) & (F.col("statistic") == s)
    stored = again.filter("run_key % 50 <> 4").withColumn("n", F.col("n") + F.when((F.col("run_key") % 40 == 0) & (F.col("statistic") == "elapsed_seconds"), 1).otherwise(0))
    stored = stored.withColumn("mean", F.when(at(1, "images_per_second"), F.col("mean") * 1.5).otherwise(F.col("mean"))).withColumn("median", F.when(at(2, "microseconds_per_image"), F.col("median") + 1).otherwise(F.col("median")))
    stored = stored.withColumn("sample_std", F.when(at(3, "elapsed_seconds"), F.col("sample_std") + 1).otherwise(F.col("sample_std")))
    return validate.summary_recheck(again, stored).select("key", "rule")


@query("""with x as (select run_key, coalesce(num_workers, 0) > 0 and protocol_id = 'loader-supply' as loads, run_key % 7 as items, 1 + run_key % 3 as factor from f_runs)
select key, rule from (select cast(run_key as varchar) as key, unnest(list_filter([case when run_key % 11 = 0 then 'run-key-not-a-digest' end, case when run_key % 13 = 0 then 'revision-malformed' end, case when run_key % 13 = 0 then 'revision-mismatch' end,
  case when loads then 'context-mismatch' end, case when run_key % 17 = 0 then 'items-processed-mismatch' end, case when run_key % 19 = 0 then 'unique-images-mismatch' end, case when run_key % 23 = 0 then 'repeat-factor-mismatch' end,
  case when items = 0 then 'no-items' end, case when items > 1 and run_key % 29 = 0 then 'repeated-items' end], lambda r: r is not null)) as rule from x)""")
def identity_rules(spark, d):
    r = view(spark, d, "f_runs").withColumn("start_method", F.when(F.col("num_workers") > 0, "spawn")).withColumn("factor", 1 + F.col("run_key") % 3).withColumn("n", (F.col("run_key") % 7).cast("int"))
    item = F.when(F.col("run_key") % 29 == 0, F.array_repeat(F.lit("same"), F.col("n"))).otherwise(F.transform(F.slice(F.sequence(F.lit(1), F.lit(7)), F.lit(1), F.col("n")), lambda i: i.cast("string")))
    plus = lambda k: F.when(F.col("run_key") % k == 0, 1).otherwise(0)
    decodes = (F.size("ordered_item_ids") * F.col("factor")).cast("long")
    r = r.withColumn("ordered_item_ids", item).select(
        F.col("run_key").alias("id"), F.when(F.col("run_key") % 11 == 0, "x").otherwise(F.sha2(F.col("run_key").cast("string"), 256)).alias("run_key"), F.when(F.col("run_key") % 13 == 0, "head").otherwise(F.lit("a" * 40)).alias("runner_revision"),
        F.lit("a" * 40).alias("environment_revision"), "protocol_id", "num_workers", "start_method", F.col("factor").alias("logical_repeat_factor"), "ordered_item_ids", F.lit("main-process").alias("support_process_context"),
        F.col("start_method").alias("support_start_method"), (decodes + plus(17)).alias("items_processed"), (F.size("ordered_item_ids") + plus(19)).cast("long").alias("num_unique_images"), (F.col("factor") + plus(23)).alias("summary_repeat_factor"), decodes.alias("logical_decodes_per_pass"),
    )
    key = r.select("id", F.col("run_key").alias("_k"))
    found = validate.identity_rules(r.withColumn("run_key", F.when(F.col("run_key") == "x", F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise(F.col("run_key"))))
    names = key.select(F.when(F.col("_k") == "x", F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise(F.col("_k")).alias("key"), "id")
    return found.join(names, "key").select(F.col("id").cast("string").alias("key"), "rule")


@query("select run_key, plan_id, num_workers from f_runs where protocol_id = 'loader-supply' and workload_id = 'native' and num_workers is not distinct from 4")
def filter_runs(spark, d):
    out = publish.filter_runs(view(spark, d, "f_runs"), {"config.protocol_id": "loader-supply", "dataset.workload_id": "native", "config.num_workers": 4, "runtime.absent": None}, check=False)
    return out.select("run_key", "plan_id", "num_workers")


@query("select workload_id, count(*) as runs from f_runs where protocol_id = 'decode-memory' group by all")
def claim_scope_gate(spark, d):
    gated = publish.claim_scope_gate(view(spark, d, "f_runs").filter("protocol_id = 'decode-memory'"), "decode")
    return gated.groupBy("workload_id").agg(F.count("*").alias("runs"))


@query("""select run_key, sha256('machine=' || machine_type || chr(10) || 'workload=' || workload_id) as comparison_platform, nullif(location, '') as location from f_runs""")
def comparison_platform(spark, d):
    r = view(spark, d, "f_runs")
    identity = F.create_map(F.lit("workload"), "workload_id", F.lit("location"), "location", F.lit("machine"), "machine_type")
    return r.select("run_key", digests.comparison_key(identity).alias("comparison_platform"), X.location(F.lit(None).cast("string"), identity["location"]).alias("location"))


@query("select plan_id, sha256(array_to_string(list(run_key::varchar order by run_key::varchar), chr(10)) || chr(10)) as digest, count(*) as n from f_runs group by all")
def sequence_digest(spark, d):
    return digests.sequence_digest(view(spark, d, "f_runs"), ["plan_id"], "run_key")


@query("""with h as (select workload_id, doc_id, doc_id // 65536 as b, sha256(json_object('compressed_bytes', compressed_bytes, 'relative_path', relative_path, 'width', width)::varchar) as h from f_items),
k as (select workload_id, b, sha256(string_agg(h, chr(10) order by doc_id)) as h, count(*) as n from h group by all)
select workload_id, sha256(string_agg(h, chr(10) order by b)) as manifest_id, sum(n)::bigint as item_count from k group by all""")
def manifest_digest(spark, d):
    return digests.ordered_digest(view(spark, d, "f_items"), ["workload_id"], "doc_id", ["relative_path", "compressed_bytes", "width"], "manifest_id")


@query("""with a as (select workload_id, machine_type, count(*) as n from f_runs group by all), b as (select workload_id, machine_type, case when machine_type = 'platform-1' then n + 1 else n end as n from a)
select workload_id, machine_type, n, 'published' as side from (select * from a except all select * from b) union all select workload_id, machine_type, n, 'recomputed' from (select * from b except all select * from a)""")
def publication_check(spark, d):
    a = view(spark, d, "f_runs").groupBy("workload_id", "machine_type").agg(F.count("*").alias("n"))
    return publish.differences(a, a.withColumn("n", F.when(F.col("machine_type") == "platform-1", F.col("n") + 1).otherwise(F.col("n"))))


@query("""with r as (select run_key::varchar as k, sha256(run_key::varchar)[1:3] as b, sha256(json_object('n', 1, 'run_key', run_key)::varchar) as h, run_key from f_runs where committed),
a as (select b, sha256(string_agg(k, chr(10) order by k)) as h, count(*) as n from r group by all), o as (select b, sha256(string_agg(h, chr(10) order by run_key)) as h, count(*) as n from r group by all),
s as (select sha256(string_agg(h, chr(10) order by b)) as run_keys_digest, sum(n)::bigint as runs from a), t as (select sum(n)::bigint as rows, sha256(string_agg(h, chr(10) order by b)) as output_digest from o)
select run_keys_digest, runs, rows, output_digest, sha256(concat_ws(chr(10), run_keys_digest, output_digest, '[(''committed'', True)]', repeat('0', 40))) as publication_id from s, t""")
def publication_provenance(spark, d):
    r = view(spark, d, "f_runs").filter("committed")
    side = publish.provenance(r, r.groupBy("run_key").agg(F.count("*").alias("n")), {"committed": True}, "0" * 40)
    return side.select("run_keys_digest", "runs", "rows", "output_digest", "publication_id")


@query("select run_key, case when num_workers > 0 then 'dataloader' else 'main-process' end as process_context from f_runs where protocol_id = 'loader-supply'")
def process_context(spark, d):
    r = view(spark, d, "f_runs").filter("protocol_id = 'loader-supply'")
    return r.select("run_key", X.process_context(F.col("protocol_id"), F.col("num_workers")).alias("process_context"))


@query("select cast(doc_id as varchar) as key, case when doc_id % 11 = 0 then 'digest-mismatch' else 'size-mismatch' end as rule from f_items where content is not null and (doc_id % 11 = 0 or doc_id % 13 = 1) union all select cast(doc_id as varchar), 'size-mismatch' from f_items where content is not null and doc_id % 11 = 0 and doc_id % 13 = 1")
def payload_rules(spark, d):
    files = view(spark, d, "f_items").filter("content is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("content").cast("binary").alias("content"), "doc_id")
    listed = files.select("path", (F.length("content") + F.when(F.col("doc_id") % 13 == 1, 1).otherwise(0)).cast("long").alias("bytes"), F.sha2(F.when(F.col("doc_id") % 11 == 0, F.lit("x").cast("binary")).otherwise(F.col("content")), 256).alias("sha256"))
    return validate.payload_rules(listed, files).select("key", "rule")


@query("""with o as (select workload_id, doc_id, row_number() over (partition by workload_id order by doc_id) - 1 as ordinal, case when doc_id % 31 = 0 then '/' || relative_path when doc_id % 37 = 0 then 'a/../' || relative_path else relative_path end as p from f_items)
select workload_id || '/' || p as key, 'unsafe-path' as rule from o where doc_id % 31 = 0 or doc_id % 37 = 0 union all select workload_id, 'item-count' from o where workload_id in ('en', 'de') group by workload_id""")
def manifest_rules(spark, d):
    path = F.when(F.col("doc_id") % 31 == 0, F.concat(F.lit("/"), "relative_path")).when(F.col("doc_id") % 37 == 0, F.concat(F.lit("a/../"), "relative_path")).otherwise(F.col("relative_path"))
    w = Window.partitionBy("workload_id").orderBy("doc_id")
    items = view(spark, d, "f_items").select("workload_id", (F.row_number().over(w) - 1).alias("ordinal"), path.alias("relative_path"))
    stored = items.groupBy("workload_id").agg((F.count("*") + F.when(F.col("workload_id").isin("en", "de"), 1).otherwise(0)).alias("item_count"))
    return validate.manifest_rules(items, stored).select("key", "rule")


@query("""with s as (select doc_id, greatest(width, height) as side from f_items), l as (select distinct 16 + n_chars % 640 as e from documents)
select doc_id::varchar as key, 'source-too-small' as rule from s where side < (select max(e) from l)""")
def level_rules(spark, d):
    i = view(spark, d, "f_items")
    levels = i.select(F.col("width").alias("long_edge")).distinct()
    return validate.level_rules(levels, i.select(F.col("doc_id").alias("source_id"), "width", "height")).select("key", "rule")


@query("""with x as (select run_key, workload_id, committed, run_key % 9 as items from f_runs) select run_key::varchar as key, r as rule from (
select run_key, case when workload_id = 'mixed' then 'unknown-workload' end as r from x union all select run_key, case when workload_id = 'native' and items <> 3 then 'item-count' end from x
union all select run_key, case when not committed then 'not-completed' end from x) where r is not null""")
def evidence_rules(spark, d):
    r = view(spark, d, "f_runs").select("run_key", "workload_id", (F.col("run_key") % 9).alias("items"), F.lit("r1").alias("runner_revision"), F.when(F.col("committed"), "completed").otherwise("failed").alias("status"), F.lit(1).alias("sample_count"))
    expected = spark.createDataFrame([("native", 3, "r1")], "workload_id string, expected_items long, expected_revision string")
    return validate.evidence_rules(r, expected).select("key", "rule")


@query("select p_partkey::varchar as key, 'missing' as rule from part where p_size % 5 = 0 and p_size % 3 <> 0 union all select p_partkey::varchar, 'extra' from part where p_size % 3 = 0 and p_size % 5 <> 0")
def file_sets(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("path"), "p_size")
    return validate.file_sets(p.filter("p_size % 5 = 0"), p.filter("p_size % 3 = 0"), ["path"]).select("key", "rule")


# ---- bytes in Arrow batches ---------------------------------------------------------------------


def _outcome(name: str, limit: int):
    def check(content: bytes) -> None:
        if not content:
            raise support.ContractError("empty")
        if len(content) > limit:
            raise ValueError(f"{name}: more than {limit} bytes")

    return check


@query("""select doc_id::varchar as item_id, name, strlen(coalesce(content, '')) between 1 and lim as ok, case when strlen(coalesce(content, '')) = 0 then 'output_contract_error' when strlen(content) > lim then 'decode_error' end as failure_type
from f_items, (values ('small', 1000), ('large', 20000)) c(name, lim)""")
def audit_items(spark, d):
    items = view(spark, d, "f_items").select(F.col("doc_id").cast("string").alias("item_id"), F.coalesce("content", F.lit("")).cast("binary").alias("content"))
    return support.audit_items(items, {"small": _outcome("small", 1000), "large": _outcome("large", 20000)}).drop("message")


@query("""select doc_id::varchar as path, width::int as width, height::int as height, 3 as components, progressive, case when h = 1 and v = 1 then '4:4:4' when h = 2 and v = 1 then '4:2:2' when h = 2 and v = 2 then '4:2:0' else 'other' end as subsampling,
  case when doc_id % 10 = 3 then 'segment length out of range' end as parse_error from f_items""")
def profile_images(spark, d):
    """Headers that documents' sizes stand for; every tenth has a broken segment after its frame."""
    four = lambda c: F.lpad(F.hex(F.col(c)), 4, "0")
    frame = F.concat(F.lit("FFD8FF"), F.when(F.col("progressive"), "C2").otherwise("C0"), F.lit("001108"), four("height"), four("width"), F.lit("0301"), F.hex("h"), F.hex("v"), F.lit("00021100031100"))
    content = F.unhex(F.concat(frame, F.when(F.col("doc_id") % 10 == 3, "FFE0FFFF").otherwise("FFD9")))
    images = view(spark, d, "f_items").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return image_scans.profile_images(images).select("path", "width", "height", "components", "progressive", "subsampling", "parse_error")


# ---- streams ------------------------------------------------------------------------------------


@query("select o_orderkey as run_key, o_custkey, o_orderpriority as plan_id from orders where o_orderstatus = 'F'")
def stream_committed_runs(spark, d):
    path = f"{d}/orders.parque[t]"  # a stream reads folders or patterns
    target, checkpoint = shared_folder(spark, "runs"), shared_folder(spark, "stream")
    streams.stream_committed_runs(spark, path, spark.read.parquet(path).schema, target, checkpoint, "o_orderstatus = 'F'", "o_orderkey").awaitTermination()
    return spark.read.parquet(target).select(F.col("o_orderkey").alias("run_key"), "o_custkey", F.col("o_orderpriority").alias("plan_id"))


@query("""with l as (select run_key, status, finished_at, count(*) over (partition by run_key) as attempts from f_attempts qualify row_number() over (partition by run_key order by finished_at desc, attempt_id desc, status desc) = 1)
select run_key, status, strftime(finished_at, '%Y-%m-%d %H:%M:%S') as updated_at, attempts, timestamp '2024-01-20 00:00:00' - finished_at > interval 86400 seconds as stale from l""")
def stream_attempt_status(spark, d):
    path = f"{d}/events.parque[t]"
    target, checkpoint = shared_folder(spark, "status"), shared_folder(spark, "stream")
    rename = lambda df: df.select(F.col("user_id").alias("run_key"), F.col("event_id").alias("attempt_id"), F.col("event_type").alias("status"), F.col("ts").alias("finished_at"))
    streams.stream_attempt_status(spark, path, spark.read.parquet(path).schema, target, checkpoint, rename).awaitTermination()
    import datetime

    last = streams.stale(streams.current_status(spark, target).drop("stale"), datetime.datetime(2024, 1, 20), 86400)
    return last.select("run_key", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "attempts", "stale")
