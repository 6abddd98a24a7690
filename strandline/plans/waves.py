"""Bindings: coverage of a universe, hints, selections, split metrics and timing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, waves
from .registry import query


@query("""
with o as (select *, 'r' || strftime(o_orderdate, '%Y-%m') as run, strftime(o_orderdate, '%Y-%m-%d') as day from orders),
q as (select o_custkey as k, count(*) as c, count(*) filter (where o_totalprice > 300000) as queued, count(*) filter (where o_orderpriority = '1-URGENT') as u, count(*) filter (where o_orderpriority = '2-HIGH') as h from o where o_orderstatus <> 'P' group by 1),
s as (select o_custkey as k, count(distinct run) as n, string_agg(distinct run, '; ' order by run) as runs, max(day) as last, string_agg(distinct o_orderpriority, '; ' order by o_orderpriority) as kinds from o where o_orderstatus = 'F' group by 1),
f as (select o_custkey as k, count(distinct run) as n, string_agg(distinct run, '; ' order by run) as runs from o where o_orderstatus = 'P' group by 1)
select c_custkey, coalesce(c, 0) as candidates, coalesce(queued, 0) as queued, coalesce(s.n, 0) as successes, coalesce(s.runs, '') as success_runs, last as last_success, coalesce(kinds, '') as kinds, coalesce(f.n, 0) as failures, coalesce(f.runs, '') as failed_runs,
  coalesce(c, 0) - coalesce(u, 0) - coalesce(h, 0) as n_other, case when coalesce(u, 0) > 0 and coalesce(h, 0) > 0 then 'yes' else 'no' end as full_set,
  case when s.n > 0 and c > 0 then 'scouted_with_candidates' when s.n > 0 then 'scouted_no_candidates' when f.n > 0 then 'scout_attempt_failed_connection' else 'not_scouted' end as coverage_status,
  case when queued > 0 then 'queued_for_later_verification' when c > 0 then 'candidate_holds_only' when s.n > 0 then 'scouted_no_candidates' when f.n > 0 then 'scout_attempt_failed_connection' else 'not_scouted' end as queue_status,
  case when f.n > 0 and s.n > 0 then 'excluded_from_discovery_coverage; later_success_counted' when f.n > 0 then 'excluded_from_discovery_coverage; no_successful_rerun' else 'none' end as failure_accounting
from customer left join q on q.k = c_custkey left join s on s.k = c_custkey left join f on f.k = c_custkey""")
def q_coverage_join(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey").withColumn("run", F.concat(F.lit("r"), F.date_format("o_orderdate", "yyyy-MM"))).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    held, won, lost = o.filter("o_orderstatus <> 'P'"), o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'")
    out = waves.coverage(t("customer").select("c_custkey"), held, won, lost, "c_custkey", F.col("o_totalprice") > 300000, "o_orderpriority", ("1-URGENT", "2-HIGH"), "run", {"o_orderpriority": "kinds"}, "day")
    return out.drop("n_1-URGENT", "n_2-HIGH")


@query("select s_suppkey, s_name, case when s_suppkey % 7 <> 0 then n_name end as n_name, case when s_suppkey % 7 <> 0 then 'region ' || n_regionkey end as place from supplier join nation on n_nationkey = s_nationkey")
def q_attached_hints(t):
    hints = t("nation").select(F.concat(F.lit(" "), "n_nationkey", F.lit(" ")).alias("id"), "n_name", F.concat(F.lit("region "), "n_regionkey").alias("place"))
    rows = t("supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey").cast("string")).otherwise(" ").alias("id"))
    return waves.attach_hints(rows, hints, "id", ["n_name", "place"]).drop("id")


@query("""
with w as (select *, row_number() over (order by c_acctbal desc, c_custkey) as wave_rank from customer where c_mktsegment <> 'BUILDING'), k as (select *, (wave_rank - 1) // 20 as split from w where wave_rank <= 80)
select split::int as split, count(*) as n, round(avg(wave_rank), 4) as wave_rank_mean, min(wave_rank) as wave_rank_min, max(wave_rank) as wave_rank_max, min(c_acctbal) as c_acctbal_min, max(c_acctbal) as c_acctbal_max, round(median(c_acctbal), 4) as c_acctbal_median,
  min(z) as size_min, max(z) as size_max, round(median(z), 4) as size_median, count(*) - count(z) as size_missing,
  (select p from (select split as s2, c_nationkey as p, count(*) as m from k group by 1, 2) x where s2 = y.split order by m desc, p limit 1) as main_c_nationkey,
  (select max(m) from (select split as s2, c_nationkey as p, count(*) as m from k group by 1, 2) x where s2 = y.split) as main_c_nationkey_n
from (select *, case when c_custkey % 4 <> 0 then c_custkey * 10 end as size, case when c_custkey % 4 <> 0 then c_custkey * 10 end as z from k) y group by y.split""")
def q_assembled_wave(t):
    """The first 80 eligible customers, held against the full table, in splits of 20 ranks with their metrics."""
    c = t("customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    wave = waves.assemble(c, t("customer"), "c_custkey", ["c_acctbal", "c_nationkey"], F.col("c_mktsegment") != "BUILDING", [F.desc("c_acctbal"), F.asc("c_custkey")], 80)
    wave = wave.withColumn("split", ranking.slices(F.col("wave_rank"), 20) - 1).withColumn("size", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") * 10))
    out = waves.split_metrics(wave, ["split"], "wave_rank", "c_acctbal", "size", "c_nationkey")
    return out.drop("main_c_nationkey_share").withColumns({k: F.round(k, 4) for k in ("wave_rank_mean", "c_acctbal_median", "size_median")})


@query("""
with r as (select 'expected_1000_rows' as rule, abs(count(*) - 1000) as n from orders union all select 'repeated_o_orderkey', count(*) - count(distinct o_orderkey) from orders
union all select 'blank_o_orderstatus', count(*) - count(nullif(o_orderstatus, '')) from orders union all select 'repeated_o_orderstatus', count(nullif(o_orderstatus, '')) - count(distinct nullif(o_orderstatus, '')) from orders
union all select 'too_large', count(*) filter (where o_totalprice > 300000) from orders union all select 'too_late', count(*) filter (where o_orderdate > date '2100-01-01') from orders)
select rule, n::bigint as n from r where n > 0""")
def q_selection_faults(t):
    return waves.selection_faults(t("orders"), 1000, "o_orderkey", "o_orderstatus", {"too_large": F.col("o_totalprice") > 300000, "too_late": F.col("o_orderdate") > "2100-01-01"})


@query("""
with e as (select user_id % 10 as run, event_type <> 'view' as a, case when event_id % 9 = 0 then null else value end as s, user_id % 4 / 2.0 as z, case when event_type = 'click' then 5.0 + user_id % 3 end as l, event_type, case when event_type = 'error' then 'kind' || user_id % 2 else '' end as f, event_id % 50 = 0 as t from events)
select run, count(*) filter (where a) as attempted, round(avg(s) filter (where a), 4) as mean_s, round(median(s) filter (where a), 4) as median_s, round(sum(z), 4) as slept_s, min(l) as level_min, max(l) as level_max,
  round(count(*) filter (where a) * 3600 / (sum(s) filter (where a) + sum(z)), 4) as rows_per_hour, count(*) filter (where event_type = 'click') as n_click, count(*) filter (where f = 'kind0' and (a or t)) as n_kind0 from e group by 1""")
def q_timing_report(t):
    k, kind = F.col("event_id"), F.col("event_type")
    e = t("events").withColumn("run", F.col("user_id") % 10)
    elapsed = F.when(k % 9 == 0, "not a number").otherwise(F.col("value").cast("string"))
    level = F.when(kind == "click", (5.0 + F.col("user_id") % 3).cast("string")).otherwise("")
    failure = F.when(kind == "error", F.concat(F.lit("kind"), (F.col("user_id") % 2).cast("string"))).otherwise("")
    out = waves.timing_report(e, "run", kind != "view", elapsed, F.col("user_id") % 4 / 2.0, level, kind, failure, k % 50 == 0)
    n = lambda m, x: F.coalesce(F.try_element_at(F.col(m), F.lit(x)), F.lit(0))
    return out.withColumns({c: F.round(c, 4) for c in ("mean_s", "median_s", "slept_s", "rows_per_hour")}).withColumn("n_click", n("events", "click")).withColumn("n_kind0", n("failures", "kind0")).drop("events", "failures")


@query("""
select count(*) filter (where lower(trim(event_type)) = 'purchase') as n_successful, count(*) filter (where coalesce(json_extract_string(props, '$.k'), '') <> '') as n_nonempty,
  count(*) filter (where lower(trim(event_type)) = 'purchase') > 0 and count(*) filter (where coalesce(json_extract_string(props, '$.k'), '') <> '') > 0 as succeeded from events""")
def q_outcomes(t):
    e = t("events")
    return waves.outcomes(e, F.when(F.col("event_type") == "purchase", " YES ").otherwise("no"), F.get_json_object("props", "$.k"))
