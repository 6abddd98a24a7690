"""Bindings: batches, run results, crosswalks and plain scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, scoring, selection
from .registry import query


@query("""
with u as (select c_custkey, c_acctbal, c_custkey % 5 = 0 as p, c_custkey % 11 = 0 as h from customer), r as (select *, row_number() over (partition by h order by p, c_acctbal desc, c_custkey) as n from u)
select c_custkey, case when not h then n end as position, case when h then 0 else ((n - 1) // 100 + 1)::int end as batch, case when h then 0 else ((n - 1) // 25 + 1)::int end as shard from r""")
def q_batches_with_carry(t):
    c = t("customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 11 == 0).alias("held_back"))
    out = selection.batches_with_carry(c.filter("c_custkey % 5 <> 0"), c.filter("c_custkey % 5 = 0"), [F.desc("c_acctbal"), F.asc("c_custkey")])
    return out.select("c_custkey", F.col("position").cast("bigint").alias("position"), "batch", "shard")


@query("""
select o_orderkey, case when o_orderkey % 6 = 1 then 'failed' when o_orderkey % 2 = 0 then 'done' else 'not_run' end as state, case when o_orderkey % 2 = 0 then 'b' end as answer, case when o_orderkey % 5 = 0 then 40 end as ms from orders""")
def q_timing_of_rows(t):
    o, k = t("orders").select("o_orderkey"), F.col("o_orderkey")
    raw = o.filter(k % 2 == 0)
    raw = raw.withColumns({"answer": F.lit("a"), "s": F.lit(1)}).unionByName(raw.withColumns({"answer": F.lit("b"), "s": F.lit(2)}))
    failed = o.filter(k % 6 == 1).withColumns({"why": F.lit("x"), "s": F.lit(1)})
    timed = o.filter(k % 5 == 0).select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("s")).withColumn("ms", F.col("s") * 10)
    return selection.timing_of_rows(o, raw, failed, timed, "o_orderkey", "s").select("o_orderkey", "state", "answer", "ms")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'retry' else 'main' end as run from orders")
def q_retry_wins(t):
    o = t("orders").select("o_orderkey")
    return selection.retry_wins(o, o.filter("o_orderkey % 3 = 0"), "o_orderkey")


@query("select user_id, count(*) as n_runs, string_agg(r, '; ' order by d, r) as runs, max(d) as last from (select distinct user_id, 'r' || strftime(ts, '%d') as r, strftime(ts, '%Y-%m-%d') as d from events) b where not exists (select 1 from events e where e.user_id = b.user_id and event_type = 'error' and 'r' || strftime(e.ts, '%d') = b.r) group by 1")
def q_success_ledger(t):
    e = t("events").select("user_id", "event_type", F.concat(F.lit("r"), F.date_format("ts", "dd")).alias("run"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return selection.success_ledger(e.select("user_id", "run", "day").distinct(), e.filter("event_type = 'error'"), "user_id", "run", "day")


@query("""
with e as (select distinct event_type, 'u' || user_id::varchar as run from events), p as (select *, ((row_number() over (partition by event_type order by run) - 1) // 10000 + 1)::int as part from e)
select event_type, part, string_agg(run, '; ' order by run) as runs from p group by 1, 2""")
def q_inverted_runs(t):
    per = t("events").groupBy(F.concat(F.lit("u"), "user_id").alias("run")).agg(F.collect_set("event_type").alias("ids"))
    return selection.run_inverted(per, "run", "ids", "event_type")


@query("select event_id, user_id, event_type from events order by ts desc, event_id desc limit 1")
def q_latest(t):
    e = t("events").withColumn("o", F.struct("ts", "event_id"))
    return selection.latest(e.select("event_id", "user_id", "event_type", "o"), "o").drop("o")


@query("""
select s, k, min(o) as o from (select s_suppkey as s, s_nationkey as k, 'a' as o from supplier where s_suppkey % 2 = 0 union all select s_suppkey, s_suppkey % 5, 'b' from supplier where s_suppkey % 3 = 0) group by 1, 2
union all select s_suppkey, 99, 'fallback' from supplier where s_suppkey % 2 <> 0 and s_suppkey % 3 <> 0""")
def q_crosswalk(t):
    s = t("supplier").select(F.col("s_suppkey").alias("s"), "s_nationkey")
    a = s.filter("s % 2 = 0").select("s", F.col("s_nationkey").cast("bigint").alias("k"))
    b = s.filter("s % 3 = 0").select("s", (F.col("s") % 5).alias("k"))
    return selection.crosswalk([("a", a), ("b", b)], "s", "k", s.select("s", F.lit(99).cast("bigint").alias("k"))).withColumnRenamed("source", "o")


@query("""
select p_partkey, case p_size % 3 when 0 then 'N ' || n_name when 1 then 'R ' || r_name else 'none' end as label from part
left join nation on n_nationkey = p_size % 25 left join region on r_regionkey = p_size % 5""")
def q_lookup_by_kind(t):
    p = t("part").select("p_partkey", F.element_at(F.array(F.lit("n"), F.lit("r"), F.lit("x")), (F.col("p_size") % 3 + 1).cast("int")).alias("kind"), (F.col("p_size") % 25).alias("nk"), (F.col("p_size") % 5).alias("rk"))
    n = t("nation").select(F.col("n_nationkey").alias("nk"), F.concat(F.lit("N "), "n_name").alias("label"))
    r = t("region").select(F.col("r_regionkey").alias("rk"), F.concat(F.lit("R "), "r_name").alias("label"))
    return selection.lookup_by_kind(p, "kind", {"n": (n, "nk"), "r": (r, "rk")}, "label", F.lit("none")).select("p_partkey", "label")


@query("select user_id, row_number() over (order by min(event_id)) as position from events group by 1")
def q_ordered_distinct(t):
    return selection.ordered_distinct(t("events"), "user_id", "event_id").select("user_id", F.col("position").cast("bigint").alias("position"))


@query("select o_orderpriority, string_agg(o_orderstatus || ' ' || n::varchar, ', ' order by n desc, o_orderstatus) as counts from (select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2) group by 1")
def q_counts_text(t):
    return selection.group_counts_text(t("orders"), "o_orderstatus", "o_orderpriority")


_PLAIN = """with p as (select p_partkey, case when v >= 50000 then 50 when v >= 25000 then 40 when v >= 10000 then 30 when v >= 5000 then 20 when v >= 2000 then 10 else 0 end + case when p_size % 2 = 0 then 15 else 5 end + case when p_size % 3 = 0 then 15 else 0 end
  + case when p_size % 7 in (1, 2) then 10 else 0 end + case when p_size % 7 = 2 then 5 else 0 end as score from (select *, p_retailprice * (p_size % 40) as v from part))
"""


@query(_PLAIN + "select p_partkey, score::int as score, case when score >= 60 then 'tier_1_high_plausibility' when score >= 45 then 'tier_2_medium_high_plausibility' when score >= 25 then 'tier_3_systematic_mid_small' else 'tier_4_small_low_information' end as tier from p")
def q_plain_score(t):
    k = F.col("p_size")
    p = t("part").withColumn("areas", F.array(k % 7))
    score = scoring.plain_score(F.col("p_retailprice") * (k % 40), F.when(k % 2 == 0, "City").otherwise("township"), k % 3 == 0, F.col("areas"), {"seen": F.array(F.lit(1), F.lit(2)), "positive": F.array(F.lit(2))}, F.lit(False))
    return p.select("p_partkey", score.cast("int").alias("score")).withColumn("tier", scoring.bands(F.col("score"), scoring.PLAIN_TIERS, "tier_4_small_low_information"))


@query("""
select n_nationkey, case when a >= 25 and c = 'high' and y >= 0.72 then 'priority_high_evidence_state' when a >= 25 and c = 'medium' then 'priority_growing_evidence_state' when a >= 25 and c = 'low' then 'priority_exploratory_state' when a + b >= 25 then 'cross_state_priority_fill' else 'defer_or_geographic_balance_only' end as advice,
  case when a < 10 then 'calibration_sample_needed' when y >= 0.7 or d >= 1.75 then 'strong_yield_consider_next_wave' when y >= 0.5 or d >= 1 then 'moderate_yield_use_priority_targets' else 'lower_yield_use_for_strategic_coverage' end as yield_advice
from (select c_nationkey as n_nationkey, count(*) filter (where c_acctbal > 5000) as a, count(*) filter (where c_acctbal between 0 and 5000) as b, case c_nationkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as c, count(*) filter (where c_acctbal > 2000) / count(*) as y, count(*) filter (where c_acctbal < 0) / count(*) as d from customer group by 1)""")
def q_group_advice(t):
    b = F.col("c_acctbal")
    g = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_if(b > 5000).alias("a"), F.count_if(b.between(0, 5000)).alias("b"), (F.count_if(b > 2000) / F.count("*")).alias("y"), (F.count_if(b < 0) / F.count("*")).alias("d"))
    k = F.col("n_nationkey") % 3
    c = F.when(k == 0, "high").when(k == 1, "medium").otherwise("low")
    return g.select("n_nationkey", scoring.group_advice(F.col("a"), F.col("b"), c, F.col("y")).alias("advice"), scoring.yield_advice(F.col("a"), F.col("y"), F.col("d")).alias("yield_advice"))


@query("select batch, count(*) as \"count\" from (select (row_number() over (order by p_partkey) - 1) // 50 + case when p_partkey = 7 then 1 else 0 end as batch from part) group by 1 having count(*) <> 50")
def q_batch_sizes(t):
    p = ranking.position(t("part").select("p_partkey"), [F.col("p_partkey")], "n")
    b = p.select((F.floor((F.col("n") - 1) / 50) + F.when(F.col("p_partkey") == 7, 1).otherwise(0)).alias("batch"))
    return selection.batch_sizes_agree(b, "batch", 50)
