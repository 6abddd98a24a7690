"""Bindings: roll-ups, summaries, scores, ranks and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import evidence, ledgers, ranking, rollups, scoring
from .registry import query


def _r(df, *columns, places=4):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("""
select n_nationkey, n_name, coalesce(n_customers, 0) as n_customers, coalesce(n_rich, 0) as n_rich, coalesce(orders_n, 0) as n_orders from nation
left join (select c_nationkey, count(distinct c_custkey) as n_customers, count(distinct case when c_acctbal > 5000 then c_custkey end) as n_rich, count(o_orderkey) as orders_n from customer left join orders on o_custkey = c_custkey where c_nationkey <> 7 group by 1) on c_nationkey = n_nationkey""")
def q_state_rollup(t):
    per = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = t("customer").filter("c_nationkey <> 7").join(per, "c_custkey", "left").withColumnRenamed("c_nationkey", "n_nationkey")
    measures = {"n_customers": F.count("*"), "n_rich": F.count_if(F.col("c_acctbal") > 5000), "n_orders": F.sum("n")}
    return rollups.rollup_all(t("nation").select("n_nationkey", "n_name"), "n_nationkey", c, measures)


@query("""
select s_suppkey, s_name, coalesce(n_parts, 0) as n_parts, coalesce(n_large, 0) as n_large from supplier left join (select l_suppkey, count(*) as n_parts, count(*) filter (where p_size > 25) as n_large
from (select distinct l_suppkey, l_partkey from lineitem where l_quantity > 10) join part on p_partkey = l_partkey group by 1) on l_suppkey = s_suppkey""")
def q_assoc_rollup(t):
    links = t("lineitem").filter("l_quantity > 10").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    return rollups.rollup_through(t("supplier").select("s_suppkey", "s_name"), "s_suppkey", links, t("part"), "p_partkey", {"n_parts": F.count("*"), "n_large": F.count_if(F.col("p_size") > 25)})


_UNITS = "select user_id, strftime(ts, '%Y-%m-%d') as day, list_sort(list(distinct event_type)) as u from events group by 1, 2"


@query(f"""
select user_id, day, array_to_string(u, '; ') as units, k = 3 as complete, case when k >= 3 then 'high' when k = 2 then 'medium' when k = 1 then 'low' else 'none' end as confidence
from (select *, len(list_filter(u, lambda x: x in ('click', 'view', 'purchase'))) as k from ({_UNITS}))""")
def q_unit_counts(t):
    e = t("events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return rollups.units_of(e, ["user_id", "day"], "event_type", ["click", "view", "purchase"]).withColumn("units", F.array_join("units", "; "))


@query("""
select user_id, strftime(ts, '%Y-%m-%d') as day, case when s > 0 and f > 0 then 'scouted_with_candidates' when s > 0 then 'scouted_no_candidates' when e > 0 then 'scout_attempt_failed_connection' else 'not_scouted' end as status
from (select user_id, ts::date as ts, count(*) filter (where event_type = 'purchase') as s, count(*) filter (where event_type = 'error') as e, count(*) filter (where event_type = 'click') as f from events group by 1, 2)""")
def q_status_precedence(t):
    e = t("events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("purchase", "error", "click")])
    return e.select("user_id", "day", scoring.status(F.col("purchase"), F.col("error"), F.col("click")).alias("status"))


_LEADS = """with e as (select event_id, event_type as et, value as v, user_id % 4 as q from events),
l as (select *, case et when 'click' then 'city' when 'view' then 'union' when 'purchase' then 'news' else 'unknown' end as ow, case when v > 60 then 'cba' when v < 5 then 'index_page' else 'unknown' end as dt,
  case q when 0 then 'full_document' when 1 then 'partial' when 2 then 'dead_or_unreachable' else '' end as co, event_id % 3 + 1 as nu, case when event_id % 17 = 0 then 'possible' else 'none' end as du, event_id % 101 = 0 as kn, 2010 + event_id % 17 as yr from e),
s as (select *, greatest(0, least(100, 25 + case when ow = 'city' then 12 when ow = 'union' then 8 when ow = 'news' then -8 else 0 end + case dt when 'cba' then 15 when 'index_page' then -20 else 0 end
  + case co when 'full_document' then 12 when 'partial' then 3 when 'dead_or_unreachable' then -15 else 0 end + case nu when 3 then 20 when 2 then 8 else 0 end + case when du = 'possible' then -15 else 0 end + case when kn then -60 else 0 end
  + case when yr >= 2018 then 5 else 0 end + case when yr > 2024 then -25 when yr < 2014 then -15 else 0 end)) as score from l)
"""


@query(_LEADS + """
select event_id, score, bucket, case when bucket = 'already_canonical_hold' then 'already_ingested_canonical' when bucket in ('likely_duplicate_hold', 'insufficient_hold') then 'not_queued_for_ingestion' else 'ingestion_deferred_pending_coordinated_verification' end as ingestion
from (select *, case when kn then 'already_canonical_hold' when du = 'possible' then 'likely_duplicate_hold' when co = 'dead_or_unreachable' then 'insufficient_hold' when score >= 70 then 'high_priority_later_verify' when score >= 50 then 'medium_priority_later_verify' else 'low_priority_later_verify' end as bucket from s)""")
def q_queue_triage(t):
    e, i, v = t("events"), F.col("event_id"), F.col("value")
    none, no = F.lit(""), F.lit(False)
    leads = e.select(
        "event_id", F.when(F.col("event_type") == "click", "city").when(F.col("event_type") == "view", "union").when(F.col("event_type") == "purchase", "news").otherwise("unknown").alias("owner_type"),
        F.when(v > 60, "cba").when(v < 5, "index_page").otherwise("unknown").alias("document_type"),
        F.element_at(F.array(F.lit("full_document"), F.lit("partial"), F.lit("dead_or_unreachable"), none), (F.col("user_id") % 4 + 1).cast("int")).alias("completeness"),
        (i % 3 + 1).alias("n_units"), F.when(i % 17 == 0, "possible").otherwise("none").alias("duplicate_risk"), (i % 101 == 0).alias("is_known"), (2010 + i % 17).alias("newest_year"), (2010 + i % 17).alias("oldest_year"),
        *[none.alias(c) for c in ("anchor_overlap", "year_evidence", "confidence", "wrong_employer_risk", "recommendation", "verification")], *[no.alias(c) for c in ("context_only", "blocked", "wrong_unit", "verified")],
    )
    return scoring.triage(leads).select("event_id", F.col("score").cast("int").alias("score"), "bucket", "ingestion")


@query("""
with p as (select page_id, lower(url) as u, page_id % 5 as k from pages),
s as (select page_id, greatest(0, least(100, case when contains(u, '.gov') or k = 0 then 20 else 0 end + case when k = 1 then 12 else 0 end + case when ends_with(u, '.pdf') or k = 2 then 15 else 0 end + case when k = 0 then 10 else 0 end + case when k < 3 then 10 else 0 end + 8
  - case when k = 3 then 20 else 0 end - case when k = 4 then 20 else 0 end)) as score from p)
select page_id, score, case when score >= 65 then 'high' when score >= 35 then 'medium' else 'low' end as priority from s""")
def q_provenance_score(t):
    k, none, no = F.col("page_id") % 5, F.lit(""), F.lit(False)
    p = t("pages").select(
        "page_id", "url", F.when(k == 0, "city").when(k == 1, "union").when(k == 3, "news").otherwise("unknown").alias("owner_type"), F.when(k == 2, "cba").when(k == 4, "context_only").otherwise("").alias("document_type"),
        F.when(k == 0, "full_document").otherwise("").alias("completeness"), F.when(k < 3, 2).otherwise(1).alias("n_unit_types"), F.lit("a title").alias("title"),
        *[none.alias(c) for c in ("contract_years", "union_name", "employer", "unit_type", "comparator_role", "stage", "anchor_overlap", "duplicate_risk", "wrong_employer_risk", "why_relevant")],
        *[no.alias(c) for c in ("generic_title", "context_only", "blocked", "third_party_host", "mentions_request")],
    )
    return scoring.source_score(p).select("page_id", F.col("score").cast("int").alias("score"), "priority")


_PRIO = """with g as (select c_nationkey as st, count(*)::double as n, count(*) filter (where c_acctbal > 5000) as s, count(*) filter (where c_mktsegment = 'BUILDING') as b from customer group by 1),
r as (select st, (s + 25 * (sum(s) over () / sum(n) over ())) / (n + 25) as s_rate, (b + 25 * (sum(b) over () / sum(n) over ())) / (n + 25) as b_rate from g),
m as (select c_custkey, c_nationkey, greatest(c_acctbal, 0) as pop, (rank() over (order by c_acctbal) - 1 + (count(*) over (partition by c_acctbal) - 1) / 2.0) / (count(*) over () - 1) as mid, ln(1 + greatest(c_acctbal, 0)) / ln(1 + max(c_acctbal) over ()) as lg from customer),
p as (select c_custkey, c_nationkey, 0.4 * mid + 0.6 * lg as pop, case when c_nationkey < 15 then 1.0 else 0.4 end as gov, s_rate as sy, b_rate as re from m join r on st = c_nationkey),
f as (select *, 30 * pop + 10 * gov + 20 * sy + 20 * re + 10 * 0.5 + 5 * 1.0 + 5 * 0.0 as score, 40 * pop + 10 * gov + 15 * sy + 15 * re + 10 * 0.5 + 5 * 1.0 as pop_heavier, 25 * pop + 10 * gov + 30 * sy + 20 * re + 5 * 0.5 + 5 * 1.0 as yield_heavier from p)
"""


def _priorities(t):
    c = t("customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    rates = rollups.smoothed_rates(c, "c_nationkey", F.count("*"), {"s": F.count_if(F.col("c_acctbal") > 5000), "b": F.count_if(F.col("c_mktsegment") == "BUILDING")})
    top = c.agg(F.max("c_acctbal").alias("top"))
    m = ranking.mid_rank(c, "c_acctbal").crossJoin(F.broadcast(top))  # one row
    parts = m.join(rates.select("c_nationkey", "s_rate", "b_rate"), "c_nationkey").select(
        "c_custkey", "c_nationkey", (0.4 * F.col("midrank") + 0.6 * values.log_scale(F.col("c_acctbal"), F.col("top"))).alias("pop"), F.when(F.col("c_nationkey") < 15, 1.0).otherwise(0.4).alias("gov"),
        F.col("s_rate").alias("state_yield"), F.col("b_rate").alias("research"), F.lit(0.5).alias("geo"), F.lit(1.0).alias("completeness"), F.lit(0.0).alias("evidence"),
    )
    return parts.withColumns({"score": scoring.priority()} | {k: scoring.priority(w) for k, w in scoring.PRIORITY_VARIANTS.items()})


@query(_PRIO + "select c_custkey, round(pop, 6) as pop, round(sy, 6) as state_yield, round(re, 6) as research, round(score, 4) as score from f")
def q_priority_components(t):
    return _r(_r(_priorities(t).select("c_custkey", "pop", "state_yield", "research", "score"), "pop", "state_yield", "research", places=6), "score")


@query("select p_partkey, round((rank() over (order by p_size) - 1 + (count(*) over (partition by p_size) - 1) / 2.0) / (count(*) over () - 1), 6) as midrank from part")
def q_midrank_percentile(t):
    return ranking.mid_rank(t("part").select("p_partkey", "p_size"), "p_size").select("p_partkey", F.round("midrank", 6).alias("midrank"))


_TIERS = _PRIO + """, k as (select *, row_number() over (order by round(score, 4) desc, c_custkey) as rank, count(*) over () as n from f),
tr as (select *, case when rank <= ceil(n * 0.05) then 1 when rank <= ceil(n * 0.15) then 2 when rank <= ceil(n * 0.35) then 3 when rank <= ceil(n * 0.65) then 4 else 5 end as tier from k)
"""


def _tiers(t):
    return ranking.cut_tiers(_r(_priorities(t), "score"), [F.desc("score"), F.asc("c_custkey")])


@query(_TIERS + "select c_custkey, rank, tier from tr")
def q_tier_cut(t):
    return _tiers(t).select("c_custkey", F.col("rank").cast("bigint").alias("rank"), "tier")


@query(_TIERS + "select tier, c_nationkey < 15 as wide, count(*) as n, round(median(round(score, 4)), 4) as median, round(avg(round(score, 4)), 4) as mean, round(max(score), 4) as max from tr group by 1, 2")
def q_tier_summary(t):
    return _r(rollups.summary(_tiers(t).withColumn("wide", F.col("c_nationkey") < 15), "score", "all", "tier", "wide").drop("sample"), "median", "mean", "max")


@query(_TIERS + "select c_nationkey, " + ", ".join(f"count(*) filter (where tier = {i}) as tier{i}" for i in range(1, 6)) + ", round(count(*) filter (where tier <= 2) / count(*), 4) as top_share from tr group by 1")
def q_state_pivot(t):
    n = [F.count_if(F.col("tier") == i).alias(f"tier{i}") for i in range(1, 6)]
    return _tiers(t).groupBy("c_nationkey").agg(*n, F.round(F.count_if(F.col("tier") <= 2) / F.count("*"), 4).alias("top_share"))


@query(_PRIO + """, k as (select c_custkey, row_number() over (order by round(score, 4) desc, c_custkey) as r0, row_number() over (order by round(pop_heavier, 4) desc, c_custkey) as r1, row_number() over (order by round(yield_heavier, 4) desc, c_custkey) as r2 from f)
select c_custkey, r0 as rank_score, r1 as rank_pop_heavier, r2 as rank_yield_heavier, greatest(r0, r1, r2) <= 500 as in_all, greatest(abs(r1 - r0), abs(r2 - r0)) as displacement from k where least(r0, r1, r2) <= 500""")
def q_rank_variants(t):
    names = ["score", *scoring.PRIORITY_VARIANTS]
    out = ranking.rank_variants(_priorities(t), "c_custkey", {k: F.round(k, 4) for k in names}, ["c_custkey"], 500)[1]
    return out.select("c_custkey", *[F.col(f"rank_{k}").cast("bigint").alias(f"rank_{k}") for k in names], "in_all", F.col("displacement").cast("bigint").alias("displacement"))


@query("""
with c as (select p_partkey, p_size % 5 as tier, p_brand, p_retailprice, row_number() over (partition by p_size % 5, p_brand order by p_retailprice desc, p_partkey) as cycle from part)
select p_partkey, tier, cycle, row_number() over (partition by tier order by cycle, p_retailprice desc, p_partkey) as position from c""")
def q_diversified_order(t):
    p = t("part").select("p_partkey", (F.col("p_size") % 5).alias("tier"), "p_brand", "p_retailprice")
    out = ranking.round_robin(p, "tier", "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")])
    return out.select("p_partkey", "tier", F.col("cycle").cast("bigint").alias("cycle"), F.col("position").cast("bigint").alias("position"))


@query("""
select p_partkey, position, ((position - 1) // 50 + 1)::int as slice, ((position - 1) % 3 + 1)::int as hand, ((position - 1) % 50 + 1)::int as row_in_slice from (select p_partkey, row_number() over (order by p_retailprice desc, p_partkey) as position from part) where position <= 150""")
def q_batches(t):
    top = ranking.top(t("part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 150)
    p = F.col("position")
    return top.select("p_partkey", p.cast("bigint").alias("position"), ranking.slices(p, 50).alias("slice"), ranking.dealt(p, 3).cast("int").alias("hand"), ranking.dealt(p, 50).cast("int").alias("row_in_slice"))


@query("select o_orderkey, position from (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as position from orders) where position <= 500")
def q_topk(t):
    return ranking.top(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 500).select("o_orderkey", F.col("position").cast("bigint").alias("position"))


@query("select o_custkey, o_orderkey, position from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as position from orders) where position <= 3")
def q_top_per_group(t):
    out = ranking.top_per_group(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return out.select("o_custkey", "o_orderkey", F.col("position").cast("bigint").alias("position"))


@query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as position from orders")
def q_global_position(t):
    return ranking.position(t("orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", F.col("position").cast("bigint").alias("position"))


@query("select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) - 1 as seq, printf('C-%d-%s-%04d', conv_id, role, row_number() over (partition by conv_id, role order by turn) - 1) as id from conversations")
def q_sequence_ids(t):
    c = ranking.sequence_in(t("conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], "turn")
    return c.select("conv_id", "turn", "role", F.col("seq").cast("bigint").alias("seq"), F.concat_ws("-", F.lit("C"), "conv_id", "role", F.format_string("%04d", "seq")).alias("id"))


@query("""
with p(mode, pi, po, pr) as (values ('included_in_output', 0.2, 1.25, null), ('billed_as_output', 0.2, 1.25, null), ('separate', 0.2, 1.25, 2.5)),
l as (select *, case l_linenumber % 4 when 0 then 'included_in_output' when 1 then 'billed_as_output' when 2 then 'separate' else 'none' end as mode, l_quantity * 1000 as ti, l_extendedprice as tk, l_discount * 1000 as tr from lineitem)
select l.mode, count(*) as n, count(pi) as n_priced, round(sum(case l.mode when 'included_in_output' then (ti * pi + tk * po) / 1e6 when 'billed_as_output' then (ti * pi + (tk + tr) * po) / 1e6 when 'separate' then (ti * pi + tk * po + tr * pr) / 1e6 end), 4) as cost, sum(l_extendedprice::decimal(38, 2))::double as tokens from l left join p on p.mode = l.mode group by 1""")
def q_cost_modes(t):
    modes = ["included_in_output", "billed_as_output", "separate", "none"]
    x = t("lineitem").select(
        F.element_at(F.array(*[F.lit(m) for m in modes]), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("mode"), (F.col("l_quantity") * 1000).alias("ti"), F.col("l_extendedprice").alias("tk"), (F.col("l_discount") * 1000).alias("tr"),
    )
    known = F.col("mode") != "none"
    price = lambda v: F.when(known, F.lit(v))
    cost = values.estimated_cost(F.col("ti"), F.col("tk"), F.col("tr"), price(0.2), price(1.25), F.lit(2.5), F.col("mode"))
    return x.groupBy("mode").agg(F.count("*").alias("n"), F.count(cost).alias("n_priced"), F.round(F.sum(cost), 4).alias("cost"), rollups.exact_sum_or_blank(F.col("tk"), "decimal(38,2)").cast("double").alias("tokens"))


@query("""
select event_type, case when value < 5 then '0-5' when value < 10 then '5-10' when value < 15 then '10-15' when value < 25 then '15-25' when value < 40 then '25-40' when value < 55 then '40-55' when value < 70 then '55-70' when value < 85 then '70-85' when value <= 100 then '85-100' end as bin, count(*) as n from events group by 1, 2""")
def q_histogram(t):
    b = rollups.histogram(F.col("value"), [0, 5, 10, 15, 25, 40, 55, 70, 85, 100])
    return t("events").select("event_type", b.alias("bin")).groupBy("event_type", "bin").agg(F.count("*").alias("n"))


@query("select k as event_type, (select count(*) from events where event_type = k) as n from (values ('click'), ('error'), ('never'), ('purchase')) v(k)")
def q_fixed_keys(t):
    return rollups.fixed_keys(t("events").select("event_type"), "event_type", ["click", "error", "never", "purchase"])


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(*) filter (where event_type <> 'error') as n_parseable, round(count(*) filter (where event_type <> 'error') * 100.0 / count(*), 1)::varchar || '%' as parse_rate from events group by 1")
def q_run_compare(t):
    return ledgers.run_comparison(t("events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type"), "day", F.col("event_type") != "error")


_SAMPLES = {"all": "true", "urgent": "o_orderpriority = '1-URGENT'", "open": "o_orderstatus = 'O'", "large": "o_totalprice > 200000", "small": "o_totalprice < 20000", "closed": "o_orderstatus = 'F'"}


@query(" union all ".join(f"select '{k}' as sample, count(*) as n, round(avg(o_totalprice), 3) as mean, round(median(o_totalprice), 3) as median, max(o_totalprice) as max from orders where {c}" for k, c in _SAMPLES.items()))
def q_sensitivity_union(t):
    return _r(rollups.sensitivity(t("orders"), "o_totalprice", {k: F.expr(c) for k, c in _SAMPLES.items()}), "mean", "median", places=3)


@query("select o_orderstatus, count(*) as n, round(avg(m), 3) as mean, round(median(m), 3) as median from (select o_custkey, o_orderstatus, avg(o_totalprice) as m from orders group by 1, 2) group by 1")
def q_means_of_means(t):
    return _r(rollups.means_of_means(t("orders"), "o_totalprice", ["o_custkey", "o_orderstatus"], "o_orderstatus"), "mean", "median", places=3)


@query("""
select 1 as step, 'customers' as stage, count(*)::double as value from customer union all select 2, 'with_orders', count(distinct o_custkey) from orders join customer on c_custkey = o_custkey
union all select 3, 'open', count(distinct o_custkey) from orders join customer on c_custkey = o_custkey where o_orderstatus = 'O' union all select 4, 'large', count(distinct o_custkey) from orders join customer on c_custkey = o_custkey where o_totalprice > 200000""")
def q_funnel(t):
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))
    c = t("customer").select("c_custkey").join(o, "c_custkey", "left")
    return rollups.long_totals(c, {"customers": F.count("*"), "with_orders": F.count("n"), "open": F.count_if(F.col("open") > 0), "large": F.count_if(F.col("large") > 0)})


@query("select n_nationkey, v, case when v is null or v <= 0 then 0 when v / max(v) over () <= 0.25 then 1 when v / max(v) over () <= 0.5 then 2 when v / max(v) over () <= 0.75 then 3 else 4 end as band from (select n_nationkey, count(c_custkey) as v from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 4000 + n_nationkey * 250 group by 1)")
def q_mapbands(t):
    c = t("customer").withColumnRenamed("c_nationkey", "n_nationkey").filter(F.col("c_acctbal") > 4000 + F.col("n_nationkey") * 250)
    v = rollups.rollup_all(t("nation").select("n_nationkey"), "n_nationkey", c, {"v": F.count("*")})
    top = v.agg(F.max("v").alias("top"))
    return v.crossJoin(F.broadcast(top)).select("n_nationkey", "v", values.quarter_band(F.col("v"), F.col("top")).alias("band"))  # one row


@query("""
select 'c_mktsegment' as facet, c_mktsegment as value, count(*) as n from o where o_orderstatus = 'F' group by 2 union all select 'o_orderstatus', o_orderstatus, count(*) from o where c_mktsegment = 'BUILDING' group by 2
union all select 'o_orderpriority', o_orderpriority, count(*) from o where o_orderstatus = 'F' and c_mktsegment = 'BUILDING' group by 2""".replace("from o ", "from (select * from orders join customer on c_custkey = o_custkey) o "))
def q_facets(t):
    o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rollups.facets(o, ["c_mktsegment", "o_orderstatus", "o_orderpriority"], {"o_orderstatus": "F", "c_mktsegment": "BUILDING"})


@query("select n_nationkey, dominant, round(share, 6) as share from (select c_nationkey as n_nationkey, c_mktsegment as dominant, count(*) / sum(count(*)) over (partition by c_nationkey) as share, row_number() over (partition by c_nationkey order by count(*) desc, c_mktsegment) as n from customer group by 1, 2) where n = 1")
def q_dominant(t):
    return _r(rollups.dominant(t("customer").withColumnRenamed("c_nationkey", "n_nationkey"), ["n_nationkey"], "c_mktsegment"), "share", places=6)


@query("select event_type, count(value) as n, round(avg(value), 4) as mean_s, round(median(value), 4) as median_s, round(min(value), 4) as min_s, round(max(value), 4) as max_s, round(count(*) * 3600.0 / sum(value), 4) as rows_per_hour from events group by 1")
def q_timing_summary(t):
    out = ledgers.timing_summary(t("events").withColumn("one", F.lit(1)), ["event_type"], "value", "one")
    return _r(out, "mean_s", "median_s", "min_s", "max_s", "rows_per_hour")


@query("select c_nationkey, string_agg(c_custkey::varchar || ' ' || c_mktsegment, '; ' order by c_acctbal <= 9000, c_custkey) as context from customer group by 1")
def q_hints(t):
    c = t("customer")
    return evidence.ordered_context(c, "c_nationkey", F.col("c_acctbal") > 9000, "c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(" "), "c_mktsegment"))


@query("select 'large' as condition, o_custkey from orders where o_totalprice > 250000 group by 2 union all select 'urgent', o_custkey from orders where o_orderpriority = '1-URGENT' group by 2")
def q_condition_sets(t):
    return rollups.sets_by_condition(t("orders"), "o_custkey", {"large": F.col("o_totalprice") > 250000, "urgent": F.col("o_orderpriority") == "1-URGENT"})
