"""Bindings: interval matching, joins, constraints, selection and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, ledgers, matching, ranking, rollups, scoring
from .registry import query

URGENT = ["1-URGENT", "2-HIGH"]
_SPANS = """
with spans as (
  select o_orderkey, o_custkey, o_orderpriority as class, strftime(least(o_orderdate, m), '%Y-%m-%d') as s, strftime(greatest(o_orderdate, m), '%Y-%m-%d') as e
  from orders join (select l_orderkey, max(l_shipdate) as m from lineitem group by 1) on l_orderkey = o_orderkey),
pairs as (
  select l.o_orderkey as k, r.o_orderkey as m, r.class as c, left(r.s, 4) || '-' || left(r.e, 4) as w,
    case when left(l.s, 4) = left(r.s, 4) and left(l.e, 4) = left(r.e, 4) then 3
         when greatest(l.s, r.s) <= least(l.e, r.e) then 2
         when (case when r.s > l.e then date_diff('day', l.e::date, r.s::date) else date_diff('day', r.e::date, l.s::date) end) <= 730 then 1 else 0 end as t
  from spans l join spans r on l.o_custkey = r.o_custkey where l.class in ('1-URGENT', '2-HIGH') and r.class not in ('1-URGENT', '2-HIGH')),
best as (select k, max(t) as t from pairs where t > 0 group by 1)
"""


def _spans(t):
    last = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("m"))
    o = t("orders").join(last, F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    spans = o.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("class"), day(F.least("o_orderdate", "m")).alias("s"), day(F.greatest("o_orderdate", "m")).alias("e"))
    return spans.filter(F.col("class").isin(URGENT)), spans.filter(~F.col("class").isin(URGENT))


@query(_SPANS + """
select s.o_orderkey, case coalesce(b.t, 0) when 3 then 'exact' when 2 then 'overlap' when 1 then 'adjacent' else 'unmatched' end as tier,
  count(p.k) as n_matches, coalesce(string_agg(distinct p.c, '; ' order by p.c), '') as match_classes, coalesce(string_agg(distinct p.w, '; ' order by p.w), '') as match_cycles
from spans s left join best b on b.k = s.o_orderkey left join pairs p on p.k = b.k and p.t = b.t
where s.class in ('1-URGENT', '2-HIGH') group by all""")
def q_match_tiers(t):
    a, b = _spans(t)
    return matching.match_tiers(a, b, "o_custkey", "s", "e", "o_orderkey", "class", ids=False)


@query(_SPANS + """
select s.o_orderkey, coalesce(string_agg(p.m::varchar, ';' order by p.m), '') as match_ids from spans s
left join best b on b.k = s.o_orderkey left join pairs p on p.k = b.k and p.t = b.t where s.class in ('1-URGENT', '2-HIGH') group by 1""")
def q_match_pairs(t):
    a, b = _spans(t)
    return matching.match_tiers(a, b, "o_custkey", "s", "e", "o_orderkey", "class").select("o_orderkey", F.array_join(F.col("match_ids").cast("array<string>"), ";").alias("match_ids"))


@query(_SPANS + """
select case coalesce(b.t, 0) when 3 then 'exact' when 2 then 'overlap' when 1 then 'adjacent' else 'unmatched' end as tier, count(*) as n
from spans s left join best b on b.k = s.o_orderkey where s.class in ('1-URGENT', '2-HIGH') group by 1""")
def q_unmatched_report(t):
    a, b = _spans(t)
    return matching.match_tiers(a, b, "o_custkey", "s", "e", "o_orderkey", "class", ids=False).groupBy("tier").agg(F.count("*").alias("n"))


@query("""
with o as (select o_orderkey, case when o_orderkey % 97 = 0 then '' else o_orderstatus end as st, case when o_orderkey % 89 = 0 then '2020-02-30' when o_orderkey % 83 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as d, case when o_orderkey % 79 = 0 then 'abc' else o_totalprice::varchar end as p from orders)
select 'required' as "check", o_orderkey::varchar as "row", 'st' as field, 'missing' as message from o where st = ''
union all select 'required', o_orderkey::varchar, 'd', 'missing' from o where d is null
union all select 'allowed', o_orderkey::varchar, 'st', 'not allowed: ' || st from o where st <> '' and st not in ('O', 'F')
union all select 'date', o_orderkey::varchar, 'd', 'no date: ' || d from o where d = '2020-02-30'
union all select 'range', o_orderkey::varchar, 'p', case when try_cast(p as double) is null then 'not a number' else 'out of range' end from o where not coalesce(try_cast(p as double) between 1000 and 300000, false)""")
def q_required_violations(t):
    k = F.col("o_orderkey")
    o = t("orders").select(
        "o_orderkey", F.when(k % 97 == 0, "").otherwise(F.col("o_orderstatus")).alias("st"),
        F.when(k % 89 == 0, "2020-02-30").when(k % 83 == 0, None).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
        F.when(k % 79 == 0, "abc").otherwise(F.col("o_totalprice").cast("string")).alias("p"),
    )
    r = "o_orderkey"
    found = [checks.required(o, r, ["st", "d"]), checks.allowed(o, r, {"st": ["O", "F"]}), checks.dates(o, r, ["d"]), checks.in_range(o, r, {"p": (1000, 300000)})]
    return checks.report(*found)


@query("""
select 'unique' as "check", doc_id::varchar as "row", 'text' as field, 'repeats row ' || f::varchar as message
from (select doc_id, text, min(doc_id) over (partition by text) as f, row_number() over (partition by text order by doc_id) as n from documents) where n > 1 and text <> ''""")
def q_unique_violations(t):
    return checks.unique(t("documents").select("doc_id", "text"), "doc_id", ["text"])


@query("""
select 'reference' as "check", (l_orderkey * 10 + l_linenumber)::varchar as "row", 'ref' as field, 'unknown ' || ref::varchar as message
from (select *, l_partkey + case when l_orderkey % 7 = 0 then 1000000 else 0 end as ref from lineitem) where ref not in (select p_partkey from part)""")
def q_fk_violations(t):
    x = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") + F.when(F.col("l_orderkey") % 7 == 0, 1000000).otherwise(0)).alias("ref"))
    return checks.resolves(x, "id", "ref", t("part"), "p_partkey")


@query("""
select 'flag' as "check", doc_id::varchar as "row", 'quality' as field, 'does not match its class' as message
from documents join labels using (doc_id) where lang in ('en', 'de') and quality <> case when n_chars >= 300 then 1 else 0 end""")
def q_flag_consistency(t):
    d = t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id")
    return checks.flag_agrees(d, "doc_id", "quality", F.col("n_chars") >= 300, F.col("lang").isin("en", "de"))


@query("""
select * from (select 'orders' as name, (select count(*) from orders)::double as expected, (select count(distinct l_orderkey) from lineitem)::double as actual union all select 'keys', 0.0, (count(*) - count(distinct o_orderkey))::double from orders
union all select 'customers', (select count(*) from customer)::double, (select count(distinct o_custkey) from orders)::double), lateral (select expected = actual as ok)""")
def q_reconciliation(t):
    o = t("orders")
    items, buyers = t("lineitem").agg(F.count_distinct("l_orderkey")), o.agg(F.count_distinct("o_custkey"))
    return checks.reconcile([("orders", items, o.count()), ("keys", rollups.surplus(o, "o_orderkey"), 0), ("customers", buyers, t("customer").count())])


@query("""
select c_custkey, concat_ws(';', case when c_custkey % 6 = 0 then 'c_mktsegment' end, case when n_name is null then 'n_name' end) as problems
from customer left join nation on n_nationkey = c_nationkey and n_regionkey <> 3 where n_name is null or c_custkey % 6 = 0""")
def q_missing_fields(t):
    n = t("nation").filter("n_regionkey <> 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = t("customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 6 == 0, " ").otherwise(F.col("c_mktsegment")))
    bad = checks.missing_fields(["c_mktsegment", "n_name", "c_name"])
    return matching.labels_of(c, n, "c_nationkey").select("c_custkey", bad.alias("r")).filter(F.size("r") > 0).select("c_custkey", F.array_join("r", ";").alias("problems"))


_TESTS = {"balance": "c_acctbal > 0", "segment": "c_mktsegment in ('BUILDING', 'AUTOMOBILE', 'MACHINERY')", "nation": "c_nationkey between 3 and 20", "no_orders": "not is_known"}
_ANTI = """with c as (select c.*, exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000) as known from customer c),
r as (select c_custkey, unnest(list_filter([case when not c_acctbal > 0 then 'balance' end, case when c_mktsegment not in ('BUILDING', 'AUTOMOBILE', 'MACHINERY') then 'segment' end, case when c_nationkey not between 3 and 20 then 'nation' end, case when known then 'no_orders' end], lambda x: x is not null)) as reason from c)
"""


def _customers(t):
    big = t("orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return matching.flag_known(t("customer"), big, "c_custkey")


@query(_ANTI + "select reason, count(*) as n from r group by 1")
def q_anti_select(t):
    return scoring.count_reasons(_customers(t), _TESTS)


@query(_ANTI + "select c_custkey, c_name from c where c_custkey not in (select c_custkey from r)")
def q_eligible(t):
    return _customers(t).filter(F.size(scoring.reasons(_TESTS)) == 0).select("c_custkey", "c_name")


@query("""
with old as (select o_orderkey as k, o_totalprice as v, 'old' as src from orders where o_orderkey % 3 <> 0),
new as (select o_orderkey as k, max(o_totalprice + l_linenumber) as v, 'new' as src from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 2 = 0 group by 1)
select k, round(v, 2) as v, src from new union all select k, round(v, 2), src from old where k not in (select k from new)""")
def q_upsert(t):
    o = t("orders")
    old = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit(0).alias("seq"), F.lit("old").alias("src"))
    lines = t("lineitem").filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    new = o.join(lines, "o_orderkey").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + F.col("l_linenumber")).alias("v"), F.col("l_linenumber").alias("seq"), F.lit("new").alias("src"))
    return ledgers.upsert(old, new, ["k"], "seq").select("k", F.round("v", 2).alias("v"), "src")


@query("select min(doc_id) as doc_id, count(*) - 1 as skipped, md5(text) as text_md5 from documents group by text")
def q_first_dedupe(t):
    return ranking.dedupe_rows(t("documents").select("doc_id", F.md5("text").alias("text_md5")), ["text_md5"], "doc_id")


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def q_last_dedupe(t):
    e = t("events").select("user_id", "event_type", "event_id", "ts")
    return ranking.first_per_key(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""
select o_orderkey, case when s is null then 'run' when s = 'success' then 'skip' when f in ('timeout', 'connection') then 'retry' else 'hold' end as action
from orders left join (select o_orderkey as k, case when o_orderkey % 5 < 3 then 'success' else 'failed' end as s, case o_orderkey % 5 when 3 then 'timeout' when 4 then 'parse' end as f from orders where o_orderkey % 4 <> 0) on k = o_orderkey""")
def q_resume_plan(t):
    o, k = t("orders").select("o_orderkey"), F.col("o_orderkey")
    prior = o.filter(k % 4 != 0).select("o_orderkey", F.when(k % 5 < 3, "success").otherwise("failed").alias("s"), F.when(k % 5 == 3, "timeout").when(k % 5 == 4, "parse").alias("f"))
    return ledgers.resume_plan(o, prior, "o_orderkey", "s", "f", ("timeout", "connection"))


@query("""
with r as (select event_id, user_id % 50 as k, case when event_id % 11 = 0 then '' else event_type end as et from events)
select event_id, case when k < 10 then 'duplicate' when et = '' or row_number() over (partition by k order by event_id) > 1 then 'quarantined' else 'ingested' end as decision from r""")
def q_ingest_decisions(t):
    e = t("events").select("event_id", (F.col("user_id") % 50).alias("k"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_type")).alias("et"))
    known = t("events").select((F.col("user_id") % 10).alias("k"))
    return ledgers.ingest_decisions(e, known, "k", "event_id", checks.missing_fields(["et"])).select("event_id", "decision")


_GATE = """with e as (select user_id, event_id, ts, event_type = 'error' as f from events),
g as (select *, sum(case when f then 0 else 1 end) over (partition by user_id order by ts, event_id) as g from e),
r as (select *, sum(f::int) over (partition by user_id, g order by ts, event_id) as run from g)
"""


@query(_GATE + "select event_id, run::bigint as failures_in_a_row, coalesce(max(run >= 2) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) as stopped from r")
def q_stop_gate(t):
    e = t("events").select("user_id", "event_id", F.struct("ts", "event_id").alias("o"), (F.col("event_type") == "error").alias("f"))
    return ranking.stop_gate(e, ["user_id"], "o", F.col("f")).select("event_id", "failures_in_a_row", "stopped")


@query("""
with recursive e as (select user_id % 20 as run, event_id, event_type = 'error' as f, row_number() over (partition by user_id % 20 order by event_id) as n from events),
s as (select run, 0::bigint as n, null::bigint as event_id, 5.0::double as pause, 0 as calm, 0 as strikes, '' as event from e group by run
union all select e.run, e.n, e.event_id,
  case when f then least(15, greatest(pause, case when strikes + 1 >= 2 then 15 else 10 end)) when calm + 1 >= 5 then greatest(3, pause - 1) else pause end::double,
  case when f or calm + 1 >= 5 then 0 else calm + 1 end, case when f then strikes + 1 else 0 end,
  case when f and pause < case when strikes + 1 >= 2 then 15 else 10 end then 'backoff' when f then 'backoff_held' when calm + 1 >= 5 and pause > 3 then 'stable_step_down' when calm + 1 >= 5 then 'stable_at_min' else 'stable_hold' end
from s join e on e.run = s.run and e.n = s.n + 1)
select run, event_id, pause, event from s where n > 0""")
def q_pacing(t):
    e = t("events").select((F.col("user_id") % 20).alias("run"), "event_id", F.col("event_type"))
    return ledgers.pacing(e, ["run"], "event_id", F.col("event_type") == "error", stable=5)


@query("""
select c_custkey, count(*) as n_listed, round(avg(o_totalprice), 2) as mean_score, round(max(o_totalprice), 2) as best_score from
(select c_custkey, unnest(string_split(ids, ';')) as id from (select o_custkey as c_custkey, string_agg((o_orderkey + o_orderkey % 3 * 1000000)::varchar, ';') as ids from orders group by 1)) left join orders on o_orderkey = id::bigint group by 1""")
def q_explode_join(t):
    o = t("orders")
    lists = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.collect_list((F.col("o_orderkey") + F.col("o_orderkey") % 3 * 1000000).cast("string")), ";").alias("ids"))
    ids = lists.select("c_custkey", F.split("ids", ";").cast("array<bigint>").alias("ids"))
    out = matching.explode_and_score(ids, "ids", o, "o_orderkey", "o_totalprice", "c_custkey")
    return out.select("c_custkey", "n_listed", F.round("mean_score", 2).alias("mean_score"), F.round("best_score", 2).alias("best_score"))


@query("""
with u as (select s_suppkey as id, s_nationkey as st, s_suppkey % 12 as nk, s_acctbal > 5000 as pref from supplier), g as (select st, nk, count(*) as n, min(id) as id, count(*) filter (where pref) as np, min(id) filter (where pref) as pid from u group by 1, 2)
select c_custkey, case when n = 1 then 'unique' when np = 1 then 'preferred' when n > 1 then 'ambiguous' else 'none' end as resolution, case when n = 1 then id when np = 1 then pid end as resolved_id
from customer left join g on st = c_nationkey and nk = c_custkey % 12""")
def q_resolve_names(t):
    u = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("st"), (F.col("s_suppkey") % 12).alias("nk"), (F.col("s_acctbal") > 5000).alias("pref"))
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("st"), (F.col("c_custkey") % 12).alias("nk"))
    return matching.resolve_names(c, u, "st", "nk", F.col("pref")).select("c_custkey", "resolution", "resolved_id")


@query("""
select k, max_by(bal, o) as bal, min_by(note, o) as note, string_agg(distinct src, '; ' order by src) as src from (
select c_nationkey as k, max(c_acctbal) as bal, null as note, 'a_customer' as src, 0 as o from customer group by 1 union all select s_nationkey, max(s_acctbal), 'supplied', 'b_supplier', 1 from supplier group by 1
union all select n_nationkey, null, n_name, 'c_nation', 2 from nation) group by 1""".replace("max_by(bal, o)", "max_by(bal, case when bal is not null then o end)").replace("min_by(note, o)", "min_by(note, case when note is not null then o end)"))
def q_merge_sources(t):
    a = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("bal")).withColumns({"note": F.lit(None).cast("string"), "src": F.lit("a_customer")})
    b = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("bal")).withColumns({"note": F.lit("supplied"), "src": F.lit("b_supplier")})
    c = t("nation").select(F.col("n_nationkey").alias("k"), F.lit(None).cast("double").alias("bal"), F.col("n_name").alias("note"), F.lit("c_nation").alias("src"))
    return matching.merge_sources([a, b, c], "k", ["bal"], ["note"], "src")


@query("""
with a as (select c_custkey as k from customer where c_custkey % 10 <> 0), b as (select distinct o_custkey as k from orders where o_custkey % 7 <> 0)
select 'left' as only_in, k from a where k not in (select k from b) union all select 'right', k from b where k not in (select k from a)""")
def q_set_equality(t):
    a = t("customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("k"))
    return checks.same_ids(a, t("orders").filter("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("k")), "k").select("only_in", "k")


@query("select a.o_orderkey, 'o_orderstatus' as field, a.o_orderstatus as \"left\", 'X' as \"right\" from orders a where o_orderkey % 10 = 0 and o_orderstatus <> 'X'")
def q_field_drift(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")))
    return checks.same_values(o, changed, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("select c_mktsegment, count(*) as \"count\", round(count(*) / sum(count(*)) over (), 6) as share from customer group by 1 qualify count(*) > 250 or count(*) / sum(count(*)) over () > 0.205")
def q_concentration(t):
    return checks.concentrated(t("customer"), "c_mktsegment", 250, 0.205).withColumn("share", F.round("share", 6))
