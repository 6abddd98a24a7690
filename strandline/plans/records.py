"""Bindings: record operators, column functions, scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import clauses, nested, strings, values
from ..operators import checks, evidence, ledgers, matching, ranking, records, rollups, scoring, selection
from ..sources import sinks, stages, tables
from .registry import query

@query("select c_custkey from customer where c_custkey % 2 > 0 and c_custkey % 3 = 0")
def q_failures_only(t):
    c = t("customer").select("c_custkey", (F.col("c_custkey") % 3).alias("ok"), (F.col("c_custkey") % 2).alias("bad"))
    return records.failures_only(c, "ok", "bad").select("c_custkey")


@query("select c_custkey, c_acctbal from customer where c_acctbal >= 0")
def q_valid_scores(t):
    return records.valid_scores(t("customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query("select c_nationkey, count(*) as n, count(*) filter (where c_custkey % 7 = 0) as dropped from customer group by 1")
def q_without_locator(t):
    c = t("customer").select("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_name")).alias("url"))
    return records.without_locator(c, "url", "c_nationkey")[1]


@query("select user_id, count(*) as n, round(sum(value) / count(*), 6) as density from events group by 1 having count(*) >= 10")
def q_leaderboard(t):
    e = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value") / F.count("*"), 6).alias("density"))
    return records.leaderboard(e, "n", [F.desc("density"), F.asc("user_id")])


@query("select doc_id, regexp_matches(lower(text), 'foia|public records request|prr|opra|rtkl|records request') as asks, doc_id % 2 = 0 and doc_id % 3 < 2 as wrong from documents")
def q_request_and_unit_marks(t):
    k = F.col("doc_id")
    given, told = F.when(k % 2 == 0, "non_safety").otherwise("police"), F.when(k % 3 == 0, "fire").when(k % 3 == 1, " police").otherwise("non_safety")
    return t("documents").select("doc_id", records.mentions_request(F.col("text")).alias("asks"), records.wrong_unit(given, told).alias("wrong"))


@query("select c_custkey, case c_nationkey when 1 then 'AA' when 2 then 'BB' else 'CC' end as jurisdiction from customer where c_nationkey in (1, 2, 3) and c_mktsegment in ('BUILDING', 'MACHINERY') and c_custkey % 4 <> 0")
def q_in_scope_units(t):
    c = t("customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("area"), "c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "N").otherwise("Y").alias("active"))
    rows, again = records.in_scope_units(c, "area", {"1": "AA", "2": "BB", "3": "CC"}, "c_mktsegment", ("BUILDING", "MACHINERY"), "active", "c_custkey")
    return selection.gate(rows, again, "repeated ids").select("c_custkey", "jurisdiction")


@query("select distinct o_custkey as k from orders where o_totalprice > 300000 union select c_custkey from customer where c_acctbal > 5000")
def q_ids_of_files(t):
    o, c = t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), t("customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return records.ids_of([o, c], "k")


@query("""
select c_custkey, case when c_custkey % 5 = 0 then 0 else c_custkey end as covered, case when c_custkey % 5 <> 0 then c_custkey::double end as score, case when c_custkey % 4 <> 0 then round(100.0 * (c_custkey / 8192.0), 4) end as positive_pct,
  case when c_custkey % 4 = 0 then 0.0 else round(100.0 * (c_custkey / 8192.0), 4) end as coverage_pct, c_custkey % 3 = 0 as retry, case when c_custkey % 5 = 0 then 0 else 2 * c_custkey end as both from customer""")
def q_typed_projection(t):
    k = F.col("c_custkey")
    text = t("customer").select("c_custkey", F.when(k % 5 == 0, "").otherwise(k.cast("string")).alias("n"), F.when(k % 4 == 0, "").otherwise((k / 8192).cast("string")).alias("rate"), F.when(k % 3 == 0, "yes").otherwise("no").alias("flag"))
    fields = {"c_custkey": ("c_custkey", "int0"), "covered": ("n", "int0"), "score": ("n", "float"), "positive_pct": ("rate", "percent"), "coverage_pct": ("rate", "percent0"), "retry": ("flag", "yes")}
    return records.project(text, fields, {"both": "covered + covered"})


@query("select * from (select n_nationkey, n_name from nation where n_name = (select n_name from nation where n_nationkey = 5)) union all select n_nationkey, n_name from nation where n_nationkey = 0")
def q_selected_or_first(t):
    n = t("nation").select("n_nationkey", "n_name")
    name = n.filter("n_nationkey = 5").first()[1]
    there = records.selected_or_first(n, "n_name", name, F.col("n_nationkey"))
    return there.unionByName(records.selected_or_first(n, "n_name", "nowhere", F.col("n_nationkey")))


@query("""
select event_type, count(*) as n, round(sum(value), 4) as total_cost, round(sum(value) filter (where user_id % 2 = 0), 4) as parsed_seconds, round(sum(value) / count(*) * 100, 4) as estimated_cost,
  round((sum(value) filter (where user_id % 2 = 0) / count(*) filter (where user_id % 2 = 0) + 5) * 100, 4) as estimated_seconds from events group by 1""")
def q_extrapolated(t):
    out = records.extrapolated(t("events"), "event_type", "value", "value", F.col("user_id") % 2 == 0)
    return out.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("total_cost", "parsed_seconds", "estimated_cost", "estimated_seconds")])


@query("""
with p as (select o_orderkey, case when o_orderkey % 3 = 0 then 'skip' else 'run' end as action, case when o_orderkey % 5 <> 0 then o_orderkey::varchar end as k from orders),
k as (select *, ((row_number() over (partition by action order by o_orderkey) - 1) // 10000 + 1)::int as part from p where k is not null)
select action, n, coalesce(part, 1) as part, coalesce(keys, '') as keys from (select action, count(*) as n from p group by 1) left join (select action, part, string_agg(k, ';' order by o_orderkey) as keys from k group by 1, 2) using (action)""")
def q_action_summary(t):
    k = F.col("o_orderkey")
    plan = t("orders").select("o_orderkey", F.when(k % 3 == 0, "skip").otherwise("run").alias("action"), F.when(k % 5 == 0, "").otherwise(k.cast("string")).alias("id"))
    return records.action_summary(plan, "id", "action", "o_orderkey").select("action", "n", "part", F.array_join("keys", ";").alias("keys"))


@query("""
select count(*) as n, count(*) filter (where p) as present, count(*) filter (where not p) as not_found, count(*) filter (where p and quality = 1) as verified_present, count(*) filter (where p) - count(*) filter (where p and quality = 1) as unverified_present,
  count(*) filter (where toxic = 1) as flagged, count(*) filter (where doc_id % 2 = 0) as labelled from (select *, doc_id % 3 = 0 as p from labels)""")
def q_evidence_counts(t):
    d = t("labels").withColumn("st", F.when(F.col("doc_id") % 3 == 0, "present").otherwise("not_found"))
    return records.evidence_counts(d, "st", (F.col("st") == "present") & (F.col("quality") == 1), F.col("toxic") == 1, F.col("doc_id") % 2 == 0)


@query("""
with p as (select n_nationkey as pick, n_nationkey % 5 as reg, n_name as nm from nation union all select 100, 9, 'nowhere'),
u as (select c_nationkey as k, count(*) as links from customer group by 1)
select pick, k, concat_ws(';', case when k is null then 'not_one_match' end, case when k is not null and k % 4 = 0 then 'not_untouched' end, case when k is not null and k % 6 = 1 then 'failed_before' end, case when k % 10 = 3 then 'in_queue' end,
  case when k is not null and k % 7 = 2 then 'in_corpus' end, case when pick = 11 then 'banned_name' end, case when k is not null and k % 9 = 8 then 'link_mismatch' end) as faults
from (select pick, case when pick < 100 and pick % 13 <> 12 then pick end as k from p)""")
def q_pick_named(t):
    n = t("nation").select("n_nationkey", F.col("n_name").alias("nm"))
    k = F.col("n_nationkey")
    picks = n.select(k.alias("pick"), "nm").unionByName(t("region").limit(1).select(F.lit(100).alias("pick"), F.lit("nowhere").alias("nm")))
    size = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).count()
    universe = n.join(size, "n_nationkey").select(k.alias("id"), "nm", (F.col("count") + F.when(k % 9 == 8, 1).otherwise(0)).alias("links"), F.when(k % 13 == 12, "township").otherwise("municipal").alias("kind"))
    coverage = n.select(k.alias("id"), F.when(k % 4 == 0, "done").otherwise("not_scouted").alias("status"), F.when(k % 6 == 1, 2).otherwise(0).alias("failed"), F.when(k % 7 == 2, "yes").otherwise("no").alias("in_corpus"))
    banned = n.filter("n_nationkey = 11").first()[1]
    out = records.pick_named(picks, universe, ["nm"], "id", coverage, n.filter("n_nationkey % 10 = 3").select(k.alias("id")), t("customer").select(F.col("c_nationkey").alias("id")), F.col("kind") == "municipal", (banned,), "nm", "links")
    return out.select("pick", F.col("id").alias("k"), F.array_join("faults", ";").alias("faults"))


@query("""
select c_custkey, position, case when position <= 10 then 'largest_remaining_place_employer' when position <= 25 then 'high_population_place_expansion' when position <= 40 then 'regional_municipal_employer_expansion' else 'smaller_place_employer_diversity' end as bucket, (position - 1) // 25 + 1 as wave
from (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as position from customer)""")
def q_rank_buckets(t):
    c = ranking.position(t("customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")])
    return c.select("c_custkey", "position", records.rank_bucket(F.col("position")).alias("bucket"), ranking.slices(F.col("position"), 25).cast("bigint").alias("wave"))


@query("""
select s_suppkey, case s_suppkey % 3 when 0 then 'Carry forward T' || s_nationkey || ' for ' || s_name when 1 then 'Replicate in nation ' || s_nationkey else 'Anchor ' || s_name end as reason,
  case when s_suppkey % 5 = 0 then 'Parsed response lacks a source URL; preserve this row in the scout handoff but do not place it in the source-candidate queue or infer a locator. ' when s_suppkey % 5 = 1 then 'Resolve blocked/unreadable access without treating the source as dead. '
  when s_suppkey % 5 = 2 then 'Retain as context/locator only unless a binding wage-setting instrument is established later. ' when s_suppkey % 5 = 3 then 'Retain as insufficient unless later evidence establishes a qualifying source. ' else '' end as note from supplier""")
def q_texts_by_condition(t):
    s, k = t("supplier"), F.col("s_suppkey")
    b = s.select("s_suppkey", "s_name", "s_nationkey", F.element_at(F.array(F.lit("target"), F.lit("replica"), F.lit("anchor")), (k % 3 + 1).cast("int")).alias("bucket"))
    targets = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("T"), "n_nationkey").alias("target_id"))
    out = records.bucket_texts(b, "bucket", targets, ["s_nationkey"], {"target": "Carry forward {target_id} for {s_name}", "replica": "Replicate in nation {s_nationkey}", "anchor": "Anchor {s_name}"}, "target")
    m = k % 5
    note = records.handoff_note(F.when(m == 0, " ").otherwise("u"), F.when(m <= 1, "yes").otherwise("no"), F.when(m == 2, "yes"), F.when(m == 3, "insufficient_candidate").otherwise(""))
    return out.select("s_suppkey", "reason", note.alias("note"))


@query("""
select p_partkey, case when p_size % 3 = 0 then 'No excerpt was returned for this attribute in the selected source window.' when p_size % 3 = 1 then 'This excerpt was coded as evidence of Brand ' || p_brand || ' because it is of size one.' else 'This excerpt was coded under this attribute based on the source text.' end as note,
  p_size % 4 = 1 as file_exists, case p_size % 4 when 0 then '' when 3 then 'unknown' else 'pdf' end as file_type, case p_size % 4 when 0 then 'no_path' when 1 then 'to_extract' else 'file_not_found' end as method from part""")
def q_excerpt_notes(t):
    k = F.col("p_size")
    p = t("part").select("p_partkey", "p_size", F.when(k % 3 == 1, F.col("p_brand")).otherwise("other").alias("att"), F.when(k % 3 == 0, "not_found").otherwise("present").alias("st"))
    info = t("part").select(F.col("p_brand").alias("attribute")).distinct().select("attribute", F.concat(F.lit("Brand "), "attribute").alias("label"), F.lit("it is of size one").alias("clause"))
    p = records.excerpt_note(p, "att", "st", info)
    p = p.withColumn("path", F.when(k % 4 == 0, "").when(k % 4 == 3, "d/file").otherwise(F.concat(F.lit("d/f"), k, F.lit(".PDF"))))
    files = t("part").filter("p_size % 4 = 1").select(F.concat(F.lit("d/f"), "p_size", F.lit(".PDF")).alias("path"))
    return records.file_evidence(p, "path", files).select("p_partkey", "note", "file_exists", "file_type", "method")


@query("""
select o_orderkey, entry, fault from (
select o_orderkey, 2 as entry, 'missing title' as fault from orders where o_orderkey % 6 = 1 union all select o_orderkey, 2, 'blank title' from orders where o_orderkey % 6 = 2 union all select o_orderkey, 2, 'other metrics' from orders where o_orderkey % 6 = 3
union all select o_orderkey, 0, 'not one current' from orders where o_orderkey % 6 = 4 union all select o_orderkey, 0, 'repeated ids' from orders where o_orderkey % 6 = 5)""")
def q_index_faults(t):
    k = F.col("o_orderkey") % 6
    entry = lambda i, title, current, metrics: F.concat(F.lit('{"id":"'), i, F.lit('"'), title, F.lit(',"tags":["a"],"current":'), current, F.lit(',"metrics_snapshot":'), metrics, F.lit("}"))
    fine = F.lit('{"rows":3,"found":0}')
    one = entry(F.lit("x"), F.lit(',"title":"t"'), F.lit("true"), fine)
    title = F.when(k == 1, "").when(k == 2, ',"title":" "').otherwise(',"title":"u"')
    two = entry(F.when(k == 5, "x").otherwise("y"), title, F.when(k == 4, "true").otherwise("false"), F.when(k == 3, '{"rows":3}').otherwise(fine))
    d = t("orders").select("o_orderkey", F.concat(F.lit("["), one, F.lit(","), two, F.lit("]")).alias("doc"))
    return records.index_faults(d, "o_orderkey", "doc", ("id", "title"), ("rows", "found"))


@query("""
select n_nationkey, unnest(f) as fault from (select n_nationkey, list_filter([case when n_nationkey % 5 = 0 then 'not_live' end, case when n_nationkey % 7 = 1 then 'not_terminal' end, case when n_nationkey % 6 = 2 then 'no_input_hash' end,
  case when n_nationkey % 8 = 3 then 'no_rows' end, case when n_nationkey % 8 = 4 then 'repeated_identity' end], lambda x: x is not null) as f from nation)""")
def q_resume_faults(t):
    k = F.col("n_nationkey")
    n = t("nation").select("n_nationkey", F.when(k % 5 == 0, "dry").otherwise("live").alias("mode"), F.lit(True).alias("live_attempted"), F.when(k % 7 == 1, "running").otherwise("completed").alias("execution_status"), F.when(k % 6 == 2, " ").otherwise("abc").alias("input_hash"))
    c = t("customer").filter("c_nationkey % 8 <> 3").select(F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_nationkey") % 8 == 4, "same").otherwise(F.col("c_name")).alias("id"))
    return records.resume_faults(n, c, "n_nationkey", "id")


@query("""
select 'c' || c_custkey as doc_id, c_name as place, c_mktsegment as class, '2019-2021' as cycle, 'contract' as kind from customer union all
select s_nationkey || '_police_award_2020_D_' || s_suppkey || '_x', s_name, 'police', '2020', 'arbitration_award' from supplier where s_suppkey % 3 <> 0""")
def q_input_union(t):
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("doc_id"), F.col("c_name").alias("place"), F.col("c_mktsegment").alias("class"), F.lit("2019-07-01").alias("start"), F.lit("2021-06-30").alias("end"))
    s = t("supplier").select(F.col("s_nationkey").alias("place_id"), F.col("s_name").alias("place"), F.lit("police").alias("class"), F.lit("May 2020").alias("date"), F.concat(F.lit(" D/"), "s_suppkey", F.lit(" x")).alias("docket"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("u").alias("url"))
    return records.input_union(c, s)


@query("""
select s_suppkey, position, url, title, owner, owner_kind, origin from (
select s_suppkey, 1 as position, 'https://a.gov/' || s_suppkey as url, 'First' as title, 'Told' as owner, 'official_source' as owner_kind, 'response_text' as origin from supplier where s_suppkey % 2 = 0 union all
select s_suppkey, 2, 'https://b.org/x', 'not_parseable_from_response', 'B owner', 'not_classified', 'response_text' from supplier where s_suppkey % 2 = 0 union all
select s_suppkey, 1, 'https://a.gov/' || s_suppkey, 'Meta', 'Told', 'not_classified', 'metadata' from supplier where s_suppkey % 2 = 1)""")
def q_source_rows(t):
    k = F.col("s_suppkey")
    text = F.when(k % 2 == 0, F.concat(F.lit("**First** see https://a.gov/"), k, F.lit(". and https://b.org/x, too"))).otherwise("nothing")
    item = F.array(F.struct(F.concat(F.lit("https://a.gov/"), k).alias("url"), F.lit("Meta").alias("title"), F.lit("Told").alias("owner")))
    return records.source_rows(t("supplier").select("s_suppkey", text.alias("r"), item.alias("i")), "s_suppkey", "r", "i", {"b.org": "B owner"}, (".gov",))


@query("select p_partkey, p_size % 2 = 0 and p_size % 3 = 0 as found from part")
def q_signal(t):
    k = F.col("p_size")
    p = t("part").select("p_partkey", F.when(k % 2 == 0, "a Salary table").otherwise("none").alias("r"))
    rows = t("part").filter(k % 3 == 0).select("p_partkey", F.lit("the Union").alias("title"), F.lit("u").alias("url"))
    return records.signal(p, "p_partkey", "r", rows, ["title", "url"], [("salary", "contract"), ("union",)])


@query("select o_orderkey, row_number() over (order by o_orderpriority, o_orderkey) as position from orders")
def q_ordered_by_labels(t):
    return records.ordered_by_labels(t("orders").select("o_orderkey", "o_orderpriority", F.format_string("%012d", F.col("o_orderkey")).alias("k")), ["o_orderpriority", "k"]).select("o_orderkey", "position")


@query("""
select page_id, url, title from (select page_id, 'https://x/' || page_id as url, 'deep' as title from pages union all select page_id, 'https://y/' || page_id, '' from pages union all select page_id, url, 'last' from pages where page_id % 2 = 0)""")
def q_sources_at_any_depth(t):
    k = F.col("page_id").cast("string")
    top = F.concat(F.lit('{"ignored":{"sources":[{"url":"no"}]},"output":[{"a":{"b":[{"sources":[{"url":"https://x/'), k, F.lit('","title":"deep","meta":{"n":[{"url":"u3"}]}},{"url":"https://y/'), k, F.lit('"},{"url":"https://x/'), k, F.lit('","title":"deep"},{"title":"only"},7]}]}}'))
    more = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(',{"sources":[{"url":"'), "url", F.lit('","title":"last"}]}'))).otherwise("")
    return t("pages").select("page_id", F.explode(nested.sources_in(F.concat(top, more, F.lit("]}")))).alias("s")).select("page_id", "s.url", "s.title")


@query("select doc_id, 'source' as kind, 's' || doc_id as a, lang as b from documents union all select doc_id, 'extraction', 'e' || doc_id, null from documents where doc_id % 2 = 0")
def q_record_sets(t):
    d = t("documents").select("doc_id", F.to_json(F.struct(
        F.array(F.struct(F.concat(F.lit("s"), "doc_id").alias("a"), F.col("lang").alias("b"), F.lit("x").alias("other"), F.col("doc_id").alias("d"))).alias("source_candidates"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.concat(F.lit("e"), "doc_id").alias("a"), F.lit("NaN").alias("b"), F.col("doc_id").alias("d")))).alias("extractions"))).alias("response"))
    sets = nested.record_sets(d, "response", {"source_candidates": ["d", "a", "b"], "extractions": ["d", "a", "b"]})
    rows = [df.select(F.col("d").cast("bigint").alias("doc_id"), F.lit(kind).alias("kind"), "a", "b") for kind, df in (("source", sets["source_candidates"]), ("extraction", sets["extractions"]))]
    return rows[0].unionByName(rows[1])


@query("""
select item_id, item_id % 4 in (0, 3) as strict, item_id % 4 = 1 as process, item_id % 4 = 2 as leak from benchmark""")
def q_excerpt_rules(t):
    """Every rule table on excerpts of known outcome."""
    k = F.col("item_id") % 4
    x = F.when(k == 0, "The COLA is three points").when(k == 1, "After impasse the JLMC issued a stipulated award with a wage increase in the successor agreement").when(k == 2, "As CODE_LABEL_X shows").otherwise("Same health plan carrier for all")
    strict = clauses.relevance(x, clauses.IRRELEVANT_STRICT) == "irrelevant"
    return t("benchmark").select("item_id", strict.alias("strict"), clauses.process_relevant(x).alias("process"), clauses.label_leak(x, ("Code_Label_X", "other")).alias("leak"))


@query("""
select c_custkey, 'yes it is ' || lower(c_name) as folded, 'st_' || c_custkey as area, case c_custkey % 3 when 0 then 'parish' when 1 then 'census_area' else 'county' end as area_kind, case c_custkey % 2 when 0 then 'Even' else 'odd' end as label,
  case when c_custkey % 5 = 0 then c_mktsegment else c_name || ' ' || c_mktsegment end as parts, case when c_custkey % 7 = 0 then c_mktsegment || '_' || c_custkey else c_name end as id,
  case when c_custkey % 4 = 0 then 'kept' when c_custkey % 4 = 1 then 'id:x' when c_custkey % 4 = 2 then 'number|AB|' || c_custkey else 'name|AB|' || lower(c_name) end as identity, c_name || ' in ' || c_mktsegment as hint, 2 as n_listed, case when c_custkey % 3 = 0 then 'late' else 'lost' end as retry from customer""")
def q_string_functions(t):
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    key = k.cast("string")
    state = F.when(k % 3 == 0, "LA").when(k % 3 == 1, "AK").otherwise("NV")
    return t("customer").select(
        "c_custkey", strings.fold(F.concat(F.lit("  Yes  it\tIS "), name, F.lit(" "))).alias("folded"), strings.area_key(F.concat(F.lit("St. "), key, F.lit(" County"))).alias("area"),
        strings.area_kind(state, F.when(k % 3 == 1, "X Census Area").otherwise("Clark County")).alias("area_kind"), strings.labelled(F.when(k % 2 == 0, "EVEN").otherwise("odd"), {"even": "Even"}).alias("label"),
        strings.parts_label(F.when(k % 5 == 0, " ").otherwise(name), seg).alias("parts"), strings.default_id(F.when(k % 7 == 0, "").otherwise(name), seg, key).alias("id"),
        strings.row_identity(F.when(k % 4 == 0, " kept "), F.when(k % 4 == 1, "x"), F.lit(" ab"), F.when(k % 4 == 2, key), name).alias("identity"),
        F.get(strings.hints(("{a} in {b}",), a=name, b=seg), F.lit(0)).alias("hint"), F.size(strings.coerce_list(F.array(name, F.lit(" "), seg, key), 2)).alias("n_listed"), strings.retry_kind(F.when(k % 3 == 0, "timeout").otherwise("connection"), {"timeout": "late", "connection": "lost"}).alias("retry"),
    )


@query("""
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as dates, strftime(o_orderdate, '%Y-%m-%d') as compact, length(strftime(now(), '%Y-%m-%dT%H:%M:%SZ'))::int as now_length, round(o_totalprice / 3, 6) as ratio,
  case when o_orderkey % 6 = 0 then '0' when o_orderkey % 6 = 1 then '1_25' when o_orderkey % 6 = 2 then '26_50' when o_orderkey % 6 = 3 then '51_75' when o_orderkey % 6 = 4 then '76_100' else 'invalid' end as band, 12.0::double as area, round((o_orderkey % 50) * 2.0, 6)::double as x, round(100 - (o_orderkey % 20) * 5.0, 6)::double as y,
  least(100, greatest(0, o_orderkey % 300 - 100))::int as clamped, case when o_orderkey % 2 = 0 then o_totalprice end as clean, 3::int as n_items from orders""")
def q_value_functions(t):
    k, price, day = F.col("o_orderkey"), F.col("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd")
    x, y = values.projected((k % 50).cast("double"), (k % 20).cast("double"), (0.0, 0.0, 50.0, 20.0), (100.0, 100.0))
    return t("orders").select(
        "o_orderkey", F.when(F.col("o_orderdate") >= "2000-01-01", values.joined_dates(F.concat(F.lit("x "), day, F.lit("; none; "), day))).otherwise(day).alias("dates"),
        F.when(F.col("o_orderdate") >= "2000-01-01", values.compact_date(F.concat(F.lit("run_"), F.replace(day, F.lit("-"), F.lit("")), F.lit("_a")))).otherwise(day).alias("compact"), F.length(values.utc_now()).alias("now_length"),
        F.round(values.ratio(price, F.lit(3)), 6).alias("ratio"), values.score_band(F.element_at(F.array(*[F.lit(v) for v in (0, 25, 26, 75, 76, 101)]), (k % 6 + 1).cast("int"))).alias("band"),
        values.ring_area(F.array(*[F.lit(float(v)) for v in (0, 4, 4, 0)]), F.array(*[F.lit(float(v)) for v in (0, 0, 3, 3)])).alias("area"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), values.clamp(k % 300 - 100).cast("int").alias("clamped"),
        nested.nan_to_null(F.when(k % 2 == 0, price).otherwise(F.lit(float("nan")))).alias("clean"), F.size(nested.items(F.lit(" a; b;;c "))).alias("n_items"),
    )


@query("""
select s_suppkey, case s_suppkey % 3 when 0 then 'context_only_candidate' when 1 then 'given' else 'legacy_unverified_candidate' end as stage, case s_suppkey % 3 when 0 then 'not_calibrated' when 1 then 'calibration_unreachable' else 'calibration_odd' end as state,
  case when s_suppkey % 2 = 1 then 'not_applicable' when s_nationkey <= 2 then 'high' when s_nationkey = 3 then 'medium' else 'low' end as retry, case when s_acctbal >= 5000 then 'high' when s_acctbal >= 1000 then 'medium' else 'low' end as confidence,
  case s_suppkey % 5 when 0 then 'timeout_or_capacity' when 1 then 'connection_error' when 2 then 'json_parse_error' when 3 then 'empty_response_with_response_id' else 'empty_response_no_response_id' end as failure, s_suppkey % 5 < 2 as transport,
  case s_suppkey % 3 when 0 then 'clean' when 1 then 'partial' else 'ocr_messy' end as quality, concat_ws('; ', case when s_suppkey % 2 = 0 then 'large' end, case when s_suppkey % 3 = 0 then 'near' end) as why,
  case when s_suppkey % 4 = 0 then 0 else 36.0 end::double as ready, case when s_suppkey % 4 = 0 then 0.2 else 0.9 end::double as evidence, case when s_suppkey % 4 = 0 then 'claim_context_without_current_scout_coverage' else 'candidate_leads_need_verification' end as level from supplier""")
def q_scoring_functions(t):
    k, none = F.col("s_suppkey"), F.lit("")
    fifth = F.element_at(F.array(F.lit("Request TIMED OUT"), F.lit("connection error"), none, none, none), (k % 5 + 1).cast("int"))
    answer = F.when(k % 5 == 2, "{x").otherwise("")
    empty = k % 4 == 0
    zero = lambda n: F.when(empty, 0).otherwise(n)
    return t("supplier").select(
        "s_suppkey", scoring.stage_of(F.when(k % 3 == 1, " given ").otherwise(""), F.when(k % 3 == 0, "meeting_minutes").otherwise("cba")).alias("stage"),
        scoring.verified_state(F.when(k % 3 == 0, "").when(k % 3 == 1, "unreachable").otherwise("odd")).alias("state"), scoring.retry_plan(k % 2 == 0, F.col("s_nationkey"))["priority"].alias("retry"), scoring.levels(F.col("s_acctbal"), 5000, 1000).alias("confidence"),
        scoring.failure_kind(fifth, answer, k % 5 == 3, "timed out|capacity", "connection").alias("failure"), scoring.transport_failure(fifth, F.lit(None), none, F.lit("0")).alias("transport"),
        scoring.text_quality(F.when(k % 3 == 0, 900).when(k % 3 == 1, 90).otherwise(10), F.when(k % 3 == 1, 80).otherwise(800), F.lit(4))["quality"].alias("quality"),
        selection.selection_texts({"large": k % 2 == 0, "near": k % 3 == 0}).alias("why"), scoring.readiness(zero(10), zero(5), zero(3), F.lit(0), F.lit(False)).alias("ready"),
        scoring.evidence_signal(zero(5), ~empty, zero(0), empty).alias("evidence"), scoring.readiness_level(zero(10), zero(5), F.lit(0), F.lit(True)).alias("level"),
    )


@query("""
select doc_id, 'The parties agree to interest arbitration of wages.' as arbitration, doc_id % 2 = 0 as flagged, 'surrounding communities' as compared, doc_id % 3 = 0 as heading, case when doc_id % 2 = 0 then 'grounded' else 'unsupported' end as ground, 'Article 5' as location, 1 as kept, 1 as unverified, 1 as repeated,
  case when doc_id % 4 = 0 then 'false_positive_trap_above_25' when doc_id % 4 = 1 then 'clear_positive_below_51' else '' end as audit, 2 as n_bold from documents""")
def q_clause_functions(t):
    k = F.col("doc_id")
    turned = "The unit is not subject to last best offer. Impasse goes to interest arbitration."
    barred = "No member is eligible, and this unit is not subject to interest arbitration."
    text = F.lit("\n\n".join(["ARTICLE 4", "The parties agree to interest arbitration of wages.", "Pay shall be comparable to surrounding communities. Wages follow.", "x"]))
    d = t("documents").select("doc_id", text.alias("text"), F.when(k % 2 == 0, turned).otherwise(barred).alias("other"))
    d = clauses.scan_clauses(d, "text").select("doc_id", "interest_arbitration_text", "comparability_referent", "other")
    d = clauses.scan_clauses(d.withColumn("arbitration", F.regexp_extract("interest_arbitration_text", r"The parties[^.]*\.", 0)), "other", {"interest_arbitration": clauses.TRIGGERS["interest_arbitration"]}, compared=(), flag_only=("interest_arbitration",))
    body = F.lit("Article 5 of this says the wage is fixed by the panel each year")
    quotes = F.array(F.lit("the wage is fixed"), F.lit("THE  wage is fixed"), F.lit("never said in it at all"))
    checked = clauses.verified_excerpts(quotes, body)
    return d.select(
        "doc_id", "arbitration", (F.col("interest_arbitration_flag") == 1).alias("flagged"), F.regexp_extract("comparability_referent", "surrounding communities", 0).alias("compared"), clauses.is_heading(F.when(k % 3 == 0, "ARTICLE 5 WAGES").otherwise("A plain sentence.")).alias("heading"),
        clauses.grounding(F.when(k % 2 == 0, "wage is  fixed").otherwise("no such words"), body).alias("ground"), clauses.location_before(body, F.lit("wage is fixed")).alias("location"), F.size(checked["kept"]).alias("kept"), checked["unverified"].alias("unverified"), checked["repeated"].alias("repeated"),
        clauses.gold_audit(F.when(k % 4 == 0, "false_positive_trap").when(k % 4 == 1, "clear_positive").otherwise("clear_negative"), F.when(k % 4 < 2, 30).otherwise(10), F.lit("no")).alias("audit"), F.size(strings.bold_in(F.lit("**a** and **b** and **a**"))).alias("n_bold"),
    )


def _folder(t) -> tuple:
    spark = t("region").sparkSession
    return spark, f"{stages.shared_dir(spark)}/strandline/io-{uuid.uuid4().hex}"


@query("select o_orderkey, o_orderstatus, case when o_orderkey % 3 = 0 then null else o_orderpriority end as o_orderpriority, 'w1' as wave from orders union all select o_orderkey, 'X', null, 'w2' from orders where o_orderkey % 2 = 0")
def q_csv_round_trip(t):
    spark, at = _folder(t)
    o = t("orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    sinks.write_checked(o, f"{at}/a", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    sinks.write_csv(t("orders").filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")), f"{at}/b", ["o_orderkey", "o_orderstatus"])
    out = tables.read_many(spark, [{"path": f"{at}/a", "wave": "w1"}, {"path": f"{at}/b", "wave": "w2"}], ["o_orderkey"])
    none, errors = tables.read_or_report(spark, f"{at}/none", "o_orderkey string, o_orderstatus string, o_orderpriority string, wave string")
    if not errors:
        raise ValueError("an absent file was not reported")
    return out.unionByName(none).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", "o_orderpriority", "wave")


@query("select c_custkey, c_name, case when c_custkey % 2 = 0 then c_custkey * 10 end as extra, case when c_custkey % 3 = 0 then 'new' else 'old' end as state from customer")
def q_table_lifecycle(t):
    """Create, append with a new column, upsert, publish, read the current version."""
    spark, at = _folder(t)
    c = t("customer").select("c_custkey", "c_name", F.lit("old").alias("state"))
    sinks.append(c.filter("c_custkey % 2 = 1"), f"{at}/t")
    sinks.append(c.filter("c_custkey % 2 = 0").withColumn("extra", F.col("c_custkey") * 10), f"{at}/t")
    now = spark.read.parquet(f"{at}/t")
    sinks.upsert_parquet(now.filter("c_custkey % 3 = 0").withColumn("state", F.lit("new")), f"{at}/t", ["c_custkey"])
    sinks.publish(spark.read.parquet(f"{at}/t").limit(1), f"{at}/p")
    sinks.publish(spark.read.parquet(f"{at}/t"), f"{at}/p")
    return sinks.current(spark, f"{at}/p").select("c_custkey", "c_name", "extra", "state")


@query("select n_nationkey, n_name, case when n_nationkey % 4 = 0 then 'unknown' else 'r' || n_regionkey end as region, n_nationkey % 2 = 0 as cached, case when n_nationkey % 5 = 0 then 'n_comment' else '' end as missing_fields from nation")
def q_json_and_defaults(t):
    spark, at = _folder(t)
    n, k = t("nation"), F.col("n_nationkey")
    body = [F.col("n_nationkey"), F.col("n_name"), F.when(k % 4 != 0, F.concat(F.lit("r"), "n_regionkey")).alias("region"), F.when(k % 5 != 0, F.lit("c")).alias("n_comment")]
    sinks.documents(n, "n_nationkey", body, {"stage": "test"}).select(F.col("json").alias("value")).write.text(f"{at}/docs")
    rows = spark.read.schema("n_nationkey int, n_name string, region string, n_comment string").json(f"{at}/docs")
    rows = rows.unionByName(tables.read_json(spark, f"{at}/none.json", "n_nationkey int, n_name string, region string, n_comment string"))
    rows = tables.with_defaults(rows, {"region": "unknown"})
    cached = n.filter(k % 2 == 0).select("n_nationkey", F.lit("t").alias("text"))
    rows = tables.reuse_text(rows.withColumn("fresh", F.lit("f")), cached, "n_nationkey", "text", "fresh")
    good, bad = sinks.split_quarantine(rows, checks.missing_fields(["n_comment"]))
    both = good.withColumn("missing_fields", F.lit("")).unionByName(bad)
    return both.select("n_nationkey", "n_name", "region", (F.col("text_source") == "cache").alias("cached"), "missing_fields")


@query("select o_orderkey, n_name, o_orderkey % 2 = 0 as named, case when o_orderkey % 3 = 0 then 'b' else 'a' end as file from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_orderstatus = 'F'")
def q_gated_joins(t):
    c, n = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), t("nation").select("n_nationkey", "n_name")
    o = t("orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", " f").otherwise(F.col("o_orderstatus")).alias("state"), F.when(F.col("o_orderkey") % 2 == 0, "Town of X").otherwise("X").alias("label"))
    o = selection.rows_of_state(o, "F")
    o = selection.gate(o, matching.missing_keys(o, c, "o_custkey").select("o_custkey"), "orders without a customer")
    o = matching.complete_join(o, c, "o_custkey").join(n, "n_nationkey")
    first = matching.first_of_files([o.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.lit("a").alias("file")), o.select("o_orderkey", F.lit("b").alias("file"))], "o_orderkey")
    return o.join(first, "o_orderkey").select("o_orderkey", "n_name", selection.named_like(F.col("label"), ("TOWN",)).alias("named"), "file")


@query("""
select event_type, count(*) as n, count(*) filter (where user_id % 3 <> 0) as n_parseable, count(*) filter (where user_id % 3 = 0) as n_failed, sum(event_id % 5 + event_id % 7)::bigint as tokens, round(stddev_samp(value) / sqrt(count(value)), 6) as se,
  count(*) filter (where user_id % 2 = 0 or event_id % 3 = 0) as successful, count(distinct user_id) as users from events group by 1""")
def q_cost_and_outcomes(t):
    e = t("events").withColumns({"i": F.col("event_id") % 5, "o": F.col("event_id") % 7, "a": F.lit(None).cast("long"), "r": F.when(F.col("user_id") % 2 == 0, "text").otherwise(" "), "c": F.col("event_id") % 3 == 0})
    costs = ledgers.cost_summary(e, ["event_type"], F.col("user_id") % 3 != 0, "i", "o", "a", "value").select("event_type", "n", "n_parseable", "n_failed", "tokens")
    said = selection.response_rows(e, "r", "c").groupBy("event_type").agg(F.count_if("successful").alias("successful"), F.round(values.standard_error(F.col("value")), 6).alias("se"), F.count_distinct("user_id").alias("users"))
    return costs.join(said, "event_type")


@query("select status, n from (select o_orderstatus as status, count(*) as n from orders group by 1) union all select 'sum', round(sum(o_totalprice))::bigint from orders union all select 'absent', null from region where r_regionkey = 0")
def q_totals_and_counts(t):
    o = t("orders")
    each = rollups.counts_document(o, "o_orderstatus").select(F.explode("counts").alias("status", "n"))
    one = rollups.totals(o, {"sum": F.round(F.sum("o_totalprice"))}, ("absent",))
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("status"), F.col(c).cast("bigint").alias("n")) for c in ("sum", "absent")])).alias("s")).select("s.*")
    return each.unionByName(long)


@query("""
select "check", count(*) as n from (select 'required' as "check" from customer where c_custkey % 10 = 0 union all select 'allowed' from customer where c_mktsegment = 'BUILDING' union all select 'one_flag' from (select c_nationkey from customer group by 1 having count(*) filter (where c_acctbal > 9500) <> 1)) group by 1""")
def q_validation_report(t):
    c = t("customer").withColumn("name", F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_name")))
    kinds = [r[0] for r in c.select("c_mktsegment").distinct().collect() if r[0] != "BUILDING"]
    odd = selection.exactly_one(c, "c_nationkey", F.col("c_acctbal") > 9500)
    odd = odd.select(F.lit("one_flag").alias("check"), F.col("c_nationkey").cast("string").alias("row"), F.lit("c_acctbal").alias("field"), F.col("n").cast("string").alias("message"))
    return checks.report(checks.required(c, "c_custkey", ["name"]), checks.allowed(c, "c_custkey", {"c_mktsegment": kinds}), odd).groupBy("check").agg(F.count("*").alias("n"))


@query("""
select c_custkey, 'known' as how, 1 as rank, c_name as record, null as error from customer where c_custkey % 3 = 0 union all select c_custkey, 'known', 2, c_mktsegment, null from customer where c_custkey % 3 = 0
union all select c_custkey, 'prompt', 1, null, 'no list of results' from customer where c_custkey % 3 <> 0""")
def q_capped_records(t):
    k = F.col("c_custkey")
    c = t("customer").select("c_custkey", F.when(k % 3 == 0, F.array("c_name", "c_mktsegment", F.lit("cut"))).alias("items"), selection.resolve_place(F.when(k % 3 == 0, "city_boston_1").otherwise("x"), F.lit("City: Salem"), ("Boston", "Salem")).alias("place"))
    rows = selection.capped_records(c.select("c_custkey", "items"), "c_custkey", "items", 2)
    how = selection.marker_switch(F.col("place"), {"boston": "known", "salem": "prompt"}, "none")
    return rows.join(c.select("c_custkey", how.alias("how")), "c_custkey").select("c_custkey", "how", "rank", "record", "error")


@query("select c_custkey, c_name, first, n_cells from (select c_custkey, c_name, case when c_custkey % 2 = 0 then c_mktsegment else c_name end as first, case c_custkey % 4 when 0 then 2 when 1 then 1 when 2 then 1 else 0 end as n_cells from customer where c_custkey in (3, 1, 2, 17, 40))")
def q_by_ids(t):
    k = F.col("c_custkey")
    c = selection.by_ids(t("customer"), "c_custkey", [3, 1, 2, 17, 40])
    n = selection.count_allowed(c, 5, 10, True)
    cell = F.when(k % 4 == 0, "['a', None]").when(k % 4 == 1, "bare").when(k % 4 == 2, "{'u': 1}").otherwise(" ")
    c = c.limit(n).withColumn("first", nested.first_field(F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(" "), F.col("c_name"))).withColumn("n_cells", F.size(nested.list_cell(cell)))
    return selection.existing(c, ["c_custkey", "not_there", "c_name", "first", "n_cells"])


@query("select c_nationkey, count(*) as n, round(avg(c_acctbal), 4) as mean, max(c_acctbal) as max, min(c_custkey) as first from customer group by 1")
def q_group_scores(t):
    s = rollups.summary(t("customer"), "c_acctbal", "all", "c_nationkey").select("c_nationkey", "n", F.round("mean", 4).alias("mean"), "max")
    first = ranking.dedupe_rows(t("customer"), ["c_nationkey"], "c_custkey").select("c_nationkey", F.col("c_custkey").alias("first"))
    return s.join(first, "c_nationkey")


@query("select c_nationkey, string_agg(c_custkey::varchar, ' | ' order by c_acctbal <= 9000, c_custkey) as context from customer group by 1")
def q_long_context(t):
    return evidence.ordered_context(t("customer"), "c_nationkey", F.col("c_acctbal") > 9000, "c_custkey", F.col("c_custkey").cast("string"), " | ")
