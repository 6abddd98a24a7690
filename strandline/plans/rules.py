"""Bindings: rules of clauses, excerpts and scores on the tables' own texts and roll-ups, stated in SQL in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clauses
from ..operators import scoring
from .registry import query
from .texts import _any, _rule_sql

VOCABULARY = ("Token", "password", "licen")
_ANY = lambda rules: " or ".join(map(_rule_sql, rules))


@query(f"""
select doc_id, case when {_ANY(clauses.IRRELEVANT_STRICT)} then 'irrelevant' when {_ANY(clauses.RELEVANT)} then 'relevant' else 'ambiguous' end as strict,
  ({_ANY(clauses.PROCESS_RELEVANT)}) and not ({_ANY(clauses.BOILERPLATE)}) as process, {_any([v.lower() for v in VOCABULARY])} as leak
from (select doc_id, lower(text) as e from documents union all select 1000000000 + item_id, lower(text) from benchmark union all select 2000000000 + page_id, lower(html) from pages)""")
def q_excerpt_rules_on_texts(t):
    """The rule tables on whole documents, passages and pages."""
    rows = t("documents").select("doc_id", "text").unionByName(t("benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), "text"))
    rows = rows.unionByName(t("pages").select((F.col("page_id") + 2_000_000_000).alias("doc_id"), F.col("html").alias("text")))
    x = F.col("text")
    return rows.select("doc_id", clauses.relevance(x, clauses.IRRELEVANT_STRICT).alias("strict"), clauses.process_relevant(x).alias("process"), clauses.label_leak(x, VOCABULARY).alias("leak"))


SIGNS = (r"licen[sc]e", r"(?:^|[ \n])token", r"[ \n]the[ \n]", r"[ \n]de[ \n]")
CUES = r"(?:^|[ \n])(?:not|is|la|pour|under)[ \n]"
_SENTENCE = "regexp_extract(text, '([^.;]*?(?:{p})[^.;]*[.;]?)', 1, 'i')"
_FIRST = "case " + " ".join(f"when regexp_matches(text, '{p}', 'i') then " + _SENTENCE.format(p=p) for p in SIGNS) + " end"


@query(f"""
select doc_id, sign, said, coalesce(regexp_matches(said, '{CUES}', 'i'), false) as negated
from (select doc_id, nullif({_SENTENCE.format(p=SIGNS[0])}, '') as sign, nullif({_FIRST}, '') as said from documents)""")
def q_negated_sentences(t):
    """The sentence of the first listed sign that a document holds, and whether a cue negates it."""
    x = F.col("text")
    said = F.coalesce(*[F.when(x.rlike(f"(?i){p}"), clauses.sentence_at(x, p)) for p in SIGNS])
    return t("documents").select("doc_id", clauses.sentence_at(x, SIGNS[0]).alias("sign"), said.alias("said"), clauses.is_negated(x, *SIGNS, cues=CUES).alias("negated"))


_PARTS = r"""(select doc_id, list_filter(list_transform(case when len(a) < 3 then string_split(text, chr(10)) else a end, lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') as ps
  from (select doc_id, text, string_split_regex(text, '\n\s*\n') as a from documents))"""
_HEAD = r"(length({p}) <= 80 and (regexp_matches({p}, '^\s*(article|section|sec\.?|art\.?)\b', 'i') or (regexp_matches({p}, '\p{{L}}') and {p} = upper({p}) and not regexp_matches({p}, '[.;]'))))"


@query(f"""
with p as {_PARTS},
q as (select doc_id, list_concat(['SECTION ' || len(ps)], ps) as ps from p),
h as (select doc_id, ps, list_transform(ps, lambda x: {_HEAD.format(p='x')}) as hs from q),
i as (select doc_id, ps, hs, unnest(range(1, len(ps) + 1)) as k from h)
select doc_id, (k - 1)::int as at, hs[k] as heading,
  case when not hs[k] or k = len(ps) or hs[k + 1] then ps[k] when length(ps[k + 1]) > 120 or k + 1 = len(ps) or hs[k + 2] then ps[k] || chr(10) || ps[k + 1] else ps[k] || chr(10) || ps[k + 1] || chr(10) || ps[k + 2] end as span
from i where hs[k] or regexp_matches(ps[k], 'licen[sc]e', 'i')""")
def q_heading_spans(t):
    """Every heading and every paragraph with a licence, with the body that follows a heading; a heading of its own opens each document."""
    parts = clauses.paragraphs(F.col("text"))
    d = t("documents").select("doc_id", parts.alias("own")).withColumn("ps", F.concat(F.array(F.concat(F.lit("SECTION "), F.size("own"))), "own"))
    d = d.select("doc_id", "ps", F.posexplode("ps").alias("at", "p"))
    heading = clauses.is_heading(F.col("p"))
    d = d.filter(heading | F.col("p").rlike("(?i)licen[sc]e"))
    return d.select("doc_id", "at", heading.alias("heading"), clauses.span_with_body(F.col("ps"), F.col("at")).alias("span"))


@query(r"""
with d as (select doc_id, d.text, regexp_extract(d.text, '^[^.]*', 0) as s1, b.text as passage from documents d join benchmark b on item_id = doc_id % 40),
q as (select *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as n, list_transform([s1, replace(s1, ' ', '  '), passage], lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))) as qs from d),
s as (select *, list_filter(qs, lambda x: length(x) >= 15 and contains(n, x)) as sure from q)
select doc_id, len(list_distinct(sure))::int as kept, (3 - len(sure))::int as unverified, (len(sure) - len(list_distinct(sure)))::int as repeated,
  case when trim(regexp_replace(passage, '\s+', ' ', 'g')) = '' then 'not_applicable' when contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(passage, '\s+', ' ', 'g'))) then 'grounded' else 'unsupported' end as passage_ground,
  case when trim(regexp_replace(s1, '\s+', ' ', 'g')) = '' then 'not_applicable' else 'grounded' end as own_ground from s""")
def q_grounded_quotes(t):
    """A document's own first sentence, the same with other white space, and a passage of the benchmark, held against the document."""
    b = t("benchmark").select("item_id", F.col("text").alias("passage"))
    d = t("documents").select("doc_id", "text", F.regexp_extract("text", "^[^.]*", 0).alias("s1"), (F.col("doc_id") % 40).alias("item_id")).join(b, "item_id")
    checked = clauses.verified_excerpts(F.array("s1", F.replace("s1", F.lit(" "), F.lit("  ")), "passage"), F.col("text"))
    return d.select(
        "doc_id", F.size(checked["kept"]).alias("kept"), checked["unverified"].alias("unverified"), checked["repeated"].alias("repeated"),
        clauses.grounding(F.col("passage"), F.col("text")).alias("passage_ground"), clauses.grounding(F.col("s1"), F.col("text")).alias("own_ground"),
    )


@query(r"""
with d as (select doc_id, length(split_part(text, chr(10), 1)) as layer, length(regexp_replace(text, '[^a-z]', '', 'g')) as scanned, greatest(1, len(string_split(text, chr(10)))) as pages from documents)
select doc_id, case when layer / pages >= 100 then 'text_layer' when scanned / pages >= 100 and layer > scanned then 'text_layer' when scanned / pages >= 100 then 'ocr' else 'text_layer+ocr_partial' end as method,
  case when layer / pages >= 100 then 'clean' when scanned / pages >= 100 and layer > scanned then 'partial' when scanned / pages >= 100 then 'ocr_messy' else 'partial' end as quality from d""")
def q_text_quality(t):
    """First line, letters a to z and lines as the embedded text, the scanned text and pages of a document."""
    x = F.col("text")
    q = scoring.text_quality(F.length(F.split(x, "\n")[0]), F.length(F.regexp_replace(x, "[^a-z]", "")), F.size(F.split(x, "\n")))
    return t("documents").select("doc_id", q["method"].alias("method"), q["quality"].alias("quality"))


@query("""
with c as (select c_custkey, c_acctbal, c_nationkey, count(o_orderkey) as n, count(*) filter (where o_orderstatus = 'F') as done, count(*) filter (where o_totalprice > 250000) as large, count(*) filter (where o_orderpriority = '1-URGENT') as urgent
  from customer left join orders on o_custkey = c_custkey group by 1, 2, 3)
select c_custkey, round(case when n <= 0 then 0 else least(20 + 20 * (done / n) + 20 * least(large / 10, 1) + 30 * least(urgent / 10, 1) + 10 * (c_acctbal > 0)::int, 100) end, 1) as ready,
  case when urgent > 0 then 'matched_set_leads_need_verification' when done > 0 then 'candidate_leads_need_verification' when n > 0 then 'scout_coverage_only' when c_acctbal > 0 then 'claim_context_without_current_scout_coverage' else 'not_started' end as level,
  round(case when n > 0 then least(1, 0.4 + 0.3 * least(n / 5, 1) + 0.2 * (c_acctbal > 0)::int + 0.1 * least(done / greatest(n, 1), 1)) when c_acctbal < 0 then 0.2 else 0 end, 6) as signal,
  case when c_acctbal >= 5000 then 'high' when c_acctbal >= 1000 then 'medium' else 'low' end as confidence,
  case when n > 0 then 'not_applicable' when c_nationkey % 5 <= 2 then 'high' when c_nationkey % 5 = 3 then 'medium' else 'low' end as retry,
  case when n < 10 then 'calibration_sample_needed' when done / n >= 0.7 or large / n >= 1.75 then 'strong_yield_consider_next_wave' when done / n >= 0.5 or large / n >= 1.0 then 'moderate_yield_use_priority_targets' else 'lower_yield_use_for_strategic_coverage' end as advice from c""")
def q_readiness_rules(t):
    """Readiness, signal, confidence, retry and advice of customers by what their orders are."""
    c = lambda x: F.coalesce(x, F.lit(0))
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 250000).alias("large"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )
    d = t("customer").select("c_custkey", "c_acctbal", "c_nationkey").join(o, "c_custkey", "left").withColumns({k: c(F.col(k)) for k in ("n", "done", "large", "urgent")})
    n, done, large, urgent, rich = F.col("n"), F.col("done"), F.col("large"), F.col("urgent"), F.col("c_acctbal") > 0
    return d.select(
        "c_custkey", scoring.readiness(n, done, large, urgent, rich).alias("ready"), scoring.readiness_level(n, done, urgent, rich).alias("level"),
        F.round(scoring.evidence_signal(n, rich, done, F.col("c_acctbal") < 0), 6).alias("signal"), scoring.levels(F.col("c_acctbal"), 5000, 1000).alias("confidence"),
        scoring.retry_plan(n == 0, F.col("c_nationkey") % 5)["priority"].alias("retry"), scoring.yield_advice(n, F.try_divide(done, n), F.try_divide(large, n)).alias("advice"),
    )


@query(r"""
with e as (select event_id, event_type, coalesce(json_extract_string(props, '$.k'), '') as page, user_id % 2 = 0 as has_id, lower(event_type) as low from events)
select event_id, case when regexp_matches(low, 'err|timed out') then 'timeout_or_capacity' when regexp_matches(low, 'click|sign') then 'connection_error' when trim(page) <> '' then 'json_parse_error' when has_id then 'empty_response_with_response_id' else 'empty_response_no_response_id' end as kind,
  case when page <> '' then page else 'legacy_unverified_candidate' end as stage, case when event_type = 'error' then 'calibration_error' else 'calibration_' || event_type end as state from e""")
def q_failure_kinds(t):
    """Kinds, stages and states of events by their type and properties."""
    page = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    return t("events").select(
        "event_id", scoring.failure_kind(F.col("event_type"), page, F.col("user_id") % 2 == 0, "err|timed out", "click|sign").alias("kind"),
        scoring.stage_of(page, F.lit("cba")).alias("stage"), scoring.verified_state(F.col("event_type")).alias("state"),
    )
