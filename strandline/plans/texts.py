"""Bindings: strings, dates, JSON, clauses and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clauses, nested, strings, values
from ..operators import evidence, matching, quotes, ranking
from .registry import query


@query("""
select event_id, case when event_id % 7 = 0 then 'failed' else 'parsed' end as parse_status, case when event_id % 7 = 0 then null else coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.k')) end as page, case when event_id % 7 <> 0 then event_id end as id from events""")
def q_json_extract(t):
    e = t("events").select("event_id", "props", F.concat(F.lit('{"candidates": [{"id": '), F.col("event_id").cast("string"), F.lit("}]}")).alias("j"))
    k = F.col("event_id") % 7
    cell = F.when(k == 0, F.concat(F.lit("no json { here "), F.col("event_id").cast("string"))).when(k < 3, F.concat(F.lit("Sure:\n```json\n"), "j", F.lit("\n```"))).when(k < 5, F.concat(F.lit("text before "), "j", F.lit(" and after }"))).otherwise(F.col("j"))
    rows = nested.candidates_or_failure(e.withColumn("response", cell), "response", "struct<id:bigint>", "candidates", ("police", "fire"))
    page = F.when(k != 0, F.coalesce(F.get_json_object("props", "$.page"), F.get_json_object("props", "$.k")))
    return rows.select("event_id", "parse_status", page.alias("page"), F.col("item.id").alias("id"))


@query("""
select o_orderkey, kind, id from (select o_orderkey, unnest([{'kind': 'a', 'id': o_orderkey}, {'kind': 'a', 'id': o_orderkey + 1}, {'kind': 'c', 'id': o_custkey}]) as u from orders), lateral (select u.kind as kind, u.id as id)""")
def q_keyed_lists(t):
    o = t("orders")
    j = F.to_json(F.struct(F.array(F.struct(F.col("o_custkey").alias("id"))).alias("c"), F.array(F.struct(F.col("o_orderkey").alias("id")), F.struct((F.col("o_orderkey") + 1).alias("id"))).alias("a")))
    return nested.candidates_or_failure(o.select("o_orderkey", j.alias("r")), "r", "struct<id:bigint>", "flat", ("a", "b", "c")).select("o_orderkey", "kind", F.col("item.id").alias("id"))


@query("""
select doc_id, number, quote, case when number <= 2 then len(quote)::varchar else '' end as page from (select doc_id, unnest(w) as quote, unnest(range(1, len(w) + 1)) as number from (select doc_id, list_slice(string_split(lang || ' ' || source || ' ' || doc_id::varchar, ' '), 1, 3) as w from documents))""")
def q_zip_posexplode(t):
    d = t("documents").select("doc_id", F.split(F.concat_ws(" ", "lang", "source", F.col("doc_id").cast("string")), " ").alias("w"))
    pages = F.slice(F.transform("w", F.length), 1, 2)
    out = d.select("doc_id", F.explode(nested.zip_numbered(F.col("w"), pages)).alias("z"))
    return out.select("doc_id", F.col("z.number").cast("bigint").alias("number"), "z.quote", "z.page")


@query("""
select c_custkey, attribute, position, excerpt, case when excerpt is null then 'not_found' else 'present' end as status from (
select c_custkey, 'a' as attribute, 0 as position, c_name as excerpt from customer where c_custkey % 2 = 0 union all select c_custkey, 'a', 1, c_mktsegment from customer where c_custkey % 2 = 0
union all select c_custkey, 'a', null, null from customer where c_custkey % 2 = 1 union all select c_custkey, 'b', 0, c_mktsegment from customer)""")
def q_unpivot_lists(t):
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.array("c_name", "c_mktsegment")).otherwise(F.array().cast("array<string>")).alias("a"), F.array("c_mktsegment").alias("b"))
    return nested.unpivot_lists(c, ["c_custkey"], ["a", "b"])


@query("""
select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as key, lower(replace(replace(trim(p_type), ' ', '_'), '-', '_')) as snake, printf('P-%s-%04d', p_brand, p_size) as id,
substring(sha256(p_name), 1, 20) as token, case when p_size > 25 then p_name else 'not_available' end as filled from part""")
def q_normalize(t):
    p, n = t("part"), F.col("p_name")
    return p.select(
        "p_partkey", strings.alnum_key(n).alias("key"), strings.snake(F.col("p_type")).alias("snake"), strings.generated_id("P", F.col("p_brand"), number=F.col("p_size")).alias("id"),
        F.substring(strings.legacy_token(n), 8, 20).alias("token"), strings.text_or(F.when(F.col("p_size") > 25, n), "not_available").alias("filled"),
    )


@query("select page_id, lower(regexp_extract(url, '://([^/]+)', 1)) as domain, contains(lower(url), 'example') as hosted from pages")
def q_domains(t):
    return t("pages").select("page_id", strings.domain(F.col("url")).alias("domain"), strings.host_in(F.col("url"), ("example",)).alias("hosted"))


@query("""
select n_nationkey, 'X ' || upper(left(lower(n_name), 1)) || substring(lower(n_name), 2) as label, replace(lower(n_name), '_', ' ') as key, case n_nationkey % 5 when 0 then 'police' when 1 then 'fire' when 2 then 'non_safety' when 3 then 'unclear' else 'unknown' end as unit,
case n_nationkey % 4 when 0 then 'city' when 1 then 'third_party' when 2 then 'unknown' else 'blog_x' end as owner, case n_nationkey % 3 when 0 then 'cba' when 1 then 'arbitration_award' else 'unknown' end as kind from nation""")
def q_labels(t):
    k = F.col("n_nationkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % n + 1).cast("int"))
    plain = F.regexp_replace("n_name", " ", "")
    n = t("nation").withColumn("n_name", plain)
    return n.select(
        "n_nationkey", strings.strip_prefix_title(F.concat(F.lit("TOWN OF  x "), F.col("n_name"))).alias("label"), strings.name_key(F.concat("n_name", F.lit(" Township"))).alias("key"),
        strings.unit_kind(pick(5, "Police Dept", "fire-fighters", "Non-Safety", "mixed", "?")).alias("unit"), strings.owner_kind(pick(4, "City Council", "legal-database", "", "Blog X")).alias("owner"),
        strings.first_pattern(pick(3, "Full Agreement", "interest_arbitration_award", "nothing"), strings.DOCUMENT_KINDS).alias("kind"),
    )


@query("""
select doc_id, regexp_replace(text, '((token|password)[ ]*[=:][ ]*)[^ ,;]+', '\\1[REDACTED]', 'g') as redacted from documents where regexp_matches(text, '(token|password)[ ]*[=:]')""")
def q_redact(t):
    d = t("documents").filter(F.col("text").rlike("(token|password)[ ]*[=:]"))
    return d.select("doc_id", strings.redact(F.col("text"), patterns=("((?:token|password)[ ]*[=:][ ]*)[^ ,;]+",), limit=None).alias("redacted"))


@query("""
select o_orderkey, strftime(o_orderdate, '%Y') || '-' || strftime(l, '%Y') as cycle, greatest(year(o_orderdate), year(l)) as newest, least(year(o_orderdate), year(l)) as oldest, case when o_orderdate >= '2000-01-01' then strftime(o_orderdate, '%Y-%m-%d') when l >= '2000-01-01' then strftime(l, '%Y-%m-%d') end as found,
  case when l < o_orderdate then date_diff('day', l::date, o_orderdate::date) else 0 end as days from orders join (select l_orderkey, max(l_shipdate) as l from lineitem group by 1) on l_orderkey = o_orderkey""")
def q_years(t):
    last = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("l"))
    o = t("orders").join(last, F.col("l_orderkey") == F.col("o_orderkey"))
    d = lambda c: F.date_format(c, "yyyy-MM-dd")
    text = F.concat(F.lit("run "), d("o_orderdate"), F.lit(" to "), d("l"))
    y = values.years_in(text)
    gap = values.gap_days(d("o_orderdate"), d("o_orderdate"), F.lit("1990-1-1"), d("l"))
    return o.select("o_orderkey", values.cycle_key(d("o_orderdate"), d("l")).alias("cycle"), F.array_max(y).cast("bigint").alias("newest"), F.array_min(y).cast("bigint").alias("oldest"), values.date_in(text, required=False).alias("found"), gap.cast("bigint").alias("days"))


@query("""
select doc_id, len(p) as n_paragraphs, len(list_filter(p, lambda x: len(x) <= 80 and regexp_matches(x, '^(article|section|sec|art)\\b', 'i'))) as n_named, len(p[1]) as first_length
from (select doc_id, list_filter(list_transform(case when len(string_split_regex(text, '\\n\\s*\\n')) < 3 then string_split(text, chr(10)) else string_split_regex(text, '\\n\\s*\\n') end, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as p from documents)""")
def q_paragraphs(t):
    d = t("documents").select("doc_id", clauses.paragraphs(F.col("text")).alias("p"))
    named = F.filter("p", lambda x: (F.length(x) <= 80) & x.rlike(r"(?i)^(article|section|sec|art)\b"))
    return d.select("doc_id", F.size("p").cast("bigint").alias("n_paragraphs"), F.size(named).cast("bigint").alias("n_named"), F.length(F.get("p", F.lit(0))).cast("bigint").alias("first_length"))


@query("""
select doc_id, (k is not null)::int as license_flag, p[k] as license_text from (select doc_id, p, list_min(list_filter(range(1, len(p) + 1), lambda i: regexp_matches(p[i], 'licen[sc]e', 'i') and not regexp_matches(p[i], 'other\\s+than', 'i'))) as k
from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as p from documents)) where k is not null""")
def q_clause_scan(t):
    kinds = {"license": (r"licen[sc]e",)}
    out = clauses.scan_clauses(t("documents").select("doc_id", "text"), "text", kinds, guarded=("license",), compared=(), flag_only=())
    return out.filter("license_flag = 1").select("doc_id", "license_flag", "license_text")


@query("""
select doc_id, item_id from documents d, benchmark b where len(b.text) >= 15 and contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))))""")
def q_verbatim(t):
    return quotes.quotes_in(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text")


@query("""
with h as (select doc_id, term, k, text, list_filter(range(1, len(text) + 1), lambda i: substring(lower(text), i, len(term)) = term) as p from documents, (values ('token', 1), ('password', 2), ('licence', 3), ('license', 4)) v(term, k)),
e as (select doc_id, term, k, text, unnest(p[1:3]) as s, unnest(range(1, len(p[1:3]) + 1)) as j from h), n as (select *, row_number() over (partition by doc_id order by k, j) as number from e)
select doc_id, term, number::int as number, (s - 1)::int as start, substring(text, greatest(s - 200, 1), (s + len(term) + 200 - greatest(s - 200, 1))::int) as "window" from n where number <= 15
union all select doc_id, null, null, null, 'NO MATCH' from documents where doc_id not in (select doc_id from e)""")
def q_windows(t):
    return clauses.evidence_windows(t("documents").select("doc_id", "text"), "doc_id", "text", ["token", "password", "licence", "license"])


@query("""
with c as (select doc_id, len(w) as n, list_sort(list_transform(range(1, len(w) + 1), lambda i: {'n': -len(trim(w[i])), 'i': i, 'p': trim(w[i])}))[1].p as cut from (select doc_id, string_split(text, chr(10)) as w from documents)),
f as (select *, instr(cut, ' the ') as hit, trim(substring(cut, 1, greatest(instr(cut, ' the ') - 1, 0))) as l, trim(substring(cut, instr(cut, ' the ') + 5)) as r from c)
select doc_id, case when hit = 0 then cut when len(l) >= len(r) then l else r end as text, case when n > 1 then 'separator removed' when hit > 0 then 'fragment removed' else '' end as note from f""")
def q_leak_clean(t):
    d = t("documents").select("doc_id", clauses.clean_leak(F.col("text"), "\n", " the ").alias("c"))
    return d.select("doc_id", "c.text", "c.note")


def _any(terms) -> str:
    return "(" + " or ".join("contains(e, '" + x.replace("'", "''") + "')" for x in terms) + ")"


def _rule_sql(rule) -> str:
    parts = [_any(g) for g in rule.get("all", ())] + ["regexp_matches(e, '" + p + "')" for p in rule.get("like", ())]
    return "(" + " and ".join(parts + [f"not {_any(g)}" for g in [rule.get("none")] if g]) + ")"


_OPENINGS = (
    "Wages of comparable towns: ", "Cost-of-living: ", "FY 2019 a 3.5% raise ", "A market adjustment ", "IBEW local 7 ", "The chart on drug testing in each town ", "Longevity varies by community ", "Therefore the award ", "Salary above other employers ",
    "Pay and longevity in peer communities are higher than here ", "",
)


@query("select id, case when " + " or ".join(map(_rule_sql, clauses.IRRELEVANT)) + " then 'irrelevant' when " + " or ".join(map(_rule_sql, clauses.RELEVANT)) + " then 'relevant' else 'ambiguous' end as relevance from (select id, lower(x) as e from (select 1000000 + item_id as id, list_extract(["
       + ", ".join(f"'{x}'" for x in _OPENINGS) + "], (item_id % 11 + 1)::int) || text as x from benchmark union all select 2000000 + item_id, list_extract([" + ", ".join(f"'{x}'" for x in _OPENINGS) + "], (item_id % 11 + 1)::int) from benchmark union all select doc_id, text from documents))")
def q_relevance(t):
    """Whole documents and passages, and openings of which each fires one rule."""
    opening = F.element_at(F.array(*[F.lit(x) for x in _OPENINGS]), (F.col("item_id") % 11 + 1).cast("int"))
    b = t("benchmark")
    rows = b.select((F.col("item_id") + 1000000).alias("id"), F.concat(opening, "text").alias("x")).unionByName(b.select((F.col("item_id") + 2000000).alias("id"), opening.alias("x")))
    return rows.unionByName(t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("x"))).select("id", clauses.relevance(F.col("x")).alias("relevance"))


@query("""
select lang, source, status, excerpt, skipped, seq, status = 'present' and c as verified from (select *, row_number() over (partition by lang, source order by o) - 1 as seq from (
select lang, source, status, case when status = 'present' then text else '' end as excerpt, min(doc_id) as o, count(*) - 1 as skipped, bool_or(coalesce(quality, 0) = 1) as c
from (select *, case doc_id % 5 when 0 then 'not_found' when 1 then 'unclear' else 'present' end as status from documents left join labels using (doc_id)) group by 1, 2, 3, 4))""")
def q_evidence_layer(t):
    k = F.col("doc_id") % 5
    d = matching.labels_of(t("documents").select("doc_id", "text", "lang", "source"), t("labels").select("doc_id", "quality"), "doc_id")
    d = d.select("doc_id", "lang", "source", F.col("text").alias("x"), F.when(k == 0, "not_found").when(k == 1, "odd").otherwise("present").alias("st"), F.lit("").alias("no"), (F.coalesce("quality", F.lit(0)) == 1).alias("ok"))
    out = evidence.evidence_layer(d, "lang", "source", "st", "x", "no", "doc_id", F.col("ok"))
    return out.select("lang", "source", "status", "excerpt", F.col("skipped").cast("bigint").alias("skipped"), F.col("seq").cast("bigint").alias("seq"), "verified")


@query("select lang, source, doc_id from documents join labels using (doc_id) where quality = 1 and toxic = 0 and lang = 'en' and contains(lower(text), 'ing')")
def q_default_view(t):
    d = t("documents").join(t("labels"), "doc_id").select("doc_id", "lang", "source", F.lit("present").alias("status"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("verified"), F.col("text").alias("excerpt"), F.lit("").alias("notes"))
    return evidence.default_view(d, {"lang": "en"}, "ING").select("lang", "source", "doc_id")


@query("select doc_id, t as term from documents, (values ('licen'), ('token'), ('password'), ('worthless')) v(t) where contains(lower(text), t)")
def q_forbidden_terms(t):
    return evidence.forbidden_terms(t("documents").select("doc_id", "text"), "doc_id", "text", ["licen", "token", "password", "worthless"])


@query("select distinct page_id, regexp_replace(u, '[.,;:!?]+$', '') as url from (select page_id, unnest(regexp_extract_all(html || ' see ' || url || '.', 'https?://[^\\s<>\"'')\\]]+')) as u from pages)")
def q_urls(t):
    return t("pages").select("page_id", F.explode(strings.urls_in(F.concat("html", F.lit(" see "), "url", F.lit(".")))).alias("url"))


@query("select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as page from documents")
def q_pages(t):
    text = F.regexp_replace("text", "\n", "\f")
    return t("documents").select("doc_id", clauses.page_at(text, F.length(text)).cast("bigint").alias("page"))


@query("select c_custkey, list_filter(['MACHINERY', 'BUILDING'], lambda x: x = c_mktsegment)[1] as best from customer where c_mktsegment in ('MACHINERY', 'BUILDING') union all select c_custkey, c_mktsegment from customer where c_mktsegment not in ('MACHINERY', 'BUILDING')")
def q_best_of(t):
    return t("customer").select("c_custkey", nested.best_of(F.array("c_mktsegment"), ("MACHINERY", "BUILDING")).alias("best"))


@query("select user_id, event_type, n from (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, event_type) as k from events group by 1, 2) where k = 1")
def q_first_by_rank(t):
    n = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return ranking.first_per_key(n, ["user_id"], [F.desc("n"), F.asc("event_type")])
