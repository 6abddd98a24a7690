"""Record operators: projections with typed blanks, index documents, picked batches, resume gates, source rows, texts by condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clauses import any_term
from ..functions.strings import blank, urls_in
from ..functions.values import bands
from . import scans

# Filters.

# Markers of a records request.
REQUEST_MARKERS = ("foia", "public records request", "prr", "opra", "rtkl", "records request")


def failures_only(df: DataFrame, successes: str, failures: str) -> DataFrame:
    """Rows that failed at least once and never succeeded."""
    return df.filter((F.coalesce(failures, F.lit(0)) > 0) & (F.coalesce(successes, F.lit(0)) == 0))


def valid_scores(df: DataFrame, score: str) -> DataFrame:
    """Rows with a score; a negative one marks an error."""
    return df.filter(F.col(score) >= 0)


def without_locator(df: DataFrame, locator: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a locator, and per group how many were there and how many dropped for want of one."""
    gone = blank(F.trim(F.col(locator)))
    return df.filter(~gone), df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(gone).alias("dropped"))


def leaderboard(df: DataFrame, n: str, order: list[Column], least: int = 10) -> DataFrame:
    """Groups with a large enough sample, best first."""
    return df.filter(F.col(n) >= least).orderBy(*order)


def mentions_request(text: Column) -> Column:
    return F.coalesce(any_term(text, REQUEST_MARKERS), F.lit(False))


def wrong_unit(given: Column, verified: Column) -> Column:
    """A row taken for an ordinary unit that turned out to be police or fire."""
    return F.coalesce((F.trim(given) == "non_safety") & F.trim(verified).isin("police", "fire"), F.lit(False))


def in_scope_units(df: DataFrame, area: str, areas: dict[str, str], kind: str, kinds: tuple[str, ...], active: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Active units of the listed kinds in mapped areas, with the area's label; and the keys that repeat among them."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in areas.items() for x in kv]), F.col(area))
    rows = df.withColumn("jurisdiction", label).filter(F.col("jurisdiction").isNotNull() & F.col(kind).isin(*kinds) & (F.col(active) == "Y"))
    return rows, rows.groupBy(key).count().filter("count > 1")


def ids_of(tables: list[DataFrame], key: str) -> DataFrame:
    """Distinct keys of several tables."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.unionByName(t.select(key))
    return out.distinct()


# Projections.


def typed(c: Column, kind: str) -> Column:
    """A text cell as a value: blanks are 0 (int0, percent0), null (float, percent) or false (yes); percents are of shares, to 4 places."""
    cell = F.when(~blank(F.trim(c)), F.trim(c))
    if kind == "int0":
        return F.coalesce(cell.cast("long"), F.lit(0).cast("long"))
    if kind == "float":
        return cell.cast("double")
    if kind in ("percent", "percent0"):
        share = F.round(100.0 * cell.cast("double"), 4)
        return F.coalesce(share, F.lit(0.0)) if kind == "percent0" else share
    return F.coalesce(cell == "yes", F.lit(False)) if kind == "yes" else c


def project(df: DataFrame, fields: dict[str, tuple[str, str]], derived: dict[str, str] | None = None) -> DataFrame:
    """Named fields of (column, kind) in order, then derived ones (SQL over the fields)."""
    out = df.select(*[typed(F.col(c).cast("string"), kind).alias(name) for name, (c, kind) in fields.items()])
    return out.selectExpr("*", *[f"{e} as {name}" for name, e in (derived or {}).items()])


def selected_or_first(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """The row whose key has the value, else the first in order; one row, by one aggregate."""
    best = F.min_by(F.struct(*df.columns), F.struct((~F.coalesce(F.col(key) == value, F.lit(False))).alias("other"), order.alias("o")))
    return df.agg(best.alias("r")).filter("r is not null").select("r.*")


# Roll-ups.


def extrapolated(df: DataFrame, by: str, cost: str, seconds: str, parsed: Column, pause: float = 5.0, per: int = 100) -> DataFrame:
    """Per group: rows, total cost, time of parsed rows, and cost and time that ``per`` rows would take with a pause after each."""
    n, ok = F.count("*"), F.count_if(parsed)
    spent, took = F.coalesce(F.sum(cost), F.lit(0.0)), F.coalesce(F.sum(F.when(parsed, F.col(seconds))), F.lit(0.0))
    return df.groupBy(by).agg(
        n.alias("n"), spent.alias("total_cost"), took.alias("parsed_seconds"), (spent / n * per).alias("estimated_cost"),
        ((took / F.greatest(ok, F.lit(1)) + pause) * per).alias("estimated_seconds"),
    )


def action_summary(plan: DataFrame, key: str, action: str, order: str, size: int = 10_000) -> DataFrame:
    """Each action with its number of rows and their non-blank keys in order, ``size`` of them a row (part 1, 2, ...); an action without keys has one row."""
    n = plan.groupBy(action).agg(F.count("*").alias("n"))
    told = plan.filter(~blank(F.trim(F.col(key).cast("string")))).select(action, F.col(order).alias("_o"), F.col(key).alias("_k"))
    lists = scans.chunked_lists(told.withColumnRenamed(action, "_action"), ["_action"], [F.col("_o"), F.col("_k")], F.col("_k"), size, "keys")
    none = F.array().cast(lists.schema["keys"].dataType)
    both = n.join(lists, F.col(action).eqNullSafe(F.col("_action")), "left")
    return both.select(action, "n", F.coalesce("part", F.lit(1)).alias("part"), F.coalesce("keys", none).alias("keys"))


def evidence_counts(df: DataFrame, status: str, verified: Column, flagged: Column, labelled: Column) -> DataFrame:
    present = F.col(status) == "present"
    return df.agg(
        F.count("*").alias("n"), F.count_if(present).alias("present"), F.count_if(~F.coalesce(present, F.lit(False))).alias("not_found"), F.count_if(verified).alias("verified_present"),
        (F.count_if(present) - F.count_if(verified)).alias("unverified_present"), F.count_if(flagged).alias("flagged"), F.count_if(labelled).alias("labelled"),
    )


# Picked batches.


def pick_named(
    picks: DataFrame, universe: DataFrame, by: list[str], key: str, coverage: DataFrame, queued: DataFrame, links: DataFrame,
    fits: Column, banned: tuple[str, ...], name: str, n_links: str,
) -> DataFrame:
    """Picks resolved by name, each with its key and the faults that bar it (array; empty if none).

    Faults, in order: not one fitting row of that name; touched before; failed before; queued; in the
    corpus; a banned name; links that do not number what the row states. ``coverage`` has status,
    failed and in_corpus per key. Every side is one row per name or key before it is joined.
    """
    u = universe.filter(fits).groupBy(*by).agg(F.count("*").alias("_n"), F.min(F.struct(key, n_links)).alias("_u"))
    out = picks.join(u, by, "left").withColumn(key, F.when(F.col("_n") == 1, F.col(f"_u.{key}"))).withColumn("_want", F.col(f"_u.{n_links}"))
    out = out.join(coverage.select(key, F.col("status").alias("_st"), F.col("failed").alias("_fl"), F.col("in_corpus").alias("_ic")), key, "left")
    out = out.join(queued.select(key).distinct().withColumn("_q", F.lit(True)), key, "left").join(links.groupBy(key).agg(F.count("*").alias("_have")), key, "left")
    one = F.col("_n") == 1
    tests = [
        (~F.coalesce(one, F.lit(False)), "not_one_match"), (one & ~F.col("_st").eqNullSafe("not_scouted"), "not_untouched"), (one & (F.coalesce("_fl", F.lit(0)) != 0), "failed_before"),
        (F.col("_q"), "in_queue"), (one & ~F.col("_ic").eqNullSafe("no"), "in_corpus"), (F.col(name).isin(*banned), "banned_name"), (one & (F.coalesce("_have", F.lit(0)) != F.col("_want")), "link_mismatch"),
    ]
    faults = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for t, n in tests]), lambda x: x.isNotNull())
    return out.withColumn("faults", faults).select(*picks.columns, key, "faults")


# Names of a batch's parts by rank: the part after the named number of ranks.
RANK_BUCKETS = ((40, "smaller_place_employer_diversity"), (25, "regional_municipal_employer_expansion"), (10, "high_population_place_expansion"))
FIRST_RANK_BUCKET = "largest_remaining_place_employer"


def rank_bucket(rank: Column, cuts: tuple[tuple[int, str], ...] = RANK_BUCKETS, first: str = FIRST_RANK_BUCKET) -> Column:
    return bands(rank - 1, list(cuts), first)


def bucket_texts(df: DataFrame, bucket: str, targets: DataFrame, on: list[str], templates: dict[str, str], target_bucket: str) -> DataFrame:
    """Reason by the row's bucket: a template with {column} places; of the target bucket, from its target's row (none: an error)."""
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*df.columns, *[c for c in targets.columns if c not in on]]}

    def fill(template: str) -> Column:
        out = F.lit(template)
        for c, v in cells.items():
            if "{" + c + "}" in template:
                out = F.replace(out, F.lit("{" + c + "}"), v)
        return out

    joined = df.join(targets.withColumn("_t", F.lit(True)), on, "left")
    text = F.raise_error(F.concat(F.lit("unknown bucket "), F.col(bucket)))
    for name, template in templates.items():
        own = fill(template)
        if name == target_bucket:
            own = F.when(F.col("_t"), own).otherwise(F.raise_error(F.lit("no target")))
        text = F.when(F.col(bucket) == name, own).otherwise(text)
    return joined.withColumn("reason", text).select(*df.columns, "reason")


# Opening of a handed-over row's notes, by the first condition that holds.
HANDOFF = (
    ("no_url", "Parsed response lacks a source URL; preserve this row in the scout handoff but do not place it in the source-candidate queue or infer a locator. "),
    ("blocked", "Resolve blocked/unreadable access without treating the source as dead. "),
    ("context", "Retain as context/locator only unless a binding wage-setting instrument is established later. "),
    ("insufficient", "Retain as insufficient unless later evidence establishes a qualifying source. "),
)


def handoff_note(url: Column, blocked: Column, context: Column, stage: Column) -> Column:
    tests = {"no_url": blank(F.trim(url)), "blocked": blocked == "yes", "context": context == "yes", "insufficient": stage == "insufficient_candidate"}
    return F.coalesce(*[F.when(tests[k], F.lit(text)) for k, text in HANDOFF], F.lit(""))


# Sentences on an excerpt.
NO_EXCERPT = "No excerpt was returned for this attribute in the selected source window."
PLAIN_EXCERPT = "This excerpt was coded under this attribute based on the source text."


def excerpt_note(df: DataFrame, attribute: str, status: str, info: DataFrame) -> DataFrame:
    """Adds ``note``: what an excerpt shows, by its status and its attribute's label and clause."""
    known = F.concat(F.lit("This excerpt was coded as evidence of "), F.col("label"), F.lit(" because "), F.col("clause"), F.lit("."))
    note = F.when(~F.coalesce(F.col(status) == "present", F.lit(False)), NO_EXCERPT).when(F.col("label").isNotNull(), known).otherwise(PLAIN_EXCERPT)
    return df.join(info.select(F.col("attribute").alias(attribute), "label", "clause"), attribute, "left").withColumn("note", note).select(*df.columns, "note")


def file_evidence(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """Adds file_exists, file_type and method by the row's path: none stated, not among ``files`` (path), or there."""
    there = files.select(F.col("path").alias(path)).distinct().withColumn("_f", F.lit(True))
    kind = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = df.join(there, path, "left").withColumn("file_exists", F.coalesce("_f", F.lit(False)))
    none = blank(F.trim(F.col(path)))
    method = F.when(none, "no_path").when(~F.col("file_exists"), "file_not_found").otherwise("to_extract")
    return out.withColumn("file_type", F.when(none, "").when(kind == "", "unknown").otherwise(kind)).withColumn("method", method).select(*df.columns, "file_exists", "file_type", "method")


# Documents.


def index_faults(df: DataFrame, key: str, entries: str, texts: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """(key, entry from 1 or 0 for the whole, fault) of index documents: JSON lists of reports.

    An entry must hold every text (not blank), a list of non-blank tags, a boolean ``current`` and
    exactly the named metrics as whole numbers from 0. Of a document exactly one entry is current,
    ids are distinct, and there is at least one entry.
    """
    fields = [*texts, "tags", "current", "metrics_snapshot"]
    doc = F.from_json(F.col(entries), "array<map<string,string>>")
    each = df.select(key, F.posexplode_outer(doc).alias("_i", "e"))
    field = lambda f: F.element_at("e", F.lit(f))
    whole = F.from_json(field("metrics_snapshot"), "map<string,string>")
    named = F.array_sort(F.map_keys(whole)) == F.array_sort(F.array(*[F.lit(m) for m in metrics]))
    tags = F.from_json(field("tags"), "array<string>")
    tests = [(~F.map_contains_key("e", F.lit(f)), f"missing {f}") for f in fields]
    tests += [(F.map_contains_key("e", F.lit(f)) & blank(F.trim(field(f))), f"blank {f}") for f in texts]
    tests += [
        (F.map_contains_key("e", F.lit("tags")) & ~F.coalesce(F.forall(tags, lambda t: ~blank(F.trim(t))), F.lit(False)), "bad tags"),
        (F.map_contains_key("e", F.lit("current")) & ~F.coalesce(field("current").isin("true", "false"), F.lit(False)), "bad current"),
        (F.map_contains_key("e", F.lit("metrics_snapshot")) & ~F.coalesce(named, F.lit(False)), "other metrics"),
        (F.coalesce(F.exists(F.map_values(whole), lambda v: ~v.rlike(r"^\d+$")), F.lit(False)), "bad metric"),
    ]
    one = each.filter("e is not null").select(key, (F.col("_i") + 1).alias("entry"), F.explode(F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for t, n in tests]), lambda x: x.isNotNull())).alias("fault"))
    sums = each.groupBy(key).agg(F.count("e").alias("n"), F.count_if(field("current") == "true").alias("c"), F.count(field("id")).alias("ids"), F.count_distinct(field("id")).alias("d"))
    faults = F.filter(F.array(F.when(F.col("n") == 0, "no entries"), F.when((F.col("n") > 0) & (F.col("c") != 1), "not one current"), F.when(F.col("ids") != F.col("d"), "repeated ids")), lambda x: x.isNotNull())
    return one.unionByName(sums.select(key, F.lit(0).alias("entry"), F.explode(faults).alias("fault")))


TERMINAL = ("completed", "completed_no_parseable_outcome", "no_response_rows")


def resume_faults(metadata: DataFrame, timing: DataFrame, run: str, identity: str) -> DataFrame:
    """(run, fault) of prior runs that may not be resumed: not live, no terminal state, no input hash, no rows, repeated identities."""
    rows = timing.groupBy(run).agg(F.count("*").alias("_n"), F.count_distinct(identity).alias("_d"))
    m = metadata.join(rows, run, "left")
    tests = [
        ((F.col("mode") != "live") | ~F.coalesce("live_attempted", F.lit(False)), "not_live"), (~F.coalesce(F.col("execution_status").isin(*TERMINAL), F.lit(False)), "not_terminal"),
        (blank(F.trim(F.col("input_hash"))), "no_input_hash"), (F.coalesce("_n", F.lit(0)) == 0, "no_rows"), (F.col("_n") > F.col("_d"), "repeated_identity"),
    ]
    return m.select(run, F.explode(F.filter(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for t, n in tests[:3]], *[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for t, n in tests[3:]]), lambda x: x.isNotNull())).alias("fault"))


def input_union(contracts: DataFrame, awards: DataFrame) -> DataFrame:
    """Contracts as they are and awards with ids derived from place, class, year and docket; awards without a URL are left out."""
    year = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit("")), F.lit(""))
    a = awards.filter(~blank(F.trim(F.col("url"))))
    docket = F.regexp_replace(F.trim(F.col("docket")), "[/ ]", "_")
    first = contracts.select("doc_id", "place", "class", F.concat_ws("-", year(F.col("start")), year(F.col("end"))).alias("cycle"), F.lit("contract").alias("kind"))
    return first.unionByName(a.select(F.concat_ws("_", "place_id", "class", F.lit("award"), year(F.col("date")), docket).alias("doc_id"), "place", "class", year(F.col("date")).alias("cycle"), F.lit("arbitration_award").alias("kind")))


def source_rows(df: DataFrame, key: str, response: str, items: str, owners: dict[str, str], official: tuple[str, ...]) -> DataFrame:
    """A row per source of each response: its text's URLs in order, else its metadata items (array of url, title, owner).

    Titles stand in bold in the text and are paired with URLs by position; else the metadata's
    title; else 'not_parseable_from_response'. Owners come from the metadata, else by what the URL
    holds. Metadata rows say 'not_returned' for what they lack.
    """
    titles = F.filter(F.array_distinct(F.transform(F.regexp_extract_all(response, F.lit(r'\*\*["“]?([^*"“”]+)["”]?\*\*'), F.lit(1)), lambda x: F.regexp_replace(x, r"^[ :-]+|[ :-]+$", ""))), lambda x: x != "")
    unknown = "not_parseable_from_response"
    d = df.select(key, urls_in(F.col(response)).alias("urls"), titles.alias("titles"), F.coalesce(items, F.array().cast(df.schema[items].dataType)).alias("items"))
    by_url = lambda u: F.get(F.filter("items", lambda x: x["url"] == u), F.lit(0))
    owner_of = lambda u: F.coalesce(*[F.when(F.contains(u, F.lit(k)), F.lit(v)) for k, v in owners.items()], F.lit(unknown))
    full = lambda c: F.when(~blank(c), c)
    from_text = F.transform("urls", lambda u, i: F.struct(
        (i + 1).alias("position"), u.alias("url"), F.coalesce(F.get("titles", i), full(by_url(u)["title"]), F.lit(unknown)).alias("title"),
        F.coalesce(full(by_url(u)["owner"]), owner_of(u)).alias("owner"), F.when(any_term(u, official), "official_source").otherwise("not_classified").alias("owner_kind"), F.lit("response_text").alias("origin")))
    none = F.lit("not_returned")
    from_items = F.transform("items", lambda x, i: F.struct(
        (i + 1).alias("position"), F.coalesce(full(x["url"]), none).alias("url"), F.coalesce(full(x["title"]), none).alias("title"), F.coalesce(full(x["owner"]), none).alias("owner"),
        F.lit("not_classified").alias("owner_kind"), F.lit("metadata").alias("origin")))
    return d.select(key, F.explode(F.when(F.size("urls") > 0, from_text).otherwise(from_items)).alias("s")).select(key, "s.*")


def signal(df: DataFrame, key: str, response: str, rows: DataFrame, columns: list[str], groups: list[tuple[str, ...]]) -> DataFrame:
    """(key, found): whether a response with the texts of its rows holds a term of every group."""
    said = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", *columns))), " ").alias("_rows"))
    text = F.lower(F.concat_ws(" ", F.coalesce(response, F.lit("")), F.coalesce("_rows", F.lit(""))))
    found = F.lit(True)
    for terms in groups:
        found = found & any_term(text, terms)
    return df.join(said, key, "left").select(key, found.alias("found"))


def ordered_by_labels(df: DataFrame, labels: list[str], name: str = "position") -> DataFrame:
    """Global position in the order of several labels as people sort them (case and accents last), missing labels as blank."""
    from .ranking import position

    return position(df, [F.collate(F.coalesce(c, F.lit("")), "UNICODE") for c in labels], name)
