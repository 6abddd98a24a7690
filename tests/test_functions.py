"""Column functions on hand-made rows: names, dates, numbers, JSON and clauses."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import clauses, nested, strings, values


@pytest.fixture
def ask(spark):
    """Values of expressions over one row of text columns a, b, c, d."""

    def run(row, *columns):
        df = spark.createDataFrame([tuple(row) + (None,) * (4 - len(row))], "a string, b string, c string, d string")
        out = df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)]).first()
        return out[0] if len(columns) == 1 else tuple(out)

    return run


A, B, C, D = (F.col(c) for c in "abcd")


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (strings.squeeze, "  a \n b\t", "a b"), (strings.fold, " A  b", "a b"), (strings.alnum_key, "St. Mary's-Town", "st mary s town"),
        (strings.strip_suffix, "Juneau City and Borough", "Juneau"), (strings.strip_suffix, "Oak  Township", "Oak"), (strings.strip_suffix, "City", "City"),
        (strings.title_case, "O'FALLON WINSTON-SALEM", "O'Fallon Winston-Salem"), (strings.strip_prefix_title, "CHARTER TOWNSHIP OF  FLINT", "Flint"),
        (strings.name_key, "St. Paul city", "st paul"), (strings.area_key, "City and Borough of Juneau", "juneau"), (strings.area_key, "Prince George's County", "prince_georges"),
        (strings.area_key, "Yukon-Koyukuk Census Area", "yukon-koyukuk"), (strings.owner_kind, "City Council", "city"), (strings.owner_kind, "", "unknown"), (strings.owner_kind, "My Blog", "my_blog"),
        (strings.unit_kind, "Non-Safety", "non_safety"), (strings.unit_kind, "police officers", "police"), (strings.unit_kind, "mixed", "unclear"), (strings.unit_kind, None, "unknown"),
        (strings.domain, "https://A.example.org:8080/x", "a.example.org:8080"), (strings.domain, "no scheme", None), (strings.yes_no, " YES ", "yes"), (strings.yes_no, "true", "unclear"), (strings.truthy, " TRUE ", True), (strings.truthy, "maybe", False),
        (values.compact_date, "run_20260715_x", "2026-07-15"), (values.compact_date, "x", "unknown-date"), (values.date_in, "scout-2026-07-15-a", "2026-07-15"),
        (values.joined_dates, "b 2026-02-01; a 2026-01-05;x; 2026-02-01", "2026-01-05; 2026-02-01"), (clauses.relevance, "Wages in comparable communities", "relevant"),
        (clauses.relevance, "CPI adjustment of wages in comparable communities", "irrelevant"), (clauses.relevance, "hello", "ambiguous"), (clauses.relevance, "FY 2021 - 2.5%", "irrelevant"),
        (clauses.relevance, "AFSCME local 12 wages", "irrelevant"), (clauses.relevance, "Accordingly the award stands", "irrelevant"), (clauses.relevance, "other towns pay officers", "relevant"),
    ],
)
def test_text_functions(ask, f, given, want):
    assert ask([given], f(A)) == want


def test_document_kinds_by_first_pattern(ask):
    kind = lambda x: ask([x], strings.first_pattern(A, strings.DOCUMENT_KINDS))
    assert [kind(x) for x in ("cba", "police interest_arbitration_award", "City ordinance and full agreement", "meeting minutes", "", "zzz")] == ["cba", "arbitration_award", "ordinance_or_policy", "meeting_minutes", "unknown", "unknown"]


def test_area_kinds(ask):
    kind = lambda s, n: ask([s, n], strings.area_kind(A, B))
    assert [kind(*x) for x in (("DC", "x"), ("CT", "x"), ("LA", "x"), ("NV", "Carson City"), ("AK", "Nome Census Area"), ("AK", "Sitka City and Borough"), ("VA", "Salem city"), ("VA", "Wise County"))] == [
        "federal_district", "planning_region", "parish", "independent_city", "census_area", "city_and_borough", "independent_city", "county",
    ]


def test_identities_and_tokens(ask):
    one = lambda *r: ask(r, strings.row_identity(A, F.lit(None).cast("string"), B, C, D))
    assert one("k1", "ny", "5", "X") == "k1" and one(None, "ny", "5", "X") == "number|NY|5" and one(None, "ny", "", " Big  Town") == "name|NY|big town"
    with pytest.raises(Exception, match="row without identity"):
        one(None, "", "", "")
    assert len(ask(["x"], strings.legacy_token(A))) == len("legacy_") + 20


def test_redaction(ask):
    text = "Authorization: Bearer abc.def, api_key=SECRET1; subscription-key: zz my s3cr3t-long and s3cr3t"
    out = ask([text], strings.redact(A, ("s3cr3t", "s3cr3t-long")))
    assert not any(x in out for x in ("abc.def", "SECRET1", "zz", "s3cr3t")) and out.count("[REDACTED]") == 5 and ask(["x" * 3000], F.length(strings.redact(A))) == 2000


def test_dates_and_intervals(ask):
    assert [ask([x], values.valid_date(A)) for x in ("2020-1-5", "2020-02-30", "2020", "x", None)] == [True, False, False, False, False]
    over = lambda *r: ask(r, values.overlaps(A, B, C, D))
    gap = lambda *r: ask(r, values.gap_days(A, B, C, D))
    same = lambda *r: ask(r, values.same_cycle(A, B, C, D))
    assert over("2020-01-01", "2020-12-31", "2020-12-31", "2021-12-31") and not over("2020-01-01", "2020-12-31", "2021-01-01", "2021-12-31")
    assert over("2020", "2022", "2022-x", "2023") and not over("a", "b", "c", "d")
    assert gap("2020-01-01", "2020-12-31", "2021-01-10", "2021-12-31") == 10 and gap("2023", "2024", "2020", "2021") == 730 and gap("x", "y", "2020", "2021") is None
    assert ask(["2020-01-01", "2020-12-31", "2022-12-31", "2023-12-31"], values.adjacent(A, B, C, D)) and not ask(["2020-01-01", "2020-12-31", "2023-01-01", "2023-12-31"], values.adjacent(A, B, C, D))
    assert same("2020-01-01", "2022-06-30", "2020-07-01", "2022-12-31") and same("", "", None, "") and not same("2020", "2022", "2020", "2023")


def test_numbers(spark, ask):
    row = spark.range(1).select(
        values.ratio(F.lit(1), F.lit(0)).alias("a"), values.percent(F.lit(1), F.lit(3)).alias("b"), values.smoothed(F.lit(3), F.lit(5), F.lit(0.5)).alias("c"), values.clamp(F.lit(140)).alias("d"),
        values.quarter_band(F.lit(5), F.lit(10)).alias("e"), values.quarter_band(F.lit(0), F.lit(10)).alias("f"), values.score_band(F.lit(26)).alias("g"),
        values.ring_area(F.array(*[F.lit(float(x)) for x in (0, 2, 2, 0)]), F.array(*[F.lit(float(x)) for x in (0, 0, 2, 2)])).alias("h"),
        values.token_cost(F.lit(1_000_000), F.lit(2_000_000), F.lit(0.2), F.lit(1.25)).alias("i"), values.bands(F.lit(12000), [(50000, 50), (25000, 40), (10000, 30)], 0).alias("j"),
    ).first()
    assert row["a"] is None and row["b"] == 33.3333 and abs(row["c"] - 15.5 / 30) < 1e-12 and (row["d"], row["e"], row["f"], row["g"], row["h"], row["j"]) == (100, 2, 0, "26_50", 4.0, 30)
    assert abs(row["i"] - 2.7) < 1e-9
    e = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "k int, v double").groupBy("k").agg(values.standard_error(F.col("v")).alias("s"))
    assert {r["k"]: round(r["s"], 6) for r in e.collect()} == {1: 1.0, 2: 0.0}


@pytest.mark.parametrize(
    ("cell", "want"),
    [('{"a":1}', '{"a":1}'), ('Sure:\n```json\n{"a": {"b": 2}}\n```', '{"a":{"b":2}}'), ('before {"a":{"b":[1]}} after }', '{"a":{"b":[1]}}'), ("no json", None), ("{ broken", None), (None, None)],
)
def test_tolerant_json(ask, cell, want):
    assert ask([cell], nested.tolerant_json_text(A)) == want


def test_responses_become_rows(spark):
    df = spark.createDataFrame([(1, '{"candidates":[{"id":1},{"id":2}]}'), (2, '{"fire":[{"id":3}],"police":[{"id":4}]}'), (3, "oops"), (4, "{}")], "k int, r string")
    got = nested.candidates_or_failure(df, "r", "struct<id:int>", "candidates", ("police", "fire", "non_safety")).orderBy("k", "position").collect()
    assert [(r["k"], r["parse_status"], r["kind"], r["item"] and r["item"]["id"]) for r in got] == [(1, "parsed", None, 1), (1, "parsed", None, 2), (2, "parsed", "police", 4), (2, "parsed", "fire", 3), (3, "failed", None, None), (4, "empty", None, None)]


def test_lists(spark, ask):
    assert ask([" a; ;b ;"], nested.items(A)) == ["a", "b"] and ask(['["x","y"]'], nested.list_cell(A)) == ["x", "y"] and ask(["bare"], nested.list_cell(A)) == ["bare"] and ask([""], nested.list_cell(A)) == []
    row = spark.createDataFrame([(["q1", "q2"], [7], ["b", "z"])], "q array<string>, p array<int>, v array<string>").select(
        nested.zip_numbered(F.col("q"), F.col("p")).alias("z"), nested.best_of(F.col("v"), ("z", "a")).alias("best"), nested.best_of(F.col("v"), ("n",)).alias("least"), nested.has_all(F.col("v"), ("b",)).alias("all")
    ).first()
    assert [tuple(x) for x in row["z"]] == [(1, "q1", "7"), (2, "q2", "")] and (row["best"], row["least"], row["all"]) == ("z", "b", True)
    deep = '{"output":[{"sources":[{"url":"u1","title":"t","meta":{"x":[{"url":"no"}]}},{"title":"t","url":"u1"}]},{"y":{"sources":[{"url":"u2"},5,{"title":"no url"}]}}],"sources":[{"url":"outside"}]}'
    assert [tuple(x) for x in ask([deep], nested.sources_in(A))] == [("u1", "t"), ("u2", "")]
    assert ask(["not json"], nested.sources_in(A)) == [] and [tuple(x) for x in ask(["[" * 400 + '{"sources":[{"url":"u"}]}' + "]" * 400], nested.sources_in(A))] == [("u", "")]
    assert len(ask(["{'a': 'x', 'b': 'y'}"], nested.list_cell(A))) == 1 and ask(["['a', None]"], nested.list_cell(A)) == ["a", None]
    assert ask(["see https://a.b/c. and https://a.b/c, http://x.y"], strings.urls_in(A)) == ["https://a.b/c", "http://x.y"] and ask(["**One** x **Two** **One**"], strings.bold_in(A)) == ["One", "Two"]


INTEREST = {
    "The parties shall submit the impasse to interest arbitration under the statute.": 1,
    "Disputes go to last best offer before the panel.": 1,
    "This applies to employees but not employees who are eligible for interest arbitration.": 0,
    "Members are not subject to interest arbitration.": 0,
    "Other than units entitled to interest arbitration, all units receive it.": 0,
    "Grievances go to final and binding arbitration.": 0,
    "Not subject to interest arbitration.\nThe award of interest arbitration binds both.": 1,
}
COMPARED = {
    "Wages shall be comparable to the wages of neighboring communities in the county.": 1,
    "Comparable rank shall be kept.": 0,
    "Candidates from other major or comparable metropolitan cities are evaluated.": 0,
    "Comparability of benefits plans is reviewed.": 0,
}
STRIKES = {"There shall be no strikes.": 1, "A no-strike pledge.": 1, "No employee shall engage in any strike.": 1, "Work stoppages are forbidden.": 1, "Members shall not strike.": 1, "He may strike a balance.": 0}


@pytest.mark.parametrize(("texts", "flag"), [(INTEREST, "interest_arbitration_flag"), (COMPARED, "comparability_flag"), (STRIKES, "no_strike_flag")])
def test_clause_flags(spark, texts, flag):
    df = spark.createDataFrame(list(texts.items()), "t string, want int")
    assert [(r["t"], r[flag]) for r in clauses.scan_clauses(df, "t").collect()] == list(texts.items())


def test_headings_take_their_body_in(spark):
    text = "ARTICLE 5 INTEREST ARBITRATION\n\nEither party may ask for it.\n\n" + "x" * 130 + "\n\nmore\n\nArticle 6 Parity\n\nPay follows the average of surrounding cities' wages."
    row = clauses.scan_clauses(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert row["interest_arbitration_text"].startswith("ARTICLE 5") and row["interest_arbitration_text"].endswith("x") and row["comparability_text"].startswith("Article 6 Parity\nPay")
    assert row["comparability_referent"] and row["unresolved"] == ["me_too"]
    heads = spark.createDataFrame([("Section 4. Pay",), ("ALL CAPS TITLE",), ("A plain sentence.",), ("SHOUTED; NOT A TITLE",)], "t string")
    assert [r[0] for r in heads.select(clauses.is_heading(F.col("t"))).collect()] == [True, True, False, False]


def test_quotes(spark, ask):
    src = "The wages   of officers shall\nrise by two percent. ARTICLE 7 Leave. Sick leave accrues."
    assert ask(["wages of officers shall rise", src], clauses.is_verbatim(A, B)) and not ask(["wages of officers may rise", src], clauses.is_verbatim(A, B)) and not ask(["wages", src], clauses.is_verbatim(A, B))
    assert [ask([q, src], clauses.grounding(A, B)) for q in ("", "rise by two", "Rise By")] == ["not_applicable", "grounded", "unsupported"]
    assert ask([src, "Sick leave accrues."], clauses.location_before(A, B)) == "ARTICLE 7"
    assert ask(["a\fb\fc"], clauses.page_at(A, F.lit(4))) == 3
    row = spark.createDataFrame([(["one two three four five", "ONE  two three four five", "absent from the source text"], "so one two three four five.")], "q array<string>, s string").select(clauses.verified_excerpts(F.col("q"), F.col("s")).alias("v")).first()["v"]
    assert (row["kept"], row["unverified"], row["repeated"]) == (["one two three four five"], 1, 1)
    assert tuple(ask(["short -- a longer part -- x"], clauses.clean_leak(A, " -- ", "##"))) == ("a longer part", "separator removed")
    assert tuple(ask(["left ## the right side"], clauses.clean_leak(A, " -- ", "##"))) == ("the right side", "fragment removed")
    assert [ask([x], clauses.gold_audit(A, F.lit(y), F.lit(z))) for x, y, z in (("clear_positive", 40, "no"), ("clear_negative", 20, "yes"), ("false_positive_trap", 26, "yes"))] == ["clear_positive_below_51", "", "false_positive_trap_above_25;trap_flag_above_25"]


def test_windows(spark):
    df = spark.createDataFrame([(1, "aa x aa y aa z aa"), (2, "none"), (3, None)], "k int, t string")
    got = clauses.evidence_windows(df, "k", "t", ["AA", "y"], before=2, after=2).orderBy("k", "number").collect()
    assert [(r["k"], r["term"], r["number"], r["start"]) for r in got] == [(1, "AA", 1, 0), (1, "AA", 2, 5), (1, "AA", 3, 10), (1, "y", 4, 8), (2, None, None, None), (3, None, None, None)]
    assert got[1]["window"] == "x aa y" and got[4]["window"] == "NO MATCH"
