"""Operators on hand-made rows: matching, checks, ranks, ledgers, scans and sinks, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from strandline.functions import values
from strandline.operators import checks, evidence, ledgers, matching, ranking, records, rollups, scoring
from strandline.sources import commits, sinks, tables
from strandline.streaming import ledgers as streams


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


def test_first_tier_with_a_match_wins(spark):
    schema = "city string, unit string, s string, e string, w string, id string"
    left = spark.createDataFrame([("a", "police", "2020-01-01", "2022-12-31", None, "L1"), ("a", "fire", "2015-01-01", "2016-12-31", None, "L2"), ("b", "police", "2020-01-01", "2020-12-31", None, "L3"), ("c", "fire", None, None, None, "L4")], schema)
    right = spark.createDataFrame(
        [("a", "clerk", "2020-07-01", "2022-06-30", None, "R1"), ("a", "dpw", "2022-01-01", "2024-12-31", None, "R2"), ("a", "lib", "2018-06-01", "2019-06-01", None, "R3"), ("b", "dpw", "2025-01-01", "2026-01-01", None, "R4"), ("c", "dpw", "", "", None, "R5")], schema
    )
    got = {r["id"]: (r["tier"], r["n_matches"], r["match_ids"]) for r in matching.match_tiers(left, right, "city", "s", "e", "id", "unit").collect()}
    assert got == {"L1": ("exact", 1, ["R1"]), "L2": ("adjacent", 1, ["R3"]), "L3": ("unmatched", 0, []), "L4": ("exact", 1, ["R5"])}


def test_checks(spark):
    df = spark.createDataFrame([(2, "x", "2020-01-01", "0.02", "1"), (3, "", "2020-13-01", "2.0", "0"), (4, "y", "", "abc", "2"), (5, "x", None, "", None), (6, "z", "2020-1-5", "nan", "1")], "row int, id string, d string, p string, f string")
    assert rows(checks.required(df, "row", ["id"]), "row") == [("3",)] and rows(checks.dates(df, "row", ["d"]), "row") == [("3",)]
    assert rows(checks.in_range(df, "row", {"p": (-1, 1)}), "row", "message") == [("3", "out of range"), ("4", "not a number"), ("6", "out of range")]
    assert rows(checks.unique(df, "row", ["id"]), "row", "message") == [("5", "repeats row 2")]
    assert rows(checks.flag_agrees(df, "row", "f", F.col("id") == "x", F.col("id") != "z"), "row", "message") == [("4", "not 0 or 1"), ("5", "not 0 or 1")]
    assert rows(checks.resolves(df, "row", "id", spark.createDataFrame([("x",)], "k string"), "k"), "row") == [("4",), ("6",)]
    assert checks.report(checks.required(df, "row", ["id"]), checks.allowed(df, "row", {"id": ["x", "y", "z"]})).count() == 1


def test_ranks(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10, 20, 20, 40, None])], "id int, v int")
    assert [r["midrank"] for r in ranking.mid_rank(df, "v").orderBy("id").collect()] == [0.0, 0.5, 0.5, 1.0, None]
    many = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(97)))
    pos = {r["id"]: r["position"] for r in ranking.position(many, [F.col("x").desc(), F.col("id").asc()]).collect()}
    want = {r["id"]: i + 1 for i, r in enumerate(sorted(many.collect(), key=lambda r: (-r["x"], r["id"])))}
    assert pos == want
    tiers = ranking.cut_tiers(spark.range(10), [F.asc("id")]).orderBy("id").collect()
    assert [r["tier"] for r in tiers] == [1, 2, 3, 3, 4, 4, 4, 5, 5, 5]
    rr = ranking.round_robin(spark.createDataFrame([("a", 9), ("a", 8), ("a", 7), ("b", 6), ("c", 5)], "g string, s int").withColumn("t", F.lit(1)), "t", "g", [F.desc("s")])
    assert [r["s"] for r in rr.orderBy("position").collect()] == [9, 6, 5, 8, 7]
    gate = ranking.stop_gate(spark.createDataFrame([(1, i, f) for i, f in enumerate([True, False, True, True, False, True])], "k int, o int, f boolean"), ["k"], "o", F.col("f")).orderBy("o").collect()
    assert [r["failures_in_a_row"] for r in gate] == [1, 0, 1, 2, 0, 1] and [r["stopped"] for r in gate] == [False, False, False, False, True, True]


def test_positions_of_a_descending_text_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 0)], "s string, i int")
    got = {(r["s"], r["i"]): r["position"] for r in ranking.position(df, [F.col("s"), F.col("i")]).collect()}
    assert got == {(None, 3): 1, ("a", 2): 2, ("b", 0): 3, ("b", 1): 4}


def test_pacing_steps_down_and_backs_off(spark):
    run = [False] * 4 + [True, True, False, True] + [False] * 2
    got = ledgers.pacing(spark.createDataFrame([("r", i, f) for i, f in enumerate(run)], "run string, o int, f boolean"), ["run"], "o", F.col("f"), stable=2).orderBy("o").collect()
    assert [r["pause"] for r in got] == [5, 4, 4, 3, 10, 15, 15, 15, 15, 14]
    assert [r["event"] for r in got][:6] == ["stable_hold", "stable_step_down", "stable_hold", "stable_step_down", "backoff", "backoff"] and got[7]["event"] == "backoff_held"


def test_rollups(spark):
    dim = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    facts = spark.createDataFrame([("a", 1), ("a", 5), ("b", None)], "k string, v int")
    assert rows(rollups.rollup_all(dim, "k", facts, {"n": F.count("*"), "s": F.sum("v")})) == [("a", 2, 6), ("b", 1, 0), ("c", 0, 0)]
    assert rows(rollups.surplus(facts, "k")) == [(1,)] and rows(rollups.dominant(facts, ["k"], "v")) == [("a", 1, 0.5), ("b", None, 1.0)]
    assert rows(facts.groupBy("k").agg(rollups.exact_sum_or_blank(F.col("v")).cast("int").alias("s"))) == [("a", 6), ("b", None)]
    assert rows(rollups.counts_document(facts, "k")) == [({"a": 2, "b": 1},)]
    links = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1), ("a", 2)], "k string, f int")
    assert rows(rollups.rollup_through(dim, "k", links, spark.createDataFrame([(1, 10), (2, 20)], "f int, w int"), "f", {"w": F.sum("w")})) == [("a", 30), ("b", 10), ("c", 0)]
    e = rollups.facets(spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p")], "a string, b string"), ["a", "b"], {"a": "x"})
    assert rows(e) == [("a", "x", 2), ("a", "y", 1), ("b", "p", 1), ("b", "q", 1)]
    assert rows(rollups.inverted(spark.createDataFrame([("r1", ["x", "y"]), ("r2", ["x"])], "r string, l array<string>"), "r", "l", "i")) == [("x", 1, ["r1", "r2"]), ("y", 1, ["r1"])]
    many = spark.range(25).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("r"), F.array(F.lit("x")).alias("l"))
    assert [len(r["rs"]) for r in rollups.inverted(many, "r", "l", "i", size=10).orderBy("part").collect()] == [10, 10, 5]
    plan = records.action_summary(spark.createDataFrame([(i, "run" if i % 2 else "skip", None if i % 2 == 0 else f"k{i}") for i in range(9)], "o int, a string, k string"), "k", "a", "o", size=3)
    assert rows(plan) == [("run", 4, 1, ["k1", "k3", "k5"]), ("run", 4, 2, ["k7"]), ("skip", 5, 1, [])]


def test_scores(spark):
    parts = spark.createDataFrame([(1.0, 1.0, 0.5, 0.5, 0.5, 1.0, 0.0), (1.0, 0.4, 0.5, 0.5, 0.5, 1.0, 0.0)], list(scoring.PRIORITY_WEIGHTS))
    a, b = [r[0] for r in parts.select(scoring.priority()).collect()]
    assert abs(a - b - 6.0) < 1e-9
    one = spark.range(1).select(
        scoring.readiness(F.lit(10), F.lit(5), F.lit(20), F.lit(5), F.lit(True)).alias("r"), scoring.evidence_signal(F.lit(10), F.lit(True), F.lit(5), F.lit(False)).alias("e"),
        scoring.yield_advice(F.lit(30), F.lit(0.6), F.lit(0.1)).alias("y"), scoring.failure_kind(F.lit("Read timed out"), F.lit(""), F.lit(False), "timed out", "connection").alias("f"),
        scoring.text_quality(F.lit(50), F.lit(900), F.lit(3)).alias("q"), scoring.status(F.lit(0), F.lit(2), F.lit(0)).alias("s"),
    ).first()
    assert (one["r"], round(one["e"], 6), one["y"], one["f"], one["q"], one["s"]) == (75.0, 0.95, "moderate_yield_use_priority_targets", "timeout_or_capacity", ("ocr", "ocr_messy"), "scout_attempt_failed_connection")


def test_ledgers(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 0), (3, "d", 0), (3, "e", 1)], "k int, v string, s int")
    assert rows(ledgers.upsert(old.withColumn("s", F.lit(0)), new, ["k"], "s"), "k", "v") == [(1, "a"), (2, "c"), (3, "e")]
    batch = spark.createDataFrame([(0, "x", "1"), (1, "y", "1"), (2, "y", "1"), (3, "z", "")], "o int, id string, m string")
    got = ledgers.ingest_decisions(batch, spark.createDataFrame([("x",)], "id string"), "id", "o", checks.missing_fields(["m"]))
    assert rows(got, "o", "decision") == [(0, "duplicate"), (1, "ingested"), (2, "quarantined"), (3, "quarantined")]
    prior = spark.createDataFrame([("a", "success", None), ("b", "failed", "timeout"), ("c", "failed", "parse")], "k string, s string, f string")
    plan = ledgers.resume_plan(spark.createDataFrame([(c,) for c in "abcd"], "k string"), prior, "k", "s", "f", ("timeout",))
    assert rows(plan) == [("a", "skip"), ("b", "retry"), ("c", "hold"), ("d", "run")]
    cost = ledgers.cost_summary(spark.createDataFrame([(True, 1, 2, None, 0.5), (False, 3, 4, None, 0.25)], "ok boolean, i int, o int, a int, c double"), [], F.col("ok"), "i", "o", "a", "c").first()
    assert (cost["n"], cost["tokens"], cost["cost_parseable"], cost["cost_failed"]) == (2, 10, 0.5, 0.25)


def test_entity_resolution_and_merges(spark):
    uni = spark.createDataFrame([("NY", "a", 1, True), ("NY", "b", 2, False), ("NY", "b", 3, True), ("NY", "c", 4, True), ("NY", "c", 5, True)], "st string, k string, id int, muni boolean")
    got = matching.resolve_names(spark.createDataFrame([("NY", x) for x in "abcd"], "st string, k string"), uni, "st", "k", F.col("muni"))
    assert rows(got, "k", "resolution", "resolved_id") == [("a", "unique", 1), ("b", "preferred", 3), ("c", "ambiguous", None), ("d", "none", None)]
    with pytest.raises(Exception, match="no match for"):
        matching.complete_join(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int"), "k").collect()
    files = [spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")]
    assert rows(matching.first_of_files(files, "k")) == [("a", 1), ("b", 3)]


def test_contexts_are_one_whole_text_a_group(spark):
    rows = [("a", i, i % 7 == 0, f"t{i}" if i % 5 else None) for i in range(1, 41)] + [("b", 2, None, "last"), ("b", 3, False, "z"), ("b", None, True, "y"), ("b", 9, True, "x"), (None, 1, True, "n"), ("c", 1, True, None)]
    df = spark.createDataFrame(rows, "g string, k int, p boolean, t string").repartition(5)
    got = {r["g"]: r["context"] for r in evidence.ordered_context(df, "g", F.col("p"), "k", F.col("t"), " | ", size=3).collect()}
    want = " | ".join(f"t{i}" for i in sorted(range(1, 41), key=lambda i: (i % 7 != 0, i)) if i % 5)
    assert got == {"a": want, "b": "x | y | z | last", None: "n", "c": None}


def test_long_context_of_large_groups(spark):
    from strandline.plans.records import q_long_context

    df = spark.range(25_000).selectExpr("id as c_custkey", "cast(id % 2 as int) as c_nationkey", "cast(id % 9100 as double) as c_acctbal")
    got = {r["c_nationkey"]: r["context"] for r in q_long_context({"customer": df}.__getitem__).collect()}
    assert got == {n: " | ".join(map(str, sorted(range(n, 25_000, 2), key=lambda i: (i % 9100 <= 9000, i)))) for n in (0, 1)}


def test_hints_of_large_groups(spark):
    from strandline.plans.rollups_ranks import q_hints

    df = spark.range(25_000).selectExpr("id as c_custkey", "cast(id % 2 as int) as c_nationkey", "cast(id % 9100 as double) as c_acctbal", "if(id % 10 = 0, null, 'S') as c_mktsegment")
    got = {r["c_nationkey"]: r["context"] for r in q_hints({"customer": df}.__getitem__).collect()}
    ordered = {n: sorted(range(n, 25_000, 2), key=lambda i: (i % 9100 <= 9000, i)) for n in (0, 1)}
    assert got == {n: "; ".join(f"{i} S" for i in ids if i % 10) for n, ids in ordered.items()}


def test_evidence(spark):
    df = spark.createDataFrame([(0, "c1", "pay", "present", "text", "", True), (1, "c1", "pay", "present", "text", "", True), (2, "c1", "pay", "weird", "x", None, True), (3, "c1", "pay", "present", "other", "flagged", True)], "o int, c string, a string, s string, e string, n string, ok boolean")
    layer = evidence.evidence_layer(df, "c", "a", "s", "e", "n", "o", F.col("ok"))
    assert rows(layer, "seq", "status", "excerpt", "skipped", "verified") == [(0, "present", "text", 1, True), (1, "unclear", "", 0, False), (2, "present", "other", 0, False)]
    assert evidence.default_view(layer).count() == 2 and evidence.default_view(layer, show_unverified=True, search="OTHER").count() == 1


def test_scans(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿id,note\n1,"two\nlines, ""quoted"""\n2,\n', encoding="utf-8")
    assert rows(tables.read_csv(spark, str(path), ["id"])) == [("1", 'two\nlines, "quoted"'), ("2", None)]
    with pytest.raises(ValueError, match="lacks columns"):
        tables.read_csv(spark, str(path), ["nope"])
    assert tables.read_optional(spark, str(tmp_path / "none.csv"), "x string").count() == 0 and tables.read_or_report(spark, str(tmp_path / "none.csv"), "x string")[1]
    assert rows(tables.read_many(spark, [{"path": str(path), "wave": 1}, {"path": str(path), "wave": 2}]), "id", "wave") == [("1", 1), ("1", 2), ("2", 1), ("2", 2)]
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x.txt", "A \tB\n1\t 2 \n3\t\n")
    assert rows(tables.read_zipped(spark, str(z), ["A", "B"])) == [("1", "2"), ("3", None)]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as f:
        f.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>na</t><t>me</t></si><si><t>Bob</t></si></sst>")
        f.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="s"><v>2</v></c></row><row><c r="A3"><v>8</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(book.getvalue())
    assert rows(tables.read_sheet(spark, str(tmp_path / "b.xlsx"), ["id", "name"])) == [("7", "Bob"), ("8", None)]
    (tmp_path / "c.json").write_text('{"a": 1}')
    (tmp_path / "d.json").write_text('{"a": ')
    assert tables.read_json(spark, str(tmp_path / "c.json"), "a int").first()["a"] == 1 and tables.read_json(spark, str(tmp_path / "d.json"), "a int").count() == 0
    with pytest.raises(Exception):
        tables.read_json(spark, str(tmp_path / "d.json"), "a int", strict=True).collect()
    assert len(tables.file_hashes(spark, str(path)).first()["sha256"]) == 64
    both = tables.reuse_text(spark.createDataFrame([(1, "f1"), (2, "f2")], "k int, f string"), spark.createDataFrame([(1, "old")], "k int, t string"), "k", "t", "f")
    assert rows(both, "k", "t", "text_source") == [(1, "old", "cache"), (2, "f2", "fresh")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "k int, v string")
    assert sinks.write_checked(df, str(tmp_path / "csv"), ["v", "k"]) == 2
    p = str(tmp_path / "t")
    sinks.append(df, p)
    sinks.append(df.withColumn("w", F.lit(9)), p)
    assert rows(spark.read.parquet(p), "k", "w") == [(1, 9), (1, None), (2, 9), (2, None)]
    sinks.upsert_parquet(spark.createDataFrame([(2, "z"), (3, "y")], "k int, v string").withColumn("w", F.lit(0)), p, ["k"])
    assert rows(spark.read.parquet(p), "k", "w") == [(1, 9), (1, None), (2, 0), (3, 0)]
    good, bad = sinks.split_quarantine(df, checks.missing_fields(["v"]))
    assert rows(good, "k") == [(1,)] and rows(bad, "k", "missing_fields") == [(2, "v")]
    assert sinks.documents(df, "k", [F.col("v")], {"made_by": "test"}).orderBy("k").first()["json"] == '{"metadata":{"made_by":"test"},"v":"a\\nb"}'
    assert sinks.markdown(spark.createDataFrame([(1, "x|y")], "a int, b string")).endswith("| 1 | x\\|y |")


def test_streams(spark, tmp_path):
    for i, r in enumerate([[("a", 1, False), ("a", 2, True), ("b", 1, True)], [("a", 3, True), ("a", 4, False), ("b", 2, True)]]):
        spark.createDataFrame(r, "k string, o int, f boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, o int, f boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.failure_runs(stream(), "k", "f", "o").writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c1")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows(spark.table("runs"), "k", "o")[0] == ("a", 1) and spark.table("runs").count() == 6
    q = streams.upsert_stream(stream(), str(tmp_path / "out"), ["k"], str(tmp_path / "c2"), "o")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows(commits.read(spark, str(tmp_path / "out")), "k", "o") == [("a", 4), ("b", 2)] and commits.entry(spark, str(tmp_path / "out"))["version"] == 2


def test_intervals_never_divide_by_zero(spark):
    assert spark.range(1).select(values.percent(F.lit(0), F.lit(0))).first()[0] == 0.0
