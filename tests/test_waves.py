"""What waves refuse: hints that do not fit, selections that differ, rows that lack; and reports of few rows."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import waves
from strandline.sources import sinks


def test_hints_are_exact(spark):
    rows = spark.createDataFrame([("1", "a"), (" 2 ", "b"), ("", "c"), (None, "d")], "id string, v string")
    hints = spark.createDataFrame([("1", "x"), ("2 ", None), ("3", "z")], "id string, h string")
    got = {r["v"]: r["h"] for r in waves.attach_hints(rows, hints, "id", ["h"]).collect()}
    assert got == {"a": "x", "b": "", "c": None, "d": None}
    for bad in ([("1", "x"), (" 1", "y")], [("", "x")], [(None, "x")]):
        with pytest.raises(ValueError, match="blank or repeated"):
            waves.attach_hints(rows, spark.createDataFrame(bad, "id string, h string"), "id", ["h"])
    with pytest.raises(ValueError, match="without a hint"):
        waves.attach_hints(rows, hints.filter("id <> '1'"), "id", ["h"])


def test_a_wave_is_held_against_the_full_file(spark):
    full = spark.createDataFrame([(i, i * 10, i % 3) for i in range(20)], "k int, s int, g int")
    ok = waves.assemble(full.filter("k < 9"), full, "k", ["s", "g"], F.col("g") != 0, [F.desc("s")], 4)
    assert [(r["k"], r["wave_rank"]) for r in ok.orderBy("wave_rank").collect()] == [(8, 1), (7, 2), (5, 3), (4, 4)]
    assert {(r["rule"], r["n"]) for r in waves.selection_faults(ok, 5, "k", "g", {"low": F.col("s") < 50}).collect()} == {("expected_5_rows", 1), ("repeated_g", 2), ("low", 1)}
    for bad, error in ((full.withColumn("s", F.lit(3)), "differ"), (full.filter("k > 2"), "differ")):
        with pytest.raises(ValueError, match=error):
            waves.assemble(full.filter("k < 9"), bad, "k", ["s", "g"], F.lit(True), [F.desc("s")], 4)
    with pytest.raises(ValueError, match="fewer than"):
        waves.assemble(full, full, "k", ["s"], F.col("g") == 5, [F.desc("s")], 4)


def test_html_is_escaped(spark):
    df = spark.createDataFrame([(1, "<b>&"), (2, None)], "a int, b string").orderBy("a")
    got = sinks.html(df, caption="x < y")
    assert "<td>&lt;b&gt;&amp;</td>" in got and "<caption>x &lt; y</caption>" in got and "<tr><td>2</td><td></td></tr>" in got
    with pytest.raises(ValueError, match="over 1 rows"):
        sinks.html(df, most=1)
