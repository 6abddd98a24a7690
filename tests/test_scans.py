"""Prefix scans, quantiles and chunked lists against folds in Python, with one key that holds most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandline.operators import ledgers, ranking, rollups, scans


@pytest.fixture(params=["3", "40"])
def ranges(spark, request):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", was)


def runs(seed, n=3000):
    """(key, order, flag): one key has over half of the rows, one has a single row, one is null; long runs of either kind."""
    rng = random.Random(seed)
    keys = ["hot"] * n + [f"k{i % 40}" for i in range(n // 2)] + [None] * 30 + ["one"]
    out, flag = [], False
    for i, k in enumerate(keys):
        flag = flag if rng.random() < 0.97 else not flag
        out.append((k, i, None if rng.random() < 0.01 else flag))
    return out + [("all", n * 2 + i, True) for i in range(500)]


def by_key(data):
    out = {}
    for k, o, f in sorted(data, key=lambda r: r[1]):
        out.setdefault(k, []).append((o, bool(f)))
    return out


def test_failure_runs(spark, ranges):
    data = runs(ranges)
    df = spark.createDataFrame(data, "k string, o int, f boolean").repartition(7)
    got = {r["o"]: (r["failures_in_a_row"], r["stopped"]) for r in ranking.stop_gate(df, ["k"], "o", F.col("f"), most=9).collect()}
    want = {}
    for rows in by_key(data).values():
        run, stopped = 0, False
        for o, f in rows:
            run = run + 1 if f else 0
            want[o] = (run, stopped)
            stopped = stopped or run >= 9
    assert got == want


def fold(rows, low, base, high, backoff, stable, strikes):
    pause, calm, strike, out = base, 0, 0, []
    for o, f in rows:
        was = pause
        if f:
            strike, calm = strike + 1, 0
            pause = min(high, max(pause, high if strike >= strikes else backoff))
            event = "backoff" if pause > was else "backoff_held"
        else:
            strike, calm = 0, calm + 1
            event = "stable_hold"
            if calm >= stable:
                calm, pause = 0, max(low, pause - 1)
                event = "stable_step_down" if pause < was else "stable_at_min"
        out.append((o, pause, event))
    return out


@pytest.mark.parametrize("how", [(3.0, 5.0, 15.0, 10.0, 25, 2), (0.25, 0.5, 99.5, 40.125, 3, 4)])
def test_pacing_equals_the_fold(spark, ranges, how):
    data = runs(ranges + 1)
    df = spark.createDataFrame(data, "k string, o int, f boolean").repartition(5)
    got = sorted((r["o"], r["pause"], r["event"]) for r in ledgers.pacing(df, ["k"], "o", F.col("f"), *how).collect())
    assert got == sorted(x for rows in by_key(data).values() for x in fold(rows, *how))


def test_a_large_group_is_spread_over_ranges(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    dealt = scans.deal(df, ["k"], [F.col("o")])
    assert max(r["count"] for r in dealt.groupBy("_p").count().collect()) < 60_000
    longest = scans.run_lengths(dealt, ["k"], {"run": F.col("o") >= 1000}).agg(F.max("run")).first()[0]
    assert longest == 199_000


def test_quantiles(spark, ranges):
    rng = random.Random(ranges)
    data = [("hot", float(rng.choice((1, 1, 1, 2, 3, 9)))) for _ in range(2000)] + [(f"k{i % 60}", rng.random()) for i in range(900)]
    data += [(None, 4.0), (None, 5.0), ("none", None), ("one", 7.5), ("hot", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    got = {r["k"]: (r["q1"], r["median"], r["end"]) for r in scans.quantiles(df, ["k"], "v", {"q1": 0.25, "median": 0.5, "end": 1.0}).collect()}
    groups = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        q1 = statistics.quantiles(values, n=4, method="inclusive")[0] if len(values) > 1 else values[0]
        assert got[k] == (pytest.approx(q1), pytest.approx(statistics.median(values)), max(values)), k
    whole = rollups.summary(df, "v", "all").collect()
    assert [(r["n"], r["median"]) for r in whole] == [(2903, pytest.approx(statistics.median([v for _, v in data if v is not None])))]
    assert rollups.summary(df, "v", "all", "k").filter("k = 'none'").first()["median"] is None


def test_chunked_lists(spark, ranges):
    data = [("hot", i, f"i{i}") for i in range(1234)] + [(None, 5, "x"), ("b", 2, "y"), ("b", 1, None)]
    df = spark.createDataFrame(data, "k string, o int, v string").repartition(4)
    got = {}
    for r in sorted(scans.chunked_lists(df, ["k"], [F.col("o")], F.col("v"), size=100).collect(), key=lambda r: (str(r["k"]), r["part"])):
        assert len(r["items"]) <= 100
        got.setdefault(r["k"], []).extend(r["items"])
    assert got == {"hot": [f"i{i}" for i in range(1234)], None: ["x"], "b": [None, "y"]}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, o int, f boolean")
    assert ranking.stop_gate(df, ["k"], "o", F.col("f")).collect() == [] and ledgers.pacing(df, ["k"], "o", F.col("f")).collect() == []
    assert scans.quantiles(df, ["k"], "o", {"median": 0.5}).collect() == [] and scans.chunked_lists(df, ["k"], [F.col("o")], F.col("f")).collect() == []
    assert ranking.rank_variants(df, "k", {"a": F.col("o"), "b": -F.col("o")}, ["k"], 3)[1].collect() == []


def test_ranks_under_several_scores(spark, ranges):
    rng = random.Random(5)
    data = [(i, rng.randrange(50), None if i % 17 == 0 else rng.random()) for i in range(900)]
    df = spark.createDataFrame(data, "k int, a int, b double").repartition(4)
    ranked, union = ranking.rank_variants(df, "k", {"a": F.col("a"), "b": F.col("b")}, ["k"], 10)
    ra = {r[0]: i + 1 for i, r in enumerate(sorted(data, key=lambda r: (-r[1], r[0])))}
    rb = {r[0]: i + 1 for i, r in enumerate(sorted(data, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])))}
    assert {r["k"]: (r["rank_a"], r["rank_b"]) for r in ranked.collect()} == {k: (ra[k], rb[k]) for k in ra}
    assert {r["k"]: r["displacement"] for r in union.collect()} == {k: abs(ra[k] - rb[k]) for k in ra if min(ra[k], rb[k]) <= 10}
