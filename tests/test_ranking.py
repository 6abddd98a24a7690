"""Global positions, running totals and mid ranks over many distinct keys, with columns that are not part of the order."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import ranking


@pytest.mark.parametrize("parts", ["4", "211"])
def test_positions_are_gapless_with_extra_columns(spark, parts):
    rng = random.Random(1)
    data = [(i, rng.randrange(10**9) / 100, f"n{i % 7}", rng.random()) for i in range(15_500)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(data, "k long, v double, name string, extra double").repartition(5)
        got = {r["k"]: r["position"] for r in ranking.position(df, [F.col("v").desc(), F.col("k")]).filter("length(name) > 0").collect()}
        want = {r[0]: i + 1 for i, r in enumerate(sorted(data, key=lambda r: (-r[1], r[0])))}
        assert got == want
        upto = {r["k"]: r["upto"] for r in ranking.running_total(df.select("k", "name", "v"), [F.col("v"), F.col("k")], F.col("k"), "upto").collect()}
        total = 0
        for r in sorted(data, key=lambda r: (r[1], r[0])):
            total += r[0]
            assert upto[r[0]] == total
        mids = {r["k"]: r["midrank"] for r in ranking.mid_rank(df, "v").collect()}
        values = sorted(r[1] for r in data)
        low = {v: i for i, v in reversed(list(enumerate(values)))}
        high = {v: i for i, v in enumerate(values)}
        assert all(abs(mids[r[0]] - (low[r[1]] + high[r[1]]) / 2 / (len(data) - 1)) < 1e-12 for r in data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_round_robin_takes_strata_in_turn(spark):
    rows = [(t, s, i) for t, n in ((1, 40), (2, 3), (None, 5)) for s in "abc" for i in range(n if s == "a" else 2)]
    df = spark.createDataFrame(rows, "tier int, stratum string, i int")
    got = {}
    for r in ranking.round_robin(df, "tier", "stratum", [F.col("stratum"), F.col("i")]).collect():
        got.setdefault(r["tier"], []).append((r["position"], r["stratum"], r["i"]))
    for tier, placed in got.items():
        want = sorted((r for r in rows if r[0] == tier), key=lambda r: (r[2], r[1]))
        assert [(s, i) for _, s, i in sorted(placed)] == [(s, i) for _, s, i in want] and [p for p, _, _ in sorted(placed)] == list(range(1, len(placed) + 1))
