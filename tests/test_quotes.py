"""Quotes by automaton, by parted automata and by word windows, against a plain search."""

import random

import pytest

from strandline.operators import quotes


@pytest.mark.parametrize("most", [quotes.MOST, 60])
def test_quotes_are_found_by_either_way(spark, most):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gämma", "delta", "epsilon", "zeta's", "𝒳ray", "theta"]
    say = lambda n: rng.choice((" ", "  ", "\n")).join(rng.choice(words) for _ in range(n))
    texts = [(i, say(rng.randint(0, 60)), "x") for i in range(60)] + [(60, None, ""), (61, "", ""), (None, say(40), ""), (7, say(30), ""), (62, "extraordinarilylong " + say(4000), "")]
    cut = lambda t: t[(k := rng.randrange(max(1, len(t) - 60))) : k + rng.randint(10, 60)]
    asked = [(i, cut(t)) for i, (_, t, _) in enumerate(texts) if t] + [(100, None), (101, ""), (102, "extraordinarily"), (103, "EXTRAORDINARILY"), (104, "absent from every text"), (105, "too short")]
    norm = lambda t: " ".join((t or "").split()).lower()
    want = sorted(((k, i) for k, t, _ in texts for i, q in asked if t is not None and q is not None and len(norm(q)) >= 15 and norm(q) in norm(t)), key=str)
    d = spark.createDataFrame(texts, "k int, text string, _q string").repartition(3)
    got = quotes.quotes_in(d, "k", "text", spark.createDataFrame(asked, "i int, quote string"), "i", "quote", most=most)
    assert sorted(((r["k"], r["i"]) for r in got.collect()), key=str) == want and len(want) > 40
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_to_quote(spark):
    none = spark.createDataFrame([], "i int, quote string")
    some = spark.createDataFrame([(1, "a text of some words")], "i int, quote string")
    assert quotes.quotes_in(some, "i", "quote", none, "i", "quote").collect() == [] and quotes.quotes_in(none, "i", "quote", some, "i", "quote").collect() == []
