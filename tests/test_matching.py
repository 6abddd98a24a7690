"""Interval matching by cells against all pairs in Python: unreadable, partial, reversed and long spans, windows, and an entity that holds most rows."""

import datetime
import random

import pytest

from strandline.operators import matching

SCHEMA = "city string, unit string, s string, e string, w string, id string"


def day(text):
    try:
        y, m, d = text.split("-")
        return datetime.date(int(y), int(m), int(d))
    except (AttributeError, ValueError):
        return None


def year(text):
    try:
        return int((text or "")[:4])
    except ValueError:
        return None


def tier(a, b, windows):
    (s1, e1, w1), (s2, e2, w2) = a, b
    k1, k2 = (f"{(s or '')[:4]}-{(e or '')[:4]}" for s, e in ((s1, e1), (s2, e2)))
    if k1 == k2 or windows and (w1 or k1) == (w2 or k2):
        return 3
    for f, unit in ((day, 1), (year, 365)):
        at = [f(x) for x in (s1, e1, s2, e2)]
        if None not in at:
            if max(at[0], at[2]) <= min(at[1], at[3]):
                return 2
            gap = at[2] - at[1] if at[2] > at[1] else at[0] - at[3]
            return int((gap.days if unit == 1 else gap * 365) <= 730)
    return 0


def spans(seed, n, side):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = datetime.date(1990, 1, 1) + datetime.timedelta(days=rng.randrange(14000))
        b = a + datetime.timedelta(days=int(rng.expovariate(1 / 500)) if rng.random() < 0.95 else rng.randrange(20000))
        s, e = a.isoformat(), b.isoformat()
        kind = rng.random()
        if kind < 0.05:
            s, e = e, s
        elif kind < 0.1:
            e = e[:5] + "13-40"
        elif kind < 0.13:
            s = rng.choice((None, "", "unknown", s[:4]))
        elif kind < 0.15:
            s, e = s[:4], e[:4]
        out.append((rng.choice(("hot", "hot", "hot", "a", "b", None)), rng.choice(("x", "y", "z")), s, e, rng.choice((None, "", None, "w1", "2001-2003")), f"{side}{i}"))
    return out


@pytest.mark.parametrize("window", [None, "w"])
@pytest.mark.parametrize("block", [20, 4096])
def test_cells_find_every_pair_once(spark, window, block):
    ls, rs = spans(1, 220, "L"), spans(2, 260, "R")
    left, right = spark.createDataFrame(ls, SCHEMA).repartition(3), spark.createDataFrame(rs, SCHEMA).repartition(4)
    got = sorted((r["id"], r["match_id"], r["tier"]) for r in matching.match_pairs(left, right, "city", "s", "e", "id", window, block=block).collect())
    want = sorted((a[5], b[5], t) for a in ls for b in rs if a[0] is not None and a[0] == b[0] for t in [tier(a[2:5], b[2:5], window)] if t)
    assert got == want
    if block == 4096:
        best = {}
        for i, m, t in want:
            best.setdefault(i, {}).setdefault(t, []).append(m)
        kinds, cycle = {b[5]: b[1] for b in rs}, {b[5]: f"{(b[2] or '')[:4]}-{(b[3] or '')[:4]}" for b in rs}
        names = ["unmatched", "adjacent", "overlap", "exact"]
        want_rows = {}
        for a in ls:
            t = max(best.get(a[5], {0: []}))
            ms = sorted(best.get(a[5], {0: []})[t])
            want_rows[a[5]] = (names[t], len(ms), "; ".join(sorted({kinds[m] for m in ms})), "; ".join(sorted({cycle[m] for m in ms})), ms)
        full = matching.match_tiers(left, right, "city", "s", "e", "id", "unit", window)
        assert {r["id"]: tuple(r)[1:] for r in full.collect()} == want_rows
        slim = matching.match_tiers(left, right, "city", "s", "e", "id", "unit", window, ids=False)
        assert {r["id"]: tuple(r)[1:] for r in slim.collect()} == {k: v[:-1] for k, v in want_rows.items()}


def test_blocks_bound_a_hot_cell(spark):
    """All spans of one entity in one year: block pairs share the work."""
    rows = [("hot", "x", "2001-01-01", "2001-06-01", None, f"R{i}") for i in range(900)]
    left = spark.createDataFrame([(*r[:5], "L" + r[5]) for r in rows], SCHEMA)
    pairs = matching.match_pairs(left, spark.createDataFrame(rows, SCHEMA), "city", "s", "e", "id", block=100)
    assert pairs.count() == 900 * 900 and pairs.select("id", "match_id").distinct().count() == 900 * 900


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(spans(3, 5, "L"), SCHEMA)
    assert matching.match_pairs(some, none, "city", "s", "e", "id").collect() == [] and matching.match_tiers(none, some, "city", "s", "e", "id", "unit").collect() == []
    assert {r["tier"] for r in matching.match_tiers(some, none, "city", "s", "e", "id", "unit").collect()} == {"unmatched"}
