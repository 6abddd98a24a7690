"""URL filter, whitening and filter audit against plain versions, with nulls, ties, repeats, long and empty inputs, and clashing columns."""

import math
import re
from itertools import permutations

import numpy as np
import pytest

from strandline.llm import filter_audit, url_filter, whitening


@pytest.fixture(scope="module")
def weights():
    return url_filter.fit_table(url_filter.labelled_table())


def plain_rule(host, path):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def plain_probability(host, path, weights):
    """One n-gram at a time, in Python's integers."""
    total = n = 0
    for text, seed in ((host, 1), (path, 2)):
        fenced = [2, *map(ord, text), 3]
        for size in url_filter.SIZES:
            for i in range(len(fenced) - size + 1):
                h = seed
                for c in fenced[i : i + size]:
                    h = (h * 0x9E3779B97F4A7C15 + c + 1) % 2**64
                total, n = total + weights[(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) % 2**64) >> 48], n + 1
    return 1 / (1 + math.exp(-total / math.sqrt(max(n, 1)) - weights[-1]))


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM", "http://com/", "http://Example.COM/en/1?x=/es/", "http://www.example.com/en/", "http://a.www.example.com/en/x", "http://xexample.com/en/",
    "http://example.com/en", "https://casino-bets.example.net/es/1", "https://casino-bets.example.net/de/1", "https://casino-bets.example.net/de/1", "http://library.org#://x/", "http://net?q://com/", "http://é.ñ/ü/" + "ß" * 50,
    "http://free-pills.org/" + "a" * 300_000, "a://b://c/d", "http://net/fr/\nx", "http://users.net/fr/",
]


def test_urls_are_judged_like_the_plain_version(spark, weights, monkeypatch):
    rows = [(i, u, "x", "y", 1) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, extra string, html string, _i int").repartition(3)
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, weights).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        tail = (u or "").partition("://")[2]
        host, path = re.match(r"([^/?#]*)([^?#]*)", tail).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rule, verdict = plain_rule(host, path)
        p = plain_probability(host, path, weights)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["probability"] == pytest.approx(p, rel=1e-9)
        assert r["verdict"] == (verdict or ("block" if p >= 0.5 else "allow"))
    assert (got[12]["rule"], got[13]["rule"], got[13]["verdict"]) == ("net/es/", None, "block")
    monkeypatch.setattr(url_filter, "WINDOW", 64)  # windows change nothing
    assert url_filter.probabilities(["free-pills.org"], ["/" + "ab" * 500], weights)[0] == pytest.approx(plain_probability("free-pills.org", "/" + "ab" * 500, weights))


def test_the_url_model_holds_on_rows_it_has_not_seen(spark, weights):
    held = url_filter.labelled_table(2000, seed=99)
    parts = [re.match(r"([^/?#]*)([^?#]*)", u.partition("://")[2]).groups() for u, _ in held]
    p = url_filter.probabilities([h for h, _ in parts], [x for _, x in parts], weights)
    assert ((p >= 0.5) == np.array([y for _, y in held])).mean() > 0.93
    table = spark.createDataFrame([*url_filter.labelled_table(400), (None, 1), ("http://x", None)], "url string, label int")
    again = url_filter.fit_table(table.repartition(5), most=300)
    assert (again == url_filter.fit_table(table.repartition(2), most=300)).all()


def test_no_pages(spark, weights):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), weights).collect() == []


def check_white(rows, vectors, d):
    keep = [(k, v) for k, v in vectors if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in keep], dtype=object)
    n, s = len(keep), x.sum(0)
    c = (x * n - s).astype(float) / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(32, d)
    assert len(rows) == n * k
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], []).append(r)
    deviations = sorted((key, int(((row * n - s) ** 2).sum())) for (key, _), row in zip(keep, x))
    assert sorted((r["vec_id"], r["deviation"]) for r in rows if r["component"] == 1) == deviations
    assert {r["n"] for r in rows} == {n}
    for j in range(k):
        want = sorted(np.abs(c @ u[:, j] / np.sqrt(e[j])))
        assert np.allclose(sorted(abs(r["whitened"]) for r in rows if r["component"] == j + 1), want, atol=1e-6)
        assert all(r["explained"] == pytest.approx(e[j] / e.sum(), rel=1e-6) for r in rows if r["component"] == j + 1)
    assert max(r["identity_error"] for r in rows) < 1e-8


@pytest.mark.parametrize(("d", "tile"), [(5, 2), (40, 16), (40, None)])
def test_whitening_equals_the_plain_version(spark, d, tile):
    rng = np.random.default_rng(d)
    vectors = [(i, [float(np.float32(v)) for v in rng.normal(0, 1 + np.arange(d) / 7)]) for i in range(300)]
    vectors += [vectors[0], vectors[1], (900, None), (901, []), (902, [None] * d), (903, [math.nan] * d), (904, [math.inf] + [0.0] * (d - 1)), (905, [1.0] * (d + 1)), (906, [0.0] * d), (907, [1e30] * d)]
    table = spark.createDataFrame([(k, v, 1.0, 2) for k, v in vectors], "vec_id long, embedding array<float>, whitened double, n int").repartition(4)
    rows = whitening.whiten(table, tile=tile).collect()
    check_white(rows, [x for x in vectors if x[0] != 907], d)
    again = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(table.repartition(2), tile=tile).collect()}
    assert all(again[r["vec_id"], r["component"]] == pytest.approx(r["whitened"], abs=1e-9) for r in rows)


def test_whitening_of_hardly_any_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(None, [0.5, 1.0])], schema)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(None, 1, 1, 0, None, None), (None, 2, 1, 0, None, None)]
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], None if r["whitened"] is None else round(r["whitened"], 9)) for r in flat) == [(1, 1, -1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)]
    large = whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [1e12]), (3, [1e15])], schema)).collect()
    x = [1_000_000, int(64e12) + 1_000_000, int(64e15) + 1_000_000]
    want = [sum((3 * v - sum(x)) ** 2 for v in [a]) for a in x]
    assert [r["deviation"] for r in sorted(large)] == [v if v < 2**63 else None for v in want]


def plain_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    marked, firsts = [], {}
    for i, _, text in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    for i, source, text in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        caps = sum("A" <= c <= "Z" for c in t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * caps > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > firsts[t]}
        marked.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in marked}:
        mine = [m for m in marked if m[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                f, before = order[step - 1], set(order[: step - 1])
                gone = [m for m in mine if f in m[1] and not m[1] & before]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    sum(not m[1] & (before | {f}) for m in mine), len(gone), sum(f in m[1] and bool(m[1] & before) for m in mine), sum(m[1] == {f} for m in mine),
                    sum(m[2] for m in gone), sum(m[3] for m in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_equals_the_plain_replay(spark, monkeypatch):
    say = lambda n, k=10**9: " ".join(f"w{i % k}" for i in range(n))
    texts = [None, "", "", " \n\x0b", say(49), say(50), say(100, 64), say(100, 65), say(60) + " #", "A" * 6 + "é" * 94 + say(50), "Abc", say(60), say(60), "É" + say(70), say(20_000), "a\xa0b " * 60]
    docs = [(i, f"s{i % 2}" if i % 5 else None, t) for i, t in enumerate(texts)]
    docs += [(3, "", "Abc"), (3, "", "Abc"), (None, "s0", "Abc"), (None, None, None), (99, "s1", say(60)), (98, "s9", None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 14)] + [(4, None, None), (5, 0, 1), (5, 1, None), (None, 1, 1), (777, 1, 1)]
    table = spark.createDataFrame([(*d, "x", 1, True, "z") for d in docs], "doc_id long, source string, text string, part string, n int, good boolean, kept string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(table, known).collect()}
    assert got == plain_audit(docs, labels)
    text = (say(500, 300) + "\n\n" + "x" * 90 + "  " + say(300)).encode()
    whole = filter_audit.own_flags(text)
    monkeypatch.setattr(filter_audit, "WINDOW", 7)
    assert filter_audit.own_flags(text) == whole and sum(len(w) for w in filter_audit._words(text)) == len(text.split())


def test_audit_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_personal_data_in_long_texts_takes_linear_time(spark):
    from strandline.llm import pii

    import time

    crf = pii.Crf().train(pii.labelled_table())
    line = "some words here jane(at)acme.net and more"
    text = "\n".join([line] * 100_000 + ["a@b.example"] * 1000)
    began = time.perf_counter()
    [(base, added)] = pii.find_spans([text], crf)
    assert time.perf_counter() - began < 60
    assert len(base) == 1000 and [text[s:e] for s, _, e in added] == ["jane(at)acme.net"] * 100_000
    assert pii.features("x-" * 5000 + "@")[6] == "last=@" and pii.features("x-" * 5000 + "@")[4] == "at=1"


def test_what_the_model_adds_can_be_such_data(spark):
    from strandline.llm import pii

    kinds = {k: i for i, k in enumerate(pii.LABELS)}
    for found, kind, ok in [
        ("jane(at)acme.net", "EMAIL", True), ("jane at acme dot org", "EMAIL", True), ("and at at", "EMAIL", False), ("at at dot com", "EMAIL", False), ("jane at acme", "EMAIL", False),
        ("1[.]2[.]3[.]4", "IP", True), ("1.2.3.400", "IP", False), ("4111.1111.1111.1111", "CARD", True), ("4111111111111112", "CARD", False), ("555-010-2345", "PHONE", True), ("55", "PHONE", False),
    ]:
        assert pii.well_formed(kinds[kind], found) is ok, found
    spans = [(0, 0, 50), (3, 1, 9), (60, 2, 70)]
    t = pii.Taken(spans)
    for s in range(80):
        for e in range(s + 1, 81):
            assert t.meets(s, e) == any(a < e and s < b for a, _, b in spans)
    held = pii.labelled_table(600, seed=77)
    crf = pii.Crf().train(pii.labelled_table())
    gold = [x for _, labels in held for x in labels]
    got = [pii.LABELS[k] for labels in crf.decode([w for w, _ in held]) for k in labels]
    right = sum(x == y != "O" for x, y in zip(gold, got))
    assert right / sum(y != "O" for y in got) > 0.9 and right / sum(x != "O" for x in gold) > 0.9


def test_contexts_of_many_tasks_are_added_in_levels(spark, monkeypatch):
    import random

    from strandline.llm import brown_lm

    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(80))) for i in range(400)], "doc_id long, text string")
    got = []
    for fan in (32, 2):
        monkeypatch.setattr(brown_lm, "_FAN", fan)
        told = {}
        rows = brown_lm.score_documents(docs.repartition(9, "doc_id"), told=told).collect()
        got.append((sorted((r["doc_id"], r["score"]) for r in rows), told["m"].tolist(), told["cls"].tolist()))
    assert got[0] == got[1]


def test_token_counts_of_long_words_and_windows(spark, monkeypatch):
    import random
    import tracemalloc

    from strandline.llm import token_counts

    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    counter = token_counts.ViterbiCounter(token_counts.unigram_vocab(path))
    rng = random.Random(1)
    texts = ["", " ", "▁", "▁ a", " ▁a", "a ", "a  b", "é" * 100, "𝒳 y"] + ["".join(rng.choice("ab é▁\nthe of") for _ in range(rng.randint(0, 300))) for _ in range(100)]
    want = [counter.text(t)[:2] for t in texts]
    for window in (1, 7):
        monkeypatch.setattr(token_counts, "WINDOW", window)
        assert [counter.text(t)[:2] for t in texts] == want
    monkeypatch.undo()
    long = "\n".join(f"theone{i}" for i in range(100_000))
    tracemalloc.start()
    n = counter.text(long)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100_000 and peak < 8 * len(long)  # copies of the text, no lists over its characters
