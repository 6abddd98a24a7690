"""The pipeline's stages on a small table, against their rules."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_decisions_take_effect(spark):
    clean = lambda i: " ".join(f"w{i}x{j}" for j in range(80))
    secret = "9f" * 20
    rows = [(i, clean(i), "en", f"s{i % 2}", 1) for i in range(30)]
    rows += [(30, clean(3), "en", "s0", 1), (31, clean(4) + " more", "en", "s1", 1), (3, clean(3), "en", "s1", 1)]
    rows += [(40, "short", "en", "s0", 1), (41, "# | " * 100 + clean(41), "en", "s0", 1), (42, clean(42) + f' token = "{secret}"', "en", "s0", 1), (43, None, None, None, None), (None, clean(44), "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {d for d, _ in seen["quality_rules"]}
    assert {40, 41, 43}.isdisjoint(kept) and set(range(32)) | {42, None} <= kept
    unique = [d for d, _ in seen["near_duplicates"]]
    assert len(unique) == len(set(unique)) and {30, 31}.isdisjoint(unique) and set(range(30)) <= set(unique)
    assert not any(secret in t for _, t in seen["secret_scan"]) and len(seen["secret_scan"]) == len(unique)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {p["doc_id"] for p in pieces} == {d for d, _ in seen["source_mix"]}


def test_rows_that_share_an_id_are_told_apart(spark):
    clean = lambda i: " ".join(f"w{i}x{j}" for j in range(80))
    row = lambda i, t, source="s": (i, t, "en", source, 1)
    rows = [row(None, clean(1)), row(None, clean(2)), row(None, clean(3)), row(7, clean(4)), row(7, clean(5)), row(7, clean(6))]
    copies = [row(None, clean(4) + " more"), row(9, clean(5)), row(None, clean(2) + " more"), row(7, clean(6), "t"), row(7, clean(6)), row(None, clean(3))]
    blank = [row(None, None), row(None, " "), row(7, ""), row(7, None)]
    docs = spark.createDataFrame(rows + copies + blank, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    one_of = [row(None, clean(2)), row(None, clean(2) + " more")]  # by the hash of the text
    assert sum(r in one_of for r in got) == 1
    rest = [r for r in got if r not in one_of]
    assert sorted(rest, key=str) == sorted([r for r in rows if r not in one_of] + blank, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        rows = docs.collect()
        assert rows == []
        docs = spark.createDataFrame([], docs.schema)


def test_whole_run_equals_its_rules(spark, tmp_path):
    """run() on a table of its own: what is packed is what the rules leave, masked, at the mix's copies; two runs agree."""
    import random
    import re

    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    texts = [say(rng.randint(60, 200)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i] if i % 2 else texts[i] + " more", "en", "s1", 1) for i in range(12)]
    rows += [(200, say(20), "en", "s0", 1), (201, "a b c " * 80, "en", "s0", 1), (202, None, None, None, None), (203, say(90) + " token=abcdef123456 " + say(30), "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    once, again = ([tuple(r) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").select("doc_id", "doc_tokens", "start", "length", "ids").collect()] for _ in range(2))
    tokens = lambda got: sorted((d, t) for d, t, s, _, _ in got if s == 0)
    assert tokens(once) == tokens(again)
    alive = set(range(60)) | {203}
    seen = [d for d, _ in tokens(once)]
    assert set(seen) <= alive and {200, 201, 202}.isdisjoint(seen) and not set(range(100, 112)) & set(seen)
    from strandline.llm import packing
    import public_tokenizers

    bpe = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    final = {d: re.sub(r"token=[a-z0-9]+", "[SECRET]", t) for d, t, *_ in rows if d in alive}
    assert all(t == len(bpe.ids(final[d])) + 1 for d, t in tokens(once))
    size = {s: sum(len(final[d].split()) for d in alive if rows[[r[0] for r in rows].index(d)][3] == s) for s in ("s0", "s1", "s2")}
    taken = {s: sum(len(final[d].split()) for d in seen if rows[[r[0] for r in rows].index(d)][3] == s) for s in size}
    total = sum(size.values())
    assert all(abs(taken[s] - total * w / 6) <= 100 for s, w in (("s0", 1), ("s1", 2), ("s2", 3)))
