"""The registered queries run, have SQL or a reason not to, and give the flagship's known tiers."""

import __spark_entry__
import pytest

DATA = "/root/testdata/sf0.001"
#: Queries that SQL does not state.
NO_SQL: set[str] = set()


def test_every_query_has_sql():
    from strandline.plans import QUERIES, SQL

    assert set(QUERIES) - set(SQL) == NO_SQL and set(SQL) <= set(QUERIES)


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["o_orderkey", "tier", "n_matches", "match_classes", "match_cycles"] and got.count() > 0


@pytest.mark.parametrize("name", ["q_match_tiers", "q_required_violations", "q_tier_cut", "q_facets", "q_stop_gate", "q_evidence_layer", "q_unit_counts", "q_upsert"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    from strandline.plans import QUERIES, SQL

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({SQL[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(map(tuple, want), key=str)


def test_short_quotes_are_found(spark):
    from strandline.plans import texts

    quotes = ["extraordinarily", "collective agreement", "arbitration of the award", "one two three four fi", "two three four five six seven", "absent altogether"]
    docs = [(i, f"zero x{q}x after that and more words" if i != 4 else f"one {q} eight") for i, q in enumerate(quotes[:5])] + [(9, "nothing of it is in here at all")]
    frames = {"benchmark": spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string"), "documents": spark.createDataFrame(docs, "doc_id long, text string")}
    got = sorted((r["doc_id"], r["item_id"]) for r in texts.q_verbatim(frames.__getitem__).collect())
    want = sorted((i, j) for i, t in docs for j, q in enumerate(quotes) if q in t)
    assert got == want and {(i, i) for i in range(5)} <= set(got)
