"""The commit log under repeated batches, concurrent writers, growing columns and old versions; pacing as a stream."""

import threading

import pytest
from pyspark.sql import functions as F

from strandline.operators import ledgers
from strandline.sources import commits
from strandline.streaming import ledgers as streams


def table(spark, root, version=None):
    return {r["k"]: tuple(r)[1:] for r in commits.read(spark, root, version).select("k", "v").collect()}


def test_versions_batches_and_columns(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        commits.read(spark, root)
    first = spark.createDataFrame([(i, f"a{i}", i) for i in range(40)] + [(3, "late", 99)], "k int, v string, seq int")
    assert commits.upsert(first, root, ["k"], "seq", ("s", 0), buckets=8) == 1
    assert table(spark, root)[3] == ("late",) and len(table(spark, root)) == 40
    more = spark.createDataFrame([(3, "b", 100), (77, "b", 1)], "k int, v string, seq int").withColumn("extra", F.lit(1.5))
    assert commits.upsert(more, root, ["k"], "seq", ("s", 1)) == 2
    assert commits.upsert(more, root, ["k"], "seq", ("s", 1)) == 2 and commits.upsert(first, root, ["k"], "seq", ("s", 0)) == 2  # applied before
    assert commits.upsert(more.limit(0), root, ["k"], "seq", ("other", 0)) == 3
    now = commits.read(spark, root)
    assert now.columns == ["k", "v", "seq", "extra"] and now.count() == 41 and table(spark, root)[3] == ("b",)
    assert table(spark, root, 1)[3] == ("late",)
    late = spark.createDataFrame([(3, "old news", 50)], "k int, v string, seq int")
    assert commits.upsert(late, root, ["k"], "seq") == 4 and table(spark, root)[3] == ("b",)
    e1, e2 = commits.entry(spark, root, 1), commits.entry(spark, root, 2)
    assert 0 < len(e2["touched"]) <= 2 and sum(e1["data"][b] != e2["data"][b] for b in e1["data"]) <= 2  # other buckets stay
    commits.vacuum(spark, root, keep=1)
    assert now.count() == 41 and len(table(spark, root)) == 41
    with pytest.raises(ValueError):
        commits.upsert(more, root, ["v"])


@pytest.mark.parametrize("buckets", [1, 64])
def test_writers_at_once_lose_nothing(spark, tmp_path, buckets):
    root, errors = str(tmp_path / "t"), []
    commits.upsert(spark.createDataFrame([(0, "start")], "k int, v string"), root, ["k"], buckets=buckets)

    def write(w):
        try:
            for i in range(3):
                rows = [(1000 * w + i, f"w{w}"), (0, f"w{w}.{i}")] if i else [(1000 * w, f"w{w}")]
                commits.upsert(spark.createDataFrame(rows, "k int, v string"), root, ["k"], batch=(f"w{w}", i))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in (1, 2, 3, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    got = table(spark, root)
    assert set(got) == {0} | {1000 * w + i for w in (1, 2, 3, 4) for i in range(3)} and got[0][0].endswith(".2")
    last = commits.entry(spark, root)
    assert last["version"] == 13 and last["batches"] == {f"w{w}": 2 for w in (1, 2, 3, 4)}


def test_pacing_as_a_stream_equals_pacing_of_the_table(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, None if i % 41 == 0 else i % 13 == 0 or i % 29 < 3) for i in range(400)]
    schema = "run string, o int, f boolean"
    for n, k in enumerate(range(0, 400, 100)):
        spark.createDataFrame(rows[k : k + 100], schema).repartition(3).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []
    try:
        for n in range(4):  # a run stops after each batch and is resumed from its checkpoint
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / ("in/[0-%d]" % n)))
            out = streams.paced(stream, "run", "o", "f", stable=4)
            q = out.writeStream.foreachBatch(lambda b, _: got.extend((r["o"], r["pause"], r["event"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    whole = ledgers.pacing(spark.createDataFrame(rows, schema), ["run"], "o", F.col("f"), stable=4)
    assert sorted(got) == sorted((r["o"], r["pause"], r["event"]) for r in whole.collect())
