"""Tables kept by a commit log: versions, batches that count once, writers that do not undo each other.

A table's rows lie in buckets by hash of their keys. A commit writes the buckets that it changes
beside the old ones and then adds one file to the log, ``root/_log/<version>``, which only one
writer can create; it names the folder of every bucket. Readers take the newest entry, so they see
a whole version and never none. A writer who comes second looks at what was committed meanwhile: if
that touched other buckets, it adds itself on top; otherwise it merges again.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.matching import newer_wins
from ..operators.ranking import first_per_key
from .sinks import _fs
from .stages import release, staged


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole, or say that it exists: by a link on a local disk, else by a rename that does not overwrite."""
    jvm, (tmp, fs) = spark.sparkContext._jvm, _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    target = _fs(spark, path)[0]
    try:
        if fs.getUri().getScheme() == "file":
            os.link(tmp.toUri().getPath(), target.toUri().getPath())
        else:
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            how = spark.sparkContext._gateway.new_array(rename, 1)
            how[0] = rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, target, how)
        return True
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(tmp, False)


def _versions(spark: SparkSession, root: str) -> list[int]:
    log, fs = _fs(spark, f"{root}/_log")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n) for n in names if n.isdigit())


def entry(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The log's entry of a version, by default the newest."""
    known = _versions(spark, root)
    version = version if version is not None else known[-1] if known else None
    if version is None:
        return None
    p, fs = _fs(spark, f"{root}/_log/{version:020d}")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _rows(spark: SparkSession, root: str, found: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(found["schema"])
    paths = [f"{root}/{p}" for b, p in found["data"].items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of the table, by default the newest."""
    found = entry(spark, root, version)
    if found is None:
        raise FileNotFoundError(f"{root} has no committed version")
    return _rows(spark, root, found)


def upsert(df: DataFrame, root: str, keys: list[str], sequence: str | None = None, batch: tuple[str, int] | None = None, buckets: int = 64, tries: int = 100) -> int:
    """New rows win by key; returns the version that holds them. With ``sequence`` the row that is last in it wins, new or old, so late batches undo nothing.

    ``batch``: name of a source and rising number; a number that is not above the source's last one
    has been applied and changes nothing. Only buckets that hold a new row are read and written.
    The first commit fixes keys and number of buckets. Columns that either side lacks are null.
    """
    spark = df.sparkSession
    head = entry(spark, root)
    if head and head["keys"] != keys:
        raise ValueError(f"{root} is kept by {head['keys']}")
    n = head["buckets"] if head else buckets
    new = newer_wins(df.limit(0), df, keys, sequence).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
    new = staged(new, "commit")  # a retry must see the same rows
    touched = [str(r["_bucket"]) for r in new.select("_bucket").distinct().collect()]
    made: dict[str, str] | None = None
    try:
        for _ in range(tries):
            seen, head = head, entry(spark, root)
            if head and batch and head["batches"].get(batch[0], -1) >= batch[1]:
                return head["version"]
            if made is None or _overlap(spark, root, seen, head, set(touched)):
                made, schema = _merge(spark, root, head, new, keys, touched, sequence)
            nothing = {"version": 0, "keys": keys, "buckets": n, "data": {}, "batches": {}}
            base = head or nothing
            text = base | {"version": base["version"] + 1, "schema": schema, "data": base["data"] | made, "touched": touched, "batches": base["batches"] | ({batch[0]: batch[1]} if batch else {})}
            if _create(spark, f"{root}/_log/{text['version']:020d}", json.dumps(text)):
                return text["version"]
        raise RuntimeError(f"{root}: {tries} commits were overtaken")
    finally:
        release(new)


def _overlap(spark: SparkSession, root: str, seen: dict | None, head: dict | None, touched: set[str]) -> bool:
    """Whether the commits after ``seen`` changed buckets of ours, or the columns."""
    first = seen["version"] if seen else 0
    since = [entry(spark, root, v) for v in range(first + 1, (head["version"] if head else 0) + 1)]
    return any(touched & set(e["touched"]) for e in since) or bool(since) and since[-1]["schema"] != (seen or {}).get("schema")


def _merge(spark: SparkSession, root: str, head: dict | None, new: DataFrame, keys: list[str], touched: list[str], sequence: str | None) -> tuple[dict[str, str], dict]:
    """Write the touched buckets anew; their folders and the schema."""
    rows = new
    if head:
        old = _rows(spark, root, head, touched).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(head["buckets"])).cast("int"))
        if sequence:
            both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
            rows = first_per_key(both, keys, [F.desc(sequence), F.desc("_new")]).drop("_new")
        else:
            rows = old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    folder = f"data/{uuid.uuid4().hex}"
    if touched:
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{root}/{folder}")
    return {b: f"{folder}/_bucket={b}" for b in touched}, json.loads(rows.drop("_bucket").schema.json())


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete data that none of the last ``keep`` versions names. Run it while nobody commits."""
    kept = {p.split("/")[1] for v in _versions(spark, root)[-keep:] for p in entry(spark, root, v)["data"].values()}
    data, fs = _fs(spark, f"{root}/data")
    for s in fs.listStatus(data) if fs.exists(data) else []:
        if s.getPath().getName() not in kept:
            fs.delete(s.getPath(), True)
