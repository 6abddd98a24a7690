"""Bindings: scans that need a column or a file, hashes of files, committed tables and streams into them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import commits, sinks, tables
from ..streaming import ledgers
from .records import _folder
from .registry import query


@query("select c_custkey::varchar as c_custkey, c_name, case when c_custkey % 3 <> 0 then c_mktsegment end as c_mktsegment, true as complete from customer")
def q_required_and_optional(t):
    """A file with required columns, a file that may be absent, and what is reported of one that lacks a column."""
    spark, at = _folder(t)
    fields = ["c_custkey", "c_name", "c_mktsegment"]
    sinks.write_csv(t("customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))), f"{at}/c", fields)
    rows = tables.read_csv(spark, f"{at}/c", fields)
    try:
        tables.read_csv(spark, f"{at}/c", ["c_phone_2"])
        complete = False
    except ValueError:
        complete = True
    absent = tables.read_optional(spark, f"{at}/none", "c_custkey string, c_name string, c_mktsegment string")
    return rows.unionByName(absent).select(*fields, F.lit(complete).alias("complete"))


@query("select n_regionkey::int as region, sha256(string_agg(n_name || chr(10), '' order by n_name)) as sha256, sum(length(n_name) + 1)::bigint as length from nation group by 1")
def q_file_hashes(t):
    spark, at = _folder(t)
    n = t("nation").select("n_name", F.col("n_regionkey").cast("int").alias("region"))
    n.repartition(1).sortWithinPartitions("region", "n_name").write.partitionBy("region").text(f"{at}/n")  # a file a region
    files = tables.file_hashes(spark, f"{at}/n/region=*/part-*")
    return files.select(F.regexp_extract("path", "region=([0-9]+)", 1).cast("int").alias("region"), "sha256", "length")


@query("""
select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1""")
def q_upsert_stream(t):
    """Orders as a stream in three parts, out of order, into a committed table of each customer's newest; a batch that comes again changes nothing."""
    spark, at = _folder(t)
    o = t("orders").select("o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("seq"))
    for part in (2, 0, 1):
        o.filter(F.col("o_orderkey") % 3 == part).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    q = ledgers.upsert_stream(stream, f"{at}/t", ["o_custkey"], f"{at}/c", "seq", once=True)
    q.awaitTermination()
    again = commits.upsert(o.filter("o_orderkey % 3 = 0"), f"{at}/t", ["o_custkey"], "seq", (f"{at}/c", 0))
    return commits.read(spark, f"{at}/t", again).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
select c_custkey, case when c_custkey % 5 = 0 then 'second' when c_custkey % 2 = 0 then 'first' else 'base' end as state, case when c_custkey % 5 = 0 then c_acctbal end as balance from customer""")
def q_committed_versions(t):
    """Three commits to one table by key, the last with a new column; only buckets that a commit touches are written."""
    spark, at = _folder(t)
    c = t("customer")
    commits.upsert(c.select("c_custkey", F.lit("base").alias("state")), f"{at}/t", ["c_custkey"])
    commits.upsert(c.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("first").alias("state")), f"{at}/t", ["c_custkey"])
    commits.upsert(c.filter("c_custkey % 5 = 0").select("c_custkey", F.lit("second").alias("state"), F.col("c_acctbal").alias("balance")), f"{at}/t", ["c_custkey"])
    commits.vacuum(spark, f"{at}/t", keep=1)
    return commits.read(spark, f"{at}/t")
