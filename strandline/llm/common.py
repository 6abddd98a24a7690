"""Shared pieces of the corpus operators: word rule, written stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import noted, release, reread, shared_dir, staged, staged_small  # noqa: F401

#: White space of the word rule (ASCII only) and a word, as Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, 0 for null; JVM only."""
    parts = F.split(text, SPACE + "+", -1)
    n = F.size(parts) - (parts[0] == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.coalesce(F.when(text.isNotNull(), n), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ``documents`` table, with the named columns only."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def filter_bits(n: int) -> int:
    """Exponent of the size of a bit filter of ``n`` hashes: about 16 bits for each, from 2^23 up to 2^28 (32 MB) in all.

    Past 16 million hashes there are fewer bits for each; a filter passes more rows then, all of
    which are told exactly afterwards.
    """
    return min(28, max(23, (16 * n).bit_length()))


def bit_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """(_w, _b): 64 bits a row of a filter of 2^bits, in which the bit of each value of the column ``hash`` is set.

    At most 2^(bits - 6) rows for any number of hashes, so it may be broadcast (filter_bits() keeps it below 64 MB).
    """
    at = hashes.select(F.pmod(F.col("hash"), F.lit(1 << bits)).alias("_at"))
    return at.groupBy(F.shiftright("_at", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_b"))


def with_pass(df: DataFrame, hash_: Column, filter_: DataFrame, bits: int) -> DataFrame:
    """Adds _pass: false only where ``hash_`` is not among the hashes of bit_filter()."""
    at = F.pmod(hash_, F.lit(1 << bits))
    d = df.withColumn("_at", at)
    d = d.join(F.broadcast(filter_), F.shiftright("_at", 6) == F.col("_w"), "left")
    return d.withColumn("_pass", F.coalesce(F.expr("(shiftright(_b, cast(_at & 63 as int)) & 1) = 1"), F.lit(False))).drop("_at", "_w", "_b")
