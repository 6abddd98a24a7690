"""Filter interaction audit: what each of five filters removes, in every order.

A direct relational replay: each document's flags are crossed with the 120 orders (a broadcast
table of that size), the five steps are exploded, the first failure is computed, and conditional
sums are combined in the map tasks before they are shuffled, some 600 rows a part and task.

Documents with null text count as empty, with a null source as of the part ''. A null id is neither
larger nor smaller than any id, so such a document is no repeat and makes none, and has no label. Rows that repeat an
id and its text are no repeats of each other. Labels that repeat an id count where any of them says
so; documents without one are neither good nor toxic. Long texts are read whole, in windows of 4 MB;
only digests of texts are shuffled. A table without rows has no parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

FILTERS = "ABCDE"
WINDOW = 1 << 22
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUING = bytes(range(0x80, 0xC0))  # second and later bytes of a code point


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, in windows that end between words."""
    s = 0
    while s < len(text):
        e = min(s + WINDOW, len(text))
        while e < len(text) and text[e] not in _SPACE:
            e += 1
        yield text[s:e].split()
        s = e


def own_flags(text: bytes) -> int:
    """Bits of the filters A to D that one text (UTF-8) fails."""
    n, seen = 0, set()
    for words in _words(text):
        n += len(words)
        seen.update(words)
    points = len(text.translate(None, _CONTINUING))
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(text.translate(None, b"#$%&*|")) < len(text)
    return (n < 50) | (100 * len(seen) < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | symbols << 3


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text) and mask (bits of A to D) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2)]
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array([own_flags(t) for t in texts], pa.int32())], ["doc_id", "part", "digest", "mask"])

    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, part string, digest binary, mask int")


def orders(spark) -> DataFrame:
    """number, filter_order and bits (of the filter at each step): one row for each of the 120 orders."""
    rows = [(k, "".join(p), [1 << FILTERS.index(f) for f in p]) for k, p in enumerate(permutations(FILTERS))]
    return spark.createDataFrame(rows, "number int, filter_order string, bits array<int>")


def replay(marked: DataFrame) -> DataFrame:
    """Counts of each part, order and step from rows of part, mask (bits of A to E), good and toxic."""
    every = orders(marked.sparkSession)
    d = marked.select("part", "mask", "good", "toxic").crossJoin(F.broadcast(every.select("number", "bits")))  # 120 rows
    fails = lambda k: F.col("mask").bitwiseAND(F.col("bits")[k]) != 0
    first = F.lit(len(FILTERS))
    for k in reversed(range(len(FILTERS))):
        first = F.when(fails(k), k).otherwise(first)
    d = d.withColumn("first", first).select("*", F.posexplode("bits").alias("at", "bit"))
    here = F.col("first") == F.col("at")
    failed = F.col("mask").bitwiseAND(F.col("bit")) != 0

    def count(c: Column, name: str) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)

    sums = d.groupBy("part", "number", "at").agg(
        count(F.col("first") > F.col("at"), "kept"), count(here, "removed"), count(failed & (F.col("first") < F.col("at")), "redundant"),
        count(F.col("mask") == F.col("bit"), "unique_fails"), count(here & F.col("good"), "good_lost"), count(here & F.col("toxic"), "toxic_lost"),
    )
    out = sums.join(F.broadcast(every.select("number", "filter_order")), "number").withColumn("step", F.col("at") + 1)
    own = Window.partitionBy("part", F.substr("filter_order", "step", F.lit(1)))  # 120 rows: one of each order
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(own).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step, with its counts."""
    rows = staged(flags(docs), "audit-flags")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least")
    told = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    least, told = staged(least, "audit-least"), staged(told, "audit-labels")  # so that the joins have exchanges of their own, whose hot keys are split
    marked = rows.join(least, "digest", "left").join(told, "doc_id", "left")
    repeat = F.when(F.col("doc_id") > F.col("least"), 1 << 4).otherwise(0)
    no = F.lit(False)
    return replay(marked.select("part", F.col("mask").bitwiseOR(repeat).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")))
