"""Verbatim quotes: which of many quotes stand in which of many texts, white space and case aside."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import fold

MOST = 2_000_000  # characters of quotes in one automaton: some 200 MB of a task's memory


def _found(texts: DataFrame, patterns: list[str], kind: str) -> DataFrame:
    """(_key, _q) of each text and pattern in it, by one pass of an automaton over the text."""
    shared = texts.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if not shared.value:
            return
        automaton = ahocorasick.Automaton()
        for i, p in enumerate(shared.value):
            automaton.add_word(p, i)
        automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for row, text in enumerate(batch.column(1)):
                for i in {i for _, i in automaton.iter(text.as_py())} if text.is_valid else ():
                    rows.append(row)
                    hits.append(shared.value[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], ["_key", "_q"])

    return texts.mapInArrow(run, f"_key {kind}, _q string")


def quotes_in(texts: DataFrame, key: str, text: str, quotes: DataFrame, quote_id: str, quote: str, least: int = 15, most: int = MOST) -> DataFrame:
    """(key, quote_id) of every quote of ``least`` characters or more that stands in a text.

    The distinct quotes are measured first. Up to ``most`` characters they are one automaton, which
    is broadcast, and each text is read once and shuffled nowhere. Above, quotes of six words or
    more are found by an equi-join of their second to fifth word with all runs of four words of the
    texts and then checked, and the shorter ones are parted by hash into automata of about ``most``
    characters each. Texts and quotes may be null, empty or long; repeated rows count as they stand.
    """
    kind = texts.schema[key].dataType.simpleString()
    q = quotes.select(F.col(quote_id), fold(F.col(quote)).alias("_q")).filter(F.length("_q") >= least)
    t = texts.select(F.col(key).alias("_key"), fold(F.col(text)).alias("_t"))
    each = q.select("_q").distinct()
    size = each.agg(F.coalesce(F.sum(F.length("_q")), F.lit(0))).first()[0]
    if size <= most:
        found = _found(t, sorted(r["_q"] for r in each.collect()), kind)
    else:
        short = F.size(F.split("_q", " ")) < 6
        found = _by_windows(t, each.filter(~short))
        few = each.filter(short)
        parts = -(-(few.agg(F.coalesce(F.sum(F.length("_q")), F.lit(0))).first()[0]) // most)
        for p in range(parts):
            found = found.unionByName(_found(t, sorted(r["_q"] for r in few.filter(F.pmod(F.xxhash64("_q"), F.lit(parts)) == p).collect()), kind))
    return found.join(q, "_q").select(F.col("_key").alias(key), quote_id)


def _by_windows(t: DataFrame, long: DataFrame) -> DataFrame:
    """The same for quotes of six words or more; the first and last word of a quote can be parts of words."""
    b = long.withColumn("_k", F.array_join(F.slice(F.split("_q", " "), 2, 4), " "))
    words = t.select("*", F.split("_t", " ").alias("_w"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 3, F.lit(1))), lambda i: F.array_join(F.slice("_w", i, 4), " ")))
    pairs = words.select("_key", F.xxhash64("_t").alias("_h"), F.explode(runs).alias("_k")).join(b, "_k").select("_key", "_h", "_q").distinct()
    return pairs.join(t.select(F.col("_key").alias("_key2"), "_t", F.xxhash64("_t").alias("_h2")), F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("_h") == F.col("_h2"))).filter(F.contains("_t", "_q")).select("_key", "_q")
