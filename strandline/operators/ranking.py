"""Ranks, tiers, batches, sequences and consecutive runs.

Global ranks come from a range partitioning that is written once, and from per-range counts (see
position()), never from one task; windows are per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stages import reread
from . import scans

W = Window


def _starts(sums: DataFrame) -> DataFrame:
    """(_p, _start): the sums of the ranges before each; one row a range."""
    before = F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.select("_p", before.alias("_start"))


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Running sum in a global order without a single-task window: range partitions, summed within, plus the sums of the ranges before.

    End the order with a key where rows may tie. The table is written between dealing and summing.
    """
    dealt = scans.deal(df.withColumn("_v", value), [], order)
    starts = _starts(reread(dealt).groupBy("_p").agg(F.sum("_v").alias("_s")))
    local = F.sum("_v").over(W.partitionBy("_p").orderBy("_r").rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn("_n", local).join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_n")).drop("_p", "_r", "_n", "_v", "_start")


def position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Global row number in a total order: one exchange, no window over rows."""
    dealt = scans.deal(df, [], order)
    starts = _starts(reread(dealt).groupBy("_p").agg(F.count("*").alias("_s")))
    return dealt.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_r") + 1).drop("_p", "_r", "_start")


def rank_rows(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    return position(df, order, name)


def cut_tiers(df: DataFrame, order: list[Column], shares: tuple[float, ...] = (0.05, 0.15, 0.35, 0.65), rank: str = "rank", tier: str = "tier") -> DataFrame:
    """Rank and tier by ceil(n * share) cuts."""
    out = rank_rows(df, order, rank).crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    t = F.lit(len(shares) + 1)
    for i in reversed(range(len(shares))):
        t = F.when(F.col(rank) <= F.ceil(F.col("_n") * shares[i]), i + 1).otherwise(t)
    return out.withColumn(tier, t).drop("_n")


def mid_rank(df: DataFrame, value: str, name: str = "midrank") -> DataFrame:
    """(rows below + (ties - 1) / 2) / (rows - 1), null for null values; from one row per distinct value."""
    each = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    all_ = each.agg(F.sum("_c").alias("_all"))
    each = running_total(each, [F.col(value)], F.col("_c"), "_upto").crossJoin(F.broadcast(all_))  # one row
    each = each.select(value, F.try_divide(F.col("_upto") - F.col("_c") + (F.col("_c") - 1) / 2, F.col("_all") - 1).alias(name))
    return df.join(each, value, "left")


def rank_variants(df: DataFrame, key: str, scores: dict[str, Column], ties: list[str], top: int) -> tuple[DataFrame, DataFrame]:
    """Ranks under each score (falling, nulls last; then by ``ties``, rising), and for the union of the tops: the overlap flag and largest displacement from the first.

    All orders are one: rows of (score's number, score as a double, ties) are dealt into ranges once,
    and a rank is the position in that order less those of the scores before. ``key`` tells rows
    apart and comes back from the ranks by one join.
    """
    names = list(scores)
    which = F.array(*[F.struct(F.lit(i).alias("n"), s.cast("double").alias("s")) for i, s in enumerate(scores.values())])
    columns = dict.fromkeys([key, *ties])
    each = df.select(*columns, F.explode(which).alias("_v")).select(*columns, F.col("_v.n").alias("_variant"), F.col("_v.s").alias("_s"))
    placed = scans.numbered(scans.deal(each, ["_variant"], [F.desc("_s"), *map(F.asc, ties)]), ["_variant"], "_rank")
    ranked = placed.groupBy(F.col(key).alias("_key")).agg(*[F.max(F.when(F.col("_variant") == i, F.col("_rank"))).alias(f"rank_{n}") for i, n in enumerate(names)])
    out = df.join(ranked, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    ranks = [F.col(f"rank_{n}") for n in names]
    moved = F.greatest(*[F.abs(r - ranks[0]) for r in ranks[1:]]) if len(ranks) > 2 else F.abs(ranks[1] - ranks[0])
    union = out.filter(F.least(*ranks) <= top).select(key, *ranks, (F.greatest(*ranks) <= top).alias("in_all"), moved.alias("displacement"))
    return out, union


def round_robin(df: DataFrame, tier: str, stratum: str, order: list[Column], name: str = "position") -> DataFrame:
    """Within a tier, cycle k takes each stratum's k-th row; the cycle's rows stand in ``order``.

    Positions in a tier are global positions less those of the tiers before, so a tier with most
    rows is dealt over many tasks.
    """
    cycle = df.withColumn("cycle", F.row_number().over(W.partitionBy(tier, stratum).orderBy(*order)))
    placed = position(cycle, [F.col(tier), F.col("cycle"), *order], "_at")
    first = placed.groupBy(F.col(tier).alias("_tier")).agg((F.min("_at") - 1).alias("_before"))
    return placed.join(first, F.col(tier).eqNullSafe(F.col("_tier"))).withColumn(name, F.col("_at") - F.col("_before")).drop("_at", "_tier", "_before")


def slices(rank: Column, size: int) -> Column:
    return F.floor((rank - 1) / size).cast("int") + 1


def dealt(rank: Column, hands: int) -> Column:
    return (rank - 1) % hands + 1


def sequence_in(df: DataFrame, by: list[str], order: str, name: str = "seq", start: int = 0) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1 + start)


def first_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each key; the counterpart of keep-first and, with a falling order, of keep-last."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_rn = 1").drop("_rn")


def dedupe_rows(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row per distinct combination (first in order), with the number left out."""
    return df.groupBy(*columns).agg(F.min(order).alias(order), (F.count("*") - 1).alias("skipped"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("position") <= n)


def top(df: DataFrame, order: list[Column], n: int, name: str = "position") -> DataFrame:
    """First ``n`` rows, numbered (a bounded heap a task; only those rows are numbered)."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(W.orderBy(*order)))


def stop_gate(df: DataFrame, by: list[str], order: str, failed: Column, most: int = 2) -> DataFrame:
    """Run length of failures at each row, and whether the row comes after the first run of ``most``; a scan over ranges, so one key may hold most rows."""
    dealt = scans.deal(df.withColumn("_failed", failed), by, [F.col(order)])
    out = scans.run_lengths(dealt, by, {"failures_in_a_row": F.col("_failed")}, most)
    return out.withColumnRenamed("failures_in_a_row_reached", "stopped").drop("_failed", "_p", "_r")
