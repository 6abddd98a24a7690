"""Stateful and ledger operators: upserts, resume plans, pacing, ingest decisions, timing and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stages import staged
from . import scans
from .matching import newer_wins


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """Old rows whose key is not in ``new``, and the new rows (the last of a key that repeats)."""
    return newer_wins(old, new, keys, sequence)


def with_new_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append with schema growth: columns of either side, nulls where one lacks them."""
    return old.unionByName(new, allowMissingColumns=True)


def resume_plan(planned: DataFrame, prior: DataFrame, key: str, status: str, failure: str, retry: tuple[str, ...]) -> DataFrame:
    """Action of each planned row: skip what succeeded, retry chosen failures, hold the others, run what has not run."""
    p = prior.select(key, F.col(status).alias("_s"), F.col(failure).alias("_f"))
    action = F.when(F.col("_s").isNull(), "run").when(F.col("_s") == "success", "skip").when(F.col("_f").isin(*retry), "retry").otherwise("hold")
    return planned.join(p, key, "left").withColumn("action", action).drop("_s", "_f")


def ingest_decisions(rows: DataFrame, existing: DataFrame, key: str, order: str, missing: Column) -> DataFrame:
    """duplicate (known before), quarantined (repeats in the batch, or lacks fields) or ingested."""
    known = existing.select(key).distinct().withColumn("_k", F.lit(True))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    out = rows.withColumn("_n", nth).join(known, key, "left")
    decision = F.when(F.col("_k"), "duplicate").when((F.size(missing) > 0) | (F.col("_n") > 1), "quarantined").otherwise("ingested")
    return out.withColumn("missing_fields", missing).withColumn("decision", decision).drop("_k", "_n")


def pacing(df: DataFrame, by: list[str], order: str, failed: Column, low: float = 3.0, base: float = 5.0, high: float = 15.0, backoff: float = 10.0, stable: int = 25, strikes: int = 2) -> DataFrame:
    """Pause after each row of a run, a fold over its outcomes in order.

    A success adds to a calm streak that takes one second off at each ``stable``; a failure ends
    it and raises the pause to ``backoff``, or to ``high`` from the ``strikes``-th in a row. A row's
    place in its streak tells which of these happens, and every one maps a pause p to
    max(p + step, floor), so both are prefix scans: a run of any length is spread over ranges.
    Pauses count to six places. A null outcome is a success.
    """
    if not low <= base <= high or not low <= backoff <= high:
        raise ValueError("low <= base, backoff <= high must hold")
    f, exact = F.col("_failed"), lambda x: F.lit(x).cast("decimal(20,6)")
    dealt = scans.deal(df.select(*by, order, F.coalesce(failed.cast("boolean"), F.lit(False)).alias("_failed")), by, [F.col(order)])
    d = staged(scans.run_lengths(dealt, by, {"_strikes": f, "_calm": ~f}), "streaks")
    due = ~f & (F.col("_calm") % stable == 0)
    floor = F.when(f, F.when(F.col("_strikes") >= strikes, exact(high)).otherwise(exact(backoff))).when(due, exact(low))
    d = scans.max_plus(d, by, F.when(due, -1).otherwise(0), floor, exact(base), "_pause", "_was")
    now, was = F.col("_pause"), F.col("_was")
    event = (
        F.when(f & (now > was), "backoff").when(f, "backoff_held")
        .when(due & (now < was), "stable_step_down").when(due, "stable_at_min").otherwise("stable_hold")
    )
    return d.select(*by, order, now.cast("double").alias("pause"), event.alias("event"))


def timing_summary(df: DataFrame, by: list[str], seconds: str, rows: str) -> DataFrame:
    s = F.col(seconds)
    each = df.groupBy(*by).agg(F.count(s).alias("n"), F.avg(s).alias("mean_s"), F.min(s).alias("min_s"), F.max(s).alias("max_s"), (F.sum(rows) * 3600.0 / F.sum(s)).alias("rows_per_hour"))
    return scans.with_medians(each, df, by, seconds, "median_s")


def cost_summary(df: DataFrame, by: list[str], parseable: Column, tokens_in: str, tokens_out: str, tokens_all: str, cost: str) -> DataFrame:
    """Counts and tokens split by outcome; all tokens as reported if any row reports them, else in plus out."""
    both = F.coalesce(F.sum(tokens_in), F.lit(0)) + F.coalesce(F.sum(tokens_out), F.lit(0))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(parseable).alias("n_parseable"), F.count_if(~parseable).alias("n_failed"),
        F.when(F.count(tokens_all) > 0, F.sum(tokens_all)).otherwise(both).alias("tokens"), F.sum(F.when(parseable, F.col(cost))).alias("cost_parseable"), F.sum(F.when(~parseable, F.col(cost))).alias("cost_failed"),
    )


def run_comparison(df: DataFrame, by: str, parseable: Column) -> DataFrame:
    n, ok = F.count("*"), F.count_if(parseable)
    return df.groupBy(by).agg(n.alias("n"), ok.alias("n_parseable"), F.concat(F.round(ok * 100 / n, 1).cast("string"), F.lit("%")).alias("parse_rate"))
