"""Assembling and following waves of targets: coverage joins, exact hints, checked selections, split metrics, timing reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans, scoring
from .ranking import rank_rows
from .rollups import distinct_text
from .selection import gate

Names = dict[str, str]


def coverage(universe: DataFrame, queue: DataFrame, successes: DataFrame, failures: DataFrame, key: str, queued: Column, unit: str, units: tuple[str, ...], run: str, listed: Names, date: str) -> DataFrame:
    """Each row of the universe with what is queued, found and failed for it, and the statuses that follow.

    ``queue``, ``successes`` and ``failures`` are each reduced to one row a key before they are
    joined, so none multiplies another. ``listed`` names the columns of the successes whose distinct
    values are joined as texts. ``units``: kinds counted one by one; all of them make a full set.
    """
    is_unit = {u: F.count_if(F.col(unit) == u).alias(f"n_{u}") for u in units}
    q = queue.groupBy(key).agg(F.count("*").alias("candidates"), F.count_if(queued).alias("queued"), *is_unit.values())
    s = successes.groupBy(key).agg(F.count_distinct(run).alias("successes"), distinct_text(F.col(run)).alias("success_runs"), F.max(date).alias("last_success"), *[distinct_text(F.col(c)).alias(n) for c, n in listed.items()])
    f = failures.groupBy(key).agg(F.count_distinct(run).alias("failures"), distinct_text(F.col(run)).alias("failed_runs"))
    out = universe.join(q, key, "left").join(s, key, "left").join(f, key, "left")
    numbers, texts = ["candidates", "queued", "successes", "failures", *[f"n_{u}" for u in units]], ["success_runs", "failed_runs", *listed.values()]
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in numbers} | {t: F.coalesce(t, F.lit("")) for t in texts})
    won, lost, found = F.col("successes"), F.col("failures"), F.col("candidates")
    excluded = F.lit("excluded_from_discovery_coverage; ")
    return out.withColumns({
        "coverage_status": scoring.status(won, lost, found), "queue_status": scoring.queue_status(won, lost, found, F.col("queued")),
        "failure_accounting": F.when((lost > 0) & (won > 0), F.concat(excluded, F.lit("later_success_counted"))).when(lost > 0, F.concat(excluded, F.lit("no_successful_rerun"))).otherwise("none"),
        "full_set": F.when(F.least(*[F.col(f"n_{u}") for u in units]) > 0, "yes").otherwise("no"),
        "n_other": found - sum((F.col(f"n_{u}") for u in units), F.lit(0)),
    })


def attach_hints(rows: DataFrame, hints: DataFrame, key: str, columns: list[str], show: int = 5) -> DataFrame:
    """Rows with the hint columns of their exact id; rows without an id pass through with nulls.

    Raises where a hint's id is blank or repeated, or where an id has no hint (with the first
    ``show`` of these).
    """
    at = F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = hints.select(at.alias("_id"), *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    h = gate(h, h.groupBy("_id").count().filter("_id = '' or count > 1").select("_id").orderBy("_id"), "hints with a blank or repeated id", show)
    r = rows.withColumn("_key", F.nullif(at, F.lit("")))
    lost = r.filter("_key is not null").select(F.col("_key").alias("_id")).join(h.select("_id"), "_id", "left_anti").orderBy("_id")
    return gate(r, lost, "ids without a hint", show).join(h, F.col("_key") == F.col("_id"), "left").drop("_key", "_id")


def assemble(top: DataFrame, full: DataFrame, key: str, same: list[str], eligible: Column, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` eligible rows of ``top``, ranked, after it is held against ``full``.

    Raises if a row of ``top`` has no row in ``full``, if one of the ``same`` columns differs there,
    or if fewer than ``n`` rows are eligible.
    """
    other = full.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in same])
    both = top.join(other, F.col(key) == F.col("_key"), "left")
    differs = F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in same])
    fault = F.when(F.col("_key").isNull(), "missing").otherwise(F.nullif(differs, F.lit("")))
    faults = both.select(F.col(key), fault.alias("fault")).filter("fault is not null").orderBy(key)
    ranked = rank_rows(gate(top, faults, "rows that differ from the full file").filter(eligible), order, "wave_rank").filter(F.col("wave_rank") <= n)
    got = ranked.agg(F.count("*").alias("n"))
    return gate(ranked, got.filter(F.col("n") < n), f"fewer than {n} eligible rows")


def selection_faults(df: DataFrame, expected: int, key: str, other_key: str, forbidden: dict[str, Column]) -> DataFrame:
    """(rule, n) of every broken rule of a selection, in one pass: its size, repeated ids, blank or repeated second ids, and rows with a forbidden property."""
    second = F.nullif(F.col(other_key).cast("string"), F.lit(""))
    n = F.count("*")
    found = {
        f"expected_{expected}_rows": F.abs(n - expected), f"repeated_{key}": n - F.count_distinct(key), f"blank_{other_key}": n - F.count(second), f"repeated_{other_key}": F.count(second) - F.count_distinct(second),
        **{k: F.count_if(c) for k, c in forbidden.items()},
    }
    one = df.agg(*[c.cast("long").alias(k) for k, c in found.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in found])
    return one.select(F.explode(rows).alias("r")).select("r.*").filter("n > 0")


def split_metrics(df: DataFrame, by: list[str], rank: str, score: str, size: str, place: str) -> DataFrame:
    """For each split: its rows, ranks, scores and sizes (least, median, largest; sizes that lack), and its commonest place (ties to the smaller) with its share."""
    span = lambda c: [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    each = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(rank).alias(f"{rank}_mean"), *span(rank), *span(score), *span(size), (F.count("*") - F.count(size)).alias(f"{size}_missing"))
    each = scans.with_medians(scans.with_medians(each, df, by, score, f"{score}_median"), df, by, size, f"{size}_median")
    most = df.groupBy(*by, place).agg(F.count("*").alias("_k")).groupBy(*by).agg(F.min(F.struct((-F.col("_k")).alias("k"), F.col(place).alias("p"))).alias("_m"))
    return each.join(most, by).withColumns({f"main_{place}": F.col("_m.p"), f"main_{place}_n": -F.col("_m.k")}).withColumn(f"main_{place}_share", F.col(f"main_{place}_n") / F.col("n")).drop("_m")


def counts_of(df: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """(by, map of the non-blank values to their counts): one row a group, as long as there are values."""
    each = df.select(by, F.nullif(F.trim(value), F.lit("")).alias("_v")).filter("_v is not null").groupBy(by, "_v").agg(F.count("*").alias("_n"))
    return each.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias(name))


def timing_report(df: DataFrame, by: str, attempted: Column, elapsed: Column, slept: Column, level: Column, event: Column, failure: Column, stopped: Column) -> DataFrame:
    """Attempts, mean and median seconds, sleep, pace levels, rows an hour, and counts of events and failures by kind.

    Failures count for rows that were attempted or stopped before their request. Unreadable numbers
    are left out. The hour is the sum of seconds and sleep.
    """
    d = df.select(by, F.coalesce(attempted, F.lit(False)).alias("_a"), elapsed.try_cast("double").alias("_s"), slept.try_cast("double").alias("_z"), level.try_cast("double").alias("_l"), event.alias("_e"), failure.alias("_f"), F.coalesce(stopped, F.lit(False)).alias("_t"))
    spent = F.when(F.col("_a"), F.col("_s"))
    d = d.withColumn("_s", spent)
    total = F.coalesce(F.sum("_s"), F.lit(0.0)) + F.coalesce(F.sum("_z"), F.lit(0.0))
    each = d.groupBy(by).agg(
        F.count_if("_a").alias("attempted"), F.avg("_s").alias("mean_s"), F.coalesce(F.sum("_z"), F.lit(0.0)).alias("slept_s"), F.min("_l").alias("level_min"), F.max("_l").alias("level_max"),
        F.when((F.count_if("_a") > 0) & (total > 0), F.count_if("_a") * 3600 / total).alias("rows_per_hour"),
    )
    each = scans.with_medians(each, d, [by], "_s", "median_s")
    return each.join(counts_of(d, by, F.col("_e"), "events"), by, "left").join(counts_of(d.filter("_a or _t"), by, F.col("_f"), "failures"), by, "left")


def outcomes(df: DataFrame, success: Column, response: Column) -> DataFrame:
    """Rows marked successful, rows with a response, and whether there are both."""
    ok = F.lower(F.trim(F.coalesce(success.cast("string"), F.lit("")))).isin("true", "1", "yes")
    said = F.trim(F.coalesce(response, F.lit(""))) != ""
    one = df.agg(F.count_if(ok).alias("n_successful"), F.count_if(said).alias("n_nonempty"))
    return one.withColumn("succeeded", (F.col("n_successful") > 0) & (F.col("n_nonempty") > 0))
