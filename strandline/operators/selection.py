"""Selections and assemblies: gated filters, batches, carry-forward, run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import blank
from . import rollups
from .ranking import position


def gate(df: DataFrame, broken: DataFrame, message: str, show: int = 5) -> DataFrame:
    """``df``, or an error that lists up to ``show`` rows of ``broken``."""
    found = broken.limit(show).collect()
    if found:
        raise ValueError(f"{message}: {[tuple(r) for r in found]}")
    return df


def rows_of_state(df: DataFrame, state: str, column: str = "state", allow_mixed: bool = False) -> DataFrame:
    """Rows of one state, or all for 'ALL'; several states need ``allow_mixed``."""
    key = F.upper(F.trim(F.col(column)))
    out = df if state.upper() == "ALL" else df.filter(key == state.upper())
    if not allow_mixed and len(out.select(key.alias("s")).distinct().limit(2).collect()) > 1:
        raise ValueError("rows of several states")
    return out


def named_like(c: Column, starts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | F.upper(c).startswith(s.upper())
    return out


def count_allowed(df: DataFrame, wanted: int, most: int, exact: bool) -> int:
    """Row count for a run: positive, at most ``most``, and exact if the input is mixed."""
    n = df.limit(most + 1).count()
    if wanted <= 0 or wanted > most or (exact and n != wanted) or n < wanted:
        raise ValueError(f"{wanted} rows wanted, {n} there, at most {most}")
    return wanted


def by_ids(df: DataFrame, key: str, ids: list, most: int | None = None) -> DataFrame:
    """Rows of listed ids in the list's order; an unknown id is an error."""
    listed = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], f"{key} {df.schema[key].dataType.simpleString()}, _o int")
    gate(df, listed.join(df, key, "left_anti").select(key), "unknown ids")
    out = df.join(listed, key).orderBy("_o")
    return (out.limit(most) if most else out).drop("_o")


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in order of first sight, numbered from 1."""
    first = df.filter(~blank(F.col(key).cast("string"))).groupBy(key).agg(F.min(order).alias("first"))
    return position(first, [F.col("first"), F.col(key)])


def existing(df: DataFrame, preferred: list[str]) -> DataFrame:
    """The preferred columns that exist, in that order."""
    return df.select(*[c for c in preferred if c in df.columns])


def exactly_one(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Keys whose number of flagged rows is not one."""
    return df.groupBy(key).agg(F.count_if(flag).alias("n")).filter("n <> 1")


def batches_with_carry(fresh: DataFrame, carried: DataFrame, order: list[Column], size: int = 100, shard: int = 25, held: str = "held_back") -> DataFrame:
    """Fresh rows in order, then carried ones, in batches and shards; rows marked ``held`` get batch 0."""
    rows = fresh.withColumn("_part", F.lit(0)).unionByName(carried.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    out = rows.withColumn("_held", F.coalesce(F.col(held), F.lit(False)) if held in rows.columns else F.lit(False))
    placed = position(out.filter(~F.col("_held")), [F.col("_part"), *order])
    out = placed.unionByName(out.filter("_held"), allowMissingColumns=True)
    cut = lambda n: F.coalesce(F.floor((F.col("position") - 1) / n) + 1, F.lit(0)).cast("int")
    return out.withColumn("batch", cut(size)).withColumn("shard", cut(shard)).drop("_part", "_held")


def batch_sizes_agree(df: DataFrame, batch: str, size: int) -> DataFrame:
    """Batches that are neither full nor the last."""
    n = df.groupBy(batch).count()
    last = n.agg(F.max(batch).alias("last"))
    return n.crossJoin(F.broadcast(last)).filter(((F.col(batch) != F.col("last")) & (F.col("count") != size)) | (F.col("count") > size)).drop("last")  # one row


def selection_texts(parts: dict[str, Column]) -> Column:
    """Sentence of the parts whose condition holds: {text: condition}."""
    return F.concat_ws("; ", *[F.when(c, F.lit(t)) for t, c in parts.items()])


def timing_of_rows(planned: DataFrame, raw: DataFrame, failed: DataFrame, events: DataFrame, key: str, order: str) -> DataFrame:
    """Planned rows with their last raw response, failure and timing event: the last of repeated ones wins."""
    def last(df: DataFrame, mark: str) -> DataFrame:
        keep = [c for c in df.columns if c not in (key, order)]
        return df.groupBy(key).agg(F.max_by(F.struct(F.lit(True).alias(mark), *keep), order).alias("s")).select(key, "s.*")

    out = planned.join(last(raw, "answered"), key, "left").join(last(failed, "failed"), key, "left").join(last(events, "timed"), key, "left")
    state = F.when(F.col("failed"), "failed").when(F.col("answered"), "done").otherwise("not_run")
    return out.withColumn("state", state).drop("answered", "failed", "timed")


def retry_wins(main: DataFrame, retry: DataFrame, key: str) -> DataFrame:
    """Rows of the main run for keys that the retry run did not touch, and the retry's rows."""
    tag = lambda df, name: df.withColumn("run", F.lit(name))
    return tag(main.join(retry.select(key).distinct(), key, "left_anti"), "main").unionByName(tag(retry, "retry"), allowMissingColumns=True)


def success_ledger(batches: DataFrame, failed: DataFrame, key: str, run: str, order: str) -> DataFrame:
    """Runs in which each key succeeded: batch rows without those that failed in the same run, in order."""
    ok = batches.join(failed.select(key, run).distinct(), [key, run], "left_anti")
    listed = F.array_sort(F.collect_list(F.struct(order, run)))
    return ok.groupBy(key).agg(F.count("*").alias("n_runs"), F.array_join(F.transform(listed, lambda x: x[run]), "; ").alias("runs"), F.max(order).alias("last"))


def latest(df: DataFrame, order: str) -> DataFrame:
    """The whole last row, by a single aggregate."""
    return df.agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def lookup_by_kind(df: DataFrame, kind: str, lookups: dict[str, tuple[DataFrame, str]], value: str, fallback: Column) -> DataFrame:
    """Attribute from the lookup table of the row's kind, each with a key of its own, else the fallback."""
    out, found = df, []
    for i, (k, (table, key)) in enumerate(lookups.items()):
        t = table.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        out = out.join(t, (F.col(kind) == k) & (F.col(key) == F.col(f"_k{i}")), "left")
        found.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*found, fallback)).drop(*[f"_{x}{i}" for i in range(len(lookups)) for x in "kv"])


def crosswalk(candidates: list[tuple[str, DataFrame]], left: str, right: str, fallback: DataFrame) -> DataFrame:
    """Links of several sources, each pair once (the first source names it); keys without a link take the fallback's."""
    rows = None
    for i, (name, df) in enumerate(candidates):
        part = df.select(left, right, F.lit(i).alias("_o"), F.lit(name).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    links = rows.filter(~blank(F.col(right).cast("string"))).groupBy(left, right).agg(F.min_by("source", "_o").alias("source"))
    rest = fallback.join(links.select(left).distinct(), left, "left_anti").select(left, right, F.lit("fallback").alias("source"))
    return links.unionByName(rest)


def run_inverted(runs: DataFrame, run: str, ids: str, key: str) -> DataFrame:
    """(run, map or list of ids) as (id, part, sorted runs), 10,000 runs a part."""
    lists = rollups.inverted(runs, run, ids, key)
    return lists.select(key, "part", F.array_join(f"{run}s", "; ").alias("runs"))


def response_rows(df: DataFrame, response: str, complete: str) -> DataFrame:
    """A response counts as successful if it is complete or not empty."""
    there = F.trim(F.coalesce(response, F.lit(""))) != ""
    return df.withColumn("response_nonempty", there).withColumn("successful", F.coalesce(F.col(complete), F.lit(False)) | there)


def marker_switch(text: Column, cases: dict[str, str], default: str) -> Column:
    """Value of the first marker that a report text holds."""
    out = None
    for marker, value in cases.items():
        hit = F.contains(F.lower(text), F.lit(marker.lower()))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.coalesce(out.otherwise(default), F.lit(default))


def resolve_place(identifier: Column, prompt: Column, places: tuple[str, ...]) -> Column:
    """Place named by the identifier, else by the prompt's field, else the first place whose name the prompt holds as a word."""
    known = lambda c: F.when(c.isin(*places), c)
    word = F.coalesce(*[F.when(prompt.rlike(rf"\b{p}\b"), F.lit(p)) for p in places])
    return F.coalesce(known(F.initcap(F.regexp_extract(F.lower(identifier), r"city_([a-z]+)", 1))), known(F.trim(F.regexp_extract(prompt, r"City:\s*([A-Za-z .'-]+)", 1))), word)


def capped_records(df: DataFrame, key: str, items: str, most: int) -> DataFrame:
    """(key, rank, record) of the first ``most`` items; one error record where there is no list."""
    listed = df.select(key, F.posexplode_outer(F.slice(items, 1, most)).alias("i", "record"))
    return listed.select(key, (F.coalesce("i", F.lit(0)) + 1).alias("rank"), "record", F.when(F.col("record").isNull(), "no list of results").alias("error"))


def group_counts_text(df: DataFrame, by: str, group: str) -> DataFrame:
    """'NY 3, PA 2' per group: counts in falling order, then by name."""
    n = df.groupBy(group, by).count()
    listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), F.col(by).alias("b"))))
    return n.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["b"], F.lit(" "), (-x["k"]).cast("string"))), ", ").alias("counts"))
