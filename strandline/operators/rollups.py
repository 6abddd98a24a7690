"""Aggregations: zero-filled roll-ups, histograms, summaries, facets, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ratio, smoothed
from . import scans


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def counts_document(df: DataFrame, by: str, name: str = "counts") -> DataFrame:
    """One map of value to count."""
    n = counts(df, by)
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by).cast("string"), "n")))).alias(name))


def rollup_all(universe: DataFrame, key: str, rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Measures per key, aggregated before the join (no fan-out); keys without rows get zeros, also where a measure is null."""
    agg = rows.groupBy(key).agg(*[m.alias(n) for n, m in measures.items()])
    out = universe.join(agg, key, "left")
    return out.select(*universe.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in measures])


def rollup_through(dim: DataFrame, key: str, links: DataFrame, facts: DataFrame, fact_key: str, measures: dict[str, Column]) -> DataFrame:
    """Many-to-many roll-up: each distinct link counts once, so sums over keys exceed the total."""
    each = links.select(key, fact_key).distinct().join(facts, fact_key)
    return rollup_all(dim, key, each, measures)


def totals(df: DataFrame, measures: dict[str, Column], absent: tuple[str, ...] = ()) -> DataFrame:
    """One row of totals, with nulls for stages that are not there."""
    return df.agg(*[m.alias(n) for n, m in measures.items()]).select("*", *[F.lit(None).cast("double").alias(a) for a in absent])


def long_totals(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Totals as rows (stage, value), in order: a funnel from one pass."""
    one = df.agg(*[m.cast("double").alias(n) for n, m in measures.items()])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("stage"), F.col(n).alias("value")) for i, n in enumerate(measures)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def smoothed_rates(df: DataFrame, by: str, n: Column, successes: dict[str, Column], strength: float = 25.0) -> DataFrame:
    """Rates per group pulled to the rate over all groups; the overall row is one aggregate of the groups."""
    g = df.groupBy(by).agg(n.alias("n"), *[s.alias(k) for k, s in successes.items()])
    prior = {k: F.coalesce(ratio(F.sum(k), F.sum("n")), F.lit(0.0)).alias(f"_{k}") for k in successes}
    out = g.crossJoin(F.broadcast(g.agg(*prior.values())))  # one row
    return out.withColumns({f"{k}_rate": smoothed(F.col(k), F.col("n"), F.col(f"_{k}"), strength) for k in successes}).drop(*[f"_{k}" for k in successes])


def histogram(c: Column, edges: list[float]) -> Column:
    """Label of the bin [low, high) that holds a value, the last bin closed; null outside."""
    out = None
    last = len(edges) - 2
    for i in range(len(edges) - 1):
        inside = (c >= edges[i]) & ((c <= edges[i + 1]) if i == last else (c < edges[i + 1]))
        label = f"{edges[i]:g}-{edges[i + 1]:g}"
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def fixed_keys(df: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Counts for a fixed list of keys, zero where absent; other keys are left out."""
    spark = df.sparkSession
    dim = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias(by))
    return dim.join(counts(df, by), by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def summary(df: DataFrame, value: str, label: str, *by: str, conditions: dict[str, Column] | None = None) -> DataFrame:
    """Mean, median, maximum, count and conditional counts."""
    v = F.col(value)
    agg = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max")] + [F.count_if(c).alias(k) for k, c in (conditions or {}).items()]
    return scans.with_medians(df.groupBy(*by).agg(*agg), df, list(by), value).select(F.lit(label).alias("sample"), "*")


def sensitivity(df: DataFrame, value: str, samples: dict[str, Column]) -> DataFrame:
    """Summaries of several filtered samples: each row goes to its samples in one pass, one exchange."""
    member = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in samples.items()]), lambda x: x.isNotNull())
    each = df.select(F.explode(member).alias("sample"), F.col(value).alias("v"))
    return scans.with_medians(each.groupBy("sample").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("max")), each, ["sample"], "v")


def means_of_means(df: DataFrame, value: str, inner: list[str], outer: str) -> DataFrame:
    first = df.groupBy(*inner).agg(F.avg(value).alias("m"))
    return scans.with_medians(first.groupBy(outer).agg(F.count("*").alias("n"), F.avg("m").alias("mean")), first, [outer], "m")


def distinct_text(c: str | Column, sep: str = "; ") -> Column:
    """Aggregate: sorted distinct values, joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def exact_sum_or_blank(c: Column, kind: str = "decimal(38,10)") -> Column:
    """Aggregate: exact sum, null if any value is missing."""
    return F.when(F.count(c) == F.count("*"), F.sum(c.cast(kind)))


def surplus(df: DataFrame, key: str) -> DataFrame:
    """How many rows repeat a key: the sum of (count - 1)."""
    return counts(df.filter(F.col(key).isNotNull()), key).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def dominant(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Commonest value of each group (ties to the smaller) and its share."""
    n = counts(df, *by, value)
    best = n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("b"), F.sum("n").alias("all"))
    return best.select(*by, F.col("b.v").alias("dominant"), (-F.col("b.k") / F.col("all")).alias("share"))


def units_of(df: DataFrame, by: list[str], unit: str, required: list[str]) -> DataFrame:
    """Distinct units of a group, whether all required are there, and the ladder 3, 2, 1 to high, medium, low."""
    s = df.groupBy(*by).agg(F.array_sort(F.collect_set(unit)).alias("units"))
    need = F.array(*[F.lit(r) for r in required])
    k = F.size(F.array_intersect("units", need))
    return s.withColumn("complete", k == len(required)).withColumn("confidence", F.when(k >= 3, "high").when(k == 2, "medium").when(k == 1, "low").otherwise("none"))


def facets(df: DataFrame, columns: list[str], chosen: dict[str, str]) -> DataFrame:
    """Options of each facet (facet, value, n) among rows that match all other facets: one scan, one exchange."""
    match = {c: (F.col(c) == chosen[c]) if c in chosen else F.lit(True) for c in columns}
    rows = []
    for c in columns:
        others = F.lit(True)
        for o in columns:
            if o != c:
                others = others & F.coalesce(match[o], F.lit(False))
        rows.append(F.when(others, F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))))
    each = df.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("f"))
    return each.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def inverted(pairs: DataFrame, key: str, items: str, item: str, size: int = 10_000) -> DataFrame:
    """Rows of (key, list) as rows of (item, part, sorted distinct keys), ``size`` keys a part."""
    each = pairs.filter(F.col(key).isNotNull()).select(key, F.explode(items).alias(item)).distinct()
    return scans.chunked_lists(each, [item], [F.col(key)], F.col(key), size, f"{key}s")


def sets_by_condition(df: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """(condition, key): distinct keys that meet each condition."""
    member = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(member).alias("condition"), key).distinct()
