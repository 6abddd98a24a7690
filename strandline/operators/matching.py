"""Joins: tiered interval matching, entity resolution, precedence and reference checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values

TIERS = ("unmatched", "adjacent", "overlap", "exact")


def _cells(span: Column, window: str | None, pad: int, years: int) -> tuple[Column, Column]:
    """The cells of a span, as texts: its cycle, its window's label, and the ranges of years that it meets when ``pad`` years are added at both ends; and the first such range.

    A span of which a year is unknown has no ranges: only equal cycles or labels match it.
    """
    y = [F.coalesce(span[f"y{i}"], F.year(span[f"d{i}"])) for i in (1, 2)]
    every = [span["y1"], span["y2"], F.year(span["d1"]), F.year(span["d2"])]
    first, last = (F.floor(e / years).cast("int") for e in (F.least(*every) - pad, F.greatest(*every) + pad))
    first = F.when(y[0].isNotNull() & y[1].isNotNull(), first)
    ranges = F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(first, last), lambda k: F.concat(F.lit("y"), k.cast("string"))))
    named = [F.concat(F.lit("k"), span["key"])] + ([F.concat(F.lit("l"), span["label"])] if window else [])
    return F.concat(F.array(*named), ranges), first


def match_pairs(left: DataFrame, right: DataFrame, entity: str, start: str, end: str, key: str, window: str | None = None, most: int = 730, years: int = 4, block: int = 4096) -> DataFrame:
    """All pairs of one entity with their tier (1 adjacent, 2 overlap, 3 exact).

    Rows are dealt to cells of their entity: their cycle (and window) for exact matches, and ranges
    of ``years`` for the others, where the left spans reach ``most`` days further. Cells are joined,
    and a pair counts in one cell only: the first that both have. A cell with over ``block`` rows of
    a side is cut into blocks of about that many on either side, each pair of which is a join key of
    its own, so no task holds an entity. ``key`` tells rows of a side apart; rows without an entity
    match nothing; all columns of ``right`` travel with it, so select what is needed.
    """
    span = lambda: values.span(F.col(start), F.col(end), F.col(window) if window else None)
    a = left.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("_e"), F.col(key), span().alias("_a"), F.xxhash64(key).alias("_h"))
    b = right.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("_f"), span().alias("_b"), F.xxhash64(key).alias("_i"), *[F.col(c).alias(f"r_{c}") for c in right.columns])
    cells, first = _cells(F.col("_a"), window, most // 365 + 1, years)
    a = a.select("*", first.alias("_p"), F.explode(cells).alias("_c"))
    cells, first = _cells(F.col("_b"), window, 0, years)
    b = b.select("*", first.alias("_q"), F.explode(cells).alias("_d"))
    n, m = a.groupBy("_e", "_c").agg(F.count("*").alias("_n")), b.groupBy(F.col("_f").alias("_e"), F.col("_d").alias("_c")).agg(F.count("*").alias("_m"))
    large = n.join(m, ["_e", "_c"]).filter(F.greatest("_n", "_m") > block)  # few: each stands for over ``block`` rows
    large = large.select("_e", "_c", F.ceil(F.col("_n") / block).cast("int").alias("_n"), F.ceil(F.col("_m") / block).cast("int").alias("_m"))
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    a = a.join(large, ["_e", "_c"], "left").withColumn("_x", F.pmod("_h", one("_n"))).withColumn("_y", F.explode(F.sequence(F.lit(0), one("_m") - 1))).drop("_n", "_m", "_h")
    large = large.select(F.col("_e").alias("_f"), F.col("_c").alias("_d"), "_n", "_m")
    b = b.join(large, ["_f", "_d"], "left").withColumn("_v", F.pmod("_i", one("_m"))).withColumn("_u", F.explode(F.sequence(F.lit(0), one("_n") - 1))).drop("_n", "_m", "_i")
    x, y = F.col("_a"), F.col("_b")
    near = F.when(values.spans_meet(x, y), 2).when(values.spans_adjacent(x, y, most), 1).otherwise(0)
    here = F.col("_d") == F.concat(F.lit("y"), F.greatest("_p", "_q").cast("string"))
    kind = F.left("_d", F.lit(1))
    tier = F.when(kind == "k", 3).when(kind == "l", F.when(x["key"] == y["key"], 0).otherwise(3)).otherwise(F.when(here & ~values.spans_agree(x, y), near).otherwise(0))
    both = a.join(b, (F.col("_e") == F.col("_f")) & (F.col("_c") == F.col("_d")) & (F.col("_x") == F.col("_u")) & (F.col("_y") == F.col("_v"))).withColumn("tier", tier)
    return both.filter("tier > 0").select(key, F.col(f"r_{key}").alias("match_id"), "tier", F.col("_b.key").alias("cycle"), *[f"r_{c}" for c in right.columns if c != key])


def match_tiers(left: DataFrame, right: DataFrame, entity: str, start: str, end: str, key: str, classes: str, window: str | None = None, most: int = 730, ids: bool = True) -> DataFrame:
    """Each left row with its best tier and, of that tier only: number of matches, classes and cycles (sorted, distinct, joined) and, with ``ids``, the ids.

    Without ids, pairs are counted in the map tasks and a row never holds its matches; with them,
    the best tier comes with its rows in one grouped pass, so no pair is joined twice.
    """
    needed = dict.fromkeys([entity, start, end, *([window] if window else []), key, classes])
    pairs = match_pairs(left.select(*[c for c in needed if c != classes or c in left.columns]), right.select(*needed), entity, start, end, key, window, most)
    at = lambda t, c: F.when(F.col("tier") == t, c)
    listed = F.struct("match_id", F.col(f"r_{classes}").alias("c"), F.col("cycle").alias("w"))
    agg = {"n": lambda t: F.count_if(F.col("tier") == t), "c": lambda t: F.collect_set(at(t, F.col(f"r_{classes}"))), "w": lambda t: F.collect_set(at(t, F.col("cycle")))}
    if ids:
        agg["m"] = lambda t: F.transform(F.sort_array(F.collect_set(at(t, listed))), lambda x: x["match_id"])
    best = pairs.groupBy(key).agg(F.max("tier").alias("best"), *[F.struct(*[f(t).alias(k) for k, f in agg.items()]).alias(f"t{t}") for t in (1, 2, 3)])
    best = best.select(key, "best", F.when(F.col("best") == 3, F.col("t3")).when(F.col("best") == 2, F.col("t2")).otherwise(F.col("t1")).alias("at"))
    words = lambda f: F.coalesce(F.array_join(F.array_sort(F.col("at")[f]), "; "), F.lit(""))
    out = left.select(key).join(best, key, "left")
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.coalesce("best", F.lit(0)) + 1)
    listing = [F.coalesce(F.col("at.m"), F.array().cast(f"array<{right.schema[key].dataType.simpleString()}>")).alias("match_ids")] if ids else []
    return out.select(key, tier.alias("tier"), F.coalesce(F.col("at.n"), F.lit(0)).alias("n_matches"), words("c").alias("match_classes"), words("w").alias("match_cycles"), *listing)


def resolve_names(rows: DataFrame, universe: DataFrame, state: str, name_key: str, preferred: Column) -> DataFrame:
    """Adds resolved_id: of a unique match, else of a unique preferred match; and resolution ('unique', 'preferred', 'ambiguous', 'none')."""
    u = universe.groupBy(state, name_key).agg(F.count("*").alias("_n"), F.min("id").alias("_id"), F.count_if(preferred).alias("_np"), F.min(F.when(preferred, F.col("id"))).alias("_pid"))
    out = rows.join(u, [state, name_key], "left")
    how = F.when(F.col("_n") == 1, "unique").when(F.col("_np") == 1, "preferred").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    return out.withColumn("resolution", how).withColumn("resolved_id", F.when(F.col("_n") == 1, F.col("_id")).when(F.col("_np") == 1, F.col("_pid"))).drop("_n", "_id", "_np", "_pid")


def newer_wins(old: DataFrame, new: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """Old rows without a new one, and the (last) new row of each key."""
    if sequence:
        last = Window.partitionBy(*keys).orderBy(F.desc(sequence))
        new = new.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")
    return old.join(new, keys, "left_anti").unionByName(new)


def first_of_files(files: list[DataFrame], key: str) -> DataFrame:
    """The first file's row for each key, then the second's, and so on."""
    ranked = [f.withColumn("_file", F.lit(i)) for i, f in enumerate(files)]
    rows = ranked[0]
    for f in ranked[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("_file"))).filter("_rn = 1").drop("_rn", "_file")


def complete_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that raises on a row without a partner."""
    got = left.join(right.withColumn("_there", F.lit(True)), key, "left")
    return got.withColumn("_there", F.when(F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string"))))).filter("_there").drop("_there")


def missing_keys(left: DataFrame, right: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows of ``left`` with a non-blank key that ``right`` lacks."""
    r = right.select(F.col(other or key).alias(key)).distinct()
    return left.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).join(r, key, "left_anti")


def flag_known(df: DataFrame, known: DataFrame, key: str, name: str = "is_known") -> DataFrame:
    """Boolean column: whether the key is among ``known``."""
    k = known.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(k, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def explode_and_score(df: DataFrame, ids: str, scores: DataFrame, key: str, score: str, by: str) -> DataFrame:
    """Rows with a list of ids, scored by the listed rows: number listed, mean and best score of those found."""
    each = df.select(by, F.explode(ids).alias(key)).join(scores.select(key, score), key, "left")
    return each.groupBy(by).agg(F.count("*").alias("n_listed"), F.avg(score).alias("mean_score"), F.max(score).alias("best_score"))


def labels_of(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join to a dimension (Spark broadcasts it if its size allows)."""
    return df.join(dim, key, "left")


def merge_sources(sources: list[DataFrame], key: str, later_wins: list[str], first_wins: list[str], label: str) -> DataFrame:
    """Rows of several sources merged by key: of some fields the last non-blank, of others the first; labels of all sources joined in order."""
    rows = sources[0].withColumn("_o", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("_o", F.lit(i)), allowMissingColumns=True)
    seen = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c))
    last = [F.max_by(c, F.when(seen(c).isNotNull(), F.col("_o"))).alias(c) for c in later_wins]
    first = [F.min_by(c, F.when(seen(c).isNotNull(), F.col("_o"))).alias(c) for c in first_wins]
    names = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_o", label))), lambda x: x[label]), "; ").alias(label)
    return rows.groupBy(key).agg(*last, *first, names)
