"""Data-quality constraints: every check gives rows (check, row, field, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import blank
from ..functions.values import valid_date


def _found(df: DataFrame, row: str, check: str, tests: list[tuple[str, Column, Column]]) -> DataFrame:
    """Violations of (field, failing condition, message), all fields in one pass."""
    hits = F.filter(F.array(*[F.when(bad, F.struct(F.lit(f).alias("field"), msg.alias("message"))) for f, bad, msg in tests]), lambda x: x.isNotNull())
    return df.select(F.lit(check).alias("check"), F.col(row).cast("string").alias("row"), F.explode(hits).alias("v")).select("check", "row", "v.field", "v.message")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def required(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    return _found(df, row, "required", [(f, blank(F.trim(_text(f))), F.lit("missing")) for f in fields])


def allowed(df: DataFrame, row: str, values: dict[str, list[str]], optional: bool = True) -> DataFrame:
    bad = lambda f, v: F.when(blank(_text(f)), F.lit(not optional)).otherwise(~_text(f).isin(v))
    return _found(df, row, "allowed", [(f, bad(f, v), F.concat(F.lit("not allowed: "), F.coalesce(_text(f), F.lit("")))) for f, v in values.items()])


def dates(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    return _found(df, row, "date", [(f, ~blank(_text(f)) & ~valid_date(_text(f)), F.concat(F.lit("no date: "), _text(f))) for f in fields])


def in_range(df: DataFrame, row: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    tests = []
    for f, (low, high) in ranges.items():
        x = _text(f).try_cast("double")
        tests.append((f, ~blank(_text(f)) & ~F.coalesce(x.between(low, high) & ~F.isnan(x), F.lit(False)), F.when(x.isNull(), "not a number").otherwise("out of range")))
    return _found(df, row, "range", tests)


def unique(df: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """Repeats of a non-blank key, each with the row it repeats (the first in row order)."""
    d = df.filter(~blank(F.concat_ws("", *[_text(k) for k in keys]))).select(F.col(row).alias("_row"), F.xxhash64(*keys).alias("_h"), *keys)
    twice = d.groupBy("_h", *keys).agg(F.min("_row").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")  # partial counts first: a hot key is no hot task
    same = [d["_h"] == twice["_h"], *[d[k].eqNullSafe(twice[k]) for k in keys]]
    again = d.join(twice, same).filter(F.col("_row") != F.col("_first"))
    return again.select(F.lit("unique").alias("check"), F.col("_row").cast("string").alias("row"), F.lit(",".join(keys)).alias("field"), F.concat(F.lit("repeats row "), F.col("_first").cast("string")).alias("message"))


def flag_agrees(df: DataFrame, row: str, flag: str, derived: Column, known: Column) -> DataFrame:
    """A 0/1 flag that must equal ``derived`` where the class is ``known``."""
    x = _text(flag)
    bad01, wrong = ~F.coalesce(x.isin("0", "1"), F.lit(False)), known & (x != derived.cast("int").cast("string"))
    return _found(df, row, "flag", [(flag, bad01 | F.coalesce(wrong, F.lit(False)), F.when(bad01, "not 0 or 1").otherwise("does not match its class"))])


def resolves(df: DataFrame, row: str, field: str, other: DataFrame, other_key: str, where: Column | None = None) -> DataFrame:
    """Non-blank references without a row on the other side."""
    d = df.filter(where) if where is not None else df
    d = d.filter(~blank(_text(field))).join(other.select(F.col(other_key).alias(field)).distinct(), field, "left_anti")
    return d.select(F.lit("reference").alias("check"), F.col(row).cast("string").alias("row"), F.lit(field).alias("field"), F.concat(F.lit("unknown "), _text(field)).alias("message"))


def report(*violations: DataFrame) -> DataFrame:
    out = violations[0]
    for v in violations[1:]:
        out = out.unionByName(v)
    return out.orderBy("check", "row", "field")


def missing_fields(fields: list[str]) -> Column:
    """Array of the required fields that are blank."""
    return F.filter(F.array(*[F.when(blank(F.trim(_text(f))), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def reconcile(checks: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """(name, expected, actual, ok) of one-value frames."""
    out = None
    for name, df, expected in checks:
        row = df.select(F.lit(name).alias("name"), F.lit(float(expected)).alias("expected"), F.col(df.columns[0]).cast("double").alias("actual"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    left = a.select(key).distinct().join(b, key, "left_anti").withColumn("only_in", F.lit("left"))
    return left.unionByName(b.select(key).distinct().join(a, key, "left_anti").withColumn("only_in", F.lit("right")))


def same_values(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that differ between rows of one key (nulls equal)."""
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"))
    hits = F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("left"), F.col(f"b.{f}").cast("string").alias("right"))) for f in fields])
    return j.select(F.col(f"a.{key}"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def concentrated(df: DataFrame, group: str, most_rows: int, most_share: float) -> DataFrame:
    """Groups with too many rows or too large a share of them."""
    n = df.groupBy(group).count()
    n = n.crossJoin(F.broadcast(n.agg(F.sum("count").alias("_all"))))  # one row
    return n.withColumn("share", F.col("count") / F.col("_all")).drop("_all").filter((F.col("count") > most_rows) | (F.col("share") > most_share))
