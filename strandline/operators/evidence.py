"""Evidence layers: default views, coerced and deduplicated rows, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scans
from .scoring import evidence_status


def evidence_layer(df: DataFrame, owner: str, attribute: str, status: str, excerpt: str, notes: str, order: str, checked: Column) -> DataFrame:
    """Rows once each (first in order), status coerced, excerpt only where present, sequence within (owner, attribute) from 0, and whether it is verified."""
    s, e = evidence_status(F.col(status), F.col(excerpt))
    rows = df.select(owner, attribute, s.alias("status"), e.alias("excerpt"), F.coalesce(notes, F.lit("")).alias("notes"), F.col(order).alias("_o"), checked.alias("_c"))
    rows = rows.groupBy(owner, attribute, "status", "excerpt", "notes").agg(F.min("_o").alias("_o"), (F.count("*") - 1).alias("skipped"), F.bool_or("_c").alias("_c"))
    seq = F.row_number().over(Window.partitionBy(owner, attribute).orderBy("_o")) - 1
    flagged = F.lower("notes").contains("flag")
    return rows.withColumn("seq", seq).withColumn("verified", (F.col("status") == "present") & F.col("_c") & ~flagged).drop("_o", "_c")


def default_view(df: DataFrame, chosen: dict[str, str] | None = None, search: str = "", show_absent: bool = False, show_unverified: bool = False, searched: tuple[str, ...] = ("excerpt", "notes")) -> DataFrame:
    """Absent and unverified rows are hidden unless asked for; equality filters and one substring search over the joined texts."""
    keep = F.lit(True)
    if not show_absent:
        keep = keep & (F.col("status") != "not_found")
    if not show_unverified:
        keep = keep & ((F.col("status") != "present") | F.col("verified"))
    for k, v in (chosen or {}).items():
        keep = keep & (F.col(k) == v)
    if search:
        keep = keep & F.contains(F.lower(F.concat_ws(" ", *searched)), F.lit(search.lower()))
    return df.filter(keep)


def context_parts(df: DataFrame, by: str, primary: Column, key: str, label: Column, sep: str = "; ", size: int = 10_000) -> DataFrame:
    """Labels of each group as texts of up to ``size`` labels (part 1, 2, ...), the primary first, then by key; null flags and keys come last, a part without a label is null."""
    rows = df.select(by, (~primary).alias("_later"), F.col(key).alias("_k"), label.alias("_t"))
    order = [F.col(c).asc_nulls_last() for c in ("_later", "_k", "_t")]
    lists = scans.chunked_lists(rows, [by], order, F.col("_t"), size)
    return lists.select(by, "part", F.when(F.exists("items", F.isnotnull), F.array_join("items", sep)).alias("context"))


def ordered_context(df: DataFrame, by: str, primary: Column, key: str, label: Column, sep: str = "; ", size: int = 10_000) -> DataFrame:
    """One text per group with all its labels, ordered as in context_parts(); null without a label.

    Labels are sorted and joined ``size`` at a time, so that only a group's finished text is in one task, as it is in one row.
    """
    parts = context_parts(df, by, primary, key, label, sep, size).filter(F.col("context").isNotNull() | (F.col("part") == 1))
    listed = F.array_sort(F.collect_list(F.struct("part", "context")))
    texts = parts.groupBy(by).agg(F.transform(listed, lambda x: x["context"]).alias("_texts"))
    return texts.select(by, F.when(F.exists("_texts", F.isnotnull), F.array_join("_texts", sep)).alias("context"))


def forbidden_terms(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, term) of every forbidden term in a text."""
    hits = F.filter(F.array(*[F.when(F.contains(F.lower(text), F.lit(t.lower())), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return df.select(key, F.explode(hits).alias("term"))
