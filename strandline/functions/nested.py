"""Arrays and JSON in cells."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def items(c: Column, sep: str = ";") -> Column:
    """Trimmed non-empty parts of a delimited cell."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def balanced_object(c: Column) -> Column:
    """From the first { to its closing brace; null without one. Braces count inside strings too."""
    depth = F.transform(F.split(F.regexp_replace(F.substring(c, F.instr(c, "{"), F.length(c)), r"[^{}]", " "), ""), lambda x: F.when(x == "{", 1).when(x == "}", -1).otherwise(0))
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"), F.lit(False).alias("end"))
    step = lambda a, x: F.struct((a["d"] + x).alias("d"), F.when(a["end"], a["n"]).otherwise(a["n"] + 1).alias("n"), (a["end"] | ((a["d"] + x == 0) & (x != 0))).alias("end"))
    size = F.aggregate(depth, start, step, lambda a: F.when(a["end"], a["n"]))
    return F.when(F.instr(c, "{") > 0, F.substring(c, F.instr(c, "{"), size))


def tolerant_json(c: Column) -> Column:
    """Variant of a cell that is JSON, or holds it in a code fence or among prose; null otherwise."""
    fence = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(F.trim(c)), F.try_parse_json(fence), F.try_parse_json(balanced_object(c)))


def tolerant_json_text(c: Column) -> Column:
    """Like tolerant_json, as canonical text."""
    return F.to_json(tolerant_json(c))


def keyed_lists(json: Column, item: str, flat: str, keys: tuple[str, ...]) -> Column:
    """Array of (kind, item): the flat list if it is there, else the named lists in order; items that do not fit are null and skipped."""
    schema = ", ".join([f"{flat} array<{item}>"] + [f"{k} array<{item}>" for k in keys])
    doc = F.from_json(json, schema)
    tag = lambda name: F.transform(F.coalesce(doc[name], F.array().cast(f"array<{item}>")), lambda x: F.struct(F.lit(None if name == flat else name).cast("string").alias("kind"), x.alias("item")))
    lists = F.when(doc[flat].isNotNull(), tag(flat)).otherwise(F.concat(*[tag(k) for k in keys]))
    return F.filter(lists, lambda x: x["item"].isNotNull())


def candidates_or_failure(df: DataFrame, response: str, item: str, flat: str, keys: tuple[str, ...]) -> DataFrame:
    """A row per candidate of each response, one row with parse_status 'failed' or 'empty' otherwise."""
    text = tolerant_json_text(F.col(response))
    listed = df.withColumn("_json", text).withColumn("_items", keyed_lists(F.col("_json"), item, flat, keys))
    status = F.when(F.col("_json").isNull(), "failed").when(F.size("_items") > 0, "parsed").otherwise("empty")
    return listed.withColumn("parse_status", status).select("*", F.posexplode_outer("_items").alias("position", "_c")).select(*df.columns, "parse_status", "position", "_c.kind", "_c.item")


def _listed_sources(text: str | None, under: str) -> list[dict[str, str]]:
    try:
        payload = json.loads(text or "")
    except ValueError:
        return []
    found: dict[tuple[str, str], None] = {}
    todo = [payload.get(under, []) if isinstance(payload, dict) else payload]
    while todo:  # depth first, a parent's own list before its children
        node = todo.pop()
        if isinstance(node, dict):
            for item in node["sources"] if isinstance(node.get("sources"), list) else []:
                if isinstance(item, dict) and (url := str(item.get("url") or "")):
                    found.setdefault((url, str(item.get("title") or "")))
        todo += reversed(list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else [])
    return [{"url": u, "title": t} for u, t in found]


def sources_in(c: Column, under: str = "output") -> Column:
    """Items with a URL of every ``sources`` list at any depth of a JSON text, distinct by (url, title) in order of first sight.

    A document is searched from its field ``under``, a list from its top. Depth has no bound, so
    this walks each text in Arrow batches.
    """

    @F.pandas_udf("array<struct<url:string,title:string>>")
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _listed_sources(t, under))

    return walk(c)


def zip_numbered(quotes: Column, pages: Column) -> Column:
    """(number from 1, quote, page) by position; a missing page is ''."""
    return F.transform(quotes, lambda q, i: F.struct((i + 1).alias("number"), q.alias("quote"), F.coalesce(F.get(pages, i).cast("string"), F.lit("")).alias("page")))


def best_of(values: Column, order: tuple[str, ...]) -> Column:
    """First of ``order`` among values, else the smallest value."""
    ranked = F.filter(F.array(*[F.lit(x) for x in order]), lambda x: F.array_contains(values, x))
    return F.coalesce(F.get(ranked, F.lit(0)), F.array_min(values))


def has_all(values: Column, required: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(x) for x in required]), values)) == 0


def size_ladder(values: Column, required: tuple[str, ...]) -> Column:
    n = F.size(F.array_intersect(values, F.array(*[F.lit(x) for x in required])))
    return F.when(n >= 3, "high").when(n == 2, "medium").when(n == 1, "low")


def unpivot_lists(df: DataFrame, ids: list[str], attributes: list[str]) -> DataFrame:
    """Wide to long: a row per item of each attribute's list, one row with status not_found for an empty one."""
    parts = F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a), F.array().cast("array<string>")).alias("list")) for a in attributes])
    long = df.select(*ids, F.explode(parts).alias("a")).select(*ids, "a.attribute", F.posexplode_outer("a.list").alias("position", "excerpt"))
    return long.withColumn("status", F.when(F.col("excerpt").isNull(), "not_found").otherwise("present"))


def list_cell(c: Column) -> Column:
    """A cell as a list of texts: a JSON (or single-quoted) array's items, objects as JSON; one object alone; else the bare text; blank gives none."""
    literal = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    t = F.trim(c)
    listed = F.coalesce(F.from_json(t, "array<string>"), F.from_json(F.trim(literal), "array<string>"))
    one = F.coalesce(F.from_json(t, "map<string,string>"), F.from_json(F.trim(literal), "map<string,string>"))
    return (
        F.when(c.isNull() | (t == ""), F.array().cast("array<string>")).when(t.startswith("[") & listed.isNotNull(), listed)
        .when(t.startswith("{") & one.isNotNull(), F.array(F.to_json(one))).otherwise(F.array(c))
    )


def first_field(*columns: Column) -> Column:
    """First non-blank of synonymous fields."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def record_sets(df: DataFrame, response: str, sets: dict[str, list[str]]) -> dict[str, DataFrame]:
    """For each named list of a JSON payload: a row per record with the fixed columns in order; absent fields and NaN are null."""
    out = {}
    for name, columns in sets.items():
        item = "struct<" + ",".join(f"`{c}`:string" for c in columns) + ">"
        each = df.select(F.explode(F.from_json(F.col(response), f"`{name}` array<{item}>")[name]).alias("r"))
        out[name] = each.select(*[F.when(~F.col(f"r.{c}").isin("NaN", "nan"), F.col(f"r.{c}")).alias(c) for c in columns])
    return out
