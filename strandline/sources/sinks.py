"""Sinks: ordered CSV, checked and atomic writes, appends with schema growth, nested documents, reports."""

from __future__ import annotations

import uuid
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import exists


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "overwrite") -> None:
    """The named columns in order; missing cells are empty; as many files as partitions."""
    df.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_checked(df: DataFrame, path: str, fields: list[str]) -> int:
    """Write, read again and compare columns and row count; returns the count."""
    spark = df.sparkSession
    expected = df.count()
    write_csv(df, path, fields)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if expected and (back.columns != fields or back.count() != expected):
        raise ValueError(f"{path}: read back {back.columns}, {back.count()} rows; wrote {fields}, {expected}")
    return expected


def replace_parquet(df: DataFrame, path: str) -> None:
    """Write beside the table, then swap by two renames.

    Between them the path names no table for a moment; if the second fails, the old table is put
    back. Readers that must never miss it read through publish() and current().
    """
    spark, part = df.sparkSession, f"{path}.part-{uuid.uuid4().hex}"
    df.write.parquet(part)
    target, fs = _fs(spark, path)
    old, had = _fs(spark, f"{path}.old-{uuid.uuid4().hex}")[0], fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(_fs(spark, part)[0], target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{part} cannot be moved to {path}")
    if had:
        fs.delete(old, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside and renamed over the old one in one step: readers see the old or the new text."""
    jvm, (tmp, fs) = spark.sparkContext._jvm, _fs(spark, f"{path}.part-{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    target, conf = _fs(spark, path)[0], spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(tmp, target, how)


def publish(df: DataFrame, root: str) -> str:
    """Write a version of a table under ``root`` and make it the current one in one step; returns its path."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    write_text(df.sparkSession, f"{root}/CURRENT", path)
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    """The current version of a published table."""
    return spark.read.parquet(spark.read.text(f"{root}/CURRENT").first()[0])


def append(df: DataFrame, path: str) -> None:
    """Append or create; if the columns differ, the table is rewritten with the columns of both."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.parquet(path)
        return
    old = spark.read.parquet(path)
    if old.columns == df.columns:
        df.write.mode("append").parquet(path)
    else:
        replace_parquet(old.unionByName(df, allowMissingColumns=True), path)


def upsert_parquet(df: DataFrame, path: str, keys: list[str], sequence: str | None = None) -> None:
    """New rows win by key."""
    from ..operators.ledgers import upsert

    spark = df.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else df.limit(0)
    replace_parquet(upsert(old, df, keys, sequence), path)


def split_quarantine(df: DataFrame, missing: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields, and the others with the list of what they lack."""
    marked = df.withColumn("_missing", missing)
    return marked.filter(F.size("_missing") == 0).drop("_missing"), marked.filter(F.size("_missing") > 0).withColumn("missing_fields", F.array_join("_missing", ";")).drop("_missing")


def documents(df: DataFrame, key: str, body: list[Column], metadata: dict[str, str]) -> DataFrame:
    """(key, json): a nested document per row with shared metadata."""
    meta = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]).alias("metadata")
    return df.select(key, F.to_json(F.struct(meta, *body)).alias("json"))


def html(df: DataFrame, most: int = 200, caption: str = "") -> str:
    """A small result as an HTML table, escaped (an error over ``most`` rows)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{escape('' if c is None else str(c))}</{tag}>" for c in row) + "</tr>"
    title = f"<caption>{escape(caption)}</caption>" if caption else ""
    return "\n".join([f"<table>{title}", "<thead>", cells("th", df.columns), "</thead>", "<tbody>", *[cells("td", r) for r in rows], "</tbody>", "</table>"])


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table (an error over ``most`` rows)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])
