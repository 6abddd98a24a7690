"""Scans: typed CSV, JSON, archives and sheets, with one blank policy (missing is null)."""

from __future__ import annotations

import io
import re
import struct
import sys
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package


def exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(p))


def null_blanks(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None, schema: str | None = None, sep: str = ",", lines_in_cells: bool = True) -> DataFrame:
    """CSV with a header and long cells; a byte-order mark is dropped; raises if a required column is absent.

    Quoted line breaks make each file one task; large files without them are split if
    ``lines_in_cells`` is false.
    """
    reader = spark.read.option("header", True).option("multiLine", lines_in_cells).option("escape", '"').option("sep", sep).option("maxCharsPerColumn", -1)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if gone := [c for c in required or [] if c not in df.columns]:
        raise ValueError(f"{path} lacks columns {gone}")
    return null_blanks(df)


def read_optional(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Like read_csv; no rows if the file is absent."""
    return read_csv(spark, path, schema=schema, sep=sep) if exists(spark, path) else spark.createDataFrame([], schema)


def read_or_report(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, list[str]]:
    """Rows and errors: an absent file is an error and an empty table."""
    return (read_csv(spark, path, schema=schema), []) if exists(spark, path) else (spark.createDataFrame([], schema), [f"missing {path}"])


def read_many(spark: SparkSession, files: list[dict], required: list[str] | None = None) -> DataFrame:
    """Files with constant columns of their own: each entry has a path and values; columns missing in one file are null."""
    out = None
    for spec in files:
        df = read_csv(spark, spec["path"], required)
        for k, v in spec.items():
            if k != "path":
                df = df.withColumn(k, F.lit(v))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON documents; absent or corrupt ones give no rows, or raise if strict."""
    if not strict and not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df


class _Inflated(io.RawIOBase):
    """A member's bytes as they are inflated, a piece at a time; its checksum is compared at the end."""

    def __init__(self, data: bytes, method: int, crc: int):
        self.data, self.at, self.left, self.crc, self.want = data, 0, b"", 0, crc
        self.inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None

    def readable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        while not self.left and self.at < len(self.data):
            piece = self.data[self.at : self.at + (1 << 16)]
            self.at += len(piece)
            self.left = self.inflate.decompress(piece) if self.inflate else piece
            if self.at >= len(self.data) and self.inflate:
                self.left += self.inflate.flush()
            self.crc = zlib.crc32(self.left, self.crc)
        n = min(len(room), len(self.left))
        room[:n], self.left = self.left[:n], self.left[n:]
        if not n and len(room) and self.crc != self.want:
            raise zipfile.BadZipFile("bad CRC-32")
        return n


def zip_members(spark: SparkSession, path: str, member: str = ".*") -> DataFrame:
    """(archive, member, method, crc, data) of ZIP archives: the packed bytes of every member, dealt to a task each as far as there are tasks.

    Archives are read by Spark's own reader, so any store will do; an archive is a row of up to 2 GB there.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, raw in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for m in z.infolist():
                        if not re.fullmatch(member, m.filename):
                            continue
                        if m.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not m.flag_bits & 1:
                            name, extra = struct.unpack("<HH", raw[m.header_offset + 26 : m.header_offset + 30])
                            start = m.header_offset + 30 + name + extra
                            row = (m.compress_type, m.CRC, raw[start : start + m.compress_size])
                        else:  # other methods are unpacked here
                            row = (zipfile.ZIP_STORED, m.CRC, z.read(m))
                        yield pd.DataFrame([(archive, m.filename, *row)], columns=["archive", "member", "method", "crc", "data"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cut, "archive string, member string, method int, crc long, data binary").repartition(n, "archive", "member")


def read_zipped(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", member: str = r".*\.txt", encoding: str = "utf-8") -> DataFrame:
    """Delimited text inside ZIP archives, a member a task; header names trimmed, the named columns only, all text; blanks are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data, method, crc in zip(batch["data"], batch["method"], batch["crc"], strict=True):
                text = io.TextIOWrapper(io.BufferedReader(_Inflated(data, method, crc)), encoding)
                for part in pd.read_csv(text, sep=sep, dtype=str, keep_default_na=False, chunksize=50_000, usecols=lambda c: c.strip() in columns):
                    part.columns = [c.strip() for c in part.columns]
                    yield part[columns].apply(lambda c: c.str.strip()).replace("", None)

    return zip_members(spark, path, member).mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def read_sheet(spark: SparkSession, path: str, columns: list[str], sheet: str = "xl/worksheets/sheet1.xml") -> DataFrame:
    """First sheet of XLSX workbooks by its XML: shared strings, cell references (gaps are null), header in the first row."""
    tag = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def index(ref: str) -> int:
        n = 0
        for c in re.match("[A-Z]+", ref)[0]:
            n = n * 26 + ord(c) - 64
        return n - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = set(z.namelist())
                    shared = ["".join(t.text or "" for t in si.iter(f"{tag}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{tag}si")] if "xl/sharedStrings.xml" in names else []
                    header, rows = None, []
                    for row in ElementTree.fromstring(z.read(sheet)).iter(f"{tag}row"):
                        cells = {}
                        for c in row.iter(f"{tag}c"):
                            v = c.find(f"{tag}v")
                            text = "".join(t.text or "" for t in c.iter(f"{tag}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                            cells[index(c.get("r"))] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                        if header is None:
                            header = {v: k for k, v in cells.items()}
                        else:
                            rows.append([cells.get(header.get(c, -1)) for c in columns])
                    yield pd.DataFrame(rows, columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def reuse_text(rows: DataFrame, cached: DataFrame, key: str, text: str, fresh: str) -> DataFrame:
    """Cached text where there is some, else the fresh one, and where it came from."""
    c = cached.select(key, F.col(text).alias("_cached"))
    out = rows.join(c, key, "left")
    have = F.col("_cached").isNotNull() & (F.col("_cached") != "")
    return out.withColumn("text_source", F.when(have, "cache").otherwise("fresh")).withColumn(text, F.when(have, F.col("_cached")).otherwise(F.col(fresh))).drop("_cached")


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Columns filled where blank, added where absent."""
    return df.select("*", *[F.lit(v).alias(k) for k, v in defaults.items() if k not in df.columns]).withColumns({k: F.coalesce(k, F.lit(v)) for k, v in defaults.items() if k in df.columns})


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")
