"""Corpus pipeline: quality rules, near duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The first,
third and fourth write each row once with what they learn of it, decide on narrow tables and read
the rows back in place: texts are not shuffled. The second shuffles the texts that may be copies.
Tables that a stage wrote go when the stage is done, and those that its result reads when the next
stage, which reads that result as written, begins. Null ids are ids; rows that agree in every
column share their fate in the second stage and have one of their own elsewhere; long texts are
read whole; tables without rows pass through.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import jaccard_join, mixing, packing, quality, secrets
from strandline.llm.common import bit_filter, documents, filter_bits, noted, release, staged, with_pass

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[tuple[int, str], list[DataFrame]] = {}  # of each thread and folder: tables that the last stage's result reads


def _clearing(stage: Stage) -> Stage:
    """``stage``, after whose call only the tables stay that its result reads, until the next stage is called.

    Runs in several threads, or over several folders, do not touch each other's tables.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mine = threading.get_ident(), sf_dir
        left = _left.pop(mine, [])
        if stage.__name__ == STAGES[0][0]:  # another run begins; the last one's result may not have been read yet
            left = []
        needed = set(docs.inputFiles()) if left else set()
        still = [t for t in left if needed & set(t.inputFiles())]  # a caller that has not written the result
        release(*[t for t in left if t not in still])
        with noted() as tables:
            out = stage(spark, docs, sf_dir)
        read = set(out.inputFiles())
        reads = list(still)
        for t in tables:
            try:
                files = t.inputFiles()
            except Exception:  # released by its operator already
                continue
            reads.append(t) if read & set(files) else release(t)
        _left[mine] = reads
        return out

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


@_clearing
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the robust distance reject."""
    return quality.robust_outliers(docs.select(*COLUMNS), carry=COLUMNS).filter("kept").select(*COLUMNS)


@_clearing
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id (null ids last), of each group of linked documents; texts without words link with nothing.

    Rows are told by id and hash of the text. Only rows that a filter, sized by the number of marked
    rows up to a bound, does not clear are shuffled, to be told exactly.
    """
    found = staged(jaccard_join.similar_components(docs.select(*COLUMNS)).filter("lead is not null").select("doc_id", "text_hash", "lead"), "pipe-components")
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash"))
    mark = (F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_h"))
    # Rows that repeat both id and text of the one that stays (as a rule there are none) are marked, too.
    each = found.groupBy(*mark).agg(F.max(leads).alias("m_lead"), F.count("*").alias("m_n")).filter("not m_lead or m_n > 1")
    marks = staged(each, "pipe-marks")
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("_t"))
    bits = filter_bits(marks.count())
    docs = with_pass(docs, F.col("_t"), staged(bit_filter(marks.select(F.col("m_h").alias("hash")), bits), "pipe-filter"), bits)
    told = docs.filter("_pass").join(marks, docs["doc_id"].eqNullSafe(marks["m_id"]) & (docs["_t"] == marks["m_h"]), "left")
    alone = docs.filter("not _pass").select(*COLUMNS).unionByName(told.filter("m_n is null").select(*COLUMNS))
    if marks.filter("m_lead").isEmpty():
        return alone
    again = told.filter("m_lead").groupBy("doc_id", "_t").agg(F.min(F.struct(*COLUMNS[1:])).alias("s"))
    return alone.unionByName(again.select("doc_id", "s.*"))


@_clearing
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret but the widely copied examples."""
    found = secrets.scan_secrets(docs.select(*COLUMNS), carry=COLUMNS)
    live = F.filter("found", lambda s: s["verdict"] != "copied")
    masked = F.size(live) > 0
    text = F.when(masked, secrets.mask_secrets(F.col("text"), live)).otherwise(F.col("text"))
    n_chars = F.when(masked, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


@_clearing
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents so that sources come near their share."""
    mixed = mixing.pareto_mix(docs.select(*COLUMNS), carry=COLUMNS).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


@_clearing
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences along the curve."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        done = staged(stage(spark, docs, sf_dir), f"pipe-{name}")
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
