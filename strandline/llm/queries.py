"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, brown_lm, filter_audit, jaccard_join, mixing, packing, pii, quality, secrets, sharding, token_counts, url_filter, whitening
from .common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), _vocabulary("byte_bpe_50k.json")).drop("ids")


def op2_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.pareto_mix(documents(spark, sf_dir, "doc_id", "source", "text"), carry=("doc_id",))
    size = F.col("mix_size")
    return mixed.select("doc_id", size.alias("size"), "source_size", "target", (size * F.col("copies")).alias("taken"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(documents(spark, sf_dir, "doc_id", "text", "source", "lang"))
    return out.select(F.col("_key").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied")


def op4_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"), _vocabulary("piece_bpe_32k.model"))


def op5_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op6_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = documents(spark, sf_dir, "doc_id", "text").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shuffle_into_shards(slim, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.robust_outliers(documents(spark, sf_dir, "doc_id", "text", "source", "lang"), carry=("doc_id",))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op8_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(documents(spark, sf_dir, "doc_id", "text"))


def op9_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir, "doc_id", "text"))


def op10_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(documents(spark, sf_dir, "doc_id", "text")).drop("text_hash", "lead")


def op11_url_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = url_filter.judge_urls(pages, url_filter.fit_table(url_filter.labelled_table()))
    return out.select("page_id", "host", "path", "rule", "verdict", "probability")


def op12_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.audit(documents(spark, sf_dir, "doc_id", "source", "text"), labels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_COMPONENTS = r"""
with recursive
w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)),
e as (select x, y from l union select y, x from l),
r as (select x, y from e union select r.x, e.y from r join e on e.x = r.y)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) as component_id
from documents d left join n on n.doc_id = d.doc_id left join (select x, min(y) as c from r group by 1) m on m.x = d.doc_id
"""

_AUDIT = r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, min(doc_id) over (partition by text) as least from t),
f as (select doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] as fails from w),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
m as (select part, fails, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n from f left join l using (doc_id) group by all),
x as (select unnest([1, 2, 3, 4, 5]) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as seq from x a, x b, x c, x d, x e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r as (select m.*, seq, coalesce(list_min(list_filter(range(1, 6), lambda k: fails[seq[k]])), 6) as first from m, o),
s as (select part, seq, step, sum(n) filter (where first > step) as kept, sum(n) filter (where first = step) as removed, sum(n) filter (where fails[seq[step]] and first < step) as redundant,
  sum(n) filter (where fails[seq[step]] and len(list_filter(fails, lambda y: y)) = 1) as unique_fails, sum(n) filter (where first = step and good) as good_lost, sum(n) filter (where first = step and toxic) as toxic_lost
  from r, (select unnest([1, 2, 3, 4, 5]) as step) group by 1, 2, 3)
select part, array_to_string(list_transform(seq, lambda k: chr(64 + k::int)), '') as filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, sum(coalesce(removed, 0)) over (partition by part, seq[step])::bigint as shapley from s
"""


def oracle_sql() -> dict[str, str]:
    """The join and the audit are stated in SQL; the others are tested against brute-force versions."""
    return {"op10_token_group_join": _COMPONENTS, "op13_filter_replay": _AUDIT}
