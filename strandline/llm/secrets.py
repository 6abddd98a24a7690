"""Secret scan with corpus-wide ownership frequency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: kind, pattern, group that holds the secret, least length of that group. Base kinds first, in their order.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("generic", r"[A-Za-z0-9_+=-]{20,}", 0, 20),
)
N_BASE = 3
_HIT = "array<struct<kind:int,nth:int,gap:int,len:int,value:string>>"


def _hits(text: Column, kind: int) -> Column:
    """All leftmost matches in order: code points before each since the last, its own, and the secret."""
    _, pattern, group, least = KINDS[kind]
    apart = F.split(text, pattern, -1)
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    row = lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("nth"), F.length(z["0"]).alias("gap"), F.length(z["1"]).alias("len"),
        F.when(F.length(z["2"]) >= least, z["2"]).alias("value"),
    )
    found = F.transform(F.filter(F.arrays_zip(apart.alias("0"), whole.alias("1"), value.alias("2")), lambda z: z["1"].isNotNull()), row)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_HIT))


def scan_secrets(
    df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), wide: int = 3,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """A row per row of ``df``: the columns ``carry``, _key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, found.

    Base kinds are the first three of KINDS: all leftmost non-overlapping matches, those with a
    short secret dropped. Generic candidates are runs of 20 characters or more with a digit, an
    upper and a lower case letter, clear of base spans. The SHA-256 of every candidate is counted
    over the corpus by distinct repository and owner. A secret of ``wide`` owners or more is a
    copied example; one of a single owner is live-looking; generic candidates become spans (kind
    "live") only if they are live-looking, base spans always stay. ``found`` holds kind, start,
    end, hash, owners, repositories and verdict of each span.

    Null or empty texts have no spans; null owners count as one owner. Repeated rows are scanned
    each (their copies share an owner). Clashing column names do not matter: only the named
    columns are read. Hashes are pre-aggregated on (hash, owner, repository) before each
    exchange, so a secret that a third of the rows hold never meets in one task; the join back
    has an exchange of its own on both sides, which adaptive execution splits. Rows are written
    once with what is carried, and only those with a candidate are shuffled. Texts of any length
    are scanned whole; equal secrets are one secret; an empty table gives an empty result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    seen = staged(
        df.select(
            F.monotonically_increasing_id().alias("_i"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("_row"), F.col(key).alias("_key"), F.col(owner).alias("_owner"),
            F.to_json(F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(repository)])).alias("_repo"),
            F.concat(*[_hits(t, k) for k in range(len(KINDS))]).alias("_hits"),
        ),
        "secrets-hits",
    )
    shown = [F.col("_row")[c].alias(c) for c in carry]
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    marked = F.exists("_hits", lambda x: x["value"].isNotNull() & ((x["kind"] < N_BASE) | mixed(x["value"])))
    each = seen.filter(marked).select("_i", "_owner", "_repo", F.explode("_hits").alias("h")).select("_i", "_owner", "_repo", "h.*")
    upto = Window.partitionBy("_i", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len")).filter(F.col("value").isNotNull())
    base = F.col("kind") < N_BASE
    by = Window.partitionBy("_i").orderBy("start", "kind")
    reach = F.max(F.when(base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    near = F.min(F.when(base, F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(near, F.col("end")) >= F.col("end"))
    spans = staged(
        placed.withColumn("_clear", clear).filter(base | (F.col("_clear") & mixed(F.col("value"))))
        .select("_i", "_owner", "_repo", "kind", "start", "end", F.sha2("value", 256).alias("hash")),
        "secrets-spans",
    )
    owners = (
        spans.groupBy("hash", "_owner", "_repo").agg(F.count("*").alias("n"))
        .groupBy("hash", "_owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"), F.sum("n").alias("copies"))
    )
    owners = staged(owners, "secrets-owners")
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS[:N_BASE]], F.lit("live")), F.col("kind") + 1)
    verdict = F.when(F.col("owners") >= wide, "copied").when(F.col("owners") == 1, "live").otherwise("shared")
    judged = spans.join(owners, "hash").withColumn("verdict", verdict).filter(base | (F.col("verdict") == "live"))
    judged = judged.select("_i", F.struct("start", "kind", name.alias("name"), "end", "hash", "owners", "repositories", "copies", "verdict").alias("s"))
    of_doc = judged.groupBy("_i").agg(F.array_sort(F.collect_list("s")).alias("found"))
    count = lambda test: F.size(F.filter(F.col("found"), test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
    none = F.lit(None).cast("array<struct<start:bigint,kind:int,name:string,end:bigint,hash:string,owners:bigint,repositories:bigint,copies:bigint,verdict:string>>")
    rows = seen.filter(~marked).select(*shown, "_key", none.alias("found")).unionByName(
        seen.filter(marked).select("_i", *shown, "_key").join(of_doc, "_i", "left").select(*carry, "_key", "found"))
    rows = rows.withColumn("found", F.coalesce("found", F.array().cast(rows.schema["found"].dataType)))
    return rows.select(
        *carry, "_key", *[count(of_kind(k)).alias(f"n_{KINDS[k][0]}") for k in range(N_BASE)],
        F.sha2(told(F.filter("found", lambda s: s["kind"] < N_BASE)), 256).alias("base_sha256"), told(F.col("found")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"), count(lambda s: s["verdict"] == "copied").alias("n_copied"), "found",
    )


def mask_secrets(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span of ``found`` (as scan_secrets gives it, ordered by start) replaced; overlaps merge."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))
        return F.struct(F.when(fresh, piece).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, zero, step, end)).otherwise(text)
