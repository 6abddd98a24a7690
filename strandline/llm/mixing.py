"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranking import position
from .common import release, reread, staged, staged_small, word_count


def _targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds _goal to a row per source (_s, _total): shares of all words by weight, none over ``most`` times its total, the excess reshared."""
    placed = position(sources, [F.col("_s").asc_nulls_last()], "_at")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_at") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = staged_small(placed.withColumn("_w", w).drop("_at"), "mix-weights")
    level, full = F.lit(0.0), -1
    while True:
        over = level * F.col("_w") > most * F.col("_total")
        r = placed.agg(F.sum("_total").alias("n"), F.sum(F.when(over, most * F.col("_total"))).alias("held"), F.sum(F.when(~over, F.col("_w"))).alias("w"), F.count_if(over).alias("full")).first()
        if r["full"] == full or not r["w"]:
            break
        full, level = r["full"], F.lit((r["n"] - (r["held"] or 0.0)) / r["w"])
    return placed.withColumn("_goal", F.least(level * F.col("_w"), most * F.col("_total"))).drop("_w")


def _rates(sized: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """Adds _rate to the plan: copies due per tilt, so that the due words of a source, none over ``most`` copies, sum to its goal."""
    at_limit = F.col("_goal") >= most * F.col("_total") * (1 - 1e-9)
    rate = F.when(at_limit, F.lit(float("inf"))).otherwise(F.col("_goal") / F.col("_gn"))
    plan = staged_small(plan.withColumn("_rate", rate).withColumn("_capped", F.lit(0).cast("long")), "mix-rates")
    while not plan.filter((F.col("_rate") < float("inf")) & (F.col("_rate") * F.col("_gmax") >= most)).isEmpty():
        full = sized.join(plan, sized["_s"].eqNullSafe(plan["_s"])).filter((F.col("_rate") < float("inf")) & (F.col("_rate") * F.col("_g") >= most) & (F.col("_n") > 0))
        full = full.groupBy(sized["_s"].alias("_fs")).agg(F.sum("_n").alias("_fn"), F.sum(F.col("_n") * F.col("_g")).alias("_fg"), F.count("*").alias("_more"))
        full = staged_small(full, "mix-full")
        joined = plan.join(full, plan["_s"].eqNullSafe(full["_fs"]), "left")
        left = F.col("_gn") - F.coalesce("_fg", F.lit(0))
        again = F.when(F.col("_fn").isNotNull() & (left > 0), (F.col("_goal") - most * F.col("_fn")) / left).otherwise(F.col("_rate"))
        moved = F.coalesce("_more", F.lit(0)) != F.col("_capped")
        new = staged_small(joined.select("_s", "_total", "_goal", "_gn", "_gmax", again.alias("_rate"), F.coalesce("_more", F.lit(0)).alias("_capped"), moved.alias("_moved")), "mix-rates")
        done = new.filter("_moved").isEmpty()
        release(plan, full)
        plan = new.drop("_moved")
        plan._stage_path = new._stage_path
        if done:
            break
    return plan


def pareto_mix(
    df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0, size: Column | None = None, tilt: float = 0.1, seed: int = 2, carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Whole copies of every row so that each source's words come near its share of all words.

    Sources in code point order (null last) take ``weights`` in turn. Returns the columns ``carry``
    (all but the text if None) with text_hash (xxhash64 of the text), mix_size, source_size, target
    and copies (0 .. ``most``); input columns of these names are replaced.

    A document is due copies in proportion to size^tilt, at most ``most``, such that the due words
    of its source sum to the source's target (the rate is solved for with the capped documents set
    aside). Its whole copies are certain. For one more copy, the fraction p that is left is its
    odds of inclusion: documents are ranked by u/(1-u) over p/(1-p) (u: a hash of key and text,
    so that reruns agree), and those up to where the words of a source run out are taken. What
    the last one leaves open is closed by the single further document whose size comes nearest,
    if any brings the source nearer its target: one document a source at most is chosen by size.

    The sample is a cut in the ranking, so the rows are written once with what is carried, are
    not shuffled and learn their copies from a row per source. The ranking itself holds sizes
    only: rows are dealt by range of (source, rank), each range sums its own, and the ranges' sums
    give the offsets, so no source is ever in one task. Sources are a table; nothing per source
    reaches the driver.

    Nulls and empties: a text without words has size and copies 0; a null source is a source, a
    null key a key. Repeated rows count as rows of their own, ties in rank fall to either of
    equals. Texts of any length count whole. An empty table gives an empty result.
    """
    rest = [c for c in (carry or [c for c in df.columns if c != text]) if c not in ("mix_size", "source_size", "target", "copies", "text_hash")]
    words = word_count(F.col(text)) if size is None else size
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text))), 11) + 0.5) / float(1 << 53)
    g = F.floor(1000 * F.pow(F.greatest(F.col("_n"), F.lit(1)).cast("double"), F.lit(tilt)))  # whole numbers: sums do not depend on their order
    row = F.struct(*[F.col(f"`{c}`") for c in rest], F.xxhash64(F.col(text)).alias("text_hash")).alias("_row")
    t = df.select(row, F.col(source).alias("_s"), words.alias("_n"), u.alias("_u"), F.monotonically_increasing_id().alias("_i")).withColumn("_g", g)
    t = staged(t, "mix-sized")
    sized = t.select("_s", "_n", "_g", "_u", "_i")
    sources = staged_small(sized.groupBy("_s").agg(F.sum("_n").alias("_total"), F.sum(F.col("_n") * F.col("_g")).alias("_gn"), F.max("_g").alias("_gmax")), "mix-sources")
    plan = _rates(sized, _targets(sources, weights, most), most)

    due = F.least(F.col("_rate") * F.col("_g"), F.lit(float(most)))
    whole = F.when(F.col("_n") > 0, F.floor("_due")).otherwise(0).cast("long")
    p = F.col("_due") - F.floor("_due")
    drawn = (F.col("_n") > 0) & (F.col("_due") < most) & (p > 0)
    rank = F.when(drawn, F.col("_u") / (1 - F.col("_u")) * (1 - p) / p)
    with_plan = lambda rows, plan: rows.join(plan.withColumnRenamed("_s", "_ps"), rows["_s"].eqNullSafe(F.col("_ps"))).withColumn("_due", due).withColumn("_q", rank).withColumn("_whole", whole)
    ranked = with_plan(sized, plan)
    certain = ranked.groupBy(F.col("_s").alias("_cs")).agg(F.sum(F.col("_n") * F.col("_whole")).alias("_certain"))
    order = ("_s", "_q", "_i")
    dealt = ranked.filter("_q is not null").select("_s", "_q", "_i", "_n").repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    dealt = staged(dealt, "mix-dealt")
    parts = reread(dealt).groupBy("_s", "_p").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("_s").alias("_os"), F.col("_p").alias("_op"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    run = F.sum("_n").over(Window.partitionBy("_s", "_p").orderBy("_q", "_i").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("_run", run).join(starts, dealt["_s"].eqNullSafe(F.col("_os")) & (dealt["_p"] == F.col("_op")))
    room = plan.join(certain, plan["_s"].eqNullSafe(certain["_cs"])).select(F.col("_s").alias("_rs"), (F.col("_goal") - F.col("_certain")).alias("_room"))
    room = staged_small(room, "mix-room")
    placed = placed.withColumn("_upto", F.col("_start") + F.col("_run")).join(room, F.col("_s").eqNullSafe(F.col("_rs"))).select("_s", "_q", "_i", "_n", "_upto", "_room")
    placed = staged(placed, "mix-placed")
    fits = F.col("_upto") <= F.col("_room")
    cut = placed.groupBy("_s").agg(F.max(F.when(fits, F.struct("_q", "_i"))).alias("_cut"), F.coalesce(F.max(F.when(fits, F.col("_upto"))), F.lit(0)).alias("_taken"))
    cut = staged_small(cut.withColumnRenamed("_s", "_ks"), "mix-cut")
    open_ = F.col("_room") - F.col("_taken")
    last = placed.filter(~fits).join(cut, F.col("_s").eqNullSafe(F.col("_ks"))).filter(F.abs(open_ - F.col("_n")) < open_)
    last = staged_small(last.groupBy(F.col("_s").alias("_ls")).agg(F.min(F.struct(F.abs(open_ - F.col("_n")).alias("d"), "_q", "_i")).alias("_last")), "mix-last")
    plan = plan.join(cut, plan["_s"].eqNullSafe(F.col("_ks")), "left").join(last, plan["_s"].eqNullSafe(F.col("_ls")), "left")
    plan = staged_small(plan.select("_s", "_total", "_goal", "_rate", "_cut", F.col("_last._i").alias("_last")), "mix-plan")
    release(dealt, placed)
    at = F.struct("_q", "_i")
    more = F.col("_q").isNotNull() & F.coalesce((at <= F.col("_cut")) | (F.col("_i") == F.col("_last")), F.lit(False))
    return with_plan(t, plan).select(
        "_row.*", F.col("_n").alias("mix_size"), F.col("_total").alias("source_size"), F.col("_goal").alias("target"),
        (F.col("_whole") + more.cast("long")).alias("copies"),
    )
