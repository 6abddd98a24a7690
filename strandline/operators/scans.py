"""Segmented prefix scans: running results per key in a global order, where one key may hold most rows.

Rows are dealt once into ranges of (key, order) and written; a range holds many small keys or a
piece of a large one. Windows run per piece. What a piece needs of the pieces before it comes from
one row a piece, and only pieces that are not their key's first, one a range at most, are broadcast.
Orders must be total within a key: end them with a column that tells rows apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..sources.stages import reread, staged

_ROW = (1 << 33) - 1  # the part of a generated id that counts a partition's rows


def deal(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows sorted in ranges of key and order, with _p (range) and _r (row in it), written: the ranges are drawn once, whatever reads them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, by), *order]
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    return staged(rows.withColumn("_p", F.shiftright("_m", 33)).withColumn("_r", F.col("_m").bitwiseAND(F.lit(_ROW))).drop("_m"), "ranked")


def _own(by: list[str]) -> WindowSpec:
    return Window.partitionBy("_p", *by).orderBy("_r")


def _upto(w: WindowSpec, last: int = 0) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, last)


def _with_carry(d: DataFrame, pieces: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``d`` with the named columns of its piece, null in the first piece of a key."""
    later = pieces.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("_p"))).filter("_nth > 1")
    carry = later.select(F.col("_p").alias("_q"), *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], *names)
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)], F.col("_p") == F.col("_q"))
    return d.join(F.broadcast(carry), same, "left").drop("_q", *[f"_by{i}" for i in range(len(by))])  # one row a range at most


def run_lengths(dealt: DataFrame, by: list[str], flags: dict[str, Column], most: int | None = None) -> DataFrame:
    """For each flag, how many rows up to each one bear it without a break (0 where it is false or null).

    With ``most``, also <name>_reached: whether a row before had a run of that length.
    """
    own, d = _own(by), dealt.withColumn("_first", F.first("_r").over(_upto(_own(by))))
    for k, flag in flags.items():
        d = d.withColumn(f"_x_{k}", F.max(F.when(~F.coalesce(flag, F.lit(False)), F.col("_r"))).over(_upto(own)))
        d = d.withColumn(k, F.when(F.col(f"_x_{k}").isNull(), F.col("_r") - F.col("_first") + 1).otherwise(F.col("_r") - F.col(f"_x_{k}")))
    ends = []
    for k in flags:
        unbroken = F.col(f"_x_{k}").isNull()
        ends += [F.max_by(k, "_r").alias(f"_t_{k}"), F.max((~unbroken).cast("int")).alias(f"_b_{k}"), F.count_if(unbroken).alias(f"_l_{k}"), F.max(k).alias(f"_h_{k}")]
    pieces = d.groupBy("_p", *by).agg(*ends)
    along = Window.partitionBy(*by).orderBy("_p")
    carried = []
    for k in flags:
        pieces = pieces.withColumn(f"_i_{k}", F.sum(f"_b_{k}").over(_upto(along)))
        pieces = pieces.withColumn(f"_o_{k}", F.sum(f"_t_{k}").over(_upto(Window.partitionBy(*by, f"_i_{k}").orderBy("_p"))))
        pieces = pieces.withColumn(f"_c_{k}", F.coalesce(F.lag(f"_o_{k}").over(along), F.lit(0)))
        carried.append(f"_c_{k}")
        if most is not None:
            longest = F.greatest(F.col(f"_h_{k}"), F.when(F.col(f"_l_{k}") > 0, F.col(f"_c_{k}") + F.col(f"_l_{k}")).otherwise(0))
            pieces = pieces.withColumn(f"_g_{k}", longest).withColumn(f"_z_{k}", F.max(f"_g_{k}").over(_upto(along, -1)))
            carried.append(f"_z_{k}")
    d = _with_carry(d, pieces, by, carried)
    for k in flags:
        d = d.withColumn(k, F.col(k) + F.when(F.col(f"_x_{k}").isNull(), F.coalesce(f"_c_{k}", F.lit(0))).otherwise(0))
        if most is not None:
            d = d.withColumn(f"{k}_reached", F.coalesce(F.greatest(f"_z_{k}", F.max(k).over(_upto(own, -1))), F.lit(0)) >= most)
    return d.drop("_first", *carried, *[f"_x_{k}" for k in flags])


def max_plus(dealt: DataFrame, by: list[str], step: Column, floor: Column, start: Column, name: str, before: str) -> DataFrame:
    """The fold v -> max(v + step, floor) from ``start`` along each key: its value after each row (``name``) and before it (``before``).

    Such maps compose: v after a row is the sum S of the steps so far plus the largest of the start
    and all floors less their S. ``step`` is a whole number, ``floor`` null where it does not bind.
    """
    own = _own(by)
    d = dealt.withColumn("_s", F.sum(step).over(_upto(own))).withColumn("_f", floor - F.col("_s")).withColumn("_m", F.max("_f").over(_upto(own)))
    pieces = d.groupBy("_p", *by).agg(F.max_by("_s", "_r").alias("_ps"), F.max("_m").alias("_pm"))
    along = _upto(Window.partitionBy(*by).orderBy("_p"), -1)
    pieces = pieces.withColumn("_sb", F.coalesce(F.sum("_ps").over(along), F.lit(0))).withColumn("_pg", F.col("_pm") - F.col("_sb")).withColumn("_mb", F.max("_pg").over(along))
    d = _with_carry(d, pieces, by, ["_sb", "_mb"]).withColumn("_sb", F.coalesce("_sb", F.lit(0)))
    d = d.withColumn(name, F.col("_sb") + F.col("_s") + F.greatest(start, F.col("_mb"), F.col("_m") - F.col("_sb")))
    d = d.withColumn(before, F.coalesce(F.lag(name).over(own), F.col("_sb") + F.greatest(start, F.col("_mb"))))
    return d.drop("_s", "_f", "_m", "_sb", "_mb")


def numbered(dealt: DataFrame, by: list[str], name: str = "position") -> DataFrame:
    """Row number within each key, from 1."""
    own = _own(by)
    d = dealt.withColumn(name, F.row_number().over(own).cast("long"))
    pieces = reread(dealt).groupBy("_p", *by).agg(F.count("*").alias("_pn"))
    pieces = pieces.withColumn("_c", F.sum("_pn").over(_upto(Window.partitionBy(*by).orderBy("_p"), -1)))
    return _with_carry(d, pieces, by, ["_c"]).withColumn(name, F.col(name) + F.coalesce("_c", F.lit(0))).drop("_c")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, interpolated between neighbours as doubles; groups without a value are left out.

    A distributed selection: equal values of a group are one row with a count, these rows are dealt
    into ranges, counts by range tell which ranges hold the wanted ranks of a group, and only those
    pieces are numbered. A group with any share of the rows, or any share of equal values, is spread.
    """
    names = [f"_by{i}" for i in range(len(by))]  # of the join's other side
    each = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_w"))
    dealt = deal(each, by, [F.col("_value")])
    along = Window.partitionBy(*by)
    pieces = reread(dealt).groupBy("_p", *by).agg(F.sum("_w").alias("_n"))
    pieces = pieces.withColumn("_upto", F.sum("_n").over(_upto(along.orderBy("_p")))).withColumn("_all", F.sum("_n").over(along))
    low, high = ([f(F.lit(s) * (F.col("_all") - 1)).cast("long") for s in shares.values()] for f in (F.floor, F.ceil))
    inside = lambda k, start, end: (k >= start) & (k < end)
    wanted = pieces.withColumn("_before", F.col("_upto") - F.col("_n")).filter(reduce(lambda x, y: x | y, [inside(k, F.col("_before"), F.col("_upto")) for k in (*low, *high)]))
    wanted = wanted.select(F.col("_p").alias("_q"), *[F.col(b).alias(n) for b, n in zip(by, names)], "_before", "_all")
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names)], F.col("_p") == F.col("_q"))
    d = dealt.join(wanted, same)
    d = d.withColumn("_end", F.col("_before") + F.sum("_w").over(_upto(_own(by)))).withColumn("_start", F.col("_end") - F.col("_w"))
    v = F.col("_value").cast("double")
    found = [F.max(F.when(inside(k, F.col("_start"), F.col("_end")), v)).alias(f"_{e}{i}") for e, ks in (("l", low), ("h", high)) for i, k in enumerate(ks)]
    got = d.groupBy(*by).agg(*found, F.max("_all").alias("_all"))
    at = [F.lit(s) * (F.col("_all") - 1) for s in shares.values()]
    out = [(F.col(f"_l{i}") + F.when(F.col(f"_h{i}") == F.col(f"_l{i}"), 0.0).otherwise((F.col(f"_h{i}") - F.col(f"_l{i}")) * (a - F.floor(a)))).alias(n) for i, (n, a) in enumerate(zip(shares, at))]
    return got.select(*by, *out)


def with_medians(groups: DataFrame, df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Adds the median of ``value`` in ``df`` to one row a group."""
    m = quantiles(df, by, value, {name: 0.5}).select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], name)
    if not by:
        return groups.join(F.broadcast(m), F.lit(True), "left")  # one row
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])
    return groups.join(m, same, "left").drop(*[f"_by{i}" for i in range(len(by))])


def chunked_lists(df: DataFrame, by: list[str], order: list[Column], item: Column, size: int = 10_000, name: str = "items") -> DataFrame:
    """The ordered items of each group in lists of ``size``: (by, part from 1, items). No task holds a group."""
    d = numbered(deal(df.withColumn("_item", item), by, order), by, "_at")
    each = d.withColumn("part", (F.floor((F.col("_at") - 1) / size) + 1).cast("int")).groupBy(*by, "part").agg(F.sort_array(F.collect_list(F.struct("_at", "_item"))).alias("_l"))
    return each.select(*by, "part", F.transform("_l", lambda x: x["_item"]).alias(name))
