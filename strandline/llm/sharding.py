"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Largest population for numpy's sampler.
_NUMPY_LIMIT = 10**9


def hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; exact at any size.

    Below 10^9 numpy draws; above, inversion walks out from the mode (about one standard
    deviation of steps).
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    p = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    u, up, down, pu, pd = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Row b says how many rows of input group b go to each shard.

    Row sums are ``counts``; column sums differ by one at most. Each row is a multivariate
    hypergeometric draw from the room that is left, so the whole matrix has the law of a
    uniform permutation.
    """
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(counts)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    random.Random(seed).shuffle(sizes)
    room, out = sizes, []
    for n in counts:
        row, left, rest = [], n, sum(room)
        for r in room:
            rest -= r
            k = hypergeometric(rng, r, rest, left)
            row.append(k)
            left -= k
        room = [r - k for r, k in zip(room, row, strict=True)]
        out.append(row)
    return out


def shuffle_into_shards(df: DataFrame, n_shards: int = 24, seed: int = 20, max_groups: int = 16384, rows_per_cell: int = 250_000) -> DataFrame:
    """All rows of ``df`` in a uniformly random order, dealt into ``n_shards`` exact shards.

    Adds shard (int) and slot (long, gapless from 0 in each shard); input columns of these
    names are replaced. Shard sizes differ by one row at most. Rows are kept one for one:
    nulls, ties and repeated rows get slots of their own; an empty table gives an empty result.

    Random keys are drawn once and written, so that lost executors reread the same keys. Each
    input partition (folded into ``max_groups`` groups) orders its rows by the first key and
    cuts them by its row of the matrix; each shard is ordered by the second key, range by range.
    The matrix (at most max_groups x n_shards numbers) and the range counts are all that the
    driver sees, and both are bounded.
    """
    rest = [c for c in df.columns if c not in ("shard", "slot")]
    keyed = staged(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.monotonically_increasing_id().alias("_i"),
            F.pmod(F.spark_partition_id(), F.lit(max_groups)).alias("_b"), F.rand(seed).alias("_k1"), F.rand(seed + 1).alias("_k2"),
        ),
        "shards-keyed",
    )
    spark = df.sparkSession
    counts = {r["_b"]: r["count"] for r in keyed.groupBy("_b").count().collect()}
    groups = sorted(counts)
    total = sum(counts.values())
    matrix = communication_matrix([counts[b] for b in groups], n_shards, seed)
    cut = []
    for b, row in zip(groups, matrix, strict=True):
        upto, edges = 0, []
        for k in row:
            upto += k
            edges.append(upto)
        cut.append({"_b": b, "_edges": edges})
    cuts = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(cut)), "array<struct<_b:int,_edges:array<bigint>>>")).alias("c")).select("c.*")
    n_ranges = min(4096, max(8, -(-total // (n_shards * rows_per_cell))))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_k1", "_i")) - 1
    sent = staged(
        keyed.withColumn("_rank", rank.cast("long")).join(F.broadcast(cuts), "_b")
        .select("_row", "_i", "_k2", F.expr("size(filter(_edges, e -> e <= _rank))").alias("shard"), F.floor(F.col("_k2") * n_ranges).cast("int").alias("_range")),
        "shards-sent",
    )
    cells = sorted((r["shard"], r["_range"], r["count"]) for r in sent.groupBy("shard", "_range").count().collect())
    before, starts = {}, []
    for s, r, n in cells:
        starts.append({"shard": s, "_range": r, "_start": before.get(s, 0)})
        before[s] = before.get(s, 0) + n
    offsets = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(starts)), "array<struct<shard:int,_range:int,_start:bigint>>")).alias("c")).select("c.*")
    within = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_k2", "_i")) - 1
    return sent.withColumn("_within", within.cast("long")).join(F.broadcast(offsets), ["shard", "_range"]).select("_row.*", "shard", (F.col("_start") + F.col("_within")).alias("slot"))
