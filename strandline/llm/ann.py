"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_DATA = pa.schema([("d_block", pa.int64()), ("d_n", pa.int32()), ("d_ids", pa.binary()), ("d_vec", pa.binary()), ("d_bits", pa.binary()), ("d_scale", pa.binary())])
_QUERY = pa.schema([("q_block", pa.int64()), ("q_n", pa.int32()), ("q_ids", pa.binary()), ("q_vec", pa.binary())])
_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vector: Column, dim: int | None = None) -> Column:
    """Neither null, nor empty or zero, nor with null or non-finite components (and of length ``dim``)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok & (F.size(vector) == dim) if dim else ok, F.lit(False))


class Rotation:
    """Center of a bounded sample and a random orthogonal matrix; turns vectors into codes and scalars."""

    def __init__(self, center: np.ndarray, seed: int):
        self.center = center
        d = len(center)
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
        self.p = q * np.sign(np.diag(r))

    def turn(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated residuals to unit length, and their lengths."""
        r = (x - self.center) @ self.p
        n = np.sqrt((r * r).sum(1))
        return r / np.maximum(n, 1e-300)[:, None], n

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed signs (a bit a dimension) and per vector (length, inner product of the unit residual with its code)."""
        u, n = self.turn(x)
        bits = np.packbits(u > 0, axis=1)
        dot = np.abs(u).sum(1) / np.sqrt(x.shape[1])
        return bits, np.stack([n, np.maximum(dot, 1e-9)], 1)


def _cut(batch: pa.RecordBatch, block: int, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first row, ids, vectors) of every ``block`` rows, vectors in the column's own width."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8")
    x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    for lo in range(0, len(ids), block):
        yield batch.column("_i")[lo].as_py(), ids[lo : lo + block], x[lo : lo + block]


def _row(values: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)


def _data_blocks(batches, rotation: Rotation, block: int, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, ids, x in _cut(batch, block, dim):
            bits, scale = rotation.encode(x.astype("<f8"))
            yield _row((first, len(ids), ids.tobytes(), x.tobytes(), bits.tobytes(), scale.astype("<f8").tobytes()), _DATA)


def _query_blocks(batches, block: int, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, ids, x in _cut(batch, block, dim):
            yield _row((first, len(ids), ids.tobytes(), x.tobytes()), _QUERY)


_PLANES = 4  # bits of a query's coordinates


def _words(packed: np.ndarray) -> np.ndarray:
    """Rows of packed bits as rows of 64-bit words."""
    out = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _planes(u: np.ndarray) -> tuple[np.ndarray, float, float, float, float]:
    """A vector's coordinates rounded to 2^_PLANES steps: packed planes (a bit of the steps each), least coordinate, step, sum of the rounded ones, length of what rounding left out."""
    low = u.min()
    step = (u.max() - low) / ((1 << _PLANES) - 1) or 1.0
    k = np.rint((u - low) / step).astype(np.uint8)
    rounded = low + step * k
    planes = _words(np.packbits(k >> np.arange(_PLANES, dtype=np.uint8)[:, None] & 1, axis=1))
    return planes, low, step, rounded.sum(), float(np.sqrt(((u - rounded) ** 2).sum()))


def _common(words: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Sum of the steps of the coordinates at which each code has a set bit."""
    total = np.zeros(len(words), dtype=np.uint16 if words.shape[1] < 64 else np.int64)  # at most 15 times 64 a word
    for plane in planes[::-1]:
        total <<= 1
        for column, bits in zip(words.T, plane):
            total += np.bitwise_count(column & bits)
    return total


def _within(part: np.ndarray, norms: np.ndarray, at: np.ndarray, q: np.ndarray, limit: float) -> np.ndarray:
    """Those of the rows ``at`` whose squared distance may be within ``limit``, by inner products in the rows' own width less what rounding can make of them."""
    if not len(at) or limit == np.inf:
        return at
    length, longest = float(np.sqrt(q @ q)), float(np.sqrt(norms.max()))
    single = part.dtype == np.float32 and 1e-12 < length < 1e12 and 1e-12 < longest < 1e12
    dot = part.take(at, axis=0) @ q.astype(np.float32) if single else part.take(at, axis=0).astype(np.float64) @ q
    off = 4 * (len(q) + 2) * float(np.finfo(np.float32 if single else np.float64).eps) * (length + longest) ** 2
    return at[norms[at] + length**2 - 2 * dot <= limit + off]


def code_products(words: np.ndarray, ones: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, float]:
    """Inner products of every code (signs, as packed bits) with a vector, from the bits alone, and the length of what rounding left out.

    The vector's coordinates are rounded to 2^_PLANES steps; each bit of the steps is a packed
    plane, whose product with a code is a count of common bits. ``ones``: the set bits of each code.
    """
    planes, low, step, whole, off = _planes(u)
    return 2 * (low * ones + step * _common(words, planes)) - whole, off


def search(q_ids, q, ids, x, bits, scale, rotation: Rotation, k: int, bound: float, step: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and distance of the best ``k`` candidates for each query.

    The inner product of unit residuals is estimated as <code, query> / <code, vector> from packed
    bits; its error is at most bound * sqrt((1 - c^2) / c^2 / (dim - 1)), c = <code, vector>, with
    the probability that ``bound`` stands for, and what rounding the query adds. Candidates come
    ``step`` at a time. As long as a query has not found k, the k best by estimate are computed
    first; every candidate whose least possible distance is within the k-th found is tried by its
    inner product, and those that may be nearer are computed too.
    """
    d = x.shape[1]
    u, qn = rotation.turn(q)
    asked = [_planes(v) for v in u]
    best = [(np.empty(0), np.empty(0, dtype=np.int64))] * len(q)
    edge = np.full(len(q), np.inf)  # square of the k-th distance
    for lo in range(0, len(ids), step):
        own_ids, part, words = ids[lo : lo + step], x[lo : lo + step], np.asfortranarray(_words(bits[lo : lo + step]))
        n, c = scale[lo : lo + step].T
        ones, norms = np.bitwise_count(words).sum(1, dtype=np.int64), np.square(part, dtype=np.float64).sum(1)
        n2, per = n * n, 2 * n / np.sqrt(d) / c
        spread = 2 * n * bound * np.sqrt(np.maximum(1 - c * c, 0) / (c * c) / max(d - 1, 1))
        central = n <= 1e-150  # at the center: no code to go by
        by = np.where(central, 1.0, per)
        terms = np.where(central, 0.0, [n2 / by, 1 / by, spread / by, ones, np.ones(len(n))])
        for i, (planes, low, width, whole, off) in enumerate(asked):
            common, limit = _common(words, planes), edge[i]
            if limit == np.inf:
                near = n2 - qn[i] * per * (2 * (low * ones + width * common) - whole)
                near[own_ids == q_ids[i]] = np.inf
                free = int(np.isfinite(near).sum())
                if not free:
                    continue
                first = np.argpartition(near, min(k, free) - 1)[: min(k, free)]
                limit = ((part[first] - q[i]) ** 2).sum(1).max() if free > k else np.inf
            at = np.arange(len(n))
            if limit < np.inf and qn[i] > 1e-150:
                # the least distance squared, n^2 + qn^2 - qn * (per * (2 * (low * ones + width * common) - whole + bound * off) + spread), solved for common
                room, half = qn[i] ** 2 * (1 - 1e-12) - limit * (1 + 1e-12), 0.5 / width
                need = np.array([half / qn[i], half / qn[i] * room, -half, -low / width, half * (whole - bound * off)]) @ terms
                at = np.flatnonzero(common >= need - 1e-9)
            at = _within(part, norms, at, q[i], limit)
            at = at[own_ids[at] != q_ids[i]]
            far = ((part[at] - q[i]) ** 2).sum(1)
            keep = far <= limit * (1 + 1e-12)
            if not keep.any():
                continue
            dist, found = np.concatenate([best[i][0], np.sqrt(far[keep])]), np.concatenate([best[i][1], own_ids[at[keep]]])
            top = np.lexsort((found, dist))[:k]
            best[i] = dist[top], found[top]
            if len(top) == k:
                edge[i] = best[i][0][-1] ** 2 * (1 + 1e-12)
    return np.repeat(q_ids, [len(found) for _, found in best]), np.concatenate([found for _, found in best]), np.concatenate([dist for dist, _ in best])


def _read(table: pa.Table, name: str, kind, dim: int = 0) -> np.ndarray:
    """The blocks of a binary column as one array, with rows of ``dim`` if that is given."""
    flat = np.concatenate([np.frombuffer(v.as_buffer(), dtype=kind) for v in table.column(name)])
    return flat.reshape(-1, dim) if dim else flat


def _search(queries: pa.Table, data: pa.Table, rotation: Rotation, k: int, bound: float, dim: int, kind: str) -> pa.Table:
    columns = np.empty((3, 0))
    if queries.num_rows and data.num_rows:
        columns = search(
            _read(queries, "q_ids", "<i8"), _read(queries, "q_vec", kind, dim).astype("<f8"), _read(data, "d_ids", "<i8"), _read(data, "d_vec", kind, dim),
            _read(data, "d_bits", "u1", -(-dim // 8)), _read(data, "d_scale", "<f8", 2), rotation, k, bound,
        )
    return pa.table([pa.array(c).cast(t) for c, t in zip(columns, _BEST.types, strict=True)], schema=_BEST)


def _slices(rows: int, queries: int, data_slice: int, query_slice: int) -> tuple[int, int]:
    """Slices of the rows and of the queries, every two of which meet: bounded in size, and as few as keep tasks busy, as each slice is sent once for every slice of the other side."""
    return max(1, min(32, -(-rows // 4096)), -(-rows // data_slice)), max(1, -(-queries // query_slice))


def _slice(place: str, block: int, n: int) -> Column:
    """A partition's blocks in turn to ``n`` slices, from a slice of its own on."""
    turn = F.floor(F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) / block)
    return F.pmod(F.pmod(F.xxhash64(F.shiftright(place, 33)), F.lit(n)) + turn, F.lit(n)).cast("int")


def nearest(
    df: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding", bound: float = 3.0, sample: int = 16384,
    data_block: int = 2048, query_block: int = 512, data_slice: int = 1 << 17, query_slice: int = 1 << 16, seed: int = 5,
) -> DataFrame:
    """The ``k`` nearest rows of each row whose key is divisible by ``every``: query_id, rank, vec_id, score (Euclidean).

    Every usable row (see usable()) of the commonest length (the smaller, if two are as common)
    is indexed and can be found; others take no part. Null keys take no part. A query's own row
    is every row with its key; repeated keys elsewhere are candidates of their own and ties go to
    the smaller key. An empty table gives an empty result.

    The center is the mean of at most ``sample`` rows (only it depends on the sample, and only the
    width of the bounds depends on it). Rows become blocks of packed one-bit codes, scalars and
    vectors, dealt into slices of about ``data_slice`` rows; the query set, in slices of about
    ``query_slice``, meets all of them, two slices a group. Both sides are shuffled and none is
    broadcast, as the queries are sent once for every slice of rows. Each group returns ``k`` rows
    a query at most, and the rank is a window over those, cut before its exchange. Columns other
    than the two named are not read; equal vectors are candidates each.
    """
    spark = df.sparkSession
    single = isinstance(df.schema[vector].dataType.elementType, T.FloatType)  # sent in the column's own width, computed in doubles
    x = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vec")).filter(F.col("vec_id").isNotNull())
    asks = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    sizes = x.filter(usable(F.col("vec"))).groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("count"), F.count_if(asks).alias("asked")).orderBy(F.desc("count"), "d").limit(1).collect()
    dim, n_rows, n_asked = (sizes[0]["d"], sizes[0]["count"], sizes[0]["asked"]) if sizes else (1, 0, 0)
    rows = x.filter(usable(F.col("vec"), dim)).withColumn("_i", F.monotonically_increasing_id())
    share = min(1.0, 2 * sample / n_rows) if n_rows else 1.0
    some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(sample).agg(*[F.avg(F.col("vec")[i]).alias(f"c{i}") for i in range(dim)]).collect()[0]
    rotation = Rotation(np.array([some[i] or 0.0 for i in range(dim)]), seed)
    data = rows.mapInArrow(lambda b: _data_blocks(b, rotation, data_block, dim), "d_block long, d_n int, d_ids binary, d_vec binary, d_bits binary, d_scale binary")
    asked = rows.filter(asks).mapInArrow(lambda b: _query_blocks(b, query_block, dim), "q_block long, q_n int, q_ids binary, q_vec binary")
    n_data, n_query = _slices(n_rows, n_asked, data_slice, query_slice)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_q", _slice("q_block", query_block, n_query)).withColumn("_g", each(n_data))
    right = data.withColumn("_g", _slice("d_block", data_block, n_data)).withColumn("_q", each(n_query))
    left, right = (side.repartition(4 * n_data * n_query, "_g", "_q") for side in (left, right))  # few groups to a task: their work is in pairs of rows, not in bytes
    kind = "<f4" if single else "<f8"
    pairs = left.groupBy("_g", "_q").cogroup(right.groupBy("_g", "_q"))
    found = pairs.applyInArrow(lambda a, b: _search(a, b, rotation, k, bound, dim, kind), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
