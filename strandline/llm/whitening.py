"""Whitening of embeddings by a tiled covariance.

Dimension pairs are parted into tiles. Each row-block of centred vectors is cut into column blocks,
which are shuffled by row-block; there the blocks of each tile's two dimension ranges are
multiplied, products are added up per tile in the task and then over all tasks, and the driver
assembles the matrix (dimensions squared numbers, whatever the number of rows) and decomposes it.

Each entry c becomes x = floor(64 c) + 1000000, a long. Rows take no part if the vector is null or
empty, holds null, NaN or infinite entries or one whose 64 c has no long (2^62 and beyond), or has
another length than most vectors (of two equally frequent lengths the longer counts). Repeated rows
and null ids are rows like others. Where a component has no variance to double precision (fewer
rows than dimensions, constant ones), ``whitened`` is null and the component stays out of
``identity_error``; ``explained`` is null where there is no variance at all. ``deviation`` is null
where it exceeds a long. A table without rows that take part gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Matrix = Callable[[np.ndarray], np.ndarray]
ROW_BLOCK = 1 << 20  # numbers of a row-block
_LONG = (1 << 63) - 1


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector takes part, whatever its length."""
    there = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * 64 < float(1 << 62), F.lit(False)))
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & there)


def _longs(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """x of a column of lists of ``d`` numbers, rows by dimensions."""
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(values * 64).astype(np.int64) + 1_000_000


def dimension_sums(df: DataFrame, vector: str, d: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of x in each dimension: one row a task and dimension is shuffled."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _longs(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    parts = df.select(vector).mapInArrow(add_up, "dim int, n long, high long, low long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
    rows = sorted(parts.groupBy("dim").agg(F.sum("n").alias("n"), exact("high"), exact("low")).collect())
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def tiled_second_moments(df: DataFrame, vector: str, d: int, matrix: Matrix, width: int, tile: int) -> np.ndarray:
    """Sum over all rows of the outer product of matrix(x), ``width`` centred numbers a row, assembled from tiles of ``tile`` by ``tile`` dimensions."""
    n_blocks = -(-width // tile)
    rows_at_once = max(64, ROW_BLOCK // width)

    def column_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for s in range(0, batch.num_rows, rows_at_once):
                m = matrix(_longs(batch.column(0).slice(s, rows_at_once), d))
                cut = [np.ascontiguousarray(m[:, i * tile : (i + 1) * tile]).tobytes() for i in range(n_blocks)]
                yield pa.RecordBatch.from_arrays([pa.array([row_block] * n_blocks, pa.int64()), pa.array(range(n_blocks), pa.int32()), pa.array([len(m)] * n_blocks, pa.int32()), pa.array(cut, pa.binary())], ["row_block", "block", "n", "data"])
                row_block += 1

    def multiply(group: pa.Table) -> pa.Table:
        """All tiles of one row-block."""
        at = {b: np.frombuffer(x).reshape(n, -1) for b, n, x in zip(*(group.column(c).to_pylist() for c in ("block", "n", "data")))}
        pairs = [(i, j) for i in range(n_blocks) for j in range(i, n_blocks)]
        return pa.table([pa.array([i for i, _ in pairs], pa.int32()), pa.array([j for _, j in pairs], pa.int32()), pa.array([(at[i].T @ at[j]).tobytes() for i, j in pairs], pa.binary())], ["i", "j", "data"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One product a tile and task."""
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, x in zip(*(c.to_pylist() for c in batch.columns)):
                total[i, j] = total.get((i, j), 0) + np.frombuffer(x)
        for (i, j), x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["i", "j", "data"])

    def add_tile(group: pa.Table) -> pa.Table:
        return pa.table([group.column("i")[:1], group.column("j")[:1], pa.array([sum(np.frombuffer(x) for x in sorted(group.column("data").to_pylist())).tobytes()], pa.binary())], ["i", "j", "data"])

    blocks = df.select(vector).mapInArrow(column_blocks, "row_block long, block int, n int, data binary")
    product = "i int, j int, data binary"
    tiles = blocks.groupBy("row_block").applyInArrow(multiply, product).mapInArrow(add_up, product).groupBy("i", "j").applyInArrow(add_tile, product)
    out = np.zeros((width, width))
    for i, j, data in tiles.collect():  # the matrix: its size depends on the dimensions alone
        part = np.frombuffer(data).reshape(min(tile, width - i * tile), -1)
        out[i * tile : i * tile + part.shape[0], j * tile : j * tile + part.shape[1]] = part
        out[j * tile : j * tile + part.shape[1], i * tile : i * tile + part.shape[0]] = part.T
    return out


def _deviations(y: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Exact sums over dimensions of (n y - rest)^2; None beyond a long."""
    rough = ((y.astype(float) * n - rest.astype(float)) ** 2).sum(1)
    out: list[int | None] = [None] * len(y)
    small = rough < 2.0**61
    if small.any():
        for k, v in zip(np.flatnonzero(small), (((y[small] * n - rest) ** 2).sum(1)).tolist()):
            out[k] = v
    for k in np.flatnonzero(~small & (rough < 2.0**64)):
        v = sum((n * a - b) ** 2 for a, b in zip(y[k].tolist(), rest.tolist()))
        out[k] = v if v <= _LONG else None
    return out


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32, tile: int | None = None) -> DataFrame:
    """One row for each vector that takes part and component up to ``most``: key, component, n, deviation, whitened, explained, identity_error.

    Eigenvectors have their largest entry (the first of equals) positive. ``tile`` dimensions a side
    is 16 or more, so that 32 column blocks at most are kept of a row-block.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    df = usable(df.select(key, vector), vector)
    lengths = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return df.sparkSession.createDataFrame([], schema)
    d = lengths["d"]
    df = df.filter(F.size(vector) == d)
    n, sums = dimension_sums(df, vector, d)
    whole = np.array([s // n for s in sums], np.int64)  # x - S/n is exactly x - whole - rest/n
    rest = np.array([s % n for s in sums], np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - rest / n

    v = tiled_second_moments(df, vector, d, centred, d, tile or max(16, -(-d // 32))) / n
    e, u = np.linalg.eigh(v)
    k = min(most, d)
    e, u = e[::-1], u[:, ::-1]
    trace = float(np.trace(v))
    u = u * np.where(u[np.abs(u).argmax(0), range(d)] < 0, -1.0, 1.0)
    spread = int((e[:k] > max(d, 2) * np.finfo(float).eps * max(e[0], 0)).sum())  # components with variance come first
    project = u[:, :spread] / np.sqrt(e[:spread])
    explained = [float(x) / trace if trace > 0 else None for x in e[:k]]
    error = 0.0
    if spread:
        second = tiled_second_moments(df, vector, d, lambda x: centred(x) @ project, spread, 16) / n
        error = float(np.abs(second - np.eye(spread)).max())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                x = _longs(part.column(1), d)
                m = len(x)
                white = np.full((m, k), np.nan)
                white[:, :spread] = centred(x) @ project
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                        pa.array(_deviations(x - whole, n, rest), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(white.ravel(), mask=np.isnan(white.ravel())),
                        pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, error)),
                    ],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return df.mapInArrow(rows, schema)
