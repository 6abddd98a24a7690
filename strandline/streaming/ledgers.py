"""Streaming forms of the ledger operators."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import commits

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package


def upsert_stream(stream: DataFrame, root: str, keys: list[str], checkpoint: str, sequence: str | None = None, once: bool = False):
    """Keep a committed table (commits.read()) at the newest row of each key; a batch that is repeated after a failure changes nothing, and other writers may commit meanwhile. ``once``: stop when all that is there has been taken."""
    out = stream.writeStream.foreachBatch(lambda rows, n: commits.upsert(rows, root, keys, sequence, (checkpoint, n))).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per time window and key with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).count().select("w.start", "w.end", by, "count")


def failure_runs(stream: DataFrame, key: str, failed: str, order: str, most: int = 2) -> DataFrame:
    """Running count of consecutive failures per key as rows arrive; ``stopped`` once it has reached ``most``. State: two numbers a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, stopped = state.get if state.exists else (0, False)
        for batch in batches:
            rows = []
            for o, f in batch.sort_values(order)[[order, failed]].itertuples(index=False):
                rows.append((k[0], o, run + 1 if f else 0, stopped))
                run = run + 1 if f else 0
                stopped = stopped or run >= most
            state.update((run, stopped))
            yield pd.DataFrame(rows, columns=[key, order, "failures_in_a_row", "stopped"])

    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, failures_in_a_row int, stopped boolean"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "run int, stopped boolean", "append", "NoTimeout")


class Pacer(StatefulProcessor):
    """Pause after each outcome of a run; state: the pause, the calm streak and the strikes of each key."""

    def __init__(self, by: str, order: str, failed: str, low: float, base: float, high: float, backoff: float, stable: int, strikes: int):
        self.by, self.order, self.failed = by, order, failed
        self.low, self.base, self.high, self.backoff, self.stable, self.strikes = low, base, high, backoff, stable, strikes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pace", "pause double, calm int, strikes int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pause, calm, strike = self.state.get() if self.state.exists() else (self.base, 0, 0)
        out = []
        for o, f in pd.concat(list(rows)).sort_values(self.order)[[self.order, self.failed]].itertuples(index=False):
            was = pause
            if f is True or f == 1:
                calm, strike = 0, strike + 1
                pause = min(self.high, max(pause, self.high if strike >= self.strikes else self.backoff))
                event = "backoff" if pause > was else "backoff_held"
            else:
                calm, strike, event = calm + 1, 0, "stable_hold"
                if calm >= self.stable:
                    calm, pause = 0, max(self.low, pause - 1.0)
                    event = "stable_step_down" if pause < was else "stable_at_min"
            out.append((key[0], o, pause, event))
        self.state.update((float(pause), int(calm), int(strike)))
        yield pd.DataFrame(out, columns=[self.by, self.order, "pause", "event"])

    def close(self) -> None:
        pass


def paced(stream: DataFrame, by: str, order: str, failed: str, low: float = 3.0, base: float = 5.0, high: float = 15.0, backoff: float = 10.0, stable: int = 25, strikes: int = 2) -> DataFrame:
    """operators.ledgers.pacing() as rows arrive: the state of a run survives restarts, so a run is resumed where it stood.

    Rows of one batch are taken in order; the state store must be RocksDB's
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    kinds = dict(stream.dtypes)
    schema = f"{by} {kinds[by]}, {order} {kinds[order]}, pause double, event string"
    pacer = Pacer(by, order, failed, low, base, high, backoff, stable, strikes)
    return stream.groupBy(by).transformWithStateInPandas(pacer, schema, "append", "none")
