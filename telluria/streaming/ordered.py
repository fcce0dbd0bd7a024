"""State per group over ordered rows (survey T2, T4).

A processor sees the rows of its group in order, in blocks of bounded size, and
keeps a ring of the last values in list state.  Rows of a micro-batch come in any
order: up to ``HELD_ROWS`` of a group are sorted in memory; of a group with more,
sorted runs are put into map state block by block and merged from there, so that
memory stays fixed however many rows of one group a batch brings.  Batches follow
arrival.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HELD_ROWS = 65_536
RUN_BLOCK = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """List and map state need the RocksDB store; a provider that is set stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key, "HDFSBacked"):
        spark.conf.set(key, ROCKSDB)


class OrderedProcessor(StatefulProcessor):
    """Calls ``block`` for consecutive rows; ``past`` holds what the ring keeps
    of the rows before, one row each, oldest first."""

    ring: Sequence[str] = ()  # number columns that the ring keeps

    def __init__(self, order: Sequence[str], rows: int, ttl_ms: int | None = None, held_rows: int = HELD_ROWS,
                 run_block: int = RUN_BLOCK):
        self.order, self.rows, self.ttl_ms = list(order), rows, ttl_ms
        self.held_rows, self.run_block = held_rows, run_block

    def init(self, handle: StatefulProcessorHandle) -> None:
        point = T.StructType([T.StructField(c, T.DoubleType()) for c in self.ring])
        numbers = T.StructType([T.StructField("run", T.LongType()), T.StructField("block", T.LongType())])
        self._history = handle.getListState("history", point, self.ttl_ms)
        self._counts = handle.getValueState("counts", T.StructType([
            T.StructField("seen", T.LongType()), T.StructField("flagged", T.LongType())]), self.ttl_ms)
        self._runs = handle.getMapState("runs", numbers, T.StructType([T.StructField("rows", T.BinaryType())]))

    def close(self) -> None:
        pass

    def block(self, key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self._history.get()) if self._history.exists() else []
        self.past = np.array(kept, float).reshape(-1, len(self.ring))
        self.seen, self.flagged = self._counts.get() if self._counts.exists() else (0, 0)
        for pdf in self._ordered(rows):
            fresh = pdf[list(self.ring)].to_numpy(float)
            out = self.block(key, pdf)
            self.past = np.concatenate([self.past, fresh])[-self.rows:]
            self.seen += len(pdf)
            yield out
        self._history.put([tuple(p) for p in self.past.tolist()])
        self._counts.update((int(self.seen), int(self.flagged)))

    def _sorted(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts, ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)

    def _ordered(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, blocks = [], 0, []
        for pdf in rows:
            if not len(pdf):
                continue
            held.append(pdf)
            n += len(pdf)
            if n >= self.held_rows:
                blocks.append(self._store(len(blocks), self._sorted(held)))
                held, n = [], 0
        if not blocks:
            if held:
                yield self._sorted(held)
            return
        if held:
            blocks.append(self._store(len(blocks), self._sorted(held)))
        yield from self._merged(blocks)

    def _store(self, run: int, pdf: pd.DataFrame) -> int:
        """Put a sorted run into map state; the number of its blocks."""
        starts = range(0, len(pdf), self.run_block)
        for no, a in enumerate(starts):
            self._runs.updateValue((run, no), (pickle.dumps(pdf.iloc[a:a + self.run_block]),))
        return len(starts)

    def _merged(self, blocks: list[int]) -> Iterator[pd.DataFrame]:
        """Sorted blocks of all runs; each run has one block in memory."""
        following = [0] * len(blocks)
        open_rows: list[pd.DataFrame | None] = [None] * len(blocks)

        def last(pdf: pd.DataFrame) -> tuple:
            return tuple(pdf[c].iloc[-1] for c in self.order)

        while True:
            for run, count in enumerate(blocks):
                if open_rows[run] is None and following[run] < count:
                    at = (run, following[run])
                    open_rows[run] = pickle.loads(bytes(self._runs.getValue(at)[0]))
                    self._runs.removeKey(at)
                    following[run] += 1
            live = [run for run, pdf in enumerate(open_rows) if pdf is not None]
            if not live:
                return
            # Rows up to the first end of a block cannot be preceded by unread ones.
            more = [last(open_rows[run]) for run in live if following[run] < blocks[run]]
            bound = min(more) if more else None
            ready = []
            for run in live:
                pdf = open_rows[run]
                cut = len(pdf) if bound is None else _upto(pdf, self.order, bound)
                ready.append(pdf.iloc[:cut])
                open_rows[run] = pdf.iloc[cut:] if cut < len(pdf) else None
            yield self._sorted(ready)


def _upto(pdf: pd.DataFrame, order: Sequence[str], bound: tuple) -> int:
    """Rows of a sorted frame that are not beyond the bound."""
    beyond = np.zeros(len(pdf), bool)
    same = np.ones(len(pdf), bool)
    for c, b in zip(order, bound):
        v = pdf[c].to_numpy()
        beyond |= same & (v > b)
        same &= v == b
    return len(pdf) if not beyond.any() else int(beyond.argmax())


def keep_state(df: DataFrame, by: Sequence[str], processor: StatefulProcessor, schema: T.StructType,
               ttl_ms: int | None, initial: DataFrame | None = None) -> DataFrame:
    use_rocksdb(df.sparkSession)
    return df.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
        initialState=initial.groupBy(*by) if initial is not None else None)
