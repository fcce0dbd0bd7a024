"""Progress of running streams as a durable table (survey A23, T6).

A listener takes down every micro-batch: rows read, rates, time, rows that came
too late, and whether the batch overran its trigger.  It holds at most ``held``
rows on the driver before it appends them as Parquet.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = ("query_name string, run_id string, batch_id long, started string, input_rows long, input_hz double, "
            "processed_hz double, batch_ms long, late_rows long, is_overrun boolean")
WAIT_S = 60.0


def _finite(x: float | None) -> float | None:
    return None if x is None or not math.isfinite(x) else float(x)


class ProgressTable(StreamingQueryListener):
    """Appends a row a micro-batch to the Parquet table at ``path``.

    ``late_rows`` is what stateful operators dropped behind the watermark; an
    aggregation counts groups of its partial sums there, other operators rows.
    They drop by the watermark as it stood one batch earlier.
    ``is_overrun`` is NULL unless ``trigger_ms`` is given.
    """

    def __init__(self, spark: SparkSession, path: str, trigger_ms: int | None = None, held: int = 20):
        self.spark, self.path, self.trigger_ms, self.held = spark, path, trigger_ms, held
        self.rows: list[tuple] = []
        self.lock = threading.Lock()
        self.started: set[str] = set()
        self.ended: set[str] = set()
        self.change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self.change:
            self.started.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = p.durationMs.get("triggerExecution")
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        overrun = None if self.trigger_ms is None or took is None else took > self.trigger_ms
        with self.lock:
            self.rows.append((p.name, str(p.runId), p.batchId, p.timestamp, p.numInputRows, _finite(p.inputRowsPerSecond),
                              _finite(p.processedRowsPerSecond), took, late, overrun))
            full = len(self.rows) >= self.held
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.change:
            self.ended.add(str(event.runId))
            self.change.notify_all()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def settle(self) -> None:
        """Wait until every stream that began under this listener has been heard to end."""
        with self.change:
            if not self.change.wait_for(lambda: self.started <= self.ended, WAIT_S):
                raise TimeoutError("a stream is still running")


@contextmanager
def recording(spark: SparkSession, path: str, trigger_ms: int | None = None, held: int = 20) -> Iterator[ProgressTable]:
    """Take down the progress of the streams that begin and end inside the block."""
    listener = ProgressTable(spark, path, trigger_ms, held)
    spark.streams.addListener(listener)
    try:
        yield listener
        listener.settle()
    finally:
        spark.streams.removeListener(listener)
        listener.flush()


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The table, one row for each batch of a run."""
    return spark.read.schema(PROGRESS).parquet(path).dropDuplicates(["run_id", "batch_id"])


def summarize_progress(table: DataFrame) -> DataFrame:
    """Per run: batches with rows, rows read and dropped, overruns, slowest batch."""
    return table.groupBy("query_name", "run_id").agg(
        F.count_if(F.col("input_rows") > 0).alias("batches"), F.sum("input_rows").alias("input_rows"),
        F.sum("late_rows").alias("late_rows"), F.count_if("is_overrun").alias("overruns"),
        F.max("batch_ms").alias("longest_ms"))
