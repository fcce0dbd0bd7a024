"""Windowed status, sessions and refits of running streams (survey T5-T7, T10).

Each function works on a batch frame as well, which is its twin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telluria import params
from telluria.operators.aggregates import throughput_report
from telluria.operators.models import retrain_on_window
from telluria.schema import KEYS, ORDER

WATERMARK = "10 seconds"


def _timed(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    return df.withWatermark(ts, watermark) if df.isStreaming else df


def stream_monitor(df: DataFrame, width: str = "60 seconds", slide: str = "5 seconds", ts: str = "event_ts",
                   by: Sequence[str] = ("flight_id",), watermark: str = WATERMARK) -> DataFrame:
    """Rolling status of detector rows: count, range, extremes, anomalies."""
    return _timed(df, ts, watermark).groupBy(*by, F.window(ts, width, slide).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.min("magnitude").alias("mag_min"), F.max("magnitude").alias("mag_max"),
        F.max("z").alias("z_max"), F.max("roc").alias("roc_max"), F.count_if("is_anomaly").alias("n_anomalies"),
        F.max("mission_time_s").alias("last_time")).select(
        *by, F.unix_micros("_w.start").alias("start_us"), "n", "mag_min", "mag_max", "z_max", "roc_max",
        "n_anomalies", "last_time")


def stream_throughput(df: DataFrame, seconds: int = 5, ts: str = "event_ts", flag: str | None = "is_anomaly",
                      rate_hz: float = params.SAMPLE_RATE_HZ, watermark: str = WATERMARK) -> DataFrame:
    return throughput_report(_timed(df, ts, watermark), seconds, ts, flag, rate_hz)


def stream_sessions(df: DataFrame, gap: str = "5 seconds", ts: str = "event_ts",
                    by: Sequence[str] = ("flight_id",), watermark: str = WATERMARK) -> DataFrame:
    """Boot sessions: rows of a flight without a pause of ``gap`` or longer.
    Each task merges its rows to sessions before they go to the one task of their flight."""
    df.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return _timed(df, ts, watermark).groupBy(*by, F.session_window(ts, gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("_a"), F.max(ts).alias("_b")).select(
        *by, "n", F.unix_micros("_a").alias("first_us"), F.unix_micros("_b").alias("last_us"))


Save = Callable[[dict[str, PipelineModel | None], int], None]


def stream_retrain(df: DataFrame, history: Callable[[], DataFrame], save: Save, checkpoint: str, every: int = 100,
                   rows: int = 200, by: Sequence[str] = KEYS, order: Sequence[str] = ORDER, trees: int = 200,
                   depth: int = 20, once: bool = False) -> StreamingQuery:
    """Refit from the durable ``history`` table after every ``every`` readings
    of the stream.  The count of each micro-batch is a file beside the
    checkpoint, so a restart goes on counting and a repeated batch counts once."""
    spark, counts = df.sparkSession, f"{checkpoint}-counts"

    def step(batch: DataFrame, number: int) -> None:
        batch.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{counts}/batch={number}")
        told = spark.read.option("basePath", counts).schema("n long, batch long").parquet(f"{counts}/batch=*")
        row = told.where(F.col("batch") <= number).agg(
            F.sum("n").alias("now"), F.sum(F.when(F.col("batch") < number, F.col("n"))).alias("before")).first()
        fits = row["now"] // every
        if fits > (row["before"] or 0) // every:
            save(retrain_on_window(history(), rows, by, order, fits, trees, depth), number)

    writer = df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
