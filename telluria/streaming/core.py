"""Running streams: sources, exactly-once sinks, draining (survey 2.11)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from telluria.operators.projections import experiment_cutoff
from telluria.session import scratch_path


def stream_bronze(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, out: str,
                  fmt: str = "parquet", files_per_batch: int = 100, once: bool = False) -> StreamingQuery:
    """Raw rows to a durable table before anything is computed from them."""
    raw = (spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path))
    return append_table(raw, out, checkpoint, once)


def append_table(df: DataFrame, out: str, checkpoint: str, once: bool = False,
                 fmt: str = "parquet") -> StreamingQuery:
    """Append rows exactly once: the file sink's log and the checkpoint decide
    which files count, so a restarted batch is not seen twice."""
    writer = df.writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_sink(df: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Detector rows in the 16-column layout, one folder per flight."""
    from telluria.sinks import result_rows

    writer = (result_rows(df).writeStream.format("parquet").partitionBy("flight_id").option("path", out)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_cutoff(df: DataFrame, t_off: float = 336.0, t: str = "mission_time_s") -> DataFrame:
    """Drop rows past the end of the experiment; same filter as in batch."""
    return experiment_cutoff(df, t_off, t)


def drain(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what its source holds now and return the result.

    Append mode keeps every batch in a folder of its own, complete mode the
    last one; a repeated batch overwrites its folder.
    """
    spark = df.sparkSession
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "progress")

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{out}/part={number if mode == 'append' else 0}"
        batch.write.mode("overwrite").parquet(folder)
        if each is not None:
            each(batch, number)

    query = (df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.option("basePath", out).schema(df.schema).parquet(f"{out}/part=*").select(
        *[F.col(c) for c in df.columns])
