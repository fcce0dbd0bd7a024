"""The ``readings`` view over the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telluria.functions.scalar import magnitude

# Sensor number of each event type, and the instant that counts as launch.
SENSOR_OF_TYPE = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
LAUNCH_MICROS = 1_705_363_200_000_000  # 2024-01-16 00:00:00 UTC


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_readings(events: DataFrame) -> DataFrame:
    """``events`` rows as readings; works on batch and streaming frames."""
    sensor = F.lit(None).cast("int")
    for kind, number in SENSOR_OF_TYPE.items():
        sensor = F.when(F.col("event_type") == kind, F.lit(number)).otherwise(sensor)
    ts = F.col("ts").cast("timestamp")
    rows = events.select(
        F.lit("f0").alias("flight_id"),
        sensor.alias("sensor_id"),
        F.col("event_id").alias("reading_number"),
        ts.alias("event_ts"),
        ((F.unix_micros(ts) - F.lit(LAUNCH_MICROS)) / F.lit(1e6)).alias("mission_time_s"),
        F.col("value").alias("bx"),
        F.col("user_id").cast("double").alias("by"),
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("bz"),
    )
    return rows.withColumn("magnitude", magnitude("bx", "by", "bz"))


def readings(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return as_readings(table(spark, folder, "events"))
