"""Column sets shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("flight_id", "sensor_id")
ORDER = ("mission_time_s", "reading_number")
AXES = ("bx", "by", "bz")

READINGS = T.StructType([
    T.StructField("flight_id", T.StringType()),
    T.StructField("sensor_id", T.IntegerType()),
    T.StructField("reading_number", T.LongType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("mission_time_s", T.DoubleType()),
    T.StructField("bx", T.DoubleType()),
    T.StructField("by", T.DoubleType()),
    T.StructField("bz", T.DoubleType()),
    T.StructField("magnitude", T.DoubleType()),
])

# The 16 columns of a result row, in file order.
RESULT_COLUMNS = (
    "timestamp_unix", "mission_time_s", "sensor_id", "bx_raw", "by_raw", "bz_raw",
    "magnitude_measured", "magnitude_rf", "magnitude_nn", "cluster_id",
    "anomaly_zscore", "anomaly_is_zscore", "anomaly_is_roc", "anomaly_is_ensemble",
    "anomaly_rate_of_change", "reading_number",
)
RESULT_ROWS = T.StructType([
    T.StructField(c, T.IntegerType() if c in ("sensor_id", "cluster_id") or "_is_" in c
                  else T.LongType() if c == "reading_number" else T.DoubleType())
    for c in RESULT_COLUMNS
])
RAW_ROWS = T.StructType([
    T.StructField(c, T.IntegerType() if c == "sensor_id" else T.DoubleType())
    for c in ("timestamp_unix", "sensor_id", "bx_raw", "by_raw", "bz_raw")
])
