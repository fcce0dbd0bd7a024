"""What the query catalogue shares: views, SQL fragments, rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telluria.sources.tables import readings, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Gap thresholds for the test tables, whose rows are minutes apart.
GAP_SENSOR = 7200.0
GAP_POOLED = 1200.0
ROC_LIMIT = 50.0


def query(name: str, sql: str | None = None):
    """Register a query and, when it can be put in SQL, its twin."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 4, *columns: str) -> DataFrame:
    """Round the named columns, or every double one."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def r(spark: SparkSession, folder: str) -> DataFrame:
    return readings(spark, folder)


def scored(df: DataFrame) -> DataFrame:
    """Readings with two stand-in predictions and a sigma, exact in SQL too."""
    return df.withColumns({
        "pred_a": F.col("magnitude") * 0.9 + F.col("bz") * 0.1,
        "pred_b": F.col("magnitude") * 0.8 + F.col("bx") * 0.25,
        "sigma": F.col("bx") * 0.02 + 1.0})


__all__ = ["F", "GAP_POOLED", "GAP_SENSOR", "QUERIES", "ROC_LIMIT", "SQL", "query", "r",
           "rounded", "scored", "table"]

R = """readings AS (
  SELECT 'f0' AS flight_id,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
      WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS sensor_id,
    event_id AS reading_number, ts AS event_ts,
    (epoch_us(ts) - 1705363200000000) / 1e6 AS mission_time_s,
    value AS bx, user_id::DOUBLE AS b_y, regexp_extract(props, '(\\d+)', 1)::DOUBLE AS bz,
    sqrt(value * value + user_id::DOUBLE * user_id::DOUBLE
      + regexp_extract(props, '(\\d+)', 1)::DOUBLE * regexp_extract(props, '(\\d+)', 1)::DOUBLE) AS magnitude
  FROM events)"""
# Windows in the readings order, per sensor and pooled.
W = "PARTITION BY flight_id, sensor_id ORDER BY mission_time_s, reading_number"
WP = "PARTITION BY flight_id ORDER BY mission_time_s, reading_number"
# Output of the flight detector.
DET = f"""h AS (
  SELECT *, list(magnitude) OVER ({W} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS hist,
    coalesce(abs(magnitude - lag(magnitude) OVER ({W})), 0) AS roc FROM readings),
hm AS (SELECT *, list_median(hist) AS med FROM h),
hd AS (SELECT *, CASE WHEN len(hist) >= 20 THEN list_median(list_transform(hist, lambda v: abs(v - med))) END AS mad FROM hm),
hz AS (SELECT *, CASE WHEN mad > 1e-9 THEN 0.6745 * abs(magnitude - med) / mad ELSE 0.0 END AS z FROM hd),
hv AS (SELECT *, z > 3.5 AS is_z, roc > {ROC_LIMIT} AS is_roc FROM hz),
det AS (SELECT *, is_z::INT + is_roc::INT AS votes, is_z::INT + is_roc::INT >= 2 AS is_anomaly FROM hv)"""
SCORED = """scored AS (SELECT *, magnitude * 0.9 + bz * 0.1 AS pred_a,
  magnitude * 0.8 + bx * 0.25 AS pred_b, bx * 0.02 + 1.0 AS sigma FROM readings)"""


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join((R, *ctes)) + "\n" + select
