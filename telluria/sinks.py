"""Outputs: result rows, rendered logs, retention, fingerprints (survey 2.2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telluria.schema import RESULT_COLUMNS

# Decimals kept in result rows.
RESULT_DIGITS = {
    "timestamp_unix": 6, "mission_time_s": 4, "magnitude_measured": 2, "magnitude_rf": 2,
    "magnitude_nn": 2, "anomaly_zscore": 4, "anomaly_rate_of_change": 2,
}


def result_rows(df: DataFrame, partition: Sequence[str] = ("flight_id",)) -> DataFrame:
    """Detector output (``detect_flight`` with optional predictions) in the
    16-column layout.  Missing predictions are NULL."""
    have = set(df.columns)
    optional = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    source: dict[str, Column] = {
        "timestamp_unix": F.unix_micros("event_ts") / F.lit(1e6),
        "mission_time_s": F.col("mission_time_s"), "sensor_id": F.col("sensor_id"),
        "bx_raw": F.col("bx"), "by_raw": F.col("by"), "bz_raw": F.col("bz"),
        "magnitude_measured": F.col("magnitude"),
        "magnitude_rf": optional("magnitude_rf", "double"), "magnitude_nn": optional("magnitude_nn", "double"),
        "cluster_id": optional("cluster_id", "int"),
        "anomaly_zscore": F.col("z"), "anomaly_is_zscore": F.col("is_z").cast("int"),
        "anomaly_is_roc": F.col("is_roc").cast("int"), "anomaly_is_ensemble": F.col("is_anomaly").cast("int"),
        "anomaly_rate_of_change": F.col("roc"), "reading_number": F.col("reading_number")}
    cols = [F.round(source[c], RESULT_DIGITS[c]).alias(c) if c in RESULT_DIGITS else source[c].alias(c)
            for c in RESULT_COLUMNS]
    return df.select(*partition, *cols)


def write_readings(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   partition: Sequence[str] = ("flight_id",)) -> None:
    """Result rows, one folder per flight, so that later reads prune flights."""
    result_rows(df, partition).write.mode(mode).format(fmt).option("header", "true").partitionBy(
        *partition).save(path)


def _stamp(ts: str) -> Column:
    """asctime text; days below ten are padded with a blank."""
    return F.concat(F.date_format(ts, "EEE MMM "), F.lpad(F.date_format(ts, "d"), 2, " "),
                    F.date_format(ts, " HH:mm:ss yyyy"))


def _prefix(t: str, number: str) -> Column:
    whole = F.bround(t, 0).cast("long")
    sign = F.when(whole > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(F.lit("T"), sign, whole.cast("string"), F.lit(": |"), F.col(number).cast("string"), F.lit("|: "))


def render_magneto_lines(df: DataFrame, t: str = "mission_time_s", number: str = "reading_number") -> DataFrame:
    whole = lambda c: F.col(c).cast("long").cast("string")
    line = F.concat(_prefix(t, number), F.lit("Magneto #"), F.col("sensor_id").cast("string"),
                    F.lit(" X: "), whole("bx"), F.lit(" Y: "), whole("by"), F.lit(" Z: "), whole("bz"),
                    F.lit(" ( "), _stamp("event_ts"), F.lit(" )"))
    return df.withColumn("line", line)


def fixed(value: Column, digits: int) -> Column:
    """Text with ``digits`` (three at most) decimals, rounded half to even on the
    exact binary value as C's ``printf`` does: 0.35 lies below its decimal form
    and gives 0.3, 0.25 is a true tie and gives 0.2."""
    scale, one = 10 ** digits, 1 << 52
    x = F.abs(value.cast("double"))
    whole = F.floor(x)
    units = (x - whole) * F.lit(float(one))  # by a power of two, so nothing is lost
    low = units - F.floor(units)  # bits below 2^-52, which only values below one have
    scaled = F.floor(units) * F.lit(scale)
    digit = F.shiftright(scaled, 52)
    missing = F.lit(one >> 1) - scaled.bitwiseAND(F.lit(one - 1))  # to the middle
    odd = (digit + whole % 2 * scale) % 2 == 1
    more = low * scale
    digit = digit + ((more > missing) | ((more == missing) & odd)).cast("long")
    parts = F.concat((whole + (digit == scale).cast("long")).cast("string"), F.lit("." if digits else ""),
                     F.lpad((digit % scale).cast("string"), digits, "0"))
    large = F.concat(x.try_cast("decimal(38,0)").cast("string"), F.lit("." * bool(digits) + "0" * digits))
    text = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x < 2.0 ** 53, parts).otherwise(large)
    return F.concat(F.when(value < 0, "-").otherwise(""), text)


def render_result_lines(df: DataFrame, t: str = "mission_time_s", number: str = "reading_number") -> DataFrame:
    """Result lines; ``anomaly_no`` numbers the anomalies (see
    ``running_anomaly_number``)."""
    have = set(df.columns)
    value = lambda c, digits, none: (F.coalesce(fixed(F.col(c), digits), F.lit(none)) if c in have else F.lit(none))
    cluster = (F.coalesce(F.col("cluster_id").cast("string"), F.lit("-")) if "cluster_id" in have else F.lit("-"))
    tag = F.when(F.col("is_anomaly"), F.concat(F.lit(" ANOMALY#"), F.col("anomaly_no").cast("string"))).otherwise("")
    line = F.concat(
        _prefix(t, number), F.lit("ML"), tag, F.lit(" |B|="), fixed(F.col("magnitude"), 1),
        F.lit(" RF="), value("magnitude_rf", 1, "---"), F.lit(" NN="), value("magnitude_nn", 1, "---"),
        F.lit(" C="), cluster, F.lit(" Z="), fixed(F.col("z"), 2), F.lit(" RoC="), fixed(F.col("roc"), 1),
        F.lit(" ( "), _stamp("event_ts"), F.lit(" )"))
    return df.withColumn("line", line)


def write_log(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Text files whose names and lines follow ``order``: a range partitioning
    with sorted parts, so no task holds the whole log."""
    df.orderBy(*order).select("line").write.mode("overwrite").text(path)


def keep_latest(df: DataFrame, by: Sequence[str], order: str, n: int = 10,
                tie: str | None = None) -> DataFrame:
    """Newest ``n`` rows per group.  Spark cuts each map task's share to ``n``
    rows per group before the shuffle, so a hot group stays small."""
    newest = Window.partitionBy(*by).orderBy(F.desc(order), *([F.col(tie)] if tie else []))
    return df.withColumn("age_rank", F.row_number().over(newest)).where(F.col("age_rank") <= n)


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Identity of a dataset: one row that any order or partitioning of the
    same rows gives again, and that every row takes part in."""
    h = F.xxhash64(*columns)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("hash_xor"),
        F.sum(F.pmod(h, F.lit(1 << 31))).alias("hash_sum"),
        *[F.min(c).alias(f"min_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns])
