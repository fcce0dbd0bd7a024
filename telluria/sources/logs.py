"""Interleaved text logs of several instruments (survey S1-S7).

One pass classifies every line; the five outputs are filters on that.  Records
that span lines are put together with distributed running counts along the file,
never with a window over a whole file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telluria.functions.scalar import magnitude, once
from telluria.operators.series import Series
from telluria.session import SLICE_ROWS, attach

# The line formats, tried in this order at the start of a line.
T_PREFIX = r"^T([+-]?\d+):\s*"
STAMP = r"\s*\(\s*(.+?)\s*\)"
PATTERNS = {
    "magneto": T_PREFIX + r"\|(\d+)\|:\s*Magneto\s*#(\d+)\s*X:\s*(-?\d+)\s*Y:\s*(-?\d+)\s*Z:\s*(-?\d+)" + STAMP,
    "pressure": T_PREFIX + r"Pressure:\s*([\d.]+)\s*mbar" + STAMP,
    "adc_open": T_PREFIX + r"a0:\s*([\d.]+)" + STAMP,
    "adc_next": T_PREFIX + r"a([123]):\s*([\d.]+)",
    "tc_open": T_PREFIX + r"Tc\s*0:\s*([\d.]+)\s*C\s*([\d.]+)\s*F" + STAMP,
    "tc_next": T_PREFIX + r"Tc\s*1:\s*([\d.]+)\s*C\s*([\d.]+)\s*F",
    "event": T_PREFIX + r"(.+?)" + STAMP,
}
# Text that bars a line or a description from being an event.
NOT_EVENT_LINE = "Magneto"
NOT_EVENT_TEXT = ("Pressure:", "a0:", "Tc 0:")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines with single blanks, their file and their line number.

    Line numbers are exact for files that split: lines are counted per split
    and shifted by the splits before them in the same file.  Undecodable bytes
    are dropped.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        "value", F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy("path", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = (Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "_start", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    lines = attach(raw, splits, ["path", "_start"], how="inner")
    number = F.col("_off") + F.col("_id") - F.col("_first") + 1
    return clean_lines(lines.select("path", number.alias("line_no"), F.col("value").alias("line")))


def clean_lines(lines: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace(F.regexp_replace("line", "\ufffd", ""), r"\s+", " "))
    rest = [c for c in lines.columns if c != "line"]
    return lines.select(*rest, once(text).alias("line")).where(F.col("line") != "")


def classify(lines: DataFrame) -> DataFrame:
    """Add ``line_type``, NULL for lines of no known format."""
    kind = F.lit(None).cast("string")
    line = F.col("line")
    for name, pattern in reversed(PATTERNS.items()):
        test = line.rlike(pattern)
        if name == "event":
            text = F.regexp_extract(line, pattern, 2)
            test = test & ~F.contains(line, F.lit(NOT_EVENT_LINE))
            for bar in NOT_EVENT_TEXT:
                test = test & ~F.contains(text, F.lit(bar))
        kind = F.when(test, F.lit(name)).otherwise(kind)
    return lines.select("*", once(kind).alias("line_type"))


def _part(kind: str, group: int, cast: str | None = None) -> Column:
    out = F.regexp_extract("line", PATTERNS[kind], group)
    return out.try_cast(cast) if cast else F.trim(out)


def _of(typed: DataFrame, *kinds: str) -> DataFrame:
    return typed.where(F.col("line_type").isin(*kinds))


def log_time(text: str | Column) -> Column:
    """Timestamp of a ``Wed Jun 18 16:20:22 2025`` text, NULL when it is none.
    The weekday must be a name but is not checked against the date."""
    text = F.col(text) if isinstance(text, str) else text
    shape = text.rlike(r"^(?i)(mon|tue|wed|thu|fri|sat|sun) ")
    return F.when(shape, F.try_to_timestamp(F.substring(text, 5, 40), F.lit("MMM d HH:mm:ss yyyy")))


def parse_magnetometer(typed: DataFrame) -> DataFrame:
    rows = _of(typed, "magneto").select(
        "path", "line_no", _part("magneto", 1, "int").alias("time_mission"),
        _part("magneto", 2, "long").alias("reading_number"), _part("magneto", 3, "int").alias("sensor_id"),
        _part("magneto", 4, "int").alias("x"), _part("magneto", 5, "int").alias("y"),
        _part("magneto", 6, "int").alias("z"), _part("magneto", 7).alias("timestamp_str"))
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    return rows.withColumn("event_ts", log_time("timestamp_str")).withColumn("magnitude", magnitude(x, y, z))


def parse_pressure(typed: DataFrame) -> DataFrame:
    return _of(typed, "pressure").select(
        "path", "line_no", _part("pressure", 1, "int").alias("time_mission"),
        _part("pressure", 2, "double").alias("pressure_mbar"), _part("pressure", 3).alias("timestamp_str"))


def _records(rows: DataFrame, opens: str, closes: Column, slice_rows: int) -> DataFrame:
    """Number the records of multi-line formats.  A new number starts at every
    opening line and after every closing line, so a closing line is the last of
    its number; numbers without an opening line hold stray lines."""
    s = Series.of(rows.withColumns({"_open": (F.col("line_type") == opens).cast("long"),
                                    "_close": F.coalesce(closes, F.lit(False)).cast("long")}),
                  ["path"], ["line_no"], slice_rows=slice_rows)
    s = s.running_sum({"_o": F.col("_open"), "_c": F.col("_close")})
    return s.df.withColumn("record", F.col("_o") + F.col("_c") - F.col("_close"))


def _last(value: Column, test: Column) -> Column:
    return F.max_by(value, F.when(test, F.col("line_no")))


def parse_adc(typed: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    rows = _of(typed, "adc_open", "adc_next")
    is_open = F.col("line_type") == "adc_open"
    rows = rows.withColumns({
        "_ch": F.when(is_open, F.lit(0)).otherwise(_part("adc_next", 2, "int")),
        "_v": F.when(is_open, _part("adc_open", 2, "double")).otherwise(_part("adc_next", 3, "double")),
        "_t": _part("adc_open", 1, "int"), "_s": _part("adc_open", 3)})
    rows = _records(rows, "adc_open", F.col("_ch") == 3, slice_rows)
    is_open = F.col("_open") == 1
    out = rows.groupBy("path", "record").agg(
        F.min(F.when(is_open, F.col("line_no"))).alias("line_no"),
        _last(F.col("_t"), is_open).alias("time_mission"),
        *[_last(F.col("_v"), F.col("_ch") == k).alias(f"a{k}") for k in range(4)],
        _last(F.col("_s"), is_open).alias("timestamp_str"), F.max("_close").alias("_done"))
    return out.where("line_no IS NOT NULL AND _done = 1").drop("_done", "record")


def parse_thermocouple(typed: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    rows = _of(typed, "tc_open", "tc_next")
    rows = _records(rows, "tc_open", F.col("line_type") == "tc_next", slice_rows)
    is_open, is_next = F.col("_open") == 1, F.col("_close") == 1
    out = rows.groupBy("path", "record").agg(
        F.min(F.when(is_open, F.col("line_no"))).alias("line_no"),
        _last(_part("tc_open", 1, "int"), is_open).alias("time_mission"),
        _last(_part("tc_open", 2, "double"), is_open).alias("tc0_C"),
        _last(_part("tc_open", 3, "double"), is_open).alias("tc0_F"),
        _last(_part("tc_next", 2, "double"), is_next).alias("tc1_C"),
        _last(_part("tc_next", 3, "double"), is_next).alias("tc1_F"),
        _last(_part("tc_open", 4), is_open).alias("timestamp_str"), F.max("_close").alias("_done"))
    return out.where("line_no IS NOT NULL AND _done = 1").drop("_done", "record")


def parse_events(typed: DataFrame) -> DataFrame:
    return _of(typed, "event").select(
        "path", "line_no", _part("event", 1, "int").alias("time_mission"),
        _part("event", 2).alias("event"), _part("event", 3).alias("timestamp_str"))


@dataclass(frozen=True)
class Telemetry:
    """The five record types of a log and the classified lines they come from."""

    lines: DataFrame
    magneto: DataFrame
    pressure: DataFrame
    adc: DataFrame
    thermo: DataFrame
    events: DataFrame

    def counts(self) -> DataFrame:
        """Number of records per type, zero included."""
        parts = []
        for name in ("magneto", "pressure", "adc", "thermo", "events"):
            parts.append(getattr(self, name).agg(F.count(F.lit(1)).alias("n"))
                         .select(F.lit(name).alias("record_type"), "n"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def parse_telemetry(lines: DataFrame, slice_rows: int = SLICE_ROWS, store: str | None = None) -> Telemetry:
    """All record types of a log.  With ``store`` the classified lines are
    written there once, one folder per type, and each output reads only its own
    folders; without it each output classifies the lines when it runs."""
    typed = classify(lines)
    if store is not None:
        typed.where("line_type IS NOT NULL").write.mode("overwrite").partitionBy("line_type").parquet(store)
        typed = lines.sparkSession.read.parquet(store)
    return Telemetry(typed, parse_magnetometer(typed), parse_pressure(typed),
                     parse_adc(typed, slice_rows), parse_thermocouple(typed, slice_rows), parse_events(typed))


def as_readings(magneto: DataFrame) -> DataFrame:
    """Parsed magnetometer rows as readings; the file stands for the flight."""
    return magneto.select(
        F.col("path").alias("flight_id"), "sensor_id", "reading_number", "event_ts",
        F.col("time_mission").cast("double").alias("mission_time_s"),
        F.col("x").cast("double").alias("bx"), F.col("y").cast("double").alias("by"),
        F.col("z").cast("double").alias("bz"), "magnitude")
