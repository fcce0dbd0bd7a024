"""CSV captures in their several layouts (survey S8-S11, S14, S15)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telluria.functions.scalar import magnitude
from telluria.operators.projections import rebase_mission_time
from telluria.operators.windows import detect_sessions
from telluria.schema import RAW_ROWS
from telluria.session import attach, profile

# Alternative column names and what they stand for, in order.
COLUMN_NAMES = (
    ("X", "bx_raw"), ("Bx", "bx_raw"),
    ("Y", "by_raw"), ("By", "by_raw"),
    ("Z", "bz_raw"), ("Bz", "bz_raw"),
    ("T", "mission_time_s"), ("Time", "mission_time_s"),
    ("Sensor", "sensor_id"),
    ("Magnitude", "magnitude_measured"),
)
AXES_RAW = ("bx_raw", "by_raw", "bz_raw")


def legacy_rows(raw: DataFrame) -> DataFrame:
    """Positional captures (``_c0`` ...) to Time, Sensor, X, Y, Z, Magnitude.
    Sensor ids start at zero here; rows that do not parse are skipped."""
    # Position: field 2 names the sensor; 0, 4, 6 and 8 are time and axes.
    fields = {"Time": 0, "X": 4, "Y": 6, "Z": 8}
    label = F.trim(F.element_at(F.split("_c2", "#"), 2))
    number = lambda c: F.trim(c).try_cast("int")
    rows = raw.where(F.contains("_c2", F.lit("Magneto"))).select(
        (number(label) - 1).alias("Sensor"), *[number(F.col(f"_c{i}")).alias(n) for n, i in fields.items()])
    rows = rows.dropna()
    x, y, z = (F.col(c).cast("double") for c in "XYZ")
    return rows.select("Time", "Sensor", "X", "Y", "Z", magnitude(x, y, z).alias("Magnitude"))


def read_legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"_c{i} string" for i in range(10))
    return legacy_rows(spark.read.csv(path, header=False, schema=schema, mode="PERMISSIVE"))


def detect_format(spark: SparkSession, path: str) -> DataFrame:
    """Layout of every file, from its first line."""
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_id"), "value")
    return first_line_format(lines.groupBy("path").agg(F.min_by("value", "_id").alias("line")))


def first_line_format(first: DataFrame) -> DataFrame:
    old = F.contains("line", F.lit("|")) & F.contains("line", F.lit("Magneto"))
    return first.select("path", F.when(old, "legacy").otherwise("timeline").alias("format"))


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename known alternatives; ``Time`` gives way to ``T``.  A measured
    magnitude that is missing is computed, a missing sensor is 0."""
    if "T" in df.columns and "Time" in df.columns:
        df = df.drop("Time")
    taken = set(df.columns)
    renames: dict[str, str] = {}
    for old, new in COLUMN_NAMES:
        if old in taken and new not in taken:
            renames[old] = new
            taken.add(new)
    df = df.withColumnsRenamed(renames)
    doubles = [c for c in (*AXES_RAW, "mission_time_s", "magnitude_measured") if c in df.columns]
    df = df.withColumns({c: F.col(c).try_cast("double") for c in doubles})
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})
    norm = magnitude(*AXES_RAW)
    has = "magnitude_measured" in df.columns
    df = df.withColumn("magnitude_measured", F.coalesce(F.col("magnitude_measured"), norm) if has else norm)
    sensor = F.col("sensor_id").try_cast("int") if "sensor_id" in df.columns else F.lit(0)
    return df.withColumn("sensor_id", sensor)


def read_flight_csv(spark: SparkSession, path: str) -> DataFrame:
    """One capture layout per call: headers are read, values stay text until
    they are cast, so no pass over the data is spent on inference."""
    return canonical_columns(spark.read.csv(path, header=True, inferSchema=False))


def relative_raw_readings(df: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """Raw rows to readings; time runs from the first row of the file, that is
    the row with the smallest ``_position``."""
    first = df.groupBy(*by).agg(F.min_by("timestamp_unix", "_position").alias("_t0"))
    rows = attach(df, first, by, groups=profile(df, by).groups)
    return rows.select(
        *by, F.coalesce("sensor_id", F.lit(0)).alias("sensor_id"),
        (F.col("timestamp_unix") - F.col("_t0")).alias("mission_time_s"),
        *AXES_RAW, magnitude(*AXES_RAW).alias("magnitude"))


def read_raw_readings(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=RAW_ROWS, enforceSchema=False)
    rows = rows.withColumns({
        "path": F.col("_metadata.file_path"),
        "_position": F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())})
    return relative_raw_readings(rows)


def merge_sessions(df: DataFrame, source: str = "path", by: Sequence[str] = ("flight_id",),
                   threshold: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Result rows of several boots as one flight: boots numbered by file name,
    mission time recomputed from the absolute clock.  Returns rows and sessions."""
    boots = df.select(*by, source).distinct()
    names = Window.partitionBy(*by).orderBy(source)
    ranks = boots.withColumn("boot_id", F.row_number().over(names) - 1)
    rows = attach(df, ranks, [*by, source], groups=profile(boots, [*by, source]).groups)
    rows = rebase_mission_time(rows, by=by)
    return rows, detect_sessions(rows, threshold, by)


def union_datasets(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Named datasets as one frame; columns that one lacks are NULL."""
    out = None
    for name, df in datasets.items():
        tagged = df.withColumn("dataset", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no datasets")
    return out
