"""Row-wise operators: filters, labels, scaling (survey 2.3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluria import params
from telluria.functions import scalar
from telluria.operators.windows import detect_gaps
from telluria.schema import AXES, KEYS
from telluria.session import attach, profile


def with_magnitude(df: DataFrame, axes: Sequence[str] = AXES, out: str = "magnitude") -> DataFrame:
    return df.withColumn(out, scalar.magnitude(*axes))


def assemble_features(df: DataFrame, cols: Sequence[str] = AXES, scale: float = 1.0,
                      out: str = "features") -> DataFrame:
    """Vector of the axes; time is left out on purpose."""
    if scale == 1.0:
        return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)
    scaled = [f"_s_{c}" for c in cols]
    wide = df.withColumns({s: F.col(c) * F.lit(scale) for s, c in zip(scaled, cols)})
    return VectorAssembler(inputCols=scaled, outputCol=out).transform(wide).drop(*scaled)


def filter_outliers(df: DataFrame, max_magnitude: float = 5500.0) -> DataFrame:
    return df.where(F.col("magnitude") < max_magnitude)


def validate_range(df: DataFrame, limit: float = params.SENSOR_RANGE,
                   axes: Sequence[str] = AXES) -> DataFrame:
    reason = scalar.range_reason(dict(zip("xyz", axes)), limit)
    return df.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def label_mission_phase(df: DataFrame, mission: params.Mission = params.Mission()) -> DataFrame:
    return df.withColumn("phase", scalar.mission_phase("mission_time_s", mission))


def with_time_labels(df: DataFrame, t: str = "mission_time_s") -> DataFrame:
    return df.withColumns({"hms": scalar.format_hms(t), "tplus": scalar.format_tplus(t),
                           "tplus_live": scalar.format_tplus_live(t)})


def with_sensor_label(df: DataFrame, labels: Mapping[int, str] = params.SENSOR_LABELS) -> DataFrame:
    return df.withColumn("sensor_label", scalar.sensor_label("sensor_id", labels))


def rebase_mission_time(df: DataFrame, ts: str = "timestamp_unix",
                        by: Sequence[str] = ("flight_id",),
                        tie: str = "reading_number") -> DataFrame:
    """Mission time from the absolute clock, anchored at the earliest row."""
    first = df.groupBy(*by).agg(
        F.min(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"),
                       F.col("mission_time_s").alias("mt"))).alias("_a"))
    rows = attach(df, first, by, groups=profile(df, by).groups)
    return rows.withColumn("mission_time_s",
                           F.col("_a.mt") + (F.col(ts) - F.col("_a.ts"))).drop("_a")


def standardize(df: DataFrame, cols: Sequence[str] = AXES, by: Sequence[str] = ("flight_id",)) -> DataFrame:
    """(x - mean) / population std as ``<col>_std``; a constant column gives 0."""
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"_d_{c}") for c in cols])
    rows = attach(df, stats, by, groups=profile(df, by).groups)
    return rows.withColumns({
        f"{c}_std": (F.col(c) - F.col(f"_m_{c}"))
        / F.when(F.col(f"_d_{c}") > 0, F.col(f"_d_{c}")).otherwise(1.0) for c in cols
    }).drop(*[f"_{k}_{c}" for k in "md" for c in cols])


def minmax_time(df: DataFrame, by: Sequence[str] = KEYS, t: str = "mission_time_s") -> DataFrame:
    stats = df.groupBy(*by).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    rows = attach(df, stats, by, groups=profile(df, by).groups)
    return rows.withColumn("time_scaled", (F.col(t) - F.col("_lo"))
                           / (F.col("_hi") - F.col("_lo") + F.lit(1e-8))).drop("_lo", "_hi")


def flight_bounds(df: DataFrame, by: Sequence[str] = ("flight_id",), trim: float = 0.95,
                  t: str = "mission_time_s") -> DataFrame:
    """Start, end and artifact cutoff of each flight."""
    ends = df.groupBy(*by).agg(F.min(t).alias("_lo"), F.max(t).alias("t_end"))
    start = F.greatest(F.lit(0.0), F.col("_lo").cast("double"))
    length = F.col("t_end") - F.col("t_start")
    return (ends.withColumn("t_start", start)
            .withColumn("t_cutoff", F.when(length > 60, F.col("t_start") + length * trim)
                        .otherwise(F.col("t_end")).cast("double")).drop("_lo"))


def flight_window(df: DataFrame, by: Sequence[str] = ("flight_id",), trim: float = 0.95,
                  t: str = "mission_time_s", from_start: bool = True) -> DataFrame:
    """Rows between the start of flight and the artifact cutoff."""
    rows = attach(df, flight_bounds(df, by, trim, t), by, groups=profile(df, by).groups)
    keep = F.col(t) <= F.col("t_cutoff")
    if from_start:
        keep = keep & (F.col(t) >= F.col("t_start"))
    return rows.where(keep).drop("t_start", "t_end", "t_cutoff")


def flight_window_counts(df: DataFrame, by: Sequence[str] = ("flight_id",), trim: float = 0.95,
                         t: str = "mission_time_s") -> DataFrame:
    rows = attach(df, flight_bounds(df, by, trim, t), by, groups=profile(df, by).groups)
    keep = F.col(t).between(F.col("t_start"), F.col("t_cutoff"))
    return rows.groupBy(*by, "t_start", "t_end", "t_cutoff").agg(
        F.count_if(keep).alias("n_kept"), F.count_if(~keep).alias("n_removed"))


def after_last_gap(df: DataFrame, threshold: float = 5.0, pad: float = 5.0,
                   by: Sequence[str] = ("flight_id",), t: str = "mission_time_s") -> DataFrame:
    """Rows later than ``pad`` seconds before the end of the last gap."""
    last = detect_gaps(df, threshold, by, t).groupBy(*by).agg(F.max("gap_end").alias("_e"))
    rows = attach(df, last, by, groups=profile(df, by).groups)
    start = F.coalesce(F.greatest(F.lit(0.0), F.col("_e") - F.lit(pad)), F.lit(0.0))
    return rows.where(F.col(t) > start).drop("_e")


def clean_temperature(df: DataFrame, channels: Sequence[str] = ("tc0_C", "tc1_C"),
                      by: Sequence[str] = ("path",), t: str = "time_mission",
                      trim: float = 0.95) -> DataFrame:
    """NULL the readings after the cutoff and the near-zero reboot defaults,
    with one flag per channel that tells which rule removed the value."""
    rows = attach(df, flight_bounds(df, by, trim, t), by, groups=profile(df, by).groups)
    for c in channels:
        why = (F.when(F.col(t) > F.col("t_cutoff"), F.lit("shutdown"))
               .when(F.abs(F.col(c)) < 0.5, F.lit("zero")))
        rows = rows.withColumn(f"{c}_removed", why).withColumn(
            c, F.when(F.col(f"{c}_removed").isNull(), F.col(c)))
    return rows.drop("t_start", "t_end", "t_cutoff")


def plausible_temperature(df: DataFrame, channels: Sequence[str] = ("tc0_C", "tc1_C"),
                          low: float = 1.0, high: float = 100.0) -> DataFrame:
    """Report variant: keep values strictly between ``low`` and ``high``."""
    return df.withColumns({
        c: F.when((F.col(c) > low) & (F.col(c) < high), F.col(c)) for c in channels})


def with_skip_key(df: DataFrame, text: str = "event") -> DataFrame:
    return df.withColumn("skip_key", scalar.skip_key(text))


def filter_events(df: DataFrame, text: str = "event") -> DataFrame:
    return df.where(scalar.skip_key(text).isNull())


def categorize_events(df: DataFrame, text: str = "event") -> DataFrame:
    return df.withColumn("category", scalar.event_category(text))


def experiment_cutoff(df: DataFrame, t_off: float = 336.0, t: str = "mission_time_s") -> DataFrame:
    return df.where(F.col(t) <= t_off)
