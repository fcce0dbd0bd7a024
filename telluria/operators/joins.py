"""Joins with small labelled intervals, scalars and sensors (survey 2.4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telluria import params
from telluria.functions.scalar import in_phase
from telluria.schema import KEYS
from telluria.session import attach, profile


def label_mission_events(df: DataFrame, mission: params.Mission = params.Mission(),
                         window: float = 5.0, z: str = "z", t: str = "mission_time_s",
                         extreme: float = 5.0) -> DataFrame:
    """Name what happened around each row.  The timeline holds at most five
    rows, so the nearest-event test is a CASE over them: the range join with a
    table of constants, without a join and without copies of the rows."""
    out: Column = F.when(F.coalesce(F.col(z), F.lit(0.0)) > extreme, "EXTREME_OUTLIER").otherwise("UNKNOWN")
    events = [(mission.timeline[key], label)
              for key, label in params.EVENT_LABELS if key in mission.timeline]
    events.append((0.0, params.EVENT_LABELS[0][1]))
    for at, label in reversed(events):
        out = F.when(F.abs(F.col(t) - F.lit(at)) < window, label).otherwise(out)
    return df.withColumn("event_label", out)


def label_phases(df: DataFrame, phases: Sequence[params.Phase] = params.PHASES,
                 t: str = "mission_time_s") -> DataFrame:
    """One row per reading and phase it lies in (phases overlap); rows outside
    every phase are dropped.  The phases are constants, so this is an explode."""
    hits = F.array_compact(F.array(*[F.when(in_phase(t, p), F.lit(p.name)) for p in phases]))
    return df.withColumn("phase", F.explode(hits))


def attach_scalars(df: DataFrame, aggregates: Sequence[Column], by: Sequence[str] = KEYS) -> DataFrame:
    """Add per-group aggregates (one row per group) to the rows."""
    return attach(df, df.groupBy(*by).agg(*aggregates), by, groups=profile(df, by).groups)


def overlay_sensors(df: DataFrame, sensors: Sequence[int], step: float = 1.0,
                    value: str = "magnitude", by: Sequence[str] = ("flight_id",),
                    t: str = "mission_time_s") -> DataFrame:
    """Mean value of every sensor side by side per time step."""
    slots = df.withColumn("time_slot", F.floor(F.col(t) / step) * F.lit(step))
    wide = slots.groupBy(*by, "time_slot").agg(*[
        F.avg(F.when(F.col("sensor_id") == s, F.col(value))).alias(f"sensor_{s}") for s in sensors])
    return wide


def sensor_spread(overlay: DataFrame, sensors: Sequence[int]) -> DataFrame:
    """Range over the sensors present at each time step."""
    cols = [F.col(f"sensor_{s}") for s in sensors]
    return overlay.withColumn("spread", F.greatest(*cols) - F.least(*cols))
