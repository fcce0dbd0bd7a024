"""Mission constants and thresholds, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Detector thresholds.
Z_THRESHOLD = 3.5
ROC_THRESHOLD = 200.0
FOREST_CONTAMINATION = 0.02
LOF_NEIGHBORS = 50
LOF_CONTAMINATION = 0.02
MIN_VOTES = 2
HISTORY_ROWS = 500
HISTORY_MIN = 20
MAD_SCALE = 0.6745
MAD_FLOOR = 1e-9
SENSOR_RANGE = 800_000
SAMPLE_RATE_HZ = 45

# Labels of the four sensor channels and the fallback.
SENSOR_LABELS = {
    0: "RM3100 #0 (MUX Ch0)",
    1: "RM3100 #1 (MUX Ch1)",
    2: "RM3100 #2 (MUX Ch2)",
    3: "RM3100 #3 (MUX Ch3)",
}
SENSOR_LABEL_PREFIX = "RM3100 #"

# Routine messages, first match is the skip key.
ROUTINE_PATTERNS = (
    "time to launch",
    "waiting for",
    "waiting to retract",
    "tdl: measurementoutput",
    "measurementoutput",
    "polling",
    "heartbeat",
    "loop iteration",
    "reading sensor",
    "adc reading",
    "pressure reading",
    "temperature reading",
    "magneto reading",
    "sample ",
    "data point",
    "tdl: none",
    "checking if",
)

# Event categories, first match wins; the rest is "System".
EVENT_CATEGORIES = (
    ("Warning/Error", ("error", "fail", "warning", "anomal")),
    ("Milestone", ("launch", "liftoff", "mission", "apogee", "deploy", "skirt", "burnout")),
    ("Actuator", ("motor", "stepper", "relay", "gpio", "camera", "power")),
    ("Sensor", ("sensor", "magneto", "pressure", "thermo", "adc", "tdl", "particle", "calibrat")),
)
EVENT_CATEGORY_DEFAULT = "System"

# Pressure levels (mbar) and the altitude they stand for.
PRESSURE_LEVELS = (
    (1013.0, "~0 km (sea level)"),
    (500.0, "~5.5 km"),
    (200.0, "~12 km (tropopause)"),
    (50.0, "~21 km (stratosphere)"),
)

# Labels of the mission events, in order of priority.
EVENT_LABELS = (
    ("T_LAUNCH", "LAUNCH_TRANSIENT"),
    ("T_BURN_END", "MOTOR_BURNOUT_TRANSIENT"),
    ("T_SKIRT_DEPLOY", "NOSECONE_SEPARATION"),
    ("T_APOGEE", "APOGEE_REGION"),
)

INF = float("inf")


@dataclass(frozen=True)
class Phase:
    """A time interval; an open end excludes its bound."""

    name: str
    lo: float = -INF
    hi: float = INF
    lo_closed: bool = False
    hi_closed: bool = False


# The five overlapping evaluation phases.
PHASES = (
    Phase("Pre-launch (T<0)", hi=0.0),
    Phase("Launch (-5<T<5)", -5.0, 5.0, True, True),
    Phase("Ascent (0<T<200)", 0.0, 200.0),
    Phase("Apogee (195<T<205)", 195.0, 205.0, True, True),
    Phase("Descent (T>200)", lo=200.0),
)


# Seconds relative to launch.
DEFAULT_TIMELINE = {
    "T_SYSTEMS_START": -150.0,
    "T_ML_START": -126.0,
    "T_CAMERA_START": -30.0,
    "T_LAUNCH": 0.0,
    "T_EXPERIMENTS_OFF": 336.0,
}


@dataclass(frozen=True)
class Mission:
    """Timeline of one mission."""

    timeline: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_TIMELINE))

    def at(self, key: str, default: float) -> float:
        return self.timeline.get(key, default)


@dataclass(frozen=True)
class Smoothing:
    """Savitzky-Golay settings."""

    window: int = 7
    order: int = 2
    min_rows: int = 20
