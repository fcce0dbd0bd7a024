"""Column expressions: each stays inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from telluria import params


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column) -> Column:
    """Compute a costly value once per row.  What a generator makes is opaque to
    the optimizer: filters and projections above it do not copy the expression."""
    return F.explode(F.array(value))


def magnitude(x: str | Column, y: str | Column, z: str | Column) -> Column:
    x, y, z = _col(x), _col(y), _col(z)
    return F.sqrt(x * x + y * y + z * z)


def range_reason(axes: Mapping[str, str], limit: float) -> Column:
    """Text naming the first axis out of range, NULL when all are inside."""
    out = F.lit(None).cast("string")
    for axis, name in reversed(list(axes.items())):
        value = F.col(name)
        text = F.concat(F.lit(f"{axis}-axis value "), value.cast("string"),
                        F.lit(f" exceeds range (+/-{limit})"))
        out = F.when(F.abs(value) > limit, text).otherwise(out)
    return out


def mission_phase(t: str | Column, mission: params.Mission) -> Column:
    """Phase name; the thresholds are tested from the latest down."""
    t = _col(t)
    steps = (
        ("POST_EXPERIMENT", mission.at("T_EXPERIMENTS_OFF", params.INF)),
        ("DESCENT", mission.at("T_APOGEE", params.INF)),
        ("ASCENT", mission.at("T_LAUNCH", 0.0)),
        ("ML_ACTIVE", mission.at("T_ML_START", -params.INF)),
        ("SYSTEMS_ON", mission.at("T_SYSTEMS_START", -params.INF)),
    )
    out = F.lit("STANDBY")
    for name, start in reversed(steps):
        out = F.when(t >= F.lit(start), F.lit(name)).otherwise(out)
    return out


def _two_digits(n: Column) -> Column:
    text = n.cast("string")
    return F.when((n >= 0) & (n < 10), F.concat(F.lit("0"), text)).otherwise(text)


def format_hms(seconds: str | Column) -> Column:
    """``HH:MM:SS`` of the truncated seconds; hours may exceed 23."""
    s = _col(seconds).cast("long")
    minutes = F.floor(s / 60)
    return F.concat_ws(":", _two_digits(F.floor(minutes / 60)),
                       _two_digits(F.pmod(minutes, F.lit(60))),
                       _two_digits(F.pmod(s, F.lit(60))))


def format_tplus(t: str | Column) -> Column:
    """``T0``, ``T+120``, ``T-30``, truncating."""
    t = _col(t)
    whole = t.cast("long").cast("string")
    return (F.when(t == 0, F.lit("T0"))
            .when(t > 0, F.concat(F.lit("T+"), whole))
            .otherwise(F.concat(F.lit("T"), whole)))


def format_tplus_live(t: str | Column) -> Column:
    """As :func:`format_tplus` but rounding half to even, with a dead zone."""
    t = _col(t)
    whole = F.bround(t, 0).cast("long").cast("string")
    return (F.when(F.abs(t) < 0.5, F.lit("T0"))
            .when(t > 0, F.concat(F.lit("T+"), whole))
            .when(whole == "0", F.lit("T-0"))
            .otherwise(F.concat(F.lit("T"), whole)))


def skip_key(text: str | Column, patterns: Sequence[str] = params.ROUTINE_PATTERNS) -> Column:
    """First routine pattern contained in the text, NULL when none is."""
    low = F.lower(_col(text))
    out = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        out = F.when(F.contains(low, F.lit(pattern)), F.lit(pattern.strip())).otherwise(out)
    return out


def event_category(text: str | Column) -> Column:
    low = F.lower(_col(text))
    out = F.lit(params.EVENT_CATEGORY_DEFAULT)
    for name, words in reversed(params.EVENT_CATEGORIES):
        out = F.when(low.rlike("|".join(words)), F.lit(name)).otherwise(out)
    return out


def sensor_label(sensor_id: str | Column, labels: Mapping[int, str] = params.SENSOR_LABELS) -> Column:
    sid = _col(sensor_id)
    out = F.concat(F.lit(params.SENSOR_LABEL_PREFIX), sid.cast("string"))
    for number, label in labels.items():
        out = F.when(sid == number, F.lit(label)).otherwise(out)
    return out


def in_phase(t: str | Column, phase: params.Phase) -> Column:
    t = _col(t)
    test = F.lit(True)
    if phase.lo > -params.INF:
        test = test & ((t >= phase.lo) if phase.lo_closed else (t > phase.lo))
    if phase.hi < params.INF:
        test = test & ((t <= phase.hi) if phase.hi_closed else (t < phase.hi))
    return test
