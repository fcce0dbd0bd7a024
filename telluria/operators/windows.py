"""Ordered operators: gaps, smoothing, robust scores, forecast windows (survey 2.6).

All of them run on :class:`~telluria.operators.series.Series`, so a hot group is
cut into slices with borrowed rows instead of being sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from telluria import params
from telluria.functions import frames
from telluria.functions.scalar import magnitude, once
from telluria.operators.median import wide_medians
from telluria.operators.quantiles import percentiles
from telluria.operators.series import ARRAY_ROWS, RN, SIZE, ArrayFrame, Series
from telluria.schema import AXES, KEYS, ORDER
from telluria.session import SLICE_ROWS, Profile, attach, materialize, profile

Y = "magnitude"
WIDE_WINDOW = 65_536  # rows of a running window beyond which counts answer it


# Gaps, sessions, segments

def detect_gaps(df: DataFrame, threshold: float = 5.0, by: Sequence[str] = KEYS,
                t: str = "mission_time_s", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Gaps between consecutive distinct times that exceed the threshold."""
    times = df.select(*by, t).distinct()
    s = Series.of(times, by, [t], slice_rows=slice_rows).mutate(
        lambda d, w: d.withColumn("gap_end", F.lead(t).over(w)), after=1)
    length = F.col("gap_end") - F.col(t)
    return (s.df.where(length > threshold)
            .select(*by, F.col(t).alias("gap_start"), "gap_end", length.alias("gap_s")))


def _flag_breaks(s: Series, threshold: float, t: str) -> Series:
    return s.mutate(lambda d, w: d.withColumn(
        "_gap", F.col(t) - F.lag(t).over(w)), before=1).map(
        lambda d: d.withColumn("_break", F.coalesce((F.col("_gap") > threshold).cast("long"), F.lit(0))))


def segment_by_gap(df: DataFrame, threshold: float = 1.5, by: Sequence[str] = KEYS,
                   order: Sequence[str] = ORDER, t: str = "mission_time_s",
                   out: str = "segment", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Number of breaks so far: rows with equal numbers follow without a gap."""
    s = _flag_breaks(Series.of(df, by, order, slice_rows=slice_rows), threshold, t)
    return s.running_sum({out: F.col("_break")}).df.drop("_gap", "_break")


def detect_sessions(df: DataFrame, threshold: float = 5.0, by: Sequence[str] = ("flight_id",),
                    order: Sequence[str] = ("timestamp_unix", "reading_number"),
                    t: str = "timestamp_unix", rate_hz: float = params.SAMPLE_RATE_HZ,
                    slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per boot session, with the silence that went before it."""
    s = _flag_breaks(Series.of(df, by, order, slice_rows=slice_rows), threshold, t)
    rows = s.running_sum({"session": F.col("_break")}).df
    return rows.groupBy(*by, "session").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(t).alias("t_first"), F.max(t).alias("t_last"),
        F.min_by("mission_time_s", F.struct(*order)).alias("mission_time_first"),
        F.max(F.when(F.col("_break") == 1, F.col("_gap") - F.lit(1.0 / rate_hz))).alias("missing_s"))


def session_summary(sessions: DataFrame, by: Sequence[str] = ("flight_id",)) -> DataFrame:
    return sessions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.coalesce(F.sum("missing_s"), F.lit(0.0)).alias("missing_s"))


# Smoothing

# Rows of the least-squares fit of a parabola to seven points.
SAVGOL_MIDDLE = ([-2, 3, 6, 7, 6, 3, -2], 21)
SAVGOL_EDGE = (
    ([32, 15, 3, -4, -6, -3, 5], 42),
    ([5, 4, 3, 2, 1, 0, -1], 14),
    ([1, 3, 4, 4, 3, 1, -2], 14),
)


def smooth_savgol(df: DataFrame, by: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
                  axes: Sequence[str] = AXES, min_rows: int = params.Smoothing.min_rows,
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Seven-point quadratic smoothing with fitted ends; magnitude recomputed.
    Groups below ``min_rows`` pass unchanged."""

    def smooth(d: DataFrame, w: WindowSpec) -> DataFrame:
        def at(axis: str, k: int) -> Column:
            c = F.col(axis)
            return c if k == 0 else F.lag(axis, -k).over(w) if k < 0 else F.lead(axis, k).over(w)

        def fit(axis: str, weights: Sequence[int], total: int, first: int) -> Column:
            terms = [F.lit(float(c)) * at(axis, first + i) for i, c in enumerate(weights)]
            out = terms[0]
            for term in terms[1:]:
                out = out + term
            return out / F.lit(float(total))

        cols = {}
        for axis in axes:
            value = fit(axis, *SAVGOL_MIDDLE, first=-3)
            for i, (weights, total) in enumerate(SAVGOL_EDGE):
                value = (F.when(F.col(RN) == i + 1, fit(axis, weights, total, -i))
                         .when(F.col(RN) == F.col(SIZE) - i, fit(axis, weights[::-1], total, i - 6))
                         .otherwise(value))
            cols[axis] = F.when(F.col(SIZE) >= max(min_rows, 7), value).otherwise(F.col(axis))
        return d.withColumns(cols)

    s = Series.of(df, by, order, numbered=True, slice_rows=slice_rows).map(
        lambda d: d.withColumns({a: F.col(a).cast("double") for a in axes}))
    return s.mutate(smooth, before=6, after=6).df.withColumn("magnitude", magnitude(*axes))


def moving_average(df: DataFrame, value: str = Y, window: int = 5, out: str = "moving_avg",
                   by: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
                   slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Centred mean with zeros beyond the ends; shorter groups pass unchanged."""
    back, ahead = window // 2, (window - 1) // 2

    def mean(d, w):
        total = F.sum(value).over(w.rowsBetween(-back, ahead)) / F.lit(float(window))
        return d.withColumn(out, F.when(F.col(SIZE) < window, F.col(value)).otherwise(total))

    return Series.of(df, by, order, numbered=True, slice_rows=slice_rows).mutate(
        mean, before=back, after=ahead).df


def rolling_mean_std(df: DataFrame, value: str = Y, limit: int = 100, by: Sequence[str] = KEYS,
                     order: Sequence[str] = ORDER, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Trailing mean and sample std over ``min(limit, n // 10)`` rows with the
    one-sigma band; NULL until the frame is full or if it has one row."""

    def roll(d, w):
        size = F.least(F.lit(limit), F.floor(F.col(SIZE) / 10))
        full = (size > 1) & (F.col(RN) >= size)
        frame = w.rowsBetween(-(limit - 1), 0)
        # The frame is fixed, so shorter ones weigh the rows before them zero.
        taken = F.slice(F.collect_list(value).over(frame), -size.cast("int"), size.cast("int"))
        mean = F.aggregate(taken, F.lit(0.0), lambda a, v: a + v) / size
        squares = F.aggregate(taken, F.lit(0.0), lambda a, v: a + (v - F.col("rolling_mean"))
                              * (v - F.col("rolling_mean")))
        whole_avg, whole_std = F.avg(value).over(frame), F.stddev_samp(value).over(frame)
        d = d.withColumn("rolling_mean", F.when(full, F.when(size == limit, whole_avg).otherwise(mean)))
        return d.withColumn("rolling_std", F.when(full, F.when(size == limit, whole_std)
                                                  .otherwise(F.sqrt(squares / (size - 1)))))

    s = Series.of(df, by, order, numbered=True, slice_rows=slice_rows).mutate(roll, before=limit - 1)
    return s.df.withColumns({
        "band_low": F.col("rolling_mean") - F.col("rolling_std"),
        "band_high": F.col("rolling_mean") + F.col("rolling_std")})


# Robust scores

def robust_stats(df: DataFrame, value: str = Y, by: Sequence[str] = KEYS,
                 floor: float | None = None, slice_rows: int = SLICE_ROWS, known: Profile | None = None) -> DataFrame:
    """Median, MAD and spread per group.  The spread is the MAD, or the
    population std when the MAD is below 1e-9, at least ``floor`` if given."""
    groups, largest = known or profile(df, by)
    narrow = df.select(*by, F.col(value).cast("double").alias("_y"))
    med = percentiles(narrow, by, "_y", {"median": 0.5}, slice_rows, largest=largest)
    dev = attach(narrow, med, by, groups=groups).withColumn(
        "_d", F.abs(F.col("_y") - F.col("median")))
    mad = percentiles(dev, by, "_d", {"mad": 0.5}, slice_rows, largest=largest)
    moments = narrow.groupBy(*by).agg(F.count("_y").alias("n"), F.stddev_pop("_y").alias("std"))
    out = attach(attach(moments, med, by, groups=groups), mad, by, groups=groups)
    spread = F.when(F.col("mad") < params.MAD_FLOOR, F.col("std")).otherwise(F.col("mad"))
    if floor is not None:
        spread = F.greatest(spread, F.lit(floor))
    return out.withColumn("spread", spread)


def zscore_global(df: DataFrame, threshold: float = params.Z_THRESHOLD, value: str = Y,
                  by: Sequence[str] = KEYS, std_fallback: bool = False,
                  out: str = "z", flag: str = "is_z", slice_rows: int = SLICE_ROWS,
                  known: Profile | None = None) -> DataFrame:
    """Modified z-score against the group's median and MAD."""
    known = known or profile(df, by)
    stats = robust_stats(df, value, by, slice_rows=slice_rows, known=known).select(
        *by, "median", "mad", "spread")
    rows = attach(df, stats, by, groups=known.groups)
    dev = F.lit(params.MAD_SCALE) * F.abs(F.col(value) - F.col("median"))
    if std_fallback:
        z = dev / F.greatest(F.col("spread"), F.lit(params.MAD_FLOOR))
    else:
        z = F.when(F.col("mad") > params.MAD_FLOOR, dev / F.col("mad")).otherwise(0.0)
    return rows.withColumn(out, z).withColumn(flag, F.col(out) > threshold).drop(
        "median", "mad", "spread")


def trailing_z(s: Series, rows: int, min_rows: int, threshold: float, value: str,
               out: str, flag: str) -> Series:
    """Needs a numbered series."""

    def score(frame: ArrayFrame) -> dict[str, np.ndarray]:
        past, own, _ = frame.split(value)
        return {out: frames.trailing_scores(past, own, rows, min_rows)}

    return s.compute(score, [value], [out], before=rows - 1).map(
        lambda d: d.withColumn(flag, F.col(out) > threshold))


def zscore_trailing(df: DataFrame, rows: int = params.HISTORY_ROWS,
                    min_rows: int = params.HISTORY_MIN, threshold: float = params.Z_THRESHOLD,
                    value: str = Y, by: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
                    out: str = "z", flag: str = "is_z", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Modified z-score against the last ``rows`` rows including this one."""
    return trailing_z(Series.of(df, by, order, numbered=True, slice_rows=slice_rows), rows, min_rows,
                      threshold, value, out, flag).df


def zscore_classic(df: DataFrame, threshold: float = 3.0, rows: int = params.HISTORY_ROWS,
                   min_rows: int = params.HISTORY_MIN, value: str = Y, by: Sequence[str] = KEYS,
                   order: Sequence[str] = ORDER, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """|x - mean| / population std over the trailing frame with this row; NULL
    below ``min_rows`` rows or without spread."""
    s = Series.of(df, by, order, numbered=True, slice_rows=slice_rows)
    return classic_z(s, threshold, rows, min_rows, value).df


def classic_z(s: Series, threshold: float, rows: int, min_rows: int, value: str) -> Series:
    """Needs a numbered series.  On arrays: Spark's moving frame adds up all its
    rows anew for each row."""

    def score(frame: ArrayFrame) -> dict[str, np.ndarray]:
        past, own, _ = frame.split(value)
        n, mean, std = frames.trailing_moments(past, own, rows)
        z = np.full(len(own), np.nan)
        ok = (n >= min_rows) & (std > 0)
        z[ok] = np.abs(own[ok] - mean[ok]) / std[ok]
        return {"z_classic": z}

    return s.compute(score, [value], ["z_classic"], before=rows - 1).map(
        lambda d: d.withColumn("is_z_classic", F.coalesce(F.col("z_classic") > threshold, F.lit(False))))


def median_trend(s: Series, value: str = Y, window: int | None = None, out: str = "trend") -> Series:
    """Centred running median over an odd window of ``max(31, n // 10)`` rows of
    a group of ``n``, or of ``window`` rows; the end values stand in beyond the
    ends.  Needs a numbered series.  Windows that a slice cannot hold are
    answered by counts (:mod:`telluria.operators.median`)."""
    def half_of(n: int) -> int:
        return (window or max(31, n // 10)) // 2

    most = min(s.slice_rows, WIDE_WINDOW)
    if s.largest and 2 * half_of(s.largest) + 1 > most:
        half = F.floor(F.lit(window) / 2) if window else F.floor(F.greatest(F.lit(31), F.floor(F.col(SIZE) / 10)) / 2)
        wide = 2 * half + 1 > most
        medians = wide_medians(s.rows.where(wide), s.by, value, half, out, min(ARRAY_ROWS, s.slice_rows))
        done = s.map(lambda d: attach(d.where(wide), medians, [*s.by, RN], how="inner"))
        if window:
            return done
        rest = Series.of(s.rows.where(~wide).drop(RN, SIZE), s.by, s.order, numbered=True, slice_rows=s.slice_rows)
        rest = median_trend(rest, value, window, out)
        return done.map(lambda d: d.unionByName(rest.rows.select(*d.columns)))
    reach = half_of(s.largest or 0)

    def trend(frame: ArrayFrame) -> dict[str, np.ndarray]:
        half = half_of(frame.size)
        before, own, after = frame.split(value)
        if len(before) < half:  # only at the start of the group
            first = (before if len(before) else own)[0]
            before = np.concatenate([np.full(half - len(before), first), before])
        if len(after) < half:
            last = (after if len(after) else own)[-1]
            after = np.concatenate([after, np.full(half - len(after), last)])
        return {out: frames.centred_medians(before, own, after, half)}

    return s.compute(trend, [value], [out], before=reach, after=reach)


def zscore_detrended(df: DataFrame, threshold: float = params.Z_THRESHOLD, value: str = Y,
                     by: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
                     window: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Modified z-score of what is left after a centred running median, whose
    window is a tenth of the group or ``window`` rows."""
    s = detrended(Series.of(df, by, order, numbered=True, slice_rows=slice_rows), value, window)
    return detrended_score(materialize(s.df), threshold, by, slice_rows, s.profile)


def detrended(s: Series, value: str = Y, window: int | None = None) -> Series:
    """Add ``trend`` and ``residual`` to a numbered series."""
    return median_trend(s, value, window).map(lambda d: d.withColumn("residual", F.col(value) - F.col("trend")))


def detrended_score(rows: DataFrame, threshold: float, by: Sequence[str], slice_rows: int, known: Profile) -> DataFrame:
    return zscore_global(rows, threshold, "residual", by, std_fallback=True, out="z_detrended",
                         flag="is_z_detrended", slice_rows=slice_rows, known=known)


# Rate of change

def roc(s: Series, value: str = Y, out: str = "roc") -> Series:
    return s.mutate(lambda d, w: d.withColumn(
        out, F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)), F.lit(0.0))), before=1)


def rate_of_change(df: DataFrame, threshold: float = params.ROC_THRESHOLD, value: str = Y,
                   by: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
                   slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Absolute step from the row before; a step above the threshold is flagged."""
    s = roc(Series.of(df, by, order, slice_rows=slice_rows), value)
    return s.df.withColumn("is_roc", F.col("roc") > threshold)


def adaptive_roc_flag(rows: DataFrame, value: str, by: Sequence[str], slice_rows: int, known: Profile) -> DataFrame:
    """Threshold per group: the larger of the 99th percentile of the positive
    steps and 5 % of the 5-95 percentile range.  ``rows`` are read three times."""
    groups, largest = known
    span = percentiles(rows, by, value, {"_p5": 0.05, "_p95": 0.95}, slice_rows, largest=largest)
    steps = percentiles(rows.where("roc > 0"), by, "roc", {"_p99": 0.99}, slice_rows, largest=largest)
    out = attach(attach(rows, span, by, groups=groups), steps, by, groups=groups)
    limit = F.greatest(F.coalesce(F.col("_p99"), F.lit(0.0)),
                       (F.col("_p95") - F.col("_p5")) * F.lit(0.05))
    return (out.withColumn("roc_threshold", limit)
            .withColumn("is_roc_adaptive", F.col("roc") > F.col("roc_threshold"))
            .drop("_p5", "_p95", "_p99"))


def rate_of_change_adaptive(df: DataFrame, value: str = Y, by: Sequence[str] = KEYS,
                            order: Sequence[str] = ORDER, slice_rows: int = SLICE_ROWS) -> DataFrame:
    s = roc(Series.of(df, by, order, slice_rows=slice_rows), value)
    return adaptive_roc_flag(materialize(s.df), value, by, slice_rows, s.profile)


# Forecast windows

CHANNELS = {"x": "bx", "y": "by", "z": "bz", "mag": "magnitude"}


def make_windows(df: DataFrame, window: int = 3, horizon: int = 1, gap: float = 1.5,
                 by: Sequence[str] = KEYS, order: Sequence[str] = ORDER, t: str = "mission_time_s",
                 slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per target: the ``window`` rows that end ``horizon`` rows before
    it as ``<channel>_<i>`` (``i`` from 0, oldest first), its magnitude and its
    time.  Windows lie inside one gap-free segment."""
    last = window + horizon - 1

    def widen(d, w):
        # No break among the last rows means that they share a segment.
        broken = F.max((F.col("_step") > gap).cast("int")).over(w.rowsBetween(1 - last, 0))
        cols = {f"{name}_{i}": F.lag(source, last - i).over(w)
                for name, source in CHANNELS.items() for i in range(window)}
        return d.withColumns({**cols, "_broken": F.coalesce(broken, F.lit(0)),
                              "_oldest": F.lag(F.lit(1), last).over(w)})

    def steps_then_widen(d, w):
        return widen(d.withColumn("_step", F.col(t) - F.lag(t).over(w)), w)

    s = Series.of(df, by, order, slice_rows=slice_rows).mutate(steps_then_widen, before=last + 1)
    names = [f"{name}_{i}" for name in CHANNELS for i in range(window)]
    full = (F.col("_broken") == 0) & F.col("_oldest").isNotNull() & F.col("magnitude").isNotNull()
    for i in range(window):
        full = full & F.col(f"mag_{i}").isNotNull()
    return s.df.where(full).select(
        *by, *order, *names, F.col("magnitude").alias("target"), F.col(t).alias("target_time"))


FEATURE_STATS = ("mean", "std", "min", "max", "last", "slope", "trend")


def feature_names() -> list[str]:
    """The 31 feature names in order."""
    per_channel = [f"{c}_{s}" for c in CHANNELS for s in FEATURE_STATS]
    return [*per_channel, "mag_velocity", "mag_acceleration", "mag_max_roc"]


def window_features(windows: DataFrame, window: int = 3) -> DataFrame:
    """Statistics of every window as plain column expressions."""

    def total(cols: Sequence[Column]) -> Column:
        out = cols[0]
        for c in cols[1:]:
            out = out + c
        return out

    cols: dict[str, Column] = {}
    centre = (window - 1) / 2
    spread = sum((i - centre) ** 2 for i in range(window))
    for c in CHANNELS:
        v = [F.col(f"{c}_{i}") for i in range(window)]
        mean = total(v) / F.lit(float(window))
        std = F.sqrt(total([(x - mean) * (x - mean) for x in v]) / F.lit(float(window)))
        slope = (total([F.lit(i - centre) * x for i, x in enumerate(v)]) / F.lit(spread)
                 if spread else F.lit(0.0))
        cols |= {
            f"{c}_mean": mean, f"{c}_std": std,
            f"{c}_min": F.least(*v) if window > 1 else v[0],
            f"{c}_max": F.greatest(*v) if window > 1 else v[0],
            f"{c}_last": v[-1],
            f"{c}_slope": F.when(std > 1e-9, slope).otherwise(0.0),
            f"{c}_trend": v[-1] - v[0]}
    mag = [F.col(f"mag_{i}") for i in range(window)]
    steps = [b - a for a, b in zip(mag, mag[1:])]
    sizes = [F.abs(s) for s in steps]
    cols["mag_velocity"] = steps[-1] if steps else F.lit(0.0)
    cols["mag_acceleration"] = steps[-1] - steps[-2] if len(steps) > 1 else F.lit(0.0)
    cols["mag_max_roc"] = (F.greatest(*sizes) if len(sizes) > 1 else sizes[0] if sizes else F.lit(0.0))
    # Many statistics share sums; without the barrier, filters on the features
    # (a model's null check) would spell all of them out again.
    packed = windows.withColumn("_f", once(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return packed.select(*windows.columns, "_f.*")


def forecast_baselines(windows: DataFrame, window: int = 3) -> DataFrame:
    """Last value, straight line through the last two, window mean."""
    mag = [F.col(f"mag_{i}") for i in range(window)]
    mean = mag[0]
    for c in mag[1:]:
        mean = mean + c
    return windows.withColumns({
        "pred_last": mag[-1],
        "pred_linear": F.lit(2.0) * mag[-1] - mag[-2] if window > 1 else mag[-1],
        "pred_mean": mean / F.lit(float(window))})


# Events, history, counters

def dedupe_events(df: DataFrame, by: Sequence[str] = ("path",), t: str = "time_mission",
                  text: str = "event", order: str = "line_no", width: int = 30) -> DataFrame:
    """First row per whole second and leading text: a minimum per key, which
    combines before the shuffle, rather than a sort of each key's rows."""
    key = [F.col(t).cast("long").alias("_second"), F.substring(text, 1, width).alias("_lead")]
    rest = [c for c in df.columns if c not in (*by, order)]
    first = df.groupBy(*by, *key).agg(F.min(F.struct(order, *rest)).alias("_row"))
    return first.select(*by, "_row.*").select(*df.columns)


def history_distance(df: DataFrame, rows: int = params.HISTORY_ROWS,
                     min_rows: int = params.HISTORY_MIN, by: Sequence[str] = KEYS,
                     order: Sequence[str] = ORDER, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Mean distance to the trailing points, flagged when it exceeds the 95th
    percentile of those distances (a weak rule, kept for compatibility)."""
    return history_rule(Series.of(df, by, order, numbered=True, slice_rows=slice_rows), rows, min_rows).df


def history_rule(s: Series, rows: int, min_rows: int) -> Series:
    """Needs a numbered series."""

    def score(frame: ArrayFrame) -> dict[str, np.ndarray]:
        points = np.column_stack([frame.values[a] for a in AXES])
        mean, p95 = frames.trailing_distances(points[:frame.start], points[frame.start:frame.stop], rows, min_rows)
        return {"history_mean": mean, "history_p95": p95}

    return s.compute(score, AXES, ["history_mean", "history_p95"], before=rows - 1).map(
        lambda d: d.withColumn("is_far", F.coalesce(F.col("history_mean") > F.col("history_p95"), F.lit(False))))


def running_anomaly_number(df: DataFrame, flag: str = "is_anomaly", by: Sequence[str] = KEYS,
                           order: Sequence[str] = ORDER, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Sequential reading number and count of flagged rows so far."""
    s = Series.of(df, by, order, slice_rows=slice_rows).running_sum({
        "reading_seq": F.lit(1).cast("long"),
        "anomaly_no": F.coalesce(F.col(flag).cast("long"), F.lit(0))})
    return s.df
