"""Ordered operators (survey 2.6) and the flight detector."""

from __future__ import annotations

from telluria.checks.base import DET, GAP_POOLED, GAP_SENSOR, ROC_LIMIT, W, WP, F, query, r, rounded, sql
from telluria.operators import anomaly
from telluria.operators import windows as O

VIEW = ("reading_number", "sensor_id")


@query("detect_flight", sql(DET, select="""SELECT reading_number, sensor_id, round(z, 4) AS z, round(roc, 4) AS roc,
  is_z, is_roc, votes, is_anomaly FROM det"""))
def _(s, d):
    out = anomaly.detect_flight(r(s, d), roc_threshold=ROC_LIMIT)
    return rounded(out.select(*VIEW, "z", "roc", "is_z", "is_roc", "votes", "is_anomaly"))


@query("detect_flight_pooled", sql(DET.replace(W, WP), select="""SELECT reading_number, round(z, 4) AS z, round(roc, 4) AS roc, votes FROM det"""))
def _(s, d):
    out = anomaly.detect_flight(r(s, d), by=["flight_id"], roc_threshold=ROC_LIMIT)
    return rounded(out.select("reading_number", "z", "roc", "votes"))


@query("ensemble_vote", sql(select="""SELECT reading_number, (bx > 50)::INT + (b_y > 75)::INT + (bz > 90)::INT AS votes,
  (bx > 50)::INT + (b_y > 75)::INT + (bz > 90)::INT >= 2 AS is_anomaly FROM readings"""))
def _(s, d):
    rows = r(s, d).withColumns({"a": F.col("bx") > 50, "b": F.col("by") > 75, "c": F.col("bz") > 90})
    return anomaly.ensemble_vote(rows, ["a", "b", "c"]).select("reading_number", "votes", "is_anomaly")


@query("detect_gaps", sql("""t AS (SELECT DISTINCT flight_id, sensor_id, mission_time_s AS gap_start FROM readings),
g AS (SELECT *, lead(gap_start) OVER (PARTITION BY flight_id, sensor_id ORDER BY gap_start) AS gap_end FROM t)""",
    select=f"""SELECT sensor_id, round(gap_start, 6) AS gap_start, round(gap_end, 6) AS gap_end,
  round(gap_end - gap_start, 6) AS gap_s FROM g WHERE gap_end - gap_start > {GAP_SENSOR}"""))
def _(s, d):
    return rounded(O.detect_gaps(r(s, d), GAP_SENSOR).drop("flight_id"), 6)


SESSIONS = f"""g AS (SELECT *, epoch_us(event_ts) / 1e6 AS u FROM readings),
k AS (SELECT *, u - lag(u) OVER (PARTITION BY flight_id ORDER BY u, reading_number) AS gap FROM g),
q AS (SELECT *, sum(CASE WHEN gap > {GAP_POOLED} THEN 1 ELSE 0 END)
  OVER (PARTITION BY flight_id ORDER BY u, reading_number) AS session FROM k),
se AS (SELECT session::BIGINT AS session, count(*) AS n_rows, min(u) AS t_first, max(u) AS t_last,
  min(mission_time_s) AS mission_time_first,
  max(CASE WHEN gap > {GAP_POOLED} THEN gap - 1.0 / 45 END) AS missing_s FROM q GROUP BY session)"""


def _unix(rows):
    return rows.withColumn("timestamp_unix", F.unix_micros("event_ts") / F.lit(1e6))


@query("detect_sessions", sql(SESSIONS, select="""SELECT session, n_rows, round(t_first, 6) AS t_first, round(t_last, 6) AS t_last,
  round(mission_time_first, 6) AS mission_time_first, round(missing_s, 3) AS missing_s FROM se"""))
def _(s, d):
    out = O.detect_sessions(_unix(r(s, d)), GAP_POOLED).drop("flight_id")
    return rounded(rounded(out, 6, "t_first", "t_last", "mission_time_first"), 3, "missing_s")


@query("session_summary", sql(SESSIONS, select="""SELECT count(*) AS n_sessions, round(coalesce(sum(missing_s), 0), 3) AS missing_s FROM se"""))
def _(s, d):
    return rounded(O.session_summary(O.detect_sessions(_unix(r(s, d)), GAP_POOLED)).drop("flight_id"), 3)


SEGMENT = f"""k AS (SELECT *, mission_time_s - lag(mission_time_s) OVER ({W}) AS gap FROM readings),
seg AS (SELECT *, sum(CASE WHEN gap > {GAP_SENSOR} THEN 1 ELSE 0 END) OVER ({W})::BIGINT AS segment FROM k)"""


@query("segment_by_gap", sql(SEGMENT, select="SELECT reading_number, sensor_id, segment FROM seg"))
def _(s, d):
    return O.segment_by_gap(r(s, d), GAP_SENSOR).select(*VIEW, "segment")


def _savgol(c: str) -> str:
    """The fitted value by least squares on the seven rows, written as sums."""
    at = lambda k: f"lag({c}, {-k}) OVER o" if k < 0 else f"lead({c}, {k}) OVER o" if k else c
    fit = lambda weights, total, first: "(" + " + ".join(
        f"{w}.0 * ({at(first + i)})" for i, w in enumerate(weights)) + f") / {total}.0"
    cases = []
    for i, (w, t) in enumerate((([32, 15, 3, -4, -6, -3, 5], 42), ([5, 4, 3, 2, 1, 0, -1], 14),
                                ([1, 3, 4, 4, 3, 1, -2], 14))):
        cases.append(f"WHEN rn = {i + 1} THEN {fit(w, t, -i)}")
        cases.append(f"WHEN rn = n - {i} THEN {fit(w[::-1], t, i - 6)}")
    return f"CASE {' '.join(cases)} ELSE {fit([-2, 3, 6, 7, 6, 3, -2], 21, -3)} END"


@query("smooth_savgol", sql(f"""i AS (SELECT *, row_number() OVER ({W}) AS rn,
  count(*) OVER (PARTITION BY flight_id, sensor_id) AS n FROM readings),
f AS (SELECT reading_number, sensor_id, {_savgol('bx')} AS x, {_savgol('b_y')} AS y, {_savgol('bz')} AS z
  FROM i WINDOW o AS ({W}))""", select="""SELECT reading_number, sensor_id, round(x, 5) AS bx, round(y, 5) AS y_smooth,
  round(z, 5) AS bz, round(sqrt(x * x + y * y + z * z), 5) AS magnitude FROM f"""))
def _(s, d):
    out = O.smooth_savgol(r(s, d)).withColumnRenamed("by", "y_smooth")
    return rounded(out.select(*VIEW, "bx", "y_smooth", "bz", "magnitude"), 5)


def _global(value: str, src: str, fallback: bool) -> tuple[str, str, str]:
    spread = "CASE WHEN mad < 1e-9 THEN sd ELSE mad END" if fallback else "mad"
    return (f"md AS (SELECT sensor_id, median({value}) AS med, stddev_pop({value}) AS sd FROM {src} GROUP BY sensor_id)",
            f"ma AS (SELECT sensor_id, median(abs({value} - med)) AS mad FROM {src} JOIN md USING (sensor_id) GROUP BY sensor_id)",
            f"zz AS (SELECT x.*, CASE WHEN {spread} > 1e-9 THEN 0.6745 * abs({value} - med) / {spread} ELSE 0.0 END AS z "
            f"FROM {src} x JOIN md USING (sensor_id) JOIN ma USING (sensor_id))")


@query("zscore_detrended", sql(f"""i AS (SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER g AS n,
  first_value(magnitude) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y0,
  last_value(magnitude) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y1,
  list(magnitude) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS near
  FROM readings WINDOW g AS (PARTITION BY flight_id, sensor_id)),
j AS (SELECT *, greatest(31, n // 10) // 2 AS h FROM i),
t AS (SELECT *, list_median(list_concat(
    list_transform(range(greatest(0, h - rn + 1)), lambda v: y0),
    list_slice(near, greatest(1, rn - h), least(n, rn + h)),
    list_transform(range(greatest(0, h - (n - rn))), lambda v: y1))) AS trend FROM j),
u AS (SELECT *, magnitude - trend AS residual FROM t)""", *_global("residual", "u", True),
    select="""SELECT reading_number, sensor_id, round(trend, 4) AS trend, round(z, 4) AS z_detrended, z > 3.5 AS is_z_detrended FROM zz"""))
def _(s, d):
    out = O.zscore_detrended(r(s, d))
    return rounded(out.select(*VIEW, "trend", "z_detrended", "is_z_detrended"))


@query("zscore_trailing", sql(DET, select="SELECT reading_number, sensor_id, round(z, 4) AS z, is_z FROM det"))
def _(s, d):
    return rounded(O.zscore_trailing(r(s, d)).select(*VIEW, "z", "is_z"))


@query("zscore_global", sql(*_global("magnitude", "readings", False),
    select="SELECT reading_number, sensor_id, round(z, 4) AS z, z > 3.5 AS is_z FROM zz"))
def _(s, d):
    return rounded(O.zscore_global(r(s, d)).select(*VIEW, "z", "is_z"))


CLASSIC = f"""c AS (SELECT reading_number, sensor_id, mission_time_s, CASE WHEN count(*) OVER w >= 20 AND stddev_pop(magnitude) OVER w > 0
  THEN abs(magnitude - avg(magnitude) OVER w) / stddev_pop(magnitude) OVER w END AS z
  FROM readings WINDOW w AS ({W} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))"""


@query("zscore_classic", sql(CLASSIC, select="""SELECT reading_number, sensor_id, round(z, 4) AS z_classic,
  coalesce(z > 2.0, false) AS is_z_classic FROM c"""))
def _(s, d):
    return rounded(O.zscore_classic(r(s, d), threshold=2.0).select(*VIEW, "z_classic", "is_z_classic"))


@query("rate_of_change", sql(select=f"""SELECT reading_number, sensor_id,
  round(coalesce(abs(magnitude - lag(magnitude) OVER ({W})), 0), 4) AS roc,
  coalesce(abs(magnitude - lag(magnitude) OVER ({W})), 0) > {ROC_LIMIT} AS is_roc FROM readings"""))
def _(s, d):
    return rounded(O.rate_of_change(r(s, d), ROC_LIMIT).select(*VIEW, "roc", "is_roc"))


@query("rate_of_change_adaptive", sql(f"""k AS (SELECT *, coalesce(abs(magnitude - lag(magnitude) OVER ({W})), 0) AS roc FROM readings),
p AS (SELECT sensor_id, greatest(coalesce(quantile_cont(roc, 0.99) FILTER (roc > 0), 0),
  (quantile_cont(magnitude, 0.95) - quantile_cont(magnitude, 0.05)) * 0.05) AS lim FROM k GROUP BY sensor_id)""",
    select="""SELECT reading_number, sensor_id, round(roc, 4) AS roc, round(lim, 4) AS roc_threshold,
  roc > lim AS is_roc_adaptive FROM k JOIN p USING (sensor_id)"""))
def _(s, d):
    out = O.rate_of_change_adaptive(r(s, d))
    return rounded(out.select(*VIEW, "roc", "roc_threshold", "is_roc_adaptive"))


@query("rolling_mean_std", sql(f"""i AS (SELECT *, row_number() OVER ({W}) AS rn,
  least(100, count(*) OVER (PARTITION BY flight_id, sensor_id) // 10) AS k FROM readings),
m AS (SELECT *, list(magnitude) OVER ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS l FROM i),
q AS (SELECT *, CASE WHEN k > 1 AND rn >= k THEN list_slice(l, -k, -1) END AS f FROM m)""",
    select="""SELECT reading_number, sensor_id, round(list_avg(f), 4) AS rolling_mean, round(list_stddev_samp(f), 4) AS rolling_std,
  round(list_avg(f) - list_stddev_samp(f), 4) AS band_low, round(list_avg(f) + list_stddev_samp(f), 4) AS band_high FROM q"""))
def _(s, d):
    out = O.rolling_mean_std(r(s, d))
    return rounded(out.select(*VIEW, "rolling_mean", "rolling_std", "band_low", "band_high"))


@query("moving_average", sql(select=f"""SELECT reading_number, sensor_id, round(sum(magnitude) OVER (
  {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 5) AS moving_avg FROM readings"""))
def _(s, d):
    return rounded(O.moving_average(r(s, d)).select(*VIEW, "moving_avg"), 5)


# Windows of three rows before a target, all in one segment.
_SOURCES = {"x": "bx", "y": "b_y", "z": "bz", "mag": "magnitude"}
WINDOWS = SEGMENT + ",\nwin AS (SELECT * FROM (SELECT reading_number, sensor_id, segment, mission_time_s AS target_time, magnitude AS target, " + ", ".join(
    f"lag({src}, {3 - i}) OVER v AS {c}_{i}" for c, src in _SOURCES.items() for i in range(3)) + """,
  row_number() OVER v AS k FROM seg WINDOW v AS (PARTITION BY flight_id, sensor_id, segment ORDER BY mission_time_s, reading_number))
  WHERE k > 3)"""


@query("make_windows", sql(WINDOWS, select="""SELECT reading_number, sensor_id, round(target, 4) AS target, round(target_time, 6) AS target_time,
  round(x_0, 4) AS x_0, round(y_1, 4) AS y_1, round(z_2, 4) AS z_2, round(mag_0, 4) AS mag_0, round(mag_2, 4) AS mag_2 FROM win"""))
def _(s, d):
    out = O.make_windows(r(s, d), gap=GAP_SENSOR)
    return rounded(rounded(out, 6, "target_time").select(*VIEW, "target", "target_time", "x_0", "y_1", "z_2", "mag_0", "mag_2"),
                   4, "target", "x_0", "y_1", "z_2", "mag_0", "mag_2")


def _features() -> str:
    cols = []
    for c in _SOURCES:
        v = [f"{c}_{i}" for i in range(3)]
        lst = "[" + ", ".join(v) + "]"
        std = f"list_stddev_pop({lst})"
        cols += [f"round(list_avg({lst}), 4) AS {c}_mean", f"round({std}, 4) AS {c}_std",
                 f"round(list_min({lst}), 4) AS {c}_min", f"round(list_max({lst}), 4) AS {c}_max",
                 f"round({v[2]}, 4) AS {c}_last",
                 f"round(CASE WHEN {std} > 1e-9 THEN ({v[2]} - {v[0]}) / 2 ELSE 0.0 END, 4) AS {c}_slope",
                 f"round({v[2]} - {v[0]}, 4) AS {c}_trend"]
    cols += ["round(mag_2 - mag_1, 4) AS mag_velocity", "round(mag_2 - 2 * mag_1 + mag_0, 4) AS mag_acceleration",
             "round(greatest(abs(mag_2 - mag_1), abs(mag_1 - mag_0)), 4) AS mag_max_roc"]
    return ", ".join(cols)


@query("window_features", sql(WINDOWS, select=f"SELECT reading_number, sensor_id, {_features()} FROM win"))
def _(s, d):
    out = O.window_features(O.make_windows(r(s, d), gap=GAP_SENSOR))
    return rounded(out.select(*VIEW, *O.feature_names()))


@query("forecast_baselines", sql(WINDOWS, select="""SELECT reading_number, sensor_id, round(mag_2, 4) AS pred_last,
  round(2 * mag_2 - mag_1, 4) AS pred_linear, round((mag_0 + mag_1 + mag_2) / 3, 4) AS pred_mean FROM win"""))
def _(s, d):
    out = O.forecast_baselines(O.make_windows(r(s, d), gap=GAP_SENSOR))
    return rounded(out.select(*VIEW, "pred_last", "pred_linear", "pred_mean"))


@query("history_distance", sql(f"""h AS (SELECT *, list(bx) OVER w AS lx, list(b_y) OVER w AS ly, list(bz) OVER w AS lz
  FROM readings WINDOW w AS ({W} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)),
e AS (SELECT *, list_transform(range(1, len(lx) + 1), lambda i: sqrt((lx[i] - bx) * (lx[i] - bx)
  + (ly[i] - b_y) * (ly[i] - b_y) + (lz[i] - bz) * (lz[i] - bz))) AS dd FROM h),
f AS (SELECT reading_number, sensor_id, CASE WHEN len(dd) >= 20 THEN list_avg(dd) END AS m,
  CASE WHEN len(dd) >= 20 THEN list_aggregate(dd, 'quantile_cont', 0.95) END AS p FROM e)""",
    select="""SELECT reading_number, sensor_id, round(m, 4) AS history_mean, round(p, 4) AS history_p95,
  coalesce(m > p, false) AS is_far FROM f"""))
def _(s, d):
    return rounded(O.history_distance(r(s, d)).select(*VIEW, "history_mean", "history_p95", "is_far"))


@query("running_anomaly_number", sql(DET, select=f"""SELECT reading_number, sensor_id, row_number() OVER ({W}) AS reading_seq,
  sum(is_roc::INT) OVER ({W})::BIGINT AS anomaly_no FROM det"""))
def _(s, d):
    out = O.running_anomaly_number(O.rate_of_change(r(s, d), ROC_LIMIT), "is_roc")
    return out.select(*VIEW, "reading_seq", "anomaly_no")
