"""Projections, filters and joins (survey 2.3, 2.4)."""

from __future__ import annotations

from telluria import params
from telluria.checks.base import DET, GAP_POOLED, ROC_LIMIT, WP, F, query, r, rounded, sql, table
from telluria.operators import anomaly, joins
from telluria.operators import projections as P
from telluria.sources.frames import decode_frames, encode_int24

DAY = 86400.0
MISSION = params.Mission({
    "T_SYSTEMS_START": -10 * DAY, "T_ML_START": -5 * DAY, "T_LAUNCH": 0.0, "T_APOGEE": 5 * DAY,
    "T_BURN_END": 2 * DAY, "T_SKIRT_DEPLOY": 3 * DAY, "T_EXPERIMENTS_OFF": 10 * DAY})
PHASES = (
    params.Phase("Pre-launch", hi=0.0),
    params.Phase("Launch", -DAY, DAY, True, True),
    params.Phase("Ascent", 0.0, 8 * DAY),
    params.Phase("Apogee", 7 * DAY, 9 * DAY, True, True),
    params.Phase("Descent", lo=8 * DAY),
)
PHASE_VALUES = f"""(VALUES ('Pre-launch', -1e18, 0.0, false, false), ('Launch', {-DAY}, {DAY}, true, true),
  ('Ascent', 0.0, {8 * DAY}, false, false), ('Apogee', {7 * DAY}, {9 * DAY}, true, true),
  ('Descent', {8 * DAY}, 1e18, false, false)) AS p(phase, lo, hi, lc, hc)"""
PHASE_ON = "(mission_time_s > lo OR (lc AND mission_time_s = lo)) AND (mission_time_s < hi OR (hc AND mission_time_s = hi))"


@query("with_magnitude", sql(select="SELECT reading_number, round(magnitude, 4) AS magnitude FROM readings"))
def _(s, d):
    return rounded(P.with_magnitude(r(s, d).drop("magnitude")).select("reading_number", "magnitude"))


@query("assemble_features", sql(select="""SELECT reading_number, round(bx * 20, 6) AS f0, round(b_y * 20, 6) AS f1, round(bz * 20, 6) AS f2
  FROM readings"""))
def _(s, d):
    out = P.assemble_features(r(s, d), scale=20.0)
    from pyspark.ml.functions import vector_to_array
    axes = vector_to_array("features")
    return rounded(out.select("reading_number", *[axes[i].alias(f"f{i}") for i in range(3)]), 6)


@query("filter_outliers", sql(select="SELECT reading_number, round(magnitude, 4) AS magnitude FROM readings WHERE magnitude < 120"))
def _(s, d):
    return rounded(P.filter_outliers(r(s, d), 120.0).select("reading_number", "magnitude"))


@query("validate_range", sql(select="""SELECT reading_number,
  CASE WHEN abs(bx) > 80 THEN 'x-axis value ' || bx::VARCHAR || ' exceeds range (+/-80)'
       WHEN abs(b_y) > 80 THEN 'y-axis value ' || b_y::VARCHAR || ' exceeds range (+/-80)'
       WHEN abs(bz) > 80 THEN 'z-axis value ' || bz::VARCHAR || ' exceeds range (+/-80)' END AS reason,
  NOT (abs(bx) > 80 OR abs(b_y) > 80 OR abs(bz) > 80) AS is_valid FROM readings"""))
def _(s, d):
    return P.validate_range(r(s, d), 80).select("reading_number", "reason", "is_valid")


@query("mission_phase", sql(select=f"""SELECT reading_number, CASE
  WHEN mission_time_s >= {10 * DAY} THEN 'POST_EXPERIMENT' WHEN mission_time_s >= {5 * DAY} THEN 'DESCENT'
  WHEN mission_time_s >= 0 THEN 'ASCENT' WHEN mission_time_s >= {-5 * DAY} THEN 'ML_ACTIVE'
  WHEN mission_time_s >= {-10 * DAY} THEN 'SYSTEMS_ON' ELSE 'STANDBY' END AS phase FROM readings"""))
def _(s, d):
    return P.label_mission_phase(r(s, d), MISSION).select("reading_number", "phase")


@query("format_hms", sql(select="""SELECT reading_number,
  (CASE WHEN h BETWEEN 0 AND 9 THEN '0' || h ELSE h::VARCHAR END) || ':' || printf('%02d', m) || ':' || printf('%02d', s) AS hms
  FROM (SELECT reading_number, floor(t / 3600.0)::BIGINT AS h,
    ((t % 3600 + 3600) % 3600) // 60 AS m, (t % 60 + 60) % 60 AS s
    FROM (SELECT reading_number, trunc(mission_time_s)::BIGINT AS t FROM readings))"""))
def _(s, d):
    return P.with_time_labels(r(s, d)).select("reading_number", "hms")


@query("format_tplus", sql(select="""SELECT reading_number,
  CASE WHEN mission_time_s = 0 THEN 'T0' WHEN mission_time_s > 0 THEN 'T+' || trunc(mission_time_s)::BIGINT
    ELSE 'T' || trunc(mission_time_s)::BIGINT END AS tplus,
  CASE WHEN abs(mission_time_s) < 0.5 THEN 'T0' WHEN mission_time_s > 0 THEN 'T+' || round_even(mission_time_s, 0)::BIGINT
    ELSE 'T' || round_even(mission_time_s, 0)::BIGINT END AS tplus_live FROM readings"""))
def _(s, d):
    return P.with_time_labels(r(s, d)).select("reading_number", "tplus", "tplus_live")


@query("rebase_mission_time", sql(select=f"""SELECT reading_number,
  round(first_value(mission_time_s) OVER ({WP}) + (epoch_us(event_ts) / 1e6
    - first_value(epoch_us(event_ts) / 1e6) OVER ({WP})), 6) AS mission_time_s FROM readings"""))
def _(s, d):
    rows = r(s, d).withColumn("timestamp_unix", F.unix_micros("event_ts") / F.lit(1e6))
    return rounded(P.rebase_mission_time(rows).select("reading_number", "mission_time_s"), 6)


@query("standardize", sql("""m AS (SELECT avg(bx) a, stddev_pop(bx) sa, avg(b_y) b, stddev_pop(b_y) sb,
  avg(bz) c, stddev_pop(bz) sc FROM readings)""", select="""SELECT reading_number, round((bx - a) / sa, 4) AS bx_std,
  round((b_y - b) / sb, 4) AS by_std, round((bz - c) / sc, 4) AS bz_std FROM readings, m"""))
def _(s, d):
    return rounded(P.standardize(r(s, d)).select("reading_number", "bx_std", "by_std", "bz_std"))


@query("minmax_time", sql(select="""SELECT reading_number, round((mission_time_s - min(mission_time_s) OVER w)
  / (max(mission_time_s) OVER w - min(mission_time_s) OVER w + 1e-8), 6) AS time_scaled
  FROM readings WINDOW w AS (PARTITION BY flight_id, sensor_id)"""))
def _(s, d):
    return rounded(P.minmax_time(r(s, d)).select("reading_number", "time_scaled"), 6)


FLIGHT_WINDOW = """b AS (SELECT greatest(0.0, min(mission_time_s)) AS t_start, max(mission_time_s) AS t_end FROM readings),
c AS (SELECT *, CASE WHEN t_end - t_start > 60 THEN t_start + (t_end - t_start) * 0.95 ELSE t_end END AS t_cutoff FROM b)"""


@query("flight_window", sql(FLIGHT_WINDOW, select="""SELECT reading_number, sensor_id FROM readings, c
  WHERE mission_time_s BETWEEN t_start AND t_cutoff"""))
def _(s, d):
    return P.flight_window(r(s, d)).select("reading_number", "sensor_id")


@query("flight_window_counts", sql(FLIGHT_WINDOW, select="""SELECT round(t_start, 6) AS t_start, round(t_end, 6) AS t_end,
  round(t_cutoff, 6) AS t_cutoff, count(*) FILTER (mission_time_s BETWEEN t_start AND t_cutoff) AS n_kept,
  count(*) FILTER (NOT mission_time_s BETWEEN t_start AND t_cutoff) AS n_removed FROM readings, c GROUP BY ALL"""))
def _(s, d):
    return rounded(P.flight_window_counts(r(s, d)).drop("flight_id"), 6)


@query("after_last_gap", sql(f"""t AS (SELECT mission_time_s AS t, lead(mission_time_s) OVER (ORDER BY mission_time_s) AS e
  FROM (SELECT DISTINCT mission_time_s FROM readings)),
g AS (SELECT max(e) AS e FROM t WHERE e - t > {GAP_POOLED})""", select="""SELECT reading_number, sensor_id FROM readings, g
  WHERE mission_time_s > coalesce(greatest(0.0, e - 5.0), 0.0)"""))
def _(s, d):
    return P.after_last_gap(r(s, d), GAP_POOLED).select("reading_number", "sensor_id")


@query("experiment_cutoff", sql(select="SELECT reading_number FROM readings WHERE mission_time_s <= 336"))
def _(s, d):
    return P.experiment_cutoff(r(s, d)).select("reading_number")


@query("sensor_label", sql(select="""SELECT reading_number, CASE WHEN sensor_id <= 3
  THEN 'RM3100 #' || sensor_id || ' (MUX Ch' || sensor_id || ')' ELSE 'RM3100 #' || sensor_id END AS sensor_label FROM readings"""))
def _(s, d):
    return P.with_sensor_label(r(s, d)).select("reading_number", "sensor_label")


@query("decode_frames", """SELECT l_orderkey, l_linenumber, (l_partkey - 1000)::INT AS x,
  (l_suppkey * -37)::INT AS y, ((l_quantity * 1000)::BIGINT - 20000)::INT AS z FROM lineitem""")
def _(s, d):
    li = table(s, d, "lineitem")
    frame = F.concat(encode_int24(F.col("l_partkey") - 1000), encode_int24(F.col("l_suppkey") * -37),
                     encode_int24((F.col("l_quantity") * 1000).cast("long") - 20000))
    return decode_frames(li.withColumn("frame", frame)).select("l_orderkey", "l_linenumber", "x", "y", "z")


@query("label_mission_events", sql(DET, select=f"""SELECT reading_number, CASE
  WHEN abs(mission_time_s - 0) < 5000 THEN 'LAUNCH_TRANSIENT'
  WHEN abs(mission_time_s - {2 * DAY}) < 5000 THEN 'MOTOR_BURNOUT_TRANSIENT'
  WHEN abs(mission_time_s - {3 * DAY}) < 5000 THEN 'NOSECONE_SEPARATION'
  WHEN abs(mission_time_s - {5 * DAY}) < 5000 THEN 'APOGEE_REGION'
  WHEN z > 2 THEN 'EXTREME_OUTLIER' ELSE 'UNKNOWN' END AS event_label FROM det"""))
def _(s, d):
    rows = anomaly.detect_flight(r(s, d), roc_threshold=ROC_LIMIT)
    return joins.label_mission_events(rows, MISSION, 5000.0, extreme=2.0).select("reading_number", "event_label")


@query("label_phases", sql(select=f"""SELECT phase, reading_number FROM readings JOIN {PHASE_VALUES} ON {PHASE_ON}"""))
def _(s, d):
    return joins.label_phases(r(s, d), PHASES).select("phase", "reading_number")


@query("attach_scalars", sql(select="""SELECT reading_number, round(avg(magnitude) OVER w, 4) AS mag_avg,
  round(max(magnitude) OVER w, 4) AS mag_max FROM readings WINDOW w AS (PARTITION BY flight_id, sensor_id)"""))
def _(s, d):
    rows = joins.attach_scalars(r(s, d), [F.avg("magnitude").alias("mag_avg"), F.max("magnitude").alias("mag_max")])
    return rounded(rows.select("reading_number", "mag_avg", "mag_max"))


@query("overlay_sensors", sql(select="""SELECT floor(mission_time_s / 3600) * 3600.0 AS time_slot, """ + ", ".join(
    f"round(avg(magnitude) FILTER (sensor_id = {i}), 4) AS sensor_{i}" for i in range(5))
    + " FROM readings GROUP BY time_slot"))
def _(s, d):
    return rounded(joins.overlay_sensors(r(s, d), range(5), 3600.0).drop("flight_id"))
