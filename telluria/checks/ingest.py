"""Sources and sinks (survey 2.1, 2.2) on text that Spark derives from events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from telluria import sinks
from telluria.checks.base import DET, GAP_POOLED, ROC_LIMIT, W, F, query, r, rounded, sql
from telluria.operators import aggregates as A
from telluria.operators import anomaly
from telluria.operators import projections as P
from telluria.operators import windows as O
from telluria.session import scratch_path
from telluria.sources import csv, files, logs

# What row number modulo ten becomes in the text log; see ``log_lines``.
EVENT_TEXTS = ("Launch detected", "Heartbeat ok", "Time to launch 30", "Motor relay error", "Sample 12 stored",
               "Skirt deploy", "Stepper on", "Pressure sensor ready", "Polling bus", "System nominal",
               "TDL: none", "Apogee passed")


def log_lines(s, d) -> DataFrame:
    """The events as an interleaved log of four files: magnetometer, pressure,
    four-line and two-line records with faults, messages, result lines."""
    rows = r(s, d)
    m, u = F.col("reading_number") % 10, F.col("by").cast("long")
    t = F.floor("mission_time_s")
    head = F.concat(F.lit("T"), F.when(t > 0, "+").otherwise(""), t.cast("string"), F.lit(":  "))
    stamp = F.concat(F.lit(" ( "), F.date_format("event_ts", "EEE MMM d HH:mm:ss yyyy"), F.lit(" )"))
    v, k = F.col("bx").cast("string"), F.col("bz").cast("string")
    message = F.element_at(F.array(*[F.lit(x) for x in EVENT_TEXTS]), (u % 12 + 1).cast("int"))
    c, L = F.concat, F.lit
    number = F.col("reading_number").cast("string")
    body = (
        F.when(m == 0, c(L("|"), number, L("|: Magneto #"), F.col("sensor_id").cast("string"), L(" X:   "),
                         F.col("bx").cast("long").cast("string"), L(" Y: -"), u.cast("string"), L(" Z: "),
                         F.col("bz").cast("long").cast("string"), stamp))
        .when(m == 1, c(L("Pressure: "), v, L(" mbar"), stamp))
        .when((m == 2) | ((m == 3) & (u % 5 == 0)), c(L("a0: "), v, stamp))
        .when(m == 3, c(L("a1: "), v)).when(m == 4, c(L("a2:\t"), v))
        .when((m == 5) & (u % 7 == 0), L("noise")).when(m == 5, c(L("a3: "), v))
        .when(m == 6, c(L("Tc 0: "), v, L(" C "), k, L(" F"), stamp))
        .when((m == 7) & (u % 4 == 0), c(L("Tc 1: -"), v, L(" C "), k, L(" F"), stamp))
        .when(m == 7, c(L("Tc 1: "), v, L(" C "), k, L(" F")))
        .when(m == 8, c(message, stamp))
        .when(u % 2 == 0, c(L("|"), number, L("|: Magneto #1 no reading"), stamp))
        .otherwise(c(L("|"), number, L("|: ML |B|="), v, stamp)))
    path = c(L("log"), (F.floor(F.col("reading_number") / 10) % 4).cast("string"))
    return logs.clean_lines(rows.select(path.alias("path"), F.col("reading_number").alias("line_no"),
                                        c(head, body).alias("line")))


LOG = """lg AS (SELECT 'log' || (reading_number // 10 % 4) AS path, reading_number AS line_no, reading_number % 10 AS m,
  b_y::BIGINT AS u, floor(mission_time_s)::INT AS t, strftime(event_ts, '%a %b %-d %H:%M:%S %Y') AS st, * FROM readings)"""


@query("clean_log_lines", sql(LOG, select="SELECT path, count(*) AS n, count(*) FILTER (m = 5 AND u % 7 = 0) AS n_noise FROM lg GROUP BY path"))
def _(s, d):
    return log_lines(s, d).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("line").endswith("noise")).alias("n_noise"))


@query("read_log_lines", sql(LOG, select="SELECT count(*) AS n, count(*) AS n_lines FROM lg"))
def _(s, d):
    path = scratch_path(s, "log")
    sinks.write_log(log_lines(s, d), path, ["path", "line_no"])
    back = logs.read_log_lines(s, path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path", "line_no").alias("n_lines"))


@query("parse_magnetometer", sql(LOG, select="""SELECT path, line_no, t AS time_mission, reading_number, sensor_id, trunc(bx)::INT AS x,
  (-u)::INT AS y, trunc(bz)::INT AS z, st AS timestamp_str, epoch(date_trunc('second', event_ts))::BIGINT AS event_s,
  round(sqrt(trunc(bx) ^ 2 + u ^ 2 + trunc(bz) ^ 2), 4) AS magnitude FROM lg WHERE m = 0"""))
def _(s, d):
    out = logs.parse_magnetometer(logs.classify(log_lines(s, d)))
    return rounded(out.withColumn("event_s", F.unix_seconds("event_ts")).drop("event_ts"))


@query("parse_pressure", sql(LOG, select="SELECT path, line_no, t AS time_mission, bx AS pressure_mbar, st AS timestamp_str FROM lg WHERE m = 1"))
def _(s, d):
    return logs.parse_pressure(logs.classify(log_lines(s, d)))


# The latest opening line before each closing line, unless another record closed since.
ADC = LOG + """,
ad AS (SELECT *, CASE WHEN m = 2 OR (m = 3 AND u % 5 = 0) THEN 0 ELSE m - 2 END AS ch FROM lg WHERE m BETWEEN 2 AND 5 AND NOT (m = 5 AND u % 7 = 0)),
cl AS (SELECT path, line_no AS c, lag(line_no, 1, -1) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM ad WHERE ch = 3),
op AS (SELECT cl.path, c, max(line_no) AS o FROM cl JOIN ad ON ad.path = cl.path AND ch = 0 AND line_no > prev AND line_no < c GROUP BY ALL),
rec AS (SELECT op.path, o AS line_no, arg_max(t, line_no) FILTER (line_no = o) AS time_mission, arg_max(st, line_no) FILTER (line_no = o) AS timestamp_str,
  arg_max(bx, line_no) FILTER (ch = 0) AS a0, arg_max(bx, line_no) FILTER (ch = 1) AS a1, arg_max(bx, line_no) FILTER (ch = 2) AS a2,
  arg_max(bx, line_no) FILTER (ch = 3) AS a3 FROM op JOIN ad ON ad.path = op.path AND line_no BETWEEN o AND c GROUP BY op.path, o)"""


@query("parse_adc", sql(ADC, select="SELECT path, line_no, time_mission, a0, a1, a2, a3, timestamp_str FROM rec"))
def _(s, d):
    return logs.parse_adc(logs.classify(log_lines(s, d)))


THERMO = LOG + """,
tc AS (SELECT * FROM lg WHERE m = 6 OR (m = 7 AND u % 4 <> 0)),
tr AS (SELECT *, lead(m) OVER o AS m1, lead(bx) OVER o AS c1, lead(bz) OVER o AS f1 FROM tc WINDOW o AS (PARTITION BY path ORDER BY line_no))"""


@query("parse_thermocouple", sql(THERMO, select="""SELECT path, line_no, t AS time_mission, bx AS tc0_C, bz AS tc0_F, c1 AS tc1_C, f1 AS tc1_F,
  st AS timestamp_str FROM tr WHERE m = 6 AND m1 = 7"""))
def _(s, d):
    return logs.parse_thermocouple(logs.classify(log_lines(s, d)))


EVENTS = LOG + """,
ev AS (SELECT path, line_no, t AS time_mission, st AS timestamp_str, CASE
  WHEN m = 8 THEN list_extract([""" + ", ".join(f"'{x}'" for x in EVENT_TEXTS) + """], (u % 12 + 1)::INT)
  WHEN m = 7 THEN 'Tc 1: -' || bx::VARCHAR || ' C ' || bz::VARCHAR || ' F'
  ELSE '|' || reading_number || '|: ML |B|=' || bx::VARCHAR END AS event
  FROM lg WHERE m = 8 OR (m = 7 AND u % 4 = 0) OR (m = 9 AND u % 2 = 1))"""


@query("parse_events", sql(EVENTS, select="SELECT path, line_no, time_mission, event, timestamp_str FROM ev"))
def _(s, d):
    return logs.parse_events(logs.classify(log_lines(s, d)))


@query("parse_telemetry", sql(ADC, THERMO.replace(LOG + ",", ""), EVENTS.replace(LOG + ",", ""), select="""
SELECT 'magneto' AS record_type, count(*) AS n FROM lg WHERE m = 0 UNION ALL SELECT 'pressure', count(*) FROM lg WHERE m = 1
UNION ALL SELECT 'adc', count(*) FROM rec UNION ALL SELECT 'thermo', count(*) FROM tr WHERE m = 6 AND m1 = 7
UNION ALL SELECT 'events', count(*) FROM ev"""))
def _(s, d):
    return logs.parse_telemetry(log_lines(s, d), store=scratch_path(s, "typed")).counts()


SKIP = """CASE WHEN event = 'Heartbeat ok' THEN 'heartbeat' WHEN event = 'Time to launch 30' THEN 'time to launch'
  WHEN event = 'Sample 12 stored' THEN 'sample' WHEN event = 'Polling bus' THEN 'polling' WHEN event = 'TDL: none' THEN 'tdl: none' END"""


def _events(s, d):
    return logs.parse_events(logs.classify(log_lines(s, d)))


@query("filter_events", sql(EVENTS, select=f"SELECT path, line_no, event FROM ev WHERE ({SKIP}) IS NULL"))
def _(s, d):
    return P.filter_events(_events(s, d)).select("path", "line_no", "event")


@query("categorize_event", sql(EVENTS, select="""SELECT path, line_no, CASE WHEN event IN ('Motor relay error') THEN 'Warning/Error'
  WHEN event IN ('Launch detected', 'Time to launch 30', 'Skirt deploy', 'Apogee passed') THEN 'Milestone'
  WHEN event = 'Stepper on' THEN 'Actuator' WHEN event IN ('Pressure sensor ready', 'TDL: none') THEN 'Sensor'
  ELSE 'System' END AS category FROM ev"""))
def _(s, d):
    return P.categorize_events(_events(s, d)).select("path", "line_no", "category")


@query("dedupe_events", sql(EVENTS, select=f"""SELECT path, line_no, event FROM (SELECT *, row_number() OVER (
  PARTITION BY path, day, left(event, 30) ORDER BY line_no) AS k FROM (SELECT *, floor(time_mission / 86400.0) AS day FROM ev
  WHERE ({SKIP}) IS NULL)) WHERE k = 1"""))
def _(s, d):
    rows = P.filter_events(_events(s, d)).withColumn("day", F.floor(F.col("time_mission") / 86400.0))
    return O.dedupe_events(rows, t="day").select("path", "line_no", "event")


@query("skipped_event_counts", sql(EVENTS, select=f"""SELECT {SKIP} AS skip_key, count(*) AS n FROM ev
  WHERE ({SKIP}) IS NOT NULL GROUP BY 1 ORDER BY n DESC, skip_key LIMIT 5"""))
def _(s, d):
    return A.skipped_event_counts(P.with_skip_key(_events(s, d)))


CUT = """b AS (SELECT path, greatest(0.0, min({t})::DOUBLE) AS s, max({t})::DOUBLE AS e FROM {src} GROUP BY path),
cut AS (SELECT path, CASE WHEN e - s > 60 THEN s + (e - s) * 0.95 ELSE e END AS c FROM b)"""


@query("clean_temperature", sql(THERMO, "th AS (SELECT path, line_no, t AS tm, bx AS a, c1 AS b FROM tr WHERE m = 6 AND m1 = 7)",
    CUT.format(t="tm", src="th").replace("b AS", "bb AS").replace("FROM b)", "FROM bb)"), select="""SELECT path, line_no,
  CASE WHEN tm <= c AND abs(a) >= 0.5 THEN a END AS tc0_C, CASE WHEN tm <= c AND abs(b) >= 0.5 THEN b END AS tc1_C,
  CASE WHEN tm > c THEN 'shutdown' WHEN abs(a) < 0.5 THEN 'zero' END AS tc0_C_removed FROM th JOIN cut USING (path)"""))
def _(s, d):
    rows = logs.parse_thermocouple(logs.classify(log_lines(s, d)))
    return P.clean_temperature(rows).select("path", "line_no", "tc0_C", "tc1_C", "tc0_C_removed")


@query("temperature_summary", sql(THERMO, """th AS (SELECT path, unnest(['tc0_C', 'tc1_C']) AS channel, unnest([bx, c1]) AS v FROM tr WHERE m = 6 AND m1 = 7),
ok AS (SELECT path, channel, CASE WHEN v > 1 AND v < 100 THEN v END AS v FROM th)""", select="""SELECT path, channel, count(v) AS n,
  min(v) AS t_min, max(v) AS t_max, round(max(v) - min(v), 4) AS delta FROM ok GROUP BY ALL"""))
def _(s, d):
    rows = logs.parse_thermocouple(logs.classify(log_lines(s, d)))
    return rounded(A.temperature_summary(rows), 4, "delta")


@query("pressure_summary", sql(LOG, select="""SELECT path, count(*) AS n, min(bx) AS p_min, max(bx) AS p_max, min(t)::DOUBLE AS t_first,
  max(t)::DOUBLE AS t_last, coalesce(min(bx) FILTER (t > 60), min(bx)) AS p_floor FROM lg WHERE m = 1 GROUP BY path"""))
def _(s, d):
    return A.pressure_summary(logs.parse_pressure(logs.classify(log_lines(s, d))))


@query("pressure_levels", sql(LOG, """w AS (SELECT path, min(bx) AS p_low, max(bx) AS p_high FROM lg
  WHERE m = 1 AND t BETWEEN -100000 AND 100000 GROUP BY path)""", select="""SELECT path, p_low, p_high, mbar, altitude FROM w
  JOIN (VALUES (1013.0::DOUBLE, '~0 km (sea level)'), (500.0, '~5.5 km'), (200.0, '~12 km (tropopause)'), (50.0, '~21 km (stratosphere)')) l(mbar, altitude)
  ON mbar BETWEEN p_low AND p_high"""))
def _(s, d):
    return A.pressure_levels(logs.parse_pressure(logs.classify(log_lines(s, d))), first=-1e5, last=1e5)


# CSV layouts

def _legacy_text(s, d) -> DataFrame:
    rows = r(s, d)
    c, L = F.concat, F.lit
    u = F.col("by").cast("long")
    name = F.when(u % 9 == 0, L("Pressure")).otherwise(c(L("Magneto #"), (F.col("sensor_id") + 1).cast("string")))
    x = F.when(u % 11 == 0, L("bad")).otherwise(F.col("bx").cast("long").cast("string"))
    return rows.select(c(F.floor("mission_time_s").cast("string"), L(",|0|:,"), name, L(",X:,"), x, L(",Y:,-"), u.cast("string"),
                         L(",Z:,"), F.col("bz").cast("long").cast("string"), L(",( "), F.date_format("event_ts", "EEE MMM d HH:mm:ss yyyy"), L(" )")).alias("value"))


@query("read_legacy_csv", sql(select="""SELECT floor(mission_time_s)::INT AS "Time", sensor_id AS "Sensor", trunc(bx)::INT AS "X",
  (-b_y)::INT AS "Y", trunc(bz)::INT AS "Z", round(sqrt(trunc(bx) ^ 2 + b_y ^ 2 + bz ^ 2), 4) AS "Magnitude" FROM readings
  WHERE b_y::BIGINT % 9 <> 0 AND b_y::BIGINT % 11 <> 0"""))
def _(s, d):
    path = scratch_path(s, "legacy")
    _legacy_text(s, d).write.text(path)
    return rounded(csv.read_legacy_csv(s, path))


@query("detect_format")
def _(s, d):
    path = scratch_path(s, "formats")
    _legacy_text(s, d).write.text(f"{path}/a")
    r(s, d).select("mission_time_s", "sensor_id").write.option("header", "true").csv(f"{path}/b")
    return csv.detect_format(s, f"{path}/*").groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query("read_flight_csv", sql(select="""SELECT round(mission_time_s, 6) AS mission_time_s, sensor_id, bx AS bx_raw, bz AS bz_raw,
  round(magnitude, 4) AS magnitude_measured FROM readings"""))
def _(s, d):
    path = scratch_path(s, "flight")
    r(s, d).select(F.col("mission_time_s").alias("T"), F.lit(0).alias("Time"), F.col("sensor_id").alias("Sensor"),
                   F.col("bx").alias("X"), F.col("by").alias("Y"), F.col("bz").alias("Z"),
                   F.when(F.col("reading_number") % 3 == 0, F.lit("NaN")).otherwise(F.col("magnitude").cast("string")).alias("Magnitude")
                   ).write.option("header", "true").csv(path)
    out = csv.read_flight_csv(s, path)
    out = out.select("mission_time_s", "sensor_id", "bx_raw", "bz_raw", "magnitude_measured")
    return rounded(rounded(out, 6, "mission_time_s"), 4, "magnitude_measured")


@query("read_raw_readings", sql(select="""SELECT sensor_id, count(*) AS n, round(sum(magnitude), 2) AS magnitude_sum FROM readings GROUP BY sensor_id"""))
def _(s, d):
    path = scratch_path(s, "raw")
    r(s, d).select((F.unix_micros("event_ts") / F.lit(1e6)).alias("timestamp_unix"), "sensor_id", F.col("bx").alias("bx_raw"),
                   F.col("by").alias("by_raw"), F.col("bz").alias("bz_raw")).write.option("header", "true").csv(path)
    out = csv.read_raw_readings(s, path)
    return out.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("magnitude"), 2).alias("magnitude_sum"))


@query("relative_raw_readings", sql(select="""SELECT reading_number // 1000 AS part, sensor_id, round(epoch_us(event_ts) / 1e6
  - first_value(epoch_us(event_ts) / 1e6) OVER (PARTITION BY reading_number // 1000 ORDER BY reading_number), 4) AS mission_time_s,
  round(magnitude, 4) AS magnitude FROM readings"""))
def _(s, d):
    rows = r(s, d).select(F.floor(F.col("reading_number") / 1000).alias("part"), "sensor_id", F.col("reading_number").alias("_position"),
                          (F.unix_micros("event_ts") / F.lit(1e6)).alias("timestamp_unix"), F.col("bx").alias("bx_raw"),
                          F.col("by").alias("by_raw"), F.col("bz").alias("bz_raw"))
    return rounded(csv.relative_raw_readings(rows, ["part"]).select("part", "sensor_id", "mission_time_s", "magnitude"))


def _boots(s, d):
    """Result rows of several boots: the mission clock restarts in each file."""
    rows = r(s, d).withColumn("boot", F.floor((F.col("mission_time_s") + 1.5e6) / 5e5))
    return rows.select("flight_id", F.concat(F.lit("boot_"), F.col("boot").cast("string")).alias("path"), "reading_number",
                       (F.unix_micros("event_ts") / F.lit(1e6)).alias("timestamp_unix"),
                       (F.col("mission_time_s") + 1.5e6 - F.col("boot") * 5e5 - 150).alias("mission_time_s"), "magnitude")


BOOTS = """bt AS (SELECT *, floor((mission_time_s + 1.5e6) / 5e5) AS boot, epoch_us(event_ts) / 1e6 AS u FROM readings),
mt AS (SELECT *, mission_time_s + 1.5e6 - boot * 5e5 - 150 AS own FROM bt)"""


@query("merge_sessions", sql(BOOTS, select="""SELECT reading_number, (dense_rank() OVER (ORDER BY 'boot_' || boot::BIGINT) - 1)::INT AS boot_id,
  round(first_value(own) OVER o + (u - first_value(u) OVER o), 6) AS mission_time_s FROM mt WINDOW o AS (ORDER BY u, reading_number)"""))
def _(s, d):
    rows, _ = csv.merge_sessions(_boots(s, d), threshold=GAP_POOLED)
    return rounded(rows.select("reading_number", "boot_id", "mission_time_s"), 6)


@query("merge_sessions_gaps", sql(BOOTS, """rb AS (SELECT u, reading_number, first_value(own) OVER o + (u - first_value(u) OVER o) AS t, u - lag(u) OVER o AS gap
  FROM mt WINDOW o AS (ORDER BY u, reading_number)),
sn AS (SELECT *, sum(CASE WHEN gap > 1200 THEN 1 ELSE 0 END) OVER (ORDER BY u, reading_number)::BIGINT AS session FROM rb)""",
    select="""SELECT session, count(*) AS n_rows, round(min(u) * 1e6)::BIGINT AS t_first_us, round(max(u) * 1e6)::BIGINT AS t_last_us,
  round(arg_min(t, row(u, reading_number)), 4) AS mission_time_first, round(max(CASE WHEN gap > 1200 THEN gap - 1 / 45.0 END), 4) AS missing_s
  FROM sn GROUP BY session"""))
def _(s, d):
    sessions = csv.merge_sessions(_boots(s, d), threshold=GAP_POOLED)[1].drop("flight_id")
    sessions = sessions.withColumn("session", F.col("session").cast("long"))
    for c in ("t_first", "t_last"):  # whole microseconds: decimals of a Unix time are beyond a double's rounding
        sessions = sessions.withColumn(f"{c}_us", F.round(F.col(c) * 1e6).cast("long")).drop(c)
    return rounded(sessions)


def _named_files(s, d) -> DataFrame:
    """A listing as the file source reports it, derived from the events: forty
    files a folder, some results without a raw capture of their stamp."""
    n = F.col("reading_number")
    part, raw = n % 10, F.floor(n / 10) % 3 > 0
    kind = (F.when(part == 0, "flight_data_").when((part == 2) & raw, "flight_raw_sensors_").when(part == 4, "sim_data_")
            .when((part == 6) & raw, "sim_raw_sensors_").otherwise(F.concat(F.lit("notes"), part.cast("string"), F.lit("_"))))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.floor(n / 10) * 60), "yyyyMMdd_HHmmss")
    name = F.when(n % 120 == 1, "cam_raw_sensors_latest.csv").otherwise(F.concat(kind, stamp, F.lit(".csv")))
    folder = F.concat(F.lit("/data/"), F.floor(n / 40).cast("string"), F.lit("/"))
    return r(s, d).select(F.concat(folder, name).alias("path"), name.alias("name"),
                          (F.col("bx") * 20).cast("long").alias("length"), F.col("event_ts").alias("modified"))


FILES = """ev AS (SELECT reading_number AS n, reading_number % 10 AS m, event_ts, trunc(bx * 20) AS len,
  (reading_number // 10) % 3 > 0 AS has, '/data/' || reading_number // 40 || '/' AS folder,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(reading_number // 10), '%Y%m%d_%H%M%S') AS st FROM readings),
fl AS (SELECT *, CASE WHEN n % 120 = 1 THEN 'cam_raw_sensors_latest.csv' ELSE CASE WHEN m = 0 THEN 'flight_data_'
  WHEN m = 2 AND has THEN 'flight_raw_sensors_' WHEN m = 4 THEN 'sim_data_' WHEN m = 6 AND has THEN 'sim_raw_sensors_'
  ELSE 'notes' || m || '_' END || st || '.csv' END AS name FROM ev)"""


@query("select_inputs", sql(FILES, select="""SELECT folder || name AS path, row_number() OVER (ORDER BY event_ts DESC, folder || name) AS choice
  FROM fl WHERE name LIKE 'flight\\_data\\_%' ESCAPE '\\' AND len > 300"""))
def _(s, d):
    return files.select_inputs(_named_files(s, d)).select("path", F.col("choice").cast("long").alias("choice"))


@query("pair_companions", sql(FILES, """res AS (SELECT folder, folder || name AS result_path, split_part(name, '_', 1) AS px, st FROM fl WHERE name LIKE '%\\_data\\_%' ESCAPE '\\'),
raw AS (SELECT folder, folder || name AS raw_path, split_part(name, '_', 1) AS px, st, len, event_ts, name LIKE '%latest%' AS newer FROM fl WHERE name LIKE '%\\_raw\\_%' ESCAPE '\\'),
nw AS (SELECT folder, raw_path AS newest FROM raw WHERE len > 100
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY newer DESC, event_ts DESC, raw_path DESC) = 1)""", select="""SELECT result_path,
  coalesce(raw_path, newest) AS raw_path, raw_path IS NOT NULL AS same_stamp FROM res
  LEFT JOIN (SELECT * FROM raw WHERE NOT newer) raw USING (folder, px, st) LEFT JOIN nw USING (folder)"""))
def _(s, d):
    return files.pair_companions(_named_files(s, d))


@query("list_files", sql(select="SELECT sensor_id, 1::BIGINT AS n_files, true AS filled FROM readings GROUP BY sensor_id"))
def _(s, d):
    path = scratch_path(s, "listed")
    r(s, d).select("sensor_id", "bx").repartition("sensor_id").write.partitionBy("sensor_id").csv(path)
    found = files.list_files(s, path).where(F.col("name").startswith("part-"))
    sensor = F.regexp_extract("path", r"sensor_id=(\d+)/", 1).cast("int").alias("sensor_id")
    return found.groupBy(sensor).agg(F.count(F.lit(1)).alias("n_files"), (F.min("length") > 0).alias("filled"))


# Sinks

@query("write_readings", sql(DET, select="""SELECT round(epoch_us(event_ts) / 1e6, 6) AS timestamp_unix, round(mission_time_s::DECIMAL(18, 6), 4)::DOUBLE AS mission_time_s,
  sensor_id, round(magnitude, 2) AS magnitude_measured, round(z, 4) AS anomaly_zscore, is_z::INT AS anomaly_is_zscore,
  is_roc::INT AS anomaly_is_roc, is_anomaly::INT AS anomaly_is_ensemble, round(roc, 2) AS anomaly_rate_of_change, reading_number FROM det"""))
def _(s, d):
    path = scratch_path(s, "results")
    sinks.write_readings(anomaly.detect_flight(r(s, d), roc_threshold=ROC_LIMIT), path)
    return s.read.parquet(path).select(
        "timestamp_unix", "mission_time_s", "sensor_id", "magnitude_measured", "anomaly_zscore", "anomaly_is_zscore",
        "anomaly_is_roc", "anomaly_is_ensemble", "anomaly_rate_of_change", "reading_number")


PREFIX = """'T' || CASE WHEN round_even(mission_time_s, 0) > 0 THEN '+' ELSE '' END || round_even(mission_time_s, 0)::BIGINT || ': |' || reading_number || '|: '"""
STAMP = "' ( ' || strftime(event_ts, '%a %b ') || lpad(strftime(event_ts, '%-d'), 2, ' ') || strftime(event_ts, ' %H:%M:%S %Y') || ' )'"


@query("render_magneto_lines", sql(select=f"""SELECT {PREFIX} || 'Magneto #' || sensor_id || ' X: ' || trunc(bx)::BIGINT || ' Y: '
  || trunc(b_y)::BIGINT || ' Z: ' || trunc(bz)::BIGINT || {STAMP} AS line FROM readings"""))
def _(s, d):
    return sinks.render_magneto_lines(r(s, d)).select("line")


@query("render_result_lines", sql(DET, f"nu AS (SELECT *, sum(is_anomaly::INT) OVER ({W}) AS an FROM det)", select=f"""SELECT {PREFIX} || 'ML'
  || CASE WHEN is_anomaly THEN ' ANOMALY#' || an::BIGINT ELSE '' END || ' |B|=' || printf('%.1f', magnitude) || ' RF=--- NN=--- C=- Z='
  || printf('%.2f', z) || ' RoC=' || printf('%.1f', roc) || {STAMP} AS line FROM nu"""))
def _(s, d):
    rows = O.running_anomaly_number(anomaly.detect_flight(r(s, d), roc_threshold=ROC_LIMIT))
    return sinks.render_result_lines(rows).select("line")


@query("log_round_trip", sql(select="""SELECT reading_number, sensor_id, round_even(mission_time_s, 0)::INT AS time_mission, trunc(bx)::INT AS x,
  trunc(b_y)::INT AS y, trunc(bz)::INT AS z FROM readings"""))
def _(s, d):
    lines = sinks.render_magneto_lines(r(s, d)).select(F.lit("f").alias("path"), F.col("reading_number").alias("line_no"), "line")
    out = logs.parse_magnetometer(logs.classify(logs.clean_lines(lines)))
    return out.select("reading_number", "sensor_id", "time_mission", "x", "y", "z")


@query("fingerprint")
def _(s, d):
    return sinks.fingerprint(r(s, d), ["reading_number", "bx", "by", "bz"])
