"""Streams over the events table, run to the end of what it holds now."""

from __future__ import annotations

from telluria.checks.base import DET, GAP_POOLED, ROC_LIMIT, F, query, r, rounded, sql, table
from telluria.operators import forest, models
from telluria.session import scratch_path
from telluria.sources.tables import as_readings
from telluria.streaming import core, detect, monitor, progress

WATERMARK = "40 days"


def _stream(s, d):
    s.conf.set("spark.sql.session.timeZone", "UTC")
    raw = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    return as_readings(raw)


@query("stream_bronze", "SELECT count(*) AS n, round(sum(value), 2) AS total FROM events")
def _(s, d):
    out = scratch_path(s, "bronze")
    schema = table(s, d, "events").schema
    core.stream_bronze(s, f"{d}/events.parquet*", schema, scratch_path(s, "progress"), out, once=True).awaitTermination()
    return s.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("stream_detect", sql(DET, select="""SELECT reading_number, sensor_id, round(z, 4) AS z, round(roc, 4) AS roc, is_z, is_roc, is_anomaly FROM det"""))
def _(s, d):
    out = core.drain(detect.stream_detect(_stream(s, d), roc_threshold=ROC_LIMIT))
    return rounded(out.select("reading_number", "sensor_id", "z", "roc", "is_z", "is_roc", "is_anomaly"))


@query("stream_sink", sql(DET, select="""SELECT reading_number, sensor_id, round(magnitude, 2) AS magnitude_measured, round(z, 4) AS anomaly_zscore,
  is_anomaly::INT AS anomaly_is_ensemble FROM det"""))
def _(s, d):
    out = scratch_path(s, "results")
    rows = detect.stream_detect(_stream(s, d), roc_threshold=ROC_LIMIT)
    core.stream_sink(rows, out, scratch_path(s, "progress"), once=True).awaitTermination()
    return s.read.parquet(out).select("reading_number", "sensor_id", "magnitude_measured", "anomaly_zscore", "anomaly_is_ensemble")


@query("stream_cutoff", sql(select="SELECT reading_number, sensor_id FROM readings WHERE mission_time_s <= 336"))
def _(s, d):
    return core.drain(core.stream_cutoff(_stream(s, d))).select("reading_number", "sensor_id")


@query("stream_score")
def _(s, d):
    found = [models.fit_kmeans(r(s, d), k=3)]
    out = core.drain(detect.stream_score(_stream(s, d), found, absent=["magnitude_rf"]))
    return out.select("reading_number", "sensor_id", "cluster_id", "magnitude_rf")


@query("stream_online_check")
def _(s, d):
    trees = forest.fit_isolation_forest(r(s, d), ["reading_number"])
    out = core.drain(detect.stream_online_check(_stream(s, d), trees))
    return out.select("reading_number", "sensor_id", "z_classic", "iso_score", "is_far", "votes", "is_anomaly")


@query("stream_progress", "SELECT 1::BIGINT AS runs, count(*) AS input_rows, 0::BIGINT AS late_rows FROM events")
def _(s, d):
    path = scratch_path(s, "progress_table")
    with progress.recording(s, path):
        core.drain(_stream(s, d))
    runs = progress.summarize_progress(progress.read_progress(s, path))
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.sum("input_rows").alias("input_rows"),
                    F.sum("late_rows").alias("late_rows"))


@query("stream_monitor", sql("""w AS (SELECT *, bx > 90 AS f, (epoch_us(event_ts) // 600000000) * 600000000 - g.i * 600000000 AS start_us
  FROM readings, range(12) g(i))""", select="""SELECT start_us, count(*) AS n, round(min(magnitude), 4) AS mag_min, round(max(magnitude), 4) AS mag_max,
  max(bx) AS z_max, max(bz) AS roc_max, count(*) FILTER (f) AS n_anomalies, round(max(mission_time_s), 6) AS last_time FROM w GROUP BY start_us"""))
def _(s, d):
    rows = _stream(s, d).withColumns({"z": F.col("bx"), "roc": F.col("bz"), "is_anomaly": F.col("bx") > 90})
    out = core.drain(monitor.stream_monitor(rows, "7200 seconds", "600 seconds", watermark=WATERMARK), "complete")
    return rounded(rounded(out.drop("flight_id"), 4, "mag_min", "mag_max"), 6, "last_time")


@query("stream_throughput", sql(select="""SELECT (epoch_us(event_ts) // 3600000000) * 3600000000 AS start_us, count(*) AS n, round(count(*) / 3600.0, 6) AS hz,
  count(*) FILTER (bx > 90) AS n_anomalies FROM readings GROUP BY 1"""))
def _(s, d):
    rows = _stream(s, d).withColumn("is_anomaly", F.col("bx") > 90)
    out = core.drain(monitor.stream_throughput(rows, 3600, watermark=WATERMARK), "complete")
    return rounded(out.select("start_us", "n", "hz", "n_anomalies"), 6, "hz")


@query("stream_sessions", sql(f"""k AS (SELECT epoch_us(event_ts) AS u, epoch_us(event_ts) - lag(epoch_us(event_ts)) OVER (ORDER BY event_ts) AS g FROM readings),
q AS (SELECT *, sum(CASE WHEN g >= {int(GAP_POOLED)} * 1000000 THEN 1 ELSE 0 END) OVER (ORDER BY u ROWS UNBOUNDED PRECEDING) AS z FROM k)""",
    select="SELECT count(*) AS n, min(u) AS first_us, max(u) AS last_us FROM q GROUP BY z"))
def _(s, d):
    out = monitor.stream_sessions(_stream(s, d), f"{int(GAP_POOLED)} seconds", watermark=WATERMARK)
    return core.drain(out, "complete").drop("flight_id")


@query("stream_retrain")
def _(s, d):
    path = scratch_path(s, "models")

    def save(found, number):
        for name, model in found.items():
            if model is not None:
                model.write().overwrite().save(f"{path}/{name}")

    q = monitor.stream_retrain(_stream(s, d), lambda: r(s, d), save, scratch_path(s, "progress"), trees=5, depth=5, once=True)
    q.awaitTermination()
    from pyspark.ml import PipelineModel
    return models.cluster_centers(s, PipelineModel.load(f"{path}/clusters"))
