"""Grouped statistics (survey 2.5) and model arithmetic with an SQL form."""

from __future__ import annotations

from telluria.checks.base import (DET, ROC_LIMIT, SCORED, W, F, query, r, rounded, scored, sql, table)
from telluria.checks.rows import PHASE_ON, PHASE_VALUES, PHASES
from telluria.operators import aggregates as A
from telluria.operators import anomaly
from telluria.operators import windows as O

FLAGS = ["is_z", "is_roc", "is_anomaly"]


def _det(s, d):
    return anomaly.detect_flight(r(s, d), roc_threshold=ROC_LIMIT)


@query("resample_mean", sql(select="""SELECT sensor_id, floor(mission_time_s / 7200) * 7200.0 AS time, round(avg(bx), 5) AS bx,
  round(avg(bz), 5) AS bz, round(avg(magnitude), 5) AS magnitude, count(*) AS n FROM readings GROUP BY ALL"""))
def _(s, d):
    return rounded(A.resample_mean(r(s, d), 7200.0).select("sensor_id", "time", "bx", "bz", "magnitude", "n"), 5)


@query("avg_by_time", sql(select="""SELECT floor(mission_time_s / 3600) * 3600.0 AS mission_time_s, round(avg(magnitude), 5) AS magnitude,
  bool_or(bx > 90) AS high FROM readings GROUP BY 1"""))
def _(s, d):
    rows = r(s, d).withColumns({"mission_time_s": F.floor(F.col("mission_time_s") / 3600) * F.lit(3600.0),
                                "high": F.col("bx") > 90})
    return rounded(A.avg_by_time(rows, ["magnitude"], ["high"]).drop("flight_id"), 5)


@query("sensor_summary", sql(select="""SELECT sensor_id, count(*) AS n, count(*) FILTER (mission_time_s > 0) AS n_in_flight,
  round(min(magnitude), 4) AS mag_min, round(max(magnitude), 4) AS mag_max, round(avg(magnitude), 4) AS mag_mean,
  round(min(mission_time_s), 6) AS t_first, round(max(mission_time_s), 6) AS t_last,
  round(max(mission_time_s) - min(mission_time_s), 6) AS t_span FROM readings GROUP BY sensor_id"""))
def _(s, d):
    out = rounded(A.sensor_summary(r(s, d)).drop("flight_id"), 6, "t_first", "t_last", "t_span")
    return rounded(out, 4, "mag_min", "mag_max", "mag_mean")


FLAG_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS flag, count(*) AS n_rows, count(*) FILTER ({f}) AS n_flagged, "
    f"round(100.0 * count(*) FILTER ({f}) / count(*), 4) AS pct FROM det" for f in FLAGS)


@query("flag_rates", sql(DET, select=FLAG_SQL))
def _(s, d):
    return rounded(A.flag_rates(_det(s, d), FLAGS).drop("flight_id"))


@query("robust_stats", sql("""md AS (SELECT sensor_id, median(magnitude) AS median, stddev_pop(magnitude) AS std, count(*) AS n
  FROM readings GROUP BY sensor_id)""", select="""SELECT sensor_id, any_value(n) AS n, round(any_value(median), 4) AS median,
  round(any_value(std), 4) AS std, round(median(abs(magnitude - median)), 4) AS mad,
  round(median(abs(magnitude - median)), 4) AS spread FROM readings JOIN md USING (sensor_id) GROUP BY sensor_id"""))
def _(s, d):
    return rounded(O.robust_stats(r(s, d)).drop("flight_id"))


METRICS = """count(*) AS n, round(avg(abs(t - p)), 4) AS mae, round(avg((t - p) * (t - p)), 4) AS mse,
  round(sqrt(avg((t - p) * (t - p))), 4) AS rmse,
  round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 5) AS r2,
  round(avg(abs(t - p) / greatest(abs(t), 1)) * 100, 4) AS mape, round(avg(t - p), 4) AS bias"""


def _metrics(df):
    return rounded(rounded(df, 5, "r2"), 4, "mae", "mse", "rmse", "mape", "bias")


@query("regression_metrics", sql(SCORED, select=f"SELECT {METRICS} FROM (SELECT magnitude AS t, pred_a AS p FROM scored)"))
def _(s, d):
    return _metrics(A.regression_metrics(scored(r(s, d)), "magnitude", "pred_a"))


@query("metrics_by_sensor", sql(SCORED, select=f"SELECT sensor_id, {METRICS} FROM (SELECT sensor_id, magnitude AS t, pred_a AS p FROM scored) GROUP BY 1"))
def _(s, d):
    return _metrics(A.metrics_by(scored(r(s, d)), "magnitude", "pred_a", ["sensor_id"]))


@query("metrics_by_phase", sql(SCORED, select=f"""SELECT phase, {METRICS} FROM (SELECT phase, magnitude AS t, pred_a AS p
  FROM scored JOIN {PHASE_VALUES} ON {PHASE_ON}) GROUP BY phase"""))
def _(s, d):
    return _metrics(A.metrics_by_phase(scored(r(s, d)), "magnitude", "pred_a", phases=PHASES))


@query("cluster_profile", sql(select="""SELECT sensor_id, count(*) AS n, round(avg(bx), 4) AS bx_centroid, round(avg(b_y), 4) AS by_centroid,
  round(avg(bz), 4) AS bz_centroid, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM readings GROUP BY sensor_id"""))
def _(s, d):
    return rounded(A.cluster_profile(r(s, d), "sensor_id").drop("flight_id"))


@query("histogram", sql("""e AS (SELECT min(magnitude) AS lo, max(magnitude) AS hi FROM readings),
b AS (SELECT least(floor((magnitude - lo) / ((hi - lo) / 50.0)), 49)::INT AS bin, count(*) AS n FROM readings, e GROUP BY 1)""",
    select="""SELECT g.bin::INT AS bin, round(lo + g.bin * ((hi - lo) / 50.0), 4) AS bin_lo,
  round(lo + (g.bin + 1) * ((hi - lo) / 50.0), 4) AS bin_hi, coalesce(n, 0) AS n
  FROM range(50) g(bin) CROSS JOIN e LEFT JOIN b ON b.bin = g.bin"""))
def _(s, d):
    return rounded(A.histogram(r(s, d), "magnitude").drop("flight_id"))


@query("distribution_summary", sql(select="SELECT count(*) AS n, round(avg(magnitude), 4) AS mean, round(median(magnitude), 4) AS median FROM readings"))
def _(s, d):
    return rounded(A.distribution_summary(r(s, d), "magnitude").drop("flight_id"))


@query("channel_flatness", """WITH c AS (SELECT 'l_quantity' AS channel, l_quantity::DOUBLE AS v FROM lineitem
  UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem)
SELECT channel, round(max(v) - min(v), 6) AS value_range, round(avg(v), 6) AS mean,
  CASE WHEN max(v) - min(v) > 0.09 THEN 'dynamic' ELSE 'flat' END AS status FROM c GROUP BY channel""")
def _(s, d):
    li = table(s, d, "lineitem")
    return rounded(A.channel_flatness(li, ["l_quantity", "l_discount", "l_tax"], 0.09), 6)


SEGMENTS = """e AS (SELECT min(mission_time_s) AS a, max(mission_time_s) - min(mission_time_s) AS w FROM det),
p AS (SELECT is_roc, CASE WHEN mission_time_s <= a + w * 0.15 THEN 'early'
  WHEN mission_time_s >= a + w * 0.25 AND mission_time_s <= a + w * 0.75 THEN 'cruise'
  WHEN mission_time_s >= a + w * 0.85 THEN 'late' END AS part FROM det, e),
dy AS (SELECT (count(*) FILTER (part <> 'cruise' AND is_roc) / count(*) FILTER (part <> 'cruise'))
  / (count(*) FILTER (part = 'cruise' AND is_roc) / count(*) FILTER (part = 'cruise')) AS q FROM p)"""


@query("anomaly_rate_by_segment", sql(DET, SEGMENTS, select="""SELECT part, count(*) AS n, count(*) FILTER (is_roc) AS n_anomalies,
  round(100.0 * count(*) FILTER (is_roc) / count(*), 4) AS rate_pct, round(any_value(q), 4) AS dynamic_ratio
  FROM p, dy WHERE part IS NOT NULL GROUP BY part"""))
def _(s, d):
    rows = O.rate_of_change(r(s, d), ROC_LIMIT)
    return rounded(A.anomaly_rate_by_segment(rows, "is_roc").drop("flight_id"))


@query("method_overlap", sql(DET, select=" UNION ALL ".join(
    f"SELECT '{a}' AS method_a, '{b}' AS method_b, count(*) FILTER ({a} AND {b}) AS n_both, "
    f"min(votes) FILTER (is_anomaly) AS min_votes FROM det" for a, b in
    (("is_z", "is_z"), ("is_z", "is_roc"), ("is_roc", "is_roc")))))
def _(s, d):
    return A.method_overlap(_det(s, d), ["is_z", "is_roc"])


@query("interval_coverage", sql(SCORED, select="""SELECT round(100.0 * count(*) FILTER (abs(magnitude - pred_a) < 2 * sigma) / count(*), 4) AS coverage_pct FROM scored"""))
def _(s, d):
    return rounded(A.interval_coverage(scored(r(s, d)), "magnitude", "pred_a", "sigma").drop("flight_id"))


@query("residual_diagnostics", sql(SCORED, f"""e AS (SELECT sensor_id, magnitude AS y, magnitude - pred_a AS e,
  lag(magnitude - pred_a) OVER ({W}) AS e1 FROM scored),
q AS (SELECT sensor_id, quantile_cont(y, 0.33) AS a, quantile_cont(y, 0.67) AS b, avg(e) AS m FROM e GROUP BY sensor_id),
s3 AS (SELECT sensor_id, stddev_pop(e) FILTER (y < a) AS lo, stddev_pop(e) FILTER (y >= a AND y < b) AS mi,
  stddev_pop(e) FILTER (y >= b) AS hi, sum((e - m) * (e1 - m)) / sum((e - m) * (e - m)) AS ac FROM e JOIN q USING (sensor_id) GROUP BY sensor_id)""",
    select="""SELECT sensor_id, count(*) AS n, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS std,
  round(100 * stddev_pop(e) / avg(y), 4) AS std_pct_of_signal, round(max(abs(e)), 4) AS max_abs,
  round(any_value(lo), 4) AS std_low, round(any_value(mi), 4) AS std_mid, round(any_value(hi), 4) AS std_high,
  round(any_value(ac), 4) AS lag1_autocorr, round(corr(abs(e), y), 4) AS corr_abs_error,
  round(greatest(any_value(lo), any_value(mi), any_value(hi)) / greatest(least(any_value(lo), any_value(mi), any_value(hi)), 0.01), 4) AS std_ratio,
  round(quantile_cont(abs(e), 0.99), 4) AS p99_abs, round(quantile_cont(abs(e), 0.999), 4) AS p999_abs
  FROM e JOIN s3 USING (sensor_id) GROUP BY sensor_id"""))
def _(s, d):
    out = A.residual_diagnostics(scored(r(s, d)), "magnitude", "pred_a", ["flight_id", "sensor_id"])
    return rounded(out.drop("flight_id"))


@query("rank_correlation", sql(SCORED, """k AS (SELECT pred_a, pred_b, abs(pred_a - pred_b) AS df,
  rank() OVER (ORDER BY pred_a) + (count(*) OVER (PARTITION BY pred_a) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY pred_b) + (count(*) OVER (PARTITION BY pred_b) - 1) / 2.0 AS rb FROM scored)""",
    select="""SELECT count(*) AS n, round(corr(ra, rb), 5) AS spearman, round(corr(pred_a, pred_b), 5) AS pearson,
  round(avg(df), 4) AS mean_diff, round(quantile_cont(df, 0.95), 4) AS p95_diff FROM k"""))
def _(s, d):
    out = A.rank_correlation(scored(r(s, d)), "pred_a", "pred_b").drop("flight_id")
    return rounded(rounded(out, 5, "spearman", "pearson"), 4, "mean_diff", "p95_diff")


@query("bootstrap_ci")
def _(s, d):
    return A.bootstrap_ci(scored(r(s, d)), "magnitude", "pred_a", ["reading_number"])


@query("physics_violations", sql(SCORED, select="""SELECT count(*) AS n, count(*) FILTER (pred_b > bx + b_y + bz + 1) AS above_sum,
  count(*) FILTER (pred_b < greatest(bx, b_y, bz) - 1) AS below_largest,
  count(*) FILTER (pred_b < greatest(bx, b_y, bz) - 50) AS far_below_largest,
  count(*) FILTER (pred_b <= 0) AS not_positive FROM scored"""))
def _(s, d):
    return A.physics_violations(scored(r(s, d)), "pred_b")


@query("integrity_report", sql(select="""SELECT u.* FROM (SELECT count(*)::DOUBLE AS n, min(magnitude) AS lo, max(magnitude) AS hi,
  count(DISTINCT sensor_id)::DOUBLE AS k FROM readings), LATERAL (VALUES ('rows', n > 0, n), ('nulls', true, 0.0), ('nans', true, 0.0),
  ('infinities', true, 0.0), ('not_norm', true, 0.0), ('lowest', lo > 100, round(lo, 4)), ('highest', hi < 100000, round(hi, 4)),
  ('sensors', k >= 1, k)) AS u(check_name, passed, value)"""))
def _(s, d):
    return rounded(A.integrity_report(r(s, d)))


@query("error_separation", sql(SCORED, """e AS (SELECT abs(magnitude - pred_a) AS e, row_number() OVER (ORDER BY abs(magnitude - pred_a)) AS k,
  count(*) OVER () AS n FROM scored)""", select="""SELECT any_value(n) AS n, round(avg(e) FILTER (k > floor(n * 0.9)), 4) AS top_mean,
  round(avg(e) FILTER (k <= floor(n * 0.5)), 4) AS low_mean,
  avg(e) FILTER (k > floor(n * 0.9)) > 3 * avg(e) FILTER (k <= floor(n * 0.5)) AS separated FROM e"""))
def _(s, d):
    rows = scored(r(s, d)).withColumn("abs_error", F.abs(F.col("magnitude") - F.col("pred_a")))
    return rounded(A.error_separation(rows).drop("flight_id"))


@query("throughput_report", sql(select="""SELECT (epoch_us(event_ts) // 3600000000) * 3600000000 AS start_us, count(*) AS n, round(count(*) / 3600.0, 6) AS hz,
  count(DISTINCT sensor_id) AS n_sensors, greatest(0.0, count(DISTINCT sensor_id) * 3600 * 0.01 - count(*)) AS n_missing,
  count(*) FILTER (bx > 90) AS n_anomalies FROM readings GROUP BY 1"""))
def _(s, d):
    rows = r(s, d).withColumn("is_anomaly", F.col("bx") > 90)
    out = A.throughput_report(rows, 3600, rate_hz=0.01).drop("flight_id")
    return rounded(out, 6, "hz", "n_missing")


@query("consensus", sql(SCORED, select="SELECT reading_number, round((pred_a + pred_b) / 2, 4) AS consensus FROM scored"))
def _(s, d):
    return rounded(A.consensus(scored(r(s, d)), ["pred_a", "pred_b"]).select("reading_number", "consensus"))


@query("flight_report", sql(DET, "rep AS (SELECT *, magnitude * 0.9 + bz * 0.1 AS p FROM det)", select="""
SELECT 'sensor' AS section, u.metric, sensor_id::VARCHAR AS key, round(u.value, 6) AS value FROM (SELECT sensor_id, count(*) AS n,
  count(*) FILTER (mission_time_s > 0) AS f, min(magnitude) AS a, max(magnitude) AS b, avg(magnitude) AS c, min(mission_time_s) AS t0,
  max(mission_time_s) AS t1 FROM rep GROUP BY sensor_id), LATERAL (VALUES ('n', n::DOUBLE), ('n_in_flight', f::DOUBLE), ('mag_min', a),
  ('mag_max', b), ('mag_mean', c), ('t_first', t0), ('t_last', t1)) AS u(metric, value)
UNION ALL SELECT 'flag', m, k, round(v, 6) FROM (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS k, 'n_flagged' AS m, count(*) FILTER ({f})::DOUBLE AS v FROM rep UNION ALL "
    f"SELECT '{f}', 'pct', 100.0 * count(*) FILTER ({f}) / count(*) FROM rep" for f in FLAGS) + """)
UNION ALL SELECT 'model', u.metric, 'rf', round(u.value, 6) FROM (SELECT count(*) AS n, 1 - sum((magnitude - p) ** 2)
  / (var_pop(magnitude) * count(*)) AS r2, sqrt(avg((magnitude - p) ** 2)) AS rmse FROM rep), LATERAL (VALUES ('n', n::DOUBLE), ('r2', r2), ('rmse', rmse)) AS u(metric, value)"""))
def _(s, d):
    rows = _det(s, d).withColumn("p", F.col("magnitude") * 0.9 + F.col("bz") * 0.1)
    return rounded(A.flight_report(rows, FLAGS, predictions={"rf": "p"}), 6)


@query("split_temporal", sql("p AS (SELECT quantile_cont(mission_time_s, 0.7) AS q FROM readings)",
    select="SELECT reading_number, mission_time_s < q AS is_train FROM readings, p"))
def _(s, d):
    from telluria.operators.models import split_temporal
    return split_temporal(r(s, d)).select("reading_number", "is_train")


@query("clip_uncertainty", sql(SCORED, "k AS (SELECT stddev_pop(abs(magnitude - pred_a)) AS sd FROM scored)",
    select="""SELECT reading_number, round(least(greatest(sigma, sd * 0.5), sd * 5), 4) AS sigma,
  round(pred_a - 1.96 * least(greatest(sigma, sd * 0.5), sd * 5), 4) AS band_low,
  round(pred_a + 1.96 * least(greatest(sigma, sd * 0.5), sd * 5), 4) AS band_high FROM scored, k"""))
def _(s, d):
    from telluria.operators.models import clip_uncertainty
    out = clip_uncertainty(scored(r(s, d)), "magnitude", "pred_a", "sigma")
    return rounded(out.select("reading_number", "sigma", "band_low", "band_high"))


@query("top_anomalies", sql(DET, select="""SELECT reading_number, sensor_id, round(z, 4) AS z, round(roc, 4) AS roc, votes
  FROM det WHERE votes >= 1 ORDER BY votes DESC, mission_time_s, reading_number LIMIT 10"""))
def _(s, d):
    out = anomaly.top_anomalies(_det(s, d).withColumn("is_anomaly", F.col("votes") >= 1))
    return rounded(out.select("reading_number", "sensor_id", "z", "roc", "votes"))


@query("keep_latest", sql(select="""SELECT sensor_id, reading_number, age_rank FROM (SELECT *,
  row_number() OVER (PARTITION BY sensor_id ORDER BY mission_time_s DESC, reading_number) AS age_rank FROM readings) WHERE age_rank <= 10"""))
def _(s, d):
    from telluria.sinks import keep_latest
    return keep_latest(r(s, d), ["sensor_id"], "mission_time_s", tie="reading_number").select(
        "sensor_id", "reading_number", F.col("age_rank").cast("long").alias("age_rank"))


@query("union_datasets", sql(select="""SELECT 'a' AS dataset, count(*) AS n, round(avg(magnitude), 4) AS mag, count(bx) AS n_bx FROM readings
UNION ALL SELECT 'b', count(*), round(avg(magnitude), 4), 0 FROM readings"""))
def _(s, d):
    from telluria.sources.csv import union_datasets
    rows = r(s, d)
    out = union_datasets({"a": rows, "b": rows.drop("bx")})
    return rounded(out.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("magnitude").alias("mag"),
                                              F.count("bx").alias("n_bx")))

