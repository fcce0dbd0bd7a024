"""Neighbours, forests, fitted models (survey 2.7, 2.8)."""

from __future__ import annotations

from telluria import params, sinks
from telluria.checks.base import GAP_SENSOR, W, F, query, r, rounded, sql, table
from telluria.operators import aggregates as A
from telluria.operators import anomaly, evaluation, forest, interpolation, models, neighbors
from telluria.operators import windows as O
from telluria.schema import AXES, KEYS
from telluria.session import scratch_path, stored

KEY = ["reading_number"]
TREES, DEPTH = 20, 10


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "embedding")


PAIRS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pr AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM pr QUALIFY k <= {k})"""


@query("knn_self_join", "WITH " + PAIRS.format(k=50) + " SELECT i AS vec_id, k::INT AS neighbor_rank, j AS neighbor, round(d, 5) AS distance FROM nn")
def _(s, d):
    return rounded(neighbors.knn_self_join(_vectors(s, d), "vec_id", axes="embedding", by=[]), 5)


@query("local_outlier_factor", "WITH " + PAIRS.format(k=50) + """,
kd AS (SELECT i, max(d) AS kd FROM nn GROUP BY i),
lr AS (SELECT nn.i, 1 / (avg(greatest(kd.kd, d)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.i = nn.j GROUP BY nn.i),
lf AS (SELECT nn.i AS vec_id, avg(b.lrd) / any_value(a.lrd) AS lof FROM nn JOIN lr a ON a.i = nn.i JOIN lr b ON b.i = nn.j GROUP BY nn.i),
q AS (SELECT quantile_cont(-lof, 0.02) AS q FROM lf)
SELECT vec_id, round(lof, 4) AS lof, -lof < q AS is_lof FROM lf, q""")
def _(s, d):
    out = neighbors.local_outlier_factor(_vectors(s, d), "vec_id", axes="embedding", by=[])
    return rounded(out.select("vec_id", "lof", "is_lof"))


# The three axes of the readings, whole: boxes instead of the metric tree.
@query("readings_outlier_factor", sql("""pr AS (SELECT a.sensor_id, a.reading_number AS i, b.reading_number AS j,
  sqrt((a.bx - b.bx) * (a.bx - b.bx) + (a.b_y - b.b_y) * (a.b_y - b.b_y) + (a.bz - b.bz) * (a.bz - b.bz)) AS d
  FROM readings a JOIN readings b ON a.sensor_id = b.sensor_id AND a.reading_number <> b.reading_number),
nn AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 50),
kd AS (SELECT i, max(d) AS kd FROM nn GROUP BY i),
lr AS (SELECT nn.i, 1 / (avg(greatest(kd.kd, d)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.i = nn.j GROUP BY nn.i),
lf AS (SELECT nn.i, any_value(nn.sensor_id) AS sensor_id, avg(b.lrd) / any_value(a.lrd) AS lof
  FROM nn JOIN lr a ON a.i = nn.i JOIN lr b ON b.i = nn.j GROUP BY nn.i),
q AS (SELECT sensor_id, quantile_cont(-lof, 0.02) AS q FROM lf GROUP BY sensor_id)""",
    select="SELECT i AS reading_number, round(lof, 4) AS lof, -lof < q AS is_lof FROM lf JOIN q USING (sensor_id)"))
def _(s, d):
    rows = r(s, d).select(*KEYS, "reading_number", *AXES)
    out = neighbors.local_outlier_factor(rows, "reading_number")
    return rounded(out.select("reading_number", "lof", "is_lof"))


@query("isolation_forest")
def _(s, d):
    return forest.isolation_forest(r(s, d), KEY).select("reading_number", "sensor_id", "iso_score", "is_iso")


@query("detect_anomalies")
def _(s, d):
    rows = r(s, d).select("flight_id", "reading_number", "mission_time_s", *AXES, "magnitude")
    out = anomaly.detect_anomalies(rows, by=["flight_id"])
    return out.select("reading_number", "iso_score", "z_detrended", "lof", "roc", "votes", "is_anomaly")


@query("detect_per_sensor")
def _(s, d):
    rows = r(s, d).select(*KEYS, "reading_number", "mission_time_s", *AXES, "magnitude")
    out = anomaly.detect_per_sensor(rows, gap=GAP_SENSOR)
    return out.select("reading_number", "sensor_id", "votes", "is_anomaly", "show_z")


@query("online_check")
def _(s, d):
    trees = forest.fit_isolation_forest(r(s, d), KEY)
    out = anomaly.online_check(r(s, d), trees)
    return out.select("reading_number", "sensor_id", "z_classic", "iso_score", "is_far", "votes", "is_anomaly")


def _forest(s, d):
    train = models.split_random(r(s, d), KEY).where("is_train")
    return models.fit_reconstruction_forest(train, trees=TREES, depth=DEPTH)


@query("fit_reconstruction_forest")
def _(s, d):
    rows = models.split_random(r(s, d), KEY)
    out = models.score_batch(rows, [_forest(s, d)])
    return A.metrics_by(out, "magnitude", "magnitude_rf", ["is_train"])


@query("feature_importance")
def _(s, d):
    return models.feature_importance(s, _forest(s, d))


DRAWN = "('0x' || substr(md5(reading_number || '|42'), 1, 13))::BIGINT / 4503599627370496.0"


@query("split_random", sql(select=f"SELECT reading_number, {DRAWN} >= 0.2 AS is_train FROM readings"))
def _(s, d):
    return models.split_random(r(s, d), KEY).select("reading_number", "is_train")


@query("fit_second_regressor")
def _(s, d):
    rows = models.split_random(r(s, d), KEY)
    out = models.fit_second_regressor(rows.where("is_train")).transform(rows)
    return A.metrics_by(out, "magnitude", "magnitude_nn", ["is_train"])


@query("fit_kmeans")
def _(s, d):
    return models.cluster_centers(s, models.fit_kmeans(r(s, d)))


@query("assign_clusters")
def _(s, d):
    out = models.score_batch(r(s, d), [models.fit_kmeans(r(s, d), k=3)])
    return A.cluster_profile(out)


@query("fit_bayesian_regression")
def _(s, d):
    rows = models.split_random(r(s, d), KEY)
    model = models.fit_bayesian_regression(rows.where("is_train"))
    out = models.clip_uncertainty(model.predict(rows), "magnitude", "magnitude_gpr", "sigma")
    return A.interval_coverage(out, "magnitude", "magnitude_gpr", "sigma", by=["flight_id", "is_train"])


def _forecast(s, d):
    feats = stored(O.window_features(O.make_windows(r(s, d), gap=GAP_SENSOR)))
    return models.split_temporal(feats, t="target_time")


@query("fit_forecaster")
def _(s, d):
    rows = O.forecast_baselines(_forecast(s, d))
    model = models.fit_forecaster(rows.where("is_train"))
    test = model.transform(rows.where("NOT is_train")).drop("_features")
    names = ["forecast", "pred_last", "pred_linear", "pred_mean"]
    return A.long_form(test, names, ["target"], "method", "prediction").transform(
        lambda x: A.metrics_by(x, "target", "prediction", ["method"]))


@query("prediction_error_anomalies")
def _(s, d):
    rows = _forecast(s, d)
    model = models.fit_forecaster(rows.where("is_train"))
    out = anomaly.prediction_error_anomalies(model.transform(rows))
    return out.select("reading_number", "sensor_id", "abs_error", "error_threshold", "is_error_anomaly")


# The threshold rule itself, on a prediction that SQL can also make.
@query("prediction_error_rule", sql(f"""k AS (SELECT *, lag(magnitude) OVER ({W}) AS p FROM readings),
e AS (SELECT *, abs(magnitude - p) AS e FROM k WHERE p IS NOT NULL),
m AS (SELECT avg(e) FILTER (mission_time_s >= 0) * 3 AS lim FROM e)""", select="""SELECT reading_number, round(e, 4) AS abs_error,
  round(lim, 4) AS error_threshold, e > lim AS is_error_anomaly FROM e, m"""))
def _(s, d):
    rows = O.make_windows(r(s, d), window=1, gap=params.INF).withColumn("is_train", F.col("target_time") < 0)
    out = anomaly.prediction_error_anomalies(rows, prediction="mag_0")
    return rounded(out.select("reading_number", "abs_error", "error_threshold", "is_error_anomaly"))


@query("stratified_sample", sql("""n AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY mission_time_s, reading_number) AS rn,
  count(*) OVER (PARTITION BY flight_id) AS n FROM readings),
c AS (SELECT *, ((rn - 1) * 20) // n AS chunk FROM n)""", select=f"""SELECT reading_number, chunk FROM c
  QUALIFY row_number() OVER (PARTITION BY flight_id, chunk ORDER BY {DRAWN}, reading_number) <= 25"""))
def _(s, d):
    return models.stratified_sample(r(s, d), KEY).select("reading_number", "chunk")


@query("cross_validate")
def _(s, d):
    fit = lambda rows: models.fit_reconstruction_forest(rows, trees=10, depth=8)
    return evaluation.cross_validate(r(s, d), fit, KEY, "magnitude", "magnitude_rf")


@query("permutation_importance")
def _(s, d):
    return evaluation.permutation_importance(r(s, d), _forest(s, d), KEY, "magnitude", "magnitude_rf")


@query("synthetic_probe")
def _(s, d):
    probe = evaluation.synthetic_probe(r(s, d), KEY, 0.0, 150.0)
    return A.regression_metrics(_forest(s, d).transform(probe), "magnitude", "magnitude_rf")


@query("distribution_shift")
def _(s, d):
    return evaluation.distribution_shift(r(s, d), _forest(s, d), KEY, "magnitude_rf")


@query("score_batch")
def _(s, d):
    rows = r(s, d)
    found = [_forest(s, d), models.fit_kmeans(rows, k=3)]
    out = models.score_batch(anomaly.detect_flight(rows), found, absent=["magnitude_nn"])
    return sinks.result_rows(out)


@query("determinism_check", sql(select="SELECT count(*) AS n, 0::BIGINT AS unmatched, 0.0::DOUBLE AS max_diff, true AS passed FROM readings"))
def _(s, d):
    return evaluation.determinism_check(r(s, d), _forest(s, d), KEY, "magnitude_rf")


@query("model_audit")
def _(s, d):
    model, rows = _forest(s, d), r(s, d)
    scored = model.transform(rows).drop("_features")
    probe = model.transform(evaluation.synthetic_probe(rows, KEY, 0.0, 150.0)).drop("_features")
    return evaluation.model_audit([
        ("forest", "readings", scored, "magnitude", "magnitude_rf", "r2", 0.95, True),
        ("forest", "probe", probe, "magnitude", "magnitude_rf", "r2", 0.9, True),
        ("forest", "readings", scored, "magnitude", "magnitude_rf", "mae", 50.0, False)])


@query("retrain_on_window")
def _(s, d):
    found = models.retrain_on_window(r(s, d), trees=10, depth=8)
    return A.cluster_profile(models.score_batch(r(s, d), list(found.values())))


@query("save_and_load_model")
def _(s, d):
    path = scratch_path(s, "model")
    mark = sinks.fingerprint(r(s, d), ["reading_number", "bx", "by", "bz"])
    models.save_model(models.fit_kmeans(r(s, d), k=3), path, mark, {"k": 3.0})
    return A.cluster_profile(models.load_model(s, path, mark, 3).transform(r(s, d)))


@query("densify_segments")
def _(s, d):
    return interpolation.densify_segments(r(s, d), GAP_SENSOR)


@query("densify_linear", sql(f"""k AS (SELECT *, mission_time_s - lag(mission_time_s) OVER ({W}) AS gap FROM readings),
sg AS (SELECT *, sum(CASE WHEN gap > {GAP_SENSOR} THEN 1 ELSE 0 END) OVER ({W})::BIGINT AS segment FROM k),
pl AS (SELECT sensor_id, segment, count(*) AS n, min(mission_time_s) AS t0, max(mission_time_s) AS t1,
  count(*) * 5 AS np FROM sg GROUP BY sensor_id, segment),
gr AS (SELECT sensor_id, segment, CASE WHEN i = np - 1 THEN t1 ELSE t0 + i * ((t1 - t0) / (np - 1)) END AS tm
  FROM (SELECT *, unnest(range(np)) AS i FROM pl WHERE n >= 4)),
nx AS (SELECT *, lead(mission_time_s) OVER (PARTITION BY sensor_id, segment ORDER BY mission_time_s) AS t2,
  lead(bx) OVER (PARTITION BY sensor_id, segment ORDER BY mission_time_s) AS b2 FROM sg),
al AS (SELECT gr.sensor_id, gr.segment, tm, CASE WHEN t2 IS NULL THEN bx ELSE bx + (b2 - bx) * ((tm - mission_time_s) / (t2 - mission_time_s)) END AS v
  FROM gr ASOF JOIN nx ON gr.sensor_id = nx.sensor_id AND gr.segment = nx.segment AND gr.tm >= nx.mission_time_s
  UNION ALL SELECT sensor_id, segment, mission_time_s, bx FROM sg JOIN pl USING (sensor_id, segment) WHERE n < 4)""",
    select="SELECT sensor_id, segment, count(*) AS n, round(min(tm), 3) AS t_first, round(sum(v), 2) AS bx_sum FROM al GROUP BY ALL"))
def _(s, d):
    out = interpolation.densify_linear(r(s, d), GAP_SENSOR)
    return out.groupBy("sensor_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("time"), 3).alias("t_first"),
                                                   F.round(F.sum("bx"), 2).alias("bx_sum"))


