import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import table_of
from telluria import sinks
from telluria.operators import aggregates as A
from telluria.operators import anomaly, evaluation, interpolation, models

KEY = ["reading_number"]


@pytest.fixture(scope="module")
def cube(spark, readings):
    rows = readings.crossJoin(spark.range(3).withColumnRenamed("id", "copy"))
    rows = rows.withColumn("reading_number", F.col("reading_number") * 3 + F.col("copy")).drop("copy", "bx", "by", "bz", "magnitude")
    probe = evaluation.synthetic_probe(rows, KEY)
    return rows.join(probe, KEY).cache()


def test_split_and_sample(cube):
    share = models.split_random(cube, KEY).agg(F.avg((~F.col("is_train")).cast("double"))).first()[0]
    assert 0.15 < share < 0.25
    got = models.stratified_sample(cube, KEY).groupBy("chunk").count().toPandas()
    assert len(got) == 20 and (got["count"] == 25).all()


def test_reconstruction_and_store(spark, cube, tmp_path):
    mark = sinks.fingerprint(cube, ["reading_number", "bx"])
    model = models.fit_reconstruction_forest(cube, trees=30, depth=12)
    out = model.transform(cube)
    assert A.regression_metrics(out, "magnitude", "magnitude_rf").first()["r2"] > 0.95
    models.save_model(model, str(tmp_path / "m"), mark, {"r2": 0.9})
    again = models.load_model(spark, str(tmp_path / "m"), mark, 3)
    assert table_of(again.transform(cube), "reading_number", "magnitude_rf") == table_of(out, "reading_number", "magnitude_rf")
    assert models.load_model(spark, str(tmp_path / "m"), sinks.fingerprint(cube.limit(10), ["reading_number", "bx"])) is None
    assert models.load_model(spark, str(tmp_path / "m"), n_features=4) is None
    check = evaluation.determinism_check(cube, model, KEY, "magnitude_rf").first()
    assert check["passed"] and check["n"] == cube.count()
    imp = evaluation.permutation_importance(cube, model, KEY, "magnitude", "magnitude_rf").toPandas()
    assert len(imp) == 3 and (imp.importance > 0.1).all()
    shift = {r.condition: r.r2 for r in evaluation.distribution_shift(cube, model, KEY, "magnitude_rf").collect()}
    assert shift["noise 5.0"] > 0.9 and shift["scale 1.15"] < shift["original"]
    audit = evaluation.model_audit([("rf", "fit", out, "magnitude", "magnitude_rf", "r2", 0.9, True)]).first()
    assert audit["passed"]


def test_small_inputs_give_no_model(cube):
    assert models.fit_reconstruction_forest(cube.limit(5)) is None
    assert models.fit_kmeans(cube.limit(2)) is None


def test_clusters_of_three_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 1, (150, 3)) for c in (0, 50, 100)])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, bx double, by double, bz double")
    model = models.fit_kmeans(df)
    assert len(model.stages[-1].clusterCenters()) == 3
    assert table_of(A.cluster_profile(model.transform(df), by=[]), "n") == [(150,)] * 3


def test_fits_of_every_k_fill_the_cores(spark, monkeypatch):
    """Rows of one task are clustered by all k at once, rows of many by one k at a
    time, and each gives the centres it gives alone."""
    import threading

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 1, (200, 3)) for c in (0, 50, 100)])[rng.permutation(600)]
    df = spark.createDataFrame([tuple(map(float, p)) for p in x], "bx double, by double, bz double")
    real, lock, running, most = models._pipeline, threading.Lock(), [0], [0]
    gate = threading.Barrier(5)

    class Watched:
        def __init__(self, *args):
            self.inner, self.wait = real(*args), wait

        def fit(self, rows):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            try:
                if self.wait:
                    gate.wait(timeout=60)
                return self.inner.fit(rows)
            finally:
                with lock:
                    running[0] -= 1

    for rows, wait, expected in ((df.coalesce(1), True, 5), (df.repartition(16), False, 1)):
        rows, most[0] = rows.cache(), 0
        monkeypatch.setattr(models, "_pipeline", Watched)
        centres = models.fit_kmeans(rows).stages[-1].clusterCenters()
        monkeypatch.undo()
        assert most[0] == expected
        alone = models.fit_kmeans(rows, k=3).stages[-1].clusterCenters()
        assert len(centres) == 3 and np.allclose(centres, alone, rtol=0, atol=1e-12)


def test_silhouette_is_that_of_mllib(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator

    rng = np.random.default_rng(1)
    for k, alone in ((2, 0), (5, 2)):
        points = [(*map(float, rng.normal(0, 9, 3)), int(c)) for c in rng.integers(0, k, 200)]
        points += points[:20] + [(40.0 + i, -3.0, 0.0, k + i) for i in range(alone)]  # copies, and rows alone in a cluster
        df = spark.createDataFrame(points, "bx double, by double, bz double, c int")
        rows = models.VectorAssembler(inputCols=["bx", "by", "bz"], outputCol="f").transform(df)
        want = ClusteringEvaluator(featuresCol="f", predictionCol="c").evaluate(rows)
        assert abs(models.silhouette(df, "c") - want) < 1e-12
    assert models.silhouette(df.withColumn("c", F.lit(0)), "c") == -1.0
    same = spark.createDataFrame([(1.0, 2.0, 3.0, i % 2) for i in range(6)], "bx double, by double, bz double, c int")
    assert models.silhouette(same, "c") == 0.0


def test_bayesian_regression(cube):
    model = models.fit_bayesian_regression(cube)
    out = models.clip_uncertainty(model.predict(cube), "magnitude", "magnitude_gpr", "sigma")
    assert A.regression_metrics(out, "magnitude", "magnitude_gpr").first()["r2"] > 0.95
    assert A.interval_coverage(out, "magnitude", "magnitude_gpr", "sigma").first()["coverage_pct"] > 80


def test_bootstrap_brackets_the_estimate(cube):
    df = cube.withColumn("p", F.col("magnitude") + evaluation.gaussian(KEY, "e") * 300)
    point = A.regression_metrics(df, "magnitude", "p").first()
    ci = {r.metric: r for r in A.bootstrap_ci(df, "magnitude", "p", KEY).collect()}
    for m in ("r2", "mae"):
        assert ci[m].ci_low < point[m] < ci[m].ci_high


def test_prediction_errors(spark):
    df = spark.createDataFrame([("f", 1.0, 1.5, True), ("f", 1.0, 2.0, False), ("f", 1.0, 9.0, False)],
                               "flight_id string, target double, forecast double, is_train boolean")
    got = anomaly.prediction_error_anomalies(df, multiplier=1.5)
    assert table_of(got, "abs_error", "is_error_anomaly") == [(0.5, False), (1.0, False), (8.0, True)]


def test_spline_is_exact_for_cubics_and_for_slices(spark):
    t = np.sort(np.random.default_rng(0).uniform(0, 10, 40))
    f = lambda u: u ** 3 - 4 * u ** 2 + 2
    at = np.linspace(t[0], t[-1], 200)
    assert np.allclose(interpolation.cubic_spline(t, f(t)[:, None], at)[:, 0], f(at))
    four = interpolation.cubic_spline(np.arange(4.0), f(np.arange(4.0))[:, None], np.array([0.5, 2.5]))[:, 0]
    assert np.allclose(four, f(np.array([0.5, 2.5])))
    rows = [("f", 0, i, float(i), float(np.sin(i / 3)), float(i % 5), 1.0) for i in range(700)]
    rows += [("f", 0, 900 + i, 900.0 + i, 1.0 * i, 2.0, 3.0) for i in range(3)]
    df = spark.createDataFrame(rows, "flight_id string, sensor_id int, reading_number long, mission_time_s double, bx double, by double, bz double")
    whole = interpolation.densify_segments(df).orderBy("time").toPandas()
    cut = interpolation.densify_segments(df, slice_knots=200).orderBy("time").toPandas()
    assert len(whole) == len(cut) == 3503 and np.allclose(whole.time, cut.time)
    assert np.allclose(whole[["bx", "by", "bz"]], cut[["bx", "by", "bz"]], atol=1e-9)


def test_more_segments_than_points(spark):
    rows = [("f", 0, 10 * k + i, 100.0 * k + i, float(i), 1.0, 1.0) for k in range(10) for i in range(5)]
    df = spark.createDataFrame(rows, "flight_id string, sensor_id int, reading_number long, mission_time_s double, bx double, by double, bz double")
    for densify in (interpolation.densify_linear, interpolation.densify_segments):
        assert densify(df).count() == 250
        assert densify(df, max_points=8).count() == densify(df, max_points=10).count() == 20


def test_lines_through_rows_of_one_time(spark):
    rows = [("f", 0, i, t, float(i), 1.0, 1.0) for i, t in enumerate([0.0, 1.0, 1.0, 1.0, 2.0, 2.0])]
    rows += [("f", 1, i, 5.0, float(i), 1.0, 1.0) for i in range(4)] + [("f", 2, i, 5.0, float(i), 1.0, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "flight_id string, sensor_id int, reading_number long, mission_time_s double, bx double, by double, bz double")
    for slice_rows in (1000, 2):
        got = interpolation.densify_linear(df, slice_rows=slice_rows).toPandas()
        flat, few = got[got.sensor_id == 1], got[got.sensor_id == 2]
        assert len(flat) == 20 and set(flat.time) == {5.0} and set(flat.bx) == {3.0}
        assert sorted(few.bx) == [0.0, 1.0, 2.0]
        line = got[got.sensor_id == 0].sort_values("time")
        at = np.arange(30) * (2.0 / 29)
        want = np.where(at < 1, at, 3 + (at - 1))
        want[-1] = 5.0  # the last of the rows at the end
        assert len(line) == 30 and np.allclose(line.time, at) and np.allclose(line.bx, want)


def test_fits_read_their_source_once(spark, cube):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = cube.select(*KEY, "bx", "by", "bz", "magnitude")
    counted, n = rows.mapInPandas(count, rows.schema), rows.count()
    fit = lambda d: models.fit_reconstruction_forest(d, trees=2, depth=3)
    assert fit(counted) is not None and seen.value == n
    folds = evaluation.cross_validate(counted, fit, KEY, "magnitude", "magnitude_rf", folds=2)
    assert folds.agg(F.sum("n")).first()[0] == n and seen.value == 2 * n


def test_determinism_check_grows_with_the_cluster(spark, cube):
    """Rows are read once, and the second scoring has more parts than cores."""
    import re

    model = models.fit_reconstruction_forest(cube, trees=2, depth=2)
    out = evaluation.determinism_check(cube, model, KEY, "magnitude_rf", parts=2)
    plan = out._jdf.queryExecution().toString()
    parts = [int(n) for n in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", plan)]
    assert parts and min(parts) > spark.sparkContext.defaultParallelism
    assert tuple(out.first()) == (cube.count(), 0, 0.0, True)
