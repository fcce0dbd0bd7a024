import numpy as np
from pyspark.sql import functions as F

from conftest import table_of
from telluria.operators import anomaly, forest


def planted(spark, n=1500):
    """Three sensors on slow drifts with a closed-form jitter; every 101st row
    after the first 200 is a dropout or an overshoot of all axes, ``planted``."""
    i = np.arange(n)
    sensor = i % 3
    centre = np.array([[5200.0, -3100.0, 8700.0], [4700.0, 3900.0, -9100.0], [-6100.0, 2500.0, 7800.0]])[sensor]
    drift = 60 * np.sin(i / 400)[:, None] * np.array([1.0, 0.5, -0.7])
    jitter = 50 * (np.modf(np.abs(np.sin(i[:, None] * np.array([12.9898, 78.233, 37.719]))) * 43758.5453)[0] - 0.5)
    odd = (i > 200) & (i % 101 == 0)
    factor = np.where(odd, np.where(i % 2 == 0, 0.4, 1.5), 1.0)
    v = (centre + drift + jitter) * factor[:, None]
    rows = [("f", int(s), int(k), float(k * 0.0074), *map(float, p), float(np.sqrt((p ** 2).sum())), bool(o))
            for s, k, p, o in zip(sensor, i, v, odd)]
    return spark.createDataFrame(rows, "flight_id string, sensor_id int, reading_number long, mission_time_s double, "
                                       "bx double, by double, bz double, magnitude double, planted boolean")


def test_forest_finds_planted_rows(spark):
    df = planted(spark).cache()
    trees = forest.fit_isolation_forest(df, ["reading_number"], trees=50).cache()
    assert trees.count() == 150 and trees.agg(F.min("psi")).first()[0] == 256
    near = forest.score_isolation_forest(df, trees, ["reading_number"])
    far = forest.score_isolation_forest(df, trees, ["reading_number"], broadcast_groups=0, chunk_rows=200)
    assert table_of(near, "reading_number", "iso_score") == table_of(far, "reading_number", "iso_score")
    pdf = near.toPandas()
    assert pdf.iso_score.between(-1, 0).all()
    hits = pdf.nsmallest(int(pdf.planted.sum()), "iso_score").planted.mean()
    assert hits > 0.8


def test_same_forest_for_any_partitioning(spark):
    df = planted(spark, 600)
    out = [table_of(forest.score_isolation_forest(df, forest.fit_isolation_forest(df.repartition(n), ["reading_number"], trees=10),
                                                  ["reading_number"]), "reading_number", "iso_score") for n in (1, 7)]
    assert out[0] == out[1]


def test_flight_detector_recall(spark):
    got = anomaly.detect_flight(planted(spark)).toPandas()
    assert got[got.planted].is_anomaly.mean() > 0.9
    assert not got[got.reading_number < 60].is_z.any()


def test_ensemble_and_small_groups(spark):
    df = planted(spark, 600)
    few = df.limit(5).withColumn("sensor_id", F.lit(9)).withColumn("reading_number", F.col("reading_number") + 10_000)
    got = anomaly.detect_anomalies(df.unionByName(few), trees=20, neighbors=20).toPandas()
    assert len(got) == 605 and got[got.sensor_id == 9].is_anomaly.isna().all()
    rest = got[got.sensor_id != 9]
    flags = rest[["is_iso", "is_z_detrended", "is_lof", "is_roc_adaptive"]].astype(int).sum(axis=1)
    assert (rest.votes == flags).all() and (rest.is_anomaly == (flags >= 2)).all()
    assert rest[rest.planted].is_anomaly.mean() > 0.7
    top = anomaly.top_anomalies(spark.createDataFrame(rest[rest.is_anomaly.astype(bool)].drop(columns=["planted"])), 3)
    assert top.count() == min(3, int(rest.is_anomaly.sum()))


def test_stored_falls_back_where_parquet_has_no_type(spark):
    from telluria.session import stored

    got = stored(spark.range(3).selectExpr("id", "NULL AS nothing"))
    assert got.dtypes == [("id", "bigint"), ("nothing", "void")] and got.count() == 3


def test_detectors_store_rows_twice_and_not_as_checkpoints(spark, tmp_path, monkeypatch):
    """Checkpoints are rows as they are in memory; whole rows go to Parquet (F1)."""
    from telluria import session
    from telluria.operators import forest, neighbors, series

    wide = []
    whole = session.materialize

    def kept(df):
        wide.append(set(df.columns))
        return whole(df)

    for module in (session, anomaly, forest, neighbors, series):
        monkeypatch.setattr(module, "materialize", kept)
    rows = [("f", 0, i, None, float(i), float(np.sin(i)), float(np.cos(i * 1.7)), float(i % 7), 1.0 + i % 11) for i in range(300)]
    df = spark.createDataFrame(rows, "flight_id string, sensor_id int, reading_number long, event_ts timestamp, "
                               "mission_time_s double, bx double, by double, bz double, magnitude double")
    got = anomaly.detect_anomalies(df, by=["flight_id"], trees=5, neighbors=9, slice_rows=120)
    assert got.count() == 300 and got.where("is_anomaly IS NULL").count() == 0
    assert wide and not any({"magnitude", "reading_number"} <= c for c in wide)
