"""Sliced and plain forms agree, for every ordered operator."""

import numpy as np
import pandas as pd
import pytest

from conftest import table_of
from telluria.functions import frames
from telluria.operators import aggregates as A
from telluria.operators import anomaly
from telluria.operators import windows as W
from telluria.operators.series import RN, SIZE, Series, number_rows

K = "reading_number"
CASES = {
    "detect_flight": (lambda r, n: anomaly.detect_flight(r, roc_threshold=50, slice_rows=n), [K, "z", "roc", "votes"]),
    "detect_gaps": (lambda r, n: W.detect_gaps(r, 7200, slice_rows=n), ["sensor_id", "gap_start", "gap_end"]),
    "segment_by_gap": (lambda r, n: W.segment_by_gap(r, 7200, slice_rows=n), [K, "segment"]),
    "smooth_savgol": (lambda r, n: W.smooth_savgol(r, slice_rows=n), [K, "bx", "bz", "magnitude"]),
    "moving_average": (lambda r, n: W.moving_average(r, slice_rows=n), [K, "moving_avg"]),
    "rolling": (lambda r, n: W.rolling_mean_std(r, slice_rows=n), [K, "rolling_mean", "rolling_std"]),
    "detrended": (lambda r, n: W.zscore_detrended(r, slice_rows=n), [K, "trend", "z_detrended"]),
    "zscore_global": (lambda r, n: W.zscore_global(r, slice_rows=n), [K, "z"]),
    "adaptive": (lambda r, n: W.rate_of_change_adaptive(r, slice_rows=n), [K, "roc", "roc_threshold"]),
    "make_windows": (lambda r, n: W.make_windows(r, gap=7200, slice_rows=n), [K, "x_0", "mag_2", "target"]),
    "history": (lambda r, n: W.history_distance(r, rows=60, slice_rows=n), [K, "history_mean", "history_p95"]),
    "running": (lambda r, n: W.running_anomaly_number(
        W.rate_of_change(r, 50, slice_rows=n), "is_roc", slice_rows=n), [K, "reading_seq", "anomaly_no"]),
    "separation": (lambda r, n: A.error_separation(r, "magnitude", slice_rows=n), ["n", "top_mean", "low_mean"]),
    "ranks": (lambda r, n: A.average_ranks(r, "bz", "rank", slice_rows=n), [K, "rank"]),
}


@pytest.mark.parametrize("name", CASES)
def test_slices_change_nothing(readings, name):
    fn, cols = CASES[name]
    assert table_of(fn(readings, 10**9), *cols) == table_of(fn(readings, 60), *cols)


def test_number_rows(readings):
    got = number_rows(readings.select("sensor_id", K), ["sensor_id"], [K]).toPandas()
    want = got.sort_values(K).groupby("sensor_id").cumcount() + 1
    assert (got[RN].sort_index() == want.sort_index()).all()
    assert (got[SIZE] == got.groupby("sensor_id")[K].transform("size")).all()


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(50)], "g int, k int, v double")
    s = Series.of(df, ["g"], ["k"], slice_rows=7).running_sum({"total": df["k"].cast("long")})
    assert s.df.count() == 50 and s.df.agg({"total": "max"}).first()[0] == sum(range(50))


def test_partitioning_does_not_matter(readings):
    out = [table_of(anomaly.detect_flight(readings.repartition(n), roc_threshold=50), K, "z", "is_anomaly") for n in (1, 8)]
    assert out[0] == out[1]


def test_trailing_z_by_hand(spark):
    import numpy as np

    y = np.random.default_rng(1).normal(100, 5, 120)
    rows = [("f", 0, i, float(i), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "flight_id string, sensor_id int, reading_number long, mission_time_s double, magnitude double")
    got = W.zscore_trailing(df, rows=50, min_rows=20).orderBy(K).toPandas()["z"]
    for i in range(len(y)):
        h = y[max(0, i - 49):i + 1]
        med = np.median(h)
        want = 0.6745 * abs(y[i] - med) / np.median(abs(h - med)) if len(h) >= 20 else 0.0
        assert abs(got[i] - want) < 1e-9


def test_savgol_keeps_parabolas_and_short_groups(spark):
    rows = [("f", 0, i, float(i), i * i * 1.0, 2.0 * i, 5.0) for i in range(30)]
    rows += [("f", 1, i, float(i), float(i % 2), 0.0, 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "flight_id string, sensor_id int, reading_number long, mission_time_s double, bx double, by double, bz double")
    got = W.smooth_savgol(df).orderBy("sensor_id", K).toPandas()
    want = pd.Series([r[4] for r in rows])
    assert (got["bx"] - want).abs().max() < 1e-9


def test_windows_stay_inside_segments(spark):
    rows = [("f", 0, i, t, 1.0, 1.0, 1.0, float(i)) for i, t in enumerate([0, 1, 2, 3, 10, 11, 12, 13, 14])]
    df = spark.createDataFrame([(a, b, c, float(t), *v) for a, b, c, t, *v in rows],
                               "flight_id string, sensor_id int, reading_number long, mission_time_s double, bx double, by double, bz double, magnitude double")
    got = table_of(W.make_windows(df, window=3), "mag_0", "mag_2", "target")
    assert got == [(0.0, 2.0, 3.0), (4.0, 6.0, 7.0), (5.0, 7.0, 8.0)]


def test_detrending_window_grows_with_the_group(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(0, 1, 6000)) + rng.normal(0, 1, 6000)
    df = spark.createDataFrame(pd.DataFrame({"flight_id": "f", "sensor_id": 0, K: range(6000), "mission_time_s": np.arange(6000.0),
                                             "magnitude": y}))
    got = W.zscore_detrended(df).orderBy(K).toPandas().trend.to_numpy()
    line = np.concatenate([np.full(300, y[0]), y, np.full(300, y[-1])])
    want = [np.median(line[i:i + 601]) for i in range(6000)]
    assert np.allclose(got, want)


def test_sensors_are_counted_exactly(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.lit("f").alias("flight_id"), F.col("id").alias("sensor_id"),
                                    F.timestamp_seconds(F.lit(3)).alias("event_ts"))
    row = A.throughput_report(df, 5, flag=None).first()
    assert row.n_sensors == 20_000


def edge_medians(y, half):
    """Running medians with the end values standing in beyond the ends."""
    line = np.concatenate([np.full(half, y[0]), y, np.full(half, y[-1])])
    return np.array([np.median(line[i:i + 2 * half + 1]) for i in range(len(y))])


def long_series(kind, n):
    rng = np.random.default_rng(6)
    if kind == "drift":
        return np.cumsum(rng.normal(size=n))
    if kind == "ties":  # a third of the rows has one value
        return np.where(rng.random(n) < 0.34, 5.0, rng.integers(0, 9, n).astype(float))
    return np.where(np.arange(n) % 2 == 0, 1000.0, -1000.0) + rng.normal(size=n)  # the median jumps


@pytest.mark.parametrize("kind", ["drift", "ties", "jumps"])
def test_running_median_wider_than_a_slice(spark, kind):
    y = long_series(kind, 50_000 if kind == "drift" else 6_000)
    few = long_series("drift", 700)
    rows = [("f", 0, i, float(i), float(v)) for i, v in enumerate(y)] + [("f", 1, i, float(i), float(v)) for i, v in enumerate(few)]
    df = spark.createDataFrame(rows, "flight_id string, sensor_id int, reading_number long, mission_time_s double, magnitude double")
    got = W.zscore_detrended(df, slice_rows=500).orderBy("sensor_id", "reading_number").toPandas()
    assert len(got) == len(rows)
    assert np.array_equal(got[got.sensor_id == 0].trend.to_numpy(), edge_medians(y, max(31, len(y) // 10) // 2))
    assert np.array_equal(got[got.sensor_id == 1].trend.to_numpy(), edge_medians(few, 35))
    again = W.zscore_detrended(df.repartition(7), slice_rows=500, window=1801).orderBy("sensor_id", "reading_number").toPandas()
    assert np.array_equal(again[again.sensor_id == 0].trend.to_numpy(), edge_medians(y, 900))


def test_wide_median_puts_missing_values_last(spark):
    y = [float(i % 7) if i % 5 else None for i in range(400)]
    rows = [("f", 0, i, float(i), v) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "flight_id string, sensor_id int, reading_number long, mission_time_s double, magnitude double")
    wide, narrow = (W.zscore_detrended(df, slice_rows=n, window=151).orderBy("reading_number").toPandas().trend for n in (60, 1000))
    assert wide.equals(narrow)


def test_equal_values_have_no_spread_and_the_classic_score_reads_arrays(spark):
    line = np.full(600, 0.1)  # its mean is not 0.1 to the last bit
    assert (frames.trailing_moments(line[:0], line, 500)[2] == 0).all()
    rows = spark.createDataFrame([("f", 0, float(i), i, 0.1 if i < 300 else float(i % 7)) for i in range(400)],
                                 "flight_id string, sensor_id int, mission_time_s double, reading_number long, magnitude double")
    done = W.zscore_classic(rows, rows=100)
    got = {r.reading_number: r.z_classic for r in done.select("reading_number", "z_classic").collect()}
    assert all(got[i] is None for i in range(300)) and got[399] is not None
    assert "InArrow" in done._jdf.queryExecution().executedPlan().toString()
