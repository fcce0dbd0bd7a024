from conftest import table_of

from telluria.operators import projections as P
from telluria.sources import csv, files, frames


def test_frames(spark):
    df = spark.createDataFrame([(bytearray.fromhex("000001FFFFFF800000"),), (bytearray.fromhex("7FFFFFFFFE10000000"),),
                                (bytearray(b"\x00"),)], "frame binary")
    assert table_of(frames.decode_frames(df), "x", "y", "z") == sorted(
        [(1, -1, -8388608), (8388607, -496, 0), (None, None, None)], key=repr)


def test_legacy_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("-44,|0|:,Magneto #1,X:,612,Y:,-95,Z:,301,( Mon Jul 14 08:15:30 2025 )\n"
                                    "-117,|1|:,Pressure,X:,1,Y:,2,Z:,3\n-116,|2|:,Magneto #2,X:,oops,Y:,2,Z:,3\n"
                                    "-115,|3|:,Magneto #3,X:,2,Y:,3,Z:,6\n")
    (tmp_path / "b.csv").write_text("Time,Sensor,X,Y,Z\n1,0,2,3,6\n")
    got = table_of(csv.read_legacy_csv(spark, str(tmp_path / "a.csv")), "Time", "Sensor", "X", "Magnitude")
    assert [g[:3] for g in got] == [(-115, 2, 2), (-44, 0, 612)] and got[0][3] == 7.0
    kinds = {r.path.rsplit("/", 1)[1]: r.format for r in csv.detect_format(spark, str(tmp_path)).collect()}
    assert kinds == {"a.csv": "legacy", "b.csv": "timeline"}


def test_flight_csv_names(spark, tmp_path):
    (tmp_path / "t.csv").write_text("T,Time,Sensor,Bx,By,Bz,Magnitude\n5,9,1,2,3,6,NaN\n6,9,2,2,3,6,8\n")
    got = csv.read_flight_csv(spark, str(tmp_path / "t.csv"))
    assert table_of(got, "mission_time_s", "sensor_id", "bx_raw", "magnitude_measured") == [(5.0, 1, 2.0, 7.0), (6.0, 2, 2.0, 8.0)]


def test_raw_readings_start_at_first_row(spark, tmp_path):
    (tmp_path / "r.csv").write_text("timestamp_unix,sensor_id,bx_raw,by_raw,bz_raw\n100.5,1,2,3,6\n100.0,,1,2,2\n102.5,0,1,2,2\n")
    got = csv.read_raw_readings(spark, str(tmp_path / "r.csv"))
    assert table_of(got, "mission_time_s", "sensor_id", "magnitude") == sorted([(0.0, 1, 7.0), (-0.5, 0, 3.0), (2.0, 0, 3.0)], key=repr)


def test_merge_sessions(spark):
    rows = [("f", "b", 1, 1000.0 + i, float(i - 150)) for i in range(3)] + [("f", "a", 1, 900.0 + i, float(i)) for i in range(2)]
    df = spark.createDataFrame(rows, "flight_id string, path string, reading_number long, timestamp_unix double, mission_time_s double")
    merged, sessions = csv.merge_sessions(df)
    assert table_of(merged, "boot_id", "mission_time_s") == [(0, 0.0), (0, 1.0), (1, 100.0), (1, 101.0), (1, 102.0)]
    s = sessions.orderBy("session").collect()
    assert [x.n_rows for x in s] == [2, 3] and abs(s[1].missing_s - (99 - 1 / 45)) < 1e-9


def test_file_choice(spark, tmp_path):
    for name, size in (("flight_data_20250714_081530.csv", 400), ("flight_data_20250714_081600.csv", 10),
                       ("sim_data_20250714_081530.csv", 999), ("flight_raw_sensors_20250714_081530.csv", 200)):
        (tmp_path / name).write_text("x" * size)
    listing = files.list_files(spark, str(tmp_path))
    chosen = [r.name for r in files.select_inputs(listing).orderBy("choice").collect()]
    assert chosen == ["flight_data_20250714_081530.csv"]
    pairs = {r.result_path.rsplit("/", 1)[1]: r.same_stamp for r in files.pair_companions(listing).collect()}
    assert pairs == {"flight_data_20250714_081530.csv": True, "flight_data_20250714_081600.csv": False,
                     "sim_data_20250714_081530.csv": False}


def test_companions_stay_in_their_folder(spark):
    rows = [("/a/x_data_20250714_081530.csv", 500, 1), ("/b/x_raw_sensors_20250714_081530.csv", 500, 9),
            ("/a/y_raw_sensors_20250714_080000.csv", 500, 2), ("/a/y_raw_sensors_latest.csv", 500, 1),
            ("/a/y_raw_sensors_20250714_090000.csv", 50, 7), ("/b/x_data_20250714_081530.csv", 500, 1),
            ("/c/x_data_20250714_081530.csv", 500, 1), ("/d/x_data_20250714_081531.csv", 500, 1),
            ("/d/z_raw_sensors_20250714_081530.csv", 500, 1), ("/d/z_raw_sensors_20250714_081532.csv", 500, 3)]
    df = spark.createDataFrame([(p, p.rsplit("/", 1)[1], n, m) for p, n, m in rows],
                               "path string, name string, length long, modified long")
    got = {r.result_path[1]: (r.raw_path and r.raw_path[1:], r.same_stamp) for r in files.pair_companions(df).collect()}
    assert got == {"a": ("a/y_raw_sensors_latest.csv", False), "b": ("b/x_raw_sensors_20250714_081530.csv", True),
                   "c": (None, False), "d": ("d/z_raw_sensors_20250714_081532.csv", False)}


def test_time_texts(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.4, -0.4, 2.5, -2.5, 90061.9, -5.5)], "mission_time_s double")
    got = {r.mission_time_s: (r.hms, r.tplus, r.tplus_live) for r in P.with_time_labels(df).collect()}
    assert got[0.0] == ("00:00:00", "T0", "T0") and got[0.4][1:] == ("T+0", "T0") and got[-0.4][1:] == ("T0", "T0")
    assert got[2.5][1:] == ("T+2", "T+2") and got[-2.5][1:] == ("T-2", "T-2")
    assert got[90061.9][0] == "25:01:01" and got[-5.5][0] == "-1:59:55"


def test_range_reason(spark):
    df = spark.createDataFrame([(1, 2, 3), (900000, 2, -900001), (0, 0, -800001)], "bx int, by int, bz int")
    got = table_of(P.validate_range(df), "reason", "is_valid")
    assert (None, True) in got and ("x-axis value 900000 exceeds range (+/-800000)", False) in got
    assert ("z-axis value -800001 exceeds range (+/-800000)", False) in got


def test_events(spark):
    texts = ["Heartbeat ok", "Apogee error", "Motor on", "nothing", "Sample  3", "sample 3"]
    df = spark.createDataFrame([(t,) for t in texts], "event string")
    got = {r.event: (r.skip_key, r.category) for r in P.categorize_events(P.with_skip_key(df)).collect()}
    assert got["Heartbeat ok"][0] == "heartbeat" and got["sample 3"][0] == "sample"
    assert got["Apogee error"] == (None, "Warning/Error") and got["Motor on"][1] == "Actuator" and got["nothing"][1] == "System"


def test_fixed_decimals_round_the_binary_value(spark):
    from pyspark.sql import functions as F

    from telluria.sinks import fixed

    values = [0.25, 0.35, 0.05, 0.15, 12.35, 6.745, 0.005, 1.005, 2.675, 9.95, 99.96, 9.995, 0.0, 5e-324, 1e15 + 0.5,
              2.0 ** 53, 1e17, -0.25, -12.35, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3):
        got = [row[0] for row in df.select(fixed(F.col("x"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]
    assert df.select(fixed(F.lit(None).cast("double"), 1)).first()[0] is None
