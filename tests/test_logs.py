from conftest import table_of
from pyspark.sql import functions as F

from telluria.sources import logs

LOG = """T-2: |1|: Magneto #0   X: 20011 Y: -4987 Z: 45020 ( Wed Jun 18 16:20:20 2025 )
T-2: Pressure: 1012.9 mbar ( Wed Jun 18 16:20:20 2025 )

T-1: a3: 9.9
T-1: a0: 0.111 ( Wed Jun 18 16:20:21 2025 )
T-1: a0: 0.550 ( Wed Jun 18 16:20:21 2025 )
T-1: a1: 0.551
T-1: a3: 0.550
T-1: a3: 0.990
T-1: a2: 0.1
T+0: Tc 1: 20.9 C 69.6 F
T+0: Tc 0: 21.5 C 70.7 F ( Wed Jun 18 16:20:22 2025 )
T+0: Tc 1: 20.9 C 69.6 F
T+1: Launch detected ( Wed Jun 18 16:20:23 2025 )
T+1: |2|: Magneto #1 no reading ( Wed Jun 18 16:20:23 2025 )
T+1: |3|: ML |B|=49513.2 RF=49510.0 NN=--- C=1 Z=0.42 RoC=3.1 ( Wed Jun 18 16:20:23 2025 )
T+2: Tc 1: -3.0 C 26.6 F ( Wed Jun  4 16:20:24 2025 )
T+3: |4|: Magneto #2 X: 1 Y: 2 Z: 2 ( Wed Jun  4 16:20:25 2025 )
T+4: |5|: Magneto #2 X: 1 Y: 2 Z: 2 ( not a date )
junk
"""


def _telemetry(spark, tmp_path, **options):
    (tmp_path / "a.dat").write_bytes(LOG.encode() + b"T+5: Odd \xff byte ( Wed Jun 18 16:20:26 2025 )\n")
    return logs.parse_telemetry(logs.read_log_lines(spark, str(tmp_path / "a.dat")), **options)


def test_all_record_types(spark, tmp_path):
    for t in (_telemetry(spark, tmp_path), _telemetry(spark, tmp_path, slice_rows=2),
              _telemetry(spark, tmp_path, store=str(tmp_path / "typed"))):
        assert table_of(t.counts(), "record_type", "n") == [
            ("adc", 1), ("events", 4), ("magneto", 3), ("pressure", 1), ("thermo", 1)]
        assert table_of(t.adc, "line_no", "time_mission", "a0", "a1", "a2", "a3") == [(6, -1, 0.55, 0.551, None, 0.55)]
        assert table_of(t.thermo, "line_no", "tc0_C", "tc0_F", "tc1_C", "tc1_F") == [(12, 21.5, 70.7, 20.9, 69.6)]
        assert [r[0] for r in table_of(t.events, "event")] == [
            "Launch detected", "Odd byte", "Tc 1: -3.0 C 26.6 F", "|3|: ML |B|=49513.2 RF=49510.0 NN=--- C=1 Z=0.42 RoC=3.1"]


def test_magnetometer_values_and_dates(spark, tmp_path):
    rows = _telemetry(spark, tmp_path).magneto.orderBy("line_no").collect()
    assert [(r.time_mission, r.reading_number, r.sensor_id, r.x, r.y, r.z) for r in rows] == [
        (-2, 1, 0, 20011, -4987, 45020), (3, 4, 2, 1, 2, 2), (4, 5, 2, 1, 2, 2)]
    assert rows[1].magnitude == 3.0 and rows[2].event_ts is None and str(rows[1].event_ts) == "2025-06-04 16:20:25"


def test_line_numbers_survive_file_splits(spark, tmp_path):
    (tmp_path / "b.dat").write_text("".join(f"line {i} {'x' * 50}\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = logs.read_log_lines(spark, str(tmp_path / "b.dat"))
        assert lines.rdd.getNumPartitions() > 1
        bad = lines.where(F.col("line_no") != F.split("line", " ")[1].cast("long")).count()
        assert bad == 0 and lines.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rendered_lines_parse_back(spark, readings):
    from telluria.sinks import render_magneto_lines

    lines = render_magneto_lines(readings).select(F.lit("f").alias("path"), F.col("reading_number").alias("line_no"), "line")
    back = logs.parse_magnetometer(logs.classify(logs.clean_lines(lines)))
    want = readings.select("reading_number", "sensor_id", F.col("bx").cast("int").alias("x"), F.col("bz").cast("int").alias("z"))
    assert table_of(back, "reading_number", "sensor_id", "x", "z") == table_of(want, "reading_number", "sensor_id", "x", "z")
