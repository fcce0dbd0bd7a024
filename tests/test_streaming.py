"""Every stream gives what its batch twin gives, for any split into files."""

import time

import pytest
from pyspark.sql import functions as F

from conftest import table_of
from telluria.operators import anomaly, forest
from telluria.schema import READINGS
from telluria.streaming import core, detect, monitor, progress


@pytest.fixture(scope="module", params=[1, 4])
def stream(request, spark, readings, tmp_path_factory):
    """Readings in time order over some files, one file per micro-batch."""
    folder = tmp_path_factory.mktemp(f"files{request.param}")
    rows = readings.orderBy("mission_time_s", "reading_number").toPandas()
    step = -(-len(rows) // request.param)
    for i in range(request.param):
        part = rows.iloc[i * step:(i + 1) * step]
        spark.createDataFrame(part, READINGS).coalesce(1).write.parquet(f"{folder}/{i}")

    def open_stream():
        return spark.readStream.schema(READINGS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")

    return open_stream


def test_detector(stream, readings):
    cols = ["reading_number", "z", "roc", "votes", "is_anomaly"]
    got = core.drain(detect.stream_detect(stream(), roc_threshold=50))
    assert table_of(got, *cols) == table_of(anomaly.detect_flight(readings, roc_threshold=50), *cols)


def test_detector_merges_sorted_runs_of_a_large_batch(stream, readings):
    """Groups of more rows than may be held are sorted in runs and merged."""
    cols = ["reading_number", "z", "roc", "votes", "is_anomaly"]
    got = core.drain(detect.stream_detect(stream(), by=["flight_id"], roc_threshold=50, held_rows=60))
    assert table_of(got, *cols) == table_of(anomaly.detect_flight(readings, by=["flight_id"], roc_threshold=50), *cols)


def test_runs_are_merged_in_blocks():
    import random

    import pandas as pd

    from telluria.streaming.ordered import OrderedProcessor

    class Store(dict):
        def updateValue(self, k, v):
            self[k] = v

        getValue, removeKey = dict.__getitem__, dict.__delitem__

    class Seen(OrderedProcessor):
        ring = ("v",)

    for n, held, block in ((1000, 90, 7), (1000, 1000, 100), (37, 5, 50), (0, 5, 5)):
        rows = [(random.randrange(40), i) for i in range(n)]
        random.shuffle(rows)
        seen = Seen(["a", "b"], 10, held_rows=held, run_block=block)
        seen._runs = Store()
        parts = [pd.DataFrame(rows[i:i + 30], columns=["a", "b"]) for i in range(0, n, 30)]
        out = list(seen._ordered(iter(parts)))
        assert [tuple(r) for p in out for r in p.itertuples(index=False)] == sorted(rows) and not seen._runs
        assert all(len(p) <= max(held + 30, block * (1 + n // held)) for p in out)


def test_online_check(spark, stream, readings):
    trees = forest.fit_isolation_forest(readings, ["reading_number"], trees=10).cache()
    cols = ["reading_number", "iso_score", "z_classic", "is_far", "votes"]
    want = table_of(anomaly.online_check(readings, trees, rows=60), *cols)
    assert table_of(core.drain(detect.stream_online_check(stream(), trees, rows=60)), *cols) == want


@pytest.mark.parametrize("groups", [64, 0])
def test_online_check_scores_after_the_state(spark, stream, readings, monkeypatch, groups):
    """Groups hold only their order; with more forests than may be broadcast, trees are dealt to the states."""
    monkeypatch.setattr(detect, "BROADCAST_GROUPS", groups, raising=False)
    monkeypatch.setattr(detect, "FRAMED_ROWS", 50, raising=False)
    trees = forest.fit_isolation_forest(readings, ["reading_number"], trees=10).cache()
    cols = ["reading_number", "event_ts", "iso_score", "z_classic", "is_far", "votes"]
    df = detect.stream_online_check(stream(), trees, rows=60, held_rows=200)
    assert table_of(core.drain(df), *cols) == table_of(anomaly.online_check(readings, trees, rows=60), *cols)
    q = df.writeStream.format("noop").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    plan = q._jsq.explainInternal(False)
    assert -1 < plan.find("MapInArrow") < plan.find("TransformWithState")


def test_windows_and_sessions(stream, readings):
    add = lambda d: d.withColumns({"z": F.col("bx"), "roc": F.col("bz"), "is_anomaly": F.col("bx") > 50})
    for fn, cols in (
            (lambda d: monitor.stream_monitor(add(d), "2 hours", "1 hour", watermark="40 days"), ["start_us", "n", "z_max", "n_anomalies"]),
            (lambda d: monitor.stream_throughput(add(d), 3600, watermark="40 days"), ["start_us", "n", "n_anomalies"]),
            (lambda d: monitor.stream_sessions(d, "2 hours", watermark="40 days"), ["n", "first_us", "last_us"])):
        assert table_of(core.drain(fn(stream()), "complete"), *cols) == table_of(fn(readings), *cols)


def test_sessions_are_merged_before_they_are_shuffled(stream):
    df = monitor.stream_sessions(stream(), "2 hours", watermark="40 days")
    q = df.writeStream.format("noop").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    below = q._jsq.explainInternal(False).split("Exchange hashpartitioning")[-1]
    assert "MergingSessions" in below


def test_sinks_and_cutoff(spark, stream, readings, tmp_path):
    assert core.drain(core.stream_cutoff(stream())).count() == readings.where("mission_time_s <= 336").count()
    for _ in range(2):  # a second run finds nothing new
        rows = detect.stream_detect(stream(), roc_threshold=50)
        core.stream_sink(rows, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == readings.count()


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    # A batch tests its rows against the watermark of the batch before.
    for i, times in enumerate(([0, 100], [200], [3, 300])):
        spark.createDataFrame([("f", 0, t) for t in times], "flight_id string, sensor_id int, s int").select(
            "flight_id", "sensor_id", F.timestamp_seconds("s").alias("event_ts")).coalesce(1).write.parquet(f"{tmp_path}/{i}")
    df = spark.readStream.schema("flight_id string, sensor_id int, event_ts timestamp").option(
        "maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    got = core.drain(monitor.stream_throughput(df, 5, flag=None))
    assert (0, 2) not in table_of(got, "start_us", "n") and (0, 1) in table_of(got, "start_us", "n")


def test_retrain_counts_readings(stream, readings, tmp_path):
    fits = []
    query = monitor.stream_retrain(stream(), lambda: readings, lambda m, n: fits.append(m), str(tmp_path / "cp"),
                                   every=100, trees=2, depth=2, once=True)
    query.awaitTermination()
    assert fits and all(m["forest"] is not None for m in fits)


def test_retrain_goes_on_counting_after_a_restart(spark, readings, tmp_path):
    rows = readings.orderBy("mission_time_s").toPandas()
    fits = []
    for part in range(2):  # 70 readings each: only both together are enough
        spark.createDataFrame(rows.iloc[70 * part:70 * part + 70], READINGS).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema(READINGS).parquet(f"{tmp_path}/in/*")
        monitor.stream_retrain(stream, lambda: readings, lambda m, n: fits.append((part, n)), str(tmp_path / "cp"), every=100,
                               trees=2, depth=2, once=True).awaitTermination()
    assert fits == [(1, 1)]


def test_progress_counts_rows_and_late_rows(spark, tmp_path):
    """Spark drops by the watermark of the batch before: a row is late when a batch
    at least two before its own saw a time more than ten seconds on."""
    batches = [[1, 40, 100], [50, 60, 95, 120], [111, 100, 30, 130], [131]]
    for i, seconds in enumerate(batches):
        rows = [(f"{i}-{j}", t) for j, t in enumerate(seconds)]
        spark.createDataFrame(rows, "id string, t long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.1)
    stream = (spark.readStream.schema("id string, t long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
              .withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", "10 seconds").dropDuplicates(["id", "ts"]))
    with progress.recording(spark, f"{tmp_path}/progress", trigger_ms=0, held=2):
        kept = core.drain(stream).count()
    table = progress.read_progress(spark, f"{tmp_path}/progress")
    late = []
    for i, seconds in enumerate(batches):
        seen = max((t for b in batches[:max(0, i - 1)] for t in b), default=0)
        late.append(sum(t < seen - 10 for t in seconds))
    got = table.where("input_rows > 0").orderBy("batch_id").select("input_rows", "late_rows").collect()
    assert [tuple(x) for x in got] == [(len(b), n) for b, n in zip(batches, late)]
    run = progress.summarize_progress(table).first()
    assert (run["batches"], run["input_rows"], run["late_rows"]) == (4, 12, sum(late)) and kept == 12 - sum(late)
    assert run["overruns"] == table.count()
