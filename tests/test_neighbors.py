import numpy as np
import pytest

from telluria.operators.metric import MetricTree
from telluria.operators.neighbors import knn_self_join, local_outlier_factor


def brute(x, k):
    d = np.sqrt(((x[:, None, 0] - x[None, :, 0]) ** 2 + (x[:, None, 1] - x[None, :, 1]) ** 2) + (x[:, None, 2] - x[None, :, 2]) ** 2)
    out = []
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:k]
        out.append((order, d[i][order]))
    return out


def points(kind, n=400):
    rng = np.random.default_rng(3)
    if kind == "spread":
        return rng.normal(size=(n, 3))
    if kind == "lattice":
        return rng.integers(0, 4, (n, 3)).astype(float)
    x = rng.normal(size=(n, 3))
    x[: n // 3] = [1.0, 2.0, 3.0]  # a third of the rows at one place
    x[n // 3] = [50.0, 0.0, 0.0]
    return x


def frame(spark, x):
    rows = [(i, *map(float, p)) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, bx double, by double, bz double")


@pytest.mark.parametrize("kind", ["spread", "lattice", "copies"])
def test_knn_equals_brute_force(spark, kind):
    x, k = points(kind), 5
    got = knn_self_join(frame(spark, x), "id", k, by=[], leaf_rows=40, slice_rows=90).toPandas()
    got = got.sort_values(["id", "neighbor_rank"])
    for i, (order, d) in enumerate(brute(x, k)):
        mine = got[got.id == i]
        assert list(mine.neighbor) == order
        assert np.allclose(mine.distance, d)


@pytest.mark.parametrize("kind", ["spread", "copies"])
def test_lof_equals_brute_force(spark, kind):
    x, k = points(kind), 10
    near = brute(x, k)
    kd = np.array([d[-1] for _, d in near])
    lrd = np.array([1 / (np.mean(np.maximum(kd[o], d)) + 1e-10) for o, d in near])
    lof = np.array([np.mean(lrd[o]) / lrd[i] for i, (o, _) in enumerate(near)])
    got = local_outlier_factor(frame(spark, x), "id", k, by=[], leaf_rows=40).orderBy("id").toPandas()
    assert np.allclose(got.lof, lof, rtol=1e-6)
    assert list(got.is_lof) == list(-lof < np.quantile(-lof, 0.02))
    if kind == "copies":
        assert got.is_lof[len(x) // 3]


def test_fewer_rows_than_neighbours(spark):
    got = knn_self_join(frame(spark, points("spread", 4)), "id", 10, by=[])
    assert got.count() == 12


def test_a_row_alone_in_its_group_has_no_factor(spark):
    rows = [("a", i, float(i), 0.0, 0.0) for i in range(6)] + [("b", 9, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, id long, bx double, by double, bz double")
    got = {r["id"]: r for r in local_outlier_factor(df, "id", 3, by=["g"]).collect()}
    assert len(got) == 7 and got[9]["lof"] is None and got[9]["is_lof"] is None
    assert all(got[i]["lof"] is not None for i in range(6))


def vectors(kind, n=500, dims=24):
    rng = np.random.default_rng(8)
    if kind == "noise":
        return rng.normal(size=(n, dims))
    if kind == "lattice":  # many equal distances
        return rng.integers(0, 2, (n, dims)).astype(float)
    x = rng.normal(size=(n, dims)) / 30 + rng.normal(size=(12, dims))[rng.integers(0, 12, n)]
    x[:n // 3] = x[0]  # a third at one place
    x[-3:] = [[1e3] * dims, [1e3] * (dims - 1) + [1e3 + 1e-9], [-1e6] * dims]  # far outliers
    return x


def near_by_definition(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    orders = [[j for j in np.lexsort((np.arange(len(x)), np.round(row, 9))) if j != i][:k] for i, row in enumerate(d)]
    return [(o, d[i][o]) for i, o in enumerate(orders)]


@pytest.mark.parametrize("kind", ["noise", "lattice", "clusters"])
def test_whole_vectors_equal_brute_force(spark, kind):
    x, k = vectors(kind), 6
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")
    df = df.unionByName(spark.createDataFrame([(9001, None), (9002, [float("nan")] * 24), (9003, [None] * 24)], df.schema))
    got = knn_self_join(df, "id", k, axes="vec", by=[], leaf_rows=30).toPandas().sort_values(["id", "neighbor_rank"])
    assert len(got) == len(x) * k
    for i, (order, d) in enumerate(near_by_definition(x, k)):
        mine = got[got.id == i]
        assert np.allclose(mine.distance, d)
        assert list(mine.neighbor) == order


def test_factor_of_whole_vectors(spark):
    x, k = vectors("clusters"), 8
    near = near_by_definition(x, k)
    kd = np.array([d[-1] for _, d in near])
    lrd = np.array([1 / (np.mean(np.maximum(kd[o], d)) + 1e-10) for o, d in near])
    lof = np.array([np.mean(lrd[o]) / lrd[i] for i, (o, _) in enumerate(near)])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")
    got = local_outlier_factor(df, "id", k, axes="vec", by=[], leaf_rows=40).orderBy("id").toPandas()
    assert np.allclose(got.lof, lof, rtol=1e-6)


def test_far_outliers_visit_few_leaves(spark):
    """Planted structure: the bounds keep every query to a few leaves."""
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(size=(60, 16)) / 50 for c in rng.normal(size=(30, 16)) * 5])
    x[:4] += 500 * rng.normal(size=(4, 16))
    rows = [(i, [i], [float(v) for v in p]) for i, p in enumerate(x)]
    tree = MetricTree.build(spark.createDataFrame(rows, "pid long, ids array<long>, v array<double>"), [], 64, fan=8)
    leaves = tree.leaves.select("_node").distinct().count()
    visits = tree.route(tree.radii(6), 6).groupBy("pid").count().toPandas()
    assert leaves > 25 and len(visits) == len(x)
    assert visits["count"].mean() < leaves / 8 and visits["count"].max() < leaves / 2
    assert tree.leaves.groupBy("_node").count().agg({"count": "max"}).first()[0] <= 64


def test_box_factors_equal_those_of_pairs(spark):
    from telluria.operators import neighbors

    rng = np.random.default_rng(4)
    rows = [("f", int(i % 2), i, *map(float, rng.integers(0, 12, 3) if i % 3 else rng.normal(6, 3, 3))) for i in range(1500)]
    rows += [("f", 7, 5000 + i, 1.0, 1.0, 1.0) for i in range(40)] + [("f", 8, 6000, 2.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "flight_id string, sensor_id int, reading_number long, bx double, by double, bz double")
    by, axes = ["flight_id", "sensor_id"], ["bx", "by", "bz"]
    points = neighbors.materialize(neighbors.distinct_points(df, "reading_number", 9, axes, by))
    pairs = neighbors._pair_factors(neighbors.nearest_places(points, 9, axes, by, leaf_rows=4096), 9, by)
    want = {(r.sensor_id, r.pid): r.lof for r in pairs.collect()}
    for queries in (16_384, 50):
        boxes = neighbors._box_factors(points, 9, axes, by, leaf_rows=64, slice_rows=200, leaf_queries=queries)
        got = {(r.sensor_id, r.pid): r.lof for r in boxes.collect()}
        assert got.keys() == want.keys() and (8, 6000) not in got
        assert all(np.isclose(got[p], want[p], rtol=1e-9) for p in want)


@pytest.mark.parametrize("kind", ["noise", "lattice", "clusters"])
def test_shares_of_leaves_give_the_same_neighbours(spark, kind, monkeypatch):
    """Where bounds prune nothing a vector travels once a share, not once a leaf."""
    from telluria.operators import metric

    x, k = vectors(kind), 6
    x = np.concatenate([x, x[:5], x[:2]])
    monkeypatch.setattr(metric, "FEW_LEAVES", 0)
    monkeypatch.setattr(metric, "ASKING", 150)
    monkeypatch.setattr(metric, "HOLDING", 200)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = knn_self_join(df, "id", k, axes="vec", by=[], leaf_rows=30).toPandas().sort_values(["id", "neighbor_rank"])
    for i, (order, d) in enumerate(near_by_definition(x, k)):
        mine = got[got.id == i]
        assert np.allclose(mine.distance, d) and list(mine.neighbor) == order


def test_only_unstructured_vectors_go_by_shares(spark, monkeypatch):
    from telluria.operators import metric

    asked = []
    whole = metric.MetricTree._by_shares
    monkeypatch.setattr(metric.MetricTree, "_by_shares", lambda self, *a: asked.append(1) or whole(self, *a))
    rng = np.random.default_rng(3)
    for x, want in ((rng.normal(size=(900, 24)), 1),
                    (np.concatenate([c + rng.normal(size=(30, 24)) / 50 for c in rng.normal(size=(30, 24)) * 5]), 0)):
        df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")
        asked.clear()
        assert knn_self_join(df, "id", 4, axes="vec", by=[], leaf_rows=40).count() == len(x) * 4
        assert len(asked) == want


def shuffled_bytes(spark, run):
    """Bytes that the stages of ``run`` write for others."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        quantiles = sc._gateway.new_array(jvm.double, 0)
        found = store.stageList(jvm.java.util.ArrayList(), False, False, quantiles, jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_box_factors_shuffle_no_lists_of_neighbours(spark):
    """Places of other boxes travel once for a box, not once for each neighbour (F3)."""
    x = np.random.default_rng(6).uniform(size=(6000, 3))
    df = frame(spark, x).cache()
    df.count()
    n = shuffled_bytes(spark, lambda: local_outlier_factor(df, "id", 50, by=[], leaf_rows=1500).write.format("noop").mode("overwrite").save())
    assert n < 600 * len(x)


@pytest.mark.parametrize("kind", ["lattice", "copies", "far"])
def test_lof_of_ties_and_outliers_in_small_boxes(spark, kind):
    x, k = points("copies" if kind == "far" else kind, 500), 7
    if kind == "far":
        x[-4:] = [[1e6, 0, 0], [0, -1e5, 0], [1e6, 1e-3, 0], [3e3, 3e3, -3e3]]
        x[:60, 1:] = 0.5  # one line
    near = brute(x, k)
    kd = np.array([d[-1] for _, d in near])
    lrd = np.array([1 / (np.mean(np.maximum(kd[o], d)) + 1e-10) for o, d in near])
    lof = np.array([np.mean(lrd[o]) / lrd[i] for i, (o, _) in enumerate(near)])
    got = local_outlier_factor(frame(spark, x), "id", k, by=[], leaf_rows=20).orderBy("id").toPandas()
    assert np.allclose(got.lof, lof, rtol=1e-6)


def test_detectors_per_sensor_shuffle_no_lists_of_neighbours(spark):
    """Sensors above the size of a leaf (F2)."""
    from telluria.operators.anomaly import detect_per_sensor

    rng = np.random.default_rng(9)
    rows = [("f", i % 2, i, 1.0 + i, *map(float, p), float(np.sqrt((p ** 2).sum()))) for i, p in enumerate(rng.normal(50, 9, (6000, 3)))]
    df = spark.createDataFrame(rows, "flight_id string, sensor_id int, reading_number long, mission_time_s double, "
                                     "bx double, by double, bz double, magnitude double").cache()
    df.count()
    found = []
    n = shuffled_bytes(spark, lambda: found.extend(detect_per_sensor(df, trees=10).select("is_anomaly", "show_z").collect()))
    assert len(found) == len(rows) and all(r.is_anomaly is not None and r.show_z is not None for r in found)
    assert n < 1000 * len(rows)
