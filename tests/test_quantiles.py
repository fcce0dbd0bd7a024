import numpy as np
import pytest

from telluria.operators.quantiles import percentiles


@pytest.mark.parametrize("kind", ["normal", "ties", "constant"])
def test_bracketed_equals_numpy(spark, kind):
    rng = np.random.default_rng(0)
    values = {"normal": rng.normal(size=4000), "ties": rng.integers(0, 7, 4000).astype(float),
              "constant": np.full(4000, 3.5)}[kind]
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "g int, v double")
    wanted = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = percentiles(df, ["g"], "v", wanted, group_rows=100, accuracy=200).toPandas().set_index("g")
    for g in (0, 1):
        for name, p in wanted.items():
            assert abs(got.loc[g, name] - np.quantile(values[g::2], p)) < 1e-9


def test_without_groups(spark):
    df = spark.range(1001).selectExpr("cast(id as double) v")
    assert percentiles(df, [], "v", {"m": 0.5}, group_rows=10).first()["m"] == 500.0
