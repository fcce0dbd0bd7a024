"""Fitting, splitting, scoring with MLlib (survey 2.8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telluria.operators.quantiles import percentiles
from telluria.operators.series import RN, SIZE, Series
from telluria.operators.windows import feature_names
from telluria.schema import AXES, KEYS, ORDER
from telluria.session import SLICE_ROWS, attach, profile, stored

FLIGHT = ("flight_id",)
SEED = 42


def unit_hash(*keys: str | Column, seed: int = SEED) -> Column:
    """Number in [0, 1) that depends on the keys only, not on partitioning."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def drawn(*keys: str, seed: int = SEED) -> Column:
    """Number in [0, 1) from the digest of the keys as text, which any engine can
    repeat; dearer than ``unit_hash``."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


# Splits and samples

def split_random(df: DataFrame, key: Sequence[str], test: float = 0.2, seed: int = SEED) -> DataFrame:
    """Seeded holdout as ``is_train``."""
    return df.withColumn("is_train", drawn(*key, seed=seed) >= test)


def split_temporal(df: DataFrame, at: float | None = None, fraction: float = 0.7,
                   t: str = "mission_time_s", by: Sequence[str] = FLIGHT,
                   slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``is_train`` before the split time, else test; the time defaults to an
    exact percentile."""
    if at is not None:
        return df.withColumn("is_train", F.col(t) < at)
    groups, largest = profile(df, by)
    cut = percentiles(df, by, t, {"_cut": fraction}, slice_rows, largest=largest)
    return attach(df, cut, by, groups=groups).withColumn("is_train", F.col(t) < F.col("_cut")).drop("_cut")


def stratified_sample(df: DataFrame, key: Sequence[str], chunks: int = 20, total: int = 500,
                      by: Sequence[str] = FLIGHT, order: Sequence[str] = ORDER, seed: int = SEED,
                      slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Equal random shares of ``chunks`` stretches of time."""
    s = Series.of(df, by, order, numbered=True, slice_rows=slice_rows)
    tiled = s.rows.withColumn("chunk", F.floor((F.col(RN) - 1) * chunks / F.col(SIZE))).drop(RN, SIZE)
    pick = Window.partitionBy(*by, "chunk").orderBy(drawn(*key, seed=seed), *key)
    return tiled.withColumn("_k", F.row_number().over(pick)).where(F.col("_k") <= total // chunks).drop("_k")


# Regressors and clusters

def _pipeline(learner, cols: Sequence[str], invalid: str = "skip") -> Pipeline:
    """Skipping rows with missing values tests all columns in one predicate,
    which the optimizer spells out for every renaming; wide inputs use "error"."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="_features",
                                            handleInvalid=invalid), learner])


def _dealt(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns of a fit as a table of even files.  A fit reads its rows
    several times, and rows that come from windows lie in one partition a group."""
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    return stored(df.select(*dict.fromkeys(cols)).repartition(parts))


def fit_reconstruction_forest(df: DataFrame, target: str = "magnitude", cols: Sequence[str] = AXES,
                              trees: int = 200, depth: int = 20, seed: int = SEED,
                              out: str = "magnitude_rf") -> PipelineModel | None:
    """Random forest from the axes to the magnitude; None below ten rows."""
    df = _dealt(df, [*cols, target])
    if df.limit(10).count() < 10:
        return None
    rf = RandomForestRegressor(featuresCol="_features", labelCol=target, predictionCol=out, numTrees=trees,
                               maxDepth=depth, maxBins=256, featureSubsetStrategy="all", seed=seed)
    return _pipeline(rf, cols).fit(df)


def fit_second_regressor(df: DataFrame, target: str = "magnitude", cols: Sequence[str] = AXES,
                         rounds: int = 20, depth: int = 5, seed: int = SEED,
                         out: str = "magnitude_nn") -> PipelineModel:
    """A second, independent learner for the consensus: boosted trees."""
    gbt = GBTRegressor(featuresCol="_features", labelCol=target, predictionCol=out, maxIter=rounds,
                       maxDepth=depth, seed=seed)
    return _pipeline(gbt, cols).fit(df)


def fit_forecaster(features: DataFrame, trees: int = 50, depth: int = 12, min_leaf: int = 5,
                   seed: int = SEED, out: str = "forecast") -> PipelineModel:
    """Random forest on the 31 window features."""
    rf = RandomForestRegressor(featuresCol="_features", labelCol="target", predictionCol=out, numTrees=trees,
                               maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="all", seed=seed)
    return _pipeline(rf, feature_names(), "error").fit(_dealt(features, [*feature_names(), "target"]))


def fit_kmeans(df: DataFrame, k: int | None = None, max_k: int = 6, cols: Sequence[str] = AXES,
               seed: int = SEED, out: str = "cluster_id") -> PipelineModel | None:
    """K-means; ``k`` is chosen by the silhouette unless given.  None below
    three rows: every row then belongs to one cluster at the origin."""
    df = df.select(*cols).persist()
    try:
        return _best_kmeans(df, k, max_k, cols, seed, out)
    finally:
        df.unpersist()


def _best_kmeans(df: DataFrame, k: int | None, max_k: int, cols: Sequence[str], seed: int,
                 out: str) -> PipelineModel | None:
    size = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.sum("count"), F.max("count")).first()
    n, largest = size[0] or 0, size[1]
    if n < 3:
        return None

    def fit(count: int) -> PipelineModel:
        return _pipeline(KMeans(featuresCol="_features", predictionCol=out, k=count, seed=seed), cols).fit(df)

    if k is not None:
        return fit(k)

    def judged(count: int) -> tuple[PipelineModel, float]:
        model = fit(count)
        rows = model.transform(df).select(*cols, out).persist()  # two passes read the clusters
        try:
            return model, silhouette(rows, out, cols)
        finally:
            rows.unpersist()

    counts = range(max(2, min(max_k, n // 100)), 1, -1)  # the dearest first
    # MLlib draws its first centres by partition, so rows stay where they are and
    # as many fits run at a time as fill the cores; each holds its rows in memory.
    together = -(-df.sparkSession.sparkContext.defaultParallelism * largest // n)
    with ThreadPool(min(len(counts), together)) as pool:
        found = pool.map(inheritable_thread_target(df.sparkSession)(judged), counts, chunksize=1)
    best, best_score = None, -2.0
    for model, score in reversed(found):
        if score > best_score:
            best, best_score = model, score
    return best


def silhouette(df: DataFrame, label: str, cols: Sequence[str] = AXES) -> float:
    """Mean silhouette by squared distance, the value of ``ClusteringEvaluator``
    from plain columns: a mean squared distance to a cluster needs only its size,
    its sums and its sum of squares.  -1 where there is one cluster."""
    at, squares = F.col(label), reduce(add, [F.col(c) * F.col(c) for c in cols])
    clusters = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.sum(squares).alias("_squares"),
                                     *[F.sum(c).alias(c) for c in cols]).collect()
    if len(clusters) < 2:
        return -1.0
    own, others = [], []
    for s in clusters:
        n = s["_n"]
        dots = reduce(add, [F.col(c) * F.lit(s[c] / n) for c in cols])
        away = F.greatest(squares + F.lit(s["_squares"] / n) - 2 * dots, F.lit(0.0))
        others.append(F.when(at != s[label], away))
        if n > 1:  # a row alone in its cluster has no value of its own and counts 0
            own.append(F.when(at == s[label], away * F.lit(n / (n - 1))))
    own, other = F.coalesce(*own, F.lit(None).cast("double")), F.least(*others)
    score = F.when(F.col("_own") != F.col("_other"),
                   (F.col("_other") - F.col("_own")) / F.greatest("_own", "_other")).otherwise(0.0)
    return df.select(own.alias("_own"), other.alias("_other")).agg(F.avg(score)).first()[0]


def cluster_centers(spark: SparkSession, model: PipelineModel | None, cols: Sequence[str] = AXES) -> DataFrame:
    centers = [[0.0] * len(cols)] if model is None else [c.tolist() for c in model.stages[-1].clusterCenters()]
    return spark.createDataFrame([(i, *c) for i, c in enumerate(centers)],
                                 ", ".join(["cluster_id int", *[f"`{c}` double" for c in cols]]))


def score_batch(df: DataFrame, models: Sequence[PipelineModel | None], absent: Sequence[str] = ()) -> DataFrame:
    """Add every model's output column; columns named ``absent`` are NULL."""
    for m in models:
        if m is not None:
            df = m.transform(df).drop("_features")
    return df.withColumns({c: F.lit(None).cast("double") for c in absent})


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Named importances, largest first."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda p: (-p[1], p[0]))
    return spark.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(rows)],
                                 "place int, feature string, importance double")


def clip_uncertainty(df: DataFrame, target: str, prediction: str, sigma: str, low: float = 0.5, high: float = 5.0,
                     by: Sequence[str] = FLIGHT) -> DataFrame:
    """Keep sigma within multiples of the spread of |error|, and its 95 % band."""
    spread = df.groupBy(*by).agg(F.stddev_pop(F.abs(F.col(target) - F.col(prediction))).alias("_s"))
    rows = attach(df, spread, by, groups=profile(df, by).groups)
    clipped = F.least(F.greatest(F.col(sigma), F.col("_s") * low), F.col("_s") * high)
    rows = rows.withColumn(sigma, clipped).drop("_s")
    return rows.withColumns({"band_low": F.col(prediction) - 1.96 * F.col(sigma),
                             "band_high": F.col(prediction) + 1.96 * F.col(sigma)})


def retrain_on_window(df: DataFrame, rows: int = 200, by: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
                      generation: int = 0, trees: int = 200, depth: int = 20) -> dict[str, PipelineModel | None]:
    """Refit on the latest rows of each sensor: ten more trees per generation
    up to a thousand, and at most three clusters."""
    newest = Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order])
    recent = df.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= rows).drop("_k")
    n = recent.count()
    return {
        "forest": fit_reconstruction_forest(recent, trees=min(1000, trees + 10 * generation), depth=depth),
        "clusters": fit_kmeans(recent, k=max(1, min(3, n // 10))) if n >= 10 else None}


# Persistence

def save_model(model: PipelineModel, path: str, fingerprint: DataFrame, metrics: Mapping[str, float]) -> None:
    """The fitted pipeline, and beside it the identity of its training data."""
    model.write().overwrite().save(f"{path}/model")
    cols = model.stages[0].getInputCols()
    row = fingerprint.select("n_rows", "hash_xor", "hash_sum").withColumns({
        "n_features": F.lit(len(cols)), "features": F.array(*[F.lit(c) for c in cols]),
        "metrics": F.create_map(*[F.lit(x) for kv in metrics.items() for x in kv])
        if metrics else F.lit(None).cast("map<string,double>")})
    row.write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str, fingerprint: DataFrame | None = None,
               n_features: int | None = None) -> PipelineModel | None:
    """The stored pipeline; None when the data or the features have changed."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if n_features is not None and meta["n_features"] != n_features:
        return None
    if fingerprint is not None:
        now = fingerprint.select("n_rows", "hash_xor", "hash_sum").first()
        if any(now[c] != meta[c] for c in ("n_rows", "hash_xor", "hash_sum")):
            return None
    return PipelineModel.load(f"{path}/model")


# Regression with uncertainty

@dataclass(frozen=True)
class BayesianRegression:
    """Linear regression on random Fourier features of the scaled axes."""

    cols: tuple[str, ...]
    shift: np.ndarray
    scale: np.ndarray
    y_shift: float
    y_scale: float
    weights: np.ndarray  # (features, axes)
    phase: np.ndarray
    mean: np.ndarray
    covariance: np.ndarray
    noise: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        return _expand((x - self.shift) / self.scale, self.weights, self.phase)

    def predict(self, df: DataFrame, out: str = "magnitude_gpr", sigma: str = "sigma") -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType()),
                               T.StructField(sigma, T.DoubleType())])

        def run(batches):
            m = model.value
            for batch in batches:
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in m.cols])
                phi = m.expand(x)
                mean = phi @ m.mean * m.y_scale + m.y_shift
                var = m.noise + np.einsum("ij,jk,ik->i", phi, m.covariance, phi, optimize=True)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(mean), pa.array(np.sqrt(var) * m.y_scale)],
                    [*batch.schema.names, out, sigma])

        return df.mapInArrow(run, schema)


def _expand(z: np.ndarray, weights: np.ndarray, phase: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phase)) * np.cos(z @ weights.T + phase)


def _evidence(gram, moment, yy, n, rounds: int = 50):
    """Prior and noise precision that make the data most likely, from the
    sufficient statistics alone; returns mean, covariance, noise, log evidence."""
    lam, vec = np.linalg.eigh(gram)
    lam = np.clip(lam, 0, None)
    proj = vec.T @ moment
    a, b = 1.0, 1.0
    for _ in range(rounds):
        m = b * proj / (a + b * lam)
        gamma = float(np.sum(b * lam / (a + b * lam)))
        rss = max(float(yy - 2 * m @ proj + m @ (lam * m)), 1e-12)
        a = gamma / max(float(m @ m), 1e-12)
        b = max(n - gamma, 1e-9) / rss
    m = b * proj / (a + b * lam)
    rss = max(float(yy - 2 * m @ proj + m @ (lam * m)), 1e-12)
    log_ev = 0.5 * (len(lam) * np.log(a) + n * np.log(b) - b * rss - a * m @ m
                    - np.sum(np.log(a + b * lam)) - n * np.log(2 * np.pi))
    return vec @ m, (vec / (a + b * lam)) @ vec.T, 1.0 / b, float(log_ev)


def fit_bayesian_regression(df: DataFrame, target: str = "magnitude", cols: Sequence[str] = AXES,
                            features: int = 100, lengths: Sequence[float] = (0.5, 1.0, 2.0, 4.0, 8.0),
                            seed: int = SEED) -> BayesianRegression:
    """Fit on all rows: every task reduces its rows to a Gram matrix for each
    length scale, Spark adds the matrices entry by entry, and the driver solves
    small systems and keeps the length with the largest evidence."""
    rows = df.select(*cols, target).dropna()
    aggs = [f(c).alias(f"{n}_{c}") for c in (*cols, target) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]
    one = rows.agg(*aggs, F.count(F.lit(1)).alias("n")).first()
    shift = np.array([one[f"m_{c}"] for c in cols])
    scale = np.array([one[f"s_{c}"] or 1.0 for c in cols])
    y_shift, y_scale = one[f"m_{target}"], one[f"s_{target}"] or 1.0
    rng = np.random.default_rng(seed)
    base, phase = rng.standard_normal((features, len(cols))), rng.uniform(0, 2 * np.pi, features)
    names, name_y, scales = list(cols), target, list(lengths)
    i, j = np.triu_indices(features)

    def partial(batches):
        gram, moment, yy = np.zeros((len(scales), features, features)), np.zeros((len(scales), features)), 0.0
        for pdf in batches:
            z = (pdf[names].to_numpy() - shift) / scale
            t = (pdf[name_y].to_numpy() - y_shift) / y_scale
            for n, length in enumerate(scales):
                phi = _expand(z, base / length, phase)
                gram[n] += phi.T @ phi
                moment[n] += phi.T @ t
            yy += float(t @ t)
        for n in range(len(scales)):
            yield pd.DataFrame({
                "scale": n, "i": np.concatenate([i, np.arange(features), [-1]]),
                "j": np.concatenate([j, np.full(features, -1), [-1]]),
                "v": np.concatenate([gram[n][i, j], moment[n], [yy]])})

    sums = (rows.mapInPandas(partial, "scale int, i long, j long, v double").groupBy("scale", "i", "j")
            .agg(F.sum("v").alias("v")).toPandas())
    best = None
    for n, length in enumerate(scales):
        own = sums[sums.scale == n]
        gram, moment = np.zeros((features, features)), np.zeros(features)
        cells, lead = own[own.j >= 0], own[(own.i >= 0) & (own.j < 0)]
        gram[cells.i, cells.j] = cells.v
        gram[cells.j, cells.i] = cells.v
        moment[lead.i] = lead.v
        found = _evidence(gram, moment, float(own[own.i < 0].v.iloc[0]), int(one["n"]))
        if best is None or not found[3] <= best[1][3] and np.isfinite(found[3]):
            best = base / length, found
    weights, (mean, cov, noise, _) = best
    return BayesianRegression(tuple(cols), shift, scale, y_shift, y_scale, weights, phase, mean, cov, noise)
