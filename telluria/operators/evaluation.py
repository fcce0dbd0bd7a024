"""How good and how stable fitted models are (survey 2.8, M12-M18)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telluria.functions.scalar import magnitude
from telluria.operators.aggregates import metrics_by, regression_metrics
from telluria.operators.models import SEED, _dealt, unit_hash
from telluria.operators.series import Series
from telluria.schema import AXES
from telluria.session import SLICE_ROWS, attach, stored

Fit = Callable[[DataFrame], PipelineModel]


def cross_validate(df: DataFrame, fit: Fit, key: Sequence[str], target: str, prediction: str,
                   folds: int = 5, seed: int = SEED) -> DataFrame:
    """Metrics of each fold, the folds being shares of a key hash."""
    placed = stored(df.withColumn("fold", F.floor(unit_hash(*key, seed=seed) * folds).cast("int")))
    parts = []
    for k in range(folds):
        model = fit(placed.where(F.col("fold") != k))
        parts.append(model.transform(placed.where(F.col("fold") == k)).drop("_features"))
    return metrics_by(reduce(DataFrame.unionByName, parts), target, prediction, ["fold"])


def fold_spread(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"),
                     F.min("r2").alias("r2_min"), F.avg("rmse").alias("rmse_mean"))


def permutation_importance(df: DataFrame, model: PipelineModel, key: Sequence[str], target: str, prediction: str,
                           cols: Sequence[str] = AXES, by: Sequence[str] = ("flight_id",), seed: int = SEED,
                           slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Loss of R2 when one column is shuffled.

    In hash order every row takes the value of the next row and the last one
    that of the first: a random cycle over the group, found with one sort.
    """
    tag = unit_hash(*key, seed=seed).alias("_h")
    rows = df.select(*by, *key, *[c for c in cols if c not in key], target, tag)
    s = Series.of(rows, by, ["_h", *key], slice_rows=slice_rows).mutate(
        lambda d, w: d.withColumns({f"_n_{c}": F.lead(c).over(w) for c in cols}), after=1)
    firsts = rows.groupBy(*by).agg(*[F.min_by(c, F.struct("_h", *key)).alias(f"_f_{c}") for c in cols])
    wide = attach(s.df, firsts, by)
    variants = {"": {c: F.col(c) for c in cols}} | {
        v: {c: F.coalesce(F.col(f"_n_{c}"), F.col(f"_f_{c}")) if c == v else F.col(c) for c in cols} for v in cols}
    scored = metrics_by(model.transform(_variants(wide, variants, [target])).drop("_features"),
                        target, prediction, ["condition"])
    base = scored.where("condition = ''").select(F.col("r2").alias("r2_base"))
    rest = scored.where("condition != ''").crossJoin(F.broadcast(base))
    return rest.select(F.col("condition").alias("feature"), "r2_base", F.col("r2").alias("r2_shuffled"),
                       (F.col("r2_base") - F.col("r2")).alias("importance"))


def _variants(df: DataFrame, variants: Mapping[str, Mapping[str, Column]], keep: Sequence[str]) -> DataFrame:
    """Every row once per variant, in one scan: ``condition`` and the columns."""
    structs = [F.struct(F.lit(name).alias("condition"), *[c.cast("double").alias(n) for n, c in cols.items()])
               for name, cols in variants.items()]
    return df.select(*keep, F.explode(F.array(*structs)).alias("_v")).select(*keep, "_v.*")


def synthetic_probe(df: DataFrame, key: Sequence[str], low: float = -7000.0, high: float = 7000.0,
                    cols: Sequence[str] = AXES, seed: int = SEED) -> DataFrame:
    """One uniform random vector per input row with its known magnitude."""
    out = df.select(*key, *[(F.lit(low) + unit_hash(*key, F.lit(c), seed=seed) * (high - low)).alias(c) for c in cols])
    return out.withColumn("magnitude", magnitude(*cols))


def gaussian(key: Sequence[str], name: str, seed: int = SEED) -> Column:
    """Standard normal number that depends on the key only."""
    u = F.greatest(unit_hash(*key, F.lit(name), F.lit("r"), seed=seed), F.lit(1e-15))
    v = unit_hash(*key, F.lit(name), F.lit("a"), seed=seed)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(v * F.lit(6.283185307179586))


def distribution_shift(df: DataFrame, model: PipelineModel, key: Sequence[str], prediction: str,
                       cols: Sequence[str] = AXES, noise: Sequence[float] = (5.0, 10.0, 20.0),
                       scales: Sequence[float] = (1.02, 0.98, 1.15), seed: int = SEED) -> DataFrame:
    """Metrics under scaling, sensor noise, exchanged axes and a turned sign."""
    v = [F.col(c) for c in cols]
    named = lambda values: dict(zip(cols, values))
    variants = {"original": named(v)}
    for s in scales:
        variants[f"scale {s}"] = named([c * F.lit(s) for c in v])
    for n in noise:
        variants[f"noise {n}"] = named([c + F.lit(n) * gaussian(key, f"{name}{n}", seed) for c, name in zip(v, cols)])
    variants["axes rotated"] = named([*v[1:], v[0]])
    variants["sign flipped"] = named([-v[0], *v[1:]])
    rows = _variants(df, variants, key).withColumn("_true", magnitude(*cols))
    return metrics_by(model.transform(rows).drop("_features"), "_true", prediction, ["condition"])


def determinism_check(df: DataFrame, model: PipelineModel, key: Sequence[str], prediction: str,
                      tolerance: float = 1e-10, parts: int = 7) -> DataFrame:
    """Score the rows twice under different partitionings and compare; ``parts``
    is the least number of the second, which grows with the cluster."""
    df = _dealt(df, [*key, *model.stages[0].getInputCols()])
    parts = max(parts, 2 * df.sparkSession.sparkContext.defaultParallelism + 1)
    once = model.transform(df).select(*key, F.col(prediction).alias("_a"))
    again = model.transform(df.repartition(parts, *key)).select(*key, F.col(prediction).alias("_b"))
    diff = F.max(F.abs(F.col("_a") - F.col("_b")))
    out = once.join(again, list(key), "full").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
        F.coalesce(diff, F.lit(0.0)).alias("max_diff"))
    return out.withColumn("passed", (F.col("max_diff") < tolerance) & (F.col("unmatched") == 0))


def model_audit(tests: Sequence[tuple[str, str, DataFrame, str, str, str, float, bool]]) -> DataFrame:
    """(model, test, metric, value, threshold, passed) rows.  Each test names a
    model and a test, a scored frame, target, prediction, metric, threshold and
    whether more is better."""
    parts = []
    for name, test, df, target, prediction, metric, threshold, higher in tests:
        value = regression_metrics(df, target, prediction).select(F.col(metric).cast("double").alias("value"))
        ok = F.col("value") >= threshold if higher else F.col("value") <= threshold
        parts.append(value.select(
            F.lit(name).alias("model"), F.lit(test).alias("test"), F.lit(metric).alias("metric"), "value",
            F.lit(float(threshold)).alias("threshold"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return reduce(DataFrame.unionByName, parts)
