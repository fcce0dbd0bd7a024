"""Isolation forest on Spark (survey D1).

Growing: a hash picks the few rows each tree needs, one task grows one tree.
Scoring: Arrow batches walk all trees together.  Small forests are broadcast;
forests of many groups are joined to chunks of rows of bounded size instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telluria import params
from telluria.operators.models import unit_hash
from telluria.operators.quantiles import percentiles
from telluria.schema import AXES, KEYS
from telluria.session import SLICE_ROWS, Profile, attach, materialize, profile, stored

TREES, SAMPLE = 100, 256
CHUNK_ROWS = 200_000
# A group's forest takes under 2 MB, so this many groups stay below 128 MB.
BROADCAST_GROUPS = 64
FOREST_SCHEMA = ("_g string, tree int, psi int, feature array<int>, threshold array<double>, "
                 "left array<int>, right array<int>, path array<double>")


def expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Random axis-parallel cuts until rows are alone or deep enough."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    tree: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "path")}

    def node() -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("path", 0.0)):
            tree[k].append(v)
        return len(tree["feature"]) - 1

    todo = [(node(), x, 0)]
    while todo:
        at, rows, depth = todo.pop()
        lo, hi = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        open_axes = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(open_axes):
            tree["path"][at] = depth + expected_path(len(rows))
            continue
        f = int(rng.choice(open_axes))
        cut = float(rng.uniform(lo[f], hi[f]))
        below = rows[:, f] <= cut
        tree["feature"][at], tree["threshold"][at] = f, cut
        tree["left"][at], tree["right"][at] = node(), node()
        todo += [(tree["left"][at], rows[below], depth + 1), (tree["right"][at], rows[~below], depth + 1)]
    return tree


class Forest:
    """All trees of one group as padded arrays."""

    def __init__(self, trees: Sequence[dict]):
        width = max(len(t["feature"]) for t in trees)

        def pad(k, fill, kind):
            return np.array([list(t[k]) + [fill] * (width - len(t[k])) for t in trees], dtype=kind)

        self.feature, self.threshold = pad("feature", -1, np.int32), pad("threshold", 0.0, float)
        self.left, self.right = pad("left", -1, np.int32), pad("right", -1, np.int32)
        self.path = pad("path", 0.0, float)
        self.norm = expected_path(float(np.mean([t["psi"] for t in trees])))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Minus two to the power of minus relative depth: -1 is most unusual."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int32)
            live = rows
            while len(live):
                f = self.feature[t, at[live]]
                live = live[f >= 0]
                f = f[f >= 0]
                here = at[live]
                below = x[live, f] <= self.threshold[t, here]
                at[live] = np.where(below, self.left[t, here], self.right[t, here])
            total += self.path[t, at]
        return -np.power(2.0, -(total / len(self.feature)) / max(self.norm, 1e-12))


def _group_key(by: Sequence[str]):
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in by]).alias("_g")


def fit_isolation_forest(df: DataFrame, key: Sequence[str], axes: Sequence[str] = AXES, by: Sequence[str] = KEYS,
                         trees: int = TREES, sample: int = SAMPLE, seed: int = 42,
                         known: Profile | None = None) -> DataFrame:
    """One row per group and tree.  A pool of about twice the rows that all
    trees need is drawn first, so that the per-tree draw touches few rows."""
    rows = df.select(_group_key(by), *axes, F.xxhash64(*key).alias("_k")).dropna()
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    n = attach(rows, sizes, ["_g"], groups=(known or profile(rows, ["_g"])).groups)
    want = 2.0 * trees * sample
    pool = n.where(unit_hash("_k", seed=seed) < F.lit(want) / F.col("_n"))
    share = F.lit(2.0 * sample) / F.least(F.col("_n"), F.lit(want))
    drawn = pool.withColumn("tree", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: unit_hash("_k", t, seed=seed + 1) < share)))
    pick = Window.partitionBy("_g", "tree").orderBy(unit_hash("_k", "tree", seed=seed + 2), "_k")
    drawn = drawn.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= sample)
    names = list(axes)

    def grow(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(keys[1])
        x = pdf.sort_values([*names, "_k"])[names].to_numpy(float)
        t = grow_tree(x, np.random.default_rng([seed, tree]))
        return pd.DataFrame([{"_g": keys[0], "tree": tree, "psi": len(x), **t}])

    return drawn.select("_g", "tree", "_k", *names).groupBy("_g", "tree").applyInPandas(grow, FOREST_SCHEMA)


def _as_forest(rows) -> Forest:
    return Forest([{k: r[k] for k in ("psi", "feature", "threshold", "left", "right", "path")} for r in rows])


def forests_of(forest: DataFrame) -> dict[str, Forest]:
    """The forest of each group, for as many groups as may be broadcast."""
    by_group: dict[str, list] = {}
    for row in forest.orderBy("_g", "tree").collect():
        by_group.setdefault(row["_g"], []).append(row)
    return {g: _as_forest(rows) for g, rows in by_group.items()}


def score_isolation_forest(df: DataFrame, forest: DataFrame, key: Sequence[str], axes: Sequence[str] = AXES,
                           by: Sequence[str] = KEYS, out: str = "iso_score",
                           broadcast_groups: int = BROADCAST_GROUPS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the score of each row; rows of groups without a forest get NULL."""
    tagged = df.withColumn("_g", _group_key(by))
    schema = T.StructType([*tagged.schema.fields, T.StructField(out, T.DoubleType())])
    names = list(axes)
    if forest.select("_g").distinct().limit(broadcast_groups + 1).count() <= broadcast_groups:
        shared = df.sparkSession.sparkContext.broadcast(forests_of(forest))

        def run(batches):
            for batch in batches:
                yield _score_batch(batch, shared.value, names, out)

        return tagged.mapInArrow(run, schema).drop("_g")

    sizes = tagged.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("_s"))
    rows = attach(tagged, sizes, ["_g"]).withColumn(
        "_chunk", F.floor(unit_hash(*key, seed=3) * F.col("_s"))).drop("_s")
    trees = attach(forest, sizes, ["_g"], how="inner").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1))).drop("_s")

    def run_pair(left: pa.Table, right: pa.Table) -> pa.Table:
        forests = {}
        if right.num_rows and left.num_rows:
            picked = sorted(right.to_pylist(), key=lambda r: r["tree"])
            forests = {picked[0]["_g"]: _as_forest(picked)}
        body = left.drop_columns(["_chunk"]).combine_chunks()
        done = [_score_batch(b, forests, names, out) for b in body.to_batches()]
        return pa.Table.from_batches(done) if done else body.append_column(out, pa.array([], pa.float64()))

    return (rows.groupBy("_g", "_chunk").cogroup(trees.groupBy("_g", "_chunk"))
            .applyInArrow(run_pair, schema).drop("_g"))


def _score_batch(batch: pa.RecordBatch, forests: dict[str, Forest], names, out) -> pa.RecordBatch:
    x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float)
    group = batch.column("_g").to_numpy(zero_copy_only=False)
    score = np.full(len(x), np.nan)
    whole = ~np.isnan(x).any(axis=1)
    for g in pd.unique(group):
        if g in forests:
            mine = np.flatnonzero((group == g) & whole)
            score[mine] = forests[g].score(x[mine])
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, mask=np.isnan(score))],
                                      [*batch.schema.names, out])


def flag_lowest(df: DataFrame, score: str, contamination: float, out: str, by: Sequence[str] = KEYS,
                slice_rows: int = SLICE_ROWS, known: Profile | None = None) -> DataFrame:
    """Flag scores strictly below the contamination percentile of the group."""
    groups, largest = known or profile(df, by)
    cut = percentiles(df, by, score, {"_cut": contamination}, slice_rows, largest=largest)
    return attach(df, cut, by, groups=groups).withColumn(out, F.col(score) < F.col("_cut")).drop("_cut")


def isolation_forest(df: DataFrame, key: Sequence[str], axes: Sequence[str] = AXES, by: Sequence[str] = KEYS,
                     contamination: float = params.FOREST_CONTAMINATION, trees: int = TREES, sample: int = SAMPLE,
                     seed: int = 42, slice_rows: int = SLICE_ROWS, known: Profile | None = None) -> DataFrame:
    """Fit on the rows themselves, score them, flag the most unusual share."""
    known = known or profile(df, by)
    forest = materialize(fit_isolation_forest(df, key, axes, by, trees, sample, seed, known))
    scored = stored(score_isolation_forest(df, forest, key, axes, by))
    return flag_lowest(scored, "iso_score", contamination, "is_iso", by, slice_rows, known)
