"""Exact percentiles that do not gather a group in one task.

Percentiles interpolate linearly between neighbouring ranks.  Groups that fit
in a task use Spark's ``percentile``.  For larger groups a mergeable sketch
brackets each wanted rank, one more pass counts the rows below the bracket, and
only the distinct values inside the bracket are ranked.  The bracket is checked
against exact counts and widened until it holds, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telluria.session import SLICE_ROWS, attach, materialize, profile

SKETCH_ACCURACY = 100_000


def percentiles(df: DataFrame, by: Sequence[str], column: str, wanted: Mapping[str, float],
                group_rows: int = SLICE_ROWS, accuracy: int = SKETCH_ACCURACY,
                largest: int | None = None) -> DataFrame:
    """One row per group with the ``wanted`` percentiles (name to fraction)."""
    if largest is None:
        largest = profile(df, by).largest
    if largest <= group_rows:
        return df.groupBy(*by).agg(
            *[F.percentile(column, F.lit(p)).alias(name) for name, p in wanted.items()])
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    slack = 4.0 / accuracy
    while True:
        result, complete = _bracketed(rows, list(by), wanted, accuracy, slack)
        if complete:
            return result
        slack *= 8


def _bracketed(rows, by, wanted, accuracy, slack):
    names = list(wanted)
    ends = [e for p in wanted.values() for e in (max(0.0, p - slack), min(1.0, p + slack))]
    bounds = rows.groupBy(*by).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), accuracy).alias("_q"))
    cols = []
    for i, (name, p) in enumerate(wanted.items()):
        lo = F.col("_min") if p - slack <= 0 else F.col("_q")[2 * i]
        hi = F.col("_max") if p + slack >= 1 else F.col("_q")[2 * i + 1]
        cols += [lo.alias(f"_lo_{name}"), hi.alias(f"_hi_{name}")]
    # Fixed on disk: sketches merged in another order may differ slightly.
    bounds = materialize(bounds.select(*by, "_n", *cols))
    marked = attach(rows, bounds, by, groups=bounds.count(), how="inner")
    inside = {n: F.col("_v").between(F.col(f"_lo_{n}"), F.col(f"_hi_{n}")) for n in names}
    below = marked.groupBy(*by).agg(
        F.first("_n").alias("_n"),
        *[F.count_if(F.col("_v") < F.col(f"_lo_{n}")).alias(f"_b_{n}") for n in names],
        *[F.count_if(inside[n]).alias(f"_i_{n}") for n in names])
    below = materialize(below)
    place = {n: (F.col("_n") - 1) * F.lit(p) for n, p in wanted.items()}
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.col(f"_b_{n}") <= F.floor(place[n])) & (
            F.col(f"_b_{n}") + F.col(f"_i_{n}") > F.ceil(place[n]))
    complete = below.where(~ok).isEmpty()
    any_inside = inside[names[0]]
    for n in names[1:]:
        any_inside = any_inside | inside[n]
    counted = (marked.where(any_inside)
               .groupBy(*by, "_v", *[f"_{e}_{n}" for n in names for e in ("lo", "hi")])
               .agg(F.count(F.lit(1)).alias("_c")))
    key = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = key.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = attach(counted, below, by, how="inner")
    ranked = ranked.withColumns({
        f"_u_{n}": F.col(f"_b_{n}") + F.sum(F.when(inside[n], F.col("_c")).otherwise(0)).over(upto)
        for n in names})
    picks = []
    for n in names:
        for tag, rank in (("f", F.floor(place[n])), ("c", F.ceil(place[n]))):
            hit = inside[n] & (F.col(f"_u_{n}") > rank)
            picks.append(F.min(F.when(hit, F.col("_v"))).alias(f"_{tag}_{n}"))
    out = ranked.groupBy(*by).agg(F.first("_n").alias("_n"), *picks)
    return out.select(*by, *[
        (F.col(f"_f_{n}") + (F.col(f"_c_{n}") - F.col(f"_f_{n}"))
         * (place[n] - F.floor(place[n]))).alias(n) for n in names]), complete
