"""Grouped statistics and reports (survey 2.5).

Everything here is an aggregate with map-side combine; exact percentiles go
through :mod:`telluria.operators.quantiles`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telluria import params
from telluria.operators.joins import label_phases
from telluria.operators.projections import plausible_temperature
from telluria.operators.quantiles import percentiles
from telluria.operators.series import Series
from telluria.schema import AXES, KEYS, ORDER
from telluria.session import BROADCAST_ROWS, SLICE_ROWS, attach, materialize, profile

FLIGHT = ("flight_id",)


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
              key: str = "metric", value: str = "value") -> DataFrame:
    """Unpivot ``columns`` (cast to double) into key/value rows."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return df.select(*keep, F.expr(f"stack({len(columns)}, {pairs}) as (`{key}`, `{value}`)"))


def resample_mean(df: DataFrame, step: float = 1.0, by: Sequence[str] = KEYS,
                  t: str = "mission_time_s") -> DataFrame:
    """Mean axes and mean magnitude per time step of each group."""
    return (df.groupBy(*by, (F.floor(F.col(t) / step) * F.lit(step)).alias("time"))
            .agg(*[F.avg(c).alias(c) for c in (*AXES, "magnitude")],
                 F.count(F.lit(1)).alias("n")))


def avg_by_time(df: DataFrame, values: Sequence[str], flags: Sequence[str] = (),
                by: Sequence[str] = FLIGHT, t: str = "mission_time_s",
                ratio: float = 0.8) -> DataFrame:
    """Average the rows that share a timestamp, in groups where fewer than
    ``ratio`` of the rows have a time of their own; other groups pass through."""
    per_time = df.groupBy(*by, t).agg(
        F.count(F.lit(1)).alias("_c"), *[F.avg(v).alias(v) for v in values],
        *[F.bool_or(f).alias(f) for f in flags])
    shares = per_time.groupBy(*by).agg(
        (F.count(F.lit(1)) < F.lit(ratio) * F.sum("_c")).alias("_merge"))
    cols = [*by, t, *values, *flags]
    rows = attach(df.select(*cols), shares, by)
    merged = attach(per_time.select(*cols), shares, by)
    return rows.where(~F.col("_merge")).select(*cols).unionByName(
        merged.where(F.col("_merge")).select(*cols))


def sensor_summary(df: DataFrame, by: Sequence[str] = KEYS, value: str = "magnitude",
                   t: str = "mission_time_s") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(t) > 0).alias("n_in_flight"),
        F.min(value).alias("mag_min"), F.max(value).alias("mag_max"), F.avg(value).alias("mag_mean"),
        F.min(t).alias("t_first"), F.max(t).alias("t_last"),
        (F.max(t) - F.min(t)).alias("t_span"))


def flag_rates(df: DataFrame, flags: Sequence[str], by: Sequence[str] = FLIGHT) -> DataFrame:
    """Count and percentage per flag, in long form."""
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.sum(F.coalesce(F.col(f).cast("long"), F.lit(0))).alias(f) for f in flags])
    rows = long_form(wide, flags, [*by, "n_rows"], "flag", "n_flagged")
    return rows.withColumn("n_flagged", F.col("n_flagged").cast("long")).withColumn(
        "pct", F.lit(100.0) * F.col("n_flagged") / F.col("n_rows"))


def _metric_columns(y: Column, p: Column) -> dict[str, Column]:
    """Error sums around the target mean; two-pass sums are not needed because
    the variance aggregate is itself stable."""
    e = y - p
    n = F.count(e)
    ss_tot = F.var_pop(y) * n
    ss_res = F.sum(e * e)
    r2 = F.when(ss_tot > 0, 1 - ss_res / F.when(ss_tot > 0, ss_tot)).otherwise(0.0)
    return {
        "n": n,
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": F.when(n > 0, r2),
        "mape": F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(1.0))) * 100,
        "bias": F.avg(e),
    }


def regression_metrics(df: DataFrame, target: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """n, MAE, MSE, RMSE, R2, MAPE and bias; rows without a prediction drop out."""
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    rows = df.where(y.isNotNull() & p.isNotNull() & ~F.isnan(p))
    cols = [c.alias(name) for name, c in _metric_columns(y, p).items()]
    return rows.groupBy(*by).agg(*cols)


def metrics_by(df: DataFrame, target: str, prediction: str, by: Sequence[str]) -> DataFrame:
    """As :func:`regression_metrics` per group; R2 is NULL for a single row."""
    return regression_metrics(df, target, prediction, by).withColumn(
        "r2", F.when(F.col("n") > 1, F.col("r2")))


def metrics_by_phase(df: DataFrame, target: str, prediction: str, t: str = "mission_time_s",
                     phases: Sequence[params.Phase] = params.PHASES) -> DataFrame:
    return metrics_by(label_phases(df, phases, t), target, prediction, ["phase"])


def cluster_profile(df: DataFrame, cluster: str = "cluster_id", axes: Sequence[str] = AXES,
                    by: Sequence[str] = FLIGHT) -> DataFrame:
    per = df.groupBy(*by, cluster).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"{a}_centroid") for a in axes])
    total = per.groupBy(*by).agg(F.sum("n").alias("_all"))
    return attach(per, total, by).withColumn("pct", F.lit(100.0) * F.col("n") / F.col("_all")).drop("_all")


def histogram(df: DataFrame, value: str, bins: int = 50, by: Sequence[str] = FLIGHT) -> DataFrame:
    """Equal-width counts between minimum and maximum, empty bins included; the
    last bin holds its upper edge.  Equal ends widen by half a unit."""
    groups = profile(df, by).groups
    ends = df.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    ends = ends.select(*by, F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5)
                       .otherwise(F.col("_a")).alias("_lo"),
                       F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5)
                       .otherwise(F.col("_b")).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    placed = attach(df.select(*by, value).where(F.col(value).isNotNull()), ends, by, groups=groups)
    index = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = attach(grid, counts, [*by, "bin"],
                  groups=groups * bins if groups * bins <= BROADCAST_ROWS else None)
    return full.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
                       (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                       F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distribution_summary(df: DataFrame, value: str, by: Sequence[str] = FLIGHT,
                         slice_rows: int = SLICE_ROWS) -> DataFrame:
    mid = percentiles(df, by, value, {"median": 0.5}, slice_rows)
    mean = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return attach(mean, mid, by)


def channel_flatness(df: DataFrame, channels: Sequence[str], threshold: float = 0.01,
                     by: Sequence[str] = ()) -> DataFrame:
    """Range and mean per channel, and whether it moved more than ``threshold``."""
    rows = long_form(df, channels, by, "channel", "v")
    return rows.groupBy(*by, "channel").agg(
        (F.max("v") - F.min("v")).alias("value_range"), F.avg("v").alias("mean")).withColumn(
        "status", F.when(F.col("value_range") > threshold, "dynamic").otherwise("flat"))


def pressure_summary(df: DataFrame, value: str = "pressure_mbar", t: str = "time_mission",
                     by: Sequence[str] = ("path",), floor_after: float = 60.0) -> DataFrame:
    """Range, span and sensor floor; the floor falls back to the minimum."""
    p, s = F.col(value), F.col(t)
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(p).alias("p_min"), F.max(p).alias("p_max"),
        F.min(s).cast("double").alias("t_first"), F.max(s).cast("double").alias("t_last"),
        F.coalesce(F.min(F.when(s > floor_after, p)), F.min(p)).alias("p_floor"))


def pressure_levels(df: DataFrame, value: str = "pressure_mbar", t: str = "time_mission",
                    by: Sequence[str] = ("path",), first: float = -10.0, last: float = 70.0,
                    levels: Sequence[tuple[float, str]] = params.PRESSURE_LEVELS) -> DataFrame:
    """Altitude levels that the pressure passed during the ascent window."""
    s = F.col(t)
    rows = attach(df, df.groupBy(*by).agg(F.min(s).alias("_a"), F.max(s).alias("_b")), by,
                  groups=profile(df, by).groups)
    ascent = rows.where((s >= F.greatest(F.col("_a"), F.lit(first)))
                        & (s <= F.least(F.col("_b"), F.lit(last))))
    ends = ascent.groupBy(*by).agg(F.min(value).alias("p_low"), F.max(value).alias("p_high"))
    table = F.array(*[F.struct(F.lit(p).alias("mbar"), F.lit(a).alias("altitude")) for p, a in levels])
    each = ends.withColumn("_l", F.explode(table)).select(*by, "p_low", "p_high", "_l.*")
    return each.where(F.col("mbar").between(F.col("p_low"), F.col("p_high")))


def temperature_summary(df: DataFrame, channels: Sequence[str] = ("tc0_C", "tc1_C"),
                        by: Sequence[str] = ("path",), plausible: bool = True) -> DataFrame:
    rows = plausible_temperature(df, channels) if plausible else df
    rows = long_form(rows, channels, by, "channel", "v")
    return rows.groupBy(*by, "channel").agg(
        F.count("v").alias("n"), F.min("v").alias("t_min"), F.max("v").alias("t_max"),
        (F.max("v") - F.min("v")).alias("delta"))


def skipped_event_counts(df: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent routine messages; equal counts go by name."""
    return (df.where(F.col("skip_key").isNotNull()).groupBy("skip_key")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "skip_key").limit(top))


def anomaly_rate_by_segment(df: DataFrame, flag: str = "is_anomaly", by: Sequence[str] = FLIGHT,
                            t: str = "mission_time_s") -> DataFrame:
    """Rows, anomalies and rate in the early, cruise and late part of each
    flight, with the ratio of the dynamic rate to the cruise rate."""
    ends = df.groupBy(*by).agg(F.min(t).alias("_a"), (F.max(t) - F.min(t)).alias("_w"))
    rows = attach(df.select(*by, t, flag), ends, by, groups=profile(df, by).groups)
    a, w = F.col("_a"), F.col("_w")
    part = (F.when(F.col(t) <= a + w * 0.15, "early")
            .when((F.col(t) >= a + w * 0.25) & (F.col(t) <= a + w * 0.75), "cruise")
            .when(F.col(t) >= a + w * 0.85, "late"))
    per = rows.withColumn("part", part).where("part IS NOT NULL").groupBy(*by, "part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("n_anomalies"))
    rate = lambda c: F.sum(F.when(c, F.col("n_anomalies"))) / F.sum(F.when(c, F.col("n")))
    dyn = per.groupBy(*by).agg(rate(F.col("part") != "cruise").alias("_d"),
                               rate(F.col("part") == "cruise").alias("_c"))
    return attach(per, dyn, by).select(
        *by, "part", "n", "n_anomalies",
        (F.lit(100.0) * F.col("n_anomalies") / F.col("n")).alias("rate_pct"),
        F.when(F.col("_c") > 0, F.col("_d") / F.col("_c")).alias("dynamic_ratio"))


def method_overlap(df: DataFrame, flags: Sequence[str], votes: str = "votes",
                   ensemble: str = "is_anomaly") -> DataFrame:
    """Joint counts of each pair of methods, and the fewest votes of any row
    the ensemble flagged."""
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i:]]
    wide = df.agg(
        F.min(F.when(F.col(ensemble), F.col(votes))).alias("min_votes"),
        *[F.count_if(F.coalesce(F.col(a), F.lit(False)) & F.coalesce(F.col(b), F.lit(False)))
          .alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = ", ".join(f"'{a}', '{b}', _{i}" for i, (a, b) in enumerate(pairs))
    return wide.select(F.expr(f"stack({len(pairs)}, {rows}) as (method_a, method_b, n_both)"), "min_votes")


def interval_coverage(df: DataFrame, target: str, prediction: str, sigma: str, width: float = 2.0,
                      by: Sequence[str] = FLIGHT) -> DataFrame:
    """Share of rows closer to the prediction than ``width`` sigmas."""
    hit = F.abs(F.col(target) - F.col(prediction)) < F.col(sigma) * width
    return df.groupBy(*by).agg((F.avg(hit.cast("double")) * 100).alias("coverage_pct"))


def residual_diagnostics(df: DataFrame, target: str, prediction: str, by: Sequence[str] = FLIGHT,
                         order: Sequence[str] = ORDER, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Bias, spread, tail, spread by tercile of the target, lag-1
    autocorrelation and correlation of error size with the target."""
    rows = df.select(*by, *order, F.col(target).alias("_y"),
                     (F.col(target) - F.col(prediction)).alias("_e"))
    s = Series.of(rows, by, order, slice_rows=slice_rows)
    lagged = materialize(s.mutate(lambda d, w: d.withColumn("_e1", F.lag("_e").over(w)), before=1).df)
    size = profile(rows, by)
    lagged = lagged.withColumn("_abs", F.abs("_e"))
    cuts = percentiles(lagged, by, "_y", {"_y33": 0.33, "_y67": 0.67}, slice_rows, largest=size.largest)
    tails = percentiles(lagged, by, "_abs", {"p99_abs": 0.99, "p999_abs": 0.999}, slice_rows,
                        largest=size.largest)
    mean = lagged.groupBy(*by).agg(F.avg("_e").alias("_mean"))
    d = attach(attach(lagged, cuts, by, groups=size.groups), mean, by, groups=size.groups)
    third = (F.when(F.col("_y") < F.col("_y33"), 0).when(F.col("_y") < F.col("_y67"), 1).otherwise(2))
    std = lambda k: F.stddev_pop(F.when(third == k, F.col("_e")))
    centred = F.col("_e") - F.col("_mean")
    out = d.groupBy(*by).agg(
        F.count("_e").alias("n"), F.avg("_e").alias("mean"), F.stddev_pop("_e").alias("std"),
        (F.lit(100.0) * F.stddev_pop("_e") / F.avg("_y")).alias("std_pct_of_signal"),
        F.max("_abs").alias("max_abs"),
        std(0).alias("std_low"), std(1).alias("std_mid"), std(2).alias("std_high"),
        (F.sum(centred * (F.col("_e1") - F.col("_mean"))) / F.sum(centred * centred)).alias("lag1_autocorr"),
        F.corr("_abs", "_y").alias("corr_abs_error"))
    ratio = (F.greatest("std_low", "std_mid", "std_high")
             / F.greatest(F.least("std_low", "std_mid", "std_high"), F.lit(0.01)))
    return attach(out.withColumn("std_ratio", ratio), tails, by, groups=size.groups)


def average_ranks(df: DataFrame, column: str, out: str, by: Sequence[str] = FLIGHT,
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Ranks with ties averaged.  Equal values are counted first, then the
    counts are summed along the distinct values, slice by slice."""
    counts = materialize(df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c")))
    s = Series.of(counts, by, [column], slice_rows=slice_rows).running_sum({"_u": F.col("_c")})
    ranks = s.df.select(*by, column, (F.col("_u") - (F.col("_c") - 1) / 2).alias(out))
    return attach(df, ranks, [*by, column])


def rank_correlation(df: DataFrame, a: str, b: str, by: Sequence[str] = FLIGHT,
                     slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Agreement of two predictions: Spearman, Pearson, mean and 95th
    percentile of the absolute difference."""
    rows = df.select(*by, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = materialize(average_ranks(rows, a, "_ra", by, slice_rows))
    ranked = average_ranks(ranked, b, "_rb", by, slice_rows)
    ranked = materialize(ranked.withColumn("_d", F.abs(F.col(a) - F.col(b))))
    p95 = percentiles(ranked, by, "_d", {"p95_diff": 0.95}, slice_rows)
    out = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("spearman"),
        F.corr(a, b).alias("pearson"), F.avg("_d").alias("mean_diff"))
    return attach(out, p95, by)


def poisson_weight(u: Column, top: int = 18) -> Column:
    """Poisson(1) draw from a uniform number by its distribution function.

    Draws above ``top`` have a chance below 2**-52, the grain of the number."""
    out, term, total = F.lit(top), 1.0, 0.0
    edges = []
    for k in range(top):
        total += term
        edges.append((k, total / 2.718281828459045))
        term /= k + 1
    for k, edge in reversed(edges):
        out = F.when(u < edge, F.lit(k)).otherwise(out)
    return out


def bootstrap_ci(df: DataFrame, target: str, prediction: str, key: Sequence[str],
                 resamples: int = 200, seed: int = 42) -> DataFrame:
    """Percentile intervals of R2 and MAE over Poisson resamples.

    The weight of a row in a resample is a hash of its key, so the answer does
    not depend on the partitioning.  Rows are expanded inside the map task and
    combined there: what is shuffled is one partial sum per resample and task.
    """
    rows = df.where(F.col(target).isNotNull() & F.col(prediction).isNotNull()).select(
        F.col(target).alias("_y"), (F.col(target) - F.col(prediction)).alias("_e"),
        F.xxhash64(*key).alias("_k"))
    # Centring keeps the one-pass total variance stable.
    mean = rows.agg(F.avg("_y").alias("_m"))
    each = rows.crossJoin(F.broadcast(mean)).withColumn("_y", F.col("_y") - F.col("_m")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = F.pmod(F.xxhash64("_k", "b", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    w = each.withColumn("_w", poisson_weight(u).cast("double")).where("_w > 0")
    y, e = F.col("_y"), F.col("_e")
    per = w.groupBy("b").agg(
        F.sum("_w").alias("n"), F.sum(F.col("_w") * y).alias("sy"), F.sum(F.col("_w") * y * y).alias("syy"),
        F.sum(F.col("_w") * e * e).alias("see"), F.sum(F.col("_w") * F.abs(e)).alias("sae"))
    per = per.select((1 - F.col("see") / (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))).alias("r2"),
                     (F.col("sae") / F.col("n")).alias("mae"))
    rows = long_form(per, ["r2", "mae"])
    return rows.groupBy("metric").agg(
        F.count("value").alias("resamples"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.percentile("value", F.lit(0.025)).alias("ci_low"),
        F.percentile("value", F.lit(0.975)).alias("ci_high"))


def physics_violations(df: DataFrame, prediction: str, axes: Sequence[str] = AXES,
                       tolerance: float = 1.0, slack: float = 50.0) -> DataFrame:
    """Predictions that no vector with these components can have."""
    size = [F.abs(F.col(a)) for a in axes]
    p = F.col(prediction)
    total = size[0]
    for s in size[1:]:
        total = total + s
    largest = F.greatest(*size)
    return df.agg(
        F.count(p).alias("n"), F.count_if(p > total + tolerance).alias("above_sum"),
        F.count_if(p < largest - tolerance).alias("below_largest"),
        F.count_if(p < largest - slack).alias("far_below_largest"),
        F.count_if(p <= 0).alias("not_positive"))


def integrity_report(df: DataFrame, axes: Sequence[str] = AXES, value: str = "magnitude",
                     low: float = 100.0, high: float = 100_000.0, tolerance: float = 0.1) -> DataFrame:
    """One row per check: name, outcome, measured value."""
    cols = [F.col(c) for c in (*axes, value)]
    x, y, z = (F.col(a) for a in axes)

    def count_any(test) -> Column:
        hit = test(cols[0])
        for c in cols[1:]:
            hit = hit | test(c)
        return F.count_if(hit).cast("double")

    infinite = lambda c: F.coalesce(F.abs(c) == F.lit(params.INF), F.lit(False))
    off = F.abs(F.col(value) - F.sqrt(x * x + y * y + z * z)) > tolerance
    one = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"), count_any(lambda c: c.isNull()).alias("nulls"),
        count_any(lambda c: F.coalesce(F.isnan(c), F.lit(False))).alias("nans"),
        count_any(infinite).alias("infinities"), F.count_if(off).cast("double").alias("not_norm"),
        F.min(value).alias("lowest"), F.max(value).alias("highest"),
        F.countDistinct("sensor_id").cast("double").alias("sensors"))
    checks = {
        "rows": "rows > 0", "nulls": "nulls = 0", "nans": "nans = 0", "infinities": "infinities = 0",
        "not_norm": "not_norm = 0", "lowest": f"lowest > {low}D", "highest": f"highest < {high}D",
        "sensors": "sensors >= 1"}
    stacked = ", ".join(f"'{n}', {test}, {n}" for n, test in checks.items())
    return one.select(F.expr(f"stack({len(checks)}, {stacked}) as (check_name, passed, value)"))


def error_separation(df: DataFrame, error: str = "abs_error", by: Sequence[str] = FLIGHT,
                     slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Mean of the largest 10 % and of the smallest 50 % of the errors."""
    groups, largest = profile(df, by)
    n = df.groupBy(*by).agg(F.count(error).alias("_n"))
    # Equal errors are interchangeable, so counts per value decide the split.
    counts = materialize(df.where(F.col(error).isNotNull()).groupBy(*by, error).agg(F.count(F.lit(1)).alias("_c")))
    s = Series.of(counts, by, [error], slice_rows=slice_rows).running_sum({"_u": F.col("_c")})
    rows = attach(s.df, n, by, groups=groups)
    before = F.col("_u") - F.col("_c")
    top_from, low_to = F.floor(F.col("_n") * F.lit(0.9)), F.floor(F.col("_n") * F.lit(0.5))
    in_top = F.greatest(F.lit(0), F.col("_u") - F.greatest(before, top_from))
    in_low = F.greatest(F.lit(0), F.least(F.col("_u"), low_to) - before)
    mean = lambda k: F.sum(k * F.col(error)) / F.sum(k)
    return rows.groupBy(*by).agg(
        F.first("_n").alias("n"), mean(in_top).alias("top_mean"), mean(in_low).alias("low_mean")).withColumn(
        "separated", F.col("top_mean") > 3 * F.col("low_mean"))


def throughput_report(df: DataFrame, seconds: int = 5, ts: str = "event_ts", flag: str | None = "is_anomaly",
                      rate_hz: float = params.SAMPLE_RATE_HZ, by: Sequence[str] = FLIGHT) -> DataFrame:
    """Readings, rate, missing readings and anomalies per status interval."""
    n = F.count(F.lit(1))
    anomalies = F.count_if(F.col(flag)) if flag else F.lit(0).cast("long")
    # Streams keep the sensors of a window as a set, batches count them in two steps.
    sensors = (F.size(F.collect_set("sensor_id")).cast("long") if df.isStreaming else F.count_distinct("sensor_id"))
    per = df.groupBy(*by, F.window(ts, f"{seconds} seconds").alias("_w")).agg(
        n.alias("n"), (n / F.lit(float(seconds))).alias("hz"), anomalies.alias("n_anomalies"),
        sensors.alias("n_sensors"))
    expected = F.col("n_sensors") * F.lit(rate_hz * seconds)
    return per.select(*by, F.unix_micros("_w.start").alias("start_us"), "n", "hz", "n_sensors",
                      F.greatest(F.lit(0.0), expected - F.col("n")).alias("n_missing"), "n_anomalies")


def consensus(df: DataFrame, predictions: Sequence[str], out: str = "consensus") -> DataFrame:
    """Mean of the predictions a row has; NULL when it has none."""
    total = n = None
    for c in predictions:
        v, k = F.coalesce(F.col(c), F.lit(0.0)), F.col(c).isNotNull().cast("int")
        total, n = (v, k) if total is None else (total + v, n + k)
    return df.withColumn(out, F.when(n > 0, total / n))


def report_rows(section: str, df: DataFrame, metrics: Sequence[str], key: Column) -> DataFrame:
    """Rows of one report section: section, metric, key, value."""
    rows = long_form(df.withColumn("_key", key.cast("string")), metrics, ["_key"])
    return rows.select(F.lit(section).alias("section"), "metric", F.col("_key").alias("key"), "value")


def flight_report(df: DataFrame, flags: Sequence[str] = (), target: str = "magnitude",
                  predictions: Mapping[str, str] | None = None,
                  extra: Sequence[DataFrame] = ()) -> DataFrame:
    """One long table: sensors, flag rates, prediction quality, and whatever
    report rows the caller adds (pressure, temperature, channels)."""
    needed = ["flight_id", "sensor_id", "mission_time_s", *{"magnitude", target}, *flags, *(predictions or {}).values()]
    df = materialize(df.select(*needed))  # each section reads it
    summary = sensor_summary(df)
    parts = [report_rows("sensor", summary, ["n", "n_in_flight", "mag_min", "mag_max", "mag_mean",
                                             "t_first", "t_last"], F.col("sensor_id"))]
    if flags:
        parts.append(report_rows("flag", flag_rates(df, flags), ["n_flagged", "pct"], F.col("flag")))
    for name, column in (predictions or {}).items():
        parts.append(report_rows("model", regression_metrics(df, target, column), ["n", "r2", "rmse"],
                                 F.lit(name)))
    parts.extend(extra)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
