"""Votes and the composed detectors (survey 2.7)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluria import params
from telluria.operators.forest import fit_isolation_forest, flag_lowest, score_isolation_forest
from telluria.operators.neighbors import outlier_factors
from telluria.operators.projections import after_last_gap
from telluria.operators.series import RN, SIZE, Series
from telluria.operators.windows import (adaptive_roc_flag, classic_z, detrended, detrended_score, history_rule, roc,
                                        trailing_z)
from telluria.schema import AXES, KEYS, ORDER
from telluria.session import SLICE_ROWS, attach, materialize, profile, stored


def ensemble_vote(df: DataFrame, flags: Sequence[str], min_votes: int = params.MIN_VOTES,
                  votes: str = "votes", out: str = "is_anomaly") -> DataFrame:
    total = F.lit(0)
    for f in flags:
        total = total + F.coalesce(F.col(f).cast("int"), F.lit(0))
    return df.withColumn(votes, total).withColumn(out, F.col(votes) >= min_votes)


def detect_flight(df: DataFrame, by: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
                  rows: int = params.HISTORY_ROWS, min_rows: int = params.HISTORY_MIN,
                  z_threshold: float = params.Z_THRESHOLD,
                  roc_threshold: float = params.ROC_THRESHOLD,
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The flags of a flight log: trailing z-score and rate of change, both
    needed for an anomaly.  Batch twin of the streaming detector."""
    s = Series.of(df, by, order, numbered=True, slice_rows=slice_rows)
    s = trailing_z(roc(s), rows, min_rows, z_threshold, "magnitude", "z", "is_z")
    return ensemble_vote(s.df.withColumn("is_roc", F.col("roc") > roc_threshold),
                         ["is_z", "is_roc"])


def top_anomalies(df: DataFrame, n: int = 10, order: Sequence[str] = ORDER) -> DataFrame:
    """Rows with the most votes; equal votes go by time."""
    return df.where("is_anomaly").orderBy(F.desc("votes"), *order).limit(n)


def detect_anomalies(df: DataFrame, by: Sequence[str] = KEYS, key: str = "reading_number",
                     order: Sequence[str] = ORDER, z_threshold: float = params.Z_THRESHOLD,
                     contamination: float = params.FOREST_CONTAMINATION, neighbors: int = params.LOF_NEIGHBORS,
                     lof_contamination: float = params.LOF_CONTAMINATION, min_votes: int = params.MIN_VOTES,
                     trees: int = 100, min_rows: int = 10, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Isolation forest, detrended z-score, local outlier factor and adaptive
    rate of change on one frame, and their vote.  Groups below ``min_rows`` rows
    keep their scores but get NULL flags and no vote.  The rows are numbered and
    their groups measured once.  They are stored with trend and step, and once more
    with the scores of forest and neighbours; all flags are found on that."""
    s = detrended(Series.of(df, by, order, numbered=True, slice_rows=slice_rows, cut=stored))
    known = s.profile
    rows = stored(roc(s).rows.withColumn("_enough", F.col(SIZE) >= min_rows).drop(RN, SIZE))
    forest = materialize(fit_isolation_forest(rows, [key], by=by, trees=trees, known=known))
    factors = outlier_factors(rows, key, neighbors, by=by, slice_rows=slice_rows, known=known)
    scored = score_isolation_forest(rows, forest, [key], by=by)
    rows = stored(attach(scored, factors, [*by, *AXES]).withColumn("_neg", -F.col("lof")))
    rows = flag_lowest(rows, "iso_score", contamination, "is_iso", by, slice_rows, known)
    rows = flag_lowest(rows, "_neg", lof_contamination, "is_lof", by, slice_rows, known).drop("_neg")
    rows = detrended_score(rows, z_threshold, by, slice_rows, known)
    rows = adaptive_roc_flag(rows, "magnitude", by, slice_rows, known)
    flags = ["is_iso", "is_z_detrended", "is_lof", "is_roc_adaptive"]
    rows = ensemble_vote(rows, flags, min_votes)
    return rows.withColumns({c: F.when(F.col("_enough"), F.col(c)) for c in (*flags, "votes", "is_anomaly")}
                            ).drop("_enough")


def detect_per_sensor(df: DataFrame, detector: Callable[..., DataFrame] = detect_anomalies,
                      gap: float = 5.0, pad: float = 5.0, z_share: float = 0.15, **options) -> DataFrame:
    """The detector on every sensor after the last gap of its flight, as one
    job.  ``show_z`` is false where the z-score flags too much to be useful."""
    rows = detector(after_last_gap(df, gap, pad), by=KEYS, **options)
    shares = rows.groupBy(*KEYS).agg(
        (F.count_if(F.coalesce(F.col("is_z_detrended"), F.lit(False))) <= F.lit(z_share) * F.count(F.lit(1))).alias("show_z"))
    return attach(rows, shares, KEYS)


def online_check(df: DataFrame, forest: DataFrame, by: Sequence[str] = KEYS, key: str = "reading_number",
                 order: Sequence[str] = ORDER, rows: int = params.HISTORY_ROWS, min_rows: int = params.HISTORY_MIN,
                 z_threshold: float = 3.0, iso_limit: float = -0.5, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The live rules against a trailing history: classic z, a frozen forest and
    mean distance; two of three make an anomaly, none before ``min_rows`` rows."""
    s = classic_z(Series.of(df, by, order, numbered=True, slice_rows=slice_rows), z_threshold, rows, min_rows, "magnitude")
    s = history_rule(s, rows, min_rows)
    scored = score_isolation_forest(s.df, forest, [key], by=by)
    known = F.col("history_mean").isNotNull()
    scored = scored.withColumn("iso_score", F.when(known, F.col("iso_score"))).withColumn(
        "is_iso_online", F.coalesce(F.col("iso_score") < iso_limit, F.lit(False)))
    return ensemble_vote(scored, ["is_z_classic", "is_iso_online", "is_far"])


def prediction_error_anomalies(df: DataFrame, target: str = "target", prediction: str = "forecast",
                               test: str = "is_train", multiplier: float = 3.0,
                               by: Sequence[str] = ("flight_id",)) -> DataFrame:
    """Rows whose error exceeds a multiple of the mean error on the test rows."""
    error = F.abs(F.col(target) - F.col(prediction))
    mae = df.where(~F.col(test)).groupBy(*by).agg(F.avg(error).alias("_mae"))
    rows = attach(df, mae, by, groups=profile(df, by).groups)
    return (rows.withColumn("abs_error", error).withColumn("error_threshold", F.col("_mae") * multiplier)
            .withColumn("is_error_anomaly", F.col("abs_error") > F.col("error_threshold")).drop("_mae"))
