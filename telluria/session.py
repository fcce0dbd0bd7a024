"""Helpers around the running session: lineage cuts, scratch space, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Most rows that one task is asked to sort or one group may hold before an
# operator switches to its sliced form.
SLICE_ROWS = 1_000_000
# Most rows of a per-group table (a few doubles each) that may be broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``, or a temporary one
    when the session runs in a single process and names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which survives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder.  A checkpoint keeps the
    size that the optimizer guessed, and guesses for joins are products: where
    each of many steps joins what the step before left, they outgrow all bounds.
    A table has the size of its files, a quarter or less of a checkpoint's."""
    if any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) for f in df.schema.fields):
        return materialize(df)  # Parquet has no such columns
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Profile(NamedTuple):
    """How many groups there are and how many rows the largest one has."""

    groups: int
    largest: int


def profile(df: DataFrame, by: Sequence[str]) -> Profile:
    """Measure the groups of ``df``; a count with map-side combine, nothing else."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_c"))
    row = sizes.agg(F.count(F.lit(1)).alias("g"), F.max("_c").alias("m")).first()
    return Profile(int(row["g"]), int(row["m"] or 0))


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str],
           groups: int | None = None, how: str = "left") -> DataFrame:
    """Bring per-group values back to the rows of each group.

    The small side is broadcast only when the caller has measured it to hold at
    most ``BROADCAST_ROWS`` rows; otherwise Spark picks the join and adaptive
    execution splits skewed keys.
    """
    if not by:
        return df.crossJoin(F.broadcast(stats))  # one row of totals
    if groups is not None and groups <= BROADCAST_ROWS:
        stats = F.broadcast(stats)
    right = stats.withColumnsRenamed({k: f"_r_{k}" for k in by})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in by]
    return df.join(right, reduce(and_, same), how).drop(*[f"_r_{k}" for k in by])

