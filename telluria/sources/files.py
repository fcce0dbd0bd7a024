"""Choosing input files by their listing, without opening them (S12, S13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File name classes, preferred first.
PREFERRED = ("flight_data_*.csv", "sim_data_*.csv", "*.csv", "*.txt", "*.dat")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length, modified; the content column is never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length",
                    F.col("modificationTime").alias("modified")))


def _like(pattern: str) -> str:
    return pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%")


def select_inputs(files: DataFrame, min_bytes: int = 300, prefer: Sequence[str] = PREFERRED) -> DataFrame:
    """Files of the best class present, newest first (``choice`` from 1)."""
    rank = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(prefer))):
        rank = F.when(F.col("name").like(_like(pattern)), F.lit(i)).otherwise(rank)
    usable = files.where(F.col("length") > min_bytes).withColumn("class", rank).where("class IS NOT NULL")
    best = usable.agg(F.min("class").alias("_best"))
    chosen = usable.crossJoin(F.broadcast(best)).where(F.col("class") == F.col("_best")).drop("_best")
    newest = Window.partitionBy("class").orderBy(F.desc("modified"), "path")
    return chosen.withColumn("choice", F.row_number().over(newest))


def pair_companions(files: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Result captures with the raw capture of the same folder, prefix and
    stamp; else the newest one of their folder above ``min_bytes`` bytes, files
    named as the latest before others.  One row per result; NULL if its folder
    has no raw capture."""
    # The three file name formats.
    result, raw = r"^(.+?)_data_(\d{8}_\d{6})\.csv$", r"^(.+?)_raw_sensors_(\d{8}_\d{6})\.csv$"
    any_raw, latest = r"_raw_sensors_.*\.csv$", r"_raw_sensors_latest\.csv$"
    placed = files.withColumn("folder", F.regexp_replace("path", r"[^/]*$", ""))
    key = lambda p: [F.regexp_extract("name", p, 1).alias("prefix"), F.regexp_extract("name", p, 2).alias("stamp")]
    left = placed.where(F.col("name").rlike(result)).select(F.col("path").alias("result_path"), "folder", *key(result))
    right = placed.where(F.col("name").rlike(raw)).select(F.col("path").alias("raw_path"), "folder", *key(raw))
    newest = placed.where(F.col("name").rlike(any_raw) & (F.col("length") > min_bytes)).groupBy("folder").agg(
        F.max_by("path", F.struct(F.col("name").rlike(latest), "modified", "path")).alias("_newest"))
    return left.join(right, ["folder", "prefix", "stamp"], "left").join(newest, "folder", "left").select(
        "result_path", F.coalesce("raw_path", "_newest").alias("raw_path"),
        F.col("raw_path").isNotNull().alias("same_stamp"))
