"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Keys with several rows that are sent to all workers at most; more are joined by a shuffle.
SENT_KEYS = 500_000


def table_once(spark: SparkSession, folder: str, name: str, key: str, *columns: str) -> DataFrame:
    """``key`` and ``columns`` of one row of each key of a table, the first by file and row; null keys are left out.

    Only keys and row numbers are shuffled: the repeated keys, with the row that stays, are joined to the scan. They
    are sent to all workers if their counted number is small, so wide columns never move for the sake of a few repeats."""
    rows = table(spark, folder, name).where(F.col(key).isNotNull())
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    repeated = rows.select(key, place.alias("_at")).groupBy(key).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_key"), "_low")
    small = repeated.count() <= SENT_KEYS
    joined = rows.select(key, *columns, place.alias("_at")).join(F.broadcast(repeated) if small else repeated, F.col(key) == F.col("_key"), "left")
    return joined.where(F.col("_low").isNull() | (F.col("_low") == F.col("_at"))).select(key, *columns)
