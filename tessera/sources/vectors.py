"""The stored vector index: a Parquet table that is replaced as a whole, its count and what to do with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import read_pointed, write_pointed


def write_index(docs: DataFrame, path: str, version: str = "v1") -> None:
    """Write ``docs`` (``doc_key, vector`` and a payload of other columns, one row a key) as the index at ``path``. Readers
    see the old one until the new one is whole; nothing of an interrupted build is ever read."""
    write_pointed(docs.where(F.col("doc_key").isNotNull()), path, version)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    return read_pointed(spark, path)


def index_count(spark: SparkSession, path: str) -> int:
    """Points of the index; 0 where there is none."""
    stored = read_index(spark, path)
    return 0 if stored is None else stored.count()


def index_action(spark: SparkSession, chunks: DataFrame, path: str, forced: bool = False) -> tuple[int, int, str]:
    """Numbers of chunks and of points, and what is to be done: ``skip`` an index as large as its chunks, ``build`` one that
    is missing or empty, ``refuse`` to touch one of another size, as it may hold what the chunks no longer do, or
    ``nothing`` without chunks. ``forced`` builds it anew from whatever chunks there are."""
    n, points = chunks.count(), index_count(spark, path)
    if forced:
        return n, points, "build" if n else "nothing"
    if n and n == points:
        return n, points, "skip"
    if points:
        return n, points, "refuse"
    return n, points, "build" if n else "nothing"
