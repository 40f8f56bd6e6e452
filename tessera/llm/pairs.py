"""Pairs of records from pairs of classes of equal records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records of one side of a tile: larger sides are cut, so that no task writes all pairs of a large class.
TILE_KEYS = 1_000


def ordered_pair(a: str, b: str, names: tuple[str, str]) -> list:
    """The two key columns as ``names``, the smaller key, compared as a string, first."""
    return [F.least(F.col(a), F.col(b)).alias(names[0]), F.greatest(F.col(a), F.col(b)).alias(names[1])]


def tile_of(by: tuple[str, ...], mine: str, other: str, names: tuple[str, str]) -> list:
    """Columns that send a record to its own of ``mine`` tiles and to each of the other side's ``other`` tiles."""
    return [F.pmod(F.xxhash64(*by), F.col(mine)).alias(names[0]), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(names[1])]


def expand_pairs(links: DataFrame, members: DataFrame, names: tuple[str, str], full_pairs: int | None = None) -> DataFrame:
    """Pairs of keys from ``links`` (``a, b``: classes) and ``members`` (``cls, key``, distinct).

    Two classes of m and n records give all m * n pairs, however many; classes of more than ``TILE_KEYS`` records are cut
    into tiles that meet pairwise. A pair of a class with itself stands for its copies. Only if ``full_pairs`` is given,
    classes with more pairs than that are linked through their smallest keys, which leaves pairs out: each record of one
    side with the other side's smallest. Result: the two columns ``names``, distinct."""
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("rep"))
    sized = (
        links.select("a", "b").distinct()
        .join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("rep").alias("ra")), "a")
        .join(sizes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("rep").alias("rb")), "b")
    )
    one = members.select(F.col("cls").alias("a"), F.col("key").alias("ka"))
    two = members.select(F.col("cls").alias("b"), F.col("key").alias("kb"))
    full, star = sized, None
    if full_pairs is not None:
        within = F.col("na").cast("double") * F.col("nb") <= full_pairs
        full, star = sized.where(within), sized.where(~within)
    tiles = lambda n: F.ceil(F.col(n) / F.lit(TILE_KEYS)).cast("long")
    full = full.select("a", "b", tiles("na").alias("ta"), tiles("nb").alias("tb"))
    large = full.where("ta > 1 or tb > 1")
    left = large.join(one, "a").select("a", "b", "ka", *tile_of(("ka",), "ta", "tb", ("x", "y")))
    right = large.join(two, "b").select("a", "b", "kb", *tile_of(("kb",), "tb", "ta", ("y", "x")))
    every = full.where("ta = 1 and tb = 1").join(one, "a").join(two, "b").select("a", "b", "ka", "kb").unionByName(left.join(right, ["a", "b", "x", "y"]).select("a", "b", "ka", "kb"))
    # a class with itself has each pair both ways
    every = every.where("a != b or ka < kb").select("ka", "kb")
    if star is not None:
        every = every.unionByName(star.join(one, "a").select("ka", F.col("rb").alias("kb"))).unionByName(star.join(two, "b").select(F.col("ra").alias("ka"), "kb"))
    return every.where(F.col("ka") != F.col("kb")).select(*ordered_pair("ka", "kb", names)).distinct()
