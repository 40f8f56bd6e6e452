"""Problem 5: visually identical text with different characters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.pairs import TILE_KEYS, ordered_pair, tile_of
from tessera.llm.text import consistent_form
from tessera.session import checkpoint


def normalised(c: Column, fold: bool = False) -> Column:
    """The consistent form of a text column; each distinct value of a batch is worked out once."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s, use_na_sentinel=True)
        forms = [consistent_form(v, fold) for v in values]
        return pd.Series([forms[i] if i >= 0 else None for i in codes], dtype=object)

    return form(c)


def _form_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for b in batches:
        texts = b.column("text").to_pylist()
        done: dict[str, tuple[bytes, bytes] | None] = {}
        for t in set(texts):
            f = consistent_form(t)
            done[t] = (digest(f.encode()), digest(t.encode())) if f else None
        found = [done[t] for t in texts]
        keep = [i for i, x in enumerate(found) if x]
        out = b.select(["src_table", "key"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array([found[i][0] for i in keep], pa.binary()), pa.array([found[i][1] for i in keep], pa.binary())], ["src_table", "key", "form", "raw"])


def lookalike_pairs(rows: DataFrame, full_pairs: int | None = None) -> DataFrame:
    """Rows of one table whose raw texts differ while their consistent form is the same.

    ``rows``: ``src_table, key, text``; result: ``src_table, key_a, key_b``. Texts are compared by 128-bit hashes,
    so none is shuffled. Blank texts and null keys take no part; repeated rows count once. All pairs are written out,
    however many rows have a form; a large form is cut into tiles of ``TILE_KEYS`` rows that meet pairwise. Only if
    ``full_pairs`` is given, a form with more ordered pairs of rows gives a star, which leaves pairs out: each row with
    the smallest key among those of another raw text."""
    hashed = checkpoint(
        rows.where(F.col("key").isNotNull() & F.col("text").isNotNull()).select("src_table", "key", "text")
        .mapInArrow(_form_hashes, "src_table string, key string, form binary, raw binary")
    )
    by_raw = hashed.groupBy("src_table", "form", "raw").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n"))
    # per form: its rows, the raw text that most of them have, and the smallest key with the text it has
    by_form = by_raw.groupBy("src_table", "form").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("raws"), F.max(F.struct("n", "raw")).alias("most"), F.min(F.struct("low", "raw")).alias("one")).where("raws > 1")
    full = F.lit(True) if full_pairs is None else F.col("n").cast("double") * F.col("n") <= full_pairs
    tiles = lambda n: F.ceil(n / F.lit(TILE_KEYS)).cast("long")
    groups = by_form.select("src_table", "form", "one", full.alias("full"), F.col("most.raw").alias("main"), tiles(F.col("n")).alias("ta"), tiles(F.col("n") - F.col("most.n")).alias("tb"))
    # distinct() also merges repeated rows
    mixed = hashed.join(groups, ["src_table", "form"]).distinct()
    # all rows against those of another text than the main one, so masses of copies of one text aren't compared
    small = mixed.where("full")
    a = small.select("src_table", "form", F.col("key").alias("ka"), F.col("raw").alias("xa"), "main", *tile_of(("key", "raw"), "ta", "tb", ("x", "y")))
    b = small.where("raw != main").select("src_table", "form", F.col("key").alias("kb"), F.col("raw").alias("xb"), *tile_of(("key", "raw"), "tb", "ta", ("y", "x")))
    found = a.join(b, ["src_table", "form", "x", "y"]).where("xa != xb and (xa = main or ka < kb)").select("src_table", "ka", "kb")
    if full_pairs is not None:
        second = by_raw.join(by_form.select("src_table", "form", "one"), ["src_table", "form"]).where(F.col("raw") != F.col("one.raw")).groupBy("src_table", "form").agg(F.min("low").alias("other"))
        star = mixed.where("not full").join(second, ["src_table", "form"])
        found = found.unionByName(star.select("src_table", F.col("key").alias("ka"), F.when(F.col("raw") == F.col("one.raw"), F.col("other")).otherwise(F.col("one.low")).alias("kb")))
    return found.where("ka != kb").select("src_table", *ordered_pair("ka", "kb", ("key_a", "key_b"))).distinct()
