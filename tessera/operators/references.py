"""References to records that do not exist.

A blocked Bloom filter of the parent keys is built as a table (one 64-bit word a row, merged with ``bit_or``
before and after the shuffle) and broadcast. Its size does not depend on the data beyond ``max_words``, so the
broadcast has a fixed bound; a fuller filter only passes more references on. What the filter rejects is an
orphan for certain and is reported as it is. Only what it passes is verified, by an exact join with the parents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import plain_unions

#: Words of 64 bits: 2**19 of them are 4 MB of bits, and about 32 MB as a broadcast table.
MAX_WORDS = 1 << 19
BITS_A_KEY = 16
#: White space as Unicode has it; ids and session names are trimmed of it.
_EDGE = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    """``c`` without white space of any kind at its ends."""
    return F.regexp_replace(c, _EDGE, "")


def id_list(c: Column) -> Column:
    """The ids in a text that one of several writers made: a JSON list, such a list quoted once more, a list
    with single quotes, or bare ids between commas or semicolons. Null and blank texts give an empty list, as do
    ``null`` and ``[]``. The ids themselves hold no quotes, brackets, backslashes, commas or semicolons."""
    plain = F.regexp_replace(c, r"""\\[nrt]|["'\[\]\\]""", " ")
    return F.coalesce(F.split(plain, "[,;]"), F.array().cast("array<string>"))


def cleaned_ids(ids: Column) -> Column:
    """Trimmed, distinct ids without nulls, blanks and the text ``null``."""
    kept = F.filter(F.transform(ids, trimmed), lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "null"))
    return F.array_distinct(F.coalesce(kept, F.array().cast("array<string>")))


def references(df: DataFrame, name: str, key: str, ids: Column, at: str) -> DataFrame:
    """One row per reference: ``ref_table, ref_id, chunk_id, at``. Rows with a null key are dropped: there is
    no record to report. A repeated row gives repeated references."""
    return df.where(F.col(key).isNotNull()).select(
        F.lit(name).alias("ref_table"), F.col(key).cast("string").alias("ref_id"), F.explode(cleaned_ids(ids)).alias("chunk_id"), F.col(at).cast("timestamp_ntz").alias("at")
    )


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: Column) -> Column:
    """Four of 64 bits, from another hash than the word's."""
    h = F.xxhash64(key, F.lit("bits"))
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)])


def bloom_table(parents: DataFrame, key: str, words: int) -> DataFrame:
    """``word, bits``: the filter of ``parents[key]``, at most ``words`` rows."""
    return parents.where(F.col(key).isNotNull()).groupBy(_word(F.col(key), words).alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def bloom_maybe(df: DataFrame, column: str, parents: DataFrame, key: str, count: int, max_words: int = MAX_WORDS) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the ``count`` values of ``parents[key]``; no other column is
    added. All rows that are among them stay, and some others."""
    words = filter_words(count, max_words)
    mask = _mask(F.col(column))
    bloom = bloom_table(parents, key, words).withColumnsRenamed({"word": "_bloom_word", "bits": "_bloom_bits"})
    joined = df.join(F.broadcast(bloom), _word(F.col(column), words) == F.col("_bloom_word"))
    return joined.where(F.col("_bloom_bits").bitwiseAND(mask) == mask).drop("_bloom_word", "_bloom_bits")


def filter_words(count: int, max_words: int = MAX_WORDS) -> int:
    """Words for a filter of ``count`` keys, a power of two of at most ``max_words``."""
    words = 1 << 10
    while words < max_words and words * 64 < count * BITS_A_KEY:
        words *= 2
    return words


def orphan_references(refs: DataFrame, parents: DataFrame, *, parent_key: str = "chunk_id", since: str = "ingested_at", max_words: int = MAX_WORDS) -> DataFrame:
    """References of ``refs`` (``ref_table, ref_id, chunk_id, at``) that no parent answers.

    Result: ``ref_table, ref_id, chunk_id, at, reason``, one row for each ``(ref_table, ref_id, chunk_id)``.
    ``reason`` is ``missing`` (no such parent) or ``later`` (every parent row of that key is later than ``at``);
    a null ``at`` or a parent without any time is not tested for that. Of repeated references with several times
    the latest counts. An empty parent table makes every reference an orphan; an empty ``refs`` gives no rows.
    """
    plain_unions(refs.sparkSession)
    words = filter_words(parents.select(parent_key).count(), max_words)
    bloom = bloom_table(parents, parent_key, words)
    mask = _mask(F.col("chunk_id"))
    tested = refs.withColumn("word", _word(F.col("chunk_id"), words)).join(F.broadcast(bloom), "word", "left").withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))).drop("word", "bits")
    # both uses of this share one scan and shuffle: ``maybe``, which depends on the id only, is an aggregate, so that no filter
    # goes before the shuffle, and the first use has a condition on ``at`` that always holds, so that neither drops a column
    once = tested.groupBy("ref_table", "ref_id", "chunk_id").agg(F.max("at").alias("at"), F.bool_or("maybe").alias("maybe"))
    absent = once.where(~F.col("maybe") & F.coalesce(F.year("at") > -1_000_000, F.lit(True))).select("ref_table", "ref_id", "chunk_id", "at", F.lit("missing").alias("reason"))
    first = parents.where(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias("chunk_id")).agg(F.min(F.col(since).cast("timestamp_ntz")).alias("first_seen"), F.lit(True).alias("found"))
    checked = once.where("maybe").join(first, "chunk_id", "left")
    reason = F.when(F.col("found").isNull(), "missing").when(F.col("first_seen") > F.col("at"), "later")
    late = checked.select("ref_table", "ref_id", "chunk_id", "at", reason.alias("reason")).where(F.col("reason").isNotNull())
    return absent.unionByName(late)


def orphan_report(orphans: DataFrame, removed: DataFrame) -> DataFrame:
    """Orphans by ``ref_table, month, reason``: numbers of references, records and ids. ``missing`` becomes
    ``removed`` where ``removed`` (with ``chunk_id``) names the id. A null time gives a null month."""
    gone = removed.where(F.col("chunk_id").isNotNull()).select(trimmed(F.col("chunk_id")).alias("chunk_id")).distinct().withColumn("gone", F.lit(True))
    named = orphans.join(gone, "chunk_id", "left").withColumn("reason", F.when((F.col("reason") == "missing") & F.col("gone"), "removed").otherwise(F.col("reason")))
    month = F.date_format(F.col("at"), "yyyy-MM")
    return named.groupBy("ref_table", month.alias("month"), "reason").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("ref_id").alias("records"), F.count_distinct("chunk_id").alias("ids"))
