"""Audits and checks of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.metrics import nearest_rank


def sized_chunks(chunks: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, kind, chars, tokens``, repeats once; a chunk without a representation is narrative."""
    kind = F.coalesce(F.nullif(F.col("metadata.representation"), F.lit("")), F.lit("narrative"))
    text = F.coalesce("text", F.lit(""))
    return chunks.select("chunk_id", "doc_id", kind.alias("kind"), F.length(text).alias("chars"), F.size(T.chunk_tokens(text)).alias("tokens")).distinct()


def length_audit(sized: DataFrame) -> DataFrame:
    """Lengths by kind and over all: counts, nearest-rank percentiles, extremes, numbers of long ones."""
    stats = [F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.min("chars").alias("least"), F.max("chars").alias("most")]
    stats += nearest_rank("chars", 0.5, 0.9, 0.95, 0.99) + [F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY tokens)").alias("tokens_p90")]
    stats += [F.count_if(F.col("chars") > 2000).alias("over_2000_chars"), F.count_if(F.col("tokens") > 600).alias("over_600_tokens")]
    return sized.rollup("kind").agg(*stats)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` for each rule that a row breaks; a rule that is null for a row is not broken."""
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(broken).alias("rule")).distinct()


def blank(name: str) -> Column:
    return T.strip(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def question_rules() -> dict[str, Column]:
    """Rules for evaluation questions."""
    gold = F.coalesce("gold_chunk_ids", F.array().cast("array<string>"))
    filled = F.filter(gold, lambda x: T.strip(F.coalesce(x, F.lit(""))) != "")
    return {
        "blank question": blank("question"), "blank split": blank("split"), "answerable without gold": F.col("answerable") & (F.size(filled) == 0), "gold though unanswerable": ~F.col("answerable") & (F.size(filled) > 0),
        "blank gold entry": F.size(filled) < F.size(gold), "padded gold entry": F.exists(filled, lambda x: x != T.strip(x)), "repeated gold entry": F.size(F.array_distinct(F.transform(filled, T.strip))) < F.size(filled),
    }


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys of several rows with their numbers."""
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
