"""Ranking metrics and aggregates over hits and gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MEANS = ("strict_recall", "recall", "hit", "mrr", "ndcg", "top1")


def ranking_rows(hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """One row for each query of ``gold`` (``query_id, doc_key``, each gold document): ``gold, found, first_rank,
    strict_recall, recall, hit, mrr, ndcg, top1`` at ``k``; ``hits``: ``query_id, doc_key, rank``. A query without
    hits scores 0."""
    top = hits.where(F.col("rank") <= k).select("query_id", "doc_key", "rank")
    joined = gold.select("query_id", "doc_key").distinct().join(top, ["query_id", "doc_key"], "left")
    by = joined.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("gold"), F.count("rank").alias("found"), F.min("rank").alias("first_rank"), F.coalesce(F.sum(1.0 / F.log2(F.col("rank") + 1.0)), F.lit(0.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("gold").cast("int"))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return by.select(
        "query_id", "gold", "found", "first_rank", (F.col("found") == F.col("gold")).cast("int").alias("strict_recall"), (F.col("found") / F.col("gold")).alias("recall"), (F.col("found") > 0).cast("int").alias("hit"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"), F.round(F.col("dcg") / ideal, 9).alias("ndcg"), F.coalesce((F.col("first_rank") == 1).cast("int"), F.lit(0)).alias("top1"),
    )


def ranking_summary(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Means over queries, for each value of ``by`` and, with a null there, over all."""
    means = [F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in MEANS]]
    means += [F.count_if(F.col("strict_recall") < 1).alias("missing"), F.count_if((F.col("strict_recall") == 1) & (F.col("top1") == 0)).alias("late")]
    return rows.rollup(by).agg(*means) if by else rows.agg(*means)


def failure_reasons(rows: DataFrame, families: DataFrame) -> DataFrame:
    """``query_id, reason`` of queries that miss a gold document or rank it late. ``rows``: of ``ranking_rows`` with
    ``category``; ``families``: ``query_id, close`` (the first hit is of a gold document's family)."""
    broad = F.col("category") == "cross_section_procedure"
    miss = F.col("strict_recall") < 1
    reason = (
        F.when(miss & broad & (F.col("gold") > 1), "query_too_broad").when(miss, "retrieval_miss").when(broad | (F.col("gold") > 1), "query_too_broad")
        .when(F.coalesce("close", F.lit(False)), "chunk_text_too_similar").otherwise("ranking_late")
    )
    return rows.where(miss | (F.col("top1") == 0)).join(families, "query_id", "left").select("query_id", reason.alias("reason"))


def nearest_rank(column: str, *shares: float) -> list:
    """Nearest-rank percentiles, named p50 and so on."""
    return [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias(f"p{round(p * 100)}") for p in shares]


def rate(hits, total):
    """A ratio that is null where there is nothing to divide by."""
    return hits / F.nullif(total, F.lit(0))


def compared_rounds(rows: dict[str, DataFrame]) -> DataFrame:
    """Ranking means of several lists of the same queries (each of ``ranking_rows``), and how many queries each gains and
    loses in strict recall against the first: ``list, queries, strict_recall, mrr, ndcg, top1, gained, lost``."""
    base = next(iter(rows.values())).select("query_id", F.col("strict_recall").alias("_base"))
    out = None
    for name, df in rows.items():
        one = df.join(base, "query_id").agg(
            F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("strict_recall", "mrr", "ndcg", "top1")],
            F.count_if(F.col("strict_recall") > F.col("_base")).alias("gained"), F.count_if(F.col("strict_recall") < F.col("_base")).alias("lost"),
        ).withColumn("list", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
