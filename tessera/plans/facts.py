"""Facts of the evaluation questions against the texts of their gold chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.operators import facts
from tessera.operators.lookup import gathered_texts
from tessera.operators.metrics import rate
from tessera.sources.tables import table


def _with_gold(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    rows = table(spark, d, name).select("id", "gold_chunk_ids", *columns).distinct()
    texts = table(spark, d, "chunks").groupBy("chunk_id").agg(F.first("text").alias("text"))
    return rows.join(gathered_texts(rows, texts, "gold_chunk_ids"), "id", "left")


def fact_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_gold(spark, d, "application_questions", "category", "required_fact_groups")
    covered = rows.select("category", facts.group_coverage(F.col("text"), F.col("required_fact_groups")).alias("c"))
    return covered.groupBy("category").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("c"), 6).alias("coverage"))


def fact_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_gold(spark, d, "formal_questions", "category", "required_facts", "forbidden_facts")
    n = rows.select("category", F.size(F.coalesce("required_facts", F.array())).alias("n"), F.size(facts.facts_met(F.col("text"), F.col("required_facts"))).alias("met"), F.size(facts.facts_met(F.col("text"), F.col("forbidden_facts"))).alias("bad"))
    return n.groupBy("category").agg(F.sum("n").alias("facts"), F.sum("met").alias("met"), F.sum("bad").alias("forbidden"), F.round(rate(F.sum("met"), F.sum("n")), 6).alias("coverage"))


def fact_versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "verified_solutions").select("id", F.array_join(facts.requested_versions(F.concat_ws(" ", "version", "problem")), " ").alias("versions")).distinct()


def fact_near(spark: SparkSession, d: str) -> DataFrame:
    """How like each solved problem is to its solution, as facts are compared."""
    rows = table(spark, d, "verified_solutions").select("id", facts.normal_fact(F.col("problem")).alias("a"), facts.normal_fact(F.col("solution")).alias("b")).distinct()
    return rows.select("id", F.round(facts.fact_similarity(F.col("a"), F.col("b"), normal=True), 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (fact_groups, fact_exact, fact_versions, fact_near)}

_TIGHT = f"regexp_replace(lower({{}}), '{L.WS.replace('{', '{{').replace('}', '}}')}+', '', 'g')"
_GOLD = """
r AS (SELECT DISTINCT id, category, gold_chunk_ids AS g, {cols} FROM {t}), l AS (SELECT id, unnest(range(0, len(g))) AS place, unnest(g) AS chunk_id FROM r),
c AS (SELECT chunk_id, any_value(text) AS text FROM chunks GROUP BY 1), gold AS (SELECT id, string_agg(coalesce(text, ''), chr(10) ORDER BY place) AS text FROM l LEFT JOIN c USING (chunk_id) GROUP BY 1)"""
_MET = "len(list_filter(coalesce({c}, CAST([] AS VARCHAR[])), lambda f: f IS NOT NULL AND contains({a}, {f})))"
SQL = {
    "fact_groups": "WITH " + _GOLD.format(cols="required_fact_groups AS q", t="application_questions") + """
SELECT category, count(*) AS questions, round(avg(CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda x: len(list_filter(x, lambda v: contains(replace(lower(coalesce(text, '')), ' ', ''), replace(lower(v), ' ', '')))) > 0)) / len(q) ELSE 0 END), 6) AS coverage
FROM r LEFT JOIN gold USING (id) GROUP BY 1""",
    "fact_exact": "WITH " + _GOLD.format(cols="required_facts AS q, forbidden_facts AS b", t="formal_questions") + f"""
, n AS (SELECT category, len(coalesce(q, CAST([] AS VARCHAR[]))) AS n, {_MET.format(c='q', a=_TIGHT.format("coalesce(text, '')"), f=_TIGHT.format('f'))} AS met, {_MET.format(c='b', a=_TIGHT.format("coalesce(text, '')"), f=_TIGHT.format('f'))} AS bad FROM r LEFT JOIN gold USING (id))
SELECT category, CAST(sum(n) AS BIGINT) AS facts, CAST(sum(met) AS BIGINT) AS met, CAST(sum(bad) AS BIGINT) AS forbidden, round(sum(met) / nullif(sum(n), 0), 6) AS coverage FROM n GROUP BY 1""",
    "fact_versions": r"""
WITH v AS (SELECT DISTINCT id, concat_ws(' ', version, problem) AS t FROM verified_solutions)
SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(t, '(?i)(?:^|[^A-Za-z0-9])(V[0-9]+(?:\.[0-9]+)+)', 1), lambda x: upper(x)), list_transform(regexp_extract_all(t, '(?i)(?:固件|手册)(?:版本)?\s*([0-9]+(?:\.[0-9]+)+)', 1), lambda x: 'V' || x)))), ' ') AS versions FROM v""",
}
