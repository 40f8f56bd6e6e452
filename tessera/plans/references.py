"""Problem 6: orphan references of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.references import id_list, orphan_references, orphan_report, references
from tessera.sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    questions, turns, solutions = (table(spark, d, t) for t in ("application_questions", "conversation_turns", "verified_solutions"))
    refs = references(questions, "application_questions", "id", F.col("gold_chunk_ids"), "added_at")
    for df, name in ((turns, "conversation_turns"), (solutions, "verified_solutions")):
        refs = refs.unionByName(references(df, name, "id", id_list(F.col("source_chunk_ids")), "created_at"))
    return orphan_references(refs, table(spark, d, "chunks").select("chunk_id", "ingested_at"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", "chunk_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d), table(spark, d, "removed_chunks"))


#: The ids in ``source_chunk_ids``, whoever wrote them, trimmed and distinct, in order.
_PIECES = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(source_chunk_ids, '\\[nrt]|["''\[\]\\]', ' ', 'g'), '[,;]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND lower(x) <> 'null')"""
LISTED = f"list_filter({_PIECES}, lambda x, i: list_position({_PIECES}, x) = i)"

_REFS = r"""
WITH listed AS (
  SELECT 'application_questions' AS ref_table, id AS ref_id, unnest(gold_chunk_ids) AS raw, added_at AS seen_at FROM application_questions
  UNION ALL
  SELECT 'conversation_turns', CAST(id AS VARCHAR), unnest(regexp_split_to_array(regexp_replace(source_chunk_ids, '\\[nrt]|["''\[\]\\]', ' ', 'g'), '[,;]')), created_at FROM conversation_turns
  UNION ALL
  SELECT 'verified_solutions', CAST(id AS VARCHAR), unnest(regexp_split_to_array(regexp_replace(source_chunk_ids, '\\[nrt]|["''\[\]\\]', ' ', 'g'), '[,;]')), created_at FROM verified_solutions
), cleaned AS (
  SELECT ref_table, ref_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS chunk_id, seen_at FROM listed WHERE raw IS NOT NULL
), refs AS (
  SELECT ref_table, ref_id, chunk_id, max(seen_at) AS seen_at FROM cleaned WHERE chunk_id <> '' AND lower(chunk_id) <> 'null' GROUP BY ALL
), parents AS (
  SELECT chunk_id, min(ingested_at) AS first_seen FROM chunks GROUP BY 1
), orphans AS (
  SELECT r.*, CASE WHEN p.chunk_id IS NULL THEN 'missing' ELSE 'later' END AS reason
  FROM refs r LEFT JOIN parents p USING (chunk_id) WHERE p.chunk_id IS NULL OR p.first_seen > r.seen_at
)
"""

QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
SQL = {
    "p6_found": _REFS.replace("GROUP BY ALL", "GROUP BY ref_table, ref_id, chunk_id") + "SELECT ref_table, ref_id, chunk_id FROM orphans",
    "p6_report": _REFS.replace("GROUP BY ALL", "GROUP BY ref_table, ref_id, chunk_id")
    + """SELECT ref_table, strftime(seen_at, '%Y-%m') AS month, CASE WHEN reason = 'missing' AND chunk_id IN (SELECT trim(chunk_id) FROM removed_chunks) THEN 'removed' ELSE reason END AS reason,
  count(*) AS refs, count(DISTINCT ref_id) AS records, count(DISTINCT chunk_id) AS ids FROM orphans GROUP BY 1, 2, 3""",
}
