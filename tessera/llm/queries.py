"""Queries of the training-data problems over the dataset's tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.conversations import conversations
from tessera.llm.languages import document_languages, language_cases, language_segments
from tessera.llm.leakage import leaked_items
from tessera.llm.lookalikes import lookalike_pairs
from tessera.llm.neardup import near_duplicate_classes, near_duplicate_pairs
from tessera.llm.overlap import cross_split_counts, cross_split_pairs, split_name
from tessera.llm.packing import container_report, pack_documents
from tessera.llm.splitting import once, split_oversized
from tessera.llm.text import one_form
from tessera.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations(table(spark, d, "conversation_turns"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, d, "chunks").select(F.col("chunk_id").alias("key"), "text"), ("chunk_id_a", "chunk_id_b"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with the class of its words and the number of classes near it."""
    return near_duplicate_classes(table(spark, d, "chunks").select(F.col("chunk_id").alias("key"), "text")).withColumnRenamed("key", "chunk_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("src_table"), F.col("chunk_id").alias("key"), "text")
    questions = table(spark, d, "application_questions").select(F.lit("application_questions").alias("src_table"), F.col("id").alias("key"), F.col("question").alias("text"))
    return lookalike_pairs(chunks.unionByName(questions))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Development and evaluation questions of both tables."""
    rows = None
    for name, split in (("formal_questions", "test"), ("application_questions", "regression")):
        named = table(spark, d, name).select(F.lit(name).alias("src_table"), F.col("id").alias("key"), "question", split_name(F.col("split")).alias("split"))
        side = F.when(F.col("split") == "development", "train").when(F.col("split").isin("test", "regression"), "eval")
        named = named.withColumn("side", side).where("side is not null")
        rows = named if rows is None else rows.unionByName(named)
    return rows


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(_questions(spark, d).select("key", "question", "side"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of pairs and of evaluation questions in them, per evaluation split and table, and per table of the
    development question."""
    return cross_split_counts(_questions(spark, d))


def _oversized(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("src_table"), F.col("chunk_id").alias("item_id"), "text", "section_path")
    pages = table(spark, d, "document_pages").select(F.lit("document_pages").alias("src_table"), F.col("page_id").cast("string").alias("item_id"), "text", F.array().cast("array<string>").alias("section_path"))
    return split_oversized(chunks.unionByName(pages), with_text=with_text)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _oversized(spark, d, False).where("piece_no = 1 and item_id is not null").select("src_table", "item_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return once(_oversized(spark, d, True))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return container_report(pack_documents(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "test_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item in how many documents it is, and how much of it at most."""
    found = leaked_items(table(spark, d, "documents"), table(spark, d, "test_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max(F.col("stretch") / F.col("item_words")).alias("most"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return language_segments(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language_cases(_segments(spark, d))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_languages(_segments(spark, d))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p7_containers": p7_containers, "p7_report": p7_report, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_segments": p9_segments, "p9_documents": p9_documents}
_TOKEN = r"16#[0-9A-Fa-f]+|[\x{4e00}-\x{9fff}]|[A-Za-z]+(?:_[A-Za-z]+)*|\p{Nd}+(?:\.\p{Nd}+)?"
# Characters of the two lower planes whose form is another, from the rule.
_CHARS = [(chr(c), one_form(chr(c))) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and one_form(chr(c)) != chr(c)]
_MAP = "map(string_split('{}', chr(10)), string_split('{}', chr(10)))".format(*("\n".join(x[i] for x in _CHARS).replace("'", "''") for i in (0, 1)))
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _formed(source: str) -> str:
    """``formed``: the rows of ``source`` that have a text, with its consistent form and its words. Each distinct character is
    looked up once."""
    return f"""raw AS ({source}), char AS (SELECT c, coalesce({_MAP}[c], c) AS f FROM (SELECT DISTINCT unnest(regexp_extract_all(t, '(?s).')) AS c FROM (SELECT DISTINCT t FROM raw))),
txt AS (SELECT row_number() OVER () AS no, t FROM (SELECT DISTINCT t FROM raw WHERE t IS NOT NULL)),
made AS (SELECT no, trim(regexp_replace(nfc_normalize(string_agg(f, '' ORDER BY spot)), '{_WS}+', ' ', 'g')) AS form FROM (SELECT no, unnest(range(0, len(x))) AS spot, unnest(x) AS c FROM (SELECT no, regexp_extract_all(t, '(?s).') AS x FROM txt)) JOIN char USING (c) GROUP BY 1),
formed AS (SELECT raw.*, form, regexp_extract_all(regexp_replace(lower(form), '([\\x{{4e00}}-\\x{{9fff}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+') AS words FROM raw JOIN txt ON raw.t = txt.t JOIN made USING (no))"""


_QUESTIONS = "\nUNION ALL\n".join(
    f"SELECT DISTINCT '{name}' AS src_table, id, question AS t, lower(regexp_replace(split, '^{_WS}+|{_WS}+$', '', 'g')) AS split FROM {name}" for name in ("formal_questions", "application_questions")
)
_NEAR = f"""{_formed(f"SELECT * FROM ({_QUESTIONS}) WHERE split IN ('development', 'test', 'regression') AND id IS NOT NULL")},
sets AS (SELECT src_table, id, split, split = 'development' AS train, list_sort(list_distinct(words)) AS w, array_to_string(list_sort(list_distinct(list_filter(words, lambda x: regexp_matches(x, '\\p{{N}}')))), ' ') AS digits FROM formed WHERE len(words) > 0),
near AS (SELECT t.src_table AS train_table, t.id AS train_id, e.src_table AS eval_table, e.split AS eval_split, e.id AS eval_id FROM sets t JOIN sets e ON t.digits = e.digits AND t.train AND NOT e.train AND t.id <> e.id AND len(list_intersect(t.w, e.w)) >= 0.7 * (len(t.w) + len(e.w) - len(list_intersect(t.w, e.w))) - 1e-9)"""
_RUNS = f"""{_formed("SELECT DISTINCT chunk_id AS key, text AS t FROM chunks WHERE chunk_id IS NOT NULL")},
cls AS (SELECT DISTINCT array_to_string(words, ' ') AS cls, words FROM formed WHERE len(words) > 0),
run AS (SELECT DISTINCT cls, unnest(CASE WHEN len(words) < 3 THEN [cls] ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS r FROM cls),
size AS (SELECT cls, count(*) AS n FROM run GROUP BY 1), held AS (SELECT hash(r) AS h, cls, n FROM run JOIN size USING (cls)),
link AS (SELECT a.cls AS a, b.cls AS b FROM held a JOIN held b ON a.h = b.h AND a.cls < b.cls AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) - 1e-9 GROUP BY a.cls, b.cls, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)) - 1e-9),
member AS (SELECT DISTINCT key, array_to_string(words, ' ') AS cls FROM formed WHERE len(words) > 0)"""

SQL = {
    "p4_found": f"""
SELECT DISTINCT src_table, item_id FROM (
  SELECT 'chunks' AS src_table, chunk_id AS item_id, text FROM chunks UNION ALL SELECT 'document_pages', CAST(page_id AS VARCHAR), text FROM document_pages
) WHERE len(regexp_extract_all(text, '{_TOKEN}')) > 450""",
    "p1_found": r"""
WITH named AS (
  SELECT id, lower(trim(session_id)) AS sid, created_at, question, answer,
    NOT (question IS NULL OR NOT regexp_matches(question, '[\p{L}\p{N}]') OR regexp_matches(question, '^\s*(null|none|nan|n/a|undefined)\s*$', 'i')) AS q,
    NOT (answer IS NULL OR NOT regexp_matches(answer, '[\p{L}\p{N}]') OR regexp_matches(answer, '^\s*(null|none|nan|n/a|undefined)\s*$', 'i')) AS a
  FROM conversation_turns WHERE trim(session_id) <> ''
), once AS (
  SELECT sid, created_at, question, answer, q, a, min(id) AS id FROM named WHERE q OR a GROUP BY sid, created_at, question, answer, q, a
), messages AS (
  SELECT sid, id, created_at, 0 AS k, 'user' AS role FROM once WHERE q UNION ALL SELECT sid, id, created_at, 1, 'assistant' FROM once WHERE a
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY created_at, id, k) AS msg_no, count(*) OVER (PARTITION BY sid) AS n FROM messages
), good AS (
  SELECT sid FROM numbered GROUP BY sid
  HAVING bool_and(created_at IS NOT NULL) AND bool_and((role = 'user') = (msg_no % 2 = 1)) AND max(n) % 2 = 0
)
SELECT sid AS session_id, msg_no, role, id AS turn_id FROM numbered WHERE sid IN (SELECT sid FROM good)""",
    "p2_found": f"""WITH {_RUNS},
pair AS (SELECT x.key AS k, y.key AS l FROM link JOIN member x ON x.cls = a JOIN member y ON y.cls = b UNION ALL SELECT x.key, y.key FROM member x JOIN member y USING (cls) WHERE x.key < y.key)
SELECT DISTINCT least(k, l) AS chunk_id_a, greatest(k, l) AS chunk_id_b FROM pair WHERE k <> l""",
    "p2_classes": f"""WITH {_RUNS},
n AS (SELECT cls, count(*) AS links FROM (SELECT a AS cls FROM link UNION ALL SELECT b FROM link) GROUP BY 1), c AS (SELECT cls, min(key) AS class_id, count(*) AS copies FROM member GROUP BY 1)
SELECT key AS chunk_id, class_id, copies, coalesce(links, 0) AS links FROM member JOIN c USING (cls) LEFT JOIN n USING (cls)""",
    "p3_found": f"WITH {_NEAR} SELECT DISTINCT least(train_id, eval_id) AS id_a, greatest(train_id, eval_id) AS id_b FROM near",
    "p3_report": f"""WITH {_NEAR} SELECT eval_table, eval_split, train_table, count(*) AS pairs, count(DISTINCT eval_id) AS eval_questions FROM (SELECT DISTINCT * FROM near) GROUP BY 1, 2, 3""",
    "p5_found": f"""WITH {_formed("SELECT DISTINCT 'chunks' AS src_table, chunk_id AS key, text AS t FROM chunks UNION ALL SELECT DISTINCT 'application_questions', id, question FROM application_questions")}
SELECT DISTINCT a.src_table, least(a.key, b.key) AS key_a, greatest(a.key, b.key) AS key_b FROM formed a JOIN formed b ON a.src_table = b.src_table AND a.form = b.form AND a.t <> b.t AND a.key < b.key WHERE a.form <> ''""",
}
