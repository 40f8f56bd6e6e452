"""Chunking, audits, sessions, look-ups and checks over the dataset's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import audit, chunking, lookup, sessions
from tessera.operators.metrics import rate
from tessera.operators.references import cleaned_ids
from tessera.plans.texts import _first, _strip
from tessera.session import checkpoint
from tessera.sources.tables import table, table_once


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table_once(spark, d, "document_pages", "page_id", "doc_id", "doc_name", "page", "metadata", "text").withColumn("text", F.coalesce("text", F.lit("")))


def chunk_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "document_pages").select("page_id", F.posexplode(F.split("text", "\r?\n", -1)).alias("line_no", "line")).withColumn("h", chunking.heading(F.col("line")))
    return lines.where("h is not null").select("page_id", "line_no", "h.level", "h.title").distinct()


def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    parts = _pages(spark, d).select("page_id", F.posexplode(chunking.sections(F.col("text"))).alias("no", "s"))
    return parts.select("page_id", "no", F.array_join("s.path", " > ").alias("path"), F.md5("s.text").alias("digest"))


def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    parts = _pages(spark, d).select("page_id", F.posexplode(chunking.fixed_chunks(F.col("text"))).alias("no", "text"))
    return parts.select("page_id", "no", F.size(T.chunk_tokens(F.col("text"))).alias("tokens"), F.md5("text").alias("digest"))


def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    parts = _pages(spark, d).select("page_id", F.posexplode(chunking.semantic_chunks(F.col("text"))).alias("no", "text"))
    return parts.select("page_id", "no", F.size(T.chunk_tokens(F.col("text"))).alias("tokens"), F.md5("text").alias("digest"))


def chunk_build(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).select("doc_id", "doc_name", "page", F.col("page_id").alias("order_no"), "text", F.col("metadata.representation").alias("representation"))
    return chunking.build_chunks(pages).select("chunk_id", "doc_id", "page", F.array_join("section_path", " > ").alias("path"), F.md5("text").alias("digest"))


def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    """What building chunks of all pages gives: documents and chunks."""
    pages = _pages(spark, d).select("doc_id", "doc_name", "page", F.col("page_id").alias("order_no"), "text", F.col("metadata.representation").alias("representation"))
    return chunking.ingest_counts(chunking.build_chunks(pages), "fixed")


def chunk_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """How alike neighbouring sentences of a chunk are, on average and at least."""
    s = F.transform(T.sentences(F.col("text")), lambda x: F.array_distinct(T.chunk_tokens(F.lower(x))))
    both = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))))
    rows = table(spark, d, "chunks").select("chunk_id", s.alias("s")).where(F.size("s") > 1).select("chunk_id", both.alias("b"))
    return rows.select("chunk_id", F.round(F.aggregate("b", F.lit(0.0), lambda a, x: a + x) / F.size("b"), 6).alias("mean"), F.round(F.array_min("b"), 6).alias("least")).distinct()


def audit_lengths(spark: SparkSession, d: str) -> DataFrame:
    return audit.length_audit(audit.sized_chunks(table(spark, d, "chunks")))


def audit_largest(spark: SparkSession, d: str) -> DataFrame:
    return audit.sized_chunks(table(spark, d, "chunks")).orderBy(F.desc("chars"), "chunk_id").limit(20)


def audit_docs(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each document."""
    return audit.sized_chunks(table(spark, d, "chunks")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chars").alias("chars"))


def audit_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("metadata.representation = 'table_row'").select("chunk_id", "doc_id", "page", F.col("metadata.table_id").alias("table_id"), T.looks_like_links(F.col("text")).alias("links")).distinct()
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("table_id").alias("tables"), F.count_distinct("page").alias("pages"), F.count_if("links").alias("links"))


def audit_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("metadata.representation = 'table_row'").select("doc_id", "chunk_id", F.substring("text", 1, 80).alias("text")).distinct()
    from pyspark.sql import Window as W

    return rows.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_id"))).where("place <= 3")


def audit_index(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.agg(
        F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.count_distinct("metadata.table_id").alias("tables"), F.max("ingested_at").alias("newest"),
        F.count_distinct(F.when(F.col("metadata.status").startswith("current"), F.col("doc_id"))).alias("current_docs"),
    )


def session_recent(spark: SparkSession, d: str) -> DataFrame:
    return sessions.keep_last(sessions.turns_once(table(spark, d, "conversation_turns").select("id", "session_id")), "session_id", "id", 20)


def session_followups(spark: SparkSession, d: str) -> DataFrame:
    turns = sessions.turns_once(table(spark, d, "conversation_turns").select("id", "session_id", "question", "created_at"))
    return sessions.followups(turns).where("used > 0").select("id", "session_id", F.md5("query").alias("digest"), "used")


def session_summaries(spark: SparkSession, d: str) -> DataFrame:
    turns = sessions.turns_once(table(spark, d, "conversation_turns").select("id", "session_id", "model", "version", "answer"))
    newest = sessions.keep_newest(turns, "session_id", "id")
    return newest.select("session_id", F.col("id").alias("turn_id"), "model", "version", F.md5(F.right(F.coalesce("answer", F.lit("")), F.lit(2000))).alias("digest"))


def session_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many turns clearing each session would remove."""
    return sessions.turns_once(table(spark, d, "conversation_turns").select("id", "session_id")).groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))


def event_limits(spark: SparkSession, d: str) -> DataFrame:
    return sessions.rate_limited(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 24 * 3600.0).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"), F.max("retry_after").alias("longest"))


def event_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events, distinct users and value percentiles of each type and hour."""
    e = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.round(F.expr("percentile(value, 0.5)"), 6).alias("median"))


def usage_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Turns by tool: number, with sources, and the rate."""
    turns = table(spark, d, "conversation_turns").select("id", "selected_tool", F.contains(F.coalesce("source_chunk_ids", F.lit("")), F.lit("_")).alias("sourced")).distinct()
    return turns.groupBy("selected_tool").agg(F.count(F.lit(1)).alias("turns"), F.count_if("sourced").alias("sourced"), F.round(rate(F.count_if("sourced"), F.count(F.lit(1))), 6).alias("sourced_rate"))


def check_questions(spark: SparkSession, d: str) -> DataFrame:
    found = None
    for name in ("formal_questions", "application_questions"):
        one = audit.violations(table(spark, d, name), "id", audit.question_rules()).withColumn("src_table", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("src_table", "rule").agg(F.count(F.lit(1)).alias("rows"))


_KEYS = {"chunks": "chunk_id", "document_pages": "page_id", "conversation_turns": "id", "formal_questions": "id", "application_questions": "id", "verified_solutions": "id"}


def check_repeats(spark: SparkSession, d: str) -> DataFrame:
    found = None
    for name, key in _KEYS.items():
        one = audit.repeated_keys(table(spark, d, name), key).withColumn("src_table", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def check_gold(spark: SparkSession, d: str) -> DataFrame:
    """Gold chunks of application questions that don't exist."""
    rows = table(spark, d, "application_questions").select("id", cleaned_ids(F.col("gold_chunk_ids")).alias("gold"))
    return lookup.missing_gold(rows, table(spark, d, "chunks"), "gold")


def lookup_gold_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "formal_questions").select("id", "gold_chunk_ids").distinct()
    texts = table(spark, d, "chunks").groupBy("chunk_id").agg(F.first("text").alias("text"))
    return lookup.gathered_texts(rows, texts, "gold_chunk_ids").select("id", F.md5("text").alias("digest"))


def lookup_alarms(spark: SparkSession, d: str) -> DataFrame:
    """For each solved problem that names a code the first chunk that does, among all the codes of each chunk."""
    codes = table(spark, d, "chunks").select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit(_CODE), F.lit(1))).alias("code")).distinct().select(F.col("chunk_id").alias("no"), "code", F.lit("").alias("model"), "chunk_id")
    asked = table(spark, d, "verified_solutions").select(F.col("id").alias("query_id"), F.nullif(F.regexp_extract("problem", _CODE, 1), F.lit("")).alias("code"), "model").distinct()
    return lookup.lookup_codes(asked, codes).select("query_id", "chunk_id")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """The names of parameters that formal questions ask about, by the number of the first question."""
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    rows = table(spark, d, "formal_questions").select(number.alias("no"), F.explode(F.regexp_extract_all("question", F.lit(_NAME), F.lit(1))).alias("name"))
    return rows.groupBy("name").agg(F.min("no").alias("name_id"))


def lookup_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The longest parameter name that each solution contains (any case)."""
    texts = table(spark, d, "verified_solutions").select(F.col("id").alias("text_id"), F.col("solution").alias("text")).distinct()
    return lookup.names_in_texts(texts, _names(spark, d))


def lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of problems by the names in them, and of beginnings of names by the names that go on from them."""
    names = _names(spark, d)
    parameters = names.select(F.col("name_id").alias("parameter_id"), "name", F.array(F.concat("name", F.lit("-alias"))).alias("aliases"), F.when(F.length("name") > 11, "ZV-1200").otherwise("").alias("model"))
    solved = table(spark, d, "verified_solutions").select(F.concat(F.lit("s"), F.col("id")).alias("query_id"), F.col("problem").alias("text"), "model").distinct()
    short = names.select(F.concat(F.lit("n"), F.col("name_id"), F.lit("_"), "name").alias("query_id"), F.lower(F.substring("name", 1, 7)).alias("text"), F.lit("ZV-1200").alias("model"))
    return lookup.lookup_parameters(solved.unionByName(short), parameters)


def lookup_rows(spark: SparkSession, d: str) -> DataFrame:
    """Table rows for each application question asked, by its words, model and version."""
    rows = table(spark, d, "chunks").where("metadata.representation = 'table_row'").select("chunk_id", "doc_name", "text", "model", "version")
    asked = table(spark, d, "application_questions").select(F.col("id").alias("query_id"), F.col("question").alias("query"), "model").distinct()
    return lookup.lookup_rows(asked, rows, 5).select("query_id", "place", "chunk_id", "doc_name", "model", "version", F.md5("text").alias("digest"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The manuals' graph: makers, models and manuals, and who makes and describes what; questions with the model they are about."""
    m = table(spark, d, "chunks").select("doc_id", F.initcap(F.trim("manufacturer")).alias("maker"), "model").where("maker is not null and model != ''")
    m = checkpoint(m.groupBy("doc_id").agg(F.min("maker").alias("maker"), F.min("model").alias("model")))
    node = lambda c, kind: F.concat(F.lit(f"{kind}:"), F.col(c))
    first = F.regexp_extract("maker", "^([A-Za-z]+)", 1)
    nodes = (
        m.select(node("maker", "a").alias("node_id"), F.col("maker").alias("label"), F.array(first).alias("aliases")).unionByName(m.select(node("model", "b").alias("node_id"), F.col("model").alias("label"), F.array().cast("array<string>").alias("aliases")))
        .unionByName(m.select(node("doc_id", "c").alias("node_id"), F.col("doc_id").alias("label"), F.array().cast("array<string>").alias("aliases"))).distinct()
    )
    about = m.select(F.concat(F.lit("1"), F.col("doc_id")).alias("edge_id"), node("doc_id", "c").alias("source"), F.lit("describes").alias("relation"), node("model", "b").alias("target"))
    made = m.select(F.concat(F.lit("0"), F.col("maker"), F.col("model")).alias("edge_id"), node("maker", "a").alias("source"), F.lit("makes").alias("relation"), node("model", "b").alias("target")).distinct()
    asked = table(spark, d, "formal_questions").select(F.col("id").alias("text_id"), F.concat_ws(" ", "question", "device_model").alias("text"))
    return asked, nodes, about.unionByName(made)


def lookup_graph(spark: SparkSession, d: str) -> DataFrame:
    """One hop from the makers and models that each formal question names."""
    return lookup.expand_graph(*_graph(spark, d))[0]


def lookup_graph_terms(spark: SparkSession, d: str) -> DataFrame:
    """The entities that each formal question names, and the terms that the graph adds to them."""
    found = lookup.expand_graph(*_graph(spark, d))[1]
    return found.select("text_id", F.array_join("entities", " | ").alias("entities"), F.array_join("terms", " | ").alias("terms"))


_CODE, _NAME = r"(?i)((?:16#|0x)[0-9a-f]{4})", "([A-Z]{2}_[A-Z]+_[0-9]+)"


QUERIES = {
    f.__name__: f
    for f in (
        chunk_headings, chunk_sections, chunk_fixed, chunk_semantic, chunk_build, ingest_counts, chunk_neighbours, audit_lengths, audit_largest, audit_docs, audit_tables, audit_samples, audit_index, session_recent, session_followups,
        session_summaries, session_sizes, event_limits, event_hours, usage_metrics, check_questions, check_repeats, check_gold, lookup_gold_texts, lookup_alarms, lookup_parameters, lookup_fallback, lookup_rows, lookup_graph, lookup_graph_terms,
    )
}

_SIZED = f"sized AS (SELECT DISTINCT chunk_id, doc_id, coalesce(nullif(metadata.representation, ''), 'narrative') AS kind, length(coalesce(text, '')) AS chars, len(regexp_extract_all(coalesce(text, ''), '{L.CHUNK_TOKEN}')) AS tokens FROM chunks)"
_TURNS = f"turns AS (SELECT id, lower({_strip('session_id')}) AS session_id, any_value(question) AS question, any_value(created_at) AS created_at, any_value(model) AS model, any_value(version) AS version, any_value(answer) AS answer FROM conversation_turns WHERE {_strip('session_id')} <> '' GROUP BY 1, 2)"
_MARKED = " OR ".join([*(f"starts_with(lower(q), '{x}')" for x in L.FOLLOWUP_STARTS), *(f"ends_with(lower(q), '{x}')" for x in L.FOLLOWUP_ENDS), *(f"contains(lower(q), '{x}')" for x in L.FOLLOWUP_INSIDE)])


def _turned(c: str) -> str:
    c = f"substr({c}, 1, 240)"
    return f"CASE WHEN contains(q, '写') THEN replace(replace({c}, 'RD_MB_DATA_LEN', 'WR_MB_DATA_LEN'), '读取', '写入') WHEN contains(q, '读') THEN replace(replace({c}, 'WR_MB_DATA_LEN', 'RD_MB_DATA_LEN'), '写入', '读取') ELSE {c} END"


_FILLED = f"list_filter(g, lambda x: {_strip('coalesce(x, chr(32))')} <> '')"
_RULES = {
    "blank question": f"{_strip('coalesce(question, chr(32))')} = ''",
    "blank split": f"{_strip('coalesce(split, chr(32))')} = ''",
    "answerable without gold": f"answerable AND len({_FILLED}) = 0",
    "gold though unanswerable": f"NOT answerable AND len({_FILLED}) > 0",
    "blank gold entry": f"len({_FILLED}) < len(g)",
    "padded gold entry": f"len(list_filter({_FILLED}, lambda y: y <> {_strip('y')})) > 0",
    "repeated gold entry": f"len(list_distinct(list_transform({_FILLED}, lambda y: {_strip('y')}))) < len({_FILLED})",
}
_STATS = "count(*) AS chunks, count(DISTINCT doc_id) AS docs, min(chars) AS least, max(chars) AS most, quantile_disc(chars, 0.5) AS p50, quantile_disc(chars, 0.9) AS p90, quantile_disc(chars, 0.95) AS p95, quantile_disc(chars, 0.99) AS p99, quantile_disc(tokens, 0.9) AS tokens_p90, count_if(chars > 2000) AS over_2000_chars, count_if(tokens > 600) AS over_600_tokens"

_PAGES = "page AS (SELECT page_id, any_value(coalesce(text, '')) AS text, any_value(doc_id) AS doc_id, any_value(page) AS page, any_value(coalesce(metadata.representation = 'table_row', false)) AS whole FROM document_pages GROUP BY 1)"
_HEAD = f"""head AS (SELECT *, regexp_extract(s, '{L.MARKDOWN_HEADING}', 2) AS md, length(regexp_extract(s, '{L.MARKDOWN_HEADING}', 1)) AS ml, regexp_extract(s, '{L.NUMBERED_HEADING}', 1) AS num,
  regexp_extract(s, '{L.NUMBERED_HEADING}', 2) AS rest, regexp_extract(s, '{L.CHINESE_HEADING}', 1) AS zh, regexp_matches(s, '\\.{{3,}}') AS dots FROM line),
marked AS (SELECT *, md <> '' OR (num <> '' AND NOT dots) OR zh <> '' AS is_head, CASE WHEN md <> '' THEN ml WHEN num <> '' AND NOT dots THEN least(4, length(num) - length(replace(num, '.', '')) + 1) ELSE 1 END AS level,
  substr(CASE WHEN md <> '' THEN {_strip('md')} WHEN num <> '' AND NOT dots THEN num || ' ' || rest ELSE zh END, 1, 100) AS title FROM head)"""
#: Pages cut at their headings: ``part`` has ``page_id, no, path, text``.
_PARTS = f"""{_PAGES},
line AS (SELECT page_id, unnest(range(0, len(x))) AS line_no, unnest(x) AS line, {_strip('unnest(x)')} AS s FROM (SELECT page_id, regexp_split_to_array(regexp_replace(text, '{L.LINE_END}', chr(10), 'g'), '\\n') AS x FROM page WHERE NOT whole)),
{_HEAD},
counted AS (SELECT *, sum(CAST(is_head AS INT)) OVER (PARTITION BY page_id ORDER BY line_no) AS hn FROM marked),
paths AS (SELECT page_id, CAST(0 AS HUGEINT) AS hn, CAST([] AS VARCHAR[]) AS path FROM page UNION ALL
  SELECT p.page_id, h.hn, list_concat(CASE WHEN h.level = 1 THEN CAST([] AS VARCHAR[]) ELSE list_slice(p.path, 1, h.level - 1) END, [h.title]) FROM paths p JOIN counted h ON h.page_id = p.page_id AND h.is_head AND h.hn = p.hn + 1),
body AS (SELECT page_id, hn, {_strip("string_agg(line, chr(10) ORDER BY line_no)")} AS text FROM counted WHERE NOT is_head GROUP BY 1, 2),
found AS (SELECT page_id, hn, path, text FROM body JOIN paths USING (page_id, hn) WHERE text <> ''),
part AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY hn) - 1 AS no, path, text FROM found UNION ALL
  SELECT page_id, 0, CAST([] AS VARCHAR[]), {_strip('text')} FROM page WHERE NOT whole AND page_id NOT IN (SELECT page_id FROM found))"""


def _said(source: str, key: str) -> str:
    """``said``: the sentences of each text of ``source``, with running sums of their numbers of tokens."""
    return f"""said0 AS (SELECT {key}, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([{L.SENTENCE_STOPS}])', '\\1' || chr(10), 'g'), '\\n+'), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM {source}),
said1 AS (SELECT *, list_transform(p, lambda x: len(regexp_extract_all(x, '{L.CHUNK_TOKEN}'))) AS n FROM said0 WHERE len(p) > 0),
said AS (SELECT *, len(p) AS m, list_transform(range(0, len(p) + 1), lambda i: CAST(coalesce(list_sum(n[1:i]), 0) AS BIGINT)) AS sums FROM said1)"""


def _packed(key: str, named: str) -> str:
    """``packed``: spans ``a..b`` of ``said`` by search in the sums, each from where the one before says."""
    end = "least(m, greatest({f}, len(list_filter(sums, lambda x: x <= sums[{s} + 1] + 450)) - 1))"
    start = "greatest(a, least(b - 1, len(list_filter(sums, lambda x: x < sums[b + 1] - 60))))"
    return f"""spans AS (SELECT {key}, m, sums, 0 AS a, {end.format(f='1', s='0')} AS b FROM said UNION ALL
  SELECT {named}, m, sums, nxt, least(m, greatest(b + 1, len(list_filter(sums, lambda x: x <= sums[nxt + 1] + 450)) - 1)) FROM (SELECT *, {start} AS nxt FROM spans WHERE b < m)),
packed AS (SELECT {named}, a, array_to_string(p[a + 1:b], chr(10)) AS text FROM spans JOIN said USING ({key}) WHERE length(array_to_string(p[a + 1:b], chr(10))) >= 20)"""


_NAMES = f"n AS (SELECT name, min(no) AS name_id FROM (SELECT CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS no, unnest(regexp_extract_all(question, '{_NAME}', 1)) AS name FROM formal_questions) GROUP BY 1)"
_HOP = """c AS (SELECT DISTINCT doc_id, array_to_string(list_transform(string_split(trim(manufacturer), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS maker, model FROM chunks WHERE manufacturer IS NOT NULL AND model <> ''),
m AS (SELECT doc_id, min(maker) AS maker, min(model) AS model FROM c GROUP BY 1),
node AS (SELECT DISTINCT 'a:' || maker AS node_id, maker AS label, regexp_extract(maker, '^([A-Za-z]+)', 1) AS alias FROM m UNION SELECT 'b:' || model, model, model FROM m UNION SELECT 'c:' || doc_id, doc_id, doc_id FROM m),
edge AS (SELECT '1' || doc_id AS edge_id, 'c:' || doc_id AS source, 'describes' AS relation, 'b:' || model AS target FROM m UNION SELECT '0' || maker || model, 'a:' || maker, 'makes', 'b:' || model FROM m),
q AS (SELECT DISTINCT id AS text_id, concat_ws(' ', question, device_model) AS t FROM formal_questions),
seed AS (SELECT text_id, node_id FROM q JOIN node ON contains(lower(t), lower(label)) OR (alias <> '' AND contains(lower(t), lower(alias))) QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY node_id) <= 4),
hop AS (SELECT DISTINCT text_id, edge.* FROM seed JOIN edge ON node_id = source OR node_id = target),
rel AS (SELECT * FROM hop QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY edge_id) <= 12)"""

SQL = {
    "chunk_headings": f"""
WITH l AS (SELECT page_id, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM (SELECT page_id, regexp_split_to_array(text, '\\r?\\n') AS x FROM document_pages)),
s AS (SELECT page_id, line_no, {_strip('line')} AS s FROM l),
p AS (SELECT *, regexp_extract(s, '{L.MARKDOWN_HEADING}', 2) AS md, length(regexp_extract(s, '{L.MARKDOWN_HEADING}', 1)) AS ml, regexp_extract(s, '{L.NUMBERED_HEADING}', 1) AS num, regexp_extract(s, '{L.NUMBERED_HEADING}', 2) AS rest, regexp_extract(s, '{L.CHINESE_HEADING}', 1) AS zh FROM s)
SELECT DISTINCT page_id, line_no, CASE WHEN md <> '' THEN ml WHEN num <> '' AND NOT regexp_matches(s, '\\.{{3,}}') THEN least(4, length(num) - length(replace(num, '.', '')) + 1) ELSE 1 END AS level,
  substr(CASE WHEN md <> '' THEN {_strip('md')} WHEN num <> '' AND NOT regexp_matches(s, '\\.{{3,}}') THEN num || ' ' || rest ELSE {_strip('zh')} END, 1, 100) AS title
FROM p WHERE md <> '' OR (num <> '' AND NOT regexp_matches(s, '\\.{{3,}}')) OR zh <> ''""",
    "chunk_sections": f"WITH RECURSIVE {_PARTS.replace("metadata.representation = 'table_row'", 'false')} SELECT page_id, no, array_to_string(path, ' > ') AS path, md5(text) AS digest FROM part",
    "chunk_fixed": f"""WITH RECURSIVE {_PAGES}, {_said('page', 'page_id')}, {_packed('page_id', 'page_id')}
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY a) - 1 AS no, len(regexp_extract_all(text, '{L.CHUNK_TOKEN}')) AS tokens, md5(text) AS digest FROM packed""",
    "chunk_semantic": f"""WITH RECURSIVE {_PAGES}, {_said('page', 'page_id')},
words AS (SELECT page_id, p, m, list_transform(p, lambda x: list_distinct(regexp_extract_all(lower(x), '{L.CHUNK_TOKEN}'))) AS w FROM said),
near AS (SELECT *, list_transform(range(0, m + 1), lambda i: CAST(coalesce(list_sum(list_transform(w[1:i], lambda y: len(y))), 0) AS BIGINT)) AS d,
  list_transform(range(1, m + 1), lambda i: CASE WHEN i = 1 THEN 0.0 ELSE len(list_intersect(w[i - 1], w[i])) / greatest(1, len(w[i - 1]) + len(w[i]) - len(list_intersect(w[i - 1], w[i]))) END) AS sim FROM words),
cuts AS (SELECT page_id, 0 AS a FROM near UNION ALL
  SELECT page_id, nxt FROM (SELECT page_id, list_min(list_filter(range(a + 1, m), lambda i: d[i + 2] - d[a + 1] > 600 OR (d[i + 1] - d[a + 1] >= 450 AND sim[i + 1] < 0.05))) AS nxt FROM cuts JOIN near USING (page_id)) WHERE nxt IS NOT NULL),
ends AS (SELECT page_id, a, lead(a, 1) OVER (PARTITION BY page_id ORDER BY a) AS b FROM cuts),
texts AS (SELECT page_id, a, array_to_string(p[a + 1:coalesce(b, m)], chr(10)) AS text FROM ends JOIN near USING (page_id))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY a) - 1 AS no, len(regexp_extract_all(text, '{L.CHUNK_TOKEN}')) AS tokens, md5(text) AS digest FROM texts WHERE length(text) >= 20""",
    "chunk_build": f"""WITH RECURSIVE {_PARTS}, {_said('part', 'page_id, no')}, {_packed('page_id, no', 'page_id, no')},
every AS (SELECT page_id, no, a, path, packed.text FROM packed JOIN part USING (page_id, no) UNION ALL SELECT page_id, 0, 0, CAST([] AS VARCHAR[]), text FROM page WHERE whole),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, no, a) AS number FROM (SELECT e.*, doc_id, page FROM every e JOIN page USING (page_id)))
SELECT doc_id || printf('_%04d_%04d', page, number) AS chunk_id, doc_id, page, array_to_string(path, ' > ') AS path, md5(CASE WHEN len(path) > 0 THEN array_to_string(path, ' > ') || chr(10) ELSE '' END || text) AS digest FROM numbered""",
    "ingest_counts": f"""WITH RECURSIVE {_PARTS}, {_said('part', 'page_id, no')}, {_packed('page_id, no', 'page_id, no')}
SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, 'fixed' AS mode FROM (SELECT page_id FROM packed UNION ALL SELECT page_id FROM page WHERE whole) JOIN page USING (page_id)""",
    "chunk_neighbours": f"""
WITH t AS (SELECT DISTINCT chunk_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([{L.SENTENCE_STOPS}])', '\\1' || chr(10), 'g'), '\\n+'), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM chunks),
s AS (SELECT chunk_id, list_transform(p, lambda x: list_distinct(regexp_extract_all(lower(x), '{L.CHUNK_TOKEN}'))) AS s FROM t WHERE len(p) > 1),
b AS (SELECT chunk_id, list_transform(range(1, len(s)), lambda i: len(list_intersect(s[i], s[i + 1])) / greatest(1, len(s[i]) + len(s[i + 1]) - len(list_intersect(s[i], s[i + 1])))) AS b FROM s)
SELECT chunk_id, round(list_sum(b) / len(b), 6) AS mean, round(list_min(b), 6) AS least FROM b""",
    "audit_lengths": f"WITH {_SIZED} SELECT kind, {_STATS} FROM sized GROUP BY ROLLUP (kind)",
    "audit_largest": f"WITH {_SIZED} SELECT * FROM sized ORDER BY chars DESC, chunk_id LIMIT 20",
    "audit_docs": f"WITH {_SIZED} SELECT doc_id, count(*) AS chunks, CAST(sum(chars) AS BIGINT) AS chars FROM sized GROUP BY 1",
    "audit_tables": """
WITH r AS (SELECT DISTINCT chunk_id, doc_id, page, metadata.table_id AS table_id, contains(lower(text), 'http://') OR contains(lower(text), 'https://') OR contains(lower(text), 'www.') AS links FROM chunks WHERE metadata.representation = 'table_row')
SELECT doc_id, count(*) AS rows, count(DISTINCT table_id) AS tables, count(DISTINCT page) AS pages, count_if(links) AS links FROM r GROUP BY 1""",
    "audit_samples": """
WITH r AS (SELECT DISTINCT doc_id, chunk_id, substr(text, 1, 80) AS text FROM chunks WHERE metadata.representation = 'table_row')
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS place FROM r QUALIFY place <= 3""",
    "audit_index": "SELECT count(DISTINCT chunk_id) AS chunks, count(DISTINCT doc_id) AS docs, count(DISTINCT metadata.table_id) AS tables, max(ingested_at) AS newest, count(DISTINCT CASE WHEN starts_with(metadata.status, 'current') THEN doc_id END) AS current_docs FROM chunks",
    "session_recent": f"WITH {_TURNS} SELECT id, session_id FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 20",
    "session_followups": f"""
WITH {_TURNS},
w AS (SELECT id, session_id, {_strip("coalesce(question, '')")} AS q, created_at, lag(coalesce(question, ''), 1) OVER s AS q1, lag(created_at, 1) OVER s AS t1, lag(coalesce(question, ''), 2) OVER s AS q2, lag(created_at, 2) OVER s AS t2 FROM turns WINDOW s AS (PARTITION BY session_id ORDER BY id)),
l AS (SELECT *, list_filter([CASE WHEN t2 >= created_at - INTERVAL 24 HOURS THEN '此前问题：' || {_turned('q2')} END, CASE WHEN t1 >= created_at - INTERVAL 24 HOURS THEN '此前问题：' || {_turned('q1')} END], lambda x: x IS NOT NULL) AS lines FROM w WHERE length(q) <= 80 AND ({_MARKED}))
SELECT id, session_id, md5(array_to_string(lines, chr(10)) || chr(10) || '当前追问：' || q) AS digest, len(lines) AS used FROM l WHERE len(lines) > 0""",
    "session_summaries": f"WITH {_TURNS} SELECT session_id, id AS turn_id, model, version, md5(right(coalesce(answer, ''), 2000)) AS digest FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) = 1",
    "session_sizes": f"WITH {_TURNS} SELECT session_id, count(*) AS turns FROM turns GROUP BY 1",
    "event_limits": """WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
state AS (SELECT user_id, 0 AS no, CAST([] AS DOUBLE[]) AS log, NULL::BOOLEAN AS allowed, 0 AS wait FROM e GROUP BY 1 UNION ALL
  SELECT user_id, no, CASE WHEN len(kept) >= 3 THEN kept ELSE list_concat(kept, [t]) END, len(kept) < 3, CASE WHEN len(kept) >= 3 THEN greatest(1, CAST(trunc(86400 - (t - kept[1]) + 0.999) AS INT)) ELSE 0 END
  FROM (SELECT e.user_id, CAST(e.no AS INT) AS no, e.t, list_filter(s.log, lambda x: x > e.t - 86400) AS kept FROM state s JOIN e ON e.user_id = s.user_id AND e.no = s.no + 1))
SELECT user_id, count_if(allowed) AS allowed, count_if(NOT allowed) AS refused, max(wait) AS longest FROM state WHERE no > 0 GROUP BY 1""",
    "event_hours": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value, quantile_disc(value, 0.95) AS p95, round(median(value), 6) AS median FROM events GROUP BY 1, 2",
    "usage_metrics": """
WITH t AS (SELECT DISTINCT id, selected_tool, contains(coalesce(source_chunk_ids, ''), '_') AS sourced FROM conversation_turns)
SELECT selected_tool, count(*) AS turns, count_if(sourced) AS sourced, round(count_if(sourced) / count(*), 6) AS sourced_rate FROM t GROUP BY 1""",
    "check_questions": "\nUNION ALL\n".join(
        f"SELECT '{t}' AS src_table, '{rule}' AS rule, count(DISTINCT id) AS rows FROM (SELECT *, coalesce(gold_chunk_ids, CAST([] AS VARCHAR[])) AS g FROM {t}) WHERE {where} HAVING count(*) > 0"
        for t in ("formal_questions", "application_questions") for rule, where in _RULES.items()
    ),
    "check_repeats": "\nUNION ALL\n".join(f"SELECT '{t}' AS src_table, CAST({k} AS VARCHAR) AS key, count(*) AS n FROM {t} GROUP BY {k} HAVING count(*) > 1" for t, k in _KEYS.items()),
    "check_gold": f"SELECT DISTINCT id, chunk_id FROM (SELECT id, {_strip('unnest(gold_chunk_ids)')} AS chunk_id FROM application_questions) WHERE chunk_id <> '' AND lower(chunk_id) <> 'null' AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)",
    "lookup_gold_texts": """
WITH r AS (SELECT DISTINCT id, gold_chunk_ids AS g FROM formal_questions), l AS (SELECT id, unnest(range(0, len(g))) AS place, unnest(g) AS chunk_id FROM r),
c AS (SELECT chunk_id, any_value(text) AS text FROM chunks GROUP BY 1)
SELECT id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY place)) AS digest FROM l LEFT JOIN c USING (chunk_id) GROUP BY 1""",
    "lookup_alarms": f"""
WITH c AS (SELECT chunk_id, replace(replace(upper(code), '16#', ''), '0X', '') AS code FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '{_CODE}', 1)) AS code FROM chunks)), q AS (SELECT DISTINCT id, replace(replace(upper(regexp_extract(problem, '{_CODE}', 1)), '16#', ''), '0X', '') AS code FROM verified_solutions)
SELECT q.id AS query_id, min(c.chunk_id) AS chunk_id FROM q JOIN c USING (code) WHERE code <> '' GROUP BY 1""",
    "lookup_parameters": f"""WITH {_NAMES}, t AS (SELECT DISTINCT id, lower(solution) AS s FROM verified_solutions)
SELECT id AS text_id, name_id, name FROM t JOIN n ON contains(s, lower(name)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(name) DESC, name_id) = 1""",
    "lookup_fallback": f"""WITH {_NAMES}, p AS (SELECT name_id, name, CASE WHEN length(name) > 11 THEN 'ZV-1200' ELSE '' END AS own FROM n UNION ALL SELECT name_id, name || '-alias', CASE WHEN length(name) > 11 THEN 'ZV-1200' ELSE '' END FROM n),
q AS (SELECT DISTINCT 's' || id AS query_id, problem AS t, coalesce(model, '') AS m FROM verified_solutions UNION ALL SELECT 'n' || name_id || '_' || name, lower(substr(name, 1, 7)), 'ZV-1200' FROM n),
a AS (SELECT query_id, name_id FROM q JOIN p ON contains(lower(t), lower(name)) AND (own = '' OR own = m) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, name_id) = 1),
b AS (SELECT query_id, min(name_id) AS name_id FROM q JOIN p ON {_strip('t')} <> '' AND contains(lower(name), lower({_strip('t')})) AND (own = '' OR own = m) GROUP BY 1)
SELECT query_id, coalesce(a.name_id, b.name_id) IS NOT NULL AS found, CASE WHEN a.name_id IS NOT NULL THEN 'in text' WHEN b.name_id IS NOT NULL THEN 'like' END AS way, coalesce(a.name_id, b.name_id) AS parameter_id FROM q LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)""",
    "lookup_rows": f"""WITH q AS (SELECT DISTINCT id AS query_id, coalesce(model, '') AS m, lower(regexp_extract(question, '(?i)(?:^|[^A-Za-z0-9])(V?[0-9]+(?:\\.[0-9]+)+)', 1)) AS v, list_distinct(list_filter(list_transform(list_concat([{_strip('question')}], regexp_extract_all(question, '{L.ROW_TERM}')), lambda x: lower(x)), lambda x: x <> '')) AS terms
  FROM application_questions),
r AS (SELECT chunk_id, any_value(doc_name) AS doc_name, any_value(text) AS text, any_value(model) AS model, any_value(version) AS version FROM chunks WHERE metadata.representation = 'table_row' GROUP BY 1),
h AS (SELECT query_id, chunk_id, doc_name, model, version, md5(text) AS digest FROM q JOIN r ON (m = '' OR coalesce(model, '') IN ('', m)) AND (v = '' OR contains(lower(coalesce(version, '')), v)) WHERE len(list_filter(terms, lambda t: contains(lower(coalesce(text, '')), t) OR contains(lower(coalesce(doc_name, '')), t))) > 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS place, chunk_id, doc_name, model, version, digest FROM h QUALIFY place <= 5""",
    "lookup_graph": f"WITH {_HOP} SELECT text_id, edge_id, substr(source, 3) AS source, relation, substr(target, 3) AS target FROM rel",
    "lookup_graph_terms": f"""WITH {_HOP},
said AS (SELECT text_id, flatten(list([substr(source, 3), substr(target, 3)] ORDER BY edge_id, source, target)) AS s FROM rel GROUP BY 1),
fresh AS (SELECT text_id, list_filter(s, lambda x, i: list_position(s, x) = i AND NOT contains(lower(t), lower(x)))[1:8] AS s FROM said JOIN q USING (text_id))
SELECT text_id, array_to_string(list(node_id ORDER BY node_id), ' | ') AS entities, coalesce(array_to_string(any_value(s), ' | '), '') AS terms FROM seed LEFT JOIN fresh USING (text_id) GROUP BY 1""",
}
