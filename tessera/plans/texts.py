"""Text functions over whole tables, with their SQL. Whole-row repeats count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.sources.tables import table


def _digest(c):
    return F.md5(F.array_join(c, "\x1f"))


def text_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "document_pages")
    cleaned = T.clean_text(F.col("text"))
    return pages.select("page_id", F.length(cleaned).alias("n"), F.md5(cleaned).alias("digest")).distinct()


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.chunk_tokens(F.col("text"))
    return table(spark, d, "chunks").select("chunk_id", F.size(tokens).alias("n"), F.size(F.array_distinct(tokens)).alias("n_distinct"), _digest(tokens).alias("digest")).distinct()


def text_search_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.search_tokens(F.col("text"))
    return table(spark, d, "chunks").select("chunk_id", F.size(tokens).alias("n"), _digest(tokens).alias("digest")).distinct()


def text_embedding_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "formal_questions").select("id", F.array_join(T.embedding_tokens(F.col("question")), " ").alias("tokens")).distinct()


def text_technical_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = F.transform(T.find_all(F.col("question"), L.TECHNICAL_TERM), lambda x: x)
    return table(spark, d, "formal_questions").select(
        "id", F.array_join(T.technical_terms(F.col("question")), " ").alias("terms"), F.array_join(T.canonical_terms(terms), " ").alias("canonical"), F.array_join(T.telling_terms(terms), " ").alias("telling")
    ).distinct()


def text_similarity_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "verified_solutions").select("id", F.array_join(T.similarity_terms(F.col("problem")), " ").alias("terms")).distinct()


def text_search_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "application_questions").select("id", F.array_join(T.search_terms(F.col("question")), "\n").alias("terms")).distinct()


def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    parts = T.sentences(F.col("text"))
    return table(spark, d, "chunks").select("chunk_id", F.size(parts).alias("n"), _digest(parts).alias("digest")).distinct()


def text_generic_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", F.explode(T.generic_terms(F.col("text"))).alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("chunks"))


def text_links(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat_ws(" ", "doc_name", "source_url", "text")
    return table(spark, d, "chunks").where(T.looks_like_links(shown)).select("chunk_id").distinct()


def text_alarm_codes(spark: SparkSession, d: str) -> DataFrame:
    code = T.alarm_code(F.col("question"))
    return table(spark, d, "conversation_turns").select("id", T.normal_code(code).alias("code")).where(F.col("code").isNotNull()).distinct()


def text_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversation_turns").select("id", T.value_and_unit(F.col("question")).alias("v")).where(F.col("v.value").isNotNull()).select("id", "v.value", "v.unit").distinct()


def text_expand(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "formal_questions").select("id", T.expanded_query(F.col("question")).alias("expanded")).distinct()


def text_secrets(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(T.secret_kinds(text)).alias("kinds"), F.md5(T.redacted(text)).alias("digest")).distinct()


def text_versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", T.display_version(F.col("version")).alias("version")).distinct().groupBy("version").agg(F.count(F.lit(1)).alias("chunks"))


QUERIES = {
    f.__name__: f
    for f in (
        text_clean, text_tokens, text_search_tokens, text_embedding_tokens, text_technical_terms, text_similarity_terms, text_search_terms, text_sentences, text_generic_terms, text_links, text_alarm_codes, text_values,
        text_expand, text_secrets, text_versions,
    )
}



def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{L.WS}+|{L.WS}+$', '', 'g')"


def _join(x: str) -> str:
    return f"md5(array_to_string({x}, chr(31)))"


def _canon(v: str) -> str:
    return f"CASE WHEN regexp_full_match({v}, '16#[0-9A-Fa-f]+') OR regexp_full_match({v}, '[A-Za-z][A-Za-z0-9_-]*') THEN upper({v}) ELSE {v} END"


def _first(x: str) -> str:
    return f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"


def _search(x: str) -> str:
    low = f"replace(lower({x}), 's7 1200', 's7-1200')"
    return f"list_concat(regexp_extract_all({low}, '{L.WORD_TOKEN}'), regexp_extract_all({low}, '{L.TECH_TOKEN}'))"


def _telling(c: str) -> str:
    """Canonical terms of a text without generic ones, as a list."""
    canon = f"list_filter(list_transform(list_transform(regexp_extract_all({c}, '{L.TECHNICAL_TERM}'), lambda t: {_V}), lambda v: {_canon('v')}), lambda v: v <> '')"
    generic = ", ".join(repr(g) for g in L.GENERIC_TERMS)
    return f"list_filter({_first(canon)}, lambda v: v IN ('ID', 'IP', 'DB') OR regexp_full_match(v, '16#[0-9A-F]+') OR NOT (regexp_full_match(v, '[0-9]') OR upper(v) IN ({generic}) OR length(v) < 2))"


_PAIRED = "[\\p{L}\\p{N}_]"
_EDGE = r"[，。！？；：,!?;:()\[\]{}]+"
_V = f"regexp_replace(regexp_replace(t, '^{_EDGE}|{_EDGE}$', '', 'g'), '{L.WS}+', '', 'g')"


def _expansion(c: str) -> str:
    groups = []
    for triggers, terms in L.QUERY_EXPANSION:
        hit = " OR ".join(f"contains(lower({c}), '{t}')" for t in triggers)
        groups.append(f"CASE WHEN {hit} THEN list_filter([{', '.join(repr(t) for t in terms)}], lambda t: NOT contains(lower({c}), lower(t))) ELSE CAST([] AS VARCHAR[]) END")
    marked = " OR ".join(f"contains(lower({c}), '{m}')" for m in L.STATUS_MARKS)
    codes = f"list_transform(list_filter(regexp_extract_all(lower({c}), '[0-9a-f]+'), lambda x: length(x) = 4 AND NOT contains(lower({c}), '16#' || x)), lambda x: '16#' || upper(x))"
    groups.append(f"CASE WHEN {marked} THEN {codes} ELSE CAST([] AS VARCHAR[]) END")
    return f"list_concat({', '.join(groups)})"


_SECRETS = [rx.replace(r"\b(?:LLM_)?API", r"\b(?:LLM_)?API") for rx in L.SECRET_TEXTS]
_REDACTED = "text"
for _rx in _SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_rx}', '[REDACTED]', 'g')"
_GENERIC = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS term, count(DISTINCT chunk_id) AS chunks FROM chunks WHERE " + (f"regexp_matches(text, '(?i)(^|[^A-Za-z0-9_-]){t}([^A-Za-z0-9_-]|$)')" if t.isascii() else f"contains(text, '{t}')") for t in L.GENERIC_TERMS
)

SQL = {
    "text_clean": f"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(text, chr(173), ''), chr(0), ' '), '({_PAIRED})-\\n({_PAIRED})', '\\1\\2', 'g'), '({_PAIRED})-\\n({_PAIRED})', '\\1\\2', 'g') AS t FROM document_pages),
b AS (SELECT page_id, {_strip("regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM a)
SELECT DISTINCT page_id, length(t) AS n, md5(t) AS digest FROM b""",
    "text_tokens": f"""
WITH t AS (SELECT DISTINCT chunk_id, regexp_extract_all(text, '{L.CHUNK_TOKEN}') AS t FROM chunks)
SELECT chunk_id, len(t) AS n, len(list_distinct(t)) AS n_distinct, {_join("t")} AS digest FROM t""",
    "text_search_tokens": f"WITH t AS (SELECT DISTINCT chunk_id, {_search('text')} AS t FROM chunks) SELECT chunk_id, len(t) AS n, {_join('t')} AS digest FROM t",
    "text_embedding_tokens": f"""
WITH t AS (SELECT DISTINCT id, regexp_extract_all(lower(question), '{L.EMBEDDING_TOKEN}') AS t FROM formal_questions),
c AS (SELECT id, t, list_filter(t, lambda x: regexp_full_match(x, '[\\x{{4e00}}-\\x{{9fff}}]')) AS c FROM t)
SELECT id, array_to_string(list_concat(t, list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])), ' ') AS tokens FROM c""",
    "text_technical_terms": f"""
WITH t AS (SELECT DISTINCT id, question, regexp_extract_all(question, '{L.TECHNICAL_TERM}') AS t FROM formal_questions),
c AS (SELECT id, t, list_filter(list_transform(list_transform(t, lambda t: {_V}), lambda v: {_canon("v")}), lambda v: v <> '') AS c FROM t),
u AS (SELECT id, t, {_first("c")} AS c FROM c)
SELECT DISTINCT id, array_to_string(list_sort(list_distinct(list_transform(t, lambda x: lower(x)))), ' ') AS terms, array_to_string(c, ' ') AS canonical,
  array_to_string(list_filter(c, lambda v: v IN ('ID', 'IP', 'DB') OR regexp_full_match(v, '16#[0-9A-F]+') OR NOT (regexp_full_match(v, '[0-9]') OR upper(v) IN ({', '.join(repr(g) for g in L.GENERIC_TERMS)}) OR length(v) < 2)), ' ') AS telling FROM u""",
    "text_similarity_terms": f"""
WITH t AS (SELECT DISTINCT id, lower(problem) AS p FROM verified_solutions),
r AS (SELECT id, p, flatten(list_transform(regexp_extract_all(p, '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))) AS pairs FROM t)
SELECT id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(p, '{L.SIMILARITY_TERM}'), pairs))), ' ') AS terms FROM r""",
    "text_search_terms": f"""
WITH t AS (SELECT DISTINCT id, list_transform(list_concat([{_strip("question")}], regexp_extract_all(question, '{L.SEARCH_TERM}')), lambda x: lower(x)) AS t FROM application_questions)
SELECT id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i AND x <> ''), chr(10)) AS terms FROM t""",
    "text_sentences": f"""
WITH t AS (SELECT DISTINCT chunk_id, regexp_split_to_array(regexp_replace(text, '([{L.SENTENCE_STOPS}])', '\\1' || chr(10), 'g'), '\\n+') AS t FROM chunks),
s AS (SELECT chunk_id, list_filter(list_transform(t, lambda x: {_strip("x")}), lambda x: x <> '') AS s FROM t)
SELECT chunk_id, len(s) AS n, {_join("s")} AS digest FROM s""",
    "text_generic_terms": f"SELECT * FROM ({_GENERIC}) WHERE chunks > 0",
    "text_links": "SELECT DISTINCT chunk_id FROM chunks WHERE regexp_matches(lower(concat_ws(' ', doc_name, source_url, text)), 'http://|https://|www\\.')",
    "text_alarm_codes": f"""
WITH t AS (SELECT DISTINCT id, question AS q FROM conversation_turns),
c AS (SELECT id, coalesce(nullif(regexp_extract(q, '{L.PREFIXED_CODE}', 1), ''), list_filter(regexp_extract_all(q, '[0-9A-Za-z]+'), lambda x: regexp_full_match(x, '[0-9A-Fa-f]{{4}}') AND regexp_matches(x, '[A-Fa-f]'))[1],
  CASE WHEN {" OR ".join(f"contains(lower(q), '{w}')" for w in L.ALARM_WORDS)} THEN list_filter(regexp_extract_all(replace(q, '{L.MODEL_NAME}', ''), '[0-9]+'), lambda x: length(x) = 4)[1] END) AS code FROM t)
SELECT DISTINCT id, replace(replace(replace(upper(code), 'W#', ''), '16#', ''), '0X', '') AS code FROM c WHERE code IS NOT NULL""",
    "text_values": f"""
SELECT DISTINCT id, CAST(v.value AS DOUBLE) AS value, nullif(v.unit, '') AS unit
FROM (SELECT id, regexp_extract(replace(question, 'S7-1200', ''), '{L.VALUE_AND_UNIT}', ['value', 'unit']) AS v FROM conversation_turns) WHERE v.value <> ''""",
    "text_expand": f"""
WITH t AS (SELECT DISTINCT id, question, {_expansion('question')} AS x FROM formal_questions)
SELECT id, {_strip("array_to_string(list_concat([question], " + _first("x") + "), ' ')")} AS expanded FROM t""",
    "text_secrets": f"""
SELECT DISTINCT doc_id, {' + '.join(f"CAST(regexp_matches(text, '{rx}') AS INT)" for rx in _SECRETS)} AS kinds, md5({_REDACTED}) AS digest FROM documents""",
    "text_versions": """
WITH v AS (SELECT DISTINCT chunk_id, regexp_extract(coalesce(version, ''), '([0-9]+(?:\\.[0-9]+)+)', 1) AS v FROM chunks)
SELECT CASE WHEN v = '' THEN '' ELSE 'V' || v END AS version, count(*) AS chunks FROM v GROUP BY 1""",
}
