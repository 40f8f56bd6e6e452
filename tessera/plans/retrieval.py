"""Searches over the dataset's tables. Queries are the rows whose number is divisible by 20, against all rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import facts, lookup, metrics, retrieval
from tessera.operators.references import cleaned_ids, id_list
from tessera.plans.references import LISTED
from tessera.plans.texts import _expansion, _first, _search, _strip, _telling
from tessera.session import scratch_path, shuffle_partitions
from tessera.sources import vectors as stored
from tessera.sources.tables import table, table_once


def _asked(spark: SparkSession, d: str, name: str = "formal_questions") -> DataFrame:
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    return table(spark, d, name).where(number % 20 == 0).withColumnRenamed("id", "query_id")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", "question").distinct().select("query_id", "question", T.search_tokens(F.col("question")).alias("tokens"))


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table_once(spark, d, "chunks", "chunk_id", "text", *columns).withColumnRenamed("chunk_id", "doc_key")


def _index(spark: SparkSession, d: str, vectors: bool = False) -> retrieval.Index:
    """The chunks with their tokens, model and version, and with vectors if asked; one scan for all that use it."""
    more = [retrieval.hashed_vectors(T.embedding_tokens(F.coalesce("text", F.lit(""))), 64, "md5").alias("vector")] if vectors else []
    docs = _docs(spark, d, "model", "version")
    if len(table(spark, d, "chunks").inputFiles()) < shuffle_partitions(spark):
        docs = docs.repartition(shuffle_partitions(spark))  # a few files, so a few tasks, would do all the cutting
    return retrieval.build_index(docs.select("doc_key", T.search_tokens(F.col("text")).alias("tokens"), *more, "model", "version"))


def _plain(index: retrieval.Index) -> retrieval.Index:
    """The index without columns to filter by."""
    return replace(index, docs=index.docs.drop("model", "version"))


def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_search(_queries(spark, d).select("query_id", "tokens"), _plain(_index(spark, d)), 10)


def _asked_of_model(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The queries with the device's model and the manual's version they ask about."""
    return _asked(spark, d).select("query_id", "question", F.col("device_model").alias("model"), F.col("manual_version").alias("version")).distinct()


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """By words among the chunks of the model and version asked for, and those of none."""
    asked = _asked_of_model(spark, d).select("query_id", T.search_tokens(F.col("question")).alias("tokens"), "model", "version")
    return retrieval.bm25_search(asked, _index(spark, d), 10)


def search_dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    """By vector among the chunks of just the model asked for."""
    asked = _vectors(_asked_of_model(spark, d), "question").select("query_id", "vector", "model", F.lit("").alias("version"))
    return retrieval.dense_search(asked, _index(spark, d, True).docs, 10, exact_model=True).withColumn("score", F.round("score", 6))


def search_dense(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    docs = rows.select(F.format_string("%09d", "vec_id").alias("doc_key"), F.col("embedding").alias("vector"))
    return retrieval.dense_search(asked, docs, 10).select("query_id", "doc_key", F.round("score", 6).alias("score"), "rank")


def search_labels(spark: SparkSession, d: str) -> DataFrame:
    """Share of the ten nearest vectors with the query's own label."""
    rows = table(spark, d, "embeddings").select(F.format_string("%09d", "vec_id").alias("doc_key"), "label")
    hits = search_dense(spark, d).where(F.col("query_id").cast("long") != F.col("doc_key").cast("long"))
    own = rows.select(F.col("doc_key").cast("long").cast("string").alias("query_id"), F.col("label").alias("own"))
    joined = hits.join(rows, "doc_key").join(own, "query_id")
    return joined.groupBy(F.col("own").alias("label")).agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("label") == F.col("own")).alias("same"))


def _vectors(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("vector", retrieval.hashed_vectors(T.embedding_tokens(F.coalesce(text, F.lit(""))), 64, "md5"))


def _expanded_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", "question", T.search_tokens(T.expanded_query(F.col("question"))).alias("tokens"))


def _lists(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The rank lists of a hybrid search: candidates of the query as asked, fused, then reranked by the expanded query."""
    queries, index = _queries(spark, d), _plain(_index(spark, d, True))
    return retrieval.hybrid_search(_vectors(queries, "question"), index, _expanded_tokens(spark, d))


def search_fused(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d)["rrf_topk"].drop("rerank_score")


def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Fused candidates of the query as asked, reranked by the expanded query."""
    return _lists(spark, d)["final_evidence"].select("query_id", "doc_key", "score", "rerank_score", "rank")


def search_trace(spark: SparkSession, d: str) -> DataFrame:
    """All four lists of a hybrid search with the chunks' names and places."""
    return retrieval.trace_hits(_lists(spark, d), _docs(spark, d, "doc_name", "page", "section_path"))


def search_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Each query by the strategy that its expected tool stands for: words, vectors or both."""
    tool = F.col("expected_tool")
    strategy = F.when(tool == "lookup_alarm_code", "bm25").when(tool == "check_parameter_range", "dense").otherwise("hybrid")
    asked = _asked(spark, d).select("query_id", "question", strategy.alias("strategy")).distinct()
    asked = _vectors(asked.withColumn("tokens", T.search_tokens(F.col("question"))), "question")
    return retrieval.search_with_strategy(asked, _plain(_index(spark, d, True)), _expanded_tokens(spark, d))


def search_model_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Fused candidates ordered by a model's score, here the nearness of the text's length to twelve times the query's."""

    def model(queries: list[str], texts: list[str]) -> list[float]:
        return [-abs(len(t) - 12.0 * len(q)) for q, t in zip(queries, texts)]

    return retrieval.model_rerank(search_fused(spark, d), _queries(spark, d), _docs(spark, d), model, 5).select("query_id", "doc_key", "rerank_score", "rank")


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of search by words: as asked, and as a retry asks."""
    index, asked = _plain(_index(spark, d)), _asked_of_model(spark, d)
    first = retrieval.bm25_search(asked.select("query_id", T.search_tokens(F.col("question")).alias("tokens")), index, 5)
    again = T.retry_query(F.col("question"), F.col("model"), F.col("version"), T.telling_terms(T.find_all(F.col("question"), L.TECHNICAL_TERM)))
    second = retrieval.bm25_search(asked.select("query_id", T.search_tokens(again).alias("tokens")), index, 5)
    return first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))


def search_merged(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.merge_rounds(_rounds(spark, d)).select("query_id", "doc_key", "round", "score", "rank")


def search_rounds(spark: SparkSession, d: str) -> DataFrame:
    """What a second round changes: means of the ranking metrics of each and of both merged."""
    rounds, gold = _rounds(spark, d), _gold(spark, d)
    lists = {"first": rounds.where("round = 1"), "second": rounds.where("round = 2"), "merged": retrieval.merge_rounds(rounds)}
    return metrics.compared_rounds({k: metrics.ranking_rows(v, gold) for k, v in lists.items()})


def search_verified(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that the most similar verified solution names, then the hits by words, five in all."""
    name = "application_questions"
    asked = _asked(spark, d, name).select("query_id", F.coalesce("model", F.lit("")).alias("model"), "question").distinct()
    solutions = table(spark, d, "verified_solutions")
    found = retrieval.similar_solutions(asked, solutions)
    ids = solutions.select(F.col("id").alias("solution_id"), cleaned_ids(id_list(F.col("source_chunk_ids"))).alias("ids")).distinct()
    index = _plain(_index(spark, d))
    verified = lookup.by_ids(found.join(ids, "solution_id").select("query_id", "ids"), index.docs.select(F.col("doc_key").alias("chunk_id"))).select("query_id", F.col("chunk_id").alias("doc_key"), "place")
    hits = retrieval.bm25_search(asked.select("query_id", T.search_tokens(F.col("question")).alias("tokens")), index, 5)
    return retrieval.verified_first(verified, hits, 5)


def search_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first five hits hold enough of the identifiers that a query names."""
    hits = search_bm25(spark, d).where("rank <= 5").join(_docs(spark, d), "doc_key").select("query_id", "text")
    return retrieval.evidence_supports(_queries(spark, d).select("query_id", "question"), hits)


def search_expected(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first five hits have any of the words of a query's required facts in name or text, and the first rank."""
    hits = search_bm25(spark, d).join(_docs(spark, d, "doc_name"), "doc_key").select("query_id", "rank", F.col("doc_name").alias("name"), "text")
    terms = _asked(spark, d).select("query_id", F.flatten(F.transform("required_facts", lambda x: F.split(x, " "))).alias("terms")).where(F.size("terms") > 0).distinct()
    return facts.expected_terms(hits, terms)


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The vector index, written and read again: each point's payload and the sum of its vector's squares by half."""
    path = scratch_path(spark, "index")
    docs = _vectors(_docs(spark, d, "doc_name", "model", "version", "page"), "text")
    stored.write_index(docs.drop("text"), path)
    half = lambda a, b: F.round(F.aggregate(F.slice("vector", a, b), F.lit(0.0), lambda s, x: s + x * x), 6)
    return stored.read_index(spark, path).select("doc_key", "doc_name", "model", "version", "page", half(1, 32).alias("first_half"), half(33, 32).alias("second_half"))


def index_state(spark: SparkSession, d: str) -> DataFrame:
    """What would be done with an index that is whole, one that lacks removed chunks, an empty and a missing one."""
    docs = _docs(spark, d).select("doc_key")
    removed = table(spark, d, "removed_chunks").select(F.col("chunk_id").alias("doc_key"))
    cases = {"whole": docs, "short": docs.join(removed, "doc_key", "left_anti"), "empty": docs.limit(0)}
    paths = {k: scratch_path(spark, "index") for k in (*cases, "missing")}
    for k, df in cases.items():
        stored.write_index(df, paths[k])
    rows = [(k, forced, *stored.index_action(spark, docs, paths[k], forced)) for k in paths for forced in (False, True)]
    return spark.createDataFrame(rows, "name string, forced boolean, chunks long, points long, action string")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    rows = _asked(spark, d).select("query_id", "category", F.explode("gold_chunk_ids").alias("doc_key")).where("doc_key is not null")
    return rows.distinct()


def search_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Ranking metrics of BM25 against the gold chunks, by category and over all."""
    gold = _gold(spark, d)
    rows = metrics.ranking_rows(search_bm25(spark, d), gold)
    return metrics.ranking_summary(rows.join(gold.select("query_id", "category").distinct(), "query_id"), "category")


def search_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why questions miss: counts by category and reason."""
    gold, hits = _gold(spark, d), search_bm25(spark, d)
    names = gold.select("query_id", "category").distinct()
    rows = metrics.ranking_rows(hits, gold).join(names, "query_id")
    first = hits.where("rank = 1").select("query_id", T.chunk_family(F.col("doc_key")).alias("family"))
    close = first.join(gold.select("query_id", T.chunk_family(F.col("doc_key")).alias("other")), "query_id").groupBy("query_id").agg(F.bool_or(F.col("family") == F.col("other")).alias("close"))
    return metrics.failure_reasons(rows, close).join(names, "query_id").groupBy("category", "reason").agg(F.count(F.lit(1)).alias("questions"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first five hits of each query by words, with all that answers and citations need of them."""
    texts = _docs(spark, d, "doc_name", "page", "section_path", "metadata").withColumn("representation", F.col("metadata.representation")).drop("metadata")
    return search_bm25(spark, d).where("rank <= 5").join(texts, "doc_key").join(_queries(spark, d).select("query_id", "question"), "query_id")


def search_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The two sentences of the first five hits that answer each query best."""
    return retrieval.best_sentences(_evidence(spark, d))


def search_solutions(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d, "application_questions").select("query_id", F.coalesce("model", F.lit("")).alias("model"), "question").distinct()
    return retrieval.similar_solutions(asked, table(spark, d, "verified_solutions"))


def search_stale(spark: SparkSession, d: str) -> DataFrame:
    """An index of the chunks of before half-time against the chunks and removals since."""
    chunks, removed = table(spark, d, "chunks"), table(spark, d, "removed_chunks")
    index = chunks.where("ingested_at < timestamp_ntz'2025-01-01'").select(F.col("chunk_id").alias("doc_key")).unionByName(removed.select(F.col("chunk_id").alias("doc_key")))
    return retrieval.stale_keys(index, chunks.select(F.col("chunk_id").alias("doc_key")))


QUERIES = {
    f.__name__: f
    for f in (
        search_bm25, search_filtered, search_dense, search_dense_filtered, search_labels, search_fused, search_hybrid, search_trace, search_strategies, search_model_rerank, search_merged, search_rounds, search_verified,
        search_evidence, search_expected, search_metrics, search_reasons, search_sentences, search_solutions, search_stale, index_build, index_state,
    )
}

_TWENTIETH = "CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 20 = 0"
_Q = f"q AS (SELECT DISTINCT id AS query_id, question, {_search('question')} AS tokens FROM formal_questions WHERE {_TWENTIETH})"
_Q_MODEL = f"q AS (SELECT DISTINCT id AS query_id, question, device_model AS model, manual_version AS version, {_search('question')} AS tokens FROM formal_questions WHERE {_TWENTIETH})"
_DOCS = f"""docs AS (SELECT chunk_id AS doc_key, any_value(text) AS text, {_search("any_value(text)")} AS tokens, any_value(doc_name) AS doc_name, any_value(page) AS page, any_value(section_path) AS section_path,
  any_value(model) AS model, any_value(version) AS version, any_value(metadata.representation) AS representation FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
size AS (SELECT doc_key, len(tokens) AS length FROM docs),
posting AS (SELECT doc_key, term, count(*) AS tf FROM (SELECT doc_key, unnest(tokens) AS term FROM docs) GROUP BY 1, 2),
stat AS (SELECT count(*) AS n, avg(length) AS avgdl FROM size),
idf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM posting, stat GROUP BY term, n),
low AS (SELECT 0.25 * avg(idf) AS low FROM idf)"""


def _ranked(q: str = "q", to: str = "bm", n: int = 30, agree: str = "true") -> str:
    """The best documents by words of the queries in ``q``, and the first document for queries that go empty."""
    return f"""
{to}_asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(tokens) AS term FROM {q}) GROUP BY 1, 2),
{to}_w AS (SELECT query_id, term, times * CASE WHEN idf < 0 THEN low ELSE idf END AS w FROM {to}_asked JOIN idf USING (term), low),
{to}_score AS (SELECT query_id, doc_key, round(sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 9) AS score FROM {to}_w JOIN posting USING (term) JOIN size USING (doc_key), stat GROUP BY 1, 2),
{to}_kept AS (SELECT s.* FROM {to}_score s JOIN {q} q USING (query_id) JOIN docs d USING (doc_key) WHERE {agree}),
{to}_best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM {to}_kept WHERE score > 0),
{to} AS (SELECT query_id, doc_key, score, rank FROM {to}_best WHERE rank <= {n} UNION ALL
  SELECT q.query_id, min(d.doc_key), 0.0, 1 FROM {q} q JOIN docs d ON {agree} WHERE q.query_id NOT IN (SELECT query_id FROM {to}_best) GROUP BY 1)"""


_AGREE = " AND ".join(f"(coalesce(q.{c}, '') = '' OR coalesce(d.{c}, '') = '' OR lower(q.{c}) = lower(d.{c}))" for c in ("model", "version"))
_BASE = f"{_Q},\n{_DOCS},{_ranked()}"


def _places(source: str, key: str, text: str) -> str:
    """Vector parts by place, not yet of length one."""
    return f"""(SELECT {key}, h % 64 AS i, sum(CASE WHEN h % 2 = 1 THEN 1.0 ELSE -1.0 END * (1 + ln(1 + length(t)))) AS v
  FROM (SELECT {key}, t, CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) AS h FROM (SELECT {key}, unnest(list_concat(tok, list_transform(range(1, len(zh)), lambda i: zh[i] || zh[i + 1]))) AS t
    FROM (SELECT {key}, tok, list_filter(tok, lambda x: regexp_full_match(x, '[\\x{{4e00}}-\\x{{9fff}}]')) AS zh FROM (SELECT {key}, regexp_extract_all(lower({text}), '{L.EMBEDDING_TOKEN}') AS tok FROM {source})))) GROUP BY 1, 2)"""


_FUSED = (
    _BASE
    + f""",
qv AS (SELECT query_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY query_id)) AS v FROM {_places('q', 'query_id', 'question')}),
dv AS (SELECT doc_key, i, v / sqrt(sum(v * v) OVER (PARTITION BY doc_key)) AS v FROM {_places('docs', 'doc_key', 'text')}),
pairs AS (SELECT query_id, doc_key FROM (SELECT query_id FROM q), (SELECT doc_key FROM docs)),
dots AS (SELECT query_id, doc_key, sum(qv.v * dv.v) AS s FROM qv JOIN dv USING (i) GROUP BY 1, 2),
cos AS (SELECT query_id, doc_key, round(coalesce(s, 0.0), 9) AS s FROM pairs LEFT JOIN dots USING (query_id, doc_key)),
dense AS (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_key) AS rank FROM cos QUALIFY rank <= 30),
united AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.doc_key, b.doc_key) AS doc_key, d.rank AS dense_rank, b.rank AS bm25_rank,
  round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 12) AS score, coalesce(d.rank, 1000000 + b.rank) AS seen
  FROM dense d FULL JOIN bm b ON d.query_id = b.query_id AND d.doc_key = b.doc_key),
fused AS (SELECT query_id, doc_key, score, dense_rank, bm25_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM united QUALIFY rank <= 20)"""
)


def _expanded() -> str:
    return f"(SELECT query_id, {_search(_strip('array_to_string(list_concat([question], ' + _first('x') + '), chr(32))'))} AS tokens FROM (SELECT query_id, question, {_expansion('question')} AS x FROM q))"


_GOLD_OF = f"gold AS (SELECT DISTINCT id AS query_id, category, unnest(gold_chunk_ids) AS doc_key FROM formal_questions WHERE {_TWENTIETH})"


def _measured(hits: str, to: str = "m") -> str:
    """Ranking metrics of the queries in ``gold`` by the hits in ``hits``."""
    return f"""
{to}_hit AS (SELECT g.query_id, g.category, g.doc_key, b.rank FROM gold g LEFT JOIN (SELECT * FROM {hits} WHERE rank <= 5) b USING (query_id, doc_key) WHERE g.doc_key IS NOT NULL),
{to}_row AS (SELECT query_id, category, count(*) AS gold, count(rank) AS found, min(rank) AS first_rank, coalesce(sum(1 / log2(rank + 1.0)), 0) AS dcg FROM {to}_hit GROUP BY 1, 2),
{to} AS (SELECT *, CAST(found = gold AS INT) AS strict_recall, found / gold AS recall, CAST(found > 0 AS INT) AS hit, coalesce(1.0 / first_rank, 0) AS mrr,
  round(dcg / list_sum(list_transform(range(1, least(5, gold) + 1), lambda i: 1 / log2(i + 1.0))), 9) AS ndcg, coalesce(CAST(first_rank = 1 AS INT), 0) AS top1 FROM {to}_row)"""


_GOLD = f",\n{_GOLD_OF},{_measured('bm')}"
_RERANKED = f""", e AS {_expanded()},
s AS (SELECT f.query_id, f.doc_key, f.score, f.dense_rank, f.bm25_rank, f.rank AS was, round(0.7 * f.score + 0.3 * len(list_intersect(list_distinct(e.tokens), list_distinct(d.tokens))) / greatest(1, len(list_distinct(e.tokens))), 9) AS rerank_score
  FROM fused f JOIN e USING (query_id) JOIN docs d USING (doc_key)),
final AS (SELECT query_id, doc_key, score, dense_rank, bm25_rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, was) AS rank FROM s QUALIFY rank <= 5)"""
_CUT = "regexp_split_to_array(regexp_replace(text, '([。！？.!?])', '\\1' || chr(10), 'g'), '\\n+')"
_AGAIN = f"""again AS (SELECT query_id, {_search("array_to_string(" + _first("list_filter(list_transform(list_concat([regexp_replace(question, '" + L.QUERY_FILLERS + "', ' ', 'g'), coalesce(model, ''), coalesce(version, '')], " + "telling, ['" + "', '".join(L.RETRY_WORDS) + "']), lambda x: " + _strip("x") + "), lambda x: x <> '')") + ", ' ')")} AS tokens
  FROM (SELECT *, {_telling("question")} AS telling FROM q))"""
_ROUNDS = f"""{_Q_MODEL},
{_DOCS},{_ranked(n=5)},
{_AGAIN},{_ranked("again", "second", 5)},
rounds AS (SELECT *, 1 AS round FROM bm UNION ALL SELECT *, 2 FROM second),
better AS (SELECT * FROM rounds QUALIFY row_number() OVER (PARTITION BY query_id, doc_key ORDER BY score DESC, round, rank) = 1),
placed AS (SELECT query_id, doc_key, round, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round, rank) AS place FROM better),
merged AS (SELECT query_id, doc_key, round, score, place AS rank FROM placed WHERE place <= 5)"""

_BEST = f"""
e AS (SELECT query_id, {_strip("array_to_string(list_concat([question], " + _first("x") + "), ' ')")} AS e FROM (SELECT query_id, question, {_expansion('question')} AS x FROM q)),
t AS (SELECT query_id, list_distinct(regexp_extract_all(lower(e), '{L.CHUNK_TOKEN}')) AS q, list_filter(list_distinct(list_transform(regexp_extract_all(e, '{L.TECHNICAL_TERM}'), lambda x: lower(x))), lambda x: x NOT IN ('1200', '1500')) AS x FROM e),
h AS (SELECT query_id, rank, doc_key, CASE WHEN lower(coalesce(doc_name, '')) LIKE 'project~_%' ESCAPE '~' THEN 0 ELSE 0.05 END AS worth, CASE WHEN representation = 'table_row' THEN [regexp_replace(text, '{L.WS}+', ' ', 'g')] ELSE {_CUT} END AS cut FROM bm JOIN docs USING (doc_key) WHERE rank <= 5),
l AS (SELECT query_id, rank, doc_key, worth, unnest(range(0, len(cut))) AS no, unnest(list_transform(cut, lambda s: {_strip('s')})) AS sentence FROM h),
c AS (SELECT l.*, round(len(list_intersect(q, list_distinct(regexp_extract_all(lower(sentence), '{L.CHUNK_TOKEN}')))) / greatest(1, len(q)) + len(list_intersect(x, list_distinct(list_transform(regexp_extract_all(sentence, '{L.TECHNICAL_TERM}'), lambda y: lower(y))))) / greatest(1, len(x)) + worth, 9) AS score,
  regexp_replace(lower(sentence), '{L.WS}+', '', 'g') AS mark FROM l JOIN t USING (query_id) WHERE length(sentence) >= 18 AND NOT contains(sentence, ' > ')),
f AS (SELECT *, rank = 1 AND row_number() OVER (PARTITION BY query_id ORDER BY rank <> 1, score DESC, rank, no) = 1 AS first FROM c),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, mark ORDER BY first DESC, score DESC, rank, no) = 1),
best AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, score DESC, rank, no) AS place, rank, doc_key, sentence FROM o)"""

_SOLVED = f"""
q AS (SELECT DISTINCT id AS query_id, coalesce(model, '') AS model, lower(question) AS p FROM application_questions WHERE CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 20 = 0),
terms AS (SELECT *, list_distinct(list_concat(regexp_extract_all(coalesce(p, ''), '{L.SIMILARITY_TERM}'), flatten(list_transform(regexp_extract_all(coalesce(p, ''), '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))) AS t FROM q),
s AS (SELECT DISTINCT id, coalesce(model, '') AS own, lower(coalesce(problem, '')) AS p FROM verified_solutions WHERE verified = 1),
st AS (SELECT *, list_distinct(list_concat(regexp_extract_all(p, '{L.SIMILARITY_TERM}'), flatten(list_transform(regexp_extract_all(p, '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))) AS t FROM s),
pool AS (SELECT m.model, st.id, st.t FROM (SELECT DISTINCT model FROM q) m JOIN st ON st.own = m.model OR st.own = '' QUALIFY row_number() OVER (PARTITION BY m.model ORDER BY st.id DESC) <= 50),
pair AS (SELECT q.query_id, x.id, len(list_intersect(q.t, x.t)) AS b, round(len(list_intersect(q.t, x.t)) / greatest(1.0, sqrt(CAST(len(q.t) AS DOUBLE) * len(x.t))), 9) AS s FROM terms q JOIN pool x USING (model)),
good AS (SELECT * FROM pair WHERE b >= 2 AND s >= 0.18 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id DESC) = 1)"""

SQL = {
    "search_bm25": f"WITH {_BASE} SELECT * FROM bm WHERE rank <= 10",
    "search_dense": """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, printf('%09d', d.vec_id) AS doc_key, round(list_dot_product(q.e, d.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(d.e, d.e)), 9) AS s FROM v q, v d WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, doc_key, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_key) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""",
    "search_labels": """
WITH v AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS a, d.vec_id AS b, q.label AS x, d.label AS y, round(list_dot_product(q.e, d.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(d.e, d.e)), 9) AS s FROM v q, v d WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, printf('%09d', b)) AS rank FROM s)
SELECT x AS label, count(*) AS hits, count_if(x = y) AS same FROM r WHERE rank <= 10 AND a <> b GROUP BY 1""",
    "search_fused": f"WITH {_FUSED} SELECT * FROM fused",
    "search_hybrid": f"WITH {_FUSED}{_RERANKED} SELECT query_id, doc_key, score, rerank_score, rank FROM final",
    "search_trace": f"""WITH {_FUSED}{_RERANKED},
lists AS (SELECT 'dense_topk' AS stage, query_id, rank, doc_key, s AS score, rank AS dense_rank, NULL AS bm25_rank, NULL AS rerank_score FROM (SELECT query_id, doc_key, rank, s FROM dense JOIN cos USING (query_id, doc_key)) UNION ALL
  SELECT 'bm25_topk', query_id, rank, doc_key, score, NULL, rank, NULL FROM bm UNION ALL SELECT 'rrf_topk', query_id, rank, doc_key, score, dense_rank, bm25_rank, NULL FROM fused UNION ALL
  SELECT 'final_evidence', query_id, rank, doc_key, score, dense_rank, bm25_rank, rerank_score FROM final)
SELECT stage, query_id, rank, doc_key, CAST(CAST(CAST(score AS VARCHAR) AS DECIMAL(24, 12)) AS DECIMAL(24, 8))::DOUBLE AS score, dense_rank, bm25_rank, CAST(CAST(CAST(rerank_score AS VARCHAR) AS DECIMAL(24, 12)) AS DECIMAL(24, 8))::DOUBLE AS rerank_score, doc_name, page, section_path FROM lists JOIN docs USING (doc_key)""",
    "search_strategies": f"""WITH {_FUSED}{_RERANKED},
way AS (SELECT DISTINCT id AS query_id, CASE expected_tool WHEN 'lookup_alarm_code' THEN 'bm25' WHEN 'check_parameter_range' THEN 'dense' ELSE 'hybrid' END AS strategy FROM formal_questions WHERE {_TWENTIETH})
SELECT query_id, strategy, doc_key, score, rank FROM way JOIN bm USING (query_id) WHERE strategy = 'bm25' AND rank <= 5 UNION ALL
SELECT query_id, strategy, doc_key, s, rank FROM way JOIN dense USING (query_id) JOIN cos USING (query_id, doc_key) WHERE strategy = 'dense' AND rank <= 5 UNION ALL
SELECT query_id, strategy, doc_key, rerank_score, rank FROM way JOIN final USING (query_id) WHERE strategy = 'hybrid'""",
    "search_model_rerank": f"""WITH {_FUSED},
s AS (SELECT query_id, doc_key, -abs(length(coalesce(d.text, '')) - 12.0 * length(q.question)) AS rerank_score, f.rank AS was FROM fused f JOIN q USING (query_id) JOIN docs d USING (doc_key))
SELECT query_id, doc_key, CAST(rerank_score AS DOUBLE) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, was) AS rank FROM s QUALIFY rank <= 5""",
    "search_filtered": f"WITH {_Q_MODEL},\n{_DOCS},{_ranked(n=10, agree=_AGREE)} SELECT * FROM bm",
    "search_dense_filtered": f"""WITH {_Q_MODEL},
{_DOCS},
qv AS (SELECT query_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY query_id)) AS v FROM {_places('q', 'query_id', 'question')}),
dv AS (SELECT doc_key, i, v / sqrt(sum(v * v) OVER (PARTITION BY doc_key)) AS v FROM {_places('docs', 'doc_key', "coalesce(text, '')")}),
pairs AS (SELECT query_id, doc_key FROM q JOIN docs d ON coalesce(q.model, '') = '' OR q.model = d.model),
dots AS (SELECT query_id, doc_key, sum(qv.v * dv.v) AS s FROM qv JOIN dv USING (i) GROUP BY 1, 2),
cos AS (SELECT query_id, doc_key, round(coalesce(s, 0.0), 9) AS s FROM pairs LEFT JOIN dots USING (query_id, doc_key))
SELECT query_id, doc_key, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_key) AS rank FROM cos QUALIFY rank <= 10""",
    "search_merged": f"WITH {_ROUNDS} SELECT * FROM merged",
    "search_rounds": f"""WITH {_ROUNDS},
{_GOLD_OF},{_measured('bm', 'm1')},{_measured('second', 'm2')},{_measured('merged', 'm3')},
every AS (SELECT 'first' AS list, * FROM m1 UNION ALL SELECT 'second', * FROM m2 UNION ALL SELECT 'merged', * FROM m3)
SELECT e.list, count(*) AS queries, round(avg(e.strict_recall), 6) AS strict_recall, round(avg(e.mrr), 6) AS mrr, round(avg(e.ndcg), 6) AS ndcg, round(avg(e.top1), 6) AS top1,
  count_if(e.strict_recall > m1.strict_recall) AS gained, count_if(e.strict_recall < m1.strict_recall) AS lost FROM every e JOIN m1 USING (query_id) GROUP BY 1""",
    "search_evidence": f"""WITH {_BASE},
named AS (SELECT query_id, list_filter(list_distinct(list_transform(regexp_extract_all(question, '{L.TECHNICAL_TERM}'), lambda x: lower(x))), lambda x: x NOT IN ('1200', '1500')) AS q FROM q),
has AS (SELECT query_id, list_distinct(flatten(list(list_transform(regexp_extract_all(coalesce(text, ''), '{L.TECHNICAL_TERM}'), lambda x: lower(x))))) AS t FROM bm JOIN docs USING (doc_key) WHERE rank <= 5 GROUP BY 1)
SELECT query_id, len(q) AS identifiers, coalesce(len(list_intersect(q, t)), 0) AS supported, t IS NOT NULL AND (len(q) = 0 OR len(list_intersect(q, t)) / len(q) >= 0.75) AS sufficient FROM named LEFT JOIN has USING (query_id)""",
    "search_expected": f"""WITH {_BASE},
terms AS (SELECT DISTINCT id AS query_id, flatten(list_transform(required_facts, lambda x: string_split(x, ' '))) AS t FROM formal_questions WHERE {_TWENTIETH}),
r AS (SELECT query_id, min(rank) AS first FROM terms JOIN bm USING (query_id) JOIN docs USING (doc_key) WHERE rank <= 5 AND len(list_filter(t, lambda x: contains(lower(coalesce(doc_name, '') || ' ' || coalesce(text, '')), lower(x)))) > 0 GROUP BY 1)
SELECT query_id, CAST(first IS NOT NULL AS INT) AS hit, coalesce(1.0 / first, 0.0) AS mrr FROM terms LEFT JOIN r USING (query_id) WHERE len(t) > 0""",
    "search_sentences": f"WITH {_BASE},{_BEST} SELECT query_id, place, rank, doc_key, sentence FROM best WHERE place <= 2",
    "search_metrics": f"""WITH {_BASE}{_GOLD}
SELECT category, count(*) AS queries, round(avg(strict_recall), 6) AS strict_recall, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(top1), 6) AS top1,
  count_if(strict_recall < 1) AS missing, count_if(strict_recall = 1 AND top1 = 0) AS late FROM m GROUP BY ROLLUP (category)""",
    "search_reasons": f"""WITH {_BASE}{_GOLD},
close AS (SELECT b.query_id, bool_or(regexp_replace(b.doc_key, '_[^_]*_[^_]*$', '') = regexp_replace(g.doc_key, '_[^_]*_[^_]*$', '')) AS close FROM bm b JOIN gold g USING (query_id) WHERE b.rank = 1 AND g.doc_key IS NOT NULL GROUP BY 1)
SELECT category, CASE WHEN strict_recall < 1 AND category = 'cross_section_procedure' AND gold > 1 THEN 'query_too_broad' WHEN strict_recall < 1 THEN 'retrieval_miss'
  WHEN category = 'cross_section_procedure' OR gold > 1 THEN 'query_too_broad' WHEN coalesce(close, false) THEN 'chunk_text_too_similar' ELSE 'ranking_late' END AS reason, count(*) AS questions
FROM m LEFT JOIN close USING (query_id) WHERE strict_recall < 1 OR top1 = 0 GROUP BY 1, 2""",
    "search_solutions": f"WITH {_SOLVED} SELECT query_id, id AS solution_id, round(s, 4) AS similarity FROM good",
    "search_verified": f"""WITH {_SOLVED},
{_Q.replace('q AS', 'aq AS', 1).replace('formal_questions', 'application_questions')},
{_DOCS},{_ranked('aq', 'bm', 5)},
ids AS (SELECT id, {LISTED} AS ids FROM verified_solutions GROUP BY id, source_chunk_ids),
named AS (SELECT query_id, chunk_id, min(place) AS place FROM (SELECT query_id, unnest(ids) AS chunk_id, unnest(range(0, len(ids))) AS place FROM good JOIN ids USING (id)) WHERE chunk_id IN (SELECT doc_key FROM docs) GROUP BY 1, 2),
joined AS (SELECT query_id, chunk_id AS doc_key, 0 AS list, place FROM named UNION ALL SELECT query_id, doc_key, 1, rank FROM bm),
firsts AS (SELECT query_id, doc_key, min((list, place)) AS first FROM joined GROUP BY 1, 2)
SELECT query_id, doc_key, first[1] = 0 AS verified, row_number() OVER (PARTITION BY query_id ORDER BY first, doc_key) AS rank FROM firsts QUALIFY rank <= 5""",
    "index_build": f"""WITH {_DOCS},
dv AS (SELECT doc_key, i, v / sqrt(sum(v * v) OVER (PARTITION BY doc_key)) AS v FROM {_places('docs', 'doc_key', "coalesce(text, '')")}),
h AS (SELECT doc_key, sum(CASE WHEN i < 32 THEN v * v ELSE 0 END) AS a, sum(CASE WHEN i >= 32 THEN v * v ELSE 0 END) AS b FROM dv GROUP BY 1)
SELECT doc_key, doc_name, model, version, page, round(coalesce(a, 0), 6) AS first_half, round(coalesce(b, 0), 6) AS second_half FROM docs LEFT JOIN h USING (doc_key)""",
    "index_state": """WITH c AS (SELECT count(DISTINCT chunk_id) AS n, count(DISTINCT CASE WHEN chunk_id NOT IN (SELECT chunk_id FROM removed_chunks WHERE chunk_id IS NOT NULL) THEN chunk_id END) AS short FROM chunks),
p AS (SELECT 'whole' AS name, n AS chunks, n AS points FROM c UNION ALL SELECT 'short', n, short FROM c UNION ALL SELECT 'empty', n, 0 FROM c UNION ALL SELECT 'missing', n, 0 FROM c)
SELECT name, forced, chunks, points, CASE WHEN forced THEN 'build' WHEN chunks = points THEN 'skip' WHEN points > 0 THEN 'refuse' ELSE 'build' END AS action FROM p, (SELECT unnest([false, true]) AS forced)""",
    "search_stale": """
WITH i AS (SELECT chunk_id FROM chunks WHERE ingested_at < TIMESTAMP '2025-01-01' UNION SELECT chunk_id FROM removed_chunks)
SELECT chunk_id AS doc_key, 'stale' AS state FROM i WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks) UNION ALL
SELECT DISTINCT chunk_id, 'absent' FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM i)""",
}
