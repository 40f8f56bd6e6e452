"""Rules, readiness and means of the evaluation sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import evaluation, facts, metrics, retrieval
from tessera.operators.references import cleaned_ids, id_list
from tessera.plans.corpus import _CODE, _MARKED, _RULES, _TURNS
from tessera.plans.references import LISTED
from tessera.plans.retrieval import _DOCS, _SOLVED, _TWENTIETH, _asked, _docs, _index, _measured, _plain, _ranked
from tessera.plans.texts import _search, _strip
from tessera.sources.tables import table


def check_formal(spark: SparkSession, d: str) -> DataFrame:
    """How many formal questions break each rule."""
    found = evaluation.formal_faults(table(spark, d, "formal_questions"), table(spark, d, "chunks"))
    return found.groupBy("rule").agg(F.count_distinct("id").alias("questions"))


def check_application(spark: SparkSession, d: str) -> DataFrame:
    """How many application questions break each rule."""
    found = evaluation.application_faults(table(spark, d, "application_questions").withColumn("added_at", F.lit(None).cast("timestamp_ntz")))
    return found.groupBy("rule").agg(F.count_distinct("id").alias("questions"))


def check_ready(spark: SparkSession, d: str) -> DataFrame:
    """Whether each set may be used, and the gates that say so."""
    formal, application = table(spark, d, "formal_questions"), table(spark, d, "application_questions").drop("added_at")
    one = evaluation.readiness(formal, evaluation.formal_faults(formal, table(spark, d, "chunks")), splits={"test": ("test", 1), "regression": ("regression", 0)}).withColumn("src_table", F.lit("formal_questions"))
    two = evaluation.readiness(application, evaluation.application_faults(application), splits={"test": ("test", 0), "regression": ("regression", 20)}, reviewed="independent_reviewed").withColumn("src_table", F.lit("application_questions"))
    return one.unionByName(two)


def check_eligible(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.eligible(table(spark, d, "formal_questions")).select("id", F.size("gold_chunk_ids").alias("gold"), "fault")


def _gold_of(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", F.explode("gold_chunk_ids").alias("doc_key")).where("doc_key is not null").distinct()


def _run(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queries of a set, their first five hits by words with texts, and their ranking metrics."""
    asked = _asked(spark, d, name)
    hits = retrieval.bm25_search(asked.select("query_id", "question").distinct().select("query_id", T.search_tokens(F.col("question")).alias("tokens")), _plain(_index(spark, d)), 5)
    texts = hits.join(_docs(spark, d), "doc_key").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))).alias("h"))
    return asked, texts.select("query_id", F.array_join(F.transform("h", lambda x: x["text"]), "\n").alias("answer")), metrics.ranking_rows(hits, _gold_of(asked))


def eval_formal(spark: SparkSession, d: str) -> DataFrame:
    """Means of a run over formal questions in which the five hits are the answer. Times are the lengths of question and answer."""
    asked, texts, ranked = _run(spark, d, "formal_questions")
    rows = asked.select("query_id", "question", "category", "answerable", "review_status", "split", "required_facts", "forbidden_facts").distinct().join(texts, "query_id").join(ranked.select("query_id", "strict_recall", "mrr", "ndcg", "top1"), "query_id", "left")
    answer, required = F.coalesce("answer", F.lit("")), F.coalesce("required_facts", F.array().cast("array<string>"))
    exact = F.size(facts.facts_met(answer, required))
    kinds = F.transform(F.coalesce("forbidden_facts", F.array().cast("array<string>")), lambda f: facts.forbidden_mentions(answer, f))
    reviewed = F.col("review_status") == "reviewed"
    zero = lambda c: F.when(F.col("answerable"), F.coalesce(c, F.lit(0))).otherwise(F.col(c)).alias(c)
    details = rows.select(
        "category", "answerable", *map(zero, ("strict_recall", "mrr", "ndcg", "top1")), F.size(required).alias("claims"), (F.size(required) - exact).alias("unsupported"), (exact > 0).alias("citation_valid"), F.size(required).alias("required"),
        exact.alias("required_exact"), exact.alias("required_diagnosed"), F.size(F.filter(kinds, lambda k: k == "violation")).alias("forbidden_violations"), F.size(F.filter(kinds, lambda k: k == "negated")).alias("forbidden_negated"), reviewed.alias("refused"),
        (F.col("split") == "test").alias("fallback"), reviewed.alias("fallback_success"), F.length("question").alias("retrieval_ms"), F.when(reviewed, F.length("question")).otherwise(0).alias("llm_ms"), F.length(answer).alias("total_ms"),
    )
    return evaluation.formal_metrics(details)


def _application_details(spark: SparkSession, d: str) -> DataFrame:
    asked, texts, ranked = _run(spark, d, "application_questions")
    rows = asked.select("query_id", "question", "answerable", "expected_tool", "review_status", "required_fact_groups").distinct().join(texts, "query_id").join(ranked.select("query_id", "hit", "recall", "mrr"), "query_id", "left")
    tool = F.when(T.alarm_code(F.col("question")).isNotNull(), "lookup_alarm_code").otherwise("search_manual")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return rows.select(
        "query_id", "answerable", *map(zero, ("hit", "recall", "mrr")), F.round(facts.group_coverage(F.col("answer"), F.col("required_fact_groups")), 9).alias("fact_score"), (F.coalesce("recall", F.lit(0.0)) > 0.4).alias("cited"),
        (F.col("review_status") == "reviewed").alias("refused"), (tool == F.col("expected_tool")).alias("tool_correct"), (F.length("answer") > 1000).alias("traced"),
    )


def eval_application(spark: SparkSession, d: str) -> DataFrame:
    """Means of a run over application questions, by what went wrong."""
    return evaluation.application_metrics(evaluation.application_details(_application_details(spark, d)))


def eval_tools(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.tool_metrics(_application_details(spark, d))


def eval_memory(spark: SparkSession, d: str) -> DataFrame:
    """Rates over the turns that follow up on others: context used, a tool chosen, an answer given, a session of two turns."""
    from tessera.operators import sessions

    turns = sessions.turns_once(table(spark, d, "conversation_turns").select("id", "session_id", "question", "answer", "selected_tool", "created_at"))
    used = sessions.followups(turns.select("id", "session_id", "question", "created_at")).select("id", "session_id", "used")
    sizes = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("removed"))
    q = T.strip(F.coalesce("question", F.lit("")))
    cases = turns.where((F.length(q) <= 80) & sessions.is_followup(q)).join(used, ["id", "session_id"]).join(sizes, "session_id")
    return evaluation.memory_metrics(cases.select("used", (F.coalesce("selected_tool", F.lit("")) != "").alias("tool_ok"), (F.coalesce("answer", F.lit("")) != "").alias("answer_ok"), "removed"))


def eval_runtime(spark: SparkSession, d: str) -> DataFrame:
    """The event log as requests: types are levels, the value is the latency, odd keys of the properties are model calls."""
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k").cast("int")
    value = F.col("value")
    return evaluation.runtime_metrics(e.select(
        F.col("event_type").alias("level"), (value > 5).alias("ok"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), value.alias("latency_ms"), F.round(value * 0.9, 6).alias("service_ms"), F.round(value * 0.5, 6).alias("retrieval_ms"),
        k.cast("double").alias("llm_ms"), F.when(k > 50, "llm_grounded").otherwise("local_extractive").alias("mode"), F.when(k > 90, "timeout").otherwise("").alias("fallback"), (k > 50).cast("int").alias("llm_calls"), F.when(k > 20, k).alias("tokens"),
    ))


def eval_smoke(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as model runs: those with a tool are answerable, those with sources grounded."""
    ids = F.size(cleaned_ids(id_list(F.col("source_chunk_ids"))))
    t = table(spark, d, "conversation_turns").select("id", "model", "version", "question", "answer", "selected_tool", ids.alias("n")).dropDuplicates(["id"])
    tool, answer = F.coalesce("selected_tool", F.lit("")), F.coalesce("answer", F.lit(""))
    return evaluation.smoke_metrics(t.select(
        F.when(tool == "lookup_alarm_code", "unsafe_request").otherwise("other").alias("category"), (tool == "search_manual").alias("answerable"), F.when(F.col("n") > 0, "llm_grounded").otherwise("local_extractive").alias("mode"), F.col("n").alias("llm_calls"),
        (F.coalesce("version", F.lit("")) != "").alias("usage_known"), (answer == "").alias("refused"), (F.col("n") == 1).alias("citation_valid"), (F.coalesce("model", F.lit("")) == "").alias("fallback"), (answer != "").alias("fallback_ok"),
        F.col("question").isNotNull().alias("trace_valid"), F.col("answer").isNotNull().alias("traced"), F.length(answer).alias("latency_ms"),
    ))


def usage_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Turns with an answer as helpful feedback, and the similar solutions found as reuse."""
    turns = table(spark, d, "conversation_turns").select("id", (F.coalesce("answer", F.lit("")) != "").alias("helpful")).dropDuplicates(["id"])
    asked = _asked(spark, d, "application_questions").select("query_id", F.coalesce("model", F.lit("")).alias("model"), "question").distinct()
    solutions = table(spark, d, "verified_solutions")
    return evaluation.feedback_metrics(turns, solutions.dropDuplicates(["id"]), retrieval.similar_solutions(asked, solutions))


def usage_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token counts in answers of several providers, made from the event log: two sets of names, no total, no output, no usage."""
    k = F.get_json_object("props", "$.k")
    body = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"usage": {"prompt_tokens": '), k, F.lit(', "completion_tokens": 7, "total_tokens": 99}}')))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"usage": {"input_tokens": '), k, F.lit(', "output_tokens": 3}}'))).when(F.col("event_type") == "signup", F.concat(F.lit('{"usage": {"input_tokens": "'), k, F.lit('"}}')))
        .when(F.col("event_type") == "purchase", '{"usage": {}}').otherwise('{"id": 1}')
    )
    u = table(spark, d, "events").select(evaluation.token_usage(body).alias("u")).select("u.*")
    return u.groupBy("known", "reason").agg(F.count(F.lit(1)).alias("answers"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("total").alias("total"))


def usage_failures(spark: SparkSession, d: str) -> DataFrame:
    """Reasons why a model can't be used, over answers made from the event log."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", F.lit(429) - F.when(k > 50, 27).otherwise(0)).when(F.col("event_type") == "signup", 403).otherwise(500)
    body = F.when(k > 75, '{"error": "Insufficient Quota"}').when(k > 50, '{"error": "too many requests"}').when(k > 25, '{"error": {"code": "Throttled"}}').otherwise('{"ok": 1}')
    return table(spark, d, "events").select(status.alias("status"), evaluation.unavailable_reason(status, body).alias("reason")).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("answers"))


QUERIES = {
    f.__name__: f
    for f in (check_formal, check_application, check_ready, check_eligible, eval_formal, eval_application, eval_tools, eval_memory, eval_runtime, eval_smoke, usage_feedback, usage_tokens, usage_failures)
}

_BLANK = lambda c: f"{_strip(f'coalesce({c}, chr(32))')} = ''"
_IN = lambda values: ", ".join(repr(v) for v in values)
_FORMAL = {"blank question": _BLANK("question"), "answerable not given": "answerable IS NULL"}
for _c, _values in (("category", L.FORMAL_CATEGORIES), ("expected_tool", L.FORMAL_TOOLS), ("source_scope", L.FORMAL_SCOPES), ("review_status", L.FORMAL_REVIEWS), ("split", L.FORMAL_SPLITS), ("gold_label_source", L.FORMAL_GOLD)):
    _FORMAL[f"unknown {_c}"] = f"coalesce({_c} NOT IN ({_IN(_values)}), true)"
for _c in ("gold_chunk_ids", "required_facts", "forbidden_facts"):
    _FORMAL[f"{_c} not given"] = f"{_c} IS NULL"
    _FORMAL[f"blank entry in {_c}"] = f"len(list_filter({_c}, lambda x: {_strip("coalesce(x, '')")} = '')) > 0"
    _FORMAL[f"repeated entry in {_c}"] = f"len(list_distinct({_c})) + CAST(len(list_filter({_c}, lambda x: x IS NULL)) > 0 AS INT) < len({_c})"
_N = lambda c: f"coalesce(len({c}), 0)"
_FORMAL |= {
    "answerable without gold": f"answerable AND {_N('gold_chunk_ids')} = 0", "answerable without facts": f"answerable AND {_N('required_facts')} = 0", "answerable without human labels": "answerable AND coalesce(gold_label_source, '') <> 'human_pre_labeled'",
    "gold though unanswerable": f"NOT answerable AND {_N('gold_chunk_ids')} > 0", "labels though unanswerable": "NOT answerable AND coalesce(gold_label_source, '') <> 'not_applicable'",
    "unanswerable without reason": f"NOT answerable AND {_BLANK('refusal_reason')} AND {_N('forbidden_facts')} = 0 AND {_BLANK('notes')}",
    "test not reviewed": "split = 'test' AND coalesce(review_status, '') <> 'reviewed'", "checked without reviewer": f"review_status IN ('self_checked', 'reviewed') AND {_BLANK('reviewer')}",
    "generated labels": "(" + " OR ".join(f"contains(lower(CAST(to_json(r) AS VARCHAR)), '{m}')" for m in L.RUNTIME_GOLD_MARKS) + ")",
}
_FORMAL_FAULTS = "r AS (SELECT DISTINCT * FROM formal_questions), fault AS (" + "\nUNION ALL\n".join(f"SELECT DISTINCT id, '{k}' AS rule FROM r WHERE {v}" for k, v in _FORMAL.items()) + """
UNION ALL SELECT DISTINCT id, 'unknown gold' FROM (SELECT id, unnest(gold_chunk_ids) AS chunk_id FROM r WHERE answerable) WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)
UNION ALL SELECT id, 'repeated id' FROM r GROUP BY id HAVING count(*) > 1)"""
_NEEDED = ("split", "category", "question", "model", "answerable", "gold_chunk_ids", "expected_tool", "required_fact_groups", "source_scope", "review_status")
_APPLICATION = _RULES | {f"{c} not given": f"{c} IS NULL" for c in _NEEDED}
_APP_FAULTS = "a AS (SELECT DISTINCT * EXCLUDE (added_at), coalesce(gold_chunk_ids, CAST([] AS VARCHAR[])) AS g FROM application_questions), app_fault AS (" + "\nUNION ALL\n".join(f"SELECT DISTINCT id, '{k}' AS rule FROM a WHERE {v}" for k, v in _APPLICATION.items()) + """
UNION ALL SELECT id, 'repeated id' FROM a GROUP BY id HAVING count(*) > 1)"""


def _gates(source: str, name: str, fault: str, reviewed: str, test: int, regression: int) -> str:
    return f"""SELECT *, round(share, 4) AS official_share, questions >= 60 AS enough_questions, share >= 0.7 AS enough_official, unanswerable >= 10 AS enough_unanswerable, reviewed >= 30 AS enough_reviewed, test >= {test} AS enough_test, regression >= {regression} AS enough_regression,
  faults = 0 AND questions >= 60 AND share >= 0.7 AND unanswerable >= 10 AND reviewed >= 30 AND test >= {test} AND regression >= {regression} AS ready FROM (SELECT '{name}' AS src_table, count(*) AS questions, count_if(answerable) AS answerable, count_if(NOT answerable) AS unanswerable,
  count_if(answerable AND source_scope = 'official_manual') AS official, count_if(review_status = '{reviewed}') AS reviewed, count_if(split = 'test') AS test, count_if(split = 'regression') AS regression, (SELECT count(*) FROM {fault}) AS faults,
  coalesce(count_if(answerable AND source_scope = 'official_manual') / nullif(count_if(answerable), 0), 0.0) AS share FROM {source})"""


def _run_sql(name: str) -> str:
    """``hits`` of the queries of a set, ``text`` of each query's, and the ranking metrics ``m``."""
    return f"""q AS (SELECT DISTINCT id AS query_id, question, {_search('question')} AS tokens FROM {name} WHERE {_TWENTIETH}),
{_DOCS},{_ranked(n=5)},
gold AS (SELECT DISTINCT id AS query_id, '' AS category, unnest(gold_chunk_ids) AS doc_key FROM {name} WHERE {_TWENTIETH}),{_measured('bm')},
answer AS (SELECT query_id, string_agg(coalesce(text, ''), chr(10) ORDER BY rank) AS answer FROM bm JOIN docs USING (doc_key) GROUP BY 1)"""


_TIGHT = f"regexp_replace(lower({{}}), '{L.WS.replace('{', '{{').replace('}', '}}')}+', '', 'g')"
_NEGATED = " OR ".join(f"contains(b, '{n}')" for n in facts.NEGATIONS)
_DETAILS = f"""{_run_sql('application_questions')},
det AS (SELECT DISTINCT f.id, answerable, coalesce(hit, 0) AS hit, coalesce(recall, 0) AS recall, coalesce(mrr, 0) AS mrr, review_status = 'reviewed' AS refused, length(answer) > 1000 AS traced, coalesce(recall, 0) > 0.4 AS cited,
  CASE WHEN len(required_fact_groups) > 0 THEN len(list_filter(required_fact_groups, lambda g: len(list_filter(g, lambda v: contains(replace(lower(coalesce(answer, '')), ' ', ''), replace(lower(v), ' ', '')))) > 0)) / len(required_fact_groups) ELSE 0 END AS fact_score,
  CASE WHEN regexp_extract(f.question, '{L.PREFIXED_CODE}', 1) <> '' OR len(list_filter(regexp_extract_all(f.question, '[0-9A-Za-z]+'), lambda x: regexp_full_match(x, '[0-9A-Fa-f]{{4}}') AND regexp_matches(x, '[A-Fa-f]'))) > 0
    OR (({' OR '.join(f"contains(lower(f.question), '{w}')" for w in L.ALARM_WORDS)}) AND len(list_filter(regexp_extract_all(replace(f.question, '{L.MODEL_NAME}', ''), '[0-9]+'), lambda x: length(x) = 4)) > 0) THEN 'lookup_alarm_code' ELSE 'search_manual' END = expected_tool AS tool_correct
  FROM application_questions f JOIN answer ON answer.query_id = f.id LEFT JOIN m ON m.query_id = f.id)"""
_HIGH = lambda c, p: f"CAST(CAST(CAST(CAST(quantile_disc({c}, {p}) AS VARCHAR) AS DECIMAL(18, 6)) AS DECIMAL(18, 2)) AS DOUBLE)"

SQL = {
    "check_formal": f"WITH {_FORMAL_FAULTS} SELECT rule, count(DISTINCT id) AS questions FROM fault GROUP BY 1",
    "check_application": f"WITH {_APP_FAULTS} SELECT rule, count(DISTINCT id) AS questions FROM app_fault GROUP BY 1",
    "check_ready": f"WITH {_FORMAL_FAULTS}, {_APP_FAULTS}, every AS ({_gates('r', 'formal_questions', 'fault', 'reviewed', 1, 0)} UNION ALL {_gates('a', 'application_questions', 'app_fault', 'independent_reviewed', 0, 20)}) SELECT * EXCLUDE (share) FROM every",
    "check_eligible": f"""SELECT DISTINCT id, {_N('gold_chunk_ids')} AS gold, CASE WHEN {_N('gold_chunk_ids')} = 0 THEN 'no gold' WHEN coalesce(gold_label_source, '') <> 'human_pre_labeled' THEN 'gold not labelled by people'
  WHEN len(list_filter(gold_chunk_ids, lambda x: {_strip("coalesce(x, '')")} = '')) > 0 THEN 'blank gold' END AS fault FROM formal_questions WHERE answerable""",
    "eval_formal": f"""WITH {_run_sql('formal_questions')},
one AS (SELECT DISTINCT f.id, f.question, f.category, f.answerable, f.review_status = 'reviewed' AS reviewed, f.split = 'test' AS fallback, answer, coalesce(required_facts, CAST([] AS VARCHAR[])) AS req, coalesce(forbidden_facts, CAST([] AS VARCHAR[])) AS forb,
  CASE WHEN answerable THEN coalesce(strict_recall, 0) END AS sr, CASE WHEN answerable THEN coalesce(mrr, 0) END AS mrr, CASE WHEN answerable THEN coalesce(ndcg, 0) END AS ndcg, CASE WHEN answerable THEN coalesce(top1, 0) END AS top1
  FROM formal_questions f JOIN answer ON answer.query_id = f.id LEFT JOIN m ON m.query_id = f.id),
two AS (SELECT *, {_TIGHT.format("coalesce(answer, '')")} AS low, len(req) AS n FROM one),
three AS (SELECT *, len(list_filter(req, lambda f: f IS NOT NULL AND contains(low, {_TIGHT.format('f')}))) AS exact, list_transform(list_filter(list_transform(forb, lambda f: {_TIGHT.format('f')}), lambda p: p <> '' AND contains(low, p)),
  lambda p: len(list_filter(list_transform(range(1, len(string_split(low, p))), lambda i: right(list_reduce(string_split(low, p)[1:i], lambda a, b: a || p || b), 24)), lambda b: NOT ({_NEGATED}))) > 0) AS bad FROM two)
SELECT count(*) AS questions, round(avg(sr), 4) AS strict_recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(top1), 4) AS top1, round(1 - sum(n - exact) / nullif(sum(n), 0), 4) AS claim_support_rate, CAST(sum(n - exact) AS BIGINT) AS unsupported_claims,
  round(avg(CASE WHEN answerable THEN CAST(exact > 0 AS INT) END), 4) AS citation_valid_rate, round(sum(CASE WHEN answerable THEN exact END) / nullif(sum(CASE WHEN answerable THEN n END), 0), 4) AS required_exact_coverage, round(sum(CASE WHEN answerable THEN exact END) / nullif(sum(CASE WHEN answerable THEN n END), 0), 4) AS required_diagnosed_coverage,
  CAST(sum(len(list_filter(bad, lambda x: x))) AS BIGINT) AS forbidden_violations, CAST(sum(len(list_filter(bad, lambda x: NOT x))) AS BIGINT) AS forbidden_negated, round(avg(CASE WHEN NOT answerable AND category <> 'unsafe_request' THEN CAST(reviewed AS INT) END), 4) AS unanswerable_refused,
  round(avg(CASE WHEN category = 'unsafe_request' THEN CAST(reviewed AS INT) END), 4) AS unsafe_refused, round(avg(CASE WHEN fallback THEN CAST(reviewed AS INT) END), 4) AS fallback_success_rate, quantile_disc(length(question), 0.5) AS retrieval_ms_p50, quantile_disc(length(question), 0.95) AS retrieval_ms_p95,
  quantile_disc(CASE WHEN reviewed THEN length(question) END, 0.5) AS llm_ms_p50, quantile_disc(CASE WHEN reviewed THEN length(question) END, 0.95) AS llm_ms_p95, quantile_disc(length(coalesce(answer, '')), 0.5) AS total_ms_p50, quantile_disc(length(coalesce(answer, '')), 0.95) AS total_ms_p95 FROM three""",
    "eval_application": f"""WITH {_DETAILS},
failed AS (SELECT *, CASE WHEN answerable AND hit = 0 THEN 'retrieval_miss' WHEN answerable AND fact_score < 1 THEN 'answer_fact_missing' WHEN answerable AND NOT cited THEN 'citation_invalid' WHEN NOT answerable AND NOT refused THEN 'refusal_failure'
  WHEN answerable AND mrr < 1 THEN 'ranking_late' ELSE 'passed' END AS failure FROM det)
SELECT failure, count(*) AS questions, round(avg(CASE WHEN answerable THEN hit END), 4) AS hit, round(avg(CASE WHEN answerable THEN recall END), 4) AS recall, round(avg(CASE WHEN answerable THEN mrr END), 4) AS mrr, round(avg(CASE WHEN answerable THEN round(fact_score, 9) END), 4) AS fact_score,
  round(avg(CASE WHEN answerable THEN CAST(cited AS INT) END), 4) AS cited, round(avg(CAST(tool_correct AS INT)), 4) AS tool_accuracy, round(avg(CASE WHEN NOT answerable THEN CAST(refused AS INT) END), 4) AS unanswerable_refused FROM failed GROUP BY ROLLUP (failure)""",
    "eval_tools": f"WITH {_DETAILS} SELECT count(*) AS questions, round(avg(CAST(tool_correct AS INT)), 4) AS tool_accuracy, round(avg(CAST(cited AS INT)), 4) AS citation_valid_rate, round(avg(hit), 4) AS gold_hit, round(avg(recall), 4) AS gold_recall, round(avg(CAST(traced AS INT)), 4) AS trace_coverage FROM det",
    "eval_memory": f"""WITH turns AS (SELECT id, lower({_strip('session_id')}) AS session_id, any_value(question) AS question, any_value(created_at) AS created_at, any_value(answer) AS answer, any_value(selected_tool) AS selected_tool FROM conversation_turns WHERE {_strip('session_id')} <> '' GROUP BY 1, 2),
w AS (SELECT *, {_strip("coalesce(question, '')")} AS q, CAST(coalesce(lag(created_at, 1) OVER s >= created_at - INTERVAL 24 HOURS, false) AS INT) + CAST(coalesce(lag(created_at, 2) OVER s >= created_at - INTERVAL 24 HOURS, false) AS INT) AS used, count(*) OVER (PARTITION BY session_id) AS removed FROM turns WINDOW s AS (PARTITION BY session_id ORDER BY id))
SELECT count(*) AS cases, round(count_if(used >= 1) / nullif(count(*), 0), 4) AS context_use_rate, round(count_if(coalesce(selected_tool, '') <> '') / nullif(count(*), 0), 4) AS tool_accuracy, round(count_if(coalesce(answer, '') <> '') / nullif(count(*), 0), 4) AS answer_check_rate,
  round(count_if(removed = 2) / nullif(count(*), 0), 4) AS session_clear_rate FROM w WHERE length(q) <= 80 AND ({_MARKED})""",
    "eval_runtime": f"""WITH e AS (SELECT event_type AS level, value > 5 AS ok, epoch_us(ts) / 1e6 AS seen, value AS l, round(value * 0.9, 6) AS s, round(value * 0.5, 6) AS r, CAST(props->>'k' AS INT) AS k FROM events),
g AS (SELECT *, greatest(0.0, s - r - k) AS o, CASE WHEN k > 50 THEN 'llm_grounded' ELSE 'local_extractive' END AS mode, CASE WHEN k > 90 THEN 'timeout' END AS fb FROM e WHERE ok),
mode AS (SELECT level, list_sort(list(mode || '=' || n)) AS modes FROM (SELECT level, mode, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1), fb AS (SELECT level, list_sort(list(fb || '=' || n)) AS fallbacks FROM (SELECT level, fb, count(*) AS n FROM g WHERE fb IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
every AS (SELECT level, count(*) AS requests, max(seen) - min(seen) AS wall_seconds FROM e GROUP BY 1),
stat AS (SELECT level, count(*) AS successes, round(max(l), 2) AS latency_ms_max, {', '.join(f'{_HIGH(c, p)} AS {n}_p{round(p * 100)}' for c, n in (('l', 'latency_ms'), ('s', 'service_ms'), ('r', 'retrieval_ms'), ('k::DOUBLE', 'llm_ms'), ('o', 'orchestration_ms')) for p in (0.5, 0.95))},
  CAST(sum(CAST(k > 50 AS INT)) AS BIGINT) AS llm_calls, CAST(sum(CASE WHEN k > 20 THEN k ELSE 0 END) AS BIGINT) AS tokens FROM g GROUP BY 1)
SELECT *, round(coalesce(successes, 0) / requests, 4) AS success_rate, round(successes / nullif(wall_seconds, 0), 3) AS throughput FROM every LEFT JOIN stat USING (level) LEFT JOIN mode USING (level) LEFT JOIN fb USING (level)""",
    "eval_smoke": f"""WITH t AS (SELECT id, any_value(len({LISTED})) AS n, any_value(coalesce(selected_tool, '')) AS tool, any_value(coalesce(answer, '')) AS a, any_value(version) AS v, any_value(model) AS m, count(question) AS has_q, count(answer) AS has_a FROM conversation_turns GROUP BY id),
u AS (SELECT *, coalesce(n, 0) AS calls, tool = 'lookup_alarm_code' AS unsafe, tool = 'search_manual' AS answerable FROM t)
SELECT count(*) AS questions, round(count_if(calls > 0) / count(*), 4) AS grounded_rate, round(count_if(calls > 0) / count(*), 4) AS external_call_rate, round(count_if(calls > 0 AND coalesce(v, '') <> '') / nullif(count_if(calls > 0), 0), 4) AS usage_known_rate,
  round(count_if(NOT answerable AND NOT unsafe AND a = '') / nullif(count_if(NOT answerable AND NOT unsafe), 0), 4) AS unanswerable_refused, round(count_if(unsafe AND a = '') / nullif(count_if(unsafe), 0), 4) AS unsafe_refused, round(count_if(answerable AND calls = 1) / nullif(count_if(answerable), 0), 4) AS citation_valid_rate,
  round(count_if(coalesce(m, '') = '' AND a <> '') / nullif(count_if(coalesce(m, '') = ''), 0), 4) AS fallback_success_rate, round(count_if(has_q > 0) / count(*), 4) AS trace_valid_rate, round(count_if(has_a > 0) / count(*), 4) AS traced_rate, quantile_disc(length(a), 0.5) AS p50, quantile_disc(length(a), 0.95) AS p95 FROM u""",
    "usage_feedback": f"""WITH {_SOLVED}, t AS (SELECT id, any_value(coalesce(answer, '')) <> '' AS helpful FROM conversation_turns GROUP BY 1)
SELECT count(*) AS feedback, count_if(helpful) AS helpful, count_if(NOT helpful) AS unhelpful, round(count_if(helpful) / nullif(count(*), 0), 4) AS helpful_rate, (SELECT count(DISTINCT id) FROM verified_solutions WHERE verified = 1) AS verified_solutions, (SELECT count(*) FROM good) AS reused FROM t""",
    "usage_tokens": """WITH e AS (SELECT event_type, CAST(props->>'k' AS BIGINT) AS k FROM events),
u AS (SELECT CASE WHEN event_type IN ('view', 'click', 'signup') THEN k END AS i, CASE event_type WHEN 'view' THEN 7 WHEN 'click' THEN 3 END AS o, CASE event_type WHEN 'view' THEN 99 WHEN 'click' THEN k + 3 END AS t,
  CASE WHEN event_type IN ('view', 'click') THEN '' WHEN event_type = 'signup' THEN 'usage_parse_failed' ELSE 'provider_did_not_return_usage' END AS reason FROM e)
SELECT reason = '' AS known, reason, count(*) AS answers, CAST(sum(i) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output, CAST(sum(t) AS BIGINT) AS total FROM u GROUP BY 1, 2""",
    "usage_failures": """WITH e AS (SELECT event_type, CAST(props->>'k' AS INT) AS k FROM events),
s AS (SELECT CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN CASE WHEN k > 50 THEN 402 ELSE 429 END WHEN 'signup' THEN 403 ELSE 500 END AS status, CASE WHEN k > 75 THEN 'quota' WHEN k > 50 THEN 'many' WHEN k > 25 THEN 'throttled' ELSE '' END AS b FROM e)
SELECT status, CASE WHEN status < 400 AND b = '' THEN '' WHEN status = 429 OR b = 'throttled' THEN 'llm_rate_limited' WHEN status = 402 OR b = 'quota' THEN 'llm_quota_exceeded' WHEN status = 403 THEN 'llm_model_forbidden' WHEN b = 'many' THEN 'llm_model_unavailable' ELSE '' END AS reason, count(*) AS answers FROM s GROUP BY 1, 2""",
}
