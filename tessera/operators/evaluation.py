"""Evaluation sets: rules for their rows, readiness, and means over runs, each over its own kind of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators.audit import blank, question_rules, violations
from tessera.operators.metrics import nearest_rank, rate


def formal_rules(json: Column) -> dict[str, Column]:
    """Rules for formal evaluation questions; ``json``: a row as text, in which marks of generated labels are looked for."""
    none = F.array().cast("array<string>")
    gold, required, forbidden = (F.coalesce(c, none) for c in ("gold_chunk_ids", "required_facts", "forbidden_facts"))
    known = {"category": L.FORMAL_CATEGORIES, "expected_tool": L.FORMAL_TOOLS, "source_scope": L.FORMAL_SCOPES, "review_status": L.FORMAL_REVIEWS, "split": L.FORMAL_SPLITS, "gold_label_source": L.FORMAL_GOLD}
    answerable = F.col("answerable")
    rules = {"blank question": blank("question"), "answerable not given": answerable.isNull()}
    rules |= {f"unknown {c}": ~F.coalesce(F.col(c).isin(*values), F.lit(False)) for c, values in known.items()}
    for c in ("gold_chunk_ids", "required_facts", "forbidden_facts"):
        rules[f"{c} not given"] = F.col(c).isNull()
        rules[f"blank entry in {c}"] = F.exists(F.coalesce(c, none), lambda x: T.strip(F.coalesce(x, F.lit(""))) == "")
        rules[f"repeated entry in {c}"] = F.size(F.array_distinct(F.coalesce(c, none))) < F.size(F.coalesce(c, none))
    rules |= {
        "answerable without gold": answerable & (F.size(gold) == 0), "answerable without facts": answerable & (F.size(required) == 0), "answerable without human labels": answerable & ~F.coalesce(F.col("gold_label_source") == "human_pre_labeled", F.lit(False)),
        "gold though unanswerable": ~answerable & (F.size(gold) > 0), "labels though unanswerable": ~answerable & ~F.coalesce(F.col("gold_label_source") == "not_applicable", F.lit(False)),
        "unanswerable without reason": ~answerable & blank("refusal_reason") & (F.size(forbidden) == 0) & blank("notes"),
        "test not reviewed": (F.col("split") == "test") & ~F.coalesce(F.col("review_status") == "reviewed", F.lit(False)), "checked without reviewer": F.col("review_status").isin("self_checked", "reviewed") & blank("reviewer"),
        "generated labels": F.exists(T.strings(L.RUNTIME_GOLD_MARKS), lambda m: F.contains(F.lower(json), m)),
    }
    return rules


def formal_faults(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id, rule`` for each rule of ``formal_rules`` that a question breaks, with gold that no chunk has and ids given to
    several different questions. Whole-row repeats count once; columns that ``questions`` lacks are null."""
    wanted = ("id", "question", "category", "answerable", "expected_tool", "gold_chunk_ids", "gold_label_source", "required_facts", "forbidden_facts", "source_scope", "review_status", "reviewer", "split", "notes", "refusal_reason")
    rows = questions.select(*questions.columns, *[F.lit(None).alias(c) for c in wanted if c not in questions.columns]).distinct()
    broken = violations(rows, "id", formal_rules(F.to_json(F.struct(*questions.columns))))
    gold = rows.where("answerable").select("id", F.explode(F.array_distinct("gold_chunk_ids")).alias("chunk_id")).where("chunk_id is not null")
    unknown = gold.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").select("id", F.lit("unknown gold").alias("rule")).distinct()
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("rule"))
    return broken.unionByName(unknown).unionByName(repeated)


def application_faults(questions: DataFrame) -> DataFrame:
    """``id, rule`` for application questions: the shared rules, fields that have to be given, and repeated ids."""
    needed = ("split", "category", "question", "model", "answerable", "gold_chunk_ids", "expected_tool", "required_fact_groups", "source_scope", "review_status")
    rows = questions.distinct()
    rules = question_rules() | {f"{c} not given": F.col(c).isNull() if c in questions.columns else F.lit(True) for c in needed}
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("rule"))
    return violations(rows, "id", rules).unionByName(repeated)


def eligible(questions: DataFrame, split: str = "all") -> DataFrame:
    """Questions that may take part in a ranking evaluation: ``id, gold_chunk_ids, fault``; ``fault`` names what forbids it, null
    if nothing does. Only answerable ones of the split (``all`` for each) are listed."""
    rows = questions.where("answerable") if split == "all" else questions.where(F.col("answerable") & (F.col("split") == split))
    gold = F.coalesce("gold_chunk_ids", F.array().cast("array<string>"))
    fault = (
        F.when(F.size(gold) == 0, "no gold").when(~F.coalesce(F.col("gold_label_source") == "human_pre_labeled", F.lit(False)), "gold not labelled by people")
        .when(F.exists(gold, lambda x: T.strip(F.coalesce(x, F.lit(""))) == ""), "blank gold")
    )
    return rows.select("id", gold.alias("gold_chunk_ids"), fault.alias("fault")).distinct()


def readiness(questions: DataFrame, faults: DataFrame, *, splits: dict[str, tuple[str, int]], reviewed: str = "reviewed", least: int = 60, official: float = 0.7, unanswerable: int = 10, checked: int = 30) -> DataFrame:
    """One row: the counts of an evaluation set, the gates they have to pass, and ``ready``: all gates, and no fault.

    ``splits``: names of gates with the split and the least number of its questions. ``faults``: ``id, rule``."""
    rows = questions.distinct()
    share = F.coalesce(rate(F.col("official"), F.col("answerable")), F.lit(0.0))
    counted = rows.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("answerable").alias("answerable"), F.count_if(~F.col("answerable")).alias("unanswerable"), F.count_if(F.col("answerable") & (F.col("source_scope") == "official_manual")).alias("official"),
        F.count_if(F.col("review_status") == reviewed).alias("reviewed"), *[F.count_if(F.col("split") == s).alias(k) for k, (s, _) in splits.items()],
    ).withColumn("faults", F.lit(faults.count()))
    gates = {
        "enough_questions": F.col("questions") >= least, "enough_official": share >= official, "enough_unanswerable": F.col("unanswerable") >= unanswerable, "enough_reviewed": F.col("reviewed") >= checked,
        **{f"enough_{k}": F.col(k) >= n for k, (_, n) in splits.items()},
    }
    ready = F.col("faults") == 0
    for g in gates.values():
        ready = ready & g
    return counted.select("*", F.round(share, 4).alias("official_share"), *[g.alias(k) for k, g in gates.items()], ready.alias("ready"))


def mean(c: Column, digits: int = 4) -> Column:
    """A mean without nulls, to four digits; null if there is nothing."""
    return F.round(F.avg(c.cast("double")), digits)


def formal_metrics(details: DataFrame) -> DataFrame:
    """One row of the means of a formal run; each over the questions it is about.

    ``details``: one row a question: ``category, answerable, strict_recall, mrr, ndcg, top1, claims, unsupported, citation_valid,
    required, required_exact, required_diagnosed, forbidden_violations, forbidden_negated, refused, fallback,
    fallback_success, retrieval_ms, llm_ms, total_ms``."""
    a, unsafe = F.col("answerable"), F.col("category") == "unsafe_request"
    only = lambda where, c: F.when(where, F.col(c))
    tiers = lambda c, where=None: [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})").alias(f"{c}_p{round(p * 100)}") for p in (0.5, 0.95)]
    some = details.withColumn("llm_ms", F.when(F.col("llm_ms") > 0, F.col("llm_ms")))
    return some.agg(
        F.count(F.lit(1)).alias("questions"), *[mean(only(a, c)).alias(c) for c in ("strict_recall", "mrr", "ndcg", "top1")], F.round(1 - rate(F.sum("unsupported"), F.sum("claims")), 4).alias("claim_support_rate"), F.sum("unsupported").alias("unsupported_claims"),
        mean(only(a, "citation_valid")).alias("citation_valid_rate"), F.round(rate(F.sum(only(a, "required_exact")), F.sum(only(a, "required"))), 4).alias("required_exact_coverage"),
        F.round(rate(F.sum(only(a, "required_diagnosed")), F.sum(only(a, "required"))), 4).alias("required_diagnosed_coverage"), F.sum("forbidden_violations").alias("forbidden_violations"), F.sum("forbidden_negated").alias("forbidden_negated"),
        mean(only(~a & ~unsafe, "refused")).alias("unanswerable_refused"), mean(only(unsafe, "refused")).alias("unsafe_refused"), mean(only(F.col("fallback"), "fallback_success")).alias("fallback_success_rate"),
        *tiers("retrieval_ms"), *tiers("llm_ms"), *tiers("total_ms"),
    )


def application_details(rows: DataFrame) -> DataFrame:
    """``rows`` with ``failure``: what went wrong first. ``rows``: ``answerable, hit, mrr, fact_score, cited, refused, ...``."""
    a = F.col("answerable")
    failure = (
        F.when(a & (F.col("hit") == 0), "retrieval_miss").when(a & (F.col("fact_score") < 1), "answer_fact_missing").when(a & ~F.col("cited"), "citation_invalid")
        .when(~a & ~F.col("refused"), "refusal_failure").when(a & (F.col("mrr") < 1), "ranking_late").otherwise("passed")
    )
    return rows.withColumn("failure", failure)


def application_metrics(details: DataFrame) -> DataFrame:
    """Means of an application run by ``failure`` and, with a null there, over all."""
    a = F.col("answerable")
    only = lambda where, c: F.when(where, F.col(c))
    return details.rollup("failure").agg(
        F.count(F.lit(1)).alias("questions"), *[mean(only(a, c)).alias(c) for c in ("hit", "recall", "mrr", "fact_score", "cited")], mean(F.col("tool_correct")).alias("tool_accuracy"), mean(only(~a, "refused")).alias("unanswerable_refused"),
    )


def tool_metrics(details: DataFrame) -> DataFrame:
    """One row of means over chat runs: ``details``: ``tool_correct, cited, hit, recall, traced``."""
    return details.agg(F.count(F.lit(1)).alias("questions"), *[mean(F.col(c)).alias(n) for c, n in (("tool_correct", "tool_accuracy"), ("cited", "citation_valid_rate"), ("hit", "gold_hit"), ("recall", "gold_recall"), ("traced", "trace_coverage"))])


def memory_metrics(cases: DataFrame) -> DataFrame:
    """Rates over two-turn cases: ``cases``: ``used`` (turns of context), ``tool_ok, answer_ok, removed``."""
    one = lambda c: F.round(rate(F.count_if(c), F.count(F.lit(1))), 4)
    return cases.agg(F.count(F.lit(1)).alias("cases"), one(F.col("used") >= 1).alias("context_use_rate"), one(F.col("tool_ok")).alias("tool_accuracy"), one(F.col("answer_ok")).alias("answer_check_rate"), one(F.col("removed") == 2).alias("session_clear_rate"))


def runtime_metrics(requests: DataFrame) -> DataFrame:
    """Runs of requests by ``level``: successes, rates and latencies of those that succeeded.

    ``requests``: ``level, ok, at`` (seconds, when it ended), ``latency_ms, service_ms, retrieval_ms, llm_ms, mode, fallback, llm_calls, tokens``.
    What the service spends on neither retrieval nor a model is orchestration, at least 0."""
    good = requests.where("ok").withColumn("orchestration_ms", F.greatest(F.lit(0.0), F.col("service_ms") - F.col("retrieval_ms") - F.col("llm_ms")))
    named = ("latency_ms", "service_ms", "retrieval_ms", "llm_ms", "orchestration_ms")
    tiers = [F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})"), 2).alias(f"{c}_p{round(p * 100)}") for c in named for p in (0.5, 0.95)]
    every = requests.groupBy("level").agg(F.count(F.lit(1)).alias("requests"), (F.max("at") - F.min("at")).alias("wall_seconds"))
    stats = good.groupBy("level").agg(F.count(F.lit(1)).alias("successes"), F.round(F.max("latency_ms"), 2).alias("latency_ms_max"), *tiers, F.sum("llm_calls").alias("llm_calls"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))
    count = lambda c: good.where(F.coalesce(c, F.lit("")) != "").groupBy("level", c).agg(F.count(F.lit(1)).alias("n")).groupBy("level").agg(F.array_sort(F.collect_list(F.concat_ws("=", c, "n"))).alias(f"{c}s"))
    joined = every.join(stats, "level", "left").join(count("mode"), "level", "left").join(count("fallback"), "level", "left")
    return joined.withColumn("success_rate", F.round(F.coalesce("successes", F.lit(0)) / F.col("requests"), 4)).withColumn("throughput", F.round(rate(F.col("successes"), F.col("wall_seconds")), 3))


def smoke_metrics(details: DataFrame) -> DataFrame:
    """One row of rates over model runs: ``details``: ``category, answerable, mode, llm_calls, usage_known, refused, citation_valid,
    fallback, fallback_ok, trace_valid, traced, latency_ms``."""
    unsafe, external = F.col("category") == "unsafe_request", F.col("llm_calls") > 0
    of = lambda part, whole: F.round(rate(F.count_if(whole & part), F.count_if(whole)), 4)
    every = F.lit(True)
    return details.agg(
        F.count(F.lit(1)).alias("questions"), of(F.col("mode") == "llm_grounded", every).alias("grounded_rate"), of(external, every).alias("external_call_rate"), of(F.col("usage_known"), external).alias("usage_known_rate"),
        of(F.col("refused"), ~F.col("answerable") & ~unsafe).alias("unanswerable_refused"), of(F.col("refused"), unsafe).alias("unsafe_refused"), of(F.col("citation_valid"), F.col("answerable")).alias("citation_valid_rate"),
        of(F.col("fallback_ok"), F.col("fallback")).alias("fallback_success_rate"), of(F.col("trace_valid"), every).alias("trace_valid_rate"), of(F.col("traced"), every).alias("traced_rate"), *nearest_rank("latency_ms", 0.5, 0.95),
    )


def feedback_metrics(feedback: DataFrame, solutions: DataFrame, reuse: DataFrame) -> DataFrame:
    """One row: feedback in all, helpful and not, their rate (null without any), verified solutions and their reuse."""
    one = feedback.agg(F.count(F.lit(1)).alias("feedback"), F.count_if("helpful").alias("helpful"))
    return one.select(
        "feedback", "helpful", (F.col("feedback") - F.col("helpful")).alias("unhelpful"), F.round(rate(F.col("helpful"), F.col("feedback")), 4).alias("helpful_rate"),
        F.lit(solutions.where("verified = 1").count()).alias("verified_solutions"), F.lit(reuse.count()).alias("reused"),
    )


def token_usage(body: Column) -> Column:
    """Token counts of a provider's answer (JSON text): ``input, output, total, known, reason``.

    Either name of a count is read; a missing total is the sum of both. ``known`` is false, with its reason, if there is no usage
    or a count can't be had; nothing is made up."""
    usage = F.from_json(body, "usage map<string,string>")["usage"]
    number = lambda *names: F.coalesce(*[F.try_element_at(usage, F.lit(n)) for n in names]).try_cast("long")
    given, out = number("prompt_tokens", "input_tokens"), number("completion_tokens", "output_tokens")
    total = F.coalesce(number("total_tokens"), given + out)
    none = usage.isNull() | (F.size(usage) <= 0)
    known = ~none & given.isNotNull() & out.isNotNull() & total.isNotNull()
    reason = F.when(none, "provider_did_not_return_usage").when(~known, "usage_parse_failed").otherwise("")
    return F.struct(given.alias("input"), out.alias("output"), total.alias("total"), known.alias("known"), reason.alias("reason"))


def unavailable_reason(status: Column, body: Column) -> Column:
    """Why a model can't be used, by an answer's status and text; empty if it can."""
    low = F.lower(F.coalesce(body, F.lit("")))
    has = lambda marks: F.exists(T.strings(marks), lambda m: F.contains(low, m))
    failed = (status >= 400) | F.coalesce(F.get_json_object(body, "$.error").isNotNull(), F.lit(False))
    reason = (
        F.when((status == 429) | has(L.RATE_MARKS), "llm_rate_limited").when((status == 402) | has(L.QUOTA_MARKS), "llm_quota_exceeded").when(status == 403, "llm_model_forbidden").when(has(L.UNAVAILABLE_MARKS), "llm_model_unavailable")
    )
    return F.when(failed, F.coalesce(reason, F.lit(""))).otherwise("")
