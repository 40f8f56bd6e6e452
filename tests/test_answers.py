"""Answers, claims, facts, rules and means on literal cases."""

import time

from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import answers, chunking, evaluation, facts
from tessera.plans import stores

SCHEMA = "query_id string, question string, rank int, doc_key string, doc_name string, page int, section_path array<string>, representation string, text string"
ROWS = [
    ("q", "valve pressure", 1, "c1", "Manual", 3, ["A", "B"], "", "The valve holds pressure well. Short."),
    ("q", "valve pressure", 2, "c2", None, None, None, "table_row", "name=MB_LEN may be 12,5"),
    ("r", "other", 1, "c3", "N", 1, [], "", "tiny"),
    ("s", "哪些层", 1, "c4", "N", 1, [], "", "One sentence that is long enough. Another sentence, long enough too."),
]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_extractive(spark):
    evidence = spark.createDataFrame(ROWS, SCHEMA)
    asked = spark.createDataFrame([("q", ""), ("r", None), ("s", " found "), ("none", "")], "query_id string, prefix string")
    got = dict(rows(answers.extractive_answers(asked, evidence, {"Manual": "The Manual"})))
    assert got["none"] == L.NO_EVIDENCE
    assert got["q"].splitlines()[:2] == [L.FROM_MANUALS, "1. The valve holds pressure well. [来源1：The Manual，第3页]"]
    assert got["r"].splitlines()[:2] == [L.FROM_FOREIGN_MANUALS, "1. tiny [来源1：N，第1页]"]
    assert got["s"].splitlines()[:3] == ["found", L.MANUAL_EVIDENCE, "1. One sentence that is long enough. [来源1：N，第1页]"] and got["s"].count("来源：[来源1") == 1
    context = dict(rows(answers.context_blocks(evidence)))["q"]
    assert context.startswith("[来源1]\nchunk_id: c1\ndoc_name: Manual\npage: 3\nsection_path: A > B\nevidence: The valve") and "\n\n[来源2]\nchunk_id: c2\ndoc_name: \npage: 0\n" in context


def test_claims(spark):
    evidence = spark.createDataFrame(ROWS, SCHEMA)
    t = L.ANSWER_TITLES
    text = f"{t[0]}\nThe valve holds pressure[来源1]\nThe MB_WRONG holds 13[来源2]。\n{t[1]}\n可能 the valve holds pressure[来源1]\nno source at all here\nwell [来源1] in between\n当前证据未说明这一点的原因\n{t[2]}\n[来源9] far away text\n{t[3]}\nold\n\n{t[4]}\nx"
    draft = spark.createDataFrame([("q", text), ("r", "nothing")], "query_id string, answer string")
    faults = {}
    for q, no, fault in rows(answers.grounded_faults(draft, evidence)):
        faults.setdefault((q, no), set()).add(fault)
    assert faults == {("q", 2): {"identifier"}, ("q", 3): {"wording"}, ("q", 4): {"no source"}, ("q", 5): {"not at the end"}, ("q", 6): {"no source"}, ("q", 7): {"not one source", "not at the end"}, ("r", 0): {"no claims"}}
    checks = {no: c for no, c in rows(answers.claim_checks(draft, evidence).select("no", "category"))}
    assert checks == {1: "supported", 2: "hallucination", 3: "prompt_overgeneralization", 4: "evidence_not_enough", 5: "supported", 6: "checker_false_positive", 7: "evidence_not_enough"}
    done = dict(rows(answers.with_reference_section(draft, evidence)))
    assert done["r"] == "nothing" and f"{t[3]}\n- [来源1] chunk_id: c1；文档: Manual；第3页；章节: A > B\n- [来源2] chunk_id: c2；文档: ；第0页；章节: {L.NO_SECTION}\n\n{t[4]}\nx" in done["q"]
    ok = spark.createDataFrame([("chunk_id: a；[来源1]", ["a"]), ("[来源2]", ["a"]), ("chunk_id: b", ["a"]), ("none", ["a"])], "t string, e array<string>")
    assert [r[0] for r in ok.select(answers.valid_citations(F.col("t"), F.col("e"))).collect()] == [True, False, False, False]


def test_fact_diagnosis(spark):
    gold = "应确认 IP 地址；端口必须为 502。超时会导致停机"
    rows_ = [("a", ["端口必须为 502"], "端口必须为502", gold), ("b", ["需要检查IP地址"], "请核对 ip地址", gold), ("c", ["液压油温度过高"], "液压油温度过高", gold), ("d", ["核对IP地址，端口必须为502，超时会导致停机"], "核对IP地址", gold), ("e", ["端口必须为 502", None], None, gold), ("f", ["x"], "x", None)]
    got = dict(rows(answers.fact_diagnosis(spark.createDataFrame(rows_, "query_id string, facts array<string>, answer string, gold string")).select("query_id", "classification")))
    assert got == {"a": "exact_match", "b": "checker_false_negative", "c": "required_fact_not_directly_supported_by_gold", "d": "required_fact_too_broad", "e": "missing_from_answer", "f": "required_fact_not_directly_supported_by_gold"}
    f = spark.createDataFrame([("禁止强制输出，不得 强制 输出", "强制输出"), ("强制输出。禁止强制输出", "强制输出"), ("a.b", "."), ("x", "y"), ("x", " "), (None, "y")], "a string, f string")
    assert [r[0] for r in f.select(facts.forbidden_mentions(F.col("a"), F.col("f"))).collect()] == ["negated", "violation", "violation", None, None, None]


def test_rules_and_readiness(spark):
    q = spark.createDataFrame(
        [("1", "q", "alarm_code", True, "search_manual", ["c"], "human_pre_labeled", ["f"], [], "official_manual", "reviewed", "r", "test", "", None), ("2", " ", "x", False, "search_manual", ["c", "c", ""], "human_pre_labeled", None, [], "mixed", "reviewed", "", "test", "Runtime_Generated", None)],
        "id string, question string, category string, answerable boolean, expected_tool string, gold_chunk_ids array<string>, gold_label_source string, required_facts array<string>, forbidden_facts array<string>, source_scope string, review_status string, reviewer string, split string, notes string, refusal_reason string",
    )
    found = evaluation.formal_faults(q.unionByName(q), spark.createDataFrame([("d",)], "chunk_id string"))
    assert rows(found.where("id = '1'")) == [("1", "unknown gold")]
    assert {r[1] for r in rows(found.where("id = '2'"))} == {"blank question", "unknown category", "blank entry in gold_chunk_ids", "repeated entry in gold_chunk_ids", "required_facts not given", "gold though unanswerable", "labels though unanswerable", "checked without reviewer", "generated labels"}
    ready = evaluation.readiness(q, found, splits={"test": ("test", 1)}, least=1, unanswerable=1, checked=1).first()
    assert ready["questions"] == 2 and ready["official_share"] == 1.0 and ready["enough_test"] and not ready["ready"]
    assert evaluation.readiness(q.limit(0), found.limit(0), splits={}).first()["official_share"] == 0.0
    assert rows(evaluation.eligible(q.where("id = '1'")).select("id", "fault")) == [("1", None)]


def test_usage(spark):
    bodies = ['{"usage": {"prompt_tokens": 1, "completion_tokens": 2}}', '{"usage": {"input_tokens": "x", "output_tokens": 2}}', "{}", None, "broken"]
    got = rows(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select("i", evaluation.token_usage(F.col("b")).alias("u")).select("i", "u.*"), "i")
    assert got == [(0, 1, 2, 3, True, ""), (1, None, 2, None, False, "usage_parse_failed"), *[(i, None, None, None, False, "provider_did_not_return_usage") for i in (2, 3, 4)]]
    cases = [(200, "fine", ""), (200, '{"error": "quota_exceeded"}', "llm_quota_exceeded"), (429, None, "llm_rate_limited"), (403, "no", "llm_model_forbidden"), (500, "Too many requests", "llm_model_unavailable"), (500, "x", "")]
    df = spark.createDataFrame(cases, "s int, b string, want string")
    assert all(a == b for a, b in rows(df.select("want", evaluation.unavailable_reason(F.col("s"), F.col("b")))))


def test_titles_and_release(spark):
    df = spark.createDataFrame([([(10.0, "far"), (95.0, "near\ntitle"), (95.0, "later"), (101.0, "below"), (99.0, "x" * 200)], 100.0), (None, 1.0)], "b array<struct<y1:double,text:string>>, t double")
    assert [r[0] for r in df.select(chunking.nearest_title(F.col("b"), F.col("t"))).collect()] == ["near title", ""]
    p = spark.createDataFrame([("a/.env", "x"), ("a/.env.example", "x"), ("data/raw/x", "-----BEGIN PRIVATE KEY-----"), ("m.py", "https://u:p@h \x00"), ("m.py", "https://u:p@h")], "p string, c string")
    assert [r[0] for r in p.select(T.release_faults(F.col("p"), F.col("c"))).collect()] == [["path"], [], ["path", "private key"], [], ["credential in url"]]
    assert T.is_secret_key("X-Api-Key") and not T.is_secret_key("name")


def test_nearest_titles_of_a_large_document(spark):
    """Each of 8,000 tables against the boxes of all others would be 64 million."""
    t = spark.range(8_000).select(F.lit("d").alias("doc_id"), "id", (F.col("id") * 1.0).alias("top"))
    blocks = spark.range(8_000).select(F.lit("d").alias("doc_id"), (F.col("id") * 1.0).alias("y1"), F.when(F.col("id") % 200 == 0, F.concat(F.lit(" Table "), "id")).otherwise(F.lit("w" * 161)).alias("text"))
    odd = spark.createDataFrame([("d", 0.0, " Table 00"), ("d", 0.0, None), ("d", None, "x"), (None, 1.0, "no document"), ("e", 5.0, "\u00ad low\n title"), ("e", 5.0, "low  title!")], "doc_id string, y1 double, text string")
    more = spark.createDataFrame([(None, 8000, 1.0), ("e", 8001, 95.0), ("e", 8002, 95.5), ("e", 8003, 4.0), ("f", 8004, 1.0), ("e", 8005, None)], "doc_id string, id long, top double")
    began = time.time()
    got = {r["id"]: r["title"] for r in chunking.nearest_titles(t.unionByName(more), blocks.unionByName(odd)).collect()}
    want = {i: f"Table {i // 200 * 200}" if i % 200 <= 90 else "" for i in range(8_000)} | {8000: "", 8001: "low  title", 8002: "", 8003: "", 8004: "", 8005: ""}
    want |= {i: "Table 0" for i in range(91)}
    assert got == want
    assert time.time() - began < 45


def test_chunk_titles_of_documents_without_id(spark, tmp_path):
    """A table of no document, or with a box of less than four numbers, has no title."""
    rows = [("c1", None, ("t1", "One", [0.0, 50.0, 0.0, 10.0])), ("c2", "d", ("t2", "Two", [0.0, 50.0, 0.0, 10.0])), ("c3", "d", ("t3", "Three", [1.0]))]
    spark.createDataFrame(rows, "chunk_id string, doc_id string, metadata struct<table_id:string,table_title:string,bbox:array<double>>").write.parquet(f"{tmp_path}/chunks.parquet")
    assert sorted(tuple(r) for r in stores.chunk_titles(spark, str(tmp_path)).collect()) == [("t1", ""), ("t2", "Two"), ("t3", "")]
