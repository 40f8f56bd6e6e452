"""Facts, claims and citations on literal cases."""

from pyspark.sql import functions as F

from tessera.operators import facts


def test_facts(spark):
    df = spark.createDataFrame([("需要检查 IP，并且确认端口。[来源1]", "必须核对ip；还应重启")], "a string, b string")
    r = df.select(facts.normal_fact(F.col("a")), facts.atomic_parts(F.col("b")), facts.fact_similarity(F.col("a"), F.col("a")), facts.fact_similarity(F.col("a"), F.lit(""))).first()
    assert r[0] == "核对ip并且核对端口" and r[1] == ["核对ip", "重启"] and r[2] == 1.0 and r[3] == 0.0


def test_coverage_and_negation(spark):
    df = spark.createDataFrame([("The Valve A is shut. 不要强制输出。", [["valvea", "x"], ["none"]], ["valve a", "zz", None])], "t string, g array<array<string>>, f array<string>")
    r = df.select(facts.group_coverage(F.col("t"), F.col("g")), facts.facts_met(F.col("t"), F.col("f")), facts.affirmed(F.col("t"), F.lit("强制输出")), facts.affirmed(F.col("t"), F.lit("valve")), facts.affirmed(F.col("t"), F.lit("nowhere"))).first()
    assert tuple(r) == (0.5, ["valve a"], False, True, None)
    empty = spark.createDataFrame([(None, None, None)], "t string, g array<array<string>>, f array<string>")
    assert tuple(empty.select(facts.group_coverage(F.col("t"), F.col("g")), facts.facts_met(F.col("t"), F.col("f"))).first()) == (0.0, [])


def test_claims_and_citations(spark):
    answer = "1. 结论\n阀门已经关闭。[来源1]\n- 端口是502[来源2]。\n2. 原因\n短\n4. 引用来源\n[A | c9]"
    df = spark.createDataFrame([(answer, ["c1"])], "a string, e array<string>")
    r = df.select(facts.claims(F.col("a")), facts.source_ranges(F.lit("[来源3-1][来源 7，2]"), F.lit(5)), facts.citation_faults(F.col("a"), F.col("e")), facts.requested_versions(F.lit("v4.2 固件版本 3.1 xV9.9"))).first()
    assert r[0] == ["阀门已经关闭。[来源1]", "端口是502[来源2]。"] and r[1] == [1, 2, 3]
    assert r[2].asDict() == {"unknown": ["c9"], "out_of_range": [2], "uncited": False} and r[3] == ["V3.1", "V4.2"]


def test_frames(spark):
    hits = spark.createDataFrame([("q", 1, "N", 3, "no"), ("q", 2, "Manual", None, "has MB_LEN")], "query_id string, rank int, name string, page int, text string")
    terms = spark.createDataFrame([("q", ["mb_len"]), ("r", ["x"])], "query_id string, terms array<string>")
    assert sorted(tuple(r) for r in facts.expected_terms(hits, terms).collect()) == [("q", 1, 0.5), ("r", 0, 0.0)]
    rows = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, v string")
    assert sorted(tuple(r) for r in facts.with_overrides(rows, spark.createDataFrame([("a", "new")], "id string, v string"), ["id"]).collect()) == [("a", "new"), ("b", "old")]
    m = lambda *x: spark.createDataFrame(list(x), "metric string, value double")
    assert [tuple(r) for r in facts.deltas(m(("a", 1.0), ("b", 2.0)), m(("a", 0.5))).collect()] == [("a", 1.0, 0.5, 0.5)]
