"""Literal cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


@pytest.fixture(scope="module")
def one(spark):
    def run(fn, *values, **kw):
        df = spark.createDataFrame([(v,) for v in values], "x string")
        return [r[0] for r in df.select(fn(F.col("x"), **kw)).collect()]

    return run


def test_clean_text(one):
    assert one(T.clean_text, "a\u00adb  c-\nd\n\n\n\ne ", None, "", "a-\nb-\nc") == ["ab cd\n\ne", None, "", "abc"]


def test_collapse(one):
    assert one(T.collapse, None, " a \n\t b\u3000", "") == ["", "a b", ""]


def test_chunk_tokens(one):
    assert one(T.chunk_tokens, "16#80C8 是 MB_LEN 3.5 x1", "", None) == [["16#80C8", "是", "MB_LEN", "3.5", "x", "1"], [], None]


def test_search_tokens_count_terms_twice(one):
    assert one(T.search_tokens, "S7 1200 报错 16#80c8", None) == [["s7-1200", "报", "错", "16#80c8", "s7", "1200", "16#80c8"], []]


def test_embedding_tokens_pair_across_others(one):
    assert one(T.embedding_tokens, "参A数", "a") == [["参", "a", "数", "参数"], ["a"]]


def test_terms(one):
    assert one(T.technical_terms, "MB_CLIENT 16#80C8 plc PLC camelCase 1,200.5") == [sorted(["mb_client", "16#80c8", "plc", "camelcase", "1,200.5"])]
    assert one(T.similarity_terms, "故障码 16#80c8 ab 7") == [sorted(["故障", "障码", "16#80c8", "ab", "7"])]
    assert one(T.search_terms, " What is MB_X v1.2 ") == [["what is mb_x v1.2", "what", "is", "mb_x", "v1.2"]]


def test_sentences(one):
    assert one(T.sentences, "一。二！ x；\n\n y?z", "", "。") == [["一。", "二！", "x；", "y?", "z"], [], ["。"]]


def test_canonical_and_generic(spark):
    df = spark.createDataFrame([([" plc，", "PLC", "16#80c8", "7", "ID", "参数", "MB_X", " "],)], "t array<string>")
    r = df.select(T.canonical_terms(F.col("t")), T.telling_terms(F.col("t"))).first()
    assert r[0] == ["PLC", "16#80C8", "7", "ID", "参数", "MB_X"]
    assert r[1] == ["16#80C8", "ID", "MB_X"]


def test_generic_terms(one):
    assert one(T.generic_terms, "S7-1200 plc 手册", "myplcx") == [["S7-1200", "PLC", "手册"], []]


def test_alarm_code(one):
    cases = ["故障 16#80c8", "报 80C8 吗", "报错 8081", "地址 8081", "S7-1200 报错", "x80C8", None]
    assert one(T.alarm_code, *cases) == ["80c8", "80C8", "8081", None, None, None, None]


def test_value_and_unit(one):
    assert [tuple(x) for x in one(T.value_and_unit, "S7-1200 设为 -3.5 MS", "无")] == [(-3.5, "MS"), (None, None)]


def test_expansion(one):
    assert one(T.expanded_query, "读取 默认值", "status 80c8", "x") == ["读取 默认值 default read holding registers", "status 80c8 16#80C8", "x"]


def test_redaction(one):
    assert one(T.redacted, "API_KEY= abc, sk-12 ok", "Authorization: Bearer x.y") == ["[REDACTED] [REDACTED] ok", "[REDACTED]"]


def test_secret_keys(spark):
    df = spark.createDataFrame([({"Api-Key": "1", "note": "sk-abc"},)], "m map<string,string>")
    assert df.select(T.without_secret_keys(F.col("m"))).first()[0] == {"note": "[REDACTED]"}


def test_citations(one):
    assert one(T.source_indexes, "a[来源2] b[来源 1：x] [来源2]", most=F.lit(1)) == [[1]]
    assert one(T.cited_chunks, "[A | c1] [B|c2] [A | c1]") == [["c1", "c2"]]


def test_small_helpers(one, spark):
    assert one(T.bigrams, "aab", "a", "") == [["aa", "ab"], [], []]
    assert one(T.useful_sentence, "短。这一句足够长足够长足够长足够长足够长。", "短") == ["这一句足够长足够长足够长足够长足够长。", None]
    assert one(T.chunk_family, "a_b_0001_0002", "ab") == ["a_b", "ab"]
    assert one(T.display_version, "v4.2", "4.2", "固件V4.2", None, "x") == ["V4.2", "V4.2", "V4.2", "", ""]
    df = spark.createDataFrame([("A b\nC", "bc")], "a string, b string")
    assert df.select(T.contains_loosely(F.col("a"), F.col("b"))).first()[0]
