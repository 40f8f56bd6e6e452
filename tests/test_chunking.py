"""Folds against plain renderings of the same rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as C

TOKEN = re.compile("16#[0-9A-Fa-f]+|[\u4e00-\u9fff]|[A-Za-z]+(?:_[A-Za-z]+)*|\\d+(?:\\.\\d+)?")


def plain_sentences(t):
    return [x.strip() for x in re.sub("([。！？!?；;])", "\\1\n", t).split("\n") if x.strip()]


def plain_fixed(t, size, overlap):
    done, now = [], []
    n = lambda s: len(TOKEN.findall(s))
    for s in plain_sentences(t):
        if now and sum(map(n, now)) + n(s) > size:
            done.append(now)
            k = len(now) - 1
            while k > 0 and sum(map(n, now[k - 1 :])) <= overlap:
                k -= 1
            now = now[k:]
        now = [*now, s]
    return [x for x in ("\n".join(c) for c in ([*done, now] if now else done)) if len(x) >= 20]


def plain_semantic(t, target, most):
    done, now, total, last = [], [], 0, set()
    for s in plain_sentences(t):
        w = set(TOKEN.findall(s.lower()))
        near = len(w & last) / max(1, len(w | last))
        if now and (total >= target and near < 0.05 or total + len(w) > most):
            done.append("\n".join(now))
            now, total = [], 0
        now.append(s)
        total += len(w)
        last = w
    return [x for x in done + (["\n".join(now)] if now else []) if len(x) >= 20]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    words = ["valve", "MB_LEN", "16#80C8", "阀", "岛", "3.5", "reset", "the"]
    made = ["".join(r.choice(words) + r.choice([" ", " ", "。", "? ", "\n", "；"]) for _ in range(r.randint(0, 200))) for _ in range(60)]
    return [*made, "", None, "x", "。。。"]


def test_fixed_and_semantic(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("t", C.fixed_chunks(F.col("t"), 30, 8).alias("f"), C.semantic_chunks(F.col("t"), 20, 30).alias("s")).collect()
    for r in rows:
        if r["t"] is None:
            assert r["f"] is None and r["s"] is None
        else:
            assert r["f"] == plain_fixed(r["t"], 30, 8)
            assert r["s"] == plain_semantic(r["t"], 20, 30)


def test_sections(spark):
    text = "intro\n# A\none\n## B\ntwo\n# C\n1.2 Sub part\nthree\n1.5 to 3 ... 9\n一、总则\nfour"
    got = spark.createDataFrame([(text,), ("# only",), ("",)], "t string").select(C.sections(F.col("t"))).collect()
    assert [(list(s["path"]), s["text"]) for s in got[0][0]] == [
        ([], "intro"), (["A"], "one"), (["A", "B"], "two"), (["C", "1.2 Sub part"], "three\n1.5 to 3 ... 9"), (["一、总则"], "four"),
    ]
    assert [(list(s["path"]), s["text"]) for s in got[1][0]] == [([], "# only")]
    assert [(list(s["path"]), s["text"]) for s in got[2][0]] == [([], "")]


def test_build_chunks_numbers_run_through_a_document(spark):
    pages = [("d", "D", 1, 1, "# A\nA sentence that is long enough.", None), ("d", "D", 2, 2, "Another sentence that is long enough.", None), ("d", "D", 2, 3, "Row: a=1", "table_row"), ("e", "E", 1, 9, "short", None)]
    df = spark.createDataFrame(pages, "doc_id string, doc_name string, page int, order_no long, text string, representation string")
    got = {r["chunk_id"]: r["text"] for r in C.build_chunks(df).collect()}
    assert got == {"d_0001_0001": "A\nA sentence that is long enough.", "d_0002_0002": "Another sentence that is long enough.", "d_0002_0003": "Row: a=1"}
    assert C.build_chunks(df.limit(0)).count() == 0


def test_table_rows(spark):
    rows = [
        ("t1", "T", [["Name", "", "Name"], ["a", "1", "2"], ["", "", ""], ["b"]]),
        ("t2", "T", [["see http://x", "y"], ["a", "b"]]),
        ("t3", "T", [["one"], ["two"]]),
        ("t4", "T", [["a", "b"], ["", "c"]]),
    ]
    got = C.table_rows(spark.createDataFrame(rows, "table_id string, title string, rows array<array<string>>")).orderBy("row_index").collect()
    assert [(r["table_id"], r["row_index"], r["headers"], r["text"]) for r in got] == [
        ("t1", 1, ["Name", "column_2", "Name_2"], "T\n表格行：Name=a；column_2=1；Name_2=2"), ("t1", 3, ["Name", "column_2", "Name_2"], "T\n表格行：Name=b"),
    ]
