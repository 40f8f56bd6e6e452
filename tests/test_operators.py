"""Core operators on small cases: nulls, ties, repeats, empty tables."""

import datetime as dt
import math
import random
import re
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.operators import audit, lookup, metrics, references, retrieval, sessions
from tessera.plans import corpus

D = dt.datetime


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_id_list_reads_all_writers(spark):
    cases = ['["a_1", "b_2"]', '"[\\"a_1\\"]"', "['a_1', 'b_2']", "a_1; b_2", "a_1,b_2", "[]", "null", None, '["a_1\\n", " "]', "[\n \"a_1\"\n]"]
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    got = [r[0] for r in df.select(references.cleaned_ids(references.id_list(F.col("x")))).collect()]
    assert got == [["a_1", "b_2"], ["a_1"], ["a_1", "b_2"], ["a_1", "b_2"], ["a_1", "b_2"], [], [], [], ["a_1"], ["a_1"]]


def test_orphans(spark):
    parents = spark.createDataFrame([("a", D(2024, 1, 1)), ("a", D(2024, 5, 1)), ("b", D(2024, 3, 1)), ("c", None), (None, None)], "chunk_id string, ingested_at timestamp_ntz")
    refs = spark.createDataFrame(
        [("t", "1", "a", D(2024, 2, 1)), ("t", "1", "a", D(2024, 2, 1)), ("t", "2", "b", D(2024, 2, 1)), ("t", "3", "b", None), ("t", "4", "x", None), ("t", "5", "c", D(2020, 1, 1))], "ref_table string, ref_id string, chunk_id string, at timestamp_ntz"
    )
    found = references.orphan_references(refs, parents)
    assert rows(found.select("ref_id", "chunk_id", "reason"), "ref_id") == [("2", "b", "later"), ("4", "x", "missing")]
    assert references.orphan_references(refs, parents, max_words=1).count() == 2
    assert references.orphan_references(refs, parents.limit(0)).count() == 5
    assert references.orphan_references(refs.limit(0), parents).count() == 0
    gone = spark.createDataFrame([("x ",), (None,)], "chunk_id string")
    assert rows(references.orphan_report(found, gone).select("ref_table", "month", "reason", "refs"), "reason") == [("t", "2024-02", "later", 1), ("t", None, "removed", 1)]


def test_bm25_against_plain(spark, monkeypatch):
    r = random.Random(1)
    docs = [(f"d{i:02}", [r.choice("abcdefg") for _ in range(r.randint(1, 12))]) for i in range(40)]
    queries = [("q1", ["a", "b", "b"]), ("q2", ["g", "zz"]), ("q3", ["zz"])]
    n, avg = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = {w: sum(w in t for _, t in docs) for w in "abcdefg"}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    want = {}
    for q, ts in queries:
        s = []
        for k, t in docs:
            score = sum((idf[w] if idf[w] >= 0 else low) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in ts if w in df)
            if any(w in t for w in ts):
                s.append((-round(score, 9), k))
        want[q] = [k for i, (v, k) in enumerate(sorted(s)[:5]) if v < 0 or i == 0]
    asked, all_docs = spark.createDataFrame([*queries, ("q4", []), (None, ["a"])], "query_id string, tokens array<string>"), spark.createDataFrame(docs, "doc_key string, tokens array<string>")
    index = retrieval.build_index(all_docs)
    for blocks in (8, 1):  # all queries in one pass, and a pass for each block
        monkeypatch.setattr(retrieval, "BLOCKS_AT_ONCE", blocks)
        monkeypatch.setattr(retrieval, "TERM_BLOCK", 256 if blocks > 1 else 1)
        got = retrieval.bm25_search(asked, index, 5)
        for q in ("q1", "q2"):
            assert [x["doc_key"] for x in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want[q]
        # without any common term just the first document
        assert rows(got.where("query_id in ('q3', 'q4')"), "query_id") == [("q3", "d00", 0.0, 1), ("q4", "d00", 0.0, 1)]
    strict = retrieval.build_index(all_docs.withColumn("model", F.when(F.col("doc_key") < "d05", "x").when(F.col("doc_key") < "d20", "m").when(F.col("doc_key") < "d30", "").otherwise("x")))
    got = retrieval.bm25_search(asked.withColumn("model", F.lit("M")), strict, 40)
    assert {r[0] for r in got.select("doc_key").distinct().collect()} <= {f"d{i:02}" for i in range(5, 30)} and got.where("doc_key >= 'd20'").count() > 0
    assert rows(got.where("query_id = 'q3'")) == [("q3", "d05", 0.0, 1)]
    assert retrieval.bm25_search(asked.limit(0), index).count() == 0 == retrieval.bm25_search(asked, retrieval.build_index(all_docs.limit(0))).count()


def test_dense_search(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 8))
    docs = spark.createDataFrame([(f"{i:03}", v.tolist(), "A" if i % 2 else "B", "") for i, v in enumerate(m)] + [("zero", [0.0] * 8, "A", ""), ("null", None, "A", "")], "doc_key string, vector array<double>, model string, version string")
    asked = spark.createDataFrame([("1", m[0].tolist(), "", ""), ("2", m[1].tolist(), "B", "")], "query_id string, vector array<double>, model string, version string")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = retrieval.dense_search(asked, docs, 5)
    assert [r["doc_key"] for r in got.where("query_id = '1'").orderBy("rank").collect()] == [f"{i:03}" for i in np.argsort(-(unit @ unit[0]))[:5]]
    strict = retrieval.dense_search(asked, docs, 5, exact_model=True).where("query_id = '2'").orderBy("rank").collect()
    order = [i for i in np.argsort(-(unit @ unit[1])) if i % 2 == 0][:5]
    assert [r["doc_key"] for r in strict] == [f"{i:03}" for i in order]
    assert retrieval.dense_search(asked.limit(0), docs).count() == 0
    retrieval.BLOCK, retrieval.BLOCKS_AT_ONCE, kept = 1, 1, (retrieval.BLOCK, retrieval.BLOCKS_AT_ONCE)
    try:  # one query a pass gives the same
        assert rows(retrieval.dense_search(asked, docs, 5), "query_id", "rank") == rows(got, "query_id", "rank")
    finally:
        retrieval.BLOCK, retrieval.BLOCKS_AT_ONCE = kept


def test_strategies_trace_and_hooks(spark):
    docs = spark.createDataFrame([("a", ["x", "y"], [1.0, 0.0], "A", "xy"), ("b", ["y"], [0.0, 1.0], "B", "y"), ("c", ["z"], [0.6, 0.8], None, None)], "doc_key string, tokens array<string>, vector array<double>, name string, text string")
    index = retrieval.build_index(docs)
    asked = spark.createDataFrame([("1", "dense", ["z"], [1.0, 0.0]), ("2", "bm25", ["z"], [1.0, 0.0]), ("3", None, ["z"], [1.0, 0.0])], "query_id string, strategy string, tokens array<string>, vector array<double>")
    got = rows(retrieval.search_with_strategy(asked, index, asked.select("query_id", "tokens"), 1).select("query_id", "strategy", "doc_key"), "query_id")
    assert got == [("1", "dense", "a"), ("2", "bm25", "c"), ("3", "hybrid", "c")]
    lists = retrieval.hybrid_search(asked, index, asked.select("query_id", "tokens"), top_k=2)
    trace = retrieval.trace_hits(lists, docs.select("doc_key", "name", "text"))
    assert rows(trace.groupBy("stage").count(), "stage") == [("bm25_topk", 3), ("dense_topk", 9), ("final_evidence", 6), ("rrf_topk", 9)]
    q = spark.createDataFrame([("1", "long")], "query_id string, question string")
    byte = retrieval.model_rerank(lists["rrf_topk"].where("query_id = '1'"), q, docs, lambda qs, ts: [float(-len(t)) for t in ts], 2)
    assert [r[1] for r in rows(byte.select("rank", "doc_key"), "rank")] == ["c", "b"]
    vectors, dim, name = retrieval.embedder("mini", model=lambda ts: np.ones((len(ts), 3)))
    assert (dim, name) == (3, "mini") and docs.select(vectors(F.col("text"))).first()[0] == [1.0, 1.0, 1.0]
    assert retrieval.embedder("mini")[1:] == (512, "hash")
    first = retrieval.verified_first(spark.createDataFrame([("1", "c", 0)], "query_id string, doc_key string, place int"), lists["dense_topk"].where("query_id = '1'"), 2)
    assert rows(first, "rank") == [("1", "c", True, 1), ("1", "a", False, 2)]
    e = spark.createDataFrame([("1", "has MB_LEN and 16#80C8"), ("2", "no"), ("3", "x")], "query_id string, text string")
    a = spark.createDataFrame([("1", "MB_LEN 16#80C8 1200"), ("2", "MB_LEN"), ("3", "what"), ("4", "what")], "query_id string, question string")
    assert [r[3] for r in rows(retrieval.evidence_supports(a, e), "query_id")] == [True, False, True, False]


def test_running_totals(spark):
    from tessera.operators.running import running_before

    r = random.Random(5)
    data = [("hot" if r.random() < 0.6 else f"k{r.randint(0, 5)}", i, r.randint(0, 9)) for i in range(500)]
    got = {(k, o): n for k, o, n in rows(running_before(spark.createDataFrame([*data, (None, 1, 1)], "k string, o long, v int"), "k", "o", "v"))}
    assert got == {(k, o): sum(v for a, b, v in data if a == k and b < o) for k, o, _ in data}
    assert running_before(spark.createDataFrame([], "k string, o long, v int"), "k", "o", "v").count() == 0


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "t array<string>")
    for kind in ("md5", "blake2b"):
        a, b, c = (r[0] for r in df.select(retrieval.hashed_vectors(F.col("t"), 16, kind)).collect())
        assert abs(sum(x * x for x in a) - 1) < 1e-9 and not any(b) and not any(c)


def test_fusion_and_rerank(spark):
    dense = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, doc_key string, rank int")
    sparse = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "query_id string, doc_key string, rank int")
    fused = retrieval.fuse(dense, sparse)
    assert [(r["doc_key"], r["dense_rank"], r["bm25_rank"]) for r in fused.orderBy("rank").collect()] == [("b", 2, 1), ("a", 1, None), ("c", None, 2)]
    q = spark.createDataFrame([("q", ["x", "y", "x"])], "query_id string, tokens array<string>")
    d = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), ("c", [])], "doc_key string, tokens array<string>")
    assert [r["doc_key"] for r in retrieval.rerank(fused, q, d).orderBy("rank").collect()] == ["a", "b", "c"]


def test_rounds_solutions_sentences(spark):
    r = spark.createDataFrame([("q", 1, "a", 0.5, 1), ("q", 2, "a", 0.5, 1), ("q", 2, "b", 0.9, 2), ("q", 1, "c", 0.1, 3)], "query_id string, round int, doc_key string, score double, rank int")
    assert rows(retrieval.merge_rounds(r, 2).select("doc_key", "round", "rank"), "rank") == [("b", 2, 1), ("a", 1, 2)]
    s = spark.createDataFrame([(1, "M", "pump fault 16#80c8", 1), (2, "", "pump fault 16#80c8", 1), (3, "X", "pump fault 16#80c8", 1), (4, "M", "pump fault", 0), (5, None, None, 1)], "id long, model string, problem string, verified int")
    q = spark.createDataFrame([("a", "M", "fault of pump 16#80c8"), ("b", "M", "other"), ("c", "", None)], "query_id string, model string, question string")
    assert rows(retrieval.similar_solutions(q, s).select("query_id", "solution_id")) == [("a", 2)]
    h = spark.createDataFrame([("q", "valve pressure", 1, "The valve holds pressure well. Short."), ("q", "valve pressure", 2, "the valve holds  pressure well. valve pressure is measured here daily")], "query_id string, question string, rank int, text string")
    h = h.select("*", F.lit("d").alias("doc_key"), F.lit(None).cast("string").alias("doc_name"), F.lit("").alias("representation"))
    got = retrieval.best_sentences(h).orderBy("place").collect()
    assert [x["sentence"] for x in got] == ["The valve holds pressure well.", "valve pressure is measured here daily"]


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([("q1", "a", 2), ("q1", "b", 1), ("q2", "z", 1)], "query_id string, doc_key string, rank int")
    gold = spark.createDataFrame([("q1", "a"), ("q1", "a"), ("q2", "x"), ("q2", "z"), ("q3", "y")], "query_id string, doc_key string")
    got = {r["query_id"]: r for r in metrics.ranking_rows(hits, gold).collect()}
    assert (got["q1"]["strict_recall"], got["q1"]["mrr"], got["q1"]["top1"]) == (1, 0.5, 0)
    assert abs(got["q1"]["ndcg"] - 1 / math.log2(3)) < 1e-8
    assert (got["q2"]["recall"], got["q2"]["hit"], got["q2"]["top1"]) == (0.5, 1, 1)
    assert (got["q3"]["recall"], got["q3"]["mrr"], got["q3"]["ndcg"]) == (0.0, 0.0, 0.0)


def test_lookups(spark):
    codes = spark.createDataFrame([(2, "16#80C8", "", "x"), (1, "80c8", "M", "y"), (3, "0x9", "N", "z")], "no int, code string, model string, title string")
    q = spark.createDataFrame([("a", "80C8", "M"), ("b", "W#16#80c8", "O"), ("c", "9", "M"), ("d", None, "M")], "query_id string, code string, model string")
    assert rows(lookup.lookup_codes(q, codes).select("query_id", "title"), "query_id") == [("a", "y"), ("b", "x")]
    texts = spark.createDataFrame([(1, "set MB_DATA_LEN now"), (2, "none"), (3, None), (4, "xport y")], "text_id int, text string")
    names = spark.createDataFrame([(1, "mb_data"), (2, "MB_DATA_LEN"), (3, "port"), (4, ""), (5, None), (6, "pO")], "name_id int, name string")
    assert rows(lookup.names_in_texts(texts, names), "text_id") == [(1, 2, "MB_DATA_LEN"), (4, 3, "port")]
    store = spark.createDataFrame([("c1", "A=16#80", "M", "V4.2"), ("c2", "b", "", "4.1"), ("c3", "A=16#80", "O", None)], "chunk_id string, text string, model string, version string")
    asked = spark.createDataFrame([("1", "code 16#80 V4.2", "M"), ("2", "a=16", ""), ("3", " ", "M"), ("4", None, None)], "query_id string, query string, model string")
    assert rows(lookup.lookup_rows(asked, store, 99).select("query_id", "place", "chunk_id"), "query_id", "place") == [("1", 1, "c1"), ("2", 1, "c1"), ("2", 2, "c3"), ("3", 1, "c1"), ("3", 2, "c2"), ("4", 1, "c1"), ("4", 2, "c2"), ("4", 3, "c3")]
    assert lookup.lookup_rows(asked, store, 0).where("query_id = '2'").count() == 1 and lookup.lookup_rows(asked, store.limit(0)).count() == 0
    like = lookup.names_like(spark.createDataFrame([("a", " data_"), ("b", "zz"), ("c", "")], "query_id string, text string"), names)
    assert rows(like) == [("a", 1, "mb_data")] or rows(like) == [("a", 2, "MB_DATA_LEN")]
    parameters = spark.createDataFrame([(1, "MB_LEN", ["length"], ""), (2, "MB_LEN_MAX", None, "N"), (3, "MB_LEN_MAX", None, "M")], "parameter_id long, name string, aliases array<string>, model string")
    ask = spark.createDataFrame([("a", "set mb_len_max", "M"), ("b", "the LENGTH", "M"), ("c", "b_le", "M"), ("d", "none", "M"), ("e", None, None)], "query_id string, text string, model string")
    assert rows(lookup.lookup_parameters(ask, parameters), "query_id") == [("a", True, "in text", 3), ("b", True, "in text", 1), ("c", True, "like", 1), ("d", False, None, None), ("e", False, None, None)]
    assert rows(lookup.refused_references(spark.createDataFrame([(1, ["c1"]), (2, ["x", "c1", None, "a"])], "id long, g array<string>"), store, "g")) == [(2, ["a", "x"])]
    ids = spark.createDataFrame([("q", ["c2", "zz", "c1"])], "query_id string, ids array<string>")
    assert [r["chunk_id"] for r in lookup.by_ids(ids, store).orderBy("place").collect()] == ["c2", "c1"]
    gold = spark.createDataFrame([("r", ["c1", "x", "c2", None])], "id string, g array<string>")
    assert rows(lookup.missing_gold(gold, store, "g")) == [("r", "x")]
    assert rows(lookup.gathered_texts(gold.withColumn("g", F.slice("g", 1, 3)), store, "g")) == [("r", "A=16#80\n\nb")]


def test_graph(spark):
    nodes = spark.createDataFrame([("n1", "One", ["uno"]), ("n2", "Two", None), ("n5", "", [""])], "node_id string, label string, aliases array<string>")
    edges = spark.createDataFrame([("e1", "n1", "r", "n2"), ("e2", "n3", "r", "n1"), ("e3", "n3", "r", "n4")], "edge_id string, source string, relation string, target string")
    texts = spark.createDataFrame([("t", "UNO and two"), ("u", "zip"), ("v", None)], "text_id string, text string")
    relations, terms = lookup.expand_graph(texts, nodes, edges)
    assert rows(relations.select("text_id", "source", "target"), "edge_id") == [("t", "One", "Two"), ("t", "n3", "One")]
    assert rows(terms) == [("t", ["n1", "n2"], ["One", "n3"])]


def test_names_of_any_number(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Zel_1 zel_12"), (2, "a b"), (3, "zel_"), (4, ""), (5, None), (6, "xİß 阀b")], "text_id int, text string")
    names = spark.createDataFrame([(1, "zel_1"), (2, "ZEL_12"), (3, "zel_123"), (4, "b"), (5, " B"), (6, ""), (7, None), (8, "b"), (9, "阀"), (1, "zel_1")], "name_id int, name string")
    want = [(1, 1, "zel_1"), (1, 2, "ZEL_12"), (2, 4, "b"), (2, 5, " B"), (2, 8, "b"), (6, 4, "b"), (6, 8, "b"), (6, 9, "阀")]
    assert rows(lookup.names_contained(texts, names), "text_id", "name_id") == want
    monkeypatch.setattr(lookup, "SENT_NAMES", 3)
    assert rows(lookup.names_contained(texts, names), "text_id", "name_id") == want


def test_row_lookup_is_the_first_of_all_that_fit(spark, monkeypatch):
    r = random.Random(3)
    words = ["the", "16#80", "ab.c", "valve", "x_1"]
    store = [(f"c{i:03d}", " ".join(r.sample(words, 2)), r.choice(["M", "O", "", None]), r.choice(["V4.2", "v14.2", "3.0", None])) for i in range(80)]
    asked = [(f"q{i:02d}", r.choice([" ".join(r.sample(words, r.randint(1, 3))), "valve V4.2", "ab.c 14.2", "the 9.9", "3.0", ""]), r.choice(["M", "O", "P", "", None])) for i in range(60)]
    want = []
    for q, text, m in asked:
        v = next(iter(re.findall(r"V?\d+(?:\.\d+)+", text)), "").lower()
        terms = {text.strip().lower(), *(t.lower() for t in re.findall(r"16#[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9_#.-]+|[0-9]+(?:\.[0-9]+)+", text))} - {""}
        fit = [c for c, t, own, version in store if (not m or (own or "") in ("", m)) and v in (version or "").lower() and (not terms or any(x in t for x in terms))]
        want += [(q, n + 1, c) for n, c in enumerate(sorted(fit)[:3])]
    a, b = spark.createDataFrame(asked, "query_id string, query string, model string"), spark.createDataFrame(store + store[:9], "chunk_id string, text string, model string, version string")
    for most in (lookup.SENT_NAMES, 2):
        monkeypatch.setattr(lookup, "SENT_NAMES", most)
        assert rows(lookup.lookup_rows(a, b, 3).select("query_id", "place", "chunk_id"), "query_id", "place") == sorted(want)


def test_row_query_takes_every_question(spark, tmp_path):
    asked = [(f"aq_{i}", "the valve" if i % 2 else "Ventil?", "M") for i in range(1, 41)] + [("aq", "valve", "O")]
    store = [("c1", "a valve", "M", ("table_row",)), ("c2", "das Ventil? ja", "", ("table_row",)), ("c3", "valve", "M", ("narrative",))]
    spark.createDataFrame(asked, "id string, question string, model string").write.parquet(f"{tmp_path}/application_questions.parquet")
    spark.createDataFrame(store, "chunk_id string, text string, model string, metadata struct<representation:string>").select("*", F.lit("d").alias("doc_name"), F.lit("").alias("version")).write.parquet(f"{tmp_path}/chunks.parquet")
    got = rows(corpus.lookup_rows(spark, str(tmp_path)).select("query_id", "place", "chunk_id"), "query_id")
    assert got == sorted((q, 1, "c1" if "valve" in text else "c2") for q, text, m in asked if m == "M")
    con = duckdb.connect()
    for t in ("application_questions", "chunks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT query_id, place, chunk_id FROM ({corpus.SQL['lookup_rows']})").fetchall()) == got


def test_many_names_of_few_beginnings(spark, monkeypatch):
    """More names than are sent, whose beginnings are few: what passes their filter is looked up."""
    monkeypatch.setattr(lookup, "SENT_NAMES", 30)
    names = spark.range(500).select(F.col("id").alias("name_id"), F.concat(F.lit("Zel_"), F.col("id") * 7).alias("name")).unionByName(spark.createDataFrame([(900, "阀é")], "name_id long, name string"))
    texts = spark.range(300).select(F.col("id").alias("text_id"), F.concat(F.lit("x zel_"), F.col("id") * 5, F.lit(" 阀É")).alias("text"))
    want = sorted((i, k, f"Zel_{7 * k}") for i in range(300) for k in range(500) if str(5 * i).startswith(str(7 * k)))
    got = rows(lookup.names_contained(texts, names), "text_id", "name_id")
    assert sorted(got) == sorted([*want, *((i, 900, "阀é") for i in range(300))])


def test_row_lookup_of_common_words(spark):
    """Each query has a word with each row in common: 120 million pairs, of which five a query count."""
    store = spark.range(30_000).select(F.format_string("c%06d", "id").alias("chunk_id"), F.concat(F.lit("the valve "), "id").alias("text"), F.lit("").alias("model"))
    asked = spark.range(4_000).select("id", F.concat(F.lit("the port "), "id"), F.lit("M")).toDF("query_id", "query", "model")
    began = time.time()
    assert lookup.lookup_rows(asked, store).agg(F.count("*"), F.max("chunk_id")).first()[:] == (20_000, "c000004")
    assert time.time() - began < 45


def test_graph_of_hot_nodes(spark):
    """Names that begin alike, and a node that all texts name, with an edge to every other: pairs of texts and names or edges
    would be a hundred million."""
    n = 20_000
    ids = spark.range(n).select(F.format_string("zel_%06d", "id").alias("d"))
    nodes = ids.select(F.concat(F.lit("c:"), "d").alias("node_id"), F.col("d").alias("label"), F.array().cast("array<string>").alias("aliases")).union(spark.createDataFrame([("b:hub", "Zel", None)], "node_id string, label string, aliases array<string>"))
    edges = ids.select("d", F.concat(F.lit("c:"), "d"), F.lit("describes"), F.lit("b:hub")).toDF("edge_id", "source", "relation", "target")
    texts = spark.range(5_000).select("id", F.format_string("zel zel_%06d", F.col("id") * 3)).toDF("text_id", "text")
    began = time.time()
    relations, terms = lookup.expand_graph(texts, nodes, edges.union(edges))
    got = {r["text_id"]: r for r in terms.collect()}
    assert relations.count() == 60_000 and len(got) == 5_000
    assert got[2]["entities"] == ["b:hub", "c:zel_000006"] and got[2]["terms"] == [f"zel_{i:06d}" for i in (0, 1, 2, 3, 4, 5, 7, 8)]
    assert time.time() - began < 45


def test_graph_relations_of_texts_that_name_the_same(spark):
    """20,000 texts name two nodes of 5,000 edges each, among them repeats and one from a node to itself: of 200 million relations
    the first twelve of each text are left."""
    nodes = spark.createDataFrame([("n1", "Hub", None), ("n2", "Rim", ["wheel"])], "node_id string, label string, aliases array<string>")
    edges = spark.range(10_000).select(F.format_string("e%05d", "id"), F.when(F.col("id") % 2 == 0, "n1").otherwise("m"), F.lit("r"), F.when(F.col("id") % 2 == 0, "m").otherwise("n2")).toDF("edge_id", "source", "relation", "target")
    edges = edges.union(edges).union(spark.createDataFrame([("e00000b", "n1", "r", "n1"), ("e00000c", "n1", "r", "n2")], edges.schema))
    texts = spark.range(20_000).select("id", F.concat(F.lit("HUB and wheel "), "id")).toDF("text_id", "text")
    began = time.time()
    got = lookup.expand_graph(texts, nodes, edges)[0]
    each = got.groupBy("text_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "edge_id", "source", "target"))), ",").alias("r"))
    want = sorted(["e00000b Hub Hub", "e00000c Hub Rim", *(f"e{i:05d} {'m Rim' if i % 2 else 'Hub m'}" for i in range(10))])
    assert rows(each.groupBy("r").count()) == [(",".join(want), 20_000)]
    assert time.time() - began < 45


def test_graph_of_any_number_of_names_and_sets(spark, monkeypatch):
    """Sent or joined, names and sets give what a search of each text for each name gives; repeats of texts count once."""
    r = random.Random(5)
    words = ["zel", "zel_1", "zel_12", "zed", "a", "阀b"]
    nodes = [(f"n{i:02d}", r.choice([*words, None, ""]), r.choice([None, [r.choice(words).upper(), None]])) for i in range(30)]
    edges = [(f"e{i:03d}", f"n{r.randrange(33):02d}", "r", f"n{r.randrange(33):02d}") for i in range(90)]
    texts = [(i, " ".join(r.choice([*words, "ze", "12", "ZEL_123"]) for _ in range(3)).upper()) for i in range(60)]
    label = {n: t for n, t, _ in nodes if t is not None}
    want_relations, want_terms = [], []
    for i, t in texts:
        said = {n for n, x, more in nodes for w in [x, *(more or [])] if w and w.lower() in t.lower()}
        ids = sorted(said)[:4]
        if not ids:
            continue
        near = sorted({e for e in edges if {e[1], e[3]} & set(ids)})[:12]
        want_relations += [(i, e, label.get(a, a), k, label.get(b, b)) for e, a, k, b in near]
        new = dict.fromkeys(x for _, a, _, b in near for x in (label.get(a, a), label.get(b, b)) if x.lower() not in t.lower())
        want_terms.append((i, ids, list(new)[:8]))
    a = spark.createDataFrame(texts + texts[:20], "text_id int, text string")
    b = spark.createDataFrame(nodes, "node_id string, label string, aliases array<string>")
    c = spark.createDataFrame(edges, "edge_id string, source string, relation string, target string")
    for most_names, most_sets in ((200_000, 10_000), (4, 10_000), (2, 2)):  # 6 names with 3 beginnings
        monkeypatch.setattr(lookup, "SENT_NAMES", most_names)
        monkeypatch.setattr(lookup, "SENT_SETS", most_sets)
        relations, terms = lookup.expand_graph(a, b, c)
        assert rows(relations, "text_id", "edge_id") == want_relations
        assert rows(terms, "text_id") == want_terms


def test_graph_relations_are_written_by_several_tasks(spark):
    """A text is a few bytes but may get a dozen relations; adaptive execution left those of all texts to one task."""
    nodes = spark.createDataFrame([("n1", "Hub", None)], "node_id string, label string, aliases array<string>")
    edges = spark.range(12).select(F.format_string("e%02d", "id"), F.lit("n1"), F.lit("r"), F.lit("m")).toDF("edge_id", "source", "relation", "target")
    texts = spark.range(50_000).select("id", F.lit("the hub")).toDF("text_id", "text")
    tasks = lookup.expand_graph(texts, nodes, edges)[0].groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(t["count"] for t in tasks) == 600_000 and len(tasks) == 3


def test_graph_query_takes_every_chunk_of_a_manual(spark, tmp_path):
    """Chunks of one id that differ, and one without an id, count as in the SQL."""
    chunks = [("c1", "d1", "zed works", "M-1"), ("c1", "d1", " ALPHA co", "M-1"), ("c1", "d1", " ALPHA co", "M-1"), (None, "d2", "Zed works", "M-2"), ("c3", "d2", None, "A-1"), ("c4", "d2", "aa", "")]
    asked = [("q1", "what of alpha?", "M-2"), ("q2", "zed", None), ("q2", "zed", None), ("q3", "nothing", "")]
    spark.createDataFrame(chunks, "chunk_id string, doc_id string, manufacturer string, model string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame(asked, "id string, question string, device_model string").write.parquet(f"{tmp_path}/formal_questions.parquet")
    con = duckdb.connect()
    for t in ("chunks", "formal_questions"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("lookup_graph", "lookup_graph_terms"):
        got = corpus.QUERIES[name](spark, str(tmp_path))
        assert sorted(tuple(x) for x in got.collect()) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({corpus.SQL[name]})").fetchall())
    assert corpus.lookup_graph(spark, str(tmp_path)).count() == 4


def test_rate_limit(spark):
    t = D(2024, 1, 1)
    calls = [("k", i, t + dt.timedelta(seconds=s)) for i, s in enumerate((0, 1, 2, 61, 61.5, 62))] + [("m", 9, t), (None, 1, t), ("k", 99, None)]
    got = sessions.rate_limited(spark.createDataFrame(calls, "user string, id int, ts timestamp_ntz"), "user", "ts", "id", 2, 60)
    assert rows(got.select("user", "id", "allowed", "retry_after"), "user", "id") == [("k", 0, True, 0), ("k", 1, True, 0), ("k", 2, False, 58), ("k", 3, True, 0), ("k", 4, True, 0), ("k", 5, False, 59), ("m", 9, True, 0)]


def test_rate_limit_cuts_at_silences(spark):
    r, t = random.Random(2), D(2024, 1, 1)
    calls = [(r.choice("kkkm"), i, t + dt.timedelta(seconds=r.choice((r.randint(0, 900), r.randint(0, 90))))) for i in range(300)]
    got = {(k, i): ok for k, i, _, ok, _ in rows(sessions.rate_limited(spark.createDataFrame(calls, "user string, id int, ts timestamp_ntz"), "user", "ts", "id", 2, 20))}
    for k in "km":
        limiter = sessions.Limiter(2, 20)
        for _, i, at in sorted((c for c in calls if c[0] == k), key=lambda c: (c[2], c[1])):
            assert got[k, i] == limiter.check(at.timestamp())[0]


def test_cleared_and_appended(spark):
    turns = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "session_id string, id long")
    left, removed = sessions.cleared(turns, spark.createDataFrame([("a",), ("z",), (None,)], "session_id string"))
    assert rows(left) == [("b", 3)] and rows(removed, "session_id") == [("a", 2), ("z", 0)]
    new = spark.createDataFrame([("y",), ("x",)], "k string")
    assert rows(sessions.with_next_ids(turns, new, "k").select("id", "k"), "id") == [(4, "x"), (5, "y")]
    assert rows(sessions.with_next_ids(turns.limit(0), new, "k").select("id"), "id") == [(1,), (2,)]


def test_sessions(spark):
    t = D(2024, 1, 1)
    made = [(1, " S", "读取 A?", t), (2, "s", "那写呢", t + dt.timedelta(hours=1)), (3, "s", "还有", t + dt.timedelta(hours=30)), (3, "s", "还有", t + dt.timedelta(hours=30)), (4, None, "那", t), (5, " ", "那", t)]
    turns = sessions.turns_once(spark.createDataFrame(made, "id long, session_id string, question string, created_at timestamp_ntz"))
    assert turns.count() == 3
    got = {r["id"]: (r["query"], r["used"]) for r in sessions.followups(turns).collect()}
    assert got == {1: ("读取 A?", 0), 2: ("此前问题：写入 A?\n当前追问：那写呢", 1), 3: ("还有", 0)}
    assert rows(sessions.keep_last(turns, "session_id", "id", 2).select("id"), "id") == [(2,), (3,)]
    assert rows(sessions.keep_newest(turns, "session_id", "id").select("id")) == [(3,)]


def test_previous_across_segments(spark):
    df = spark.createDataFrame([("k", i) for i in range(1, 30)] + [("m", 7)], "k string, i long")
    for segment in (1, 3, 7, 1000):
        got = {(r["k"], r["i"]): (r["prev_1"], r["prev_2"]) for r in sessions.with_previous(df, "k", "i", F.col("i"), 2, segment).collect()}
        assert got == {("m", 7): (None, None)} | {("k", i): (i - 1 if i > 1 else None, i - 2 if i > 2 else None) for i in range(1, 30)}


def test_audits(spark):
    q = spark.createDataFrame([("a", "?", " ", True, []), ("b", None, "dev", False, ["x", "x ", " "]), ("c", "ok", "dev", True, ["y"]), ("d", "ok", "dev", None, None)], "id string, question string, split string, answerable boolean, gold_chunk_ids array<string>")
    got = {}
    for r in audit.violations(q, "id", audit.question_rules()).collect():
        got.setdefault(r["id"], set()).add(r["rule"])
    assert got == {"a": {"blank split", "answerable without gold"}, "b": {"blank question", "gold though unanswerable", "blank gold entry", "padded gold entry", "repeated gold entry"}}
    assert rows(audit.repeated_keys(spark.createDataFrame([("a",), ("a",), (None,)], "k string"), "k")) == [("a", 2)]
