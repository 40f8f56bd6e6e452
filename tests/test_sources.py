"""Readers and writers round trip."""

import json

from tessera.sources import files


def test_documents(spark, tmp_path):
    (tmp_path / "My Note.txt").write_bytes(b"he\xffllo")
    (tmp_path / "p.html").write_text("<h1> T </h1><script>x=1</script><p>a&amp;b</p>")
    (tmp_path / "skip.md").write_text("# no")
    (tmp_path / "x.bin").write_bytes(b"\0")
    (tmp_path / "f.pdf").write_bytes(b"one page that is long enough to stay|short")
    manifest = spark.createDataFrame([("skip.md", False, "S"), ("p.html", True, "T")], "filename string, ingest boolean, title string")
    got = {r["filename"]: r for r in files.read_documents(spark, str(tmp_path), manifest, lambda b: b.decode().split("|")).collect()}
    assert set(got) == {"My Note.txt", "p.html", "f.pdf"}
    assert got["My Note.txt"]["text"] == "hello" and [got[k]["title"] for k in ("p.html", "f.pdf")] == ["T", None] and sorted(r["file_no"] for r in got.values()) == [1, 2, 3]
    assert got["p.html"]["text"] == "T\nx=1\na&b" and got["My Note.txt"]["doc_id"].startswith("my_note_")
    assert {r["filename"] for r in files.file_facts(spark, str(tmp_path)).collect()} >= {"p.html", "x.bin"}


def test_lines_and_seeds(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('\ufeff{"id": "a"}\n\nnot json\n{"id": "b"}\n')
    good, bad = files.read_lines_with_errors(spark, str(p), "id string")
    assert sorted(r["id"] for r in good.collect()) == ["a", "b"] and [r["line"] for r in bad.collect()] == ["not json"]
    s = tmp_path / "s.json"
    s.write_text(json.dumps([{"code": "1", "t": "old", "c": ["x"]}, {"code": "1", "t": "new", "c": ["y"]}]))
    assert [(r["t"], r["c"]) for r in files.read_seeds(spark, str(s), "code").collect()] == [("new", ["y"])]
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"nodes": [{"id": "n"}], "edges": [{"id": "e", "source": "n"}]}))
    nodes, edges = files.read_graph(spark, str(g))
    assert nodes.count() == 1 and edges.first()["source"] == "n"


def test_traces_chunks_tables(spark, tmp_path):
    t = spark.createDataFrame([("1", "k", "use sk-abc now", ("p", [{"Api-Key": "x", "b": "sk-1"}]))], "id string, api_key string, note string, run struct<password:string,calls:array<map<string,string>>>")
    files.append_traces(t, str(tmp_path / "t"))
    (tmp_path / "t" / "bad.json").write_text("{broken\n")
    deep = files.trace(spark, str(tmp_path / "t"), "id string, run struct<password:string,calls:array<map<string,string>>>", "id", "1").first()["run"]
    assert deep["password"] is None and deep["calls"] == [{"b": "[REDACTED]"}]
    got = files.recent_traces(spark, str(tmp_path / "t"), "id string, api_key string, note string", "id").collect()
    assert [(r["id"], r["api_key"], r["note"]) for r in got] == [("1", None, "use [REDACTED] now")]
    c = spark.createDataFrame([("c", "d", "text")], "chunk_id string, doc_id string, text string")
    files.write_chunks(c, str(tmp_path / "c"))
    assert files.read_chunks(spark, str(tmp_path / "c")).select("chunk_id", "text").first() == ("c", "text")
    assert files.read_pointed(spark, str(tmp_path / "v")) is None
    files.write_pointed(c, str(tmp_path / "v"), "a")
    files.write_pointed(c.unionByName(c), str(tmp_path / "v"), "b")
    assert files.read_pointed(spark, str(tmp_path / "v")).count() == 2
    files.write_report(c, str(tmp_path / "r"))
    assert files.read_report(spark, str(tmp_path / "r")).splitlines() == ["| chunk_id | doc_id | text |", "|-|-|-|", "| c | d | text |"]
    seen = []
    rows = spark.createDataFrame([("d", ["h"], "a"), ("d", ["see www.x"], "b"), ("e", None, "c")], "doc_id string, headers array<string>, text string")
    extract = lambda new: seen.append(new.count()) or rows.join(new.select("doc_id"), "doc_id", "left_semi")
    for want in (["a"], ["a"]):
        assert [r["text"] for r in files.cached_rows(spark, str(tmp_path / "k"), rows.select("doc_id").where("doc_id = 'd'").distinct(), extract).collect()] == want
    assert seen == [1, 0]
