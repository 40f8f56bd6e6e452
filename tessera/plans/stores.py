"""What is written as files and read again, tables of rows, records as text, and appended events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import answers, chunking, facts, lookup, retrieval, sessions
from tessera.operators.references import cleaned_ids, id_list
from tessera.plans.references import LISTED
from tessera.plans.retrieval import _SOLVED, _asked
from tessera.plans.texts import _first, _strip
from tessera.session import checkpoint, scratch_path
from tessera.sources import files
from tessera.sources.tables import table


def store_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines and read again."""
    path = scratch_path(spark, "chunks")
    files.write_chunks(table(spark, d, "chunks"), path)
    back = files.read_chunks(spark, path)
    return back.select("chunk_id", "page", F.array_join("section_path", " > ").alias("path"), F.md5("text").alias("digest"), F.array_join("metadata.headers", "|").alias("headers"), F.when(F.col("metadata.bbox").isNotNull(), F.size("metadata.bbox")).alias("box")).distinct()


def store_lines(spark: SparkSession, d: str) -> DataFrame:
    """Questions as JSON lines of which those without a reviewer are cut short: how many rows and broken lines are read."""
    path = scratch_path(spark, "lines")
    line = F.to_json(F.struct("id", "question", "split"))
    q = table(spark, d, "formal_questions").distinct()
    q.select(F.when(F.coalesce("reviewer", F.lit("")) == "", F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    good, bad = files.read_lines_with_errors(spark, path, "id string, question string, split string")
    return good.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids")).withColumn("broken", F.lit(bad.count()))


def store_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Solved problems as one JSON array, newest last, read as seeds: the last of each model."""
    path = f"{scratch_path(spark, 'seeds')}/seeds.json"
    rows = table(spark, d, "verified_solutions").select("id", F.coalesce("model", F.lit("")).alias("model"), F.substring("problem", 1, 40).alias("title"), cleaned_ids(id_list(F.col("source_chunk_ids"))).alias("ids")).distinct()
    array = rows.groupBy().agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "model", "title", "ids")))).alias("j")).first()["j"]  # a seed file is small
    files.write_file(spark, path, array.encode())
    return files.read_seeds(spark, path, "model").select("model", "id", "title", F.size("ids").alias("ids"))


def store_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nations and regions as one JSON object of nodes and edges, read again and joined."""
    path = f"{scratch_path(spark, 'graph')}/graph.json"
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label")).unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("label")))
    edges = n.select(F.concat(F.lit("e"), "n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    j = lambda df: df.groupBy().agg(F.to_json(F.collect_list(F.struct(*df.columns)))).first()[0]
    files.write_file(spark, path, f'{{"nodes": {j(nodes)}, "edges": {j(edges)}}}'.encode())
    a, b = files.read_graph(spark, path)
    return b.join(a.select(F.col("id").alias("source"), F.col("label").alias("source_label")), "source").join(a.select(F.col("id").alias("target"), F.col("label").alias("target_label")), "target").select("id", "source_label", "target_label")


def store_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces with credentials at several depths, appended in two batches: the newest twenty as they are read again."""
    path = scratch_path(spark, "traces")
    t = table(spark, d, "conversation_turns").select(
        "id", F.concat(F.lit("use Bearer abc"), "id", F.lit(" now")).alias("note"), F.lit("x").alias("api_key"), F.struct(F.lit("k").alias("Secret-Key"), F.array(F.struct(F.concat(F.lit("sk-"), "id").alias("text"), F.lit("p").alias("password"))).alias("calls")).alias("run")
    ).distinct()
    files.append_traces(t.where("id <= 100"), path)
    files.append_traces(t.where("id > 100"), path)
    schema = "id long, note string, api_key string, run struct<`Secret-Key`:string,calls:array<struct<text:string,password:string>>>"
    back = files.recent_traces(spark, path, schema, "id", 20).unionByName(files.trace(spark, path, schema, "id", 7))
    return back.select("id", "note", "api_key", F.col("run.Secret-Key").alias("secret"), F.col("run.calls")[0]["text"].alias("text"), F.col("run.calls")[0]["password"].alias("password"))


def _folder(spark: SparkSession, d: str) -> str:
    """A folder with a file for each nation: text, Markdown or HTML by its number, with one byte that is no UTF-8."""
    path = scratch_path(spark, "raw")
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():
        k, name = r["n_nationkey"], r["n_name"]
        ending, body = (("txt", f"plain {name}"), ("md", f"# {name}"), ("html", f"<h1> {name} </h1><p>a&amp;b</p>"))[k % 3]
        files.write_file(spark, f"{path}/Doc {name}.{ending}", body.encode() + b"\xff")
    return path


def store_files(spark: SparkSession, d: str) -> DataFrame:
    """The pages of a folder of files with what a manifest says of some, which leaves out one nation's."""
    n = table(spark, d, "nation")
    ending = F.element_at(F.array(F.lit("txt"), F.lit("md"), F.lit("html")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    manifest = n.where("n_regionkey = 1").select(F.concat(F.lit("Doc "), "n_name", F.lit("."), ending).alias("filename"), (F.col("n_nationkey") != 2).alias("ingest"), F.concat(F.lit("T "), "n_name").alias("title"))
    return files.read_documents(spark, _folder(spark, d), manifest).select("file_no", "filename", "doc_id", "page", "text", "title")


def store_facts(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and hashes of the files of a folder, and none that changed in between."""
    found = files.file_facts(spark, _folder(spark, d))
    same = files.unchanged(found.select("filename", "sha256"), found.select("filename", "sha256")).count()
    return found.select("filename", F.col("bytes").cast("long").alias("bytes"), "sha256").withColumn("changed", F.lit(same))


def store_report(spark: SparkSession, d: str) -> DataFrame:
    """A report of events by type as Markdown lines."""
    path = scratch_path(spark, "report")
    files.write_report(table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.text(f"{path}/markdown/head").select(F.col("value").alias("line")).unionByName(spark.read.text(f"{path}/markdown/rows").select(F.col("value").alias("line")))


def store_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest as a JSON list: those without a word on it are ingested."""
    path = f"{scratch_path(spark, 'manifest')}/sources.json"
    rows = table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()
    items = [f'{{"filename": "{r["r_name"]}"' + (f', "ingest": {"true" if r["r_regionkey"] == 1 else "false"}' if r["r_regionkey"] < 3 else "") + "}" for r in rows]
    files.write_file(spark, path, f"[{', '.join(items)}]".encode())
    return files.read_manifest(spark, path).select("filename", "ingest")


def store_cache(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables read through a cache that has the first documents already: how many rows of how many documents."""
    path = scratch_path(spark, "cache")
    rows = table(spark, d, "chunks").where("metadata.table_id is not null").select("doc_id", "chunk_id", F.col("metadata.headers").alias("headers"), "text").distinct()
    docs = rows.select("doc_id").distinct()
    extract = lambda new: rows.join(new.select("doc_id"), "doc_id", "left_semi")
    files.cached_rows(spark, path, docs.where("doc_id < 'o'"), extract).count()
    return files.cached_rows(spark, path, docs, extract).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))


def _tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables that chunks come from: a row of headers, then the cells of the rows' texts."""
    r = table(spark, d, "chunks").where("metadata.table_id is not null").select("chunk_id", F.col("metadata.table_id").alias("table_id"), F.col("metadata.table_title").alias("title"), F.col("metadata.headers").alias("headers"), "text").distinct()
    cells = F.transform(F.split(F.regexp_extract("text", r"(?s)\n[^：\n]*[：:] ?(.*)$", 1), "；"), lambda x: F.regexp_replace(x, "^[^=]*=", " "))
    rows = r.groupBy("table_id").agg(F.min("title").alias("title"), F.min("headers").alias("headers"), F.array_sort(F.collect_list(F.struct("chunk_id", cells.alias("cells")))).alias("rows"))
    return rows.where("headers is not null").select("table_id", "title", F.concat(F.array("headers"), F.transform("rows", lambda x: x["cells"])).alias("rows"))


def chunk_tables(spark: SparkSession, d: str) -> DataFrame:
    """The rows of proper tables as texts."""
    return chunking.table_rows(_tables(spark, d)).select("table_id", "row_index", F.array_join("headers", "|").alias("headers"), F.md5("text").alias("digest"))


def chunk_titles(spark: SparkSession, d: str) -> DataFrame:
    """The nearest title above each table's box among the boxes and titles of its document."""
    t = table(spark, d, "chunks").where("metadata.table_id is not null and metadata.bbox is not null").groupBy("doc_id", F.col("metadata.table_id").alias("table_id")).agg(F.min("metadata.bbox").alias("box"), F.min("metadata.table_title").alias("title"))
    t = checkpoint(t.select("doc_id", "table_id", F.get("box", F.lit(1)).alias("top"), F.get("box", F.lit(3)).alias("y1"), F.col("title").alias("text")))
    return chunking.nearest_titles(t.select("doc_id", "table_id", "top"), t.select("doc_id", "y1", "text")).select("table_id", "title")


def text_html(spark: SparkSession, d: str) -> DataFrame:
    """The text nodes of pages made of documents: their type as a heading, a script, and their text with marks escaped."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><h1> "), F.coalesce("doc_type", F.lit("")), F.lit(" </h1><script>x = 1</script><p>"), escaped, F.lit("</p></html>"))
    return table(spark, d, "documents").select("doc_id", F.md5(files.html_text(page)).alias("digest")).distinct()


def text_release(spark: SparkSession, d: str) -> DataFrame:
    """What forbids documents to be published under made-up paths, with secrets put into some, and marks in their logs."""
    kind, place = F.coalesce("doc_type", F.lit("")), F.concat(F.lit("out/"), F.coalesce("source", F.lit("")))
    path = F.when(kind == "ticket", F.concat(F.lit("data/raw/"), "doc_id")).when(kind == "faq_entry", F.concat(place, F.lit("/.env.example"))).when(kind == "manual_page", F.concat(place, F.lit("/a.PDF"))).otherwise(F.concat(place, F.lit("/models.txt")))
    secret = F.when(F.col("lang") == "de", "key sk-abcdefghijklmn").when(F.col("lang") == "fr", "Authorization: Bearer abcdefghijklmnopqrstu").when(F.col("lang") == "es", "https://me:pw@host/").otherwise("")
    content = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce(secret, F.lit("")))
    rows = table(spark, d, "documents").select(F.array_join(T.release_faults(path, content), ", ").alias("faults"), F.array_join(T.log_secrets(content), ", ").alias("marks"), "doc_id").distinct()
    return rows.groupBy("faults", "marks").agg(F.count(F.lit(1)).alias("documents"))


def record_texts(spark: SparkSession, d: str) -> DataFrame:
    """Alarms, parameters and solutions as text, those without a record too."""
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(F.col("p_size") > 5, F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("minimum"), F.col("p_retailprice").alias("maximum"), F.lit("V").alias("unit"), F.col("p_type").alias("notes"), F.col("p_brand").alias("source"))).alias("r"), F.when(F.col("p_size") > 10, F.col("p_size") * 40.5).alias("v"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.when(F.col("s_nationkey") > 3, F.struct(F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("title"), F.lit("m").alias("meaning"), F.array(F.lit("a"), F.lit(""), F.lit("b")).alias("causes"), F.array(F.lit("c")).alias("checks"), F.lit(None).cast("string").alias("source"))).alias("r"))
    asked = _asked(spark, d, "application_questions").select("query_id", F.coalesce("model", F.lit("")).alias("model"), "question").distinct()
    solutions = table(spark, d, "verified_solutions").select("id", "model", "problem", "solution", "verified").distinct()
    found = asked.select("query_id").join(retrieval.similar_solutions(asked, solutions), "query_id", "left").join(solutions.withColumnRenamed("id", "solution_id"), "solution_id", "left")
    v = found.select("query_id", F.when(F.col("solution_id").isNotNull(), F.struct(F.col("solution_id").alias("id"), "similarity", "problem", "solution")).alias("r"))
    return p.select("id", answers.parameter_text(F.col("r"), F.col("v")).alias("text")).unionByName(s.select("id", answers.alarm_text(F.col("r")).alias("text"))).unionByName(v.select(F.col("query_id").alias("id"), answers.solution_text(F.col("r")).alias("text")))


def record_places(spark: SparkSession, d: str) -> DataFrame:
    """Where each chunk comes from, as far as it says."""
    c = table(spark, d, "chunks").select("chunk_id", F.col("source_url").alias("source"), "doc_name", "page", "section_path", F.col("metadata.table_id").alias("table_id"), F.col("metadata.row_index").alias("row_index")).distinct()
    return c.select("chunk_id", F.array_join(F.transform(F.map_entries(answers.provenance(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("places"))


def record_ids(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that application questions list, in their order; unknown ones left out."""
    q = table(spark, d, "application_questions").select(F.col("id").alias("query_id"), cleaned_ids(F.col("gold_chunk_ids")).alias("ids")).distinct()
    return lookup.by_ids(q, table(spark, d, "chunks").select("chunk_id", "page").distinct()).select("query_id", "place", "chunk_id", "page")


def record_refused(spark: SparkSession, d: str) -> DataFrame:
    """Turns that could not be saved as solutions, with the chunks they name that don't exist."""
    q = table(spark, d, "conversation_turns").select("id", cleaned_ids(id_list(F.col("source_chunk_ids"))).alias("ids")).distinct()
    return lookup.refused_references(q, table(spark, d, "chunks"), "ids").select("id", F.array_join("unknown", " ").alias("unknown"))


def record_appended(spark: SparkSession, d: str) -> DataFrame:
    """Removals appended to the solved problems as events: their ids go on."""
    new = table(spark, d, "removed_chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.max("reason").alias("reason"))
    return sessions.with_next_ids(table(spark, d, "verified_solutions"), new, "chunk_id").select("id", "chunk_id", "reason")


def record_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Formal questions with the status and scope that application questions of the same number have."""
    keep = lambda name, prefix: table(spark, d, name).select(F.replace("id", F.lit(prefix), F.lit("")).alias("id"), "review_status", "source_scope").distinct()
    return facts.with_overrides(keep("formal_questions", "fq_"), keep("application_questions", "aq_").withColumn("source_scope", F.when(F.col("source_scope") == "official_manual", F.col("source_scope"))), ["id"])


def record_deltas(spark: SparkSession, d: str) -> DataFrame:
    """How the shares of expected tools differ between the two sets of questions."""
    share = lambda name: table(spark, d, name).select("id", "expected_tool").distinct().groupBy(F.col("expected_tool").alias("metric")).agg(F.count(F.lit(1)).alias("n")).select("metric", (F.col("n") / F.lit(table(spark, d, name).select("id").distinct().count())).alias("value"))
    found = facts.deltas(share("formal_questions"), share("application_questions"))
    return found.select("metric", F.round("delta", 6).alias("delta"))


def session_cleared(spark: SparkSession, d: str) -> DataFrame:
    """What clearing the demo session and one that doesn't exist removes, and what is left."""
    turns = sessions.turns_once(table(spark, d, "conversation_turns").select("id", "session_id"))
    left, removed = sessions.cleared(turns, spark.createDataFrame([("demo",), ("nobody",), (None,)], "session_id string"))
    return removed.withColumn("left", F.lit(left.count()))


QUERIES = {
    f.__name__: f
    for f in (
        store_chunks, store_lines, store_seeds, store_graph, store_traces, store_files, store_facts, store_report, store_manifest, store_cache, chunk_tables, chunk_titles, text_html, text_release, record_texts, record_places,
        record_ids, record_refused, record_appended, record_overrides, record_deltas, session_cleared,
    )
}

_DOC = "SELECT n_nationkey AS k, n_regionkey AS r, 'Doc ' || n_name || ['.txt', '.md', '.html'][n_nationkey % 3 + 1] AS filename, ['plain ' || n_name, '# ' || n_name, '<h1> ' || n_name || ' </h1><p>a&amp;b</p>'][n_nationkey % 3 + 1] AS body, n_name FROM nation"
_CELLS = "list_transform(string_split(regexp_extract(text, '(?s)\\n[^：\\n]*[：:] ?(.*)$', 1), '；'), lambda x: regexp_replace(x, '^[^=]*=', ' '))"
_CLEAN = lambda x: f"coalesce({_strip(f"regexp_replace({x}, '{L.WS}+', ' ', 'g')")}, '')"
_RELEASE = ", ".join(f"CASE WHEN regexp_matches(c, '{rx}') THEN '{n}' END" for n, rx in L.RELEASE_SECRETS)
_NUM = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"

SQL = {
    "store_chunks": "SELECT DISTINCT chunk_id, page, array_to_string(section_path, ' > ') AS path, md5(text) AS digest, array_to_string(metadata.headers, '|') AS headers, len(metadata.bbox) AS box FROM chunks",
    "store_lines": "WITH q AS (SELECT DISTINCT * FROM formal_questions) SELECT count_if(coalesce(reviewer, '') <> '') AS rows, count(DISTINCT CASE WHEN coalesce(reviewer, '') <> '' THEN id END) AS ids, count_if(coalesce(reviewer, '') = '') AS broken FROM q",
    "store_seeds": f"SELECT coalesce(model, '') AS model, id, substr(problem, 1, 40) AS title, coalesce(len({LISTED}), 0) AS ids FROM verified_solutions QUALIFY row_number() OVER (PARTITION BY coalesce(model, '') ORDER BY id DESC) = 1",
    "store_graph": "SELECT 'e' || n_nationkey AS id, n_name AS source_label, r_name AS target_label FROM nation JOIN region ON n_regionkey = r_regionkey",
    "store_traces": "WITH t AS (SELECT DISTINCT id FROM conversation_turns WHERE id IS NOT NULL), r AS (SELECT * FROM (SELECT id FROM t ORDER BY id DESC LIMIT 20) UNION ALL SELECT id FROM t WHERE id = 7) SELECT id, 'use [REDACTED] now' AS note, NULL AS api_key, NULL AS secret, '[REDACTED]' AS text, NULL AS password FROM r",
    "store_files": f"""WITH f AS ({_DOC}), kept AS (SELECT * FROM f WHERE k <> 2 OR r <> 1)
SELECT row_number() OVER (ORDER BY replace(filename, ' ', '%20')) AS file_no, filename, replace(lower(regexp_replace(filename, '\\.[^.]*$', '')), ' ', '_') || '_' || substr(sha1(CAST(encode(body) || '\\xFF'::BLOB AS BLOB)), 1, 10) AS doc_id, 1 AS page,
  CASE WHEN k % 3 = 2 THEN n_name || chr(10) || 'a&b' ELSE body END AS text, CASE WHEN r = 1 THEN 'T ' || n_name END AS title FROM kept""",
    "store_facts": f"SELECT filename, octet_length(encode(body)) + 1 AS bytes, sha256(CAST(encode(body) || '\\xFF'::BLOB AS BLOB)) AS sha256, 0 AS changed FROM ({_DOC})",
    "store_report": "SELECT '| event_type | n |' AS line UNION ALL SELECT '|-|-|' UNION ALL SELECT '| ' || event_type || ' | ' || count(*) || ' |' FROM events GROUP BY event_type",
    "store_manifest": "SELECT r_name AS filename, r_regionkey = 1 OR r_regionkey >= 3 AS ingest FROM region",
    "store_cache": "WITH r AS (SELECT DISTINCT doc_id, chunk_id, metadata.headers AS h, text FROM chunks WHERE metadata.table_id IS NOT NULL) SELECT doc_id, count(*) AS rows FROM r WHERE NOT regexp_matches(lower(concat_ws(' ', array_to_string(h, ' '), coalesce(text, ''))), 'http://|https://|www\\.') GROUP BY 1",
    "chunk_tables": f"""WITH r AS (SELECT DISTINCT chunk_id, metadata.table_id AS table_id, metadata.table_title AS title, metadata.headers AS headers, text FROM chunks WHERE metadata.table_id IS NOT NULL),
t AS (SELECT table_id, min(title) AS title, min(headers) AS headers, list({_CELLS} ORDER BY chunk_id) AS data FROM r GROUP BY 1),
c AS (SELECT table_id, title, list_filter(list_transform(list_concat([headers], data), lambda row: list_transform(row, lambda x: {_CLEAN('x')})), lambda row: len(row) > 0) AS g FROM t WHERE headers IS NOT NULL),
f AS (SELECT *, list_max(list_transform(g, lambda row: len(row))) AS w, list_transform(g, lambda row: len(list_filter(row, lambda x: x <> ''))) AS n FROM c),
ok AS (SELECT *, list_transform(range(1, w + 1), lambda i: CASE WHEN coalesce(g[1][i], '') = '' THEN 'column_' || i ELSE g[1][i] END) AS base, CASE WHEN len(g) > 1 THEN g[2:] ELSE g END AS body FROM f
  WHERE w >= 2 AND len(list_filter(n, lambda x: x >= 2)) >= 2 AND list_sum(n) / (len(g) * w) >= 0.25 AND NOT regexp_matches(lower(array_to_string(flatten(g), ' ')), 'http://|https://|www\\.')),
h AS (SELECT *, list_transform(base, lambda x, i: x || CASE WHEN len(list_filter(base[1:i - 1], lambda y: y = x)) > 0 THEN '_' || (len(list_filter(base[1:i - 1], lambda y: y = x)) + 1) ELSE '' END) AS head FROM ok),
e AS (SELECT table_id, title, head, unnest(range(1, len(body) + 1)) AS row_index, unnest(body) AS cells FROM h),
p AS (SELECT *, list_filter(list_transform(range(1, len(head) + 1), lambda i: CASE WHEN coalesce(cells[i], '') <> '' THEN head[i] || '=' || cells[i] END), lambda x: x IS NOT NULL) AS pairs FROM e)
SELECT table_id, row_index, array_to_string(head, '|') AS headers, md5(title || chr(10) || '表格行：' || array_to_string(pairs, '；')) AS digest FROM p WHERE len(pairs) > 0""",
    "chunk_titles": f"""WITH t AS (SELECT doc_id, metadata.table_id AS table_id, min(metadata.bbox) AS box, min(metadata.table_title) AS title FROM chunks WHERE metadata.table_id IS NOT NULL AND metadata.bbox IS NOT NULL GROUP BY 1, 2),
b AS (SELECT a.table_id, b.box[4] AS y1, {_strip("coalesce(b.title, '')")} AS text FROM t a JOIN t b USING (doc_id) WHERE b.box[4] <= a.box[2] AND a.box[2] - b.box[4] <= 90),
n AS (SELECT table_id, text FROM b WHERE text <> '' AND length(text) <= 160 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY y1 DESC, text) = 1)
SELECT t.table_id, coalesce(n.text, '') AS title FROM t LEFT JOIN n USING (table_id)""",
    "text_html": f"SELECT DISTINCT doc_id, md5(array_to_string(list_filter([{_strip("coalesce(doc_type, '')")}, 'x = 1', {_strip('text')}], lambda x: x <> ''), chr(10))) AS digest FROM documents",
    "text_release": f"""WITH d AS (SELECT DISTINCT doc_id, coalesce(doc_type, '') AS kind, coalesce(text, '') || ' ' || CASE lang WHEN 'de' THEN 'key sk-abcdefghijklmn' WHEN 'fr' THEN 'Authorization: Bearer abcdefghijklmnopqrstu' WHEN 'es' THEN 'https://me:pw@host/' ELSE '' END AS c FROM documents),
f AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN kind IN ('ticket', 'manual_page') THEN 'path' END, {_RELEASE}], lambda x: x IS NOT NULL), ', ') AS faults, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(c, '{rx}') THEN '{n}' END" for n, rx in L.LOG_SECRETS)}], lambda x: x IS NOT NULL), ', ') AS marks FROM d)
SELECT faults, marks, count(*) AS documents FROM f GROUP BY 1, 2""",
    "record_texts": f"""WITH {_SOLVED},
p AS (SELECT p_partkey, p_name, CAST(p_size AS DOUBLE) AS lo, p_retailprice AS hi, p_type, p_brand, p_size, CASE WHEN p_size > 10 THEN p_size * CAST(40.5 AS DOUBLE) END AS v FROM part),
v AS (SELECT DISTINCT id, problem, solution FROM verified_solutions)
SELECT 'p' || p_partkey AS id, CASE WHEN p_size > 5 THEN '参数 ' || p_name || '：允许范围 ' || {_NUM('lo')} || '到' || {_NUM('hi')} || ' V。' || p_type || coalesce(' 当前值 ' || CAST(v AS VARCHAR) || ' V ' || CASE WHEN lo <= v AND v <= hi THEN '在' ELSE '不在' END || '该演示数据范围内。', '') || ' 结构化来源：' || p_brand ELSE '{L.PARAMETER_UNKNOWN}' END AS text FROM p
UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_nationkey > 3 THEN '故障码 ' || s_suppkey || '：' || s_name || '。m' || chr(10) || '可能原因：a；b' || chr(10) || '建议核对：c' || chr(10) || '结构化来源：' ELSE '{L.ALARM_UNKNOWN}' END FROM supplier
UNION ALL SELECT q.query_id, CASE WHEN g.id IS NULL THEN '' ELSE '已找到经用户确认的历史方案（方案ID ' || g.id || '，相似度 ' || round(g.s, 4) || '）：' || chr(10) || '历史问题：' || v.problem || chr(10) || '已验证方案：' || v.solution || chr(10) || '{L.SOLUTION_NOTE}' END FROM (SELECT DISTINCT query_id FROM q) q LEFT JOIN good g USING (query_id) LEFT JOIN v ON v.id = g.id""",
    "record_places": """WITH c AS (SELECT DISTINCT chunk_id, source_url, doc_name, page, section_path, metadata.table_id AS t, metadata.row_index AS r FROM chunks)
SELECT chunk_id, concat_ws('|', 'chunk_id=' || nullif(chunk_id, ''), 'source=' || nullif(source_url, ''), 'doc_name=' || nullif(doc_name, ''), 'page=' || page, 'section_path=' || nullif(array_to_string(section_path, ' > '), ''), 'table_id=' || nullif(t, ''), 'row_index=' || r) AS places FROM c""",
    "record_ids": f"""WITH q AS (SELECT DISTINCT id, list_filter(list_transform(gold_chunk_ids, lambda x: {_strip('x')}), lambda x: x <> '' AND lower(x) <> 'null') AS ids FROM application_questions),
u AS (SELECT id, {_first('ids')} AS ids FROM q), e AS (SELECT id, unnest(range(0, len(ids))) AS place, unnest(ids) AS chunk_id FROM u)
SELECT id AS query_id, place, chunk_id, page FROM e JOIN (SELECT DISTINCT chunk_id, page FROM chunks) USING (chunk_id)""",
    "record_refused": f"""WITH q AS (SELECT DISTINCT id, {LISTED} AS ids FROM conversation_turns), e AS (SELECT DISTINCT id, unnest(ids) AS c FROM q)
SELECT id, string_agg(c, ' ' ORDER BY c) AS unknown FROM e WHERE c NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) GROUP BY 1""",
    "record_appended": "SELECT (SELECT max(id) FROM verified_solutions) + row_number() OVER (ORDER BY chunk_id) AS id, chunk_id, max(reason) AS reason FROM removed_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id",
    "record_overrides": """WITH f AS (SELECT DISTINCT replace(id, 'fq_', '') AS id, review_status, source_scope FROM formal_questions), a AS (SELECT DISTINCT replace(id, 'aq_', '') AS id, review_status AS r, CASE WHEN source_scope = 'official_manual' THEN source_scope END AS s FROM application_questions)
SELECT id, coalesce(r, review_status) AS review_status, coalesce(s, source_scope) AS source_scope FROM f LEFT JOIN a USING (id)""",
    "record_deltas": """WITH f AS (SELECT expected_tool, count(DISTINCT id) / (SELECT count(DISTINCT id) FROM formal_questions) AS v FROM formal_questions GROUP BY 1), a AS (SELECT expected_tool, count(DISTINCT id) / (SELECT count(DISTINCT id) FROM application_questions) AS v FROM application_questions GROUP BY 1)
SELECT expected_tool AS metric, round(f.v - a.v, 6) AS delta FROM f JOIN a USING (expected_tool)""",
    "session_cleared": f"""WITH t AS (SELECT DISTINCT id, lower({_strip('session_id')}) AS s FROM conversation_turns WHERE {_strip('session_id')} <> '')
SELECT n AS session_id, (SELECT count(*) FROM t WHERE s = n) AS removed, (SELECT count(*) FROM t WHERE s <> 'demo') AS left FROM (SELECT unnest(['demo', 'nobody']) AS n)""",
}
