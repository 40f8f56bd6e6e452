"""Readers and writers of files: documents, pages, chunks, seeds, traces and reports."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.running import running_before

CHUNK_SCHEMA = (
    "chunk_id string, doc_id string, doc_name string, text string, page int, section_path array<string>, manufacturer string, model string, version string, source_url string, "
    "metadata struct<filename:string,license_note:string,representation:string,table_id:string,table_index:int,row_index:int,headers:array<string>,table_title:string,bbox:array<double>,released_at:string,checked_at:string,status:string>"
)
KINDS = ("pdf", "txt", "md", "html", "htm")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def html_text(c: Column) -> Column:
    """All text nodes of an HTML text, stripped, one a line; scripts and styles are text as well. Null stays null."""

    @F.pandas_udf("string")
    def nodes(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            p = _Text()
            p.feed(t)
            p.close()
            return "\n".join(p.parts)

        return s.map(one, na_action=None)

    return nodes(c)


def document_id(name: Column, content: Column) -> Column:
    """The file's name without its ending, lower-case with underscores, and ten digits of its SHA-1."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.concat(F.replace(F.lower(stem), F.lit(" "), F.lit("_")), F.lit("_"), F.substring(F.sha1(content), 1, 10))


def decoded(c: Column) -> Column:
    """Text of bytes in UTF-8; bytes that are none are dropped."""

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else v.decode("utf-8", "ignore") for v in values.to_pylist()], pa.string())

    return text(c)


#: What a manifest says of a file, as far as it does.
MANIFEST = ("title", "manufacturer", "model", "version", "url", "license_note", "released_at", "checked_at", "status")


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame | None = None, pdf_pages=None) -> DataFrame:
    """Pages of the documents in a folder: ``file_no, filename, doc_id, doc_name, page, text`` and the columns of ``MANIFEST``.

    Text, Markdown and HTML files are one page each; bytes that aren't UTF-8 are dropped. ``pdf_pages``, if given, takes a
    PDF's bytes and gives the texts of its pages (there is no PDF reader here); pages under 30 characters go. A
    ``manifest`` (``filename, ingest, ...``) leaves out files it marks with ``ingest`` false, and its columns go with the
    others; what it doesn't say is null. ``file_no`` numbers the files by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    files = files.select("path", name.alias("filename"), "content", kind.alias("kind")).where(F.col("kind").isin(*KINDS))
    said = [c for c in MANIFEST if manifest is not None and c in manifest.columns]
    if manifest is not None:
        ingest = F.coalesce(F.col("ingest"), F.lit(True)) if "ingest" in manifest.columns else F.lit(True)
        files = files.join(manifest.select("filename", ingest.alias("_ingest"), *said), "filename", "left").where("_ingest is null or _ingest").drop("_ingest")
    paths = files.select("path", "filename").withColumn("_all", F.lit(0))
    numbered = running_before(paths.withColumn("_one", F.lit(1)), "_all", "path", "_one").select("path", (F.col("before") + 1).alias("file_no"))
    named = files.join(numbered, "path").withColumn("doc_id", document_id(F.col("filename"), F.col("content"))).withColumn("doc_name", F.regexp_replace("filename", r"\.[^.]*$", ""))
    for c in MANIFEST:
        if c not in said:
            named = named.withColumn(c, F.lit(None).cast("string"))
    rest = ["file_no", "filename", "doc_id", "doc_name", *MANIFEST]
    raw = decoded(F.col("content"))
    page = lambda df, text: df.select("file_no", "filename", "doc_id", "doc_name", F.lit(1).alias("page"), text.alias("text"), *MANIFEST)
    pages = page(named.where(F.col("kind").isin("txt", "md")), raw).unionByName(page(named.where(F.col("kind").isin("html", "htm")), html_text(raw)))
    if pdf_pages is not None:

        @F.arrow_udf("array<string>")
        def read(values: pa.Array) -> pa.Array:
            return pa.array([list(pdf_pages(v)) for v in values.to_pylist()], pa.list_(pa.string()))

        pdf = named.where("kind = 'pdf'").select(*rest, F.posexplode(read("content")).alias("no", "text")).withColumn("page", F.col("no") + 1)
        pages = pages.unionByName(pdf.withColumn("text", T.clean_text(F.col("text"))).where(F.length("text") >= 30).drop("no"))
    return pages


def cached_rows(spark: SparkSession, path: str, docs: DataFrame, extract, version: str = "v1") -> DataFrame:
    """Table rows of documents (``doc_id, content``), extracted once: read from the cache at ``path`` where this ``version`` of it
    has the document, else by ``extract`` (a function from a frame of documents to one of rows with ``doc_id, headers, text``)
    and added to it. Rows that look like a list of links are left out, of old ones too. ``doc_id`` holds the content's hash,
    so a changed document is another one."""
    at = f"{path}/{version}"
    try:
        known = spark.read.parquet(f"{at}/done").distinct()
    except AnalysisException:
        known = docs.select("doc_id").limit(0)
    new = docs.join(known, "doc_id", "left_anti")
    extract(new).write.mode("append").parquet(f"{at}/rows")
    new.select("doc_id").write.mode("append").parquet(f"{at}/done")
    # a build that stopped between the two writes is done again, so its rows are there twice
    rows = spark.read.parquet(f"{at}/rows").distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.where(~T.looks_like_links(F.concat_ws(" ", F.array_join(F.coalesce("headers", T.strings(())), " "), F.coalesce("text", F.lit("")))))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of sources; ``ingest`` is true where it is missing."""
    df = spark.read.option("multiLine", "true").json(path)
    return df if "ingest" not in df.columns else df.withColumn("ingest", F.coalesce("ingest", F.lit(True)))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "FAILFAST").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def read_lines_with_errors(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that are none: ``line``. A byte-order mark at the start is dropped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where(T.strip(F.col("line")) != "")
    parsed = lines.select("line", F.from_json("line", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    good = parsed.where(F.col("r").isNotNull() & F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt")
    return good, parsed.where(F.col("r").isNull() | F.col("r._corrupt").isNotNull()).select("line")


def read_seeds(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A JSON array of records, the last of each key; ``_no`` is the place in the file, lists stay arrays."""
    rows = spark.read.option("multiLine", "true").json(path).withColumn("_no", F.monotonically_increasing_id())
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_no").alias("_r")).select(key, "_r.*")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON object of both."""
    df = spark.read.option("multiLine", "true").json(path)
    return df.select(F.explode("nodes").alias("n")).select("n.*"), df.select(F.explode("edges").alias("e")).select("e.*")


def append_traces(traces: DataFrame, path: str, secrets: tuple[str, ...] = ()) -> None:
    """Append JSON lines. Columns, fields and keys named like credentials, at any depth, are dropped, texts redacted; ``secrets``
    names more columns to drop."""
    kept = [f for f in traces.schema if not T.is_secret_key(f.name) and T.survives(f.dataType) and not any(x in f.name.lower() for x in secrets)]
    traces.select(*[T.sanitised(F.col(f.name), f.dataType).alias(f.name) for f in kept]).write.mode("append").json(path)


def trace(spark: SparkSession, path: str, schema: str, key: str, value: str) -> DataFrame:
    """The trace of one request; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key) == value)


def recent_traces(spark: SparkSession, path: str, schema: str, order: str, limit: int = 20) -> DataFrame:
    """The newest traces; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc(order)).limit(limit)


def file_facts(spark: SparkSession, folder: str) -> DataFrame:
    """``filename, bytes, sha256, age_days`` of the files of a folder."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.datediff(F.current_date(), F.to_date("modificationTime")).alias("age_days"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose content is another than before, gone or new: ``filename, state``; both: ``filename, sha256``."""
    joined = before.select("filename", F.col("sha256").alias("_a")).join(after.select("filename", F.col("sha256").alias("_b")), "filename", "full")
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") != F.col("_b"), "changed")
    return joined.select("filename", state.alias("state")).where(F.col("state").isNotNull())


def write_report(rows: DataFrame, path: str) -> None:
    """A result as JSON lines in ``path/json`` and as a Markdown table in ``path/markdown``, of any size: its rows are written
    where they are, the head as a file that sorts before them."""
    rows.write.mode("overwrite").json(f"{path}/json")
    head = [f"| {' | '.join(rows.columns)} |", f"|{'-|' * len(rows.columns)}"]
    cells = [F.coalesce(F.when(F.col(f.name).isNotNull(), F.to_json(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name).cast("string")), F.lit("")) for f in rows.schema]
    rows.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown/head")
    rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("overwrite").text(f"{path}/markdown/rows")


def read_report(spark: SparkSession, path: str) -> str:
    """The Markdown table of a small report."""
    lines = [r[0] for part in ("head", "rows") for r in spark.read.text(f"{path}/markdown/{part}").toLocalIterator()]
    return "\n".join(lines) + "\n"


def _pointer(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path(p, "CURRENT")


def read_manifest_file(spark: SparkSession, path: str) -> dict[str, str]:
    """The small JSON object in ``path/CURRENT``; empty if there is none."""
    fs, pointer = _pointer(spark, path)
    return json.loads("".join(r[0] for r in spark.read.text(pointer.toString()).collect())) if fs.exists(pointer) else {}


def write_manifest_file(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """Put ``values`` in place of ``path/CURRENT``, written beside it first."""
    fs, pointer = _pointer(spark, path)
    fresh = pointer.suffix(".new")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(values).encode()))
    out.close()
    fs.delete(pointer, False)
    fs.rename(fresh, pointer)


def drop_versions(spark: SparkSession, path: str, kept: set[str]) -> None:
    """Delete the folders of ``path`` that aren't ``kept``."""
    fs, pointer = _pointer(spark, path)
    for status in fs.listStatus(pointer.getParent()):
        if status.isDirectory() and status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content))
    out.close()


def read_pointed(spark: SparkSession, path: str) -> DataFrame | None:
    """The version of a table that its pointer names, or None."""
    fs, pointer = _pointer(spark, path)
    if not fs.exists(pointer):
        return None
    return spark.read.parquet(f"{path}/{spark.read.text(pointer.toString()).first()[0]}")


def write_pointed(df: DataFrame, path: str, version: str) -> None:
    """Write a version of a table, then let the pointer name it: readers see the old one or the new one, whole."""
    df.write.mode("overwrite").parquet(f"{path}/{version}")
    fs, pointer = _pointer(df.sparkSession, path)
    out = fs.create(pointer, True)
    out.write(bytearray(version.encode()))
    out.close()
