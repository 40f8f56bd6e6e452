"""Sections, chunks and table rows of pages.

Cutting a page is one pass over its lines and sentences: sums of token numbers from the start give the end of each chunk by
search. It runs on Arrow batches, a page at a time, so its work is linear in the page and no row is shuffled until ids
are numbered."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators.running import running_before
from tessera.session import checkpoint

#: The fixed patterns of ``lexicon`` as Python writes them.
_MARKDOWN, _CHINESE = re.compile(r"(#{1,6})\s+(.+)"), re.compile("[一二三四五六七八九十]+、.{2,80}")
_NUMBERED = re.compile(r"(\d+(?:\.\d+){0,4})\s+(.{2,80})")
_TOKEN = re.compile("16#[0-9A-Fa-f]+|[\u4e00-\u9fff]|[A-Za-z]+(?:_[A-Za-z]+)*|\\d+(?:\\.\\d+)?")
_STOP = re.compile(f"[^{L.SENTENCE_STOPS}\n]*[{L.SENTENCE_STOPS}]|[^{L.SENTENCE_STOPS}\n]+")
#: Characters of a heading that its path keeps.
TITLE = 100


def heading(line: Column) -> Column:
    """``level`` and ``title`` of a heading line; null for others."""
    s = T.strip(line)
    md, num, zh = F.regexp_extract(s, L.MARKDOWN_HEADING, 2), F.regexp_extract(s, L.NUMBERED_HEADING, 1), F.regexp_extract(s, L.CHINESE_HEADING, 1)
    dots = F.length(num) - F.length(F.replace(num, F.lit("."), F.lit("")))
    make = lambda level, title: F.struct(level.cast("int").alias("level"), F.substring(title, 1, TITLE).alias("title"))
    return (
        F.when(md != "", make(F.length(F.regexp_extract(s, L.MARKDOWN_HEADING, 1)), T.strip(md)))
        .when((num != "") & ~s.rlike(r"\.{3,}"), make(F.least(F.lit(4), dots + 1), F.concat(num, F.lit(" "), F.regexp_extract(s, L.NUMBERED_HEADING, 2))))
        .when(zh != "", make(F.lit(1), zh))
    )


def heading_of(line: str) -> tuple[int, str] | None:
    """``heading`` of one line."""
    s = line.strip()
    if m := _MARKDOWN.fullmatch(s):
        return len(m[1]), m[2].strip()[:TITLE]
    if (m := _NUMBERED.fullmatch(s)) and "..." not in s:
        return min(4, m[1].count(".") + 1), f"{m[1]} {m[2]}"[:TITLE]
    return (1, s[:TITLE]) if _CHINESE.fullmatch(s) else None


def sections_of(text: str) -> list[tuple[list[str], str]]:
    """The parts of a text between its heading lines, each with the headings in force, without empty ones."""
    parts: list[tuple[list[str], str]] = []
    path: list[str] = []
    lines = text.splitlines()
    heads = [(i, h) for i, line in enumerate(lines) if (h := heading_of(line))]
    begin = 0
    for end, head in [*heads, (len(lines), None)]:
        body = "\n".join(lines[begin:end]).strip()
        if body:
            parts.append((path, body))
        if head:
            path = [*path[: head[0] - 1], head[1]]
        begin = end + 1
    return parts or [([], text.strip())]


def sentences_of(text: str) -> list[str]:
    return [s for m in _STOP.finditer(text) if (s := m[0].strip())]


def fixed_of(text: str, size: int, overlap: int, least: int) -> list[str]:
    """``fixed_chunks`` of one text."""
    parts = sentences_of(text)
    sums = [0, *accumulate(len(_TOKEN.findall(s)) for s in parts)]
    out, start, at_least = [], 0, 1
    while start < len(parts):
        end = max(at_least, bisect_right(sums, sums[start] + size) - 1)
        out.append("\n".join(parts[start:end]))
        if end >= len(parts):
            break
        start, at_least = max(start, min(end - 1, bisect_left(sums, sums[end] - overlap))), end + 1
    return [x for x in out if len(x) >= least]


def semantic_of(text: str, target: int, most: int, similar: float, least: int) -> list[str]:
    """``semantic_chunks`` of one text."""
    parts = sentences_of(text)
    words = [set(_TOKEN.findall(s.lower())) for s in parts]
    sums = [0, *accumulate(map(len, words))]
    begins = [0] if parts else []
    for i in range(1, len(parts)):
        full = sums[i] - sums[begins[-1]]
        if full + len(words[i]) > most or (full >= target and len(words[i] & words[i - 1]) < similar * max(1, len(words[i] | words[i - 1]))):
            begins.append(i)
    out = ["\n".join(parts[a:b]) for a, b in zip(begins, [*begins[1:], len(parts)])]
    return [x for x in out if len(x) >= least]


def _mapped(kind: str, arrow: pa.DataType, f):
    """A column function that applies ``f`` to each text; null stays null."""

    @F.arrow_udf(kind)
    def work(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], arrow)

    return work


_STRINGS = pa.list_(pa.string())
_SECTION = pa.list_(pa.struct([("path", _STRINGS), ("text", pa.string())]))


def sections(c: Column) -> Column:
    """Array of ``path`` and ``text``: a text cut at its heading lines, each part with the headings in force. Parts
    without text are left out; a text without any part gives itself with no path."""
    return _mapped("array<struct<path:array<string>,text:string>>", _SECTION, lambda t: [{"path": p, "text": x} for p, x in sections_of(t)])(c)


def fixed_chunks(c: Column, size: int = 450, overlap: int = 60, least: int = 20) -> Column:
    """Sentences packed to ``size`` tokens. When the next one doesn't fit, a chunk ends, and the next begins with the
    last sentences that have ``overlap`` tokens together, at least one. Chunks under ``least`` characters go."""
    return _mapped("array<string>", _STRINGS, lambda t: fixed_of(t, size, overlap, least))(c)


def semantic_chunks(c: Column, target: int = 450, most: int = 600, similar: float = 0.05, least: int = 20) -> Column:
    """Sentences packed until ``most`` distinct tokens a sentence, summed, would be passed, or ``target`` is reached
    and the next sentence has less than ``similar`` in common with the one before. Short chunks go."""
    return _mapped("array<string>", _STRINGS, lambda t: semantic_of(t, target, most, similar, least))(c)


def _cut(mode: str, size: int, overlap: int):
    """Paths and chunks of texts, of which some are rows of tables and stay whole."""
    cut = (lambda t: fixed_of(t, size, overlap, 20)) if mode == "fixed" else (lambda t: semantic_of(t, 450, 600, 0.05, 20))

    @F.arrow_udf("array<struct<path:array<string>,text:string>>")
    def work(texts: pa.Array, whole: pa.Array) -> pa.Array:
        out = []
        for t, w in zip(texts.to_pylist(), whole.to_pylist()):
            found = [] if t is None else [([], t)] if w else [(p, x) for p, body in sections_of(t) for x in cut(body)]
            out.append([{"path": p, "text": x} for p, x in found])
        return pa.array(out, _SECTION)

    return work


def build_chunks(pages: DataFrame, mode: str = "fixed", size: int = 450, overlap: int = 60) -> DataFrame:
    """Chunks of pages: ``chunk_id, doc_id, doc_name, page, section_path, text``.

    ``pages``: ``doc_id, doc_name, page, order_no, text`` (``order_no`` orders the pages of a document, table rows
    after text; table rows are kept whole if a column ``representation`` says so). A chunk's text begins with its
    path. Numbers run within a document; they are shifted by per-page counts, so that a document of any size is
    numbered without gathering it in one task. A null text gives no chunk. ``mode`` is ``fixed`` or ``semantic``."""
    whole = F.coalesce(F.col("representation") == "table_row", F.lit(False)) if "representation" in pages.columns else F.lit(False)
    cut = pages.select("doc_id", "doc_name", "page", "order_no", _cut(mode, size, overlap)(F.col("text"), whole).alias("parts"))
    cut = checkpoint(cut)
    before = running_before(cut.groupBy("doc_id", "order_no").agg(F.sum(F.size("parts")).alias("n")), "doc_id", "order_no", "n")
    numbered = cut.join(before, ["doc_id", "order_no"]).select("doc_id", "doc_name", "page", "before", F.posexplode("parts").alias("no", "p"))
    prefix = F.when(F.size("p.path") > 0, F.concat(F.array_join("p.path", " > "), F.lit("\n"))).otherwise(F.lit(""))
    name = F.concat("doc_id", F.format_string("_%04d_%04d", F.col("page").cast("long"), F.col("before") + F.col("no") + 1))
    return numbered.select(name.alias("chunk_id"), "doc_id", "doc_name", "page", F.col("p.path").alias("section_path"), F.concat(prefix, "p.text").alias("text"))


def ingest_counts(chunks: DataFrame, mode: str) -> DataFrame:
    """One row of what a build gave: ``documents, chunks, mode``."""
    return chunks.agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks")).withColumn("mode", F.lit(mode))


def unique_headers(cells: Column) -> Column:
    """Header names: blanks become ``column_i``, the n-th repeat gets ``_n``."""
    named = F.transform(cells, lambda x, i: F.when(T.collapse(x) == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(T.collapse(x)))
    return F.transform(named, lambda x, i: F.concat(x, F.when(F.size(F.filter(F.slice(named, F.lit(1), i), lambda y: y == x)) > 0, F.concat(F.lit("_"), (F.size(F.filter(F.slice(named, F.lit(1), i), lambda y: y == x)) + 1).cast("string"))).otherwise("")))


def row_text(title: Column, headers: Column, values: Column) -> Column:
    """``title`` and the row's filled cells as ``header=value``; null for a row without any."""
    pairs = F.filter(F.arrays_zip(headers.alias("h"), values.alias("v")), lambda p: F.coalesce(p["v"], F.lit("")) != "")
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["h"], F.lit("="), p["v"])), "；")
    return F.when(F.size(pairs) > 0, F.concat(title, F.lit("\n表格行："), joined))


def nearest_title(blocks: Column, top: Column, reach: float = 90.0, most: int = 160) -> Column:
    """The title of a table whose box begins at ``top``: of the text ``blocks`` (array of ``y1, text``) that end at most
    ``reach`` above it and are at most ``most`` characters long when clean, the lowest one, the first among equals; empty
    if there is none."""
    clean = F.transform(F.coalesce(blocks, F.array().cast("array<struct<y1:double,text:string>>")), lambda b: F.struct(b["y1"].alias("y1"), F.replace(T.clean_text(b["text"]), F.lit("\n"), F.lit(" ")).alias("text")))
    near = F.filter(clean, lambda b: (b["y1"] <= top) & (top - b["y1"] <= reach) & (b["text"] != "") & (F.length(b["text"]) <= most))
    lowest = F.array_max(F.transform(near, lambda b: b["y1"]))
    return F.coalesce(F.try_element_at(F.transform(F.filter(near, lambda b: b["y1"] == lowest), lambda b: b["text"]), F.lit(1)), F.lit(""))


def nearest_titles(tables: DataFrame, blocks: DataFrame, reach: float = 90.0, most: int = 160) -> DataFrame:
    """``nearest_title`` of many tables: the columns of ``tables`` and ``title``.

    ``tables``: ``doc_id, top, ...``; ``blocks``: ``doc_id, y1, text``. Each text is cleaned once. Blocks and tables of a document are
    put in order of height, and a table takes the last block before it, so work is linear but for sorting. Of blocks at one
    height the first text counts. Blocks without a document or a height are no one's title."""
    kept = [c for c in tables.columns if c not in ("doc_id", "top")]
    clean = blocks.where("doc_id is not null and y1 is not null").select("doc_id", "y1", F.replace(T.clean_text(F.col("text")), F.lit("\n"), F.lit(" ")).alias("text")).where((F.col("text") != "") & (F.length("text") <= most))
    titles = clean.groupBy("doc_id", F.col("y1").alias("_y")).agg(F.min("text").alias("_text")).withColumn("_block", F.struct("_y", "_text"))
    both = tables.select("doc_id", F.col("top").alias("_y"), F.struct("top", *kept).alias("_t")).unionByName(titles.select("doc_id", "_y", "_block"), allowMissingColumns=True)
    so_far = W.partitionBy("doc_id").orderBy("_y", F.col("_t").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_block", F.last("_block", True).over(so_far)).where("_t is not null")
    return found.select("doc_id", "_t.*", F.when(F.col("_t.top") - F.col("_block._y") <= reach, F.col("_block._text")).otherwise("").alias("title"))


def table_rows(tables: DataFrame) -> DataFrame:
    """Texts of the rows of proper tables.

    ``tables``: ``table_id, title, rows`` (array of arrays of cells). A table counts if it has two columns, two rows
    of at least two filled cells, a quarter of its cells filled and no links in it. Its first row names the columns
    if it has another. Result: ``table_id, row_index, headers, text``; rows without a filled cell are left out."""
    clean = F.transform("rows", lambda r: F.transform(r, T.collapse))
    t = tables.withColumn("rows", F.filter(clean, lambda r: F.size(r) > 0))
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    filled = F.transform("rows", lambda r: F.size(F.filter(r, lambda c: c != "")))
    share = F.aggregate(filled, F.lit(0), lambda a, n: a + n) / (F.size("rows") * width)
    proper = (width >= 2) & (F.size(F.filter(filled, lambda n: n >= 2)) >= 2) & (share >= 0.25) & ~T.looks_like_links(F.array_join(F.flatten("rows"), " "))
    t = t.where(F.size("rows") > 0).withColumn("width", width).where(proper)
    pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("width") - F.size(r)))
    t = t.withColumn("headers", unique_headers(pad(F.col("rows")[0])))
    data = F.when(F.size("rows") > 1, F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows"))
    out = t.select("table_id", "headers", "title", "width", F.posexplode(data).alias("no", "r"))
    return out.select("table_id", (F.col("no") + 1).alias("row_index"), "headers", row_text(F.col("title"), F.col("headers"), pad(F.col("r"))).alias("text")).where(F.col("text").isNotNull())
