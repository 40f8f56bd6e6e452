"""Answers put together from evidence, and their citations and claims checked against it.

Evidence is a frame of hits: ``query_id, question, rank, doc_key, doc_name, page, section_path, representation, text``;
``rank`` from 1 is the source's number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import facts
from tessera.operators.retrieval import best_sentences


def display_name(name: Column, names: dict[str, str] | None = None) -> Column:
    """The name to show for a document: that of ``names``, else its own; null becomes empty."""
    own = F.coalesce(name, F.lit(""))
    if not names:
        return own
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, own), own)


def citation(place: Column, name: Column, page: Column, names: dict[str, str] | None = None) -> Column:
    return F.concat(F.lit("[来源"), place.cast("string"), F.lit("："), display_name(name, names), F.lit("，第"), F.coalesce(page, F.lit(0)).cast("string"), F.lit("页]"))


def context_blocks(evidence: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """The evidence of each query as one text of numbered blocks: ``query_id, context``. A query has a few hits."""
    lines = [
        F.concat(F.lit("[来源"), F.col("rank").cast("string"), F.lit("]")), F.concat(F.lit("chunk_id: "), F.col("doc_key")), F.concat(F.lit("doc_name: "), display_name(F.col("doc_name"), names)),
        F.concat(F.lit("page: "), F.coalesce("page", F.lit(0)).cast("string")), F.concat(F.lit("section_path: "), F.array_join(F.coalesce("section_path", T.strings(())), " > ")), F.concat(F.lit("evidence: "), F.coalesce("text", F.lit(""))),
    ]
    blocks = evidence.select("query_id", F.struct("rank", F.concat_ws("\n", *lines).alias("block")).alias("b"))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["block"]), "\n\n").alias("context"))


def _selected(evidence: DataFrame, most: int) -> DataFrame:
    """``query_id, place, rank, sentence``: for questions about procedures the first sentences of the first source, else the
    best of all."""
    about_steps = reduce(lambda a, b: a | b, [F.contains("question", F.lit(w)) for w in L.PROCEDURE_WORDS])
    steps = evidence.where(about_steps & (F.col("rank") == 1))
    usable = F.filter(F.transform(T.answer_sentences(F.col("text")), T.strip), lambda s: (F.length(s) >= 18) & ~F.contains(s, F.lit(" > ")))
    first = steps.select("query_id", F.posexplode(F.slice(usable, 1, 4)).alias("place", "sentence")).select("query_id", (F.col("place") + 1).alias("place"), F.lit(1).alias("rank"), "sentence")
    return first.unionByName(best_sentences(evidence.where(~about_steps), limit=most).select("query_id", "place", "rank", "sentence"))


def extractive_answers(queries: DataFrame, evidence: DataFrame, names: dict[str, str] | None = None, most: int = 320) -> DataFrame:
    """An answer for each query made of sentences of its evidence with their sources: ``query_id, answer``.

    ``queries``: ``query_id, prefix``; a non-empty ``prefix`` (what a look-up gave) comes first and is followed by the
    sources of the first three hits. Without a sentence that fits, a useful one of each of the first two hits stands
    in, else their beginning. A query without evidence gets the fixed note that there is none."""
    cited = evidence.select("query_id", "rank", citation(F.col("rank"), F.col("doc_name"), F.col("page"), names).alias("cite"), T.strip(F.coalesce(T.useful_sentence(F.col("text")), F.substring("text", 1, 220))).alias("spare"))
    lines = _selected(evidence, 3).join(cited, ["query_id", "rank"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "sentence", "cite"))).alias("chosen"))
    per = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cite", "spare"))).alias("hits"))
    all_ = queries.join(per, "query_id", "left").join(lines, "query_id", "left")
    numbered = lambda a, s: F.transform(a, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(x[s], 1, most), F.lit(" "), x["cite"]))
    prefix = T.strip(F.coalesce("prefix", F.lit("")))
    chosen = F.coalesce("chosen", F.array().cast("array<struct<place:int,sentence:string,cite:string>>"))
    sources = F.concat(F.lit("来源："), F.array_join(F.transform(F.slice("hits", 1, 3), lambda x: x["cite"]), " "))
    with_prefix = F.concat(F.array(prefix), F.when(F.size(chosen) > 0, F.concat(F.array(F.lit(L.MANUAL_EVIDENCE)), numbered(chosen, "sentence"))).otherwise(T.strings(())), F.array(sources))
    without = F.when(F.size(chosen) > 0, F.concat(F.array(F.lit(L.FROM_MANUALS)), numbered(chosen, "sentence"))).otherwise(F.concat(F.array(F.lit(L.FROM_FOREIGN_MANUALS)), numbered(F.slice("hits", 1, 2), "spare")))
    body = F.concat(F.when(prefix != "", with_prefix).otherwise(without), F.array(F.lit(L.SAFETY_NOTE)))
    return all_.select("query_id", F.when(F.col("hits").isNull(), F.lit(L.NO_EVIDENCE)).otherwise(F.array_join(body, "\n")).alias("answer"))


_SOURCES = r"(?s)4\. 引用来源.*?5\. 安全提示"


def with_reference_section(answers: DataFrame, evidence: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Answers whose list of sources is written anew from the numbers that their text cites, ranges too: ``query_id, answer``.
    An answer that cites none of its sources stays as it is."""
    line = F.concat(
        F.lit("- [来源"), F.col("rank").cast("string"), F.lit("] chunk_id: "), F.col("doc_key"), F.lit("；文档: "), display_name(F.col("doc_name"), names), F.lit("；第"), F.coalesce("page", F.lit(0)).cast("string"),
        F.lit("页；章节: "), F.coalesce(F.nullif(F.array_join(F.coalesce("section_path", T.strings(())), " > "), F.lit("")), F.lit(L.NO_SECTION)),
    )
    per = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    rows = answers.select("query_id", "answer").join(per, "query_id", "left")
    body = F.regexp_replace("answer", _SOURCES, L.ANSWER_TITLES[4])
    used = facts.source_ranges(body, F.coalesce(F.size("lines"), F.lit(0)))
    listed = F.transform(F.filter("lines", lambda x: F.array_contains(used, x["rank"])), lambda x: x["line"])
    section = F.concat(F.lit(L.ANSWER_TITLES[3] + "\n"), F.array_join(listed, "\n"), F.lit("\n\n" + L.ANSWER_TITLES[4]))
    head, tail = F.regexp_extract("answer", r"(?s)^(.*?)4\. 引用来源.*?5\. 安全提示", 1), F.regexp_extract("answer", r"(?s)^.*?4\. 引用来源.*?5\. 安全提示(.*)$", 1)
    found = F.col("answer").rlike(_SOURCES) & (F.size(used) > 0)
    return rows.select("query_id", F.when(found, F.concat(head, section, tail)).otherwise(F.col("answer")).alias("answer"))


def _claims(answers: DataFrame, least: int) -> DataFrame:
    return answers.select("query_id", F.posexplode(facts.claims(F.col("answer"), least)).alias("no", "claim")).withColumn("no", F.col("no") + 1)


def _without_marks(c: Column) -> Column:
    return F.regexp_replace(c, L.CITED_SOURCE, "")


def grounded_faults(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """What is wrong with each claim of grounded answers: ``query_id, no, fault`` (``no`` from 1; 0 for the whole answer).

    ``no claims``: the answer has none; ``no source``: a claim cites nothing; ``not one source``: not exactly one valid one;
    ``not at the end``: the citation doesn't end the claim; ``identifier``: a code name of the claim isn't in the
    source; ``wording``: a word that widens a claim isn't in it either. The text of a source meets a claim by an equi-join
    on query and number."""
    claims = _claims(answers, 3)
    sizes = evidence.groupBy("query_id").agg(F.max("rank").alias("sources"))
    cited = F.transform(F.regexp_extract_all("claim", F.lit(L.CITED_SOURCE), F.lit(1)), lambda x: x.cast("int"))
    rows = claims.join(sizes, "query_id", "left").withColumn("cited", cited).withColumn("valid", F.array_distinct(F.filter("cited", lambda i: (i >= 1) & (i <= F.coalesce("sources", F.lit(0))))))
    one = (F.size("valid") == 1) & (F.size("cited") == 1)
    rows = rows.withColumn("rank", F.when(one, F.try_element_at("valid", F.lit(1)))).join(evidence.select("query_id", "rank", F.col("text").alias("source")), ["query_id", "rank"], "left")
    plain, source = _without_marks(F.col("claim")), F.coalesce("source", F.lit(""))
    names = F.filter(F.regexp_extract_all(plain, F.lit(L.GROUNDED_IDENTIFIER), F.lit(0)), lambda x: ~F.contains(F.lower(source), F.lower(x)))
    wide = F.filter(T.strings(L.EXTENDING_WORDS), lambda w: F.contains(plain, w) & ~F.contains(source, w))
    faults = F.when(F.size("cited") == 0, F.array(F.lit("no source"))).otherwise(
        F.filter(
            F.array(
                F.when(~one, F.lit("not one source")), F.when(~F.col("claim").rlike(r"\[来源\s*[0-9]+(?:[:：][^\]]*)?\]\s*[。！？；;]?$"), F.lit("not at the end")),
                F.when(one & (F.size(names) > 0), F.lit("identifier")), F.when(one & (F.size(wide) > 0), F.lit("wording")),
            ),
            lambda x: x.isNotNull(),
        )
    )
    none = answers.where(F.coalesce(F.size(facts.claims(F.col("answer"), 3)), F.lit(0)) <= 0).select("query_id", F.lit(0).alias("no"), F.lit("no claims").alias("fault"))
    return rows.select("query_id", "no", F.explode(faults).alias("fault")).unionByName(none)


def _number_in(value: Column, text: Column) -> Column:
    """Whether a number, however grouped or padded with zeros, is in a text."""
    plain, whole = F.replace(F.lower(value), F.lit(","), F.lit("")), F.replace(F.lower(text), F.lit(","), F.lit(""))
    bare = F.coalesce(F.nullif(F.regexp_replace(plain, "^0+", ""), F.lit("")), F.lit("0"))
    return F.contains(whole, plain) | F.regexp_like(whole, F.concat(F.lit("(?<![0-9])0*"), F.replace(bare, F.lit("."), F.lit("\\.")), F.lit("(?![0-9])")))


def _missing_values(plain: Column, text: Column) -> Column:
    """Identifiers, versions, codes and numbers of a claim that a text has in no form."""
    low = F.lower(text)
    def known(x: Column) -> Column:
        other = F.lit(False)
        for name, others in L.IDENTIFIER_ALIASES:
            other = other | ((F.lower(x) == name) & reduce(lambda a, b: a | b, [F.contains(low, F.lit(o)) for o in others]))
        return F.contains(low, F.lower(x)) | other

    def code(x: Column) -> Column:
        bare = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(x), "^(?:16#|0x)", ""), "^0+", ""), F.lit("")), F.lit("0"))
        return F.contains(low, F.lower(x)) | F.regexp_like(low, F.concat(F.lit("(?<![0-9a-f])0*"), bare, F.lit("(?![0-9a-f])")))

    every = lambda c, rx: F.regexp_extract_all(c, F.lit(rx), F.lit(0))
    rest = reduce(lambda c, rx: F.regexp_replace(c, rx, " "), (L.CLAIM_VERSION, L.CLAIM_STATUS, L.CLAIM_IDENTIFIER), plain)
    return F.array_distinct(F.concat(
        F.filter(every(plain, L.CLAIM_IDENTIFIER), lambda x: ~known(x)), F.filter(every(plain, L.CLAIM_VERSION), lambda x: ~F.contains(low, F.lower(x))),
        F.filter(every(plain, L.CLAIM_STATUS), lambda x: ~code(x)), F.filter(every(rest, L.CLAIM_NUMBER), lambda x: ~_number_in(x, text)),
    ))


def claim_checks(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim of an answer (of eight characters or more) against the sources it cites: ``query_id, no, sources, category,
    supported``.

    ``evidence_not_enough``: cites none (``checker_false_positive`` if it only states a limit); ``hallucination``: names a
    value that its sources lack; ``prompt_overgeneralization``: widens them; ``citation_too_broad``: cites several or
    none that exist; else ``supported``. A claim meets its sources by an equi-join on query and number."""
    marks = r"\[来源[^\]]+\]"
    plain = T.strip(F.regexp_replace("claim", marks, ""))
    sizes = evidence.groupBy("query_id").agg(F.max("rank").alias("n"))
    rows = _claims(answers, 3).withColumn("plain", plain).where(F.length("plain") >= 8).join(sizes, "query_id", "left")
    rows = rows.withColumn("indexes", facts.source_ranges(F.col("claim"), F.coalesce("n", F.lit(0)))).withColumn("marked", F.col("claim").rlike(marks))
    block = F.concat_ws(" ", F.coalesce("doc_name", F.lit("")), F.array_join(F.coalesce("section_path", T.strings(())), " "), F.coalesce("text", F.lit("")))
    cited = rows.select("query_id", "no", F.explode("indexes").alias("rank")).join(evidence.select("query_id", "rank", "doc_key", block.alias("block")), ["query_id", "rank"])
    texts = cited.groupBy("query_id", "no").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b")).select("query_id", "no", F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("text"))
    full = rows.join(texts, ["query_id", "no"], "left")
    text, low = F.coalesce("text", F.lit("")), F.lower(F.coalesce("text", F.lit("")))
    limited = reduce(lambda a, b: a | b, [F.contains("plain", F.lit(w)) for w in L.LIMITATION_WORDS])
    missing = F.size(_missing_values(F.col("plain"), text)) > 0
    softened = lambda w: ((w == "通常") & F.contains(text, F.lit("常见"))) | ((w == "可能") & (F.contains(low, F.lit("may")) | F.contains(low, F.lit("can "))))
    wide = F.exists(T.strings(L.BROAD_WORDS), lambda w: F.contains("plain", w) & ~F.contains(text, w) & ~softened(w))
    category = (
        F.when(F.size("indexes") == 0, F.when(limited, "checker_false_positive").otherwise("evidence_not_enough")).when(F.col("text").isNull(), "citation_too_broad")
        .when(missing & ~limited, "hallucination").when(wide, "prompt_overgeneralization").when(F.size("indexes") > 1, "citation_too_broad").otherwise("supported")
    )
    return full.select("query_id", "no", F.size("indexes").alias("sources"), category.alias("category")).withColumn("supported", F.col("category").isin("supported", "checker_false_positive"))


def valid_citations(answer: Column, evidence: Column) -> Column:
    """Whether an answer cites something, only chunks of its ``evidence`` (ids) and only numbers that it has."""
    ids = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(?i)chunk_id\s*[:：]\s*([^；;\s\)）]+)"), F.lit(1)))
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[来源\s*([0-9]+)\b"), F.lit(1)), lambda x: x.cast("int"))
    return ((F.size(ids) > 0) | (F.size(numbers) > 0)) & (F.size(F.array_except(ids, evidence)) == 0) & ~F.exists(numbers, lambda i: (i < 1) | (i > F.size(evidence)))


def fact_diagnosis(rows: DataFrame) -> DataFrame:
    """Why a required fact counts or doesn't: ``query_id, fact, exact, semantic, gold_supported, classification``.

    ``rows``: ``query_id, facts, answer, gold`` (texts). A fact is met by a text if it, or a share of its atoms, is: as a normalised
    part of it, or with all its identifiers in the text and a segment, or all of the text, like enough. The answer needs all
    atoms at 0.70, the gold text 0.60 of them at 0.60. Classes in this order: not supported by gold, exact, semantic only, too
    broad (three atoms or more, some met), missing. Null answers and gold texts count as empty, null facts are left out."""
    every = rows.select("query_id", "answer", "gold", F.explode(F.array_distinct("facts")).alias("fact")).where("fact is not null")
    body = F.regexp_replace(F.coalesce("answer", F.lit("")), _SOURCES, L.ANSWER_TITLES[4])
    atoms = facts.atomic_parts(F.col("fact"))
    texts = every.select("query_id", "fact", F.contains(facts.tight(F.coalesce("answer", F.lit(""))), facts.tight(F.col("fact"))).alias("exact"), atoms.alias("atoms"), body.alias("body"), F.coalesce("gold", F.lit("")).alias("gold"))
    parts = texts.select("*", F.explode(F.array_union(F.array("fact"), "atoms")).alias("atom"))
    met = parts.withColumn("in_answer", facts.fact_met(F.col("atom"), F.col("body"), 0.70)).withColumn("in_gold", facts.fact_met(F.col("atom"), F.col("gold"), 0.60))
    is_atom = F.array_contains("atoms", F.col("atom"))
    by = met.groupBy("query_id", "fact", "exact").agg(
        F.bool_or((F.col("atom") == F.col("fact")) & F.col("in_answer")).alias("a_all"), F.bool_or((F.col("atom") == F.col("fact")) & F.col("in_gold")).alias("g_all"),
        F.avg(F.when(is_atom, F.col("in_answer").cast("int"))).alias("a_share"), F.avg(F.when(is_atom, F.col("in_gold").cast("int"))).alias("g_share"), F.count_if(is_atom).alias("n"),
    )
    semantic, gold = F.col("a_all") | (F.col("a_share") >= 1.0), F.col("g_all") | (F.col("g_share") >= 0.60)
    kind = (
        F.when(~gold, "required_fact_not_directly_supported_by_gold").when(F.col("exact"), "exact_match").when(semantic, "checker_false_negative")
        .when((F.col("n") >= 3) & (F.col("a_share") > 0), "required_fact_too_broad").otherwise("missing_from_answer")
    )
    return by.select("query_id", "fact", "exact", semantic.alias("semantic"), gold.alias("gold_supported"), kind.alias("classification"))


def _number(c: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def alarm_text(record: Column) -> Column:
    """An alarm's record (``code, title, meaning, causes, checks, source``) as text; null gives the note that there is none."""
    joined = lambda a: F.array_join(F.filter(F.coalesce(a, T.strings(())), lambda x: x.isNotNull() & (x != "")), "；")
    text = F.concat(F.lit("故障码 "), record["code"], F.lit("："), record["title"], F.lit("。"), record["meaning"], F.lit("\n可能原因："), joined(record["causes"]), F.lit("\n建议核对："), joined(record["checks"]), F.lit("\n结构化来源："), F.coalesce(record["source"], F.lit("")))
    return F.when(record.isNull(), F.lit(L.ALARM_UNKNOWN)).otherwise(text)


def parameter_text(record: Column, value: Column) -> Column:
    """A parameter's record (``name, minimum, maximum, unit, notes, source``), and whether ``value``, if there is one, is within."""
    inside = F.when((record["minimum"] <= value) & (value <= record["maximum"]), F.lit("在")).otherwise(F.lit("不在"))
    now = F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(" 当前值 "), value.cast("string"), F.lit(" "), record["unit"], F.lit(" "), inside, F.lit("该演示数据范围内。")))
    text = F.concat(F.lit("参数 "), record["name"], F.lit("：允许范围 "), _number(record["minimum"]), F.lit("到"), _number(record["maximum"]), F.lit(" "), record["unit"], F.lit("。"), record["notes"], now, F.lit(" 结构化来源："), record["source"])
    return F.when(record.isNull(), F.lit(L.PARAMETER_UNKNOWN)).otherwise(text)


def solution_text(record: Column) -> Column:
    """A verified solution's record (``id, similarity, problem, solution``) as text; null gives an empty one."""
    text = F.concat(F.lit("已找到经用户确认的历史方案（方案ID "), record["id"].cast("string"), F.lit("，相似度 "), record["similarity"].cast("string"), F.lit("）：\n历史问题："), record["problem"], F.lit("\n已验证方案："), record["solution"], F.lit("\n" + L.SOLUTION_NOTE))
    return F.when(record.isNull(), F.lit("")).otherwise(text)


def provenance(df: DataFrame) -> Column:
    """Where a record comes from: a map of the known columns that are filled."""
    have = [c for c in L.PROVENANCE if c in df.columns]
    value = lambda c: F.array_join(c, " > ") if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    return F.map_filter(F.map_from_arrays(T.strings(have), F.array(*map(value, have))), lambda k, v: v.isNotNull() & (v != ""))
