"""Answers from evidence and the checks of their citations, claims and facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import answers, facts
from tessera.operators.retrieval import best_sentences
from tessera.plans.retrieval import _BASE, _BEST, _evidence
from tessera.plans.texts import _strip
from tessera.session import checkpoint
from tessera.sources.tables import table


def answer_extractive(spark: SparkSession, d: str) -> DataFrame:
    """An answer for every query; those about alarms say so first."""
    evidence = checkpoint(_evidence(spark, d))
    asked = table(spark, d, "formal_questions").select(F.col("id").alias("query_id"), F.when(F.col("category") == "alarm_code", "Alarm").otherwise("").alias("prefix")).distinct()
    return answers.extractive_answers(asked.join(evidence.select("query_id").distinct(), "query_id", "left_semi"), evidence)


def answer_context(spark: SparkSession, d: str) -> DataFrame:
    return answers.context_blocks(_evidence(spark, d))


def _drafts(evidence: DataFrame) -> DataFrame:
    """Answers in five sections of the three best sentences: the first with its own source, the second with two sources, the
    third widened and always with the first source."""
    best = best_sentences(evidence, limit=3).groupBy("query_id").agg(*[F.max(F.when(F.col("place") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2, 3) for c in ("sentence", "rank", "doc_key")])
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    t = L.ANSWER_TITLES
    second = F.coalesce(say(F.col("sentence2"), "[来源2-3]"), F.lit("无法确认这一点的原因。"))
    third = F.coalesce(say("通常 ", F.col("sentence3"), "[来源1]"), F.lit("短"))
    text = say(t[0] + "\n", F.col("sentence1"), "[来源", F.col("rank1").cast("string"), "]\n" + t[1] + "\n", second, "\n" + t[2] + "\n- ", third, "\n" + t[3] + "\n- chunk_id: ", F.col("doc_key1"), "；\n\n" + t[4] + "\n" + L.SAFETY_NOTE)
    return best.select("query_id", text.alias("answer"))


def answer_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts with their list of sources written anew."""
    evidence = checkpoint(_evidence(spark, d))
    return answers.with_reference_section(_drafts(evidence), evidence)


def answer_faults(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the claims of the drafts."""
    evidence = checkpoint(_evidence(spark, d))
    return answers.grounded_faults(_drafts(evidence), evidence)


def answer_claims(spark: SparkSession, d: str) -> DataFrame:
    """The claims of the drafts against the sources they cite."""
    evidence = checkpoint(_evidence(spark, d))
    return answers.claim_checks(_drafts(evidence), evidence)


def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    """Whether the drafts, as if only two sources had been given, cite what there is."""
    evidence = checkpoint(_evidence(spark, d))
    ids = evidence.where("rank <= 2").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_key"))).alias("e")).select("query_id", F.transform("e", lambda x: x["doc_key"]).alias("e"))
    both = _drafts(evidence).join(ids, "query_id").withColumn("f", facts.citation_faults(F.col("answer"), F.col("e")))
    return both.select("query_id", answers.valid_citations(F.col("answer"), F.col("e")).alias("valid"), F.array_join("f.out_of_range", " ").alias("out_of_range"), F.size("f.unknown").alias("unknown"), F.col("f.uncited").alias("uncited"))


def fact_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Why each required fact of the asked questions counts or doesn't, with the two best hits as answer and all of them as gold."""
    evidence = checkpoint(_evidence(spark, d))
    text = lambda most: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", F.coalesce("text", F.lit("")).alias("text"))))), lambda x: x["text"]), "\n")
    texts = evidence.groupBy("query_id").agg(text(2).alias("answer"), text(5).alias("gold"))
    names = table(spark, d, "formal_questions").select(F.col("id").alias("query_id"), F.flatten(F.transform("required_facts", lambda x: F.array(x, F.concat(x, F.lit("，以及"), x)))).alias("facts")).distinct()
    return answers.fact_diagnosis(names.join(texts, "query_id"))


def fact_parts(spark: SparkSession, d: str) -> DataFrame:
    """The atoms of each solved problem's solution, taken as a fact, in normal form."""
    rows = table(spark, d, "verified_solutions").where("solution is not null").select("id", F.posexplode(facts.atomic_parts(F.col("solution"))).alias("no", "part"))
    return rows.select("id", "no", facts.normal_fact(F.col("part")).alias("part")).distinct()


def fact_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The share of each problem's pairs of characters, in normal form, that its solution has."""
    rows = table(spark, d, "verified_solutions").select("id", facts.normal_fact(F.col("problem")).alias("a"), facts.normal_fact(F.col("solution")).alias("b")).distinct().where("a is not null and b is not null")
    pairs = T.bigrams(F.col("a"))
    return rows.select("id", F.size(pairs).alias("pairs"), F.round(F.size(F.array_intersect(pairs, T.bigrams(F.col("b")))) / F.greatest(F.lit(1), F.size(pairs)), 6).alias("share"))


def fact_forbidden(spark: SparkSession, d: str) -> DataFrame:
    """How answers that warn of forbidden facts, and those that state them once more, mention them."""
    rows = table(spark, d, "formal_questions").select("id", "answerable", F.explode("forbidden_facts").alias("fact")).distinct().where("fact is not null")
    answer = F.when(F.col("answerable"), F.concat(F.lit("禁止："), "fact")).otherwise(F.concat("fact", F.lit("。这里不得："), "fact"))
    found = rows.select("id", "fact", facts.forbidden_mentions(answer, F.col("fact")).alias("kind"))
    return found.where("kind is not null").groupBy("id").agg(F.count_if(F.col("kind") == "violation").alias("violations"), F.count_if(F.col("kind") == "negated").alias("negated"))


QUERIES = {f.__name__: f for f in (answer_extractive, answer_context, answer_drafts, answer_faults, answer_claims, answer_citations, fact_diagnosis, fact_parts, fact_pairs, fact_forbidden)}

_CITE = "'[来源' || rank || '：' || coalesce(doc_name, '') || '，第' || coalesce(page, 0) || '页]'"
_EVIDENCE = f"{_BASE},{_BEST},\nev AS (SELECT b.query_id, b.rank, d.* FROM bm b JOIN docs d USING (doc_key) WHERE b.rank <= 5)"
_STEPS = " OR ".join(f"contains(question, '{w}')" for w in L.PROCEDURE_WORDS)
_USABLE = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。！？.!?])', '\\1' || chr(10), 'g'), '\\n+'), lambda x: {_strip('x')}), lambda x: length(x) >= 18 AND NOT contains(x, ' > '))"
_T = L.ANSWER_TITLES
_DRAFT = f"""draft AS (SELECT query_id, '{_T[0]}' || chr(10) || s1 || '[来源' || r1 || ']' || chr(10) || '{_T[1]}' || chr(10) || coalesce(s2 || '[来源2-3]', '无法确认这一点的原因。') || chr(10) || '{_T[2]}' || chr(10) || '- ' || coalesce('通常 ' || s3 || '[来源1]', '短') || chr(10)
  || '{_T[3]}' || chr(10) || '- chunk_id: ' || k1 || '；' || chr(10) || chr(10) || '{_T[4]}' || chr(10) || '{L.SAFETY_NOTE}' AS answer
  FROM (SELECT query_id, max(CASE WHEN place = 1 THEN sentence END) AS s1, max(CASE WHEN place = 1 THEN rank END) AS r1, max(CASE WHEN place = 1 THEN doc_key END) AS k1, max(CASE WHEN place = 2 THEN sentence END) AS s2, max(CASE WHEN place = 3 THEN sentence END) AS s3 FROM best WHERE place <= 3 GROUP BY 1))"""
_CLAIM = f"""said AS (SELECT query_id, regexp_replace(regexp_extract(answer, '(?s)1\\. 结论(.*?)4\\. 引用来源', 1), '(?:^|\\n)\\s*[123]\\.\\s*(?:结论|原因|排查\\s*/\\s*换算建议)\\s*', chr(10), 'g') AS t FROM draft),
cut AS (SELECT query_id, list_filter(list_transform(regexp_split_to_array(replace(regexp_replace(t, '([。！？；;])', '\\1' || chr(1), 'g'), chr(1) || '[来源', '[来源'), '[\\n\\x01]+'), lambda x: regexp_replace(x, '^[ \\-•\\t]+|[ \\-•\\t]+$', '', 'g')),
  lambda x: length(regexp_replace(regexp_replace(x, '{L.CITED_SOURCE}', '', 'g'), '^[ 。；;\\t]+|[ 。；;\\t]+$', '', 'g')) >= 3) AS c FROM said),
claim AS (SELECT query_id, unnest(range(1, len(c) + 1)) AS no, unnest(c) AS claim FROM cut)"""
_NUMBERS = """list_filter(list_sort(list_distinct(flatten(list_transform(flatten(list_transform(regexp_extract_all({c}, '\\[来源([^\\]]+)\\]', 1), lambda x: regexp_extract_all(x, '[0-9]+(?:\\s*[–—-]\\s*[0-9]+)?'))),
  lambda x: range(list_min(list_transform(regexp_extract_all(x, '[0-9]+'), lambda n: CAST(n AS INT))), list_max(list_transform(regexp_extract_all(x, '[0-9]+'), lambda n: CAST(n AS INT))) + 1))))), lambda i: i >= 1 AND i <= {n})"""
_NORMAL = f"lower(regexp_replace({{}}, '{facts.SOURCE_MARK}', '', 'g'))"
for _phrases, _one in facts.SAME_PHRASES:
    for _p in sorted(_phrases, key=len, reverse=True):
        _NORMAL = f"replace({_NORMAL}, '{_p}', '{_one}')"
_NORMAL = f"regexp_replace({_NORMAL}, '[^\\x{{{{4e00}}}}-\\x{{{{9fff}}}}A-Za-z0-9#_.]+', '', 'g')"
_PAIRS = "list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))"
_WORDS = "regexp_extract_all({c}, '[A-Za-z0-9_]+')"
_CLAIM_WORDS = "(?i)(?:MB_[A-Z0-9_]+|RD_MB_DATA_LEN|WR_MB_DATA_LEN|RemotePort|InterfaceID|TCON_IP_v[0-9]+|CONNECT|STATUS|BUSY|REQ|Role)"
_ALIASES = " OR ".join(f"(lower(x) = '{n}' AND ({' OR '.join(f"contains(low, '{o}')" for o in others)}))" for n, others in L.IDENTIFIER_ALIASES)
_PLAIN_PREFIX = "CASE " + " ".join(f"WHEN starts_with(x, '{w}') AND length(x) > {len(w) + 1} THEN substr(x, {len(w) + 1})" for w in facts.LEADING_WORDS) + " ELSE x END"
_TIGHT = f"regexp_replace(lower({{}}), '{L.WS.replace('{', '{{').replace('}', '}}')}+', '', 'g')"
_NEGATED = " OR ".join(f"contains(b, '{n}')" for n in facts.NEGATIONS)

SQL = {
    "answer_extractive": f"""WITH {_EVIDENCE},
per AS (SELECT query_id, rank, {_CITE} AS cite, {_strip(f"coalesce({_USABLE}[1], substr(text, 1, 220))")} AS spare FROM ev),
steps AS (SELECT query_id FROM q WHERE {_STEPS}),
chosen AS (SELECT query_id, place, rank, sentence FROM best WHERE place <= 3 AND query_id NOT IN (SELECT query_id FROM steps) UNION ALL
  SELECT query_id, unnest(range(1, len(u) + 1)), 1, unnest(u) FROM (SELECT query_id, {_USABLE}[1:4] AS u FROM ev WHERE rank = 1 AND query_id IN (SELECT query_id FROM steps))),
placed AS (SELECT query_id, string_agg(row || '. ' || substr(sentence, 1, 320) || ' ' || cite, chr(10) ORDER BY row) AS lines FROM (SELECT c.*, cite, row_number() OVER (PARTITION BY c.query_id ORDER BY place) AS row FROM chosen c JOIN per USING (query_id, rank)) GROUP BY 1),
spares AS (SELECT query_id, string_agg(rank || '. ' || substr(spare, 1, 320) || ' ' || cite, chr(10) ORDER BY rank) AS lines FROM per WHERE rank <= 2 GROUP BY 1),
cites AS (SELECT query_id, string_agg(cite, ' ' ORDER BY rank) AS cites FROM per WHERE rank <= 3 GROUP BY 1),
pre AS (SELECT DISTINCT id AS query_id, CASE WHEN category = 'alarm_code' THEN 'Alarm' ELSE '' END AS prefix FROM formal_questions)
SELECT query_id, CASE WHEN prefix <> '' THEN prefix || chr(10) || coalesce('{L.MANUAL_EVIDENCE}' || chr(10) || p.lines || chr(10), '') || '来源：' || cites
  ELSE coalesce('{L.FROM_MANUALS}' || chr(10) || p.lines, '{L.FROM_FOREIGN_MANUALS}' || chr(10) || s.lines) END || chr(10) || '{L.SAFETY_NOTE}' AS answer
FROM cites JOIN pre USING (query_id) LEFT JOIN placed p USING (query_id) LEFT JOIN spares s USING (query_id)""",
    "answer_context": f"""WITH {_EVIDENCE}
SELECT query_id, string_agg('[来源' || rank || ']' || chr(10) || 'chunk_id: ' || doc_key || chr(10) || 'doc_name: ' || coalesce(doc_name, '') || chr(10) || 'page: ' || coalesce(page, 0) || chr(10) || 'section_path: ' || coalesce(array_to_string(section_path, ' > '), '') || chr(10) || 'evidence: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM ev GROUP BY 1""",
    "answer_drafts": f"""WITH {_EVIDENCE}, {_DRAFT},
used AS (SELECT query_id, unnest({_NUMBERS.format(c="regexp_replace(answer, '(?s)4\\. 引用来源.*?5\\. 安全提示', '5. 安全提示')", n="n")}) AS rank FROM draft JOIN (SELECT query_id, max(rank) AS n FROM ev GROUP BY 1) USING (query_id)),
lines AS (SELECT query_id, string_agg('- [来源' || rank || '] chunk_id: ' || doc_key || '；文档: ' || coalesce(doc_name, '') || '；第' || coalesce(page, 0) || '页；章节: ' || coalesce(nullif(array_to_string(section_path, ' > '), ''), '{L.NO_SECTION}'), chr(10) ORDER BY rank) AS lines FROM used JOIN ev USING (query_id, rank) GROUP BY 1)
SELECT query_id, CASE WHEN lines IS NULL THEN answer ELSE regexp_extract(answer, '(?s)^(.*?)4\\. 引用来源', 1) || '{_T[3]}' || chr(10) || lines || chr(10) || chr(10) || '{_T[4]}' || regexp_extract(answer, '(?s)5\\. 安全提示(.*)$', 1) END AS answer FROM draft LEFT JOIN lines USING (query_id)""",
    "answer_faults": f"""WITH {_EVIDENCE}, {_DRAFT}, {_CLAIM},
cited AS (SELECT *, list_transform(regexp_extract_all(claim, '{L.CITED_SOURCE}', 1), lambda x: CAST(x AS INT)) AS cited, (SELECT max(rank) FROM ev WHERE ev.query_id = claim.query_id) AS n FROM claim),
valid AS (SELECT *, list_distinct(list_filter(cited, lambda i: i >= 1 AND i <= n)) AS valid, regexp_replace(claim, '{L.CITED_SOURCE}', '', 'g') AS plain FROM cited),
one AS (SELECT v.*, len(valid) = 1 AND len(cited) = 1 AS one, coalesce(e.text, '') AS source FROM valid v LEFT JOIN ev e ON e.query_id = v.query_id AND len(valid) = 1 AND len(cited) = 1 AND e.rank = valid[1]),
faulted AS (SELECT query_id, no, CASE WHEN len(cited) = 0 THEN ['no source'] ELSE list_filter([CASE WHEN NOT one THEN 'not one source' END, CASE WHEN NOT regexp_matches(claim, '\\[来源\\s*[0-9]+(?:[:：][^\\]]*)?\\]\\s*[。！？；;]?$') THEN 'not at the end' END,
  CASE WHEN one AND len(list_filter({_WORDS.format(c='plain')}, lambda x: regexp_full_match(x, '(?i)MB_[A-Z0-9_]+') AND NOT contains(lower(source), lower(x)))) > 0 THEN 'identifier' END,
  CASE WHEN one AND len(list_filter([{', '.join(repr(w) for w in L.EXTENDING_WORDS)}], lambda w: contains(plain, w) AND NOT contains(source, w))) > 0 THEN 'wording' END], lambda x: x IS NOT NULL) END AS faults FROM one)
SELECT query_id, no, unnest(faults) AS fault FROM faulted UNION ALL SELECT query_id, 0, 'no claims' FROM cut WHERE len(c) = 0""",
    "answer_claims": f"""WITH {_EVIDENCE}, {_DRAFT}, {_CLAIM},
plain AS (SELECT *, {_strip("regexp_replace(claim, '\\[来源[^\\]]+\\]', '', 'g')")} AS plain, (SELECT max(rank) FROM ev WHERE ev.query_id = claim.query_id) AS n FROM claim),
idx AS (SELECT *, {_NUMBERS.format(c='claim', n='n')} AS indexes FROM plain WHERE length(plain) >= 8),
txt AS (SELECT query_id, no, string_agg(coalesce(doc_name, '') || ' ' || coalesce(array_to_string(section_path, ' '), '') || ' ' || coalesce(text, ''), chr(10) ORDER BY rank) AS text FROM (SELECT query_id, no, unnest(indexes) AS rank FROM idx) JOIN ev USING (query_id, rank) GROUP BY 1, 2),
lowered AS (SELECT i.*, t.text AS found, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low, {_WORDS.format(c='plain')} AS words,
  regexp_replace(regexp_replace(plain, '(?i)(?:^|[^A-Za-z0-9])V[0-9]+(?:\\.[0-9]+)+', ' ', 'g'), '{L.CLAIM_STATUS}', ' ', 'g') AS rest FROM idx i LEFT JOIN txt t USING (query_id, no)),
miss AS (SELECT *, len(list_filter(words, lambda x: regexp_full_match(x, '{_CLAIM_WORDS}') AND NOT (contains(low, lower(x)) OR {_ALIASES})))
  + len(list_filter(regexp_extract_all(plain, '(?i)(?:^|[^A-Za-z0-9])(V[0-9]+(?:\\.[0-9]+)+)', 1), lambda x: NOT contains(low, lower(x))))
  + len(list_filter(regexp_extract_all(plain, '{L.CLAIM_STATUS}'), lambda x: NOT (contains(low, lower(x)) OR regexp_matches(low, '(^|[^0-9a-f])0*' || coalesce(nullif(regexp_replace(regexp_replace(lower(x), '^(?:16#|0x)', ''), '^0+', ''), ''), '0') || '([^0-9a-f]|$)'))))
  + len(list_filter(regexp_extract_all(regexp_replace(rest, '([^A-Za-z0-9_.,])', '\\1\\1', 'g'), '(?:^|[^A-Za-z0-9_])([0-9][0-9,]*(?:\\.[0-9]+)?)(?:[^A-Za-z0-9_]|$)', 1), lambda x: NOT (contains(replace(low, ',', ''), replace(x, ',', '')) OR regexp_matches(replace(low, ',', ''), '(^|[^0-9])0*' || replace(coalesce(nullif(regexp_replace(replace(x, ',', ''), '^0+', ''), ''), '0'), '.', '\\.') || '([^0-9]|$)')))) AS missing FROM lowered),
done AS (SELECT *, {' OR '.join(f"contains(plain, '{w}')" for w in L.LIMITATION_WORDS)} AS limited,
  len(list_filter([{', '.join(repr(w) for w in L.BROAD_WORDS)}], lambda w: contains(plain, w) AND NOT contains(text, w) AND NOT (w = '通常' AND contains(text, '常见')) AND NOT (w = '可能' AND (contains(low, 'may') OR contains(low, 'can '))))) AS wide FROM miss),
cat AS (SELECT query_id, no, len(indexes) AS sources, CASE WHEN len(indexes) = 0 THEN CASE WHEN limited THEN 'checker_false_positive' ELSE 'evidence_not_enough' END WHEN found IS NULL THEN 'citation_too_broad' WHEN missing > 0 AND NOT limited THEN 'hallucination'
  WHEN wide > 0 THEN 'prompt_overgeneralization' WHEN len(indexes) > 1 THEN 'citation_too_broad' ELSE 'supported' END AS category FROM done)
SELECT *, category IN ('supported', 'checker_false_positive') AS supported FROM cat""",
    "answer_citations": f"""WITH {_EVIDENCE}, {_DRAFT},
ids AS (SELECT query_id, list(doc_key ORDER BY rank) AS e FROM ev WHERE rank <= 2 GROUP BY 1),
noted AS (SELECT query_id, e, list_distinct(regexp_extract_all(answer, '(?i)chunk_id\\s*[:：]\\s*([^；;\\s\\)）]+)', 1)) AS ids, list_transform(regexp_extract_all(answer, '\\[来源\\s*([0-9]+)\\b', 1), lambda x: CAST(x AS INT)) AS loose,
  list_sort(list_distinct(list_transform(regexp_extract_all(answer, '{L.CITED_SOURCE}', 1), lambda x: CAST(x AS INT)))) AS numbers, list_distinct(regexp_extract_all(answer, '{L.CITED_CHUNK}', 1)) AS chunks FROM draft JOIN ids USING (query_id))
SELECT query_id, (len(ids) > 0 OR len(loose) > 0) AND len(list_filter(ids, lambda x: NOT list_contains(e, x))) = 0 AND len(list_filter(loose, lambda i: i < 1 OR i > len(e))) = 0 AS valid,
  array_to_string(list_filter(numbers, lambda i: i < 1 OR i > len(e)), ' ') AS out_of_range, len(list_filter(chunks, lambda x: NOT list_contains(e, x))) AS unknown, len(e) > 0 AND len(chunks) = 0 AND len(numbers) = 0 AS uncited FROM noted""",
    "fact_parts": f"""WITH r AS (SELECT DISTINCT id, solution FROM verified_solutions WHERE solution IS NOT NULL),
p AS (SELECT id, solution, list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(solution, '{facts.ATOM_BREAKS}'), lambda x: {_strip('x')}), lambda x: x <> ''), lambda x: {_PLAIN_PREFIX}), lambda x: length({_NORMAL.format('x')}) >= 2) AS p FROM r),
a AS (SELECT id, CASE WHEN len(p) > 0 THEN p ELSE [solution] END AS p FROM p),
e AS (SELECT id, unnest(range(0, len(p))) AS no, unnest(p) AS part FROM a)
SELECT id, no, {_NORMAL.format('part')} AS part FROM e""",
    "fact_pairs": f"""WITH r AS (SELECT DISTINCT id, {_NORMAL.format('problem')} AS a, {_NORMAL.format('solution')} AS b FROM verified_solutions WHERE problem IS NOT NULL AND solution IS NOT NULL),
p AS (SELECT id, {_PAIRS.format(c='a')} AS x, {_PAIRS.format(c='b')} AS y FROM r)
SELECT id, len(x) AS pairs, round(len(list_intersect(x, y)) / greatest(1, len(x)), 6) AS share FROM p""",
    "fact_forbidden": f"""WITH r AS (SELECT DISTINCT id, answerable, fact FROM (SELECT id, answerable, unnest(forbidden_facts) AS fact FROM formal_questions) WHERE fact IS NOT NULL),
t AS (SELECT id, fact, {_TIGHT.format("CASE WHEN answerable THEN '禁止：' || fact ELSE fact || '。这里不得：' || fact END")} AS low, {_TIGHT.format('fact')} AS part FROM r),
s AS (SELECT id, fact, part, string_split(low, part) AS x FROM t WHERE part <> '' AND contains(low, part)),
b AS (SELECT id, fact, list_transform(range(1, len(x)), lambda i: right(list_reduce(x[1:i], lambda a, b: a || part || b), 24)) AS befores FROM s),
k AS (SELECT id, len(list_filter(befores, lambda b: NOT ({_NEGATED}))) > 0 AS violation FROM b)
SELECT id, count_if(violation) AS violations, count_if(NOT violation) AS negated FROM k GROUP BY 1""",
}
