"""Scalar text functions as Column expressions, which all stay in the JVM. Plain ones are part of generated code; those over
arrays (``transform``, ``filter``, ``zip_with``) are called from it and interpreted, element by element."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from tessera.functions import lexicon as L


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Without white space, as Unicode has it, at the ends."""
    return F.regexp_replace(c, f"^{L.WS}+|{L.WS}+$", "")


def collapse(c: Column) -> Column:
    """Null becomes empty, runs of white space one space; a table cell's text."""
    return F.coalesce(strip(F.regexp_replace(c, f"{L.WS}+", " ")), F.lit(""))


def clean_text(c: Column) -> Column:
    """Page text: soft hyphens go, words cut by a hyphen at a line's end are joined, blanks and empty lines collapse."""
    word = r"[\p{L}\p{N}_]"
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\u00ad", ""), "\x00", " "), f"(?<={word})-\n(?={word})", "")
    return strip(F.regexp_replace(F.regexp_replace(joined, "[ \t]+", " "), "\n{3,}", "\n\n"))


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def chunk_tokens(c: Column) -> Column:
    return find_all(c, L.CHUNK_TOKEN)


def search_tokens(c: Column) -> Column:
    """Words in order, then technical terms once more, so that these count double."""
    low = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("s7 1200"), F.lit("s7-1200"))
    return F.concat(find_all(low, L.WORD_TOKEN), find_all(low, L.TECH_TOKEN))


def embedding_tokens(c: Column) -> Column:
    """Tokens, then the pairs of neighbours among the Chinese characters (others may lie between them)."""
    tokens = find_all(F.lower(c), L.EMBEDDING_TOKEN)
    chinese = F.filter(tokens, lambda t: t.rlike(r"^[\x{4e00}-\x{9fff}]$"))
    pairs = F.when(F.size(chinese) > 1, F.zip_with(F.slice(chinese, 1, F.size(chinese) - 1), F.slice(chinese, 2, F.size(chinese) - 1), lambda a, b: F.concat(a, b)))
    return F.concat(tokens, F.coalesce(pairs, strings(())))


def technical_terms(c: Column) -> Column:
    """Distinct, lower-case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(find_all(c, L.TECHNICAL_TERM), F.lower)))


def similarity_terms(c: Column) -> Column:
    """Terms and pairs of Chinese characters within a run, distinct and sorted."""
    low = F.lower(c)
    runs = F.filter(find_all(low, r"[\x{4e00}-\x{9fff}]+"), lambda r: F.length(r) > 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.array_sort(F.array_distinct(F.concat(find_all(low, L.SIMILARITY_TERM), pairs)))


def search_terms(c: Column) -> Column:
    """The whole query and the technical terms in it, lower-case, each once, in order."""
    return F.filter(F.array_distinct(F.transform(F.concat(F.array(strip(c)), find_all(c, L.SEARCH_TERM)), F.lower)), lambda t: t != "")


def row_terms(c: Column) -> Column:
    """What a table-row look-up looks for: the whole query and its codes, words and versions, each once."""
    return F.filter(F.array_distinct(F.transform(F.concat(F.array(strip(c)), find_all(c, L.ROW_TERM)), F.lower)), lambda t: t != "")


def sentences(c: Column) -> Column:
    """Parts after each stop and between line ends, stripped, without empty ones."""
    parts = F.split(F.regexp_replace(c, f"([{L.SENTENCE_STOPS}])", "$1\n"), "\n+", -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def canonical_term(c: Column) -> Column:
    """Without punctuation at the ends and blanks inside; codes and ASCII words in capitals."""
    edge = r"[，。！？；：,!?;:()\[\]{}]+"
    value = F.regexp_replace(F.regexp_replace(strip(c), f"^{edge}|{edge}$", ""), f"{L.WS}+", "")
    return F.when(value.rlike(r"^16#[0-9A-Fa-f]+$") | value.rlike(r"^[A-Za-z][A-Za-z0-9_-]*$"), F.upper(value)).otherwise(value)


def canonical_terms(terms: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(terms, canonical_term)), lambda t: t != "")


def is_generic(term: Column) -> Column:
    """Of a canonical term: a single digit, a word of the closed list or a single character; identifiers never."""
    kept = term.isin(*L.SHORT_TERMS_KEPT) | term.rlike(r"^16#[0-9A-F]+$")
    return ~kept & (term.rlike(r"^[0-9]$") | F.upper(term).isin(*L.GENERIC_TERMS) | (F.length(term) < 2))


def telling_terms(terms: Column) -> Column:
    return F.filter(canonical_terms(terms), lambda t: ~is_generic(t))


def generic_terms(c: Column) -> Column:
    """Words of the closed list in a text, the longest first; ASCII ones as whole words."""
    order = sorted(L.GENERIC_TERMS, key=lambda t: (-len(t), t))
    hits = [F.when(c.rlike(f"(?i)(?<![A-Za-z0-9_-]){t}(?![A-Za-z0-9_-])") if t.isascii() else c.contains(t), F.lit(t)) for t in order]
    return F.filter(F.array(*hits), lambda t: t.isNotNull())


def looks_like_links(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(c).contains(m) for m in L.LINK_MARKS])


def alarm_code(c: Column) -> Column:
    """A prefixed code; else four hexadecimal digits with a letter; else, beside a word for error, four digits. Null if none."""
    word = reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in L.ALARM_WORDS])
    found = lambda x, rx: F.nullif(F.regexp_extract(x, rx, 1), F.lit(""))
    return F.coalesce(found(c, L.PREFIXED_CODE), found(c, L.BARE_CODE), F.when(word, found(F.replace(c, F.lit(L.MODEL_NAME), F.lit("")), L.DIGIT_CODE)))


def normal_code(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.upper(c), F.lit("W#"), F.lit("")), F.lit("16#"), F.lit("")), F.lit("0X"), F.lit(""))


def value_and_unit(c: Column, model: str = L.MODEL_NAME) -> Column:
    """The first number and its unit (null if none) once the model's name is gone."""
    rest = F.replace(c, F.lit(model), F.lit(""))
    number = F.regexp_extract(rest, L.VALUE_AND_UNIT, 1)
    return F.struct(number.try_cast("double").alias("value"), F.nullif(F.regexp_extract(rest, L.VALUE_AND_UNIT, 2), F.lit("")).alias("unit"))


def expanded_terms(c: Column) -> Column:
    """Terms of the expansion table whose trigger is in the query and that are not, and bare status codes with their
    prefix; each once, in order."""
    low = F.lower(c)
    groups = []
    for triggers, terms in L.QUERY_EXPANSION:
        hit = reduce(lambda a, b: a | b, [low.contains(t) for t in triggers])
        groups.append(F.when(hit, F.filter(strings(terms), lambda t: ~low.contains(F.lower(t)))).otherwise(strings(())))
    marked = reduce(lambda a, b: a | b, [low.contains(m) for m in L.STATUS_MARKS])
    codes = F.transform(F.regexp_extract_all(low, F.lit(r"(?<![0-9a-f])([0-9a-f]{4})(?![0-9a-f])"), F.lit(1)), lambda x: F.concat(F.lit("16#"), F.upper(x)))
    codes = F.when(marked, F.filter(codes, lambda x: ~low.contains(F.lower(x)))).otherwise(strings(()))
    return F.array_distinct(F.concat(*groups, codes))


def expanded_query(c: Column) -> Column:
    return strip(F.array_join(F.concat(F.array(c), expanded_terms(c)), " "))


def redacted(c: Column) -> Column:
    """Without texts shaped like credentials."""
    return reduce(lambda x, rx: F.regexp_replace(x, rx, "[REDACTED]"), L.SECRET_TEXTS, c)


def secret_kinds(c: Column) -> Column:
    """Numbers, from 0, of the credential patterns that a text matches."""
    return F.filter(F.array(*[F.when(c.rlike(rx), F.lit(i)) for i, rx in enumerate(L.SECRET_TEXTS)]), lambda x: x.isNotNull())


def is_secret_key(name: str | Column) -> bool | Column:
    """Whether a name is one of credentials."""
    if isinstance(name, str):
        return any(x in name.lower().replace("-", "_") for x in L.SECRET_KEYS)
    low = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    return reduce(lambda a, b: a | b, [low.contains(x) for x in L.SECRET_KEYS])


def without_secret_keys(m: Column) -> Column:
    """A map without keys that name credentials, values redacted."""
    kept = F.map_filter(m, lambda k, v: ~is_secret_key(k))
    return F.transform_values(kept, lambda k, v: redacted(v))


def survives(kind: DataType) -> bool:
    """Whether anything is left of a value of this type without fields that name credentials."""
    return not isinstance(kind, StructType) or any(not is_secret_key(f.name) and survives(f.dataType) for f in kind)


def sanitised(c: Column, kind: DataType) -> Column:
    """A value of any type, however nested, without fields and keys that name credentials, its texts redacted."""
    if isinstance(kind, StringType):
        return redacted(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: sanitised(x, kind.elementType))
    if isinstance(kind, MapType):
        kept = F.map_filter(c, lambda k, v: ~is_secret_key(k)) if isinstance(kind.keyType, StringType) else c
        return F.transform_values(kept, lambda k, v: sanitised(v, kind.valueType))
    if isinstance(kind, StructType):
        fields = [sanitised(c[f.name], f.dataType).alias(f.name) for f in kind if not is_secret_key(f.name) and survives(f.dataType)]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def release_faults(path: Column, content: Column) -> Column:
    """What forbids a file to be published: ``path`` for a private path, and the names of the secrets that its text holds. A
    text with a zero byte isn't looked into."""
    private = reduce(lambda a, b: a | b, [path.rlike(rx) for rx in L.PRIVATE_PATHS]) & ~path.rlike(L.PUBLIC_PATHS)
    found = [F.when(private, F.lit("path"))] + [F.when(~F.contains(content, F.lit("\x00")) & content.rlike(rx), F.lit(name)) for name, rx in L.RELEASE_SECRETS]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def log_secrets(c: Column) -> Column:
    """Names of the marks of credentials in a log's text."""
    return F.filter(F.array(*[F.when(c.rlike(rx), F.lit(name)) for name, rx in L.LOG_SECRETS]), lambda x: x.isNotNull())


def source_indexes(c: Column, most: Column | None = None) -> Column:
    """Cited source numbers, distinct and sorted, of 1..most only if ``most`` is given."""
    found = F.transform(F.regexp_extract_all(c, F.lit(L.CITED_SOURCE), F.lit(1)), lambda x: x.cast("int"))
    if most is not None:
        found = F.filter(found, lambda x: (x >= 1) & (x <= most))
    return F.array_sort(F.array_distinct(found))


def cited_chunks(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(L.CITED_CHUNK), F.lit(1)))


def contains_loosely(text: Column, part: Column) -> Column:
    """Containment that ignores case and white space."""
    return F.contains(F.regexp_replace(F.lower(text), f"{L.WS}+", ""), F.regexp_replace(F.lower(part), f"{L.WS}+", ""))


def bigrams(c: Column) -> Column:
    return F.when(F.length(c) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2))))).otherwise(strings(()))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)


def answer_sentences(c: Column) -> Column:
    """Parts after each stop, the ASCII full stop among them, and between line ends; not stripped."""
    return F.split(F.regexp_replace(c, "([。！？.!?])", "$1\n"), "\n+", -1)


def useful_sentence(c: Column, least: int = 18) -> Column:
    """The first sentence of at least so many characters without a path mark; null if none."""
    return F.try_element_at(F.filter(F.transform(answer_sentences(c), strip), lambda s: (F.length(s) >= least) & ~F.contains(s, F.lit(" > "))), F.lit(1))


def rewritten_query(question: Column, model: Column, version: Column) -> Column:
    """A question without filler words, with model, version and general words after it."""
    parts = F.filter(F.array(F.coalesce(model, F.lit("")), F.coalesce(version, F.lit("")), F.lit(" ".join(L.RETRY_WORDS))), lambda x: x != "")
    return F.concat(strip(F.regexp_replace(question, L.QUERY_FILLERS, " ")), F.lit(" "), F.array_join(parts, " "))


def retry_query(question: Column, model: Column, version: Column, missing: Column) -> Column:
    """A question without filler words, then its model, version, ``missing`` terms and general words, each once."""
    said = F.array(F.regexp_replace(question, L.QUERY_FILLERS, " "), F.coalesce(model, F.lit("")), F.coalesce(version, F.lit("")))
    parts = F.transform(F.concat(said, F.coalesce(missing, strings(())), strings(L.RETRY_WORDS)), strip)
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), " ")


def chunk_family(c: Column) -> Column:
    return F.regexp_replace(c, "_[^_]*_[^_]*$", "")


def display_version(c: Column) -> Column:
    """Versions written in several ways (V4.2, v4.2, 4.2) as one; empty stays empty."""
    v = F.regexp_extract(F.coalesce(c, F.lit("")), r"([0-9]+(?:\.[0-9]+)+)", 1)
    return F.when(v == "", F.lit("")).otherwise(F.concat(F.lit("V"), v))
