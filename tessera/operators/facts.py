"""Facts, claims and citations of answers, checked against the texts they rest on."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T

# Phrases that count as one, the longest first within each group when they are replaced.
SAME_PHRASES = (
    (("需要检查", "需要核对", "应当检查", "应当核对", "应检查", "应核对", "应确认", "必须检查", "必须核对", "必须确认", "需检查", "需核对", "确认", "检查", "验证"), "核对"),
    (("正在运行", "运行状态", "处于运行状态"), "运行"),
    (("通信伙伴", "从站", "对端设备", "远端设备"), "对端"),
    (("没有收到响应", "未收到响应", "没有响应", "未响应"), "未响应"),
    (("从零开始", "从0开始", "零基"), "零基"),
    (("会产生", "常会产生", "可能导致", "会导致", "造成"), "导致"),
    (("调用时序", "调用节拍"), "调用时序"),
    (("网络可达", "网络可达性"), "网络可达"),
    (("不可以", "不可", "不能"), "不能"),
    (("不应该", "不应", "不要"), "不应"),
    (("功能安全评估", "功能安全评价"), "功能安全评估"),
    (("现场工程师", "现场有资质工程师", "有资质人员"), "现场有资质工程师"),
    (("参数错误", "参数异常"), "参数错误"),
    (("错误值", "数值错误"), "错误值"),
    (("读取长度", "请求长度", "数据长度"), "数据长度"),
    (("描述为", "定义为", "表示"), "表示"),
    (("是否匹配", "相匹配", "匹配"), "匹配"),
    (("连接描述错误", "连接描述无效", "连接描述不受支持"), "连接描述问题"),
    (("字节排列", "字节序排列", "字排列", "字序排列"), "字序"),
    (("不能因数值看起来接近", "不能只凭数值看起来接近"), "不能凭近似数值"),
    (("modbus 不统一规定多个寄存器之间的字顺序", "modbus未规定跨寄存器的字顺序", "多寄存器数值的字顺序由设备实现决定"), "多寄存器字顺序由设备决定"),
)
LEADING_WORDS = ("还需", "还应", "需要", "应当", "应", "必须", "同时", "并")
NEGATIONS = ("不要", "不应", "不能", "禁止", "避免", "不允许", "不得", "不建议", "无法", "不会", "不提供", "不可", "拒绝")
SOURCE_MARK = r"\[来源[^\]]+\]"
ATOM_BREAKS = r"[，,；;、]|(?:以及|并且|同时|而且|还应|并应|且应|和|及|或)"
NARRATIVE = r"(?s)1\. 结论(.*?)4\. 引用来源"
SECTION_TITLES = r"(?:^|\n)\s*[123]\.\s*(?:结论|原因|排查\s*/\s*换算建议)\s*"


def tight(c: Column) -> Column:
    """Lower-case without white space."""
    return F.regexp_replace(F.lower(c), f"{L.WS}+", "")


def normal_fact(c: Column) -> Column:
    """Without source marks and punctuation, phrases of one meaning made one."""
    value = F.lower(F.regexp_replace(c, SOURCE_MARK, ""))
    for phrases, one in SAME_PHRASES:
        value = reduce(lambda v, p: F.replace(v, F.lit(p), F.lit(one)), sorted(phrases, key=len, reverse=True), value)
    return F.regexp_replace(value, r"[^\x{4e00}-\x{9fff}A-Za-z0-9#_.]+", "")


def atomic_parts(c: Column) -> Column:
    """A fact's parts at separators and conjunctions, without a leading filler word; the fact itself if none is left."""
    parts = F.filter(F.transform(F.split(c, ATOM_BREAKS, -1), T.strip), lambda x: x != "")

    def plain(x: Column) -> Column:
        out = x
        for w in reversed(LEADING_WORDS):
            out = F.when(x.startswith(w) & (F.length(x) > len(w) + 1), F.substr(x, F.lit(len(w) + 1))).otherwise(out)
        return out

    kept = F.filter(F.transform(parts, plain), lambda x: F.length(normal_fact(x)) >= 2)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(c))


def fact_similarity(a: Column, b: Column, normal: bool = False) -> Column:
    """The larger of the matching-blocks ratio of two facts and the share of the first one's pairs of characters that the
    second has; 0 where either is empty. ``normal``: both are normal facts already, as columns that were worked out
    once should be."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() if p and q else 0.0 for p, q in zip(x, y)])

    x, y = (a, b) if normal else (normal_fact(a), normal_fact(b))
    pairs = T.bigrams(x)
    recall = F.size(F.array_intersect(pairs, T.bigrams(y))) / F.greatest(F.lit(1), F.size(pairs))
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), 0.0).otherwise(F.greatest(ratio(x, y), recall))


def fact_met(atom: Column, text: Column, threshold: float) -> Column:
    """Whether a text holds a fact: as part of it once both are normal; else, if all identifiers and numbers of the fact are in
    it, by a segment that is at least ``threshold`` like it or by the share of the fact's pairs of characters that all of
    the text has. Facts of four characters or fewer are met as parts only. Segments that can't reach the threshold, by the
    letters they have in common, are never compared in full."""

    @F.pandas_udf("double")
    def nearest(facts_: pd.Series, segments: pd.Series) -> pd.Series:
        out = []
        for a, bs in zip(facts_, segments):
            best = 0.0
            m = SequenceMatcher(None)
            m.set_seq2(a or "")
            for b in bs if bs is not None else ():
                m.set_seq1(b)
                if m.real_quick_ratio() > best and m.quick_ratio() > best:
                    # the ratio depends on the order of the two; it is taken from the fact to the segment
                    best = max(best, SequenceMatcher(None, a, b).ratio())
            out.append(best)
        return pd.Series(out, dtype="float64")

    a, t = normal_fact(atom), normal_fact(text)
    tokens = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(L.FACT_TOKEN), F.lit(0)), F.lower))
    segments = F.filter(F.transform(F.split(F.regexp_replace(text, SOURCE_MARK, ""), L.FACT_BREAKS, -1), normal_fact), lambda x: x != "")
    pairs = T.bigrams(a)
    share = lambda other: F.size(F.array_intersect(pairs, T.bigrams(other))) / F.greatest(F.lit(1), F.size(pairs))
    recall = F.coalesce(F.array_max(F.transform(segments, share)), F.lit(0.0))
    like = F.greatest(nearest(a, segments), recall) >= threshold
    spread = share(t) >= min(0.78, threshold + 0.06)
    return ((a != "") & F.contains(t, a)) | ((F.size(F.array_except(tokens(a), tokens(t))) == 0) & (F.length(a) > 4) & (like | spread))


def group_coverage(answer: Column, groups: Column) -> Column:
    """Share of the groups of which the answer has any member, without regard to case and blanks; 0 without groups."""
    low = F.replace(F.lower(F.coalesce(answer, F.lit(""))), F.lit(" "), F.lit(""))
    groups = F.coalesce(groups, F.array().cast("array<array<string>>"))
    met = F.filter(groups, lambda g: F.exists(F.coalesce(g, F.array().cast("array<string>")), lambda v: F.contains(low, F.replace(F.lower(F.coalesce(v, F.lit("\x00"))), F.lit(" "), F.lit("")))))
    return F.when(F.size(groups) > 0, F.size(met) / F.size(groups)).otherwise(0.0)


def facts_met(answer: Column, facts: Column) -> Column:
    """Facts that the answer contains word for word, without regard to case and white space; nulls never."""
    low = tight(F.coalesce(answer, F.lit("")))
    return F.filter(F.coalesce(facts, F.array().cast("array<string>")), lambda f: F.contains(low, tight(f)))


def affirmed(answer: Column, fact: Column, reach: int = 24) -> Column:
    """Whether some mention of the fact has no negation in the ``reach`` characters before it; null if it is nowhere."""
    low, part = tight(answer), tight(fact)
    places = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - F.length(part) + 1)), lambda i: i.cast("int")), lambda i: F.substr(low, i, F.length(part)) == part)
    before = lambda i: F.substr(low, F.greatest(F.lit(1), i - reach), F.least(F.lit(reach), i - 1))
    negated = lambda i: reduce(lambda a, b: a | b, [F.contains(before(i), F.lit(n)) for n in NEGATIONS])
    return F.when((part != "") & (F.size(places) > 0), F.exists(places, lambda i: ~negated(i)))


def forbidden_mentions(answer: Column, fact: Column, reach: int = 24) -> Column:
    """How an answer mentions a forbidden fact: ``violation`` if some mention has no negation in the ``reach`` characters
    before it, ``negated`` if all have one, null if it doesn't. Mentions are taken one after another, without overlap."""
    low, part = tight(answer), tight(fact)
    pieces = F.split(low, F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    before = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.right(F.call_function("array_join", F.slice(pieces, F.lit(1), i), part), F.lit(reach)))
    negated = lambda c: reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in NEGATIONS])
    return F.when((part == "") | part.isNull() | low.isNull() | ~F.contains(low, part), None).when(F.exists(before, lambda c: ~negated(c)), "violation").otherwise("negated")


def claims(answer: Column, least: int = 3) -> Column:
    """Sentences of an answer's narrative, between its first title and its list of sources."""
    body = F.regexp_replace(F.regexp_extract(answer, NARRATIVE, 1), SECTION_TITLES, "\n")
    parts = F.split(F.regexp_replace(body, r"([。！？；;])\s*(?!\[来源)", "$1\n"), "\n+", -1)
    parts = F.transform(parts, lambda x: F.regexp_replace(x, r"^[ \-•\t]+|[ \-•\t]+$", ""))
    return F.filter(parts, lambda x: F.length(F.regexp_replace(F.regexp_replace(x, L.CITED_SOURCE, ""), r"^[ 。；;\t]+|[ 。；;\t]+$", "")) >= least)


def source_ranges(c: Column, most: Column) -> Column:
    """Cited source numbers with ranges such as 1-3 written out, those of 1 to ``most``, sorted."""
    labels = F.regexp_extract_all(c, F.lit(r"\[来源([^\]]+)\]"), F.lit(1))
    spans = F.flatten(F.transform(labels, lambda x: F.regexp_extract_all(x, F.lit(r"[0-9]+(?:\s*[–—-]\s*[0-9]+)?"), F.lit(0))))

    def numbers(x: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("int"))
        return F.sequence(F.array_min(ends), F.array_max(ends))

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(spans, numbers)), lambda i: (i >= 1) & (i <= most))))


def citation_faults(answer: Column, evidence: Column) -> Column:
    """``unknown`` cited chunk ids, ``out_of_range`` source numbers, and ``uncited`` if there is evidence and none is cited."""
    ids, numbers = T.cited_chunks(answer), T.source_indexes(answer)
    return F.struct(
        F.array_sort(F.array_except(ids, evidence)).alias("unknown"), F.filter(numbers, lambda i: (i < 1) | (i > F.size(evidence))).alias("out_of_range"), ((F.size(evidence) > 0) & (F.size(ids) == 0) & (F.size(numbers) == 0)).alias("uncited")
    )


def requested_versions(c: Column) -> Column:
    """Versions a text asks for: V and numbers, and numbers after the words for firmware and manual."""
    marked = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)(?<![A-Za-z0-9])V[0-9]+(?:\.[0-9]+)+"), F.lit(0)), F.upper)
    named = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)(?:固件|手册)(?:版本)?\s*([0-9]+(?:\.[0-9]+)+)"), F.lit(1)), lambda x: F.concat(F.lit("V"), x))
    return F.array_sort(F.array_union(marked, named))


def expected_terms(hits: DataFrame, terms: DataFrame, k: int = 5) -> DataFrame:
    """For each query whether a hit up to ``k`` has any expected term in its name or text, and the first rank that has:
    ``query_id, hit, mrr``. ``hits``: ``query_id, rank, name, text``; ``terms``: ``query_id, terms``."""
    low = F.lower(F.concat_ws(" ", "name", "text"))
    some = F.exists("terms", lambda t: F.contains(low, F.lower(t)))
    found = terms.join(hits.where(F.col("rank") <= k), "query_id", "left").groupBy("query_id").agg(F.min(F.when(some, F.col("rank"))).alias("first"))
    return found.select("query_id", F.col("first").isNotNull().cast("int").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def with_overrides(rows: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns that ``overrides`` has for their keys (distinct) put in place of their own, unless null."""
    named = [c for c in overrides.columns if c not in keys]
    joined = rows.join(overrides.withColumnsRenamed({c: f"_new_{c}" for c in named}), keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in named else F.col(c) for c in rows.columns])


def deltas(now: DataFrame, before: DataFrame) -> DataFrame:
    """Changes of metrics that both have: ``metric, value, baseline, delta``; both: ``metric, value``."""
    return now.join(before.withColumnRenamed("value", "baseline"), "metric").select("metric", "value", "baseline", F.round(F.col("value") - F.col("baseline"), 9).alias("delta"))
