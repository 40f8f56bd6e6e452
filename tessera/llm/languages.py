"""Problem 9: missing or wrong language labels, by fusing evidence.

Text likelihoods come from a naive Bayes model over words with a letter-trigram model behind it for words it has
not seen. To them are added the declared label, weighted by how often declared labels of that source agree with
the text, and the source's language mix, smoothed towards its family's and that towards the whole collection's.
Both are grouped counts over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint

LANGS = ("en", "zh", "de", "fr", "es", "it")
# Codes of three letters and English names of the languages.
NAMES = {
    "en": ("eng", "english"), "zh": ("zho", "chi", "cmn", "chinese", "mandarin"), "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"), "es": ("spa", "spanish", "castilian"), "it": ("ita", "italian"),
}
#: Labelled texts the model is fitted on at most.
MOST_SAMPLES = 10_000
#: Strength, in documents, of the family's mix in a source's, and of the collection's in a family's.
SMOOTHING = 20.0
#: A sentence has so many words or Chinese characters at least; without a stop at its end so many.
WORDS_STOPPED, WORDS_OPEN = 4, 8
CHARS_STOPPED, CHARS_OPEN = 6, 12

_TOKEN = re.compile("[\u4e00-\u9fff]|[^\\W_\u4e00-\u9fff]+")
_SENTENCE = re.compile("[^.!?。！？\\n]*(?:[.!?](?=\\S)(?![\"'”’»)\\]]*(?:\\s|$|[\u3400-\u9fff]))[^.!?。！？\\n]*)*(?:[.!?。！？]+[\"'”’»)\\]]*|\\n|$)")
_STOPS = ".!?。！？"


def declared(label: Column) -> Column:
    """The language a label names by code, locale or English name in any case, or null."""
    head = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)(?:[-_][A-Za-z0-9]+)*$", 1))
    rule = F.lit(None).cast("string")
    for lang in LANGS:
        rule = F.when(head.isin(lang, *NAMES[lang]), F.lit(lang)).otherwise(rule)
    return rule


def is_code(word: str) -> bool:
    """Whether a word has a digit or is of capitals only, and so is of no language."""
    return not word.isalpha() or (len(word) > 1 and word.isupper())


class Model:
    """Log-likelihoods of words in each language."""

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        words = [Counter() for _ in LANGS]
        grams = [Counter() for _ in LANGS]
        for lang, text in samples:
            if lang in LANGS and text:
                for w in _TOKEN.findall(text):
                    if not is_code(w):
                        words[LANGS.index(lang)][w.lower()] += 1
        for c, g in zip(words, grams):
            for w, n in c.items():
                for t in self._trigrams(w):
                    g[t] += n
        vocabulary = set().union(*words)
        totals = [sum(c.values()) + 0.5 * (len(vocabulary) + 1) for c in words]
        self.seen = {w: np.array([log((c[w] + 0.5) / t) for c, t in zip(words, totals)]) for w in vocabulary}
        kinds = len(set().union(*grams)) + 1
        self.grams = [(g, sum(g.values()) + 0.5 * kinds) for g in grams]

    @staticmethod
    def _trigrams(word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def score(self, word: str) -> np.ndarray:
        """Relative to the best language, so that only differences count."""
        w = word.lower()
        if w in self.seen:
            s = self.seen[w]
        elif "\u4e00" <= w <= "\u9fff":
            s = np.array([0.0 if x == "zh" else -6.0 for x in LANGS])
        else:
            # names are made up and the same everywhere: the mean of a few trigrams is all they say
            s = np.array([sum(log((g[t] + 0.5) / n) for t in self._trigrams(w)) / max(1, len(w)) for g, n in self.grams])
        return s - s.max()


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences and of lines without a stop. A stop between letters or digits, as in numbers, is none,
    unless a Chinese character follows."""
    out = []
    for m in _SENTENCE.finditer(text):
        if m.end() > m.start() and not m[0].isspace():
            out.append(m.span())
    return out


_SEGMENTS = "doc_id long, source string, label string, best int, segments array<struct<start:int,stop:int,words:int,sentences:int,loglik:array<double>>>"
_ROWS = "doc_id long, source string, label string, segment_no int, start int, stop int, words int, sentences int, language string, confidence double"


def _segmented(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        index: dict[str, int] = {}
        rows: list[np.ndarray] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                if len(index) > 300_000:
                    index, rows = {}, []
                out = []
                texts = b.column("text").to_pylist()
                spans, flat, counts, chinese = [], [], [], []
                for t in texts:
                    mine = sentences(t) if t else []
                    spans.append(mine)
                    for s, e in mine:
                        n, before = 0, len(flat)
                        for w in _TOKEN.findall(t, s, e):
                            i = index.get(w)
                            if i is None:
                                i = index[w] = -1 if is_code(w) else len(rows)
                                if i >= 0:
                                    rows.append(model.score(w))
                            if i >= 0:
                                flat.append(i)
                                n += "\u4e00" <= w <= "\u9fff"
                        counts.append(len(flat) - before)
                        chinese.append(n)
                n = np.array(counts, np.int64)
                scores = np.zeros((len(n), len(LANGS)))
                if flat:
                    some = n > 0
                    scores[some] = np.add.reduceat(np.array(rows)[flat], (np.cumsum(n) - n)[some], axis=0)
                best, k = scores.argmax(axis=1), 0
                doc_best: list[int | None] = []
                for t, mine in zip(texts, spans):
                    segments: list[dict] = []
                    for s, e in mine:
                        words, zh = counts[k], chinese[k]
                        stopped = t[s:e].rstrip(" \t\r\n\"'”’»)]")[-1:] in _STOPS
                        latin = words - zh
                        full = zh >= (CHARS_STOPPED if stopped else CHARS_OPEN) or latin >= (WORDS_STOPPED if stopped else WORDS_OPEN)
                        if words and full:
                            lang = int(best[k])
                            if segments and segments[-1]["lang"] == lang:
                                g = segments[-1]
                                g["stop"], g["words"], g["sentences"], g["loglik"] = e, g["words"] + words, g["sentences"] + 1, g["loglik"] + scores[k]
                            else:
                                segments.append({"lang": lang, "start": s, "stop": e, "words": words, "sentences": 1, "loglik": scores[k]})
                        k += 1
                    total = sum((g["loglik"] for g in segments), np.zeros(len(LANGS)))
                    doc_best.append(int(total.argmax()) if segments else None)
                    out.append([{x: g[x].tolist() if x == "loglik" else g[x] for x in ("start", "stop", "words", "sentences", "loglik")} for g in segments])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32()), ("sentences", pa.int32()), ("loglik", pa.list_(pa.float64()))]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("source"), b.column("label"), pa.array(doc_best, pa.int32()), pa.array(out, kind)], ["doc_id", "source", "label", "best", "segments"]
                )

    return work


def _shares(counts: Column, above: Column) -> Column:
    """Shares of ``counts`` smoothed by the shares ``above``."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, above, lambda n, p: (n + SMOOTHING * p) / (total + SMOOTHING))


def _priors(docs: DataFrame) -> DataFrame:
    """``source, n, above, trust``: each source's counts of languages, the smoothed shares of its family, and how often its
    labels agree with the text.

    Counts come from the text's own best language, by source, then by family (the source's name up to its first
    ``_`` or ``.``), then all."""
    judged = docs.where(F.col("best").isNotNull()).select("source", "label", F.col("best").alias("k"))
    family = F.regexp_extract("source", r"^([^_.]*)", 1)
    agrees = F.col("label") == F.element_at(F.array(*map(F.lit, LANGS)), F.col("k") + 1)
    by_source = judged.groupBy("source").agg(F.array(*[F.count_if(F.col("k") == i).cast("double") for i in range(len(LANGS))]).alias("n"), F.count_if(agrees).alias("agreed"), F.count("label").alias("labelled"))
    by_source = checkpoint(by_source.withColumn("family", F.coalesce(family, F.lit(""))))
    sums = F.array(*[F.sum(F.col("n")[i]) for i in range(len(LANGS))])
    all_n = by_source.agg(sums.alias("n"), F.sum("agreed").alias("agreed"), F.sum("labelled").alias("labelled")).first()
    total = sum(x or 0 for x in (all_n["n"] or [])) if all_n["n"] else 0
    shares = [((all_n["n"][i] or 0) + 1) / (total + len(LANGS)) for i in range(len(LANGS))]
    trust = ((all_n["agreed"] or 0) + 9) / ((all_n["labelled"] or 0) + 10)
    by_family = by_source.groupBy("family").agg(sums.alias("m")).select("family", _shares(F.col("m"), F.array(*map(F.lit, shares))).alias("above"))
    return by_source.join(by_family, "family").select("source", "n", "above", F.least(F.lit(0.98), (F.col("agreed") + SMOOTHING * trust) / (F.col("labelled") + SMOOTHING)).alias("trust"))


def _fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posteriors of segments: the text's likelihood, the source's mix without the document itself, and the label."""
    width = len(LANGS)
    names = pa.array(LANGS, pa.string())
    for b in batches:
        if not b.num_rows:
            continue
        known = b.column("trust").is_valid().to_numpy(zero_copy_only=False)
        n, above = np.zeros((len(known), width)), np.zeros((len(known), width))
        for values, c in ((n, "n"), (above, "above")):
            values[known] = b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        best = pc.fill_null(b.column("best"), -1).to_numpy(zero_copy_only=False)
        own = np.nonzero((best >= 0) & known)[0]
        n[own, best[own]] -= 1  # a document is no evidence for itself
        mixed = (n + SMOOTHING * above) / (n.sum(axis=1, keepdims=True) + SMOOTHING)
        prior = np.where(known[:, None], np.log(np.where(mixed > 0, mixed, 1.0)), 0.0)
        trust = pc.fill_null(b.column("trust"), 0.5).to_numpy(zero_copy_only=False)[:, None]
        said = pc.fill_null(pc.index_in(b.column("label"), value_set=names), -1).to_numpy(zero_copy_only=False)[:, None]
        prior += np.where((said >= 0) & known[:, None], np.where(np.arange(width) == said, np.log(trust), np.log((1 - trust) / (width - 1))), 0.0)
        count = pc.list_value_length(b.column("segments")).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = b.column("segments").flatten()
        owner = np.repeat(np.arange(len(count)), count)
        loglik = flat.field("loglik").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        evidence = loglik + prior[owner]
        odds = np.exp(evidence - evidence.max(axis=1, keepdims=True)) if len(evidence) else evidence
        sure = odds / odds.sum(axis=1, keepdims=True)
        # documents without a whole sentence have a row of their own
        bare = np.nonzero(count == 0)[0]
        doc = np.concatenate((owner, bare))
        no = np.concatenate((np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + 1, np.zeros(len(bare), np.int64)))
        lang = np.concatenate((sure.argmax(axis=1) if len(sure) else np.zeros(0, np.int64), np.full(len(bare), -1)))
        tail = lambda c, fill: pa.concat_arrays([flat.field(c), pa.array([fill] * len(bare), pa.int32())])
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [
                *(b.column(c).take(take) for c in ("doc_id", "source", "label")), pa.array(no.astype(np.int32)), tail("start", None), tail("stop", None), tail("words", 0), tail("sentences", 0),
                names.take(pa.array(lang, mask=lang < 0)), pa.array(np.concatenate((sure.max(axis=1) if len(sure) else np.zeros(0), np.zeros(len(bare))))),
            ],
            [c.split()[0] for c in _ROWS.split(", ")],
        )


def language_segments(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """Languages of documents and of their segments.

    ``documents``: ``doc_id, text, lang, source``; ``samples``: ``lang, text`` (at most ``MOST_SAMPLES`` are used).
    One row for each run of whole sentences of one language: ``doc_id, source, label`` (the language ``lang`` names,
    or null), ``segment_no``, ``start, stop`` (characters), ``words, sentences, language, confidence``. A document
    without a whole sentence (null, blank, numbers only, a few words) has one row with ``segment_no`` 0, null
    language and confidence 0. Repeated rows and null keys are kept as they are. The counts of a source are joined to
    its documents, each of which is taken out of them before they are its prior."""
    spark = documents.sparkSession
    rows = [(r["lang"], r["text"]) for r in samples.where("lang is not null and text is not null").select("lang", "text").limit(MOST_SAMPLES).collect()]
    shared = spark.sparkContext.broadcast(Model(rows))
    source = F.coalesce(F.col("source"), F.lit(""))
    docs = checkpoint(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source.alias("source"), declared(F.col("lang")).alias("label")).mapInArrow(_segmented(shared), _SEGMENTS))
    return docs.join(_priors(docs), "source", "left").select("doc_id", "source", "label", "best", "segments", "n", "above", "trust").mapInArrow(_fused, _ROWS)


def language_cases(segments: DataFrame, least: float = 0.9) -> DataFrame:
    """Documents and languages of whole sentences of theirs that their label doesn't name: ``doc_id, lang``."""
    sure = segments.where((F.col("segment_no") > 0) & (F.col("confidence") >= least))
    return sure.where(F.col("label").isNull() | (F.col("label") != F.col("language"))).where("doc_id is not null").select("doc_id", F.col("language").alias("lang")).distinct()


def document_languages(segments: DataFrame) -> DataFrame:
    """A language and a confidence for each document: that of most words, and its share of the words times the mean
    confidence of its segments. ``doc_id, language, confidence, languages`` (how many it has)."""
    by = segments.groupBy("doc_id", "language").agg(F.sum("words").alias("w"), F.sum(F.col("confidence") * F.col("words")).alias("c"))
    return by.groupBy("doc_id").agg(
        F.max_by("language", F.struct("w", "language")).alias("language"), F.coalesce(F.max_by("c", F.struct("w", "language")) / F.nullif(F.sum("w"), F.lit(0)), F.lit(0.0)).alias("confidence"), F.count("language").alias("languages")
    )
