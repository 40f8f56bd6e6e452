"""Batch retrieval: a frame of queries against a frame of documents.

Ranks are made by ``row_number`` over a score rounded to nine digits and then the document's key, so that equal
scores are ordered alike everywhere. Top-k goes through a window limit, which each partition applies before the
shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.session import checkpoint, plain_unions

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries of one block that is sent to all workers, and blocks that are sent at once: more queries take further passes
#: over the documents, so what is broadcast has a bound (about 32 MB of vectors of 256 numbers) whatever their number.
BLOCK, BLOCKS_AT_ONCE = 2048, 8
TERM_BLOCK = 256


def ranked(scored: DataFrame, top_k: int, query: str = "query_id", key: str = "doc_key", score: str = "score") -> DataFrame:
    """The best ``top_k`` of each query with their ``rank`` from 1."""
    order = W.partitionBy(query).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def postings(docs: DataFrame) -> DataFrame:
    """``doc_key, term, tf, length`` of ``docs`` (``doc_key, tokens``): the inverted index's rows."""
    return docs.select("doc_key", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("doc_key", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass
class Index:
    """Documents cut into tokens once: ``docs`` (``doc_key, tokens`` and other columns), the rarity of each term
    (``idf``: ``term, idf``), the number of documents, their mean length and the mean idf of the vocabulary."""

    docs: DataFrame
    idf: DataFrame
    n: int
    mean_length: float
    mean_idf: float


def build_index(docs: DataFrame) -> Index:
    """The index of ``docs`` (``doc_key, tokens`` and other columns, which stay). Texts are read and cut once, into a
    checkpoint; document frequencies, lengths and scores come from there."""
    docs = checkpoint(docs)
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean")).first()
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = checkpoint(df.select("term", (F.log(F.lit(float(stats["n"])) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")))
    return Index(docs, idf, stats["n"], stats["mean"] or 1.0, idf.agg(F.avg("idf")).first()[0] or 0.0)


def query_weights(queries: DataFrame, index: Index) -> DataFrame:
    """``query_id, term, w``: how often the query has the term, times its idf. A term in more than half of the documents
    has a negative idf; it gets ``EPSILON`` times the mean idf of the vocabulary. Terms of no document are left out."""
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("string").alias("query_id"), F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    w = F.col("times") * F.when(F.col("idf") < 0, F.lit(EPSILON * index.mean_idf)).otherwise(F.col("idf"))
    return asked.join(index.idf, "term").select("query_id", "term", w.alias("w"))


def _top(score: np.ndarray, key: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best with all that tie with the last within rounding."""
    if len(score) > top_k:
        near = score >= np.partition(score, -top_k)[-top_k] - 2e-9
        return score[near], key[near]
    return score, key


def _best_by_terms(blocks: list, mean_length: float, top_k: int, cols: list[str]):
    """Reads documents; gives each partition's own best of each query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                tokens = b.column("tokens")
                length = np.nan_to_num(pc.list_value_length(tokens).to_numpy(zero_copy_only=False)).astype(np.float64)
                flat = tokens.flatten()
                keys = np.array(b.column("doc_key").to_pylist(), object)
                owner = np.repeat(np.arange(len(keys)), length.astype(np.int64))
                meta = [np.array([(x or "").lower() for x in b.column(c).to_pylist()], object) for c in cols]
                for k, shared in enumerate(blocks):
                    names, terms, (first, query, w), wanted = shared.value
                    place = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy(zero_copy_only=False)
                    has = place >= 0
                    if not has.any():
                        continue
                    cells, counts = np.unique(owner[has] * len(terms) + place[has], return_counts=True)
                    doc, term = np.divmod(cells, len(terms))
                    some, row = np.unique(doc, return_inverse=True)
                    tf = counts * (K1 + 1) / (counts + K1 * (1 - B + B * length[doc] / mean_length))
                    # each document's term meets the queries that have it
                    many = first[term + 1] - first[term]
                    at_w = np.repeat(first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    cell, shape = np.repeat(row, many) * len(names) + query[at_w], (len(some), len(names))
                    scores = np.bincount(cell, np.repeat(tf, many) * w[at_w], len(some) * len(names)).reshape(shape)
                    common = np.bincount(cell, minlength=len(some) * len(names)).reshape(shape) > 0
                    for c, values in enumerate(meta):
                        mine, want = values[some][:, None], np.array([x[c] for x in wanted], object)[None, :]
                        common &= (mine == "") | (want == "") | (mine == want)
                    for i in np.nonzero(common.any(axis=0))[0].tolist():
                        hit = common[:, i]
                        score, key = scores[hit, i], keys[some[hit]]
                        if (k, i) in kept:
                            score, key = np.concatenate((kept[k, i][0], score)), np.concatenate((kept[k, i][1], key))
                        kept[k, i] = _top(score, key, top_k)
        yield from _hits(kept, [x.value[0] for x in blocks])

    return work


def _hits(kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], names: list[list[str]]) -> Iterator[pa.RecordBatch]:
    rows = [(names[k][i], x, float(v)) for (k, i), (score, key) in kept.items() for v, x in zip(score, key)]
    if rows:
        q, x, v = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(x, pa.string()), pa.array(v, pa.float64())], ["query_id", "doc_key", "score"])


_SCORES = "query_id string, doc_key string, score double"


def _in_passes(queries: DataFrame, size: int, block: Callable[[list], tuple], scan: Callable[[list], DataFrame]) -> DataFrame:
    """Scores of all queries, which stream through the driver in blocks of ``size``; ``BLOCKS_AT_ONCE`` blocks are sent
    to the workers at a time, and the pass's scores are written before the next blocks are sent."""
    sc = queries.sparkSession.sparkContext
    done: list[DataFrame] = []
    blocks, now = [], []

    def sent(last: bool) -> None:
        if now:
            blocks.append(sc.broadcast(block(now)))
            now.clear()
        if blocks and (last and not done):
            done.append(scan(list(blocks)))  # a single pass stays lazy
        elif blocks and (last or len(blocks) == BLOCKS_AT_ONCE):
            done.append(checkpoint(scan(list(blocks))))
            for b in blocks:
                b.destroy()
            blocks.clear()

    for r in queries.toLocalIterator():
        now.append(r)
        if len(now) == size and len(blocks) + 1 == BLOCKS_AT_ONCE:
            sent(False)
        elif len(now) == size:
            blocks.append(sc.broadcast(block(now)))
            now.clear()
    sent(True)
    out = done[0] if done else queries.sparkSession.createDataFrame([], _SCORES)
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def bm25_search(queries: DataFrame, index: Index, top_k: int = 30) -> DataFrame:
    """Top-k by Okapi BM25 under metadata filters: ``query_id, doc_key, score, rank``.

    ``queries``: ``query_id, tokens`` (a token given twice counts twice); both they and the index may have ``model``
    and ``version``, which must agree without regard to case where both are non-empty. Documents without a common
    term aren't listed, nor are scores of zero or less; but a query that would go empty gets one hit, the first
    document by key with a score of 0 (its best one where all terms are so common that scores are negative). Null query
    ids and keys take no part.

    Queries are a stated set of any size: their weights go to the documents in blocks (``_in_passes``), and each
    partition passes on its own best ``top_k`` of each query only."""
    plain_unions(queries.sparkSession)
    cols = [c for c in ("model", "version") if c in queries.columns and c in index.docs.columns]
    meta = queries.where("query_id is not null").select(F.col("query_id").cast("string").alias("query_id"), *[F.lower(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in cols]).distinct()
    weighted = query_weights(queries, index).groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    asked = weighted.join(meta, "query_id") if cols else weighted

    def block(rows: list) -> tuple:
        entries = sorted((t["term"], j, t["w"]) for j, r in enumerate(rows) for t in r["terms"] if t["w"])
        terms = sorted({t for t, _, _ in entries})
        number = {t: i for i, t in enumerate(terms)}
        counts = np.bincount([number[t] for t, _, _ in entries], minlength=len(terms)) if entries else np.zeros(0, np.int64)
        by_term = np.concatenate(([0], np.cumsum(counts))), np.array([j for _, j, _ in entries], np.int64), np.array([w for _, _, w in entries], np.float64)
        return [r["query_id"] for r in rows], pa.array(terms, pa.string()), by_term, [[r[f"_{c}"] for c in cols] for r in rows]

    docs = index.docs.where("doc_key is not null and tokens is not null").select(F.col("doc_key").cast("string").alias("doc_key"), "tokens", *cols)
    best = _in_passes(asked.orderBy("query_id"), TERM_BLOCK, block, lambda blocks: docs.mapInArrow(_best_by_terms(blocks, index.mean_length, top_k, cols), _SCORES))
    # where the vocabulary's mean idf is not negative, neither is a score, and a zero ties with documents without a common term
    hits = ranked(best.withColumn("score", F.round("score", 9)), top_k).where((F.col("score") > 0) | F.lit(index.mean_idf < 0) & (F.col("rank") == 1))
    empty = meta.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    # the first document by key that agrees: for each of its values, and for any (``*``)
    if cols:
        first, wanted = docs.select("doc_key", *[F.lower(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in cols]), empty
        for c in (f"_{c}" for c in cols):
            first = first.withColumn(c, F.explode(F.array(F.col(c), F.lit("*"))))
            wanted = wanted.withColumn(c, F.explode(F.when(F.col(c) == "", F.array(F.lit("*"))).otherwise(F.array(F.col(c), F.lit("")))))
        by = [f"_{c}" for c in cols]
        zero = wanted.join(first.groupBy(*by).agg(F.min("doc_key").alias("doc_key")), by).groupBy("query_id").agg(F.min("doc_key").alias("doc_key"))
    else:
        zero = empty.select("query_id", F.lit(docs.agg(F.min("doc_key")).first()[0]).alias("doc_key")).where("doc_key is not null")
    return hits.unionByName(zero.select("query_id", "doc_key", F.lit(0.0).alias("score"), F.lit(1).alias("rank")))


def hashed_vectors(tokens: Column, dim: int = 512, kind: str = "blake2b") -> Column:
    """A text's vector from its tokens: each adds its weight at the place, and with the sign, that its hash says;
    length one unless zero. ``kind`` is ``blake2b`` (64 bits, little-endian) or ``md5`` (its first 60 bits, which SQL
    can follow). Each distinct token of a batch is hashed once. Null tokens give the zero vector."""
    hashes = {"blake2b": lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little"), "md5": lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)}
    number = hashes[kind]

    @F.arrow_udf("array<double>")
    def embed(lists: pa.Array) -> pa.Array:
        n = len(lists)
        length = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = [number(t) if t is not None else 0 for t in words]
        place = np.array([h % dim for h in known], np.int64)
        weight = np.array([0.0 if t is None else (1.0 if h & 1 else -1.0) * (1 + log1p(len(t))) for t, h in zip(words, known)])
        which = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False)
        used = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        cell = np.repeat(np.arange(n), length) * dim
        v = np.bincount((cell + place[which])[used], weight[which][used], n * dim).reshape(n, dim) if len(words) else np.zeros((n, dim))
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v /= np.where(norm > 0, norm, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(v.reshape(-1)))

    return embed(tokens)


def embedder(name: str = "hash", dim: int = 512, model: Callable[[list[str]], np.ndarray] | None = None) -> tuple[Callable[[Column], Column], int, str]:
    """A function from a text column to a vector column, its dimension and the name of what is behind it.

    ``model``, if given for a ``name`` other than ``hash``, takes a list of texts and gives a matrix; its dimension is
    found by one probe. Without a model, any name falls back to hashed tokens of ``dim`` places."""
    if name.lower() == "hash" or model is None:
        return lambda c: hashed_vectors(T.embedding_tokens(F.coalesce(c, F.lit(""))), dim), dim, "hash"
    found = len(np.asarray(model(["probe"]))[0])

    def vectors(c: Column) -> Column:
        @F.arrow_udf("array<double>")
        def embed(texts: pa.Array) -> pa.Array:
            v = np.asarray(model([t or "" for t in texts.to_pylist()]), np.float64)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * found), pa.array(v.reshape(-1)))

        return embed(c)

    return vectors, found, name


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, each of length one unless zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1)


def dense_search(queries: DataFrame, docs: DataFrame, top_k: int = 30, *, exact_model: bool = False) -> DataFrame:
    """Exact top-k by cosine: ``query_id, doc_key, score, rank``.

    ``queries``: ``query_id, vector``; ``docs``: ``doc_key, vector``, all of one dimension; null vectors take no part.
    Queries are a stated set of any size; they are sent in blocks (``_in_passes``), and each partition keeps only its
    own best ``top_k`` for each. With ``exact_model``, both have ``model`` and ``version``, and a query's non-empty
    ones must equal the document's exactly, before the top-k."""
    cols = ["model", "version"] if exact_model else []

    def block(rows: list) -> tuple:
        m = np.array([r["vector"] for r in rows], np.float64)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return [str(r["query_id"]) for r in rows], m / np.where(norms > 0, norms, 1), [[r[c] or "" for c in cols] for r in rows]

    def best(blocks: list):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    b = whole.slice(at, 2048)
                    keys = np.array(b.column("doc_key").to_pylist(), object)
                    m = _matrix(b.column("vector"))
                    meta = [np.array(b.column(c).to_pylist(), object) for c in cols]
                    for k, shared in enumerate(blocks):
                        names, q, wanted = shared.value
                        s = np.round(q @ m.T, 9)
                        for i in range(len(names)):
                            score, key = s[i], keys
                            if any(wanted[i]):
                                fits = np.logical_and.reduce([values == want for values, want in zip(meta, wanted[i]) if want])
                                score, key = score[fits], key[fits]
                            if (k, i) in kept:
                                score, key = np.concatenate((kept[k, i][0], score)), np.concatenate((kept[k, i][1], key))
                            if len(score) > top_k:
                                near = np.nonzero(score >= np.partition(score, -top_k)[-top_k])[0]
                                near = near[np.lexsort((key[near].astype(str), -score[near]))][:top_k]
                                score, key = score[near], key[near]
                            kept[k, i] = score, key
            yield from _hits(kept, [x.value[0] for x in blocks])

        return work

    asked = queries.where("query_id is not null and vector is not null").select("query_id", "vector", *cols).orderBy("query_id")
    docs = docs.where("doc_key is not null and vector is not null").select(F.col("doc_key").cast("string").alias("doc_key"), "vector", *cols)
    return ranked(_in_passes(asked, BLOCK, block, lambda blocks: docs.mapInArrow(best(blocks), _SCORES)), top_k)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 60, limit: int = 20) -> DataFrame:
    """Reciprocal rank fusion of two rank lists: ``query_id, doc_key, score, dense_rank, bm25_rank, rank``. Ties go by
    first appearance, the dense list first."""
    plain_unions(dense.sparkSession)
    both = dense.select("query_id", "doc_key", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("bm25_rank"), (F.lit(0) + F.col("rank")).alias("seen"))
    both = both.unionByName(sparse.select("query_id", "doc_key", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("bm25_rank"), (F.lit(1_000_000) + F.col("rank")).alias("seen")))
    term = F.coalesce(F.lit(1.0) / (k + F.max("dense_rank")), F.lit(0.0)) + F.coalesce(F.lit(1.0) / (k + F.max("bm25_rank")), F.lit(0.0))
    sums = both.groupBy("query_id", "doc_key").agg(F.round(term, 12).alias("score"), F.max("dense_rank").alias("dense_rank"), F.max("bm25_rank").alias("bm25_rank"), F.min("seen").alias("seen"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("seen")


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, top_k: int = 5) -> DataFrame:
    """0.7 of the fused score and 0.3 of the share of the query's distinct tokens that the document has; ties keep the
    order before. ``query_id, doc_key, score, rerank_score, rank``."""
    joined = candidates.select("query_id", "doc_key", "score", F.col("rank").alias("was")).join(queries.select("query_id", F.array_distinct("tokens").alias("q")), "query_id")
    joined = joined.join(docs.select("doc_key", "tokens"), "doc_key")
    value = F.round(0.7 * F.col("score") + 0.3 * F.size(F.array_intersect("q", "tokens")) / F.greatest(F.lit(1), F.size("q")), 9)
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "was")
    return joined.select("query_id", "doc_key", "score", value.alias("rerank_score"), "was").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("was")


def hybrid_search(queries: DataFrame, index: Index, expanded: DataFrame, *, candidates: int = 30, fused: int = 20, top_k: int = 5) -> dict[str, DataFrame]:
    """The four rank lists of a hybrid search: ``dense_topk``, ``bm25_topk``, ``rrf_topk`` and ``final_evidence``, all with
    ``query_id, doc_key, score, dense_rank, bm25_rank, rerank_score, rank``.

    ``queries``: ``query_id, tokens, vector`` as asked, by which candidates are found; ``expanded``: ``query_id, tokens``,
    by which the fused ones are reranked, so that an added word can't push a candidate out. ``index`` has vectors."""
    none, no_score = F.lit(None).cast("int"), F.lit(None).cast("double")
    dense = dense_search(queries, index.docs, candidates)
    sparse = bm25_search(queries, index, candidates)
    both = fuse(dense, sparse, limit=fused)
    best = rerank(both, expanded, index.docs, top_k).join(both.select("query_id", "doc_key", "dense_rank", "bm25_rank"), ["query_id", "doc_key"])
    shape = lambda df, d, b, r: df.select("query_id", "doc_key", "score", d.alias("dense_rank"), b.alias("bm25_rank"), r.alias("rerank_score"), "rank")
    return {
        "dense_topk": shape(dense, F.col("rank"), none, no_score), "bm25_topk": shape(sparse, none, F.col("rank"), no_score),
        "rrf_topk": shape(both, F.col("dense_rank"), F.col("bm25_rank"), no_score), "final_evidence": shape(best, F.col("dense_rank"), F.col("bm25_rank"), F.col("rerank_score")),
    }


def trace_hits(lists: dict[str, DataFrame], docs: DataFrame) -> DataFrame:
    """Rank lists as one frame with a column ``stage``, scores to eight digits, and the other columns of ``docs``
    (``doc_key, ...``), which are joined to the hits only."""
    rows = None
    for stage, hits in lists.items():
        one = hits.select(F.lit(stage).alias("stage"), "query_id", "rank", "doc_key", F.round("score", 8).alias("score"), "dense_rank", "bm25_rank", F.round("rerank_score", 8).alias("rerank_score"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.join(docs.drop("text"), "doc_key")


def search_with_strategy(queries: DataFrame, index: Index, expanded: DataFrame, top_k: int = 5) -> DataFrame:
    """Each query by its own ``strategy``: ``dense`` and ``bm25`` give that list as it is, anything else a hybrid search:
    ``query_id, strategy, doc_key, score, rank``. ``queries``: ``query_id, strategy, tokens, vector``."""
    dense = dense_search(queries.where("strategy = 'dense'"), index.docs, top_k).withColumn("strategy", F.lit("dense"))
    sparse = bm25_search(queries.where("strategy = 'bm25'"), index, top_k).withColumn("strategy", F.lit("bm25"))
    rest = queries.where("strategy is null or strategy not in ('dense', 'bm25')")
    mixed = hybrid_search(rest, index, expanded.join(rest.select("query_id"), "query_id", "left_semi"), top_k=top_k)["final_evidence"]
    columns = ["query_id", "strategy", "doc_key", "score", "rank"]
    return dense.select(*columns).unionByName(sparse.select(*columns)).unionByName(mixed.withColumn("score", F.col("rerank_score")).withColumn("strategy", F.lit("hybrid")).select(*columns))


def model_rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, model: Callable[[list[str], list[str]], list[float]] | None = None, top_k: int = 5) -> DataFrame:
    """Candidates by the scores that ``model`` gives for lists of queries and texts, batch by batch; ties keep the order
    before. Without a model the words decide (``rerank``; then ``queries`` and ``docs`` need ``tokens``). With one:
    ``queries``: ``query_id, question``; ``docs``: ``doc_key, text``. ``query_id, doc_key, score, rerank_score, rank``."""
    if model is None:
        return rerank(candidates, queries, docs, top_k)

    @F.arrow_udf("double")
    def scored(q: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array(model([x or "" for x in q.to_pylist()], [x or "" for x in t.to_pylist()]), pa.float64())

    joined = candidates.select("query_id", "doc_key", "score", F.col("rank").alias("was")).join(queries.select("query_id", "question"), "query_id").join(docs.select("doc_key", "text"), "doc_key")
    rows = joined.select("query_id", "doc_key", "score", "was", scored("question", "text").alias("rerank_score"))
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "was")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("was")


def verified_first(verified: DataFrame, hits: DataFrame, top: int = 5) -> DataFrame:
    """Documents that a verified answer names (``query_id, doc_key, place``), then the hits, each document once, ``top`` in
    all: ``query_id, doc_key, verified, rank``."""
    both = verified.select("query_id", "doc_key", F.lit(0).alias("list"), F.col("place").cast("int").alias("at")).unionByName(hits.select("query_id", "doc_key", F.lit(1).alias("list"), F.col("rank").cast("int").alias("at")))
    once = both.groupBy("query_id", "doc_key").agg(F.min(F.struct("list", "at")).alias("first"))
    order = W.partitionBy("query_id").orderBy("first", "doc_key")
    return once.select("query_id", "doc_key", (F.col("first.list") == 0).alias("verified"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)


def evidence_supports(queries: DataFrame, hits: DataFrame, least: float = 0.75) -> DataFrame:
    """Whether a query's evidence (``query_id, text``) has at least ``least`` of the identifiers its ``question`` names, the
    names of device series apart: ``query_id, identifiers, supported, sufficient``. A query that names none is
    supported by any evidence, and by none without any."""
    named = F.array_except(T.technical_terms(F.coalesce("question", F.lit(""))), T.strings(L.SERIES_NUMBERS))
    asked = queries.select("query_id", named.alias("q"))
    has = hits.select("query_id", F.explode_outer(T.technical_terms(F.coalesce("text", F.lit("")))).alias("term"), F.lit(1).alias("_e"))
    wanted = asked.select("query_id", F.explode("q").alias("term"))
    met = has.join(wanted, ["query_id", "term"], "left_semi").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("supported"))
    some = has.select("query_id", "_e").distinct()
    rows = asked.join(met, "query_id", "left").join(some, "query_id", "left")
    n, supported = F.size("q"), F.coalesce("supported", F.lit(0))
    return rows.select("query_id", n.alias("identifiers"), supported.alias("supported"), (F.col("_e").isNotNull() & ((n == 0) | (supported / F.greatest(n, F.lit(1)) >= least))).alias("sufficient"))


def merge_rounds(rounds: DataFrame, top: int = 5) -> DataFrame:
    """Best score of each document over several rounds (``query_id, round, doc_key, score, rank``), the best ``top``;
    the earlier round and rank win ties."""
    first = W.partitionBy("query_id", "doc_key").orderBy(F.desc("score"), "round", "rank")
    best = rounds.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "round", "rank")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def similar_solutions(questions: DataFrame, solutions: DataFrame, least: float = 0.18, shared: int = 2, newest: int = 50) -> DataFrame:
    """For each question the solved problem most like it: ``query_id, solution_id, similarity``.

    ``questions``: ``query_id, model, question``; ``solutions``: ``id, model, problem, verified``. Of each model the
    ``newest`` verified solutions are candidates, with those of no model among them. Similarity is the cosine of term
    sets; at least ``shared`` common terms and ``least``; the newest wins ties. A question meets the
    solutions of its own model and those of none, ``newest`` at most each, by a join on (model, term)."""
    known = solutions.where("verified = 1").select("id", F.coalesce("model", F.lit("")).alias("own"), T.similarity_terms(F.coalesce("problem", F.lit(""))).alias("terms")).distinct()
    # the newest of each own model: only these can be among a model's newest
    pool = checkpoint(known.withColumn("_n", F.row_number().over(W.partitionBy("own").orderBy(F.desc("id")))).where(F.col("_n") <= newest).drop("_n"))
    wild = [r[0] for r in pool.where("own = ''").select("id").collect()]  # ``newest`` at most
    # with those of no model, a model's newest go down to this id
    ids = F.sort_array(F.concat("ids", F.array(*map(F.lit, wild)).cast("array<long>")), asc=False)
    lowest = pool.where("own != ''").groupBy(F.col("own").alias("model")).agg(F.collect_list("id").alias("ids")).select("model", F.coalesce(F.try_element_at(ids, F.lit(newest)), F.lit(-(1 << 62))).alias("lowest"))
    asked = questions.select("query_id", "model", T.similarity_terms(F.coalesce("question", F.lit(""))).alias("q"))
    both = F.when(F.col("model") == "", F.array("model")).otherwise(F.array("model", F.lit("")))
    left = asked.join(lowest, "model", "left").select("query_id", "lowest", F.size("q").alias("nq"), "q", F.explode(both).alias("own")).select("query_id", "lowest", "nq", "own", F.explode("q").alias("term"))
    right = pool.select("own", "id", F.size("terms").alias("nt"), F.explode("terms").alias("term"))
    pairs = left.join(right, ["own", "term"]).where(F.col("lowest").isNull() | (F.col("id") >= F.col("lowest"))).groupBy("query_id", "id", "nq", "nt").agg(F.count(F.lit(1)).alias("both"))
    score = F.round(F.col("both") / F.greatest(F.lit(1.0), F.sqrt(F.col("nq").cast("double") * F.col("nt"))), 9)
    good = pairs.where(F.col("both") >= shared).select("query_id", "id", score.alias("s")).where(F.col("s") >= least)
    best = F.max_by(F.struct("id", "s"), F.struct("s", "id"))
    return good.groupBy("query_id").agg(best.alias("b")).select("query_id", F.col("b.id").alias("solution_id"), F.round("b.s", 4).alias("similarity"))


#: Part of the score of a sentence that is of a manual and not of the project's own notes.
AUTHORITY = 0.05


def best_sentences(hits: DataFrame, limit: int = 2, least: int = 18, own_notes: str = "project_") -> DataFrame:
    """Sentences that answer a query best: ``query_id, place, rank, doc_key, sentence``.

    ``hits``: ``query_id, question, rank, doc_key, doc_name, representation, text``; a table's row is one sentence. A
    sentence scores the share of the expanded query's distinct tokens plus the share of its technical terms that it has,
    plus ``AUTHORITY`` unless its document's name begins with ``own_notes``. The best of the first hit comes first,
    then the best of all; repeats that differ in case or blanks only are left out."""
    expanded = T.expanded_query(F.col("question"))
    worth = F.when(F.lower(F.coalesce("doc_name", F.lit(""))).startswith(own_notes), 0.0).otherwise(AUTHORITY)
    q = hits.select(
        "query_id", "rank", "doc_key", worth.alias("worth"), F.array_distinct(T.chunk_tokens(F.lower(expanded))).alias("q"), F.array_except(T.technical_terms(expanded), T.strings(L.SERIES_NUMBERS)).alias("x"),
        F.when(F.col("representation") == "table_row", F.array(F.regexp_replace("text", f"{L.WS}+", " "))).otherwise(T.answer_sentences(F.col("text"))).alias("cut"),
    )
    rows = q.select("query_id", "rank", "doc_key", "worth", "q", "x", F.posexplode(F.transform("cut", T.strip)).alias("no", "sentence")).where((F.length("sentence") >= least) & ~F.contains("sentence", F.lit(" > ")))
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))
    score = F.round(share(F.col("q"), T.chunk_tokens(F.lower("sentence"))) + share(F.col("x"), T.technical_terms(F.col("sentence"))) + F.col("worth"), 9)
    rows = rows.select("query_id", "rank", "doc_key", "no", "sentence", score.alias("score"), F.regexp_replace(F.lower("sentence"), f"{L.WS}+", "").alias("mark"))
    lead = F.row_number().over(W.partitionBy("query_id").orderBy(F.when(F.col("rank") == 1, 0).otherwise(1), F.desc("score"), "rank", "no"))
    rows = rows.withColumn("first", (lead == 1) & (F.col("rank") == 1))
    once = F.row_number().over(W.partitionBy("query_id", "mark").orderBy(F.desc("first"), F.desc("score"), "rank", "no"))
    rows = rows.withColumn("_n", once).where("_n = 1")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("first"), F.desc("score"), "rank", "no"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "place", "rank", "doc_key", "sentence")


def stale_keys(index: DataFrame, current: DataFrame, key: str = "doc_key") -> DataFrame:
    """Keys the index still has though the corpus no longer does, and those it lacks: ``key, state``."""
    a, b = index.select(key).distinct(), current.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("state", F.lit("stale")).unionByName(b.join(a, key, "left_anti").withColumn("state", F.lit("absent")))
