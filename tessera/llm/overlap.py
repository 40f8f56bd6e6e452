"""Problem 3: same or near-same records across splits.

A question is taken as its distinct words, rarest first, so order and repetition don't matter. The evaluation
questions are indexed in shards by an FM index: the Burrows-Wheeler transform of the words with its counts and ranks, which
holds no text beside it. Training questions are streamed through the index by backward search. A question that shares the
share t of all words with another one has a word in common among its ``n - ceil(t n) + 1`` rarest, and so has the
other: the search for those words finds where to begin. From there it goes back word by word through each text found, which
gives the maximal matches of the two; their spans are merged, and the words they cover, counted, decide.

Both splits are divided by the set of their words with a digit, which has to be the same; a common set is cut into a
grid of evaluation shards and blocks of training questions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.pairs import expand_pairs
from tessera.llm.text import words_of
from tessera.session import checkpoint

#: Evaluation questions of one index, and training questions of one block that is streamed through it.
SHARD, BLOCK = 2_000, 20_000
#: Places in the index that are followed at once.
AT_ONCE = 1_000_000


class FMIndex:
    """Backward search over texts of word numbers from 2 to ``most``; 1 ends each text, 0 the whole."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, most: int) -> None:
        n = len(lengths)
        ends = np.cumsum(lengths + 1)
        flat = np.zeros(int(ends[-1]) + 1 if n else 1, np.int64)
        owner = np.repeat(np.arange(n + 1), np.append(lengths + 1, 1))
        flat[ends - 1] = 1
        place = np.arange(len(flat)) - np.append(ends - lengths - 1, len(flat) - 1)[owner]
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = inner[-1] = False
        flat[inner] = words
        order = self._suffixes(flat)
        #: the transform, and how many symbols are smaller than each
        self.last = flat[order - 1].astype(np.int32)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(self.last, minlength=most + 1))))
        #: where a row's last symbol is as a first one: counts and ranks in one step
        self.back = np.empty(len(flat), np.int32)
        self.back[np.argsort(self.last, kind="stable")] = np.arange(len(flat))
        #: text and place of each row's first symbol, the texts' lengths, and the rows of their ends
        self.owner, self.place, self.lengths = owner[order].astype(np.int32), place[order].astype(np.int32), lengths
        rows = np.arange(self.less[1], self.less[2])
        self.ends = np.empty(n, np.int64)
        self.ends[self.owner[rows]] = rows

    @staticmethod
    def _suffixes(flat: np.ndarray) -> np.ndarray:
        """Suffix array by doubling."""
        n = len(flat)
        rank = np.unique(flat, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + 2) + nxt
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            if rank[order[-1]] == n - 1:
                return order
            step *= 2

    def matches(self, words: np.ndarray, lengths: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
        """``query, text, covered, spans`` of the pairs that reach the threshold: the words that the merged spans of maximal
        matches cover, and how many spans they are. Queries are sorted words, end to end."""
        starts = np.cumsum(lengths) - lengths
        query = np.repeat(np.arange(len(lengths)), lengths)
        rare = lambda n: n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
        seeds = np.nonzero(np.arange(len(words)) - starts[query] < rare(lengths)[query])[0]
        lo, many = self.less[words[seeds]], self.less[words[seeds] + 1] - self.less[words[seeds]]
        keys = query * (len(self.less) + 1) + words  # sorted, as queries and their words are
        firsts = rare(self.lengths)
        sums = np.cumsum(many)
        cuts = np.unique(np.searchsorted(sums, np.arange(0, (sums[-1] if len(sums) else 0) + AT_ONCE, AT_ONCE)))
        done = np.zeros(0, np.int64)
        for i, j in zip(cuts, [*cuts[1:], len(seeds)]):
            n = many[i:j]
            at = np.repeat(lo[i:j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, t = np.repeat(query[seeds[i:j]], n), self.owner[at].astype(np.int64)
            a, b = lengths[q], self.lengths[t]
            fits = (self.place[at] < firsts[t]) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9)
            # a pair that several slices find is followed once
            pairs = np.setdiff1d(q[fits] * len(self.ends) + t[fits], done)
            done = np.concatenate((done[done >= (query[seeds[j - 1]] if j else 0) * len(self.ends)], pairs))
            if len(pairs):
                yield self._followed(pairs, keys, starts, lengths, threshold)

    def _followed(self, pairs: np.ndarray, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
        q, t = np.divmod(pairs, len(self.ends))
        row, going = self.ends[t], np.arange(len(q))
        covered, spans = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        before = np.full(len(q), -2, np.int64)  # where in the query the word after this one is
        while len(going):
            symbol = self.last[row[going]].astype(np.int64)
            row[going] = self.back[row[going]]
            inside = symbol > 1
            going, symbol = going[inside], symbol[inside]
            wanted = q[going] * (len(self.less) + 1) + symbol
            found = np.searchsorted(keys, wanted)
            hit = keys[np.minimum(found, len(keys) - 1)] == wanted
            where = np.where(hit, found, -2)
            covered[going] += hit
            spans[going] += hit & (where != before[going] - 1)
            before[going] = where
        good = covered >= threshold * (lengths[q] + self.lengths[t] - covered) - 1e-9
        return q[good], t[good], covered[good], spans[good]


def near_pairs(train: list, evaluation: list, threshold: float, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of collections of distinct words that share ``threshold`` of all their words. ``kinds``: a number for each of
    both, end to end; only those of one kind are pairs, as words of different kinds count as different."""
    both = [*train, *evaluation]
    lengths = np.fromiter(map(len, both), np.int64, len(both))
    none = np.zeros(0, np.int64)
    if not len(train) or not len(evaluation) or not lengths.sum():
        return none, none
    codes = pd.factorize(np.concatenate([np.asarray(w, object) for w in both]))[0].astype(np.int64)
    owner = np.repeat(np.arange(len(both)), lengths)
    if kinds is not None:
        codes = np.unique(np.unique(kinds, return_inverse=True)[1][owner] * (codes.max() + 1) + codes, return_inverse=True)[1]
    often = np.bincount(codes)
    number = np.empty(len(often), np.int64)
    number[np.argsort(often, kind="stable")] = np.arange(len(often)) + 2
    words = number[codes]
    words = words[np.lexsort((words, owner))]
    cut, n = int(lengths[: len(train)].sum()), len(train)
    index = FMIndex(words[cut:], lengths[n:], len(often) + 2)
    found = [(q, t) for q, t, *_ in index.matches(words[:cut], lengths[:n], threshold)]
    return tuple(np.concatenate([f[i] for f in found]) if found else none for i in (0, 1))


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("question").to_pylist()
        sets = {t: sorted(set(words_of(t))) for t in set(texts)}
        keep = [i for i, t in enumerate(texts) if sets[t]]
        words = [sets[texts[i]] for i in keep]
        digits = [xxhash.xxh3_64_intdigest("\n".join(w for w in ws if any(c.isdigit() for c in w))) - (1 << 63) for ws in words]
        cls = [xxhash.xxh3_128_digest("\n".join(ws)) for ws in words]
        rest = b.drop_columns(["question"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(words, pa.list_(pa.string())), pa.array(digits, pa.int64()), pa.array(cls, pa.binary())], [*rest.schema.names, "words", "digits", "cls"])


def _near(threshold: float):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        # one group may hold several sets of words with digits
        t, e = group[group["side"] == "train"], group[group["side"] == "eval"]
        i, j = near_pairs(t["words"].tolist(), e["words"].tolist(), threshold, np.concatenate((t["digits"].to_numpy(), e["digits"].to_numpy())))
        return pd.DataFrame({"a": t["cls"].to_numpy()[i], "b": e["cls"].to_numpy()[j]})

    return work


def _grid(rows: DataFrame, mine: str, other: str, groups: int) -> DataFrame:
    """Rows with the groups they go to: one of ``groups``, or a row or column of a common set's own grid."""
    own = F.pmod(F.xxhash64("cls"), F.col(mine))
    placed = rows.select("side", "cls", "words", "digits", "common", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("far"))
    x, y = ("own", "far") if mine == "shards" else ("far", "own")
    return placed.select("side", "cls", "words", "digits", F.when(F.col("common"), F.xxhash64("digits", x, y)).otherwise(F.pmod("digits", F.lit(groups))).alias("grp"))


def cross_split_links(questions: DataFrame, threshold: float = 0.7, shard: int = SHARD, block: int = BLOCK, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal word sets of training and evaluation questions, and the members.

    ``questions``: ``key, question, side`` (``train`` or ``eval``); other columns are ignored, as are other sides, but
    for the text columns ``carry``, which the members keep. Null keys and questions without a word take no part. Result:
    ``a, b`` (a class of training and one of evaluation; the same if both have it) and members ``cls, key, side``."""
    rows = questions.where("key is not null and question is not null and side in ('train', 'eval')").select(F.col("key").cast("string").alias("key"), "side", *carry, "question")
    words = rows.mapInArrow(_word_sets, ", ".join(["key string, side string", *(f"{c} string" for c in carry), "words array<string>, digits long, cls binary"]))
    members = checkpoint(words)
    classes = members.groupBy("side", "cls", "digits").agg(F.first("words").alias("words"))
    # only sets of words with a digit that both sides have; a large one gets a grid of its own
    met = classes.groupBy("digits").agg(F.count_if(F.col("side") == "train").alias("t"), F.count_if(F.col("side") == "eval").alias("e")).where("t > 0 and e > 0")
    met = checkpoint(met.withColumn("common", (F.col("t") > block) | (F.col("e") > shard)))
    parts = lambda c, n: F.when(F.col("common"), F.ceil(F.col(c) / n)).otherwise(1).cast("long")
    most = met.where("not common").agg(F.sum("t"), F.sum("e")).first()
    groups = max(1, -(-(most[0] or 0) // block), -(-(most[1] or 0) // shard))
    placed = classes.join(met.select("digits", "common", parts("e", shard).alias("shards"), parts("t", block).alias("blocks")), "digits")
    both = _grid(placed.where("side = 'train'"), "blocks", "shards", groups).unionByName(_grid(placed.where("side = 'eval'"), "shards", "blocks", groups))
    links = both.groupBy("grp").applyInPandas(_near(threshold), "a binary, b binary")
    return links.distinct(), members


def cross_split_pairs(questions: DataFrame, threshold: float = 0.7, full_pairs: int | None = None, names: tuple[str, str] = ("id_a", "id_b")) -> DataFrame:
    """Pairs of a training and an evaluation question whose words share ``threshold`` of all (repeats don't count) and
    whose words with a digit are the same. Both keys, the smaller first. All pairs, unless ``full_pairs`` is given
    (``pairs.expand_pairs``)."""
    links, members = cross_split_links(questions, threshold)
    side = lambda c, s: F.concat(F.lit(s), c)
    named = members.select(F.concat(F.substring("side", 1, 1).cast("binary"), "cls").alias("cls"), "key").distinct()
    tagged = checkpoint(links.select(side(F.col("a"), b"t").alias("a"), side(F.col("b"), b"e").alias("b")))
    return expand_pairs(tagged, named, names, full_pairs)


def cross_split_counts(questions: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Numbers of the pairs of ``cross_split_pairs``, without writing them out, and of the evaluation questions in them:
    ``eval_table, eval_split, train_table, pairs, eval_questions``.

    ``questions``: ``key, question, side, src_table, split``. A question is a key of a table. Of linked classes the numbers
    of keys are multiplied; only pairs with a key that has several texts, which several links may give, are written
    out to count once. A key is no pair with itself."""
    links, members = cross_split_links(questions, threshold, carry=("src_table", "split"))
    links = checkpoint(links)
    named = members.select("side", "cls", "key", "src_table", "split").distinct()
    texts = members.groupBy("side", "key", "src_table").agg((F.min("cls") != F.max("cls")).alias("several"))
    named = checkpoint(named.join(texts.withColumnsRenamed({"src_table": "t"}), ["side", "key"]).where(F.col("src_table").eqNullSafe(F.col("t"))).drop("t"))
    train = named.where("side = 'train'").select(F.col("cls").alias("a"), F.col("key").alias("train_key"), F.col("src_table").alias("train_table"), F.col("several").alias("train_several")).distinct()
    evaluation = named.where("side = 'eval'").select(F.col("cls").alias("b"), F.col("key").alias("eval_key"), F.col("src_table").alias("eval_table"), F.col("split").alias("eval_split"), F.col("several").alias("eval_several"))
    question = ["eval_key", "eval_table", "eval_split", "train_table"]
    # keys with one text: to each evaluation question the number of training keys its class is linked with, without itself
    reach = train.where("not train_several").groupBy("a", "train_table").agg(F.count(F.lit(1)).alias("n")).join(links, "a").groupBy("b", "train_table").agg(F.sum("n").alias("n"))
    own = train.where("not train_several").join(links, "a").select("b", F.col("train_key").alias("eval_key"), "train_table", F.lit(1).alias("own"))
    single = evaluation.where("not eval_several").join(reach, "b").join(own, ["b", "eval_key", "train_table"], "left")
    single = single.select(*question, (F.col("n") - F.coalesce("own", F.lit(0))).alias("n"))
    odd = links.join(train.where("train_several"), "a").join(evaluation, "b").unionByName(links.join(train.where("not train_several"), "a").join(evaluation.where("eval_several"), "b"))
    odd = odd.where("train_key != eval_key").select(*question, "train_key").distinct().groupBy(*question).agg(F.count(F.lit(1)).alias("n"))
    counted = single.unionByName(odd).groupBy(*question).agg(F.sum("n").alias("n")).where("n > 0")
    return counted.groupBy("eval_table", "eval_split", "train_table").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("eval_questions"))


def split_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
