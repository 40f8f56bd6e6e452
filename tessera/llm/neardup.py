"""Problem 2: near-duplicate records with small edits.

Two texts belong together if their sets of runs of three words share at least ``threshold`` of all runs. A text's
fingerprint is a number of minimum hashes of its runs, a few bits of each: two texts of similarity s have the same
bits in a share s of them, and by chance in some others. Fingerprints are compared in tiles by exclusive-or and bit
counts; tiles are sorted by the texts' population counts (their numbers of runs), and a pair of tiles whose counts
differ by more than the radius (a + b)(1 - t)/(1 + t), the most that two texts of a and b runs that reach the threshold
t can differ by, is skipped.

All tiles against all would grow with the square of the collection, so tiles are compared within blocks: a text is
in one block for each of ``bands`` groups of ``rows`` minimum hashes. A short fingerprint travels with the entries of
the blocks; pairs that pass it are compared by the long one, and what is left is verified exactly on whole sets.
``expected_recall`` gives the probability that a pair of some similarity passes: 0.9986 at 0.63, 0.99995 at 0.7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.pairs import expand_pairs
from tessera.llm.text import WordHasher, run_sets, words_of
from tessera.operators.references import bloom_maybe
from tessera.session import checkpoint, shuffle_partitions

K = 3
#: Short fingerprint: so many hashes of three bits, in two numbers, and how many must agree.
SHORT, SHORT_AGREE = 42, 18
#: Long fingerprint: the hashes of the bands, four bits each, and what share of them must agree.
LONG_AGREE = 32 / 72
#: Texts of a block that are paired one by one; larger blocks are compared as tiles.
SMALL = 32
#: A block beyond so many texts is cut into tiles that meet pairwise in different tasks.
TILE_ROWS = 4096
#: Rows of a tile that is compared in memory.
TILE = 256
_SCHEMA = "rid long, key string, cls binary, n int, short long, short2 long, long binary, bands array<int>"


def _multipliers(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63 - 1, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signatures(bands: int, rows: int):
    """Reads ``key, text``; gives class, number of runs, fingerprints and band keys of each text with a word."""
    factors = _multipliers(bands * rows + SHORT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rid = WordHasher(), TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                texts = [words_of(t) for t in b.column("text").to_pylist()]
                keep = [i for i, ws in enumerate(texts) if ws]
                if not keep:
                    continue
                hashes, lengths = hasher([texts[i] for i in keep])
                cls = _classes(hashes, lengths)
                runs, counts = run_sets(hashes, lengths, K)
                starts = np.cumsum(counts) - counts
                low = np.empty((bands * rows, len(keep)), np.uint8)
                keys = np.empty((len(keep), bands), np.uint32)
                for j in range(bands):
                    k = np.zeros(len(keep), np.uint64)
                    for c in range(j * rows, (j + 1) * rows):
                        least = np.minimum.reduceat(runs * factors[c], starts)
                        low[c] = least >> np.uint64(20)
                        k = (k ^ least) * np.uint64(0x9E3779B97F4A7C15)
                        k ^= k >> np.uint64(32)
                    keys[:, j] = k >> np.uint64(32)
                long = np.ascontiguousarray(((low[0::2] & 15) << 4 | (low[1::2] & 15)).T)
                short = np.zeros((2, len(keep)), np.uint64)
                for c, f in enumerate(factors[bands * rows :]):
                    short[c % 2] = short[c % 2] << np.uint64(3) | (np.minimum.reduceat(runs * f, starts) >> np.uint64(20)) & np.uint64(7)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(rid, rid + len(keep))), b.column("key").take(pa.array(keep, pa.int64())), pa.array(cls, pa.binary()), pa.array(counts.astype(np.int32)),
                        pa.array(short[0].view(np.int64)), pa.array(short[1].view(np.int64)), pa.array([r.tobytes() for r in long], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int32))),
                    ],
                    [c.split()[0] for c in _SCHEMA.split(", ")],
                )
                rid += len(keep)

    return work


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of their hashes short fingerprints, pairs of numbers along the last axis, differ."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1) | x >> np.uint64(2)) & np.uint64(0o111111111111111111111)).sum(axis=-1)


def _short(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("short", "short2")], axis=-1)


def tile_pairs(short: np.ndarray, n: np.ndarray, threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of rows within the radius whose short fingerprints agree; rows must be sorted by ``n``.
    ``side``: with it, only rows of different sides are paired."""
    share = (1 - threshold) / (1 + threshold)
    found = []
    for i0 in range(0, len(n), TILE):
        i1 = min(len(n), i0 + TILE)
        for j0 in range(i0, len(n), TILE):
            j1 = min(len(n), j0 + TILE)
            if n[j0] - n[i1 - 1] > (n[j0] + n[i1 - 1]) * share:  # sorted: the nearest counts of the two tiles
                break
            near = unlike(short[i0:i1, None], short[None, j0:j1]) <= SHORT - SHORT_AGREE
            near &= n[None, j0:j1] - n[i0:i1, None] <= (n[i0:i1, None] + n[None, j0:j1]) * share
            if i0 == j0:
                near = np.triu(near, 1)
            if side is not None:
                near &= side[i0:i1, None] != side[None, j0:j1]
            found.append(np.argwhere(near) + (i0, j0))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole blocks of rows sorted by ``block``, and where their blocks begin, with the end."""

    def cut(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held)
        block = t.column("block").to_numpy()
        return t, np.concatenate(([0], np.nonzero(block[1:] != block[:-1])[0] + 1, [len(block)]))

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column("block").to_numpy()
        if held and held[-1].column("block")[-1].as_py() != block[0]:
            yield cut(held)
            held = []
        changes = np.nonzero(block[1:] != block[:-1])[0]
        if len(changes):
            at = int(changes[-1]) + 1
            yield cut([*held, b.slice(0, at)])
            held = [b.slice(at)]
        else:
            held.append(b)
    if held:
        yield cut(held)


def _meet(threshold: float):
    """Reads ``block, rid, n, short, short2`` sorted by block and n; gives pairs of rids (``size`` 0). Rows of a block of more
    than ``TILE_ROWS`` come out as they are, with the block in ``x`` and its size."""
    share = (1 - threshold) / (1 + threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _whole_blocks(batches):
            block, rid, n = t.column("block").to_numpy(), t.column("rid").to_numpy(), t.column("n").to_numpy().astype(np.int64)
            short = _short(t)
            sizes = np.diff(first)
            size = np.repeat(sizes, sizes)
            pairs = []
            # the many small blocks at once: each row and the one d further on, while they are of one block
            for d in range(1, SMALL):
                i = np.nonzero((block[:-d] == block[d:]) & (size[:-d] <= SMALL))[0] if len(block) > d else np.zeros(0, np.int64)
                if not len(i):
                    break
                j = i + d
                i = i[(n[j] - n[i] <= (n[i] + n[j]) * share) & (unlike(short[i], short[j]) <= SHORT - SHORT_AGREE)]
                pairs.append(np.stack((rid[i], rid[i + d]), axis=1))
            for k in np.nonzero((sizes > SMALL) & (sizes <= TILE_ROWS))[0]:
                s = slice(first[k], first[k + 1])
                i, j = tile_pairs(short[s], n[s], threshold)
                pairs.append(np.stack((rid[s][i], rid[s][j]), axis=1))
            x = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0) if pairs else np.zeros((0, 2), np.int64)
            big = size > TILE_ROWS
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((x[:, 0], block[big]))), pa.array(np.concatenate((x[:, 1], rid[big]))), pa.array(np.concatenate((np.zeros(len(x), np.int64), size[big])))], ["x", "y", "size"]
            )

    return work


def _compare(threshold: float):
    """Reads rows of parts of large blocks sorted by part and n; gives pairs, tile by tile."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _whole_blocks(batches):
            rid, n, tile = (t.column(c).to_numpy().astype(np.int64) for c in ("rid", "n", "tile"))
            across, short = t.column("across").to_pylist(), _short(t)
            for lo, hi in zip(first[:-1], first[1:]):
                i, j = tile_pairs(short[lo:hi], n[lo:hi], threshold, tile[lo:hi] if across[lo] else None)
                a, b = rid[lo:hi][i], rid[lo:hi][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["x", "y"])

    return work


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose long fingerprints agree."""
    for b in batches:
        if b.num_rows:
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("long_x", "long_y"))
            x = one ^ two
            x |= x >> 1 & 0x77
            x |= x >> 2 & 0x33
            differ = np.bitwise_count(x & 0x11).sum(axis=1)
            yield b.select(["x", "y"]).filter(pa.array(differ <= one.shape[1] * 2 * (1 - LONG_AGREE)))


def _classes(hashes: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The class of each text, by the hashes of all its words."""
    ends = np.cumsum(lengths)
    return [xxhash.xxh3_128_digest(hashes[e - n : e].tobytes()) for e, n in zip(ends, lengths)]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32-bit hashes of the runs, where the text is of the class: two texts of a thousand runs have a false one in common
    once in 4,000 pairs."""
    hasher = WordHasher()
    for b in batches:
        hashes, lengths = hasher([words_of(t) for t in b.column("text").to_pylist()])
        runs, counts = run_sets(hashes, lengths, K)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        short = (runs >> np.uint64(21)).astype(np.uint32).view(np.int32)
        mine = [c == x for c, x in zip(_classes(hashes, lengths), b.column("cls").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("rid"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(short))], ["rid", "runs"]).filter(pa.array(mine, pa.bool_()))


#: Texts up to which blocks share three minimum hashes; from there on, one more for each tenfold.
THREE_ROWS = 2_000_000
#: Probability that a pair of similarity 0.63 meets in a block.
MET = 0.9986


def banding(texts: int) -> tuple[int, int]:
    """Bands and minimum hashes a band for a collection of so many texts.

    Unlike texts meet by chance in a number that grows with the collection and falls with every further hash of a band; so
    a collection ten times as large gets one more, and as many bands as keep the probability that like ones meet."""
    rows = 3
    while texts > THREE_ROWS * 10 ** (rows - 3):
        rows += 1
    bands = math.ceil(math.log(1 - MET) / math.log(1 - 0.63**rows) - 1e-9)
    return bands + bands % 2, rows


def near_duplicate_links(rows: DataFrame, threshold: float = 0.6, bands: int | None = None, band_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal word sequences, and the classes' members.

    ``rows``: ``key, text``. Result: ``a, b`` (distinct pairs of different classes that reach the threshold) and
    ``cls, key`` (distinct). Null keys and texts without a word take no part. Copies share a class, and only one
    row of a class goes into blocks, so masses of copies make no block large. Bands follow from the number of rows
    (``banding``) unless given."""
    if bands is None or band_rows is None:
        bands, band_rows = banding(rows.count())
    parts = shuffle_partitions(rows.sparkSession)
    named = rows.where(F.col("key").isNotNull() & (F.length("text") > 0)).select("key", "text")
    signed = checkpoint(named.mapInArrow(_signatures(bands, band_rows), _SCHEMA))
    copied = signed.groupBy("cls").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    spare = signed.select("cls", "rid").join(copied, "cls").where("rid != rep").select("rid")
    lone = signed.select("rid", "n", "short", "short2", "bands").join(spare, "rid", "left_anti")
    entries = lone.select("rid", "n", "short", "short2", F.posexplode("bands").alias("band", "code"))
    entries = entries.select("rid", "n", "short", "short2", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("code")).alias("block"))
    met = checkpoint(entries.repartition(parts, "block").sortWithinPartitions("block", "n").mapInArrow(_meet(threshold), "x long, y long, size long").distinct())

    # a very large block is cut into parts: a pair of parts pairs across only, a part with itself pairs within
    tiles = F.ceil(F.col("size") / F.lit(TILE_ROWS)).cast("int")
    big = met.where("size > 0").select(F.col("x").alias("block"), F.col("y").alias("rid"), tiles.alias("tiles")).withColumn("tile", F.pmod(F.hash("rid"), F.col("tiles")))
    placed = big.select("block", "rid", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    placed = placed.select(F.xxhash64("block", F.least("tile", "other"), F.greatest("tile", "other")).alias("block"), "rid", "tile", (F.col("tile") != F.col("other")).alias("across"))
    tiled = placed.join(signed.select("rid", "n", "short", "short2"), "rid").select("block", "rid", "tile", "across", "n", "short", "short2").repartition(parts, "block").sortWithinPartitions("block", "n")
    pairs = met.where("size = 0").select("x", "y").unionByName(tiled.mapInArrow(_compare(threshold), "x long, y long").distinct())

    long = signed.select("rid", "long")
    pairs = pairs.join(long.select(F.col("rid").alias("x"), F.col("long").alias("long_x")), "x").join(long.select(F.col("rid").alias("y"), F.col("long").alias("long_y")), "y")
    links = checkpoint(pairs.select("x", "y", "long_x", "long_y").mapInArrow(_near, "x long, y long").distinct())

    ends = links.select(F.col("x").alias("rid")).union(links.select(F.col("y").alias("rid"))).distinct()
    needed = checkpoint(ends.join(signed.select("rid", "key", "cls"), "rid"))
    # a filter of bounded size keeps most other texts out of the shuffle; the join is exact
    texts = bloom_maybe(named, "key", needed, "key", needed.count()).join(needed.select("rid", "key", "cls"), "key").select("rid", "cls", "text")
    # texts of the key that are of another class go; the others give the same set, of which the aggregate keeps one
    sets = texts.mapInArrow(_sets, "rid long, runs array<int>").groupBy("rid").agg(F.first("runs").alias("runs"))
    paired = links.join(sets.select(F.col("rid").alias("x"), F.col("runs").alias("s")), "x").join(sets.select(F.col("rid").alias("y"), F.col("runs").alias("t")), "y")
    both = F.size(F.array_intersect("s", "t"))
    true = paired.select("x", "y", both.alias("both"), (F.size("s") + F.size("t")).alias("sizes")).where(F.col("both") >= threshold * (F.col("sizes") - F.col("both")) - 1e-9).select("x", "y")
    names = needed.select("rid", "cls")
    named_links = true.join(names.select(F.col("rid").alias("x"), F.col("cls").alias("a")), "x").join(names.select(F.col("rid").alias("y"), F.col("cls").alias("b")), "y").select("a", "b")
    return named_links, signed.select("cls", "key")


def near_duplicate_pairs(rows: DataFrame, names: tuple[str, str] = ("key_a", "key_b"), threshold: float = 0.6, full_pairs: int | None = None) -> DataFrame:
    """Pairs of different keys whose texts share at least ``threshold`` of their runs of three words.

    Copies under different keys are pairs as well, all of them unless ``full_pairs`` is given
    (``pairs.expand_pairs``). A text of one or two words pairs only with texts of the same words. A key with
    several texts takes part with each."""
    links, members = near_duplicate_links(rows, threshold)
    copies = members.groupBy("cls").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low != high").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    linked = checkpoint(links.unionByName(copies))
    ends = linked.select(F.col("a").alias("cls")).union(linked.select(F.col("b").alias("cls"))).distinct()
    return expand_pairs(linked, members.join(ends, "cls", "left_semi").distinct(), names, full_pairs)


def near_duplicate_classes(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row for each key and text with its class: ``key, class_id, copies, links``.

    ``class_id`` is the smallest key of the texts with the same words, ``copies`` the number of keys of the class, ``links`` the
    number of other classes that reach the threshold with it. Its size doesn't depend on how large the classes are."""
    links, members = near_duplicate_links(rows, threshold)
    members = checkpoint(members.distinct())
    both = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    named = members.groupBy("cls").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("copies")).join(both, "cls", "left")
    return members.join(named, "cls").select("key", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def expected_recall(similarity: float, bands: int = 24, band_rows: int = 3) -> float:
    """Probability that a pair of this similarity meets in a block and passes both fingerprints."""

    def agree(n: int, least: int, p: float) -> float:
        return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))

    met = 1 - (1 - similarity**band_rows) ** bands
    n = bands * band_rows
    return met * agree(SHORT, SHORT_AGREE, similarity + (1 - similarity) / 8) * agree(n, math.ceil(n * LONG_AGREE), similarity + (1 - similarity) / 16)
