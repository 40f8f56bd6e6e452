"""Problem 8: evaluation texts leaking into training text, by greedy string tiling.

Items and documents are sequences of words. Short runs of words that both have are the seeds that join documents to
items; a pair with a seed is tiled: the longest matches are marked first, found by Karp-Rabin codes of short runs, rolled on word by word along diagonals (the
code's base is 2**16 and its words are numbered below that, so equal codes are equal runs), until none of at least ``MIN_TILE`` words is left unmarked. Tiles that follow each other in both
texts with small gaps make a stretch; a stretch of more than half of the item is a leak.

Seeds in many items (set phrases) would join nearly everything. Of each item only its rarest seeds are used: as few
as still leave one intact in every stretch of half the item that has the allowed number of edits. This is worked
out for each item when the index is built, so the gate loses no leak.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import consistent_form, split_words
from tessera.session import checkpoint

#: Words of a seed; the length is chosen for each item.
SEEDS = (2, 3, 4)
MIN_TILE = 3
#: Words between two tiles of one stretch, in either text: a few edits in a row, or a line put between.
GAP = 12
#: Words of the items of one block, unless one item alone has more.
BLOCK_WORDS = 60_000
#: Run codes have 16 bits a word, so a block knows so many words; only an item with more different ones, of which some then
#: share a number, needs them all.
MOST_NUMBERS = 65_534
#: Words of items that are sent to every worker at once, as blocks, about 100 MB. More take further passes over the documents.
MOST_WORDS = 3_000_000
#: Documents looked at first to tell set phrases from rare ones. They only decide by which of an item's runs it is
#: looked for; any choice finds the same leaks.
SAMPLE = 1000
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐­][ \t]*[\r\n]+\s*(?=[^\W\d_])")
_TAG = re.compile(r"<!--(?s:.*?)-->|</?[A-Za-z][^<>]*>")


def plain_words(text: str | None) -> list[str]:
    """Words of a text without markup, with words joined that a line break cuts at a hyphen."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text or "-\r" in text or "‐" in text or "­" in text or "- " in text:
        text = _HYPHEN.sub("", text)
    return split_words(consistent_form(text).lower())


def codes(ids: np.ndarray, k: int) -> np.ndarray:
    """Codes of all runs of ``k`` word ids; 0 where a word is unknown (id 0)."""
    if len(ids) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - k + 1, np.uint64)
    known = np.ones(len(out), bool)
    for i in range(k):
        part = ids[i : len(out) + i]
        out = (out << np.uint64(16)) | part
        known &= part > 0
    out[~known] = 0
    return out


def edits_allowed(words: int) -> int:
    """Edits a stretch may have for the seeds to find it for certain: one word in seven and one more, as *about one in
    ten* may by chance be more; one word in ten, rounded up, in stretches of less than 20 words."""
    return words // 7 + 1 if words >= 20 else -(-words // 10)


def edits_allowed_each(words: np.ndarray) -> np.ndarray:
    return np.where(words >= 20, words // 7 + 1, -(-words // 10))


@dataclass
class Block:
    """The index of some items."""

    vocabulary: dict[str, int]
    items: list[tuple[int, np.ndarray]]
    #: by run length: sorted codes, where their places begin and end, and those places: items and positions in them
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: by run length: all codes of all items, sorted; the places of the items' codes among them, end to end, and
    #: where an item's begin and its number of words
    runs: dict[int, np.ndarray]
    #: for each of those its number among the seeds, or -1
    seed_of: dict[int, np.ndarray]
    places: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    #: by item: so many runs of some stretch of half of it a document must have
    half: np.ndarray
    least: np.ndarray


def build_block(items: list[tuple[int, list[str]]], common: Counter | None = None) -> Block:
    """The index of items; ``common``: how often runs ``(k, words)`` are met in documents, to choose seeds by."""
    vocabulary: dict[str, int] = {}
    number = lambda w: len(vocabulary) + 1 if len(vocabulary) < MOST_NUMBERS else 1 + xxhash.xxh3_64_intdigest(w) % MOST_NUMBERS
    rows = [(key, np.array([vocabulary.setdefault(w, number(w)) for w in ws], np.uint64)) for key, ws in items]
    # codes of four words fill 64 bits; there are no longer seeds
    choices = [{min(k, len(ids) // 2 + 1) for k in SEEDS} for _, ids in rows]
    often: dict[tuple[int, int], int] = {}
    for (_, ids), ks in zip(rows, choices):
        for k in ks:
            for v in set(codes(ids, k).tolist()):
                often[k, v] = often.get((k, v), 0) + 1
    for run, n in (common or {}).items():
        if all(w in vocabulary for w in run):
            code = int(codes(np.array([vocabulary[w] for w in run], np.uint64), len(run))[0])
            if (len(run), code) in often:
                often[len(run), code] += 100 * n
    seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
    half = np.array([len(ids) // 2 + 1 for _, ids in rows], np.int64)
    least = np.ones(len(rows), np.int64)
    lengths, coded = [], []
    for no, ((_, ids), ks) in enumerate(zip(rows, choices)):
        edits = edits_allowed(int(half[no]))
        best = None
        for k in sorted(ks):
            c = codes(ids, k)
            met = np.array([often[k, v] for v in c.tolist()])
            wanted = min(edits + 1, max(1, (int(half[no]) - k) // k + 1))
            use = met <= _cutoff(met, int(half[no]) - k + 1, k, wanted)
            if best is None or met[use].sum() < best[0]:
                best = met[use].sum(), k, c, use
        _, k, c, use = best
        lengths.append(k)
        coded.append(c)
        least[no] = max(1, half[no] - k + 1 - k * edits)
        for at in np.nonzero(use)[0].tolist():
            seeds.setdefault(k, {}).setdefault(int(c[at]), []).append((no, at))
    runs = {k: np.unique(np.concatenate([c for c, n in zip(coded, lengths) if n == k])) for k in set(lengths)}
    places = [np.searchsorted(runs[k], c) for c, k in zip(coded, lengths)]
    starts = np.cumsum([0, *map(len, places)])[:-1]
    sizes = np.array([len(ids) for _, ids in rows], np.int64)
    tables = {}
    for k, by_code in seeds.items():
        order = sorted(by_code)
        ends = np.cumsum([len(by_code[v]) for v in order])
        flat = np.array([x for v in order for x in by_code[v]], np.int64)
        tables[k] = (np.array(order, np.uint64), np.concatenate(([0], ends)), flat[:, 0], flat[:, 1])
    seed_of = {k: np.full(len(r), -1, np.int64) for k, r in runs.items()}
    for k, (order, *_) in tables.items():
        seed_of[k][np.searchsorted(runs[k], order)] = np.arange(len(order))
    return Block(vocabulary, rows, tables, runs, seed_of, np.concatenate(places), starts, sizes, half, least)


def _cutoff(met: np.ndarray, inside: int, k: int, wanted: int) -> int:
    """The smallest number of times met that seeds may have for ``_enough`` of them to be left."""
    values = np.unique(met)
    lo, hi = 0, len(values) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if _enough(met <= values[mid], inside, k, wanted) else (mid + 1, hi)
    return int(values[lo])


def _enough(use: np.ndarray, inside: int, k: int, wanted: int) -> bool:
    """Whether every stretch of ``inside`` runs holds ``wanted`` of ``use`` that share no word. One edit breaks one
    of those at most."""
    for lo in range(max(1, len(use) - inside + 1)):
        found, at = 0, lo
        while at < min(len(use), lo + inside) and found < wanted:
            if use[at]:
                found, at = found + 1, at + k
            else:
                at += 1
        if found < wanted:
            return False
    return True


def tiles_of(item: np.ndarray, doc: np.ndarray, most_short: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(item position, document position, length)`` of non-overlapping matches, each the
    longest of what was unmarked when it was taken; ties by item position, then document position."""
    ci, cd = codes(item, most_short), codes(doc, most_short)
    if not len(ci) or not len(cd):
        return []
    order = np.argsort(ci, kind="stable")
    ordered = ci[order]
    lo, hi = np.searchsorted(ordered, cd, "left"), np.searchsorted(ordered, cd, "right")
    hi[cd == 0] = lo[cd == 0]
    many = hi - lo
    at = np.nonzero(many)[0]
    many = many[at]
    if not len(at):
        return []
    j = np.repeat(at, many)
    i = order[np.repeat(lo[at], many) + np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many)]
    # runs along a diagonal are one match
    o = np.lexsort((j, j - i))
    i, j = i[o], j[o]
    new = np.concatenate(([True], (j[1:] != j[:-1] + 1) | (i[1:] != i[:-1] + 1)))
    start = np.nonzero(new)[0]
    length = np.diff(np.concatenate((start, [len(i)]))) + most_short - 1
    matches = sorted(zip((-length).tolist(), i[start].tolist(), j[start].tolist()))
    marked_i, marked_j = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles = []
    heapq.heapify(matches)
    while matches:
        n, a, b = heapq.heappop(matches)
        n = -n
        taken = marked_i[a : a + n] | marked_j[b : b + n]
        if not taken.any():
            marked_i[a : a + n] = True
            marked_j[b : b + n] = True
            tiles.append((a, b, n))
            continue
        # what is left of it, in pieces
        free = np.concatenate(([0], (~taken).astype(np.int8), [0]))
        edge = np.diff(free)
        for s, e in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()):
            if e - s >= most_short:
                heapq.heappush(matches, (-(e - s), a + s, b + s))
    return sorted(tiles)


def _extended(item: np.ndarray, doc: np.ndarray, i: int, j: int, step: int) -> tuple[int, int]:
    """How many words a stretch goes on beyond ``i, j`` in a direction, over single edits with two right words after
    each, and how many of them are equal."""
    reached = equal = 0
    n, m = len(item), len(doc)

    def same(a: int, b: int) -> bool:
        return 0 <= a < n and 0 <= b < m and item[a] == doc[b]

    while True:
        if same(i, j):
            di, dj, gain = 1, 1, 1
        else:
            for di, dj in ((1, 1), (0, 1), (1, 0)):
                if same(i + di * step, j + dj * step) and same(i + (di + 1) * step, j + (dj + 1) * step):
                    gain = 0
                    break
            else:
                return reached, equal
        i, j, reached, equal = i + di * step, j + dj * step, reached + di, equal + gain


def is_leak(item_words: int, reached: int, equal: int, doc_words: int, least: float = 0.5, purity: float = 0.75) -> bool:
    """Whether a stretch is more than ``least`` of the item and mostly equal."""
    return reached > least * item_words and equal >= purity * max(reached, doc_words)


def better_stretch(item_words: int):
    """The key to compare stretches by: leaks before others, then the longer."""
    return lambda x: (is_leak(item_words, *x), x)


def best_stretch(item: np.ndarray, doc: np.ndarray, gap: int = GAP) -> tuple[int, int, int]:
    """Of the item's stretches in the document the longest leak, else the longest: its words of the item, of these the
    equal ones, and its words of the document. Every chain of tiles, from each first to each last, is a stretch."""
    tiles = tiles_of(item, doc)
    better = better_stretch(len(item))
    found = (0, 0, 0)
    # the tiles that may come before each; they share no words of the item, so their ends are sorted as they are
    before: list[list[int]] = []
    for t, (i, j, _) in enumerate(tiles):
        mine = []
        for u in range(t - 1, -1, -1):
            a, b, m = tiles[u]
            if i - a - m > gap:
                break
            if i >= a + m and 0 <= j - b - m <= gap:
                mine.append(u)
        before.append(mine)
    right = [_extended(item, doc, i + n, j + n, 1) for i, j, n in tiles]
    for first, (i0, j0, n0) in enumerate(tiles):
        left, el = _extended(item, doc, i0 - 1, j0 - 1, -1)
        most = {first: n0}  # equal words of the best chain from the first tile to each
        for t in range(first, len(tiles)):
            i, j, n = tiles[t]
            if t > first:
                reached = [most[u] for u in before[t] if u in most]
                if not reached:
                    continue
                most[t] = max(reached) + n
            more, er = right[t]
            found = max(found, (i + n - i0 + left + more, most[t] + el + er, j + n - j0 + left + more), key=better)
    return found


def _common(texts: list[str]) -> Counter:
    """In how many of some documents each run of seed length is, where in several."""
    met = Counter(x for t in texts for ws in [plain_words(t)] for x in {tuple(ws[i : i + k]) for k in SEEDS for i in range(len(ws) - k + 1)})
    return Counter({x: n for x, n in met.items() if n > 1})


def _scan(blocks: list):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                keys = b.column("doc_id").to_pylist()
                texts = [plain_words(t) for t in b.column("text").to_pylist()]
                out = []
                for shared in blocks:
                    out += _hits(shared.value, keys, texts)
                if out:
                    cols = list(zip(*out))
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "item_words", "stretch", "equal"])

    return work


def _about_there(block: Block, units: np.ndarray, k: int, stride: int, codes_known: int, has: np.ndarray) -> np.ndarray:
    """Whether enough of every ``stride``-th run of the item are about where the unit puts them."""
    if not len(units):
        return np.zeros(0, bool)
    d, i = np.divmod(units >> 32, len(block.items))
    base = ((units & ((1 << 32) - 1)) - (1 << 28)) << 4
    size = (block.sizes[i] - k) // stride + 1
    start = np.cumsum(size) - size
    inner = (np.arange(size.sum()) - np.repeat(start, size)) * stride
    wanted = (np.repeat(d * codes_known, size) + block.places[np.repeat(block.starts[i], size) + inner]) << 32
    drift = edits_allowed_each(block.sizes[i]) + 3
    where = np.repeat(base - drift, size) + inner
    low = wanted | np.maximum(where, 0)
    near = np.searchsorted(has, low)
    near[near == len(has)] = 0
    there = has[near]
    there = (there >= low) & (there < (wanted | np.maximum(where + np.repeat(2 * drift + 16, size), 0)))
    sums = np.concatenate(([0], np.cumsum(there, dtype=np.int32)))
    half = block.half[i]
    inside = np.minimum(half // stride + 1 if stride > 1 else half - k + 1, size)
    first = np.arange(len(wanted))
    last = np.minimum(first + np.repeat(inside, size), np.repeat(start + size, size))
    best = np.maximum.reduceat(sums[last] - sums[first], start)
    least = np.maximum(1, (half - k + 1) // stride - edits_allowed_each(half)) if stride > 1 else block.least[i]
    return best >= least


def _hits(block: Block, keys: list, texts: list[list[str]]) -> list[tuple[int, int, int, int, int]]:
    known = block.vocabulary.get
    if not len(keys):
        return []
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.array([known(w, 0) for ws in texts for w in (*ws, "")], np.uint64)  # an unknown word after each text
    ends = np.cumsum(counts + 1)
    n = len(block.items)
    begins = ends - counts - 1
    owner = np.repeat(np.arange(len(keys)), counts + 1)
    units = []
    for k, (_, bounds, items, positions) in block.seeds.items():
        found = codes(ids, k)
        at = np.nonzero(found)[0]
        found = found[at]
        every = block.runs[k]
        known = np.searchsorted(every, found)
        known[known == len(every)] = 0
        hit = every[known] == found
        at, known = at[hit], known[hit]
        doc = owner[at]
        at = at - begins[doc]
        has = np.sort((doc * len(every) + known) << 32 | at)
        place = block.seed_of[k][known]
        hit = place >= 0
        place = place[hit]
        many = bounds[place + 1] - bounds[place]
        which = np.repeat(bounds[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        # a seed puts the item's first word at about this word of the document; near ones are tried as one
        base = np.repeat(at[hit], many) - positions[which]
        unit = np.unique((np.repeat(doc[hit], many) * n + items[which]) << 32 | ((base >> 4) + (1 << 28)))
        for some in np.array_split(unit, -(-len(unit) // 20_000)) if len(unit) else []:
            # first by runs that share no word, of which an edit breaks one at most; then by all
            some = some[_about_there(block, some, k, k, len(every), has)]
            units.append(some[_about_there(block, some, k, 1, len(every), has)])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for u in np.unique(np.concatenate(units)).tolist() if units else []:
        d, i = divmod(u >> 32, n)
        base = ((u & ((1 << 32) - 1)) - (1 << 28)) << 4
        item = block.items[i][1]
        drift = 2 * (edits_allowed(len(item)) + 3)
        lo, hi = max(0, base - drift), min(int(counts[d]), base + 16 + len(item) + drift)
        best[d, i] = max(best.get((d, i), (0, 0, 0)), best_stretch(item, ids[begins[d] + lo : begins[d] + hi]), key=better_stretch(len(item)))
    return [(keys[d], block.items[i][0], len(block.items[i][1]), *b[:2]) for (d, i), b in best.items() if is_leak(len(block.items[i][1]), *b)]


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with the items they contain: ``doc_id, item_id, item_words, stretch, equal``, distinct.

    ``documents``: ``doc_id, text``; ``items``: ``item_id, text``. Null keys and texts without a word take no part;
    an item given twice counts once. The documents are never shuffled; the items are a stated set of any size, sent in
    blocks of ``BLOCK_WORDS`` words, ``MOST_WORDS`` words at a time. Beyond that the documents are read once more for each
    further part, and a part's leaks are written before the next is sent."""
    spark = documents.sparkSession
    named = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = _common([r["text"] for r in named.select("text").limit(SAMPLE).toLocalIterator()])
    schema = "doc_id long, item_id long, item_words int, stretch int, equal int"
    rows, words, sent, blocks = [], 0, 0, []
    parts: list[DataFrame] = []

    def close() -> None:
        nonlocal rows, words
        if rows:
            blocks.append(spark.sparkContext.broadcast(build_block(rows, common)))
            rows, words = [], 0

    for r in items.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id").toLocalIterator():
        ws = plain_words(r["text"])
        if not ws:
            continue
        if rows and words + len(ws) > BLOCK_WORDS:
            close()
        if blocks and not rows and sent + len(ws) > MOST_WORDS:
            parts.append(checkpoint(named.mapInArrow(_scan(list(blocks)), schema).distinct()))
            for b in blocks:
                b.destroy()
            blocks.clear()
            sent = 0
        rows.append((r["item_id"], ws))
        words, sent = words + len(ws), sent + len(ws)
    close()
    if blocks:
        parts.append(named.mapInArrow(_scan(blocks), schema).distinct())
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
