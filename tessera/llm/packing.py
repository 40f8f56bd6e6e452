"""Problem 7: filling fixed-capacity containers, planned on a histogram of lengths.

Best fit, longest first, is worked out for numbers of items of a length instead of items. The plan has at most
``capacity`` lengths, and its rows say: the items of this length with ranks from..to go into containers from
this one on, so many to each. Items then take their slots by their rank within their length.
"""

from __future__ import annotations

import base64
import heapq
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import checkpoint

CAPACITY = 2048
#: Folder and file of the tokenizer's vocabulary (base64 token and rank on each line), and its word pattern.
VOCABULARY = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    """The byte-pair encoder of a vocabulary file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Best fit decreasing over ``{length: count}``, lengths from 1 to ``capacity``.

    Rows ``(length, first rank, first container, items a container)``, sorted; a row holds up to the next row of
    its length. Containers are numbered from 0. Containers with the same room are kept as runs of consecutive
    numbers, of which each length splits one at most, so work and plan depend on the lengths, not the items."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left: heap of (first container, how many)
    open_rooms: list[int] = []
    plan: list[tuple[int, int, int, int]] = []
    containers = 0

    def add(left: int, first: int, many: int) -> None:
        if left > 0 and many > 0:
            if not room.get(left):
                room[left] = []
                insort(open_rooms, left)
            heapq.heappush(room[left], (first, many))

    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        count, rank = histogram[length], 0
        while rank < count:
            k = bisect_left(open_rooms, length)
            if k < len(open_rooms):
                left = open_rooms[k]
                first, many = heapq.heappop(room[left])
                if not room[left]:
                    del open_rooms[k]
                    del room[left]
            else:
                left, first, many = capacity, containers, -(-(count - rank) // (capacity // length))
                containers += many
            each = left // length
            plan.append((length, rank, first, each))
            full, rest = divmod(min(count - rank, many * each), each)
            add(left - each * length, first, full)
            if rest:
                add(left - rest * length, first + full, 1)
            used = full + (rest > 0)
            add(left, first + used, many - used)
            rank += full * each + rest
    return sorted(plan)


_PIECES = "doc_id long, piece_no int, start_token int, n_tokens int, part int, rank_in_part long"


def _measured(path: str, capacity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(os.path.basename(path))).encode_ordinary
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            doc, piece, start, size = [], [], [], []
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                n = len(encode(text)) if text else 0
                for no, at in enumerate(range(0, max(n, 1), capacity), 1):
                    doc.append(key)
                    piece.append(no)
                    start.append(at)
                    size.append(min(capacity, n - at))
            sizes = np.array(size, np.int64)
            order = np.argsort(sizes, kind="stable")
            ordered = sizes[order]
            firsts = np.searchsorted(ordered, ordered)
            rank = np.empty(len(sizes), np.int64)
            rank[order] = np.arange(len(sizes)) - firsts
            rank += seen[sizes]
            seen += np.bincount(sizes, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int32()), pa.array(sizes.astype(np.int32)), pa.array(np.full(len(sizes), part, np.int32)), pa.array(rank)], [c.split()[0] for c in _PIECES.split(", ")]
            )

    return work


def _slots(plan: list[tuple[int, int, int, int]]):
    lengths, ranks, firsts, each = (np.array(x, np.int64) for x in (zip(*plan) if plan else [[]] * 4))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("n_tokens").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            slot = np.full(len(n), -1, np.int64)
            some = n > 0
            if some.any():
                # rows of the plan are sorted by (length, rank): one search by both
                low, high = np.searchsorted(lengths, n[some], "left"), np.searchsorted(lengths, n[some], "right")
                lo, hi, r = low.copy(), high.copy(), rank[some]
                while (open_ := hi - lo > 1).any():
                    mid = (lo + hi) // 2
                    right = open_ & (ranks[np.minimum(mid, len(ranks) - 1)] <= r)
                    lo, hi = np.where(right, mid, lo), np.where(open_ & ~right, mid, hi)
                slot[some] = firsts[lo] + (r - ranks[lo]) // each[lo]
            out = pa.array(slot, mask=slot < 0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece_no", "start_token", "n_tokens")), out], ["doc_id", "piece_no", "start_token", "n_tokens", "container_id"])

    return work


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Containers of documents: ``doc_id, piece_no, start_token, n_tokens, container_id``.

    ``documents``: ``doc_id, text``. Each row is one item; repeated rows are items of their own. Only a document
    of more than ``capacity`` tokens is cut: into full containers and a rest. A null or empty text has no tokens,
    one row with ``n_tokens`` 0 and no container. Containers are numbered from 0 without gaps. The vocabulary file is
    sent from the driver to the workers.

    To the driver goes the histogram only, at most ``capacity`` rows, and back the plan. Ranks within a length are
    counted within each partition and shifted by the numbers of the partitions before, so no length, however
    common, is gathered in one task."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    pieces = checkpoint(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measured(vocabulary, capacity), _PIECES))
    by_part = pieces.groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["n_tokens"]: r["n"] for r in by_part.where("n_tokens > 0").groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    plan = plan_containers(histogram, capacity)
    before = W.partitionBy("n_tokens").orderBy("part")
    shifts = by_part.select("n_tokens", "part", (F.sum("n").over(before) - F.col("n")).alias("shift"))
    ranked = pieces.join(shifts, ["n_tokens", "part"]).select("doc_id", "piece_no", "start_token", "n_tokens", (F.col("rank_in_part") + F.col("shift")).alias("rank"))
    return ranked.mapInArrow(_slots(plan), "doc_id long, piece_no int, start_token int, n_tokens int, container_id long")


def container_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, full ones and the share of room left over."""
    used = packed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.count_if(F.col("used") == capacity).alias("full"), (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("left_over")
    )
