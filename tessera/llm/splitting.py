"""Problem 4: splitting oversized items at natural boundaries, by recursive bisection."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What counts as a token, and which lines are headings.
TOKEN = re.compile("16#[0-9A-Fa-f]+|[\u4e00-\u9fff]|[A-Za-z]+(?:_[A-Za-z]+)*|\\d+(?:\\.\\d+)?")
MARKDOWN_HEADING = re.compile(r"#{1,6}\s+(.+)")
NUMBERED_HEADING = re.compile(r"(\d+(?:\.\d+){0,4})\s+.{2,80}")
CHINESE_HEADING = re.compile("[一二三四五六七八九十]+、.{2,80}")

SIZE, OVERLAP = 450, 60
HEADING, PARAGRAPH, SENTENCE, LINE = 4, 3, 2, 1
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_SENTENCE_END = re.compile("(?:[。！？；!?;]|\\.(?=\\s))[\"'”’»）)」』]*\\s*")

_SCHEMA = "src_table string, item_id string, piece_no int, n_tokens int, overlap_tokens int, start_char int, end_char int, section_path array<string>, text string"


def heading_of(line: str) -> tuple[int, str] | None:
    """Level and title of a heading line, or None."""
    s = line.strip()
    if not s:
        return None
    if m := MARKDOWN_HEADING.fullmatch(s):
        return len(s) - len(s.lstrip("#")), m[1].strip()[:100]
    if (m := NUMBERED_HEADING.fullmatch(s)) and "..." not in s:
        return min(4, m[1].count(".") + 1), s[:100]
    return (1, s[:100]) if CHINESE_HEADING.fullmatch(s) else None


def boundaries(text: str) -> tuple[dict[int, int], list[tuple[int, int, str]]]:
    """Strength by character position where a piece may begin, and headings as (position, level, title)."""
    strength: dict[int, int] = {}
    headings: list[tuple[int, int, str]] = []
    for m in _SENTENCE_END.finditer(text):
        strength[m.end()] = SENTENCE
    blank = False
    for m in _LINE.finditer(text):
        p, line = m.start(), m[0]
        if not line:
            break
        if not line.strip():
            blank = True
            continue
        head = heading_of(line)
        if head:
            headings.append((p, *head))
        strength[p] = max(strength.get(p, 0), HEADING if head else PARAGRAPH if blank else LINE)
        blank = False
    return strength, headings


def split_item(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """Pieces of a text of more than ``size`` tokens; none for a smaller, blank or null one.

    A piece is ``(start, core, end, tokens, shared)``: characters ``core..end`` of all pieces end to end make up
    the text; ``start..core`` repeats the ``shared`` last tokens of the piece before. A part that exceeds
    ``size - overlap`` tokens is cut in two at its strongest boundary (heading, paragraph, sentence, line, else any
    token) within a quarter of its length from the middle, the nearest to the middle among equals. The overlap
    begins at a sentence where one lies between three quarters and all of ``overlap`` back."""
    if not text or len(text) <= size:
        return []
    starts = [m.start() for m in TOKEN.finditer(text)]
    n = len(starts)
    if n <= size:
        return []
    strength, _ = boundaries(text)
    at: dict[int, dict[int, int]] = {}
    for p, s in strength.items():
        i = bisect_left(starts, p)
        if 0 < i < n:
            at.setdefault(s, {})[i] = p
    levels = [(sorted(at[s]), at[s]) for s in (HEADING, PARAGRAPH, SENTENCE, LINE) if s in at]
    core = max(1, size - overlap)

    def cut(lo: int, hi: int) -> tuple[int, int]:
        mid, reach = (lo + hi) // 2, (hi - lo) // 4
        for tokens, where in levels:
            k = bisect_left(tokens, mid)
            near = [i for i in tokens[max(0, k - 1) : k + 1] if abs(i - mid) <= reach]
            if near:
                i = min(near, key=lambda i: abs(i - mid))
                return i, where[i]
        return mid, starts[mid]

    leaves: list[tuple[int, int, int, int]] = []
    todo = [(0, n, 0, len(text))]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo <= core:
            leaves.append((lo, hi, a, b))
            continue
        i, p = cut(lo, hi)
        todo += [(i, hi, p, b), (lo, i, a, p)]  # the left half is taken first
    sentences = at.get(SENTENCE, {}) | at.get(PARAGRAPH, {}) | at.get(HEADING, {})
    order = sorted(sentences)
    pieces = []
    for lo, hi, a, b in leaves:
        back, start = lo, a
        if lo:
            back = max(0, lo - overlap)
            start = starts[back]
            k = bisect_left(order, back)
            if k < len(order) and order[k] <= lo - overlap * 3 // 4:
                back, start = order[k], sentences[order[k]]
        pieces.append((start, a, b, hi - back, lo - back))
    return pieces


def _paths(text: str, positions: list[int]) -> list[list[str]]:
    """The headings in force at each position (ascending), outermost first."""
    _, headings = boundaries(text)
    out, stack, k = [], [], 0
    for p in positions:
        while k < len(headings) and headings[k][0] <= p:
            stack = [*[h for h in stack if h[0] < headings[k][1]], headings[k][1:]]
            k += 1
        out.append([title for _, title in stack])
    return out


def _pieces(size: int, overlap: int, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, keys, texts, bases = (b.column(c).to_pylist() for c in ("src_table", "item_id", "text", "section_path"))
            rows = []
            for name, key, text, base in zip(names, keys, texts, bases):
                found = split_item(text, size, overlap)
                if not found:
                    continue
                paths = _paths(text, [p[1] for p in found]) if with_text else [[]] * len(found)
                base = [x for x in base or [] if x is not None and x.strip()]
                for no, ((start, _, end, tokens, shared), path) in enumerate(zip(found, paths), 1):
                    rows.append((name, key, no, tokens, shared, start, end, base + path, text[start:end] if with_text else None))
            if rows:
                cols = list(zip(*rows))
                types = [pa.string(), pa.string(), *[pa.int32()] * 5, pa.list_(pa.string()), pa.string()]
                names_out = [c.split()[0] for c in _SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names_out)

    return work


def split_oversized(items: DataFrame, size: int = SIZE, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of all items over ``size`` tokens.

    ``items``: ``src_table, item_id, text, section_path`` (null counts as empty). Result: ``src_table, item_id,
    piece_no`` (from 1), ``n_tokens`` (``size`` at most), ``overlap_tokens``, ``start_char, end_char``,
    ``section_path`` (the item's, then the headings in force where the piece's own part begins) and ``text``.
    Without ``with_text`` only the numbers are worked out. Items within the limit, blank and null ones give
    nothing; an item row that is repeated gives its pieces once for each; see ``once``. An item is one row and
    never leaves its task, so nothing is shuffled; short texts don't reach Python."""
    longer = items.where(F.length("text") > size).select("src_table", F.col("item_id").cast("string").alias("item_id"), "text", "section_path")
    return longer.mapInArrow(_pieces(size, overlap, with_text), _SCHEMA)


def once(pieces: DataFrame) -> DataFrame:
    """Pieces of repeated item rows once."""
    return pieces.dropDuplicates(["src_table", "item_id", "piece_no", "start_char", "end_char"])
