"""The consistent form of a text, its words, and hashes of runs of words."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

# Letters of Cyrillic and Greek and the Latin letters they look like, as Unicode's list of confusable
# characters has them; the capital iota and palochka go to I, the small kappas to k, letters like digits stay, and the lunate sigmas
# are compatibility variants of the others.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѵ": "V", "Ү": "Y", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "г": "r", "е": "e", "к": "k", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѡ": "w", "ѵ": "v", "ү": "y", "һ": "h", "ҽ": "e", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Ϳ": "J", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϝ": "F", "Ϻ": "M",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "ϳ": "j",
}
_LOOK = str.maketrans(LOOKALIKES)
#: Those letters, alone or under accents.
_LOOK_RX = re.compile("[" + "".join(chr(c) for c in range(0x370, 0x530) if LOOKALIKES.keys() & set(unicodedata.normalize("NFKD", chr(c)))) + "]")
#: All default-ignorable characters of Unicode: soft hyphen, joiners, fillers, direction and invisible operators,
#: variation selectors, shorthand and musical format controls, tags, and the ranges kept for more of them.
_IGNORABLE = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8"
    "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
#: A Chinese character alone, or a longest run of other letters and digits.
WORDS = re.compile("[\u4e00-\u9fff]|[^\\W_\u4e00-\u9fff]+")
_CJK = re.compile("[\u4e00-\u9fff]")

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def one_form(text: str) -> str:
    """``consistent_form`` without its care for white space: characters of a text may be taken one by one, if the result is
    composed once more (NFC)."""
    if text.isascii():
        return text
    if _IGNORABLE.search(text):
        text = _IGNORABLE.sub("", text)
    text = unicodedata.normalize("NFKC", text)
    if _LOOK_RX.search(text):
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFKD", text).translate(_LOOK))
    return text


def consistent_form(text: str | None, fold: bool = False) -> str | None:
    """One form for all texts that look the same.

    Ignorable characters go, compatibility variants become one (NFKC), look-alike letters become Latin (also under
    accents: decomposed, mapped, composed again) and runs of white space become one space, none at the ends. Case
    stays; ``fold`` adds full case folding. Null stays null; a blank text becomes empty. The form of a form is
    itself."""
    if text is None:
        return None
    text = " ".join(one_form(text).split())
    return unicodedata.normalize("NFKC", text.casefold()) if fold else text


#: Letters and digits of Latin-1 as they are, all else a space.
_LATIN = bytes(b if chr(b).isalnum() else 32 for b in range(256))


def split_words(text: str) -> list[str]:
    """Words of a text that is lower-case and in consistent form. The Greek letter of micro counts as the sign."""
    text = text.replace("\u03bc", "\u00b5")
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(text)


def words_of(text: str | None) -> list[str]:
    """Words of the lower-case consistent form, in order; none for null and blank texts."""
    return split_words(consistent_form(text).lower()) if text else []


class WordHasher:
    """64-bit hashes of words, remembered; the memory is emptied when it grows beyond ``most`` words."""

    def __init__(self, most: int = 400_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all texts end to end, and the number of words of each."""
        if len(self.known) > self.most:
            self.known.clear()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        flat: list[int] = []
        for ws in texts:
            for w in ws:
                h = known.get(w)
                if h is None:
                    h = known[w] = digest(w)
                flat.append(h)
        return np.array(flat, dtype=np.uint64), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def run_sets(hashes: np.ndarray, lengths: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 53-bit hashes of runs of ``k`` words of each text, sorted, end to end, and how many each text has.

    A text of fewer words than ``k`` has one run: all of its words (none if it has no word)."""
    if len(lengths) > 2048:
        ends = np.cumsum(lengths)
        parts = []
        for i in range(0, len(lengths), 2048):
            j = min(len(lengths), i + 2048)
            parts.append(run_sets(hashes[ends[i] - lengths[i] : ends[j - 1]], lengths[i:j], k))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    total = len(hashes)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(total)  # words from here to the text's end
    acc = hashes * _M1
    for i in range(1, k):
        nxt = np.concatenate((hashes[i:], np.zeros(min(i, total), np.uint64)))
        nxt[left <= i] = 0
        acc = (acc ^ (acc >> np.uint64(29))) * _M2 + (nxt ^ (nxt >> np.uint64(31 - i))) * _M3
    acc ^= acc >> np.uint64(32)
    keep = left >= k
    short = starts[(lengths > 0) & (lengths < k)]
    keep[short] = True
    keys = np.sort((owner[keep] << np.uint64(53)) | (acc[keep] >> np.uint64(11)))
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return keys & np.uint64((1 << 53) - 1), np.bincount((keys >> np.uint64(53)).astype(np.int64), minlength=len(lengths))
