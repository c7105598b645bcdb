"""Passages of texts as vectors of what they look like, computed for many texts at once."""

from __future__ import annotations

import numpy as np

#: Words of a passage, and code points of a piece; a text is read piece by piece.
PASSAGE_WORDS = 64
PIECE = 1 << 20

#: Classes of code points.
SPACE, LINE_END, LOWER, UPPER, DIGIT, STOP, MARK, SYMBOL, BAR, OTHER = range(10)
CLASSES = 10
SYMBOLS = "#*$%&<>@^~=_\\/+{}[]"
_KNOWN = 0x250


def _classes() -> np.ndarray:
    known = np.full(_KNOWN + 1, OTHER, dtype=np.uint8)
    for code in range(_KNOWN):
        letter = chr(code)
        if code == 10:
            known[code] = LINE_END
        elif code in (9, 11, 12, 13, 32):
            known[code] = SPACE
        elif letter in ".!?":
            known[code] = STOP
        elif letter == "|":
            known[code] = BAR
        elif letter in SYMBOLS:
            known[code] = SYMBOL
        elif letter in ",;:'\"()-":
            known[code] = MARK
        elif letter.isdecimal():
            known[code] = DIGIT
        elif letter.isupper():
            known[code] = UPPER
        elif letter.islower():
            known[code] = LOWER
    return known


CLASS_OF = _classes()
#: Shares of pairs of classes, then measures of words.
WORD_MEASURES = 13
FEATURES = CLASSES * CLASSES + WORD_MEASURES


def pieces(text: str) -> list[str]:
    return [text[at : at + PIECE] for at in range(0, len(text), PIECE)] or [""]


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of the texts in order, and the number of passages of each (one at least)."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = CLASS_OF[np.minimum(codes, _KNOWN)]
    ends = np.cumsum([len(text) + 1 for text in texts])
    blank = kinds <= LINE_END
    starts = ~blank
    starts[1:] &= blank[:-1]
    begins = np.flatnonzero(starts)
    lengths = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]])) - begins
    owner = np.searchsorted(ends, begins, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    number = np.arange(len(begins)) - np.repeat(np.cumsum(counts) - counts, counts)
    n_passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    offsets = np.cumsum(n_passages) - n_passages
    passage = offsets[owner] + number // PASSAGE_WORDS
    total = int(n_passages.sum())

    # every code point belongs to the passage of the word before it, or of the text's first word
    at_word = np.cumsum(starts) - 1
    place = np.maximum(np.append(passage, 0)[at_word], np.repeat(offsets, np.diff(ends, prepend=0)))
    cells = place[:-1] * CLASSES**2 + kinds[:-1].astype(np.int64) * CLASSES + kinds[1:]
    shares = np.bincount(np.delete(cells, ends[:-1] - 1), minlength=total * CLASSES**2)  # no pair across texts
    shares = shares.reshape(total, -1).astype(np.float32)
    shares /= np.maximum(1, shares.sum(axis=1, keepdims=True))
    if not len(begins):
        return np.column_stack([shares, np.zeros((total, WORD_MEASURES), dtype=np.float32)]), n_passages

    letters = np.where(kinds == UPPER, codes + 32, codes).astype(np.uint64)  # A-Z, and most of Latin-1
    mixed = (letters + np.uint64(1)) * _power(np.arange(len(codes)) - begins[at_word])
    mixed[blank] = 0
    hashes = np.add.reduceat(mixed, begins)
    upper = np.add.reduceat(kinds == UPPER, begins, dtype=np.int64)
    lower = np.add.reduceat(kinds == LOWER, begins, dtype=np.int64)
    last = kinds[begins + lengths - 1]
    repeats, two_back = (
        np.concatenate([[False] * min(by, len(owner)), (hashes[by:] == hashes[:-by]) & (owner[by:] == owner[:-by])]) for by in (1, 2)
    )
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order))
    fresh[1:] = (np.diff(passage[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
    measures = [
        np.log1p(lengths), lengths == 1, lengths <= 3, lengths >= 10, upper > 0, (upper > 1) & (lower == 0),
        (upper + lower) == 0, last == STOP, last == SYMBOL, last == BAR, repeats, two_back,
    ]
    per_word = np.maximum(1, np.bincount(passage, minlength=total))
    columns = [np.bincount(passage, weights=measure, minlength=total) / per_word for measure in measures]
    columns.append(np.bincount(passage[order], weights=fresh, minlength=total) / per_word)
    return np.column_stack([shares, *columns]).astype(np.float32), n_passages


_POWERS = np.cumprod(np.full(64, 6364136223846793005, dtype=np.uint64))


def _power(at: np.ndarray) -> np.ndarray:
    """A multiplier for each place in a word."""
    return _POWERS[at & 63] + (at >> 6).astype(np.uint64)
