"""Word and shingle hashes of whole batches of texts with NumPy.

A word is a longest run of a-z and 0-9 of the text after lower-casing, canonical decomposition and dropping of the
combining marks. Words are hashed to 64 bits by a polynomial over their letters with prefix sums, so a batch costs a
few array passes and no Python loop over words.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
#: Characters hashed together; keeps the arrays inside the CPU caches.
_CHUNK_CHARS = 400_000


@lru_cache(maxsize=1)
def _marks() -> re.Pattern:
    points = [c for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Mn"]
    runs, start = [], points[0]
    for a, b in zip(points, points[1:] + [None]):
        if b != a + 1:
            runs.append((start, a))
            start = b
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]+")


_TABLE = np.zeros(256, dtype=np.uint64)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _TABLE[_c] = _c


def _fold_any(low: str) -> bytes:
    low = _marks().sub("", unicodedata.normalize("NFD", low))
    # decomposition can bring out a capital (as in a compatibility form without its own lower case)
    return low.encode("ascii", "replace").lower()


@lru_cache(maxsize=1)
def _latin() -> bytes:
    """The folded byte of every character of Latin-1; those that are no letter or digit then fold to one ``?``."""
    return bytes(ord("?") if len(f := _fold_any(chr(c))) != 1 else f[0] for c in range(256))


#: Characters outside Latin-1 that fold to ``?`` like any sign; all others there are looked at one by one.
_UNCOMMON = re.compile("[^\x00-\xff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u2bff]")


def fold(text: str | None) -> bytes:
    """The folded text as ASCII, other characters as ``?``; null as empty."""
    if not text:
        return b""
    low = text.lower()
    if low.isascii():
        return low.encode("ascii")
    if _UNCOMMON.search(low):
        return _fold_any(low)
    return low.encode("latin-1", "replace").translate(_latin())


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.full(n, _BASE, dtype=np.uint64)
    ones[0] = 1
    back = np.full(n, _INV, dtype=np.uint64)
    back[0] = 1
    return np.cumprod(ones), np.cumprod(back)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(folded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(b) + 1 for b in folded), dtype=np.int64, count=len(folded))
    buf = np.frombuffer(b" ".join(folded) + b" ", dtype=np.uint8)
    values = _TABLE[buf]
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = values != 0
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    size = 1 << max(len(buf) + 1, 2).bit_length()
    up, down = _powers(size)
    prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(buf)], out=prefix[1:])
    h = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    doc_ends = np.cumsum(lengths)
    counts = np.diff(np.searchsorted(starts, doc_ends), prepend=0)
    return h, counts


_OUTSIDE = re.compile(rb"[^a-z0-9]")


def _parts(folded: bytes) -> Iterator[bytes]:
    """A folded text in parts of bounded size, cut between words."""
    start = 0
    while len(folded) - start > _CHUNK_CHARS:
        cut = _OUTSIDE.search(folded, start + _CHUNK_CHARS)
        if cut is None:
            break
        yield folded[start : cut.start()]
        start = cut.start()
    yield folded[start:]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text. Long texts are hashed in parts."""
    hashes, counts, owners, part, size = [], [], [], [], 0

    def flush() -> None:
        h, n = _word_hashes(part)
        hashes.append(h), counts.append(n)

    for i, text in enumerate(texts):
        for piece in _parts(fold(text)):
            part.append(piece)
            owners.append(i)
            size += len(piece) + 1
            if size > _CHUNK_CHARS:
                flush()
                part, size = [], 0
    if part:
        flush()
    if not owners:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    per_text = np.bincount(owners, weights=np.concatenate(counts), minlength=len(texts)).astype(np.int64)
    return np.concatenate(hashes), per_text


@lru_cache(maxsize=8)
def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants, from the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences of ``k`` consecutive words of each text, hashed and sorted; and their number by text."""
    n_docs = len(counts)
    if len(words) < k:
        return np.empty(0, np.uint64), np.zeros(n_docs, np.int64)
    c = constants(k, 11)
    m = len(words) - k + 1
    h = words[:m] * c[0]
    for i in range(1, k):
        h = h + words[i : i + m] * c[i]
    h = mix(h)
    doc = np.repeat(np.arange(n_docs), counts)
    keep = doc[:m] == doc[k - 1 :]  # not across two texts
    h, doc = h[keep], doc[:m][keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        first = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        h, doc = h[first], doc[first]
    return h, np.bincount(doc, minlength=n_docs)


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def slices(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``most`` elements together (one text at least)."""
    ends, a = np.cumsum(counts), 0
    while a < len(counts):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield a, b
        a = b


def mix_light(x: np.ndarray) -> np.ndarray:
    """Enough mixing after a multiplication for the order of MinHash values."""
    return (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
