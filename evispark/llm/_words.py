"""Words of many texts at once, as 64-bit hashes in numpy.

A word's hash is a polynomial in its bytes modulo 2**64, taken from one running sum
over the whole batch: the odd base has an inverse, so the sum between a word's two
ends can be shifted back to exponent 0. A finaliser then spreads the bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_ALNUM = np.zeros(256, np.uint8)
_ALNUM[48:58] = 1
_ALNUM[97:123] = 1
_SOLID = np.ones(256, np.uint8)
_SOLID[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
ALNUM_WORD = re.compile("[a-z0-9]+")

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


class Words(NamedTuple):
    """doc and hash of each word in order, and the number of words of each text."""

    doc: np.ndarray
    hash: np.ndarray
    counts: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting integers is vectorised, numpy's hashing of them is not."""
    x = np.sort(x)
    return x if len(x) < 2 else x[np.concatenate(([True], x[1:] != x[:-1]))]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        _inverse = np.cumprod(steps)
    return _powers, _inverse


def words(texts: Sequence[str], alnum: bool) -> Words:
    """alnum: runs of a-z and 0-9 in the lower-cased text; else runs between white space, as they stand."""
    if alnum:
        parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    else:
        parts = [(t if t.isascii() else " ".join(t.split())).encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    kind = np.zeros(len(buf) + 2, np.int8)
    kind[1:-1] = (_ALNUM if alnum else _SOLID)[buf]
    edge = np.diff(kind)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers, inverse = _tables(len(buf) + 1)
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(buf * powers[: len(buf)], out=run[1:])
    h = mix((run[end] - run[start]) * inverse[start])
    doc = np.searchsorted(ends, start, side="right")
    return Words(doc, h, np.bincount(doc, minlength=len(texts)))


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of the first word and hash of each run of n words within one text."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    powers, inverse = _tables(len(w.hash) + 1)
    run = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * powers[: len(w.hash)], out=run[1:])
    at = np.flatnonzero(w.doc[n - 1 :] == w.doc[:m])
    return at, mix((run[at + n] - run[at]) * inverse[at])


def sequence_hash(w: Words) -> np.ndarray:
    """64-bit hash of each text's words in order, as a signed integer."""
    powers, inverse = _tables(len(w.hash) + 1)
    run = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * powers[: len(w.hash)], out=run[1:])
    end = np.cumsum(w.counts)
    start = end - w.counts
    return mix((run[end] - run[start]) * inverse[start] + w.counts.astype(np.uint64)).view(np.int64)


def by_size(rows: Iterator[tuple], text_at: int, most_chars: int = 1 << 20, most_rows: int = 1000) -> Iterator[list[tuple]]:
    """Batches of rows of bounded total text length; a longer text forms its own batch."""
    batch: list[tuple] = []
    size = 0
    for row in rows:
        n = len(row[text_at])
        if batch and (size + n > most_chars or len(batch) >= most_rows):
            yield batch
            batch, size = [], 0
        batch.append(row)
        size += n
    if batch:
        yield batch
