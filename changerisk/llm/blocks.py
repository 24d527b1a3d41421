"""Vectorised splitting and hashing of texts inside a task, in blocks of bounded size.

Words are runs of bytes of a class, found on the UTF-8 bytes of many documents at once; their
hashes are differences of prefix sums. No step loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Characters of text handled at once; a longer document is a block of its own.
BLOCK_CHARS = 1 << 20
#: Bytes whose prefix sums are held at once.
_SLICE = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scramble 64-bit integers (a bijection for each seed)."""
    x = x + _U((_BASE * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit integers as numbers in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def _class(members: Iterator[int] | set[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: ASCII digits and lower-case letters, and every byte of a non-ASCII character.
ALNUM = _class({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})
#: Everything but blank, tab, line feed, vertical tab, form feed, carriage return.
SOLID = ~_class({0x20, *range(0x09, 0x0E)})
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE = mix(np.arange(256, dtype=_U), 11)
_STEP = 0xD6E8FEB86659FD93


@dataclass
class Words:
    """Words of a block: bytes (A-Z lowered), [start, end) offsets, and document of each word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    docs: int
    #: byte offset of each document in ``data``
    offset: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode()

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)

    def firsts(self) -> np.ndarray:
        """Index of each document's first word (of the next word, for a document without any)."""
        return np.concatenate(([0], np.cumsum(self.counts())))


def cut(texts: Sequence[str | None], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``chars`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(texts):
        yield start, len(texts)


def words(texts: Sequence[str | None], kind: np.ndarray, lower: bool = True) -> Words:
    coded = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    raw = np.frombuffer(b"\n".join(coded), np.uint8)
    data = _LOWER[raw] if lower else raw
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind[data]
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    sizes = np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded))
    offset = np.cumsum(sizes) - sizes
    doc = np.searchsorted(offset, start, "right") - 1
    return Words(data, start, end, doc, len(coded), offset)


_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            run = np.full(max(n, _SLICE + 1), base, _U)
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["up"][:n], _powers["down"][:n]


def hashes(w: Words) -> np.ndarray:
    """64-bit hash of each word."""
    out = np.empty(len(w.start), _U)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(w.end, w.start[a] + _SLICE, "right")))
        lo, hi = int(w.start[a]), int(w.end[b - 1])
        up, down = _power(hi - lo)
        run = np.zeros(hi - lo + 1, _U)
        np.cumsum(_BYTE[w.data[lo:hi]] * up, out=run[1:])
        s, e = w.start[a:b] - lo, w.end[a:b] - lo
        out[a:b] = (run[e] - run[s]) * down[s] + (e - s).astype(_U)
        a = b
    return mix(out)


def windows(h: np.ndarray, doc: np.ndarray, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` consecutive words of a document, and their documents.

    With ``whole``, a document of fewer words, but not none, is one run.
    """
    n = len(h)
    odd = mix(np.arange(size, dtype=_U), 5) | _U(1)
    m = max(0, n - size + 1)
    full = np.flatnonzero(doc[:m] == doc[n - m :]) if m else np.zeros(0, np.int64)
    total = np.zeros(len(full), _U)
    for k in range(size):
        total += h[full + k] * odd[k]
    d = doc[full]
    if whole and n:
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        length = np.diff(np.append(first, n))
        first, length = first[length < size], length[length < size]
        short = length.astype(_U)
        for k in range(size - 1):
            on = length > k
            short[on] += h[first[on] + k] * odd[k]
        total, d = np.concatenate((total, short)), np.concatenate((d, doc[first]))
        order = np.argsort(d, kind="stable")
        total, d = total[order], d[order]
    return mix(total), d


def occurrences(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) pairs sorted, with the running number of each repetition."""
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    if not len(h):
        return d, h, np.zeros(0, np.int64)
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
    at = np.arange(len(h))
    return d, h, at - np.maximum.accumulate(np.where(new, at, 0))
