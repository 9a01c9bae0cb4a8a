"""Whole batches of texts as arrays of code points: character classes, runs of words and 64-bit hashes of spans, all in numpy.

A batch of texts is joined by a separator that belongs to no class; everything is then a few passes over one array instead of a
regular expression per text. Hashes are polynomials modulo 2^64 over a random value per code point, finished by a bit mixer.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

U = np.uint64
LETTER, NUMBER, SPACE, OTHER, BREAK = 1, 2, 3, 4, 0
_BASE = 0x9E3779B97F4A7C15 | 1
SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


@cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    t = np.full(0x110001, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = NUMBER
    t[list(SPACES)] = SPACE
    t[0x110000] = BREAK
    return t


@cache
def _values() -> np.ndarray:
    return mix(np.arange(1, 0x110002, dtype=np.uint64) * U(0x632BE59BD9B4E019))


_POWERS = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by 0x110000, and where each text starts (one more start than texts)."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    cp = np.full(starts[-1], 0x110000, dtype=np.uint32)
    for r, s in zip(raw, starts):
        cp[s : s + len(r)] = r
    return cp, starts


def span_hashes(cp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the spans [a, b) of ``cp``: equal spans, equal hashes, wherever they are."""
    up, down = _powers(len(cp) + 1)
    prefix = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum(_values()[cp] * up[: len(cp)], out=prefix[1:], dtype=np.uint64)
    return mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))


def word_spans(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of letters, numbers and underscores."""
    k = class_table()[cp]
    word = (k == LETTER) | (k == NUMBER) | (cp == 0x5F)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def batches(texts: list[str], most: int = 2_000_000) -> list[list[int]]:
    """Indices of the texts in groups of about ``most`` characters; a longer text is a group of its own."""
    out: list[list[int]] = [[]]
    size = 0
    for i, t in enumerate(texts):
        if out[-1] and size + len(t) > most:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(t)
    return [g for g in out if g]
