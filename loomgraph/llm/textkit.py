"""Vectorised word hashing over batches of texts, for the operators that read every word.

A word is a run of bytes other than space and tab to carriage return (0x20, 0x09-0x0D); in UTF-8 these
bytes never occur inside another character. Hashes are 64 bits wide: a word's bytes are mapped to fixed
random numbers, summed as a polynomial modulo 2**64 and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_SEGMENT = 1 << 18
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED = _BYTE.copy()
_FOLDED[0x41:0x5B] = _BYTE[0x61:0x7B]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Multipliers of the words of a shingle, by place.
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, _SEGMENT + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base % (1 << 64), np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def _segments(buf: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of at most _SEGMENT bytes at white space; a longer word makes a longer segment."""
    at, n = 0, len(buf)
    while n - at > _SEGMENT:
        back = np.flatnonzero(space[at + _SEGMENT // 2 : at + _SEGMENT])
        if len(back):
            cut = at + _SEGMENT // 2 + int(back[-1]) + 1
        else:
            ahead = np.flatnonzero(space[at + _SEGMENT :])
            cut = at + _SEGMENT + int(ahead[0]) + 1 if len(ahead) else n
        yield at, cut
        at = cut
    if at < n:
        yield at, n


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a buffer."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(texts: Sequence[str | None], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the number of words of each text.

    ``fold`` lower-cases A-Z. A null text has no words.
    """
    raw = [x.encode("utf-8", "replace") if x else b"" for x in texts]
    buf = np.frombuffer(b" ".join(raw), np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    ends_of_text = np.cumsum([len(x) + 1 for x in raw])
    starts, ends = word_spans(buf)
    counts = np.diff(np.searchsorted(starts, ends_of_text), prepend=0)
    table, out = (_FOLDED if fold else _BYTE), np.empty(len(starts), np.uint64)
    for a, b in _segments(buf, _SPACE[buf]):
        i, j = np.searchsorted(starts, (a, b))
        if i == j:
            continue
        up, down = _powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[buf[a:b]] * up[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * down[s]
    return mix(out), counts


def shingles(words: np.ndarray, counts: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; a shorter text is one shingle, an empty one none."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        total += words[k : k + len(total)] * _PLACE[k]
    total = mix(total)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(total[at : at + c - n + 1]))
        elif c:
            short = (words[at : at + c] * _PLACE[32 : 32 + c]).sum(dtype=np.uint64) + np.uint64(c)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def batches(texts: Sequence[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` characters together; a longer text is a run of its own."""
    at = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
