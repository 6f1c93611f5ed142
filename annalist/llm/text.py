"""Words and shingles of many texts at once, as 64-bit keys, with numpy inside a task.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased. All work is on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240601)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _BYTE[FOLD]
_BYTE[_SEPARATOR] = 0
_ODD = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE, np.uint64)]))
    return _POWERS


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf`` (bytes)."""
    inside = np.concatenate([[False], ~_SEPARATOR[buf], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key for each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.arange(len(buf), dtype=np.int64)
    at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(buf))))
    at[: starts[0]] = 0
    worst = int(np.diff(np.append(starts, len(buf))).max())
    values = _BYTE[buf] * _powers(worst + 1)[at]
    return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * _ODD[5])


def batches(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``limit`` bytes each (or one text)."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def keyed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of ``texts``, and where each text's words begin (one more entry than texts)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    starts, ends = word_spans(buf)
    return word_keys(buf, starts, ends), np.searchsorted(starts, bounds)


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after another, and where each text's begin.

    A shingle is ``width`` words; a text of fewer words is one shingle, and a text without words has none.
    """
    words, first = keyed_words(texts)
    if width > 1 and len(words) >= width:
        n = len(words) - width + 1
        runs = np.zeros(n, np.uint64)
        for k in range(width):
            runs += words[k : k + n] * _ODD[k]
        runs = mix(runs + np.uint64(width))
    else:
        runs = np.zeros(0, np.uint64)
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            sets.append(s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s)
        elif b > a:
            sets.append(mix((words[a:b] * _ODD[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
