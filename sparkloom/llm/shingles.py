"""Word shingles of whole texts as 64-bit hashes, computed for a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _byte_values(fold_case: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold_case:
        values[65:91] = values[97:123]
    return values


_VALUES = {True: _byte_values(True), False: _byte_values(False)}


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and for each text the index of its first word (and the end).

    Words are runs without ASCII white space; ``fold_case`` makes A-Z equal a-z and nothing else.
    """
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[joined]
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[0::2] + 1, turns[1::2] + 1
    at = np.cumsum([1] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    letters = joined[~space]
    inside = np.arange(len(letters)) - np.repeat(offsets, lengths)
    terms = _VALUES[fold_case][letters] * _powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(terms, offsets) + lengths.astype(np.uint64)), first


def shingle_sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, words lower-cased in ASCII.

    A shingle is ``size`` consecutive words; a text with fewer words has one shingle, the whole sequence; one without
    words (or null) has none.
    """
    chunk: list[bytes] = []
    held = 0
    for text in texts:
        chunk.append(text or b"")
        held += len(chunk[-1])
        if held >= CHUNK_BYTES:
            yield from _sets(chunk, size)
            chunk, held = [], 0
    if chunk:
        yield from _sets(chunk, size)


def _sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    words, first = word_hashes(texts)
    odd = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    n = max(len(words) - size + 1, 0)
    runs = np.zeros(n, np.uint64)
    for k in range(size):
        runs += words[k : k + n] * odd[k]
    runs = mix(runs)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            own = words[a:b]
            yield mix(np.sum(own * odd[: b - a], dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
