"""Words and n-grams of many texts at once, as 64-bit hashes in numpy. Equal on every machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLAB_CHARS = 1 << 20
_BYTE = np.arange(256)
# Words are runs of ASCII letters and digits and of everything beyond ASCII, in lower case.
_IN_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_FACTOR = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


_LETTER = constants(256, 1)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _FACTOR, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slabs(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of bounded size; one long text is a run of its own."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        if i > low and held + len(text) > SLAB_CHARS:
            yield slice(low, i)
            low, held = i, 0
        held += len(text)
    if texts:
        yield slice(low, len(texts))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    coded = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(c) + 1 for c in coded])
    inside = _IN_WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), counts
    length = stop - start
    first = np.cumsum(length) - length
    offset = np.arange(int(length.sum())) - np.repeat(first, length)
    value = _LETTER[data[inside]] * _powers(int(length.max()))[offset]
    return mix(np.add.reduceat(value, first)), counts


def shingles(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs of each text and their number; a text of fewer words is one run of all its words."""
    factors = constants(n, 2)
    short = (counts > 0) & (counts < n)
    number = np.where(short, 1, np.maximum(counts - n + 1, 0))
    total = int(number.sum())
    begin = np.cumsum(counts) - counts
    place = np.repeat(begin - (np.cumsum(number) - number), number) + np.arange(total)
    have = np.repeat(np.minimum(counts, n), number)
    out = have.astype(np.uint64)
    for j in range(n):
        within = j < have
        at = np.minimum(place + j, max(len(words) - 1, 0))
        out = out + np.where(within, words[at] * factors[j], np.uint64(0)) if len(words) else out
    return mix(out), number
