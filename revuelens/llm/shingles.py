"""Words and word shingles of whole texts as 64-bit hashes, in numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

# White space that ends a word, and A-Z in lower case.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACES = np.random.default_rng(20240501).integers(1 << 62, size=(64, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


KEPT_POWERS = (1 << 20) + 1024  # a slice of texts and a little more


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those of a slice are kept, a longer text makes its own."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, KEPT_POWERS), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) == KEPT_POWERS:
            _powers[int(base)] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hashes`` reads any span's hash from them."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_INVERSE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; equal spans hash alike wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * powers(_BASE, len(sums))[starts] + (ends - starts).astype(np.uint64))


class Words(NamedTuple):
    starts: np.ndarray  # byte bounds in the slice
    ends: np.ndarray
    doc: np.ndarray  # row of each word
    counts: np.ndarray  # words of each row


def find_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Maximal runs of non-space bytes that do not cross a row's bounds."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    if len(data):
        edges = bounds[:-1][bounds[:-1] < len(data)]
        first[edges] = inside[edges]
        tails = bounds[1:][bounds[1:] > 0] - 1
        last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(bounds, starts, side="right") - 1
    return Words(starts, ends, doc, np.bincount(doc, minlength=len(bounds) - 1))


LONG = 4 << 20  # bytes of a text beyond which it is worked in parts


def word_parts(data: np.ndarray, stride: int, overlap: int, size: int | None = None) -> Iterator[np.ndarray]:
    """A text in parts that begin at every so many words, a multiple of ``stride``.

    Each part goes on for ``overlap`` words beyond the beginning of the next, so what spans
    that many words and one more stands whole in some part. No word is cut.
    """
    start, size = 0, size or LONG
    reach = size
    while start + reach < len(data):
        words = find_words(data[start : start + reach], np.array([0, min(reach, len(data) - start)]))
        # The last word may go on.
        n = (len(words.starts) - 1 - overlap) // stride * stride
        if n <= 0:
            reach *= 2
            continue
        yield data[start : start + (int(words.ends[n + overlap - 1]) if overlap else int(words.ends[n - 1]))]
        start, reach = start + int(words.starts[n]), size
    yield data[start:]


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return span_hashes(prefix_sums(data), words.starts, words.ends)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, end to end, and each row's bounds.

    A row with fewer words has its whole sequence as one shingle, a row without
    words has none. Words are lower-cased A-Z only. A long text, which comes alone, is
    worked in parts that share ``length`` - 1 words.
    """
    if len(bounds) == 2 and len(data) > LONG:
        each = word_parts(data, 1, length - 1)
        parts = [_shingle_sets(p, np.array([0, len(p)]), length)[0] for p in each]
        values = np.unique(np.concatenate(parts))
        return values, np.array([0, len(values)])
    return _shingle_sets(data, bounds, length)


def _shingle_sets(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    lower = LOWER[data]
    words = find_words(lower, bounds)
    hashes = word_hashes(lower, words)
    n_rows, n_words = len(bounds) - 1, len(hashes)
    row_start = np.zeros(n_rows + 1, dtype=np.int64)
    np.cumsum(words.counts, out=row_start[1:])
    place = np.arange(n_words) - row_start[words.doc] if n_words else np.zeros(0, np.int64)
    total = words.counts[words.doc] if n_words else place
    # Every start with enough words after it; the first word of a shorter row.
    use = np.flatnonzero((place + length <= total) | ((place == 0) & (total < length)))
    size = np.minimum(total[use], length)
    sums = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(length):
        here = use[size > j]
        sums[size > j] += hashes[here + j] * _PLACES[j, 0]
    values, doc = mixed(sums).view(np.int64), words.doc[use]
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[fresh], doc[fresh]
    out = np.zeros(n_rows + 1, dtype=np.int64)
    np.cumsum(np.bincount(doc, minlength=n_rows), out=out[1:])
    return values, out


def set_digests(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per set that do not depend on order: two sums of scrambled values."""
    scrambled = values.view(np.uint64)
    sums = []
    for key in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        running = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(mixed(scrambled ^ np.uint64(key)), out=running[1:])
        sums.append((running[bounds[1:]] - running[bounds[:-1]]).view(np.int64))
    return sums[0], sums[1]
