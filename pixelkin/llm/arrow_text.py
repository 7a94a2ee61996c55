"""Texts of an Arrow column as numpy words and word shingles, a bounded slice of the column at a time.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z folded to a-z. A word's hash is a
polynomial over random 64-bit letters modulo 2^64, read off two prefix sums, so a slice costs a handful of
vector operations however many words it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LETTERS = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (an invertible finalizer of multiply and shift steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, size: int) -> np.ndarray:
    """base^0 .. base^size modulo 2^64, kept between calls."""
    known = _powers.get(base)
    if known is None or len(known) <= size:
        grown = np.full(max(size, SLICE_BYTES) + 1, base, np.uint64)
        grown[0] = 1
        known = _powers[base] = np.multiply.accumulate(grown)
    return known


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


def _pieces(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about a slice each, at white space or between texts, so that no word is cut."""
    at, size = 0, len(data)
    while at < size:
        to = at + SLICE_BYTES
        if to < size:
            edge = edges[np.searchsorted(edges, to)]
            window = to
            while window < edge and not _SPACE[data[window : window + 4096]].any():
                window += 4096
            if window < edge:
                edge = min(edge, window + int(np.argmax(_SPACE[data[window : window + 4096]])))
            to = int(edge)
        yield at, min(to, size)
        at = to


def run_hashes(part: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs part[first:last], A-Z folded."""
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_LETTERS[part] * _power(_BASE, len(part))[: len(part)], out=sums[1:])
    value = (sums[last] - sums[first]) * _power(_INVERSE, len(part))[first]
    return mix(value + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word with the total at the end)."""
    starts, hashes = [], []
    for a, b in _pieces(data, offsets):
        part = data[a:b]
        inside = ~_SPACE[part]
        before = np.zeros(len(part) + 1, bool)
        before[:-1] = inside
        breaks = offsets[(offsets >= a) & (offsets < b)] - a
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[breaks] = inside[breaks]
        closes = before[:-1] & ~before[1:]
        inner = breaks[breaks > 0] - 1
        closes[inner] = inside[inner]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        hashes.append(run_hashes(part, first, last))
        starts.append(first + a)
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text the hashes of its ``width``-word windows, repeats included.

    A text with fewer words has one window of all its words; a text without words has none.
    """
    word, edges = words(data, offsets)
    windows = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for k in range(width):
        windows += word[k : k + len(windows)] * np.uint64(pow(_BASE, 2 * k + 3, 1 << 64))
    windows = mix(windows)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= width:
            out.append(windows[a : b - width + 1])
        elif b > a:
            short = sum(int(x) * pow(_BASE, 2 * k + 3, 1 << 64) for k, x in enumerate(word[a:b]))
            out.append(mix(np.array([(short + (b - a)) % (1 << 64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
