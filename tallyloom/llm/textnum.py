"""Text as numbers: words and their hashes, for many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at a time; a longer text is handled alone.
BYTES_AT_ONCE = 2 << 20
#: White space of the word rule: 0x20 and 0x09 to 0x0D. All of it is ASCII, so bytes of longer characters never match.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n 64-bit numbers that follow from the seed."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_CODE = stream(256, 11) | np.uint64(1)


def words(texts: list[bytes], space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) of all texts, and where each text's words start (one more at the end).
    ``space``: for each byte, whether it stands between words."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~space[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.append(0, np.cumsum(lengths))
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.empty(0, np.uint64), first
    at = np.flatnonzero(inside)
    size = ends - starts
    offset = at - np.repeat(starts, size)
    powers = stream(int(size.max()), 12) | np.uint64(1)
    codes = BYTE_CODE[LOWER[raw[at]]]
    codes *= powers[offset]
    sums = np.add.reduceat(codes, np.append(0, np.cumsum(size)[:-1]))
    return mixed(sums + size.astype(np.uint64)), first


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``width`` words, as sorted 64-bit hashes; a text with fewer words has its whole
    sequence as the only one, a text without words has none."""
    w, first = words(texts)
    keys = stream(width, 13) | np.uint64(1)
    n = len(w) - width + 1
    if n > 0:
        rolled = w[:n] * keys[0]
        for j in range(1, width):
            rolled += w[j : j + n] * keys[j]
        rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            x = rolled[a : b - width + 1].copy()
            x.sort()
            if len(x) > 1:
                x = x[np.append(True, x[1:] != x[:-1])]
            out.append(x)
        elif b > a:
            out.append(mixed((w[a:b] * keys[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def groups(batch: pa.RecordBatch, text: int, most: int = BYTES_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with at most so many bytes of text (or one row), and their texts; null is empty, binary is taken as it is."""
    texts = batch.column(text)
    size = texts.nbytes // max(1, batch.num_rows) + 1
    rows = max(1, min(batch.num_rows, 2 * most // size))
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        raw = [x if isinstance(x, bytes) else (x or "").encode() for x in part.column(text).to_pylist()]
        ends, a = np.cumsum([len(x) for x in raw]), 0
        while a < len(raw):
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield part.slice(a, b - a), raw[a:b]
            a = b
