"""Array kernels over the text buffers of Arrow batches: words, word hashes, shingles.

Words are maximal runs without the bytes 0x20 and 0x09-0x0D, A-Z lower-cased. UTF-8 keeps
those bytes out of every longer character, so the kernels work on bytes and never decode.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about this many bytes, whatever the size of a batch.
SLICE_BYTES = 4 << 20
#: A step that makes many whole numbers of each byte takes slices of this many: a worker's peak is that much lower.
SMALL_SLICE_BYTES = 1 << 20

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (every input bit reaches every output bit)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256, dtype=np.uint8)
    space = (byte == 32) | ((byte >= 9) & (byte <= 13))
    lower = np.where((byte >= 65) & (byte <= 90) & fold, byte + 32, byte).astype(np.uint64)
    return space, mix(lower * np.uint64(0xD1B54A32D192ED03) + np.uint64(1))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    if n:
        steps[0] = 1
    return np.multiply.accumulate(steps)


def text_slices(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column: first row, last row, bytes, offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + n + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + budget, side="right")) - 1
        last = min(n, max(last, first + 1))
        start, stop = offsets[first], offsets[last]
        yield first, last, data[start:stop], offsets[first:last + 1] - start
        first = last


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and how many words each text has; ``space`` marks the
    bytes between words if they are others than white space."""
    n_docs = len(offsets) - 1
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(n_docs, np.int64)
    if space is None:
        space, _ = _tables()
    solid = ~space[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    heads = inner[inner < len(data)]
    opens[heads] = solid[heads]
    tails = inner[inner > 0] - 1
    closes[tails] = solid[tails]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands, and with ``fold`` in either case of A-Z."""
    if not len(starts):
        return np.empty(0, np.uint64)
    _, values = _tables(fold)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _powers(_BASE, len(data)), out=sums[1:])
    shift = _powers(_BASE_INVERSE, len(data) + 1)[starts]
    length = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * shift + length)


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles in reading order, and how many each text has.

    A text with fewer than ``size`` words gives its whole sequence as one shingle; a text
    without words gives none.
    """
    total = len(hashes)
    per_doc = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if not total:
        return np.empty(0, np.uint64), per_doc
    steps = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(total) - first[doc]
    left = counts[doc] - place
    acc = np.zeros(total, np.uint64)
    for j in range(min(size, total)):
        tail = hashes[j:] * steps[j]
        acc[:total - j] += np.where(left[:total - j] > j, tail, np.uint64(0))
    acc += np.minimum(left, size).astype(np.uint64)
    keep = (left >= size) | ((place == 0) & (counts[doc] < size))
    return mix(acc[keep]), per_doc


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, counts = words(data, offsets)
    return shingle_hashes(word_hashes(data, starts, ends), counts, size)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text in turn its distinct shingle hashes, ascending (unsigned)."""
    for _, _, data, offsets in text_slices(column, SMALL_SLICE_BYTES):
        hashes, counts = shingles(data, offsets, size)
        stop = np.cumsum(counts)
        for a, b in zip(stop - counts, stop):
            one = np.sort(hashes[a:b])
            if len(one) > 1:
                one = one[np.concatenate(([True], one[1:] != one[:-1]))]
            yield one


def char_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return np.diff(heads[offsets])
