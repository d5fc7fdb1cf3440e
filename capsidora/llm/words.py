"""Words of texts as arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def plain_words(text: Column) -> Column:
    """A text as its runs of letters and digits in lower case, parted by single blanks; null is empty."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\p{L}\p{N}]+", " ")))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (as of :func:`plain_words`), and the row of each."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset)
    b = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = offsets - offsets[0]
    first = np.zeros(len(b) + 1, bool)
    first[edges] = True
    solid = b != 32
    start = np.flatnonzero(solid & (first[:-1] | np.r_[True, ~solid[:-1]]))
    end = np.flatnonzero(solid & (first[1:] | np.r_[~solid[1:], True])) + 1
    total = np.r_[np.uint64(0), np.cumsum(b.astype(np.uint64) * _powers(_BASE, len(b)), dtype=np.uint64)]
    h = (total[end] - total[start]) * _powers(_BACK, len(b))[start]
    h ^= h >> np.uint64(31)
    return h * _STEP, np.searchsorted(edges, start, side="right") - 1


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row, without regard to rows; the last ``size - 1`` places are missing."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + n]) * _STEP
        h ^= h >> np.uint64(32)
    return h


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about ``BLOCK_BYTES`` bytes of text each."""
    raw = batch.column(column).cast(pa.large_binary())
    edges = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + BLOCK_BYTES, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
