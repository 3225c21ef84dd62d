"""Vectorised numpy kernels over Arrow string batches: words, word hashes, word shingles.

A batch is cut into slices of a bounded number of bytes, so temporary arrays stay small however long a batch is; one text
longer than that forms a slice of its own. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
#: The bytes that separate words, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators where punctuation counts as space: all of ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give back to the system what Arrow's pool and malloc keep of freed memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run):
    """``run``, a function for mapInArrow, whose worker keeps no freed memory after its last batch: it stays and waits beside the executor's JVM, through stages without Python."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES):
    """Parts of ``batch`` whose texts have at most ``max_bytes`` together, or one text."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes.astype(np.int64)), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts, texts.slice(0, 0)])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets; empty parts give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "fu" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Words:
    """Words of the texts of a slice: byte ``starts`` and ``ends``, 64-bit ``hashes``, and ``offsets`` of texts in words."""

    def __init__(self, data: np.ndarray, text_offsets: np.ndarray, separators: np.ndarray = SPACE):
        word = ~separators[data]
        first, last = word.copy(), word.copy()
        if len(data):
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            inner = text_offsets[(text_offsets > 0) & (text_offsets < len(data))]
            first[inner], last[inner - 1] = word[inner], word[inner - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, text_offsets)
        forward, back = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        sums_to = np.take(_BYTE, data, out=total[1:], mode="clip")
        sums_to *= forward[: len(data)]
        np.cumsum(sums_to, out=sums_to)
        self.hashes = mix((total[self.ends] - total[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words (a shorter text is one run), repeats included, and the offsets of texts."""
        n = np.diff(self.offsets)
        count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
        offsets = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.offsets[:-1] - offsets[:-1], count) + np.arange(offsets[-1])
        padded = np.concatenate([self.hashes, np.zeros(k, np.uint64)])
        total = np.zeros(len(at), np.uint64)
        room = np.repeat(np.minimum(n, k), count)
        short = bool((n < k).any())
        for j in range(k):
            part = padded[at + j] * _SHINGLE[j]
            total += np.where(room > j, part, np.uint64(0)) if short else part
        return mix(total + room.astype(np.uint64)), offsets


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and their offsets."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.concatenate(parts) if parts else hashes, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
