"""Vectorised text primitives on Arrow string columns: words, lines, hashes, all with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as
`[^\\x20\\x09-\\x0D]+` on code points. Every function works on a whole batch of texts at once.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # bytes of text handled at once; a longer text is a chunk of its own

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NGRAM = _rng.integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of texts of at most `limit` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


@dataclass
class Words:
    """Words of a run of texts: byte bounds of each, and for each text the range of its words."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first[i]:first[i+1] are the words of text i

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(raw: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """Words of the texts raw[offsets[i]:offsets[i+1]], cut before the bytes of `cuts` too."""
    inside = ~SPACE[raw]
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if cuts is not None:
        edge[:n] |= cuts
    before = np.empty(n, bool)
    before[:1] = True
    np.logical_or(~inside[:-1], edge[1:n], out=before[1:])
    start = np.flatnonzero(inside & before)
    after = np.empty(n, bool)
    after[-1:] = True
    np.logical_or(~inside[1:], edge[1:n], out=after[:-1])
    end = np.flatnonzero(inside & after) + 1
    return Words(raw, start, end, np.searchsorted(start, offsets))


def word_hashes(w: Words) -> np.ndarray:
    """64-bit multilinear hashes of the words' bytes."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    lengths = w.end - w.start
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    values = _BYTE[w.raw[place + np.repeat(w.start, lengths)]] * _PLACE[place & 0xFFFF]
    if lengths.max() > 0xFFFF:
        far = place > 0xFFFF
        values[far] *= mix((place[far] >> 16).astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat(values, ends - lengths) + lengths.astype(np.uint64))


def ngram_hashes(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of every run of n word hashes, over text bounds too; the caller masks those."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * _NGRAM[which, j]
    return mix(out)


def starts_of_ngrams(w: Words, n: int) -> np.ndarray:
    """Word positions at which n words of one text begin."""
    ok = np.zeros(len(w.start), bool)
    for_text = w.first[1:] - n
    has = w.counts >= n
    delta = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(delta, w.first[:-1][has], 1)
    np.add.at(delta, for_text[has] + 1, -1)
    ok[:] = np.cumsum(delta[:-1]) > 0
    return np.flatnonzero(ok)


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` words lie in a window of n words that begins at one of `starts`."""
    delta = np.zeros(total + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + n, -1)
    return np.cumsum(delta[:-1]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def joined(w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, text offsets, end of each kept word) of the kept words, joined by one space in each text."""
    text = w.text
    start, end = w.start, w.end
    if keep is not None:
        text, start, end = text[keep], start[keep], end[keep]
    lengths = end - start
    gap = np.zeros(len(text), np.int64)
    gap[1:] = text[1:] == text[:-1]
    stop = np.cumsum(lengths + gap)
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
    if len(out):
        total = np.cumsum(lengths)
        step = np.arange(total[-1]) - np.repeat(total - lengths, lengths)
        out[np.repeat(stop - lengths, lengths) + step] = w.raw[np.repeat(start, lengths) + step]
    counts = np.bincount(text, minlength=len(w.first) - 1)
    upto = np.concatenate([[0], np.cumsum(counts)])
    offsets = np.concatenate([[0], stop])[upto]
    return out, offsets, stop


def strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow string array over UTF-8 bytes and text offsets."""
    off = np.ascontiguousarray(offsets, np.int64)
    array = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(raw.tobytes())])
    return array.cast(pa.string()) if len(raw) < 2**31 - 1 else array


def release() -> None:
    """Give freed memory back to the system, so that a worker is small between batches."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)
