"""Words, hashes and shingles of Arrow text columns, computed over whole batches with numpy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once; one text may be longer and is then worked on alone. After so many of them, freed memory goes back.
CHUNK_BYTES, RELEASE_BYTES = 1 << 18, 1 << 25

_U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SAME = np.arange(256, dtype=np.uint8)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than texts) and bytes; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut where more than CHUNK_BYTES of text would come together."""
    done = 0
    for batch in batches:
        size = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part, begin = np.cumsum(size) // CHUNK_BYTES, 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1), len(part)]:
            if end > begin:
                yield batch.slice(begin, end - begin)
            begin = end
        done += int(size.sum())
        if done > RELEASE_BYTES:
            done = 0
            release()
    release()


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: int = 0x9E3779B97F4A7C55) -> np.ndarray:
    p = np.full(max(n, 1), base, _U)
    p[0] = 1
    return np.cumprod(p, dtype=_U)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a text column.

    start, length: of each word in raw; hash: 64 bits from its bytes; first: index of each text's first word, and the number of all.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.offsets, raw = utf8(texts)
        self.raw = (LOWER if lower else SAME)[raw]
        inside = ~WHITE[self.raw]
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        begins = self.offsets[:-1][self.offsets[:-1] < len(raw)]
        edge[begins] |= inside[begins]
        self.start = np.flatnonzero(edge)
        kept = np.flatnonzero(inside)
        at = np.searchsorted(kept, self.start)
        self.length = np.diff(np.append(at, len(kept)))
        if len(kept):
            place = np.arange(len(kept)) - np.repeat(at, self.length)
            value = (self.raw[kept].astype(_U) + _U(1)) * _powers(int(self.length.max()))[place]
            self.hash = mix(np.add.reduceat(value, at) + self.length.astype(_U))
        else:
            self.hash = np.zeros(0, _U)
        self.first = np.searchsorted(self.start, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word shingles in order, and the index of each text's first; a text of 1 to n - 1 words has one, its whole sequence."""
        words, h = self.counts(), self.hash
        if len(h):
            acc = np.zeros(max(len(h) - n + 1, 0), _U)
            for k in range(n):
                acc = mix(acc * _U(0x9E3779B97F4A7C55) + h[k : len(h) - n + 1 + k])
        else:
            acc = h
        number = np.where(words >= n, words - n + 1, (words > 0).astype(words.dtype))
        first = np.concatenate([[0], np.cumsum(number)])
        out = np.zeros(first[-1], _U)
        long = np.flatnonzero(words >= n)
        if len(long):
            k = number[long]
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            out[np.repeat(first[:-1][long], k) + step] = acc[np.repeat(self.first[:-1][long], k) + step]
        for i in np.flatnonzero((words > 0) & (words < n)):
            x = _U(words[i])
            for w in h[self.first[i] : self.first[i + 1]]:
                x = mix((np.array([x]) * _U(0xD6E8FEB86659FD93) + w))[0]
            out[first[i]] = x
        return out, first


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(_U).view(np.int64)
