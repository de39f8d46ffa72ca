"""Text held as flat byte arrays: the UTF-8 bytes of an Arrow column lie in one buffer, which NumPy reads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one NumPy step holds; temporaries take some 60 times that.
SLICE_BYTES = 1 << 18


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets. A null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents of up to ``most`` bytes; a longer document stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Masks that keep the first 0 to 8 bytes of a little-endian block.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 512


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], equal for equal bytes wherever they stand.

    Blocks of eight bytes go through ``mix`` one after another; long spans have a digest of their own.
    """
    size = end - start
    blocks, out = _blocks(data), mix(size.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
    out = mix(out ^ (blocks[start] & _KEEP[np.clip(size, 0, 8)]))
    at = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    for k in range(8, LONG_SPAN, 8):
        if not len(at):
            break
        out[at] = mix(out[at] ^ (blocks[start[at] + k] & _KEEP[np.minimum(size[at] - k, 8)]))
        at = at[size[at] > k + 8]
    for k in np.flatnonzero(size > LONG_SPAN):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, by default ``[^\\x20\\x09-\\x0D]+``, of the documents data[offsets[i]:offsets[i+1]], A-Z in lower case.

    Returns the folded bytes, the words' starts and ends, and the n + 1 places where each document's words begin.
    """
    data = _FOLD[data]
    ink = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return data, start, end, np.searchsorted(start, offsets)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]] along the first axis; an empty run sums to 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Lookup:
    """Values of up to a few million 64-bit keys, by open addressing in NumPy arrays; found for many keys at once."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 2))))
        size = 1 << self.bits
        self.keys, self.at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.values = values
        keys = keys.astype(np.uint64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self.at[s] < 0
            self.at[s[free]] = left[free]  # of several keys for one slot, the last stays
            self.keys[s[free]] = keys[left[free]]
            left = left[self.at[s] != left]
            slot[left] = (slot[left] + 1) & (size - 1)
        self._check = self.keys

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among those given, or -1."""
        keys = keys.astype(np.uint64, copy=False)
        slot = self._slot(keys)
        out = self.at[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        out[left] = -1
        slot, size = slot[left], len(self.keys)
        while len(left):
            slot = (slot + 1) & (size - 1)
            at = self.at[slot]
            same = (at >= 0) & (self.keys[slot] == keys[left])
            out[left[same]] = at[same]
            go = (at >= 0) & ~same
            left, slot = left[go], slot[go]
        return out
