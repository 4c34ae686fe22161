"""Vectorised helpers over the UTF-8 bytes of Arrow string columns, for use inside tasks.

Nothing here walks over characters in Python: a batch of texts is one byte array with offsets,
and words, windows and their hashes are found with array operations over it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_ODD = 0x5851F42D4C957F2D  # an odd multiplier, so that it has an inverse modulo 2**64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: For bytes.translate: lower-cases A-Z and nothing else.
LOWER_TABLE = _LOWER.tobytes()


def slices(batches: Iterator[pa.RecordBatch], column: str, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs of about slice_bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).cumsum()
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + slice_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows together, and the offsets of rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, np.uint64(base % 2**64))
        have[0] = 1
        have = np.cumprod(have)
        if size <= 2 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers of an odd base, modulo 2**64; one longer than data."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * _power(_ODD, len(data), "up"), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand; from sums()."""
    down = _power(pow(_ODD, -1, 2**64), len(prefix), "down")
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


#: Bytes of a word that are hashed eight by eight; longer words are named by a digest.
_LANES = 64
_FRONT = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """64-bit hashes of data[start:end] under a key, equal for equal bytes wherever they stand.

    Eight bytes after eight are scrambled into the hash, so that no sums of byte values can
    collide; spans of more than 64 bytes are hashed by their keyed blake2b digest.
    """
    size = end - start
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", wide, strides=(1,))  # the eight bytes from each place on
    h = mix((size.astype(np.uint64) + np.uint64(key)) * _GOLD)
    live = np.flatnonzero((size > 0) & (size <= _LANES))
    at = 0
    while len(live):
        lane = eight[start[live] + at] & _FRONT[np.minimum(size[live] - at, 8)]
        h[live] = mix((h[live] ^ lane) * _GOLD)
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > _LANES).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, key=b"%d" % key).digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and 9-13, which never cross rows,
    and the number of words before each row (one longer than the rows)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = inside[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, key: int = 0) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes, under a key, of its runs of `size` words.

    With fewer words the whole sequence is the one member; without words the set is empty.
    """
    if not len(data):
        yield from (np.zeros(0, np.uint64) for _ in offsets[1:])
        return
    start, end, at = words(data, offsets)
    one = word_hashes(data, start, end, key)
    for row in range(len(offsets) - 1):
        w = one[at[row] : at[row + 1]]
        n = min(size, len(w))
        if not n:
            yield w
            continue
        h = np.full(len(w) - n + 1, np.uint64(n))
        for k in range(n):
            h = mix(h * _GOLD + w[k : len(w) - n + 1 + k])
        yield np.unique(h)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array for each row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat).cast(kind))
