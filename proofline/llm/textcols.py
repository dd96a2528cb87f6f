"""Vectorised access to text columns inside Arrow batches, shared by the operators of this subpackage.

All helpers work on one flat byte array per slice of a batch, with document offsets beside it, so that a
slice holds a bounded number of bytes (plus at most one document) however long a batch is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; the temporary arrays are about 60 times as large.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, offsets); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if binary.null_count:
        binary = binary.fill_null(b"")
    _, offsets, data = binary.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1] if len(binary) else np.zeros(1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows_limit: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a column of at most ``limit`` bytes and ``rows_limit`` rows, or one row: (first, last + 1, bytes, offsets)."""
    data, at = flat(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, min(first + rows_limit, int(np.searchsorted(at, at[first] + limit, side="right")) - 1))
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as (starts, ends, index of the first word of each document and the total)."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    inside = ~_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = at[:-1][at[1:] > at[:-1]]
    opens[full] = inside[full]
    ends = at[1:][at[1:] > at[:-1]] - 1
    closes[ends] = inside[ends]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, at)


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for which, base in (("_powers", _MULTIPLIER), ("_inverses", inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                globals()[which] = np.multiply.accumulate(steps)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every bit of the input over all bits."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Ranges beyond so many bytes are hashed one by one.
_LONG_RANGE = 512
_LANE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_CHAIN = np.uint64(0xD6E8FEB86659FD93)


def range_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of byte ranges: a chain of mixing steps over lanes of eight bytes, with the length.

    Other than in a polynomial, every step depends on the bytes before it, so no structure of the bytes cancels out.
    """
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * np.uint64(_MULTIPLIER) + np.uint64(seed))
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        lanes = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        longer = size > _LONG_RANGE
        open_ = np.flatnonzero(~longer & (size > 0))
        k = 0
        while len(open_):
            left = size[open_] - k
            lane = lanes[starts[open_] + k] & _LANE_MASKS[np.minimum(left, 8)]
            out[open_] = mix(out[open_] * _CHAIN ^ lane)
            open_ = open_[left > 8]
            k += 8
        for i in np.flatnonzero(longer):
            digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            out[i] = np.uint64(int.from_bytes(digest, "little"))
    return out


class RollingHash:
    """Polynomial fingerprints, modulo 2**64, of any byte ranges of one flat array in constant time each."""

    def __init__(self, data: np.ndarray):
        powers, self._inverse = _grow(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts] ^ (ends - starts).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """Fingerprints of all ranges of one length, by start."""
        n = len(self._sums) - length
        with np.errstate(over="ignore"):
            return mix((self._sums[length:] - self._sums[:n]) * self._inverse[:n])


def rows_of(counts_at: np.ndarray) -> np.ndarray:
    """For group boundaries [0, a, b, ...]: the group of each element."""
    return np.repeat(np.arange(len(counts_at) - 1), np.diff(counts_at))
