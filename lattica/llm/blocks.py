"""Vectorised text handling shared by the Arrow-batch operators.

Texts are taken as UTF-8 bytes straight from Arrow's buffers and handled in
blocks of about half a megabyte, so that a worker's memory follows the block and
the longest single text, not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES, LONG_WORD, PLACE_BITS = 1 << 19, 64, 28
U = np.uint64

#: Odd multipliers and mixing constants of the hashes below.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


_libc = ctypes.CDLL(None)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; when they have ended, what the worker no longer needs goes back to the system, as it may live on idle."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        if hasattr(_libc, "malloc_trim"):
            _libc.malloc_trim(0)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ U(salt)
    x = (x ^ (x >> U(30))) * U(MIX_A)
    x = (x ^ (x >> U(27))) * U(MIX_B)
    return x ^ (x >> U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or have[0].size < n:
        size = max(BLOCK_BYTES + 4096, 1 << (n - 1).bit_length())
        up, down = np.full(size, U(base)), np.full(size, U(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 8 * BLOCK_BYTES:
            _powers[base] = have
    return have


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading zero."""
    out = np.zeros(values.size + 1, U)
    np.cumsum(values * powers(base, max(values.size, 1))[0][: values.size], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the stretches [start, end) of the values behind sums."""
    return mix((sums[end] - sums[start]) * powers(base, sums.size)[1][start])


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each stretch of `width` values; empty where there are fewer."""
    n = values.size - width + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = prefix(values, base)
    return mix((sums[width:] - sums[:-width]) * powers(base, sums.size)[1][:n])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins (one more at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row bounds within them) of runs of rows of about `limit` bytes."""
    data, at = text_bytes(batch.column(column))
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, bounds: np.ndarray, gap: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are not gaps; runs end with their row."""
    if not data.size:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~gap[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < data.size)]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = WORD_BASE) -> np.ndarray:
    """Hashes of byte stretches: eight bytes at a time are mixed in, after the length; long ones begin from their XXH64.

    Not a power sum, which strings made for it would collide under; stretches of eight bytes or fewer never collide
    with others of their length.
    """
    size = end - start
    out = mix(size.astype(U), salt)
    lanes = np.ndarray(data.size + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    left, at, own = np.minimum(size, LONG_WORD), start.copy(), np.flatnonzero(size)
    while own.size:
        n = np.minimum(left[own], 8)
        out[own] = mix(out[own] ^ (lanes[at[own]] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * n.astype(U)))), salt)
        at[own] += 8
        left[own] -= n
        own = own[left[own] > 0]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = mix(out[k : k + 1] ^ U(xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes(), salt)), salt)[0]
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: out.size - (width - have)], out[width - have :]) if have < width else out


def anchors(grams: np.ndarray, width: int, valid: np.ndarray, bits: int = PLACE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Minimizers: for each valid stretch of `width` grams the leftmost least one, by all but the low `bits` bits.

    Returns each valid stretch's anchor position and the distinct anchors.
    Equal stretches have their anchors at equal distances from their starts,
    so two occurrences of one stretch always show two anchors of one value.
    Positions are counted anew every 2**(bits - 1) stretches, so a text of any length has room.
    """
    low, step, parts = U((1 << bits) - 1), 1 << (bits - 1), [np.zeros(0, np.int64)]
    for s in range(0, valid.size, step):
        own = grams[s : s + step + width - 1]
        key = (own & ~low) | np.arange(own.size, dtype=U)
        here = valid[s : s + step]
        parts.append((sliding_min(key, width)[: here.size][here] & low).astype(np.int64) + s)
    least = np.concatenate(parts)
    return least, least[np.r_[True, least[1:] != least[:-1]]] if least.size else least


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].view(np.int8)))
    return edge[::2], edge[1::2]


def cover(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the positions inside any [start, end)."""
    depth = np.zeros(size + 1, np.int32)
    np.add.at(depth, np.clip(start, 0, size), 1)
    np.add.at(depth, np.clip(end, 0, size), -1)
    return np.cumsum(depth[:-1]) > 0
