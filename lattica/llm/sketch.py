"""A sketch of the values that occur twice, built from partition sketches.

Each task hands over, for every shard, 32 bits of each value it met (twice if met more
than once).  Values are dealt to shards by other bits of their hash, and a shard's are merged and sorted
independently: those that come twice set a cell in each row, one bit, and only these
bits go on.  Equal values always meet, so nothing is ever lost; different ones that share shard and 32 bits
(about one in a thousand at 2**30 values) or cells only let more through.  The width follows the
input (CELLS_PER_ITEM cells an item) up to `max_bits` = 2**28 cells a row, which
bounds what is broadcast at 2 x 32 MB; as values that come once set no cell, that many hold out well beyond
as many values.  A shard's merge holds its values, 4 bytes each: at 2**28 cells a 256th of the corpus's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import U, mix, released

CELLS_PER_ITEM, MIN_BITS, MAX_BITS, SHARD_BITS, ROWS = 4, 16, 28, 20, 2
FLUSH = 1 << 21
SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)  # fixed values: one for each row of the sketch


def bits_for(items: int, max_bits: int = MAX_BITS) -> int:
    return int(min(max_bits, max(MIN_BITS, np.ceil(np.log2(max(2, items * CELLS_PER_ITEM))))))


def shard_bits(bits: int) -> int:
    return max(0, bits - SHARD_BITS)


def prints(values: np.ndarray, bits: int) -> np.ndarray:
    """Shard (high bits) and the 32 bits that tell values of a shard apart (low bits)."""
    return mix(values, SALTS[0]) >> U(32 - shard_bits(bits))


def cells(own: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell within its shard of each value, from its 32 bits."""
    width = bits - shard_bits(bits)
    return ((own >> U(32 - width)) if row == 0 else mix(own, SALTS[row]) >> U(64 - width)).astype(np.uint32)


def partition_sketches(values: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, cells) of what one task has met."""
    kept: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        met, n = np.unique(prints(np.concatenate(kept), bits), return_counts=True)
        kept.clear()
        met = np.repeat(met, np.minimum(n, 2))
        shard = met >> U(32)
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        low = met.astype(np.uint32)
        blobs = [low[a:b].tobytes() for a, b in zip(cut, [*cut[1:], low.size])]
        return pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "cells"])

    for v in values:
        if v.size:
            kept.append(v)
            if sum(map(len, kept)) >= FLUSH:
                yield flush()
    if kept:
        yield flush()


def _merge(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    met: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for s, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            met.setdefault(s, []).append(np.frombuffer(blob.as_buffer(), np.uint32).copy())
    for s in list(met):
        own = np.sort(np.concatenate(met.pop(s)))
        twice = own[1:][own[1:] == own[:-1]].astype(U)
        for r in range(ROWS):
            have = np.zeros(1 << (bits - shard_bits(bits)), bool)
            have[cells(twice, r, bits)] = True
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([s], pa.int32()), pa.array([np.packbits(have, bitorder="little").tobytes()], pa.binary())], ["row", "shard", "cells"])


def build(texts: DataFrame, values_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> list[np.ndarray]:
    """The merged sketch: for each row a bit for each cell."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from partition_sketches((v for b in batches for v in values_of(b)), bits)

    merged = texts.mapInArrow(lambda b: released(sketch(b)), "shard int, cells binary").repartition("shard").mapInArrow(lambda b: released(_merge(b, bits)), "row int, shard int, cells binary")
    out = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(ROWS)]
    size = min(1 << SHARD_BITS, 1 << bits) // 8
    for row, shard, packed in merged.collect():
        out[row][shard * size : (shard + 1) * size] = np.frombuffer(packed, np.uint8)[:size]
    return out


def repeated(values: np.ndarray, merged: list[np.ndarray], bits: int) -> np.ndarray:
    """True where a value may occur twice."""
    yes, met = np.ones(values.size, bool), prints(values, bits)
    shard, own = (met >> U(32)).astype(np.uint32) << np.uint32(bits - shard_bits(bits)), met & U(0xFFFFFFFF)
    for r, bitmap in enumerate(merged):
        c = shard | cells(own, r, bits)
        yes &= (bitmap[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1 > 0
    return yes
