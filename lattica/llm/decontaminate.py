"""Documents that hold benchmark passages.

Text is lower-cased (ASCII) and cut into words at white space and ASCII
punctuation; shingles are SHINGLE words.  For each benchmark item, the windows
of a document that are as long as the item are given SimHash fingerprints.
A multi-index over 8 blocks of 8 bits (each block's values within RADIUS/8
bits lead to the items) returns every item within RADIUS bits; for
these the weighted similarity of the two shingle multisets (sum of lesser counts over
sum of greater counts) is computed exactly and must reach THRESHOLD.  A document shorter than the
item is one window, compared as a whole.

Only windows that can reach the threshold are fingerprinted: a similarity of
t between two multisets of m shingles needs 2tm/(1+t) in common, which is
checked first by a running count of the shingles that any item has.

Items shorter than SHINGLE words are one shingle of all their words.  Null or
wordless items match nothing; null texts hold nothing, and a row with a null or repeated doc_id is judged like any other.  Items are taken in
slices of SLICE items or SLICE_BYTES bytes, SLICES_IN_A_SCAN slices to a scan, so what is broadcast has a bound.  Other columns are
ignored, or pass through decontaminate(); repeated rows give repeated results; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ASCII_SPACE, U, WORD_BASE, blocks, released, rolling, runs, text_bytes, word_hashes, words

SHINGLE, THRESHOLD, RADIUS, SLICE, SLICE_BYTES, SLICES_IN_A_SCAN = 5, 0.8, 20, 4096, 4 << 20, 8
GAP = ASCII_SPACE.copy()
GAP[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(*shingles.shape, 8), axis=-1, bitorder="little")
    ones = bits.reshape(*shingles.shape, 64).sum(axis=1, dtype=np.int32)
    return np.packbits(ones * 2 > shingles.shape[1], axis=1, bitorder="little").view("<u8").reshape(-1).astype(U)


class Index:
    """A slice of items: their shingles by length, and the multi-index over their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, radius: int):
        self.radius = radius
        self.by_length: dict[tuple[int, int], list[tuple[int, int, Counter]]] = {}
        by_width: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            data, bounds = text_bytes(pa.array([text], pa.string()))
            data = FOLD[data]
            start, end, _ = words(data, bounds, GAP)
            if not start.size:
                continue
            k = min(shingle, start.size)
            grams = rolling(word_hashes(data, start, end), k, WORD_BASE)
            by_width.setdefault(k, []).append(grams)
            self.by_length.setdefault((k, start.size), []).append((item, int(simhash(grams[None, :])[0]), Counter(grams.tolist())))
        self.known = {k: np.unique(np.concatenate(v)) for k, v in by_width.items()}
        self.first = {k: np.bincount((v >> U(44)).astype(np.int64), minlength=1 << 20) > 0 for k, v in self.known.items()}
        near = [v for v in range(256) if bin(v).count("1") <= radius // 8]
        self.tables = {}
        for key, own in self.by_length.items():
            table: list[dict[int, list[int]]] = [{} for _ in range(8)]
            for n, (_, fp, _) in enumerate(own):
                for b in range(8):
                    for v in near:
                        table[b].setdefault(((fp >> (8 * b)) & 255) ^ v, []).append(n)
            self.tables[key] = table

    def hits(self, k: int, grams: np.ndarray) -> np.ndarray:
        out = self.first[k][(grams >> U(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        known = self.known[k]
        out[at] = known[np.minimum(np.searchsorted(known, grams[at]), known.size - 1)] == grams[at]
        return out

    def near(self, key: tuple[int, int], fp: int) -> list[tuple[int, int, Counter, int]]:
        """Items of this length within the radius: some block is then within radius/8 bits."""
        own, table = self.by_length[key], self.tables[key]
        met = {n for b in range(8) for n in table[b].get((fp >> (8 * b)) & 255, ())}
        return [(*own[n], d) for n in sorted(met) if (d := (own[n][1] ^ fp).bit_count()) <= self.radius]


def _search(index: Index, data: np.ndarray, bounds: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float, int]]:
    """(row, item, first word, words, similarity, differing bits) of the best window for each row and item."""
    data = FOLD[data]
    start, end, doc = words(data, bounds, GAP)
    if not start.size:
        return []
    hashes = word_hashes(data, start, end)
    cut = np.searchsorted(doc, np.arange(bounds.size))
    sizes = np.diff(cut)
    best: dict[tuple[int, int], tuple] = {}
    for k in index.known:
        grams = rolling(hashes, k, WORD_BASE)
        if not grams.size:
            continue
        hit = index.hits(k, grams)
        if not hit.any():
            continue
        total = np.r_[0, np.cumsum(hit)]
        for key in index.by_length:
            if key[0] != k:
                continue
            length = key[1]
            m = length - k + 1
            # documents shorter than the item, as a whole
            short = np.flatnonzero((sizes >= k) & (sizes < length))
            own = sizes[short] - k + 1
            reach = total[cut[short] + own] - total[cut[short]] >= np.ceil(threshold * (m + own) / (1 + threshold) - 1e-9)
            for r, n_own in zip(short[reach].tolist(), own[reach].tolist()):
                row = grams[cut[r] : cut[r] + n_own]
                mine = Counter(row.tolist())
                for item, _, weights, bits in index.near(key, int(simhash(row[None, :])[0])):
                    same = (mine & weights).total()
                    similarity = same / (m + n_own - same)
                    if similarity >= threshold:
                        best[r, item] = (-similarity, 0, n_own + k - 1, bits)
            if start.size < length:
                continue
            need = int(np.ceil(2 * threshold * m / (1 + threshold) - 1e-9))
            n = start.size - length + 1
            at = np.flatnonzero((total[m : m + n] - total[:n] >= need) & (doc[:n] == doc[length - 1 :]))
            for i in range(0, at.size, 1024):
                part = at[i : i + 1024]
                rows = grams[part[:, None] + np.arange(m)]
                for s, fp, shingles in zip(part.tolist(), simhash(rows).tolist(), rows):
                    for item, _, weights, bits in index.near(key, fp):
                        mine = Counter(shingles.tolist())
                        same = (mine & weights).total()
                        similarity = same / (2 * m - same)
                        if similarity >= threshold:
                            first = int(np.searchsorted(doc, doc[s], "left"))
                            found = (-similarity, s - first, length, bits)
                            have = best.get((int(doc[s]), item))
                            if have is None or found < have:
                                best[int(doc[s]), item] = found
    return [(r, item, s, n, -q, bits) for (r, item), (q, s, n, bits) in best.items()]


def _indexes(docs: DataFrame, benchmark: DataFrame, shingle: int, radius: int, slice_size: int) -> list[list[Broadcast]]:
    """The benchmark's slices, a few to each scan of the documents.

    A slice has about slice_size items and SLICE_BYTES bytes at most, by a hash of the item; both are counted before anything is collected.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-count // slice_size), -(-size // SLICE_BYTES))
    out: list[list[Broadcast]] = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        if k % SLICES_IN_A_SCAN == 0:
            out.append([])
        out[-1].append(spark.sparkContext.broadcast(Index([tuple(r) for r in part.collect()], shingle, radius)))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS, slice_size: int = SLICE) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, bits): for each document and item its best window."""
    schema = "doc_id long, item_id long, start_word int, n_words int, similarity double, bits int"
    names = [x.split()[0] for x in schema.split(", ")]
    texts, found = docs.select("doc_id", "text"), []
    for indexes in _indexes(docs, benchmark, shingle, radius, slice_size):

        def search(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").cast(pa.int64())
                for i, _, data, bounds in blocks(batch):
                    out = [x for index in indexes for x in _search(index.value, data, bounds, threshold)]
                    if out:
                        row, item, s, n, q, b = zip(*out)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(np.array(row) + i)), pa.array(item, pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32()), pa.array(q, pa.float64()), pa.array(b, pa.int32())], names
                        )

        found.append(texts.mapInArrow(lambda b, search=search: released(search(b)), schema))
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS, slice_size: int = SLICE) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark passage; each row is judged by its own text, in one scan."""
    schema = docs.schema
    for indexes in _indexes(docs, benchmark, shingle, radius, slice_size):

        def clean(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, _, data, bounds in blocks(batch):
                    for index in indexes:
                        keep[[i + x[0] for x in _search(index.value, data, bounds, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lambda b, clean=clean: released(clean(b)), schema)
    return docs
