"""Removal of repeated word windows, with a count-min prefilter.

A window is WINDOW consecutive words of one document; each word covered by a
window whose word sequence also starts earlier (smaller doc_id, or the same
document further ahead) goes.

1. Every window is represented by its minimizer, the least-hashed run of GRAM
   words in it: equal windows have equal minimizers, and neighbouring windows
   share theirs.  Partition sketches of the minimizers are merged into a
   sketch of those that occur twice, which never leaves one out.
2. Windows estimated repeated are grouped by 128 bits: two hashes of the word
   sequence, each over word hashes of its own.  A task first keeps only the earliest of the equal
   windows that it has, so a passage that a third of all documents hold
   reaches the shuffle once for each task's flush.
3. Positions of windows that are not the earliest return to their documents.

Nulls count as empty texts.  A null doc_id sorts before all others.  Rows that
repeat a doc_id with another text are documents of their own, in order of the text's XXH64;
rows that repeat both are copies of one document and lose the same
words.  Columns besides doc_id and text are ignored.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .blocks import WORD_BASE, anchors, blocks, cover, prefix, released, rolling, spans, word_hashes, words
from .rows import identified
from .workspace import Workspace

WINDOW, GRAM = 20, 8
SECOND_BASE = 0xA24BAED4963EE407  # fixed value: base of the second window hash
FLUSH_WINDOWS = 1 << 19


def _windows(data, bounds, window, gram):
    """Word spans and documents, gram hashes and valid window starts of a block."""
    start, end, doc = words(data, bounds)
    hashes = word_hashes(data, start, end)
    n = max(0, start.size - window + 1)
    valid = doc[:n] == doc[window - 1 :] if n else np.zeros(0, bool)
    return (start, end), doc, hashes, rolling(hashes, gram, WORD_BASE), valid


def _earliest(h1, h2, *place):
    """Order by hashes and place (doc, h, pos); True where an equal window stands at an earlier place."""
    order = np.lexsort((*place[::-1], h2, h1))
    a, b = h1[order], h2[order]
    head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: order.size]
    first = np.maximum.accumulate(np.where(head, np.arange(order.size), 0))
    again = np.zeros(order.size, bool)
    for x in place:
        again |= x[order] != x[order][first]
    return order, again


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, max_bits: int = sketch.MAX_BITS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_removed, kept): kept words joined by one space."""
    spark = docs.sparkSession
    work = Workspace(spark)
    texts = identified(docs)
    width = window - gram + 1
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = sketch.bits_for(size // 6 * 2 // (width + 1), max_bits)

    def values_of(batch):
        for _, _, data, bounds in blocks(batch):
            _, _, _, grams, valid = _windows(data, bounds, window, gram)
            if valid.any():
                yield grams[anchors(grams, width, valid)[1]]

    merged = spark.sparkContext.broadcast(sketch.build(texts, values_of, bits))

    def flush(kept):
        h1, h2, doc, null, h, pos = (np.concatenate(x) for x in zip(*kept))
        kept.clear()
        rank = np.where(null, np.iinfo(np.int64).min, doc)
        order, again = _earliest(h1, h2, rank, h, pos)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(h1[order].view(np.int64), mask=again),
                pa.array(h2[order].view(np.int64), mask=again),
                pa.array(doc[order], pa.int64(), mask=null[order]),
                pa.array(h[order]),
                pa.array(pos[order].astype(np.int32)),
            ],
            ["h1", "h2", "doc_id", "h", "pos"],
        )

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting = [], 0
        for batch in batches:
            ids = batch.column("doc_id")
            null = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0), dtype=np.int64)
            own = np.asarray(batch.column("h"))
            for i, _, data, bounds in blocks(batch):
                (start, end), doc, hashes, grams, valid = _windows(data, bounds, window, gram)
                if not valid.any():
                    continue
                least, _ = anchors(grams, width, valid)
                at = np.flatnonzero(valid)[sketch.repeated(grams[least], merged.value, bits)]
                if not at.size:
                    continue
                first = np.searchsorted(doc, doc[at], "left")
                second = word_hashes(data, start, end, SECOND_BASE)
                two = [spans(prefix(x, b), at, at + window, b) for x, b in ((hashes, WORD_BASE), (second, SECOND_BASE))]
                row = i + doc[at]
                kept.append((*two, ids[row], null[row], own[row], at - first))
                waiting += at.size
                if waiting >= FLUSH_WINDOWS:
                    yield flush(kept)
                    waiting = 0
        if kept:
            yield flush(kept)

    met = texts.mapInArrow(lambda b: released(candidates(b)), "h1 long, h2 long, doc_id long, h long, pos int")
    # rows without a hash were already second in their own flush
    alone = F.when(F.col("h1").isNull(), F.xxhash64("doc_id", "h", "pos"))
    later = met.withColumn("nth", F.rank().over(Window.partitionBy("h1", "h2", alone).orderBy(F.col("doc_id").asc_nulls_first(), "h", "pos"))).where("nth > 1 or h1 is null")
    found = work.store(later.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("at")), "found")
    del met, later

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in blocks(batch):
                start, end, doc = words(data, bounds)
                total = np.bincount(doc, minlength=j - i)
                raw = data.tobytes()
                kept, removed, k = [], [], 0
                for r in range(j - i):
                    n = int(total[r])
                    at = batch.column("at")[i + r].as_py()
                    gone = np.zeros(n, bool)
                    if at:
                        at = np.array(at)
                        gone = cover(n, at, at + window)
                    left = np.flatnonzero(~gone) + k
                    kept.append(b" ".join([raw[a:b] for a, b in zip(start[left].tolist(), end[left].tolist())]))
                    removed.append(int(gone.sum()))
                    k += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j].cast(pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    other = found.withColumnsRenamed({"doc_id": "d", "h": "t"})
    return (
        texts.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")), "left")
        .select("doc_id", "text", "at")
        .mapInArrow(lambda b: released(strip(b)), "doc_id long, n_words long, n_removed long, kept string")
    )
