"""Removal of repeated byte strings, by longest-previous-factor arrays.

Each byte covered by a LENGTH-byte string that also starts earlier (smaller
doc_id, or the same document further ahead) goes; matches never cross
documents.

A suffix array over the whole corpus would be one task's work, so the suffixes are
dealt out by the minimizer of their first LENGTH bytes (the least-hashed GRAM
bytes in them): suffixes that share LENGTH bytes share it and meet.  What is
dealt is not each suffix but each minimizer with the bytes around it, its
context, from which all suffixes that begin near it can be read.

1. A sketch of minimizers tells which may occur twice.
2. Of equal contexts, all but the first are covered whole.  A task does this
   for what it holds before the shuffle, so a passage that a third of all documents
   hold is dealt out once for each flush.
3. The different contexts of one minimizer are sorted into suffix order by
   prefix doubling, and each suffix's previous smaller position in that order
   gives its earlier match: within a run of suffixes whose common prefix is
   at least LENGTH, every one but the first by position has one.  A minimizer with more than
   GROUP different contexts is dealt out again, by whole window.

Nulls count as empty texts; a null doc_id sorts first.  Rows that repeat a
doc_id are judged by (doc_id, position) and lose the same bytes.  Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .blocks import BYTE_BASE, U, anchors, blocks, cover, released, rolling, runs
from .rows import identified
from .workspace import Workspace

LENGTH, GRAM, GROUP = 100, 50, 8192
BATCH_CONTEXTS, SOLVED_CONTEXTS, FLUSH = 8192, 2048, 1 << 16
NULL_ID = -(1 << 63)


def longest_previous_factor(order: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The longest match of each suffix with one at a smaller place, for suffixes given in suffix order.

    common[k] is the common prefix of the suffixes order[k - 1] and order[k], and place tells where each suffix
    begins.  The previous and the next suffix with a smaller place are found for all suffixes at once: as long as the one that a
    suffix has come to is not smaller, it goes on to the one that this has come to, with the least
    common prefix on the way.
    """
    n = order.size
    out = np.zeros(n, np.int64)
    for way in (1, -1):
        here = place[order][::way]
        at = np.arange(n) - 1
        least = common.astype(np.int64) if way > 0 else np.r_[0, common[1:][::-1]].astype(np.int64)
        if n:
            least[0] = 0
        todo = np.flatnonzero(least)
        while (todo := todo[here[at[todo]] >= here[todo]]).size:
            least[todo], at[todo] = np.minimum(least[todo], least[at[todo]]), at[at[todo]]
            todo = todo[least[todo] > 0]
        out = np.maximum(out, least[::way])
    back = np.zeros(n, np.int64)
    back[order] = out
    return back


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the `length`-byte prefix of every suffix that has one, by prefix doubling."""
    n = data.size
    if n < length:
        return np.zeros(0, np.int64)
    rank, have = data.astype(U), 1
    while have < length:
        step = min(have, length - have)
        m = n - have - step + 1
        if have <= 4 and step == have:
            rank = (rank[:m] << U(8 * step)) | rank[step : step + m]
        else:
            rank = np.unique(rank, return_inverse=True)[1].astype(U)
            rank = rank[:m] * (rank.max() + U(1)) + rank[step : step + m]
        have += step
    rank = np.unique(rank, return_inverse=True)[1]
    return rank


def _contexts(data, bounds, length, gram):
    """Anchors of a block with the extent of their contexts."""
    n = data.size - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, z, z
    valid = np.ones(n, bool)
    for b in bounds[1:-1].tolist():
        valid[max(0, b - length + 1) : b] = False
    if bounds.size == 1 or not valid.any():
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, z, z
    grams = rolling(data.astype(U) + U(1), gram, BYTE_BASE)
    at = anchors(grams, length - gram + 1, valid)[1]
    row = np.searchsorted(bounds, at, "right") - 1
    low = np.maximum(bounds[row], at - (length - gram))
    high = np.minimum(bounds[row + 1], at + length)
    return grams[at], at, row, low, high


def _later_suffixes(blob: np.ndarray, bound: np.ndarray, group: np.ndarray, doc: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
    """Which positions of the joined contexts begin a suffix whose longest previous factor within its group reaches `length`.

    Context i begins at bound[i] of the blob and at pos[i] of its document; doc numbers
    the documents in their order.
    """
    rank = prefix_ranks(blob, length)
    own = np.searchsorted(bound, np.arange(rank.size), "right") - 1
    at = np.flatnonzero(np.arange(rank.size) + length <= bound[own + 1])
    own, rank = own[at], rank[at]
    start = pos[own] + at - bound[own]
    place = np.empty(at.size, np.int64)  # equal places, seen in two contexts, stay equal
    by_place = np.lexsort((start, doc[own]))
    d, s = doc[own][by_place], start[by_place]
    place[by_place] = np.cumsum(np.r_[False, (d[1:] != d[:-1]) | (s[1:] != s[:-1])][: at.size])
    order = np.lexsort((rank, group[own]))  # suffix order within each minimizer
    g, r = group[own][order], rank[order]
    common = np.where(np.r_[False, (g[1:] == g[:-1]) & (r[1:] == r[:-1])][: at.size], length, 0)  # what is shorter does not count
    out = np.zeros(blob.size, bool)
    out[at[longest_previous_factor(order, common, place) >= length]] = True
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, max_bits: int = sketch.MAX_BITS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, n_removed, removed array<struct<from,to>>, kept binary)."""
    spark = docs.sparkSession
    work = Workspace(spark)
    texts = identified(docs)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = sketch.bits_for(size * 2 // (length - gram + 2), max_bits)

    def values_of(batch):
        for _, _, data, bounds in blocks(batch):
            values = _contexts(data, bounds, length, gram)[0]
            if values.size:
                yield values

    merged = spark.sparkContext.broadcast(sketch.build(texts, values_of, bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts that may occur twice.  Of equal ones in a flush only the earliest goes on as such; the later ones'
        covered stretches are rows without a context."""
        held: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}
        copies: list[tuple[int, int, int, int]] = []

        def flush(whole: bool = True) -> pa.RecordBatch:
            """All that is held, or the copies alone."""
            keys, places = list(held) if whole else [], [*(held.values() if whole else ()), *(c[:3] for c in copies)]
            n = len(copies)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([*(k[0] for k in keys), *[None] * n], pa.int64()),
                    pa.array([*(k[1] for k in keys), *(b - a for _, _, a, b in copies)], pa.int32()),
                    pa.array([*(k[2] for k in keys), *[None] * n], pa.binary()),
                    pa.array([None if d == NULL_ID else d for d, _, _ in places], pa.int64()),
                    pa.array([t for _, t, _ in places], pa.int64()),
                    pa.array([p for _, _, p in places], pa.int32()),
                ],
                ["h", "before", "context", "doc_id", "t", "pos"],
            )
            if whole:
                held.clear()
            copies.clear()
            return out

        for batch in batches:
            ids = list(zip(batch.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_pylist(), batch.column("h").to_pylist()))
            for i, _, data, bounds in blocks(batch):
                values, at, row, low, high = _contexts(data, bounds, length, gram)
                if not values.size:
                    continue
                keep = np.flatnonzero(sketch.repeated(values, merged.value, bits))
                raw = data.tobytes()
                for h, q, r, x, y in zip(values[keep].view(np.int64).tolist(), at[keep].tolist(), row[keep].tolist(), low[keep].tolist(), high[keep].tolist()):
                    key, place = (h, q - x, raw[x:y]), (*ids[i + r], x - int(bounds[r]))
                    have = held.setdefault(key, place)
                    if have != place:
                        if place < have:
                            held[key], place = place, have
                        copies.append((*place, place[2] + y - x))
                if len(held) >= FLUSH or len(copies) >= FLUSH:
                    yield flush(len(held) >= FLUSH)
        if held or copies:
            yield flush()

    met = texts.mapInArrow(lambda b: released(candidates(b)), "h long, before int, context binary, doc_id long, t long, pos int")
    key = ["h", F.when(F.col("h").isNull(), F.xxhash64("doc_id", "t", "pos"))]
    dealt = met.repartition(*key).sortWithinPartitions("h", "before", "context", F.col("doc_id").asc_nulls_first(), "t", "pos")

    def lpf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by minimizer; a minimizer's contexts are handled together, with others' up to a batch.

        A minimizer with more than `group` rows is handed on, context by context, as it comes.
        """
        waiting: list[pa.Table] = []
        hot = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            plain = table.filter(pa.compute.is_null(table.column("h")))
            if plain.num_rows:
                pos = np.asarray(plain.column("pos").combine_chunks())
                yield result(plain.column("doc_id").combine_chunks(), plain.column("t").combine_chunks(), pos, pos + np.asarray(plain.column("before").combine_chunks()))
                table = table.filter(pa.compute.is_valid(table.column("h")))
            if hot is not None:
                own = pa.compute.equal(table.column("h"), hot)
                yield from defer(table.filter(own))
                table = table.filter(pa.compute.invert(own))
            if not table.num_rows:
                continue
            waiting.append(table)
            if sum(t.num_rows for t in waiting) < BATCH_CONTEXTS:
                continue
            table = pa.concat_tables(waiting).combine_chunks()
            h = np.asarray(table.column("h").combine_chunks())
            cut = int(np.searchsorted(h, h[-1], "left"))  # the last group may go on
            if cut:
                yield from parts(table.slice(0, cut))
            waiting = [table.slice(cut)]
            if h.size - cut > group:
                hot = int(h[-1])
                yield from defer(waiting.pop())
        if waiting:
            table = pa.concat_tables(waiting).combine_chunks()
            if table.num_rows:
                yield from parts(table)

    def result(ids, texts, a, b, contexts=None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([ids, texts, pa.array(a, pa.int32()), pa.array(b, pa.int32()), contexts if contexts is not None else pa.nulls(n, pa.binary())], ["doc_id", "t", "a", "b", "context"])

    def defer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for t in table.to_batches():
            if t.num_rows:
                pos = np.asarray(t.column("pos"))
                yield result(t.column("doc_id"), t.column("t"), pos, pos, t.column("context"))

    def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole minimizers together, up to SOLVED_CONTEXTS or one of more: a worker's memory follows these."""
        h = np.asarray(table.column("h").combine_chunks())
        ends = np.flatnonzero(np.r_[h[1:] != h[:-1], True]) + 1
        a = 0
        while a < h.size:
            b = int(ends[max(np.searchsorted(ends, a + SOLVED_CONTEXTS, "right") - 1, np.searchsorted(ends, a, "right"))])
            yield from solve(table.slice(a, b - a))
            a = b

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h = np.asarray(table.column("h").combine_chunks())
        before = np.asarray(table.column("before").combine_chunks())
        contexts = table.column("context").to_pylist()
        size = np.array([len(c) for c in contexts])
        pos = np.asarray(table.column("pos").combine_chunks()).astype(np.int64)
        ids = table.column("doc_id").combine_chunks()
        text = table.column("t").combine_chunks()
        raw, own_text = np.asarray(ids.fill_null(NULL_ID)), np.asarray(text)
        # equal contexts come in order of place: all but those at the first place are covered whole
        equal = np.array([False, *(contexts[k] == contexts[k - 1] for k in range(1, len(contexts)))]) & np.r_[False, (h[1:] == h[:-1]) & (before[1:] == before[:-1])]
        first = np.maximum.accumulate(np.where(equal, 0, np.arange(h.size)))
        later = np.flatnonzero(equal & ((raw != raw[first]) | (own_text != own_text[first]) | (pos != pos[first])) & (size >= length))
        if later.size:
            yield result(ids.take(pa.array(later)), text.take(pa.array(later)), pos[later], pos[later] + size[later])
        own = np.flatnonzero(~equal)
        cut = np.r_[True, h[own][1:] != h[own][:-1]]
        own = own[np.bincount(np.cumsum(cut) - 1)[np.cumsum(cut) - 1] > 1]  # minimizers with several contexts
        if not own.size:
            return
        bound = np.r_[0, np.cumsum(size[own])]
        blob = np.frombuffer(b"".join([contexts[k] for k in own.tolist()]), np.uint8)
        doc = np.unique(np.stack([raw[own], own_text[own]]), axis=1, return_inverse=True)[1].reshape(-1) if own_text.any() else np.unique(raw[own], return_inverse=True)[1]
        start, end = runs(_later_suffixes(blob, bound, h[own], doc, pos[own], length))
        if start.size:
            # no run goes on from one context into the next: a context's last bytes begin no suffix
            k = np.searchsorted(bound, start, "right") - 1
            a = pos[own][k] + start - bound[k]
            yield result(ids.take(pa.array(own[k])), text.take(pa.array(own[k])), a, a + (end - start) + length - 1)

    near = work.store(dealt.mapInArrow(lambda b: released(lpf(b)), "doc_id long, t long, a int, b int, context binary"), "near")
    merged.destroy()
    del met, dealt
    one = (
        near.where("context IS NOT NULL")
        .select("doc_id", "t", F.col("a").alias("pos"), "context")
        .where(F.length("context") >= length)
        .select("doc_id", "t", "pos", "context", F.explode(F.sequence(F.lit(0), F.length("context") - length)).alias("i"))
        .select("doc_id", "t", (F.col("pos") + F.col("i")).alias("a"), F.md5(F.expr(f"substring(context, i + 1, {length})")).alias("w"))
    )
    place = F.struct("doc_id", "t", "a")
    least = one.groupBy("w").agg(F.min(place).alias("m"))
    hot = one.join(least, "w").where(~place.eqNullSafe(F.col("m"))).select("doc_id", "t", "a", (F.col("a") + length).alias("b"))
    intervals = near.where("context IS NULL").select("doc_id", "t", "a", "b").unionByName(hot)
    found = work.store(intervals.groupBy("doc_id", "t").agg(F.collect_set(F.struct("a", "b")).alias("at")), "found")
    work.drop("near")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in blocks(batch):
                out = []
                for r in range(j - i):
                    own = data[bounds[r] : bounds[r + 1]]
                    at = batch.column("at")[i + r]
                    gone = np.zeros(own.size, bool)
                    if at.is_valid:
                        v = at.values
                        gone = cover(own.size, np.asarray(v.field("a")), np.asarray(v.field("b")))
                    s, e = runs(gone)
                    out.append((own.size, int(gone.sum()), [{"from": int(x), "to": int(y)} for x, y in zip(s, e)], own[~gone].tobytes()))
                a, b, c, d = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j].cast(pa.int64()),
                        pa.array(a, pa.int64()),
                        pa.array(b, pa.int64()),
                        pa.array(c, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                        pa.array(d, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "removed", "kept"],
                )

    other = found.withColumnRenamed("doc_id", "d")
    return (
        texts.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")), "left")
        .select("doc_id", "text", "at")
        .mapInArrow(lambda b: released(strip(b)), "doc_id long, n_bytes long, n_removed long, removed array<struct<from:long,to:long>>, kept binary")
    )
