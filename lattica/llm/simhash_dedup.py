"""Near-duplicate documents by SimHash, found through deletion variants.

A document's fingerprint has bit b set if more than half of its shingles'
hashes (XXH64, seed 42, of SHINGLE words joined by one space, repeats
included) have it.  Fingerprints at RADIUS or fewer differing bits link.

With radius 2 the 64 bits are cut into two segments, so that one of them differs
by at most one bit.  Each different fingerprint is indexed under its two
segments as they are, and under each segment with one bit taken out (66
keys); fingerprints that meet under a key are verified.  Under a bit taken
out only those that differ in it are compared, as the others meet under the
whole segment.  Copies share a fingerprint and are collapsed first.

Keys held by many fingerprints are dealt out as pairs of blocks of at most
BLOCK fingerprints, compared inside Arrow batches; only links that join
something in the block leave it (a spanning forest), so a large group emits
no pairs.  A distributed union-find gives the components.

A null text counts as empty: fingerprint zero, linked like any other.  A null
doc_id is kept as a row and never names a component.  Repeated rows
are separate rows with one id.  Other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, released, words
from .components import connected_components
from .workspace import Workspace

SHINGLE, RADIUS, SEED, BLOCK = 3, 2, 42, 2048
LOWER = bytes(range(256)).lower()
POP16 = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the 64-bit hashes."""
    if not hashes.size:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, hashes.size, 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > hashes.size, bitorder="little").tobytes(), "little")


def batch_fingerprints(batch: pa.RecordBatch, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each row's text."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(batch.num_rows, np.uint64)
    for i, j, data, bounds in blocks(batch):
        start, end, doc = words(data, bounds)
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        raw = data.tobytes().translate(LOWER)
        for r in range(j - i):
            a, b = int(cut[r]), int(cut[r + 1])
            if a == b:
                continue
            s, e = start[a:b], end[a:b]
            if (s[1:] - e[:-1] == 1).all() and b"\n" not in (own := raw[s[0] : e[-1]]) and b"\t" not in own and b"\r" not in own and b"\x0b" not in own and b"\x0c" not in own:
                s, e = s - s[0], e - s[0]
            else:
                own = b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist())])
                size = e - s
                e = np.cumsum(size + 1) - 1
                s = e - size
            k = min(shingle, b - a)
            hs = [digest(own[x:y], SEED) for x, y in zip(s[: b - a - k + 1].tolist(), e[k - 1 :].tolist())]
            out[i + r] = fingerprint(np.array(hs, np.uint64))
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp): 64-bit fingerprints as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch_fingerprints(batch, shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(lambda b: released(run(b)), "doc_id long, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    m = np.uint64(0xFFFF)
    return sum((POP16[(x >> np.uint64(k)) & m].astype(np.int16) for k in (0, 16, 32, 48)), np.int16(0))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links a-b among n nodes join two parts: at most n - 1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return np.array(keep, np.int64)


def _links(fp: np.ndarray, side: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions among rows that come sorted by key; side 0 and 1 are compared across, side 2 with all."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(cut)
    left, right = [], []
    small = size[np.searchsorted(cut, np.arange(fp.size), "right") - 1] <= 16
    for d in range(1, 16):
        at = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        if not at.size:
            break
        ok = ((side[at] == 2) | (side[at] != side[at + d])) & (_distance(fp[at], fp[at + d]) <= radius)
        left.append(at[ok])
        right.append(at[ok] + d)
    for a, n in zip(cut[:-1][size > 16].tolist(), size[size > 16].tolist()):
        own, s = fp[a : a + n], side[a : a + n]
        x_all, y_all = (np.arange(n), np.arange(n)) if s[0] == 2 else (np.flatnonzero(s == 0), np.flatnonzero(s == 1))
        for i in range(0, x_all.size, 256):
            x = x_all[i : i + 256]
            p, q = np.nonzero(_distance(own[x][:, None], own[y_all][None, :]) <= radius)
            p, q = x[p], y_all[q]
            if s[0] == 2:
                p, q = p[p < q], q[p < q]
            keep = _forest(p, q, n)
            left.append(a + p[keep])
            right.append(a + q[keep])
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *left]), np.concatenate([z, *right])


def hamming_links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Different fingerprints fps(fp) -> links (u, v) that join all fingerprints within the radius."""
    if radius != 2:
        raise ValueError("two segments with one wildcard hold for a radius of 2")
    mask = (1 << 32) - 1
    segment = [F.col("fp").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("fp", 32)]
    keys = []
    for s in (0, 1):
        keys.append(F.struct(F.lit(s * 33).cast("byte").alias("kind"), segment[s].alias("rest"), F.lit(2).cast("byte").alias("side")))
        for b in range(32):
            rest = segment[s].bitwiseAND(F.lit(mask ^ (1 << b)))
            side = F.shiftrightunsigned(segment[s], b).bitwiseAND(F.lit(1)).cast("byte")
            keys.append(F.struct(F.lit(s * 33 + 1 + b).cast("byte").alias("kind"), rest.alias("rest"), side.alias("side")))
    # each row becomes 66: dealt out first, or a few tasks of a small table would do it all
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.kind", "k.rest", "k.side")
    met = variants.groupBy("kind", "rest").agg(F.count("*").alias("n"), F.min("side").alias("_lo"), F.max("side").alias("_hi"))
    met = met.where("n > 1 and (_lo = 2 or _lo < _hi)").drop("_lo", "_hi")
    # Spark's estimate leaves out the 66 variants of a fingerprint, so it would broadcast either side too early
    held = variants.hint("merge").join(met, ["kind", "rest"])
    many = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), many).cast("int")
    held = held.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), many - 1)))
    held = held.select("fp", "kind", "rest", "side", "n", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"))
    group = ["kind", "rest", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> pa.RecordBatch:
            c = [np.asarray(table.column(x).combine_chunks()) for x in group]
            new = np.zeros(table.num_rows, bool)
            for x in c:
                new[1:] |= x[1:] != x[:-1]
            fp = np.asarray(table.column("fp").combine_chunks()).view(np.uint64)
            a, b = _links(fp, np.asarray(table.column("side").combine_chunks()), np.cumsum(new), radius)
            pairs = np.unique(np.stack([fp[a].view(np.int64), fp[b].view(np.int64)], 1), axis=0) if a.size else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            table = pa.Table.from_batches(waiting)
            last = {x: table.column(x)[table.num_rows - 1].as_py() for x in group}
            c = np.ones(table.num_rows, bool)
            for x in group:
                c &= np.asarray(table.column(x).combine_chunks()) == last[x]
            cut = table.num_rows - int(c[::-1].argmin() if not c.all() else c.size)
            if cut:
                yield solve(table.slice(0, cut))
            waiting = table.slice(cut).to_batches()
        if waiting:
            yield solve(pa.Table.from_batches(waiting))

    return held.repartition(*group).sortWithinPartitions(*group).select("fp", "side", *group).mapInArrow(lambda b: released(compare(b)), "u long, v long")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp, fingerprint, component_id)."""
    work = Workspace(docs.sparkSession)
    prints = work.store(fingerprints(docs, shingle), "fingerprints")
    each = work.store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "different")
    links = work.store(hamming_links(each.select("fp"), radius), "links")
    roots = connected_components(links, work)
    joined = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    names = joined.join(names, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
