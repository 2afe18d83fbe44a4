"""Near-duplicate documents by SimHash and MinHash, verified by the exact similarity of their word shingles.

Documents are sets of shingles of SHINGLE words (ASCII lower case; fewer words are one
shingle).  Equal sets are one class.  Two kinds of classes are
candidates, and link if the Jaccard similarity of their whole sets is THRESHOLD or more:

1. SimHash: those whose fingerprints, as simhash_dedup makes them (three-word shingles, repeats included), differ in at most two bits, found through its
   deletion variants.  (Of a large group these are the links that join it.)
2. What lies further apart: those that agree on all minima of a MinHash band.  At 0.8 fingerprints differ in 9.7 bits on average (deviation 2.9), so a radius
   that finds 99 % of the pairs is 16, whose nine segments of seven bits would compare nearly every pair.

Fingerprints alone do not link: they count repeats, so that texts which repeat a few shingles have near ones however different their sets are.

Null texts are empty, and wordless documents are one class.  A null doc_id names a component only
where all its documents have none.  Rows that repeat a doc_id with another text are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U, WORD_BASE, blocks, mix, prefix, released, spans, word_hashes, words
from .line_dedup import MINIMA, alike, band_hashes, candidate_pairs, joined_classes, parities, plausible, with_values
from .simhash_dedup import batch_fingerprints, hamming_links
from .workspace import Workspace

SHINGLE, THRESHOLD = 5, 0.8
FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's different shingles, and where each row begins (one more at the end)."""
    n = bounds.size - 1
    data = FOLD[data]
    start, end, doc = words(data, bounds)
    if not start.size:
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    cut = np.searchsorted(doc, np.arange(n + 1))
    first = np.arange(start.size)
    last = np.minimum(first + shingle, cut[doc + 1])
    own = (last - first == shingle) | (first == cut[doc])
    grams, row = spans(prefix(word_hashes(data, start, end), WORD_BASE), first[own], last[own], WORD_BASE), doc[own]
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    fresh = np.r_[True, (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])]
    return grams[fresh], np.searchsorted(row[fresh], np.arange(n + 1))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """docs(doc_id, h, text) -> (doc_id, h, fp, key, m0, .., some, grams): the SimHash, the set's MD5, its minima, whether it has any, and the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch_fingerprints(batch).view(np.int64)
            for i, j, data, bounds in blocks(batch):
                grams, at = shingle_sets(data, bounds, shingle)
                some = at[1:] > at[:-1]
                minima = np.zeros((len(MINIMA), j - i), np.int32)
                for k in range(len(MINIMA) if grams.size else 0):
                    least = np.minimum.reduceat(mix(grams, (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)), at[:-1][some])
                    minima[k, some] = (least >> U(33)).astype(np.int32)
                sets = [grams[at[r] : at[r + 1]] for r in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j].cast(pa.int64()), batch.column("h")[i:j], pa.array(prints[i:j]), pa.array([hashlib.md5(x.tobytes()).digest() for x in sets], pa.binary()),
                        *map(pa.array, minima), pa.array(some), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                    ],
                    names,
                )

    schema = ", ".join(["doc_id long", "h long", "fp long", "key binary", *[f"{m} int" for m in MINIMA], "some boolean", "grams array<long>"])
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "h", "text").mapInArrow(lambda b: released(run(b)), schema)


def simhash_pairs(prints: DataFrame, work: Workspace) -> DataFrame:
    """prints(key, fp, ...) -> (u, v): keys whose fingerprints differ in at most two bits, each fingerprint standing for its least key."""
    own = work.store(prints.groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    near = work.store(hamming_links(own.select("fp")), "near")
    near = near.join(own.select(F.col("fp").alias("u"), F.col("least").alias("x")), "u").join(own.select(F.col("fp").alias("v"), F.col("least").alias("y")), "v")
    equal = prints.select("key", "fp").distinct().join(own, "fp").select(F.col("key").alias("u"), F.col("least").alias("v"))
    both = near.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(equal).where("u <> v")
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, h, component_id, component_h) for each row: the row's document, known by its id and its
    text's XXH64, and the first document of its group of near copies."""
    work = Workspace(docs.sparkSession)
    prints = work.store(sketches(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), shingle), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    same = prints.groupBy("key").agg(F.min(place).alias("at"), *[F.min(m).alias(m) for m in MINIMA], F.max("some").alias("some"))
    same = work.store(same, "different")
    pairs, large = candidate_pairs(same.where("some").withColumn("bands", band_hashes()), work)
    pairs = work.store(pairs.unionByName(simhash_pairs(prints, work)).distinct(), "both")
    # the set of one occurrence of each class
    where = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct().join(same.select("key", F.col("at.h").alias("h")), "key")
    values = prints.select("key", "h", F.col("grams").alias("value")).join(where, ["key", "h"]).select("key", "value").dropDuplicates(["key"])
    values = work.store(values, "values")
    traits = work.store(parities(values), "traits")

    def verify(pairs: DataFrame) -> DataFrame:
        return alike(with_values(plausible(pairs, traits, threshold), values), F.col("a"), F.col("b"), threshold)

    links = work.store(verify(pairs), "links")
    work.drop("pairs", "both", "fingerprints", "near")
    roots = joined_classes(links, large, traits, verify, work, threshold).withColumnRenamed("node", "key")
    work.drop("values", "traits", "large")
    joined = same.select("key", "at").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = joined.groupBy("root").agg(F.min("at").alias("first"))
    names = joined.join(names, "root").select("key", "first")
    return prints.select("doc_id", "h", "key").join(names, "key").select("doc_id", "h", F.col("first.doc_id").alias("component_id"), F.col("first.h").alias("component_h"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one of least doc_id (null last), then least hash of the
    text; of rows that repeat both, one."""
    work = Workspace(docs.sparkSession)
    first = near_dedup(docs, shingle, threshold).where("doc_id <=> component_id AND h = component_h")
    first = work.store(first.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("t")).agg(F.count("*").alias("n")), "first")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), F.xxhash64("text").alias("h"))
    rows = rows.join(first, rows["r"]["doc_id"].eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")))
    repeated = rows.where("n > 1").dropDuplicates(["d", "t"])
    return rows.where("n = 1").unionByName(repeated).select("r.*")
