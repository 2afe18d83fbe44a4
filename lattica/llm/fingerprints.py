"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Each five-word shingle is hashed once; its hash's high bits name one of BINS
bins and each bin keeps its least hash.  An empty bin takes the value of a
bin that has one: the first of TRIES hashed choices that is not empty, else
the one of least hash for this bin (optimal densification: the choice depends on the
empty bin and on which bins are filled, so equal sets densify alike and
different bins choose independently).  Of each bin the low BITS bits are
stored, packed as hexadecimal digits.  The likeness of two fingerprints is the
share of equal bins, corrected for the 2**-BITS of chance agreements.

Words are separated by ASCII white space; a text of fewer words than a shingle has one
shingle of all of them (for no words, of the empty string).  A null text counts as empty.  In
edited_pairs(), the document after the last is the first, a lone document follows
itself, and rows that repeat a doc_id follow each other in order of text; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, SHINGLE, TRIES = 128, 8, 5, 8
SPACE = " \t\n\x0b\x0c\r"
SHIFT = 57  # 64 bits less the 7 that name a bin


def one_permutation_minima(words: str, shingle: int = SHINGLE) -> Column:
    """Ascending least hashes of the filled bins, for an array column of words."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(shingle))
    hashes = F.expr(f"IF(size({words}) < {shingle}, array(xxhash64(concat_ws(' ', {words}))), transform(sequence(0, size({words}) - {shingle}), i -> xxhash64({parts})))")
    return F.sort_array(hashes)


def densified(minima: str) -> Column:
    """An array of BINS values in place of the minima of the filled bins."""
    bins = f"transform({minima}, x -> cast(shiftright(x, {SHIFT}) as int) + {BINS // 2})"
    donors = "array(" + ", ".join(f"pmod(xxhash64(j, {t}L), {BINS})" for t in range(1, TRIES + 1)) + ")"
    # position in `minima` of each bin, or 0
    return F.expr(
        f"transform(transform(array({bins}), b -> transform(sequence(0, {BINS - 1}), j -> array_position(b, j))), "
        f"p -> transform(p, (k, j) -> IF(k > 0, {minima}[int(k) - 1], {minima}[int(coalesce("
        f"try_element_at(filter(transform({donors}, d -> p[int(d)]), v -> v > 0), 1), "
        f"array_min(transform(filter(sequence(0, {BINS - 1}), d -> p[d] > 0), d -> struct(xxhash64(d, j) as h, p[d] as k))).k)) - 1])))[0]"
    )


def sketched(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with `name`, the array of BINS low-order values of the text column."""
    clean = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE))
    rows = rows.withColumn("_w", F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"[\x20\x09-\x0D]+")))
    rows = rows.withColumn("_h", one_permutation_minima("_w"))
    rows = rows.withColumn("_h", F.expr(f"filter(_h, (x, i) -> i = 0 OR shiftright(x, {SHIFT}) <> shiftright(_h[greatest(i - 1, 0)], {SHIFT}))"))
    rows = rows.withColumn(name, F.transform(densified("_h"), lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))
    return rows.drop("_w", "_h")


def packed(name: str) -> Column:
    return F.array_join(F.transform(name, lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Estimated resemblance, 0 to 1, corrected for chance agreement of BITS-bit values."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - chance) / (1 - chance)))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fingerprint)."""
    return sketched(docs.select("doc_id", "text"), "text", "_s").select("doc_id", packed("_s").alias("fingerprint"))


def edited_pairs(docs: DataFrame, per_bucket: int = 256, max_buckets: int = 16384) -> DataFrame:
    """Each document with its edited text and their fingerprints.

    -> (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next).  The edit replaces the
    last half of the characters by the beginning of the next document.  Documents are dealt into buckets of
    consecutive ids between quantiles; each bucket is also given the first rows of the next one, so every document
    meets its follower in its own bucket and no window spans the table.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count, known, low = rows.agg(F.count("*"), F.count("doc_id"), F.min("doc_id")).first()
    buckets = max(1, min(max_buckets, count // per_bucket))
    cuts: list[int] = []
    if buckets > 1 and low is not None:
        cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0]
        cuts = sorted({c for c in cuts if c > low})
    starts = F.lit(cuts).cast("array<long>") if cuts else F.array().cast("array<long>")
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    # binary search for how many starts are at or below the id
    place = F.aggregate(
        F.lit(steps).cast("array<int>"),
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(starts, at + step - 1) <= F.col("doc_id"), F.lit(False)), at + step).otherwise(at),
    )
    own = F.struct(F.col("_at").alias("b"), F.lit(0).alias("g"))
    before = F.struct(F.pmod(F.col("_at") - 1, F.lit(len(cuts) + 1)).alias("b"), F.lit(1).alias("g"))
    opens = F.coalesce(F.array_contains(starts, F.col("doc_id")), F.lit(False)) | (F.col("doc_id").isNull() if known < count else F.col("doc_id").eqNullSafe(F.lit(low)))
    rows = rows.withColumn("_at", place).withColumn("_p", F.explode(F.when(opens, F.array(own, before)).otherwise(F.array(own)))).select("doc_id", "text", "_p.b", "_p.g")
    line = Window.partitionBy("b").orderBy("g", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("_next", F.lead("text").over(line))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substring("text", 1, F.col("n_chars").cast("int") - half), F.substring(F.coalesce("_next", F.lit("")), 1, half))
    rows = rows.withColumn("edited", F.when(F.col("g") == 0, edited)).drop("_next")
    rows = sketched(sketched(rows, "text", "_s"), "edited", "_e")
    rows = rows.withColumn("_n", F.lead("_s").over(line)).where("g = 0")
    return rows.select(
        "doc_id", "n_chars", "edited", packed("_s").alias("fingerprint"), packed("_e").alias("edited_fingerprint"), likeness("_s", "_e").alias("near_edited"), likeness("_s", "_n").alias("near_next")
    )
