"""Removal of repeated and nearly repeated lines, with DataFrame functions only.

Lines that are equal but for blanks at their ends are one class, known by
their MD5.  Classes are compared by MinHash over character shingles: each shingle of K
characters (UTF-16 units) is hashed once, and all of a line's shingles, whatever its length, give
MINIMA minima by different multipliers.  Band b is the minima b, b + 1 and b + 4 (no two
bands share two); classes that agree on all three share the band's bucket.  A pair at a similarity of 0.8 shares one
with a probability of 0.993, at 0.9 with 0.9997.

In a bucket of at most SMALL classes every pair is a candidate.  A larger bucket is
the root of a trie: it is split by the next minimum, and again, DEEPER times.  In such a
bucket each class meets the LEADERS classes of least hash, in its larger nodes the one of least hash, and
the pairs of a node of at most SMALL are candidates.  So most of a large group is joined by rows in
proportion to its size, as its classes meet leaders that are ever more like
themselves.  All candidates are verified by the exact Jaccard similarity of their
whole shingle sets, and a distributed union-find joins the links.

Then comes the rest of the larger buckets: every two classes of one that are not yet joined are compared, those outside the
bucket's largest part with all others, in cells of at most CELL by CELL.  (In a first round each of them meets only one cell of about SAMPLE; this
joins what has many partners, so that the second, whole round is left with little.)  A bound that never refuses a pair above
the threshold (what the parities of their sets differ in) spares most of these, and of all other candidates, the verification.  So no pair that shares a bucket stays apart
for the bucket's size; that costs, for each bucket, its size times the number outside its largest part.
One line of each component stays: the first by (doc_id, text's hash, line number).

Blank lines are never removed.  Null texts have no lines and stay null; a null doc_id
sorts first.  Rows that repeat a doc_id with another text are documents of their own; rows that
repeat both are one document's copies and lose the same lines.
Extra columns of any name pass through; n_lines and n_removed replace columns of those names.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .workspace import Workspace

K, CHUNK, STEP, THRESHOLD = 8, 8, 8, 0.8
SMALL, DEEPER, LEADERS = 32, 9, 2
CELL, SAMPLE, WORDS = 1024, 64, 8
MINIMA = [f"m{k}" for k in range(12)]
PARITIES = [f"p{w}" for w in range(WORDS)]
BANDS = [[MINIMA[(b + i) % len(MINIMA)] for i in (0, 1, 4)] for b in range(len(MINIMA))]
LOW31 = (1 << 31) - 1
BLANKS = " \t\r\x0b\x0c"


def band_hashes() -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *own) for b, own in enumerate(BANDS)])


def _utf16(line: str) -> Column:
    return F.encode(line, "UTF-16BE")


def _last(data: Column) -> Column:
    """Where the last shingle of a line of UTF-16 begins; a line shorter than a shingle is one."""
    return F.greatest(F.lit(0), F.floor(F.octet_length(data) / 2).cast("int") - K)


def _shingle(data: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(data, at * 2 + 1, F.lit(2 * K)))


def shingles(line: str) -> Column:
    """The 64-bit hashes of a line's shingles, repeats included."""
    return F.transform(F.array(_utf16(line)), lambda b: F.transform(F.sequence(F.lit(0), _last(b)), lambda i: _shingle(b, i)))[0]


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line_no, line, key) of the lines that are not blank: h is the text's hash, key the MD5 of the trimmed line."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # trimming at the end walks the whole line, so only lines that need it are
    blank = reduce(Column.__or__, [F.endswith("line", F.lit(c)) for c in BLANKS])
    lines = lines.withColumn("line", F.when(blank, F.btrim("line", F.lit(BLANKS))).otherwise(F.ltrim("line", F.lit(BLANKS)))).where("line <> ''")
    return lines.withColumn("key", F.unhex(F.md5("line")))


def signatures(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines(*keys, line) -> the keys that begin the list grouped, the last one's least, and all minima.

    A row stands for CHUNK shingles, whose least hash for each multiplier is taken before rows are grouped.
    """
    data = lines.select(*keys, _utf16("line").alias("b"))
    data = data.withColumn("last", _last(F.col("b")))
    rows = data.select(*keys, "b", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(CHUNK))).alias("i"))
    low = F.lit(LOW31).cast("long")
    # beyond the line's end the last shingle is repeated, which changes no minimum
    hashes = [_shingle(F.col("b"), F.least(F.col("i") + j, F.col("last"))).bitwiseAND(low).alias(f"x{j}") for j in range(CHUNK)]
    rows = rows.select(*keys, *hashes)

    def least(k: int) -> Column:
        odd = F.lit((k + 1) * 0x9E3779B1 % (1 << 32) | 1).cast("long")
        return F.min(F.least(*[(F.col(f"x{j}") * odd).bitwiseAND(low) for j in range(CHUNK)])).cast("int").alias(MINIMA[k])

    return rows.groupBy(*keys[:-1]).agg(F.min(keys[-1]).alias(keys[-1]), *[least(k) for k in range(len(MINIMA))])


def alike(pairs: DataFrame, a: Column, b: Column, threshold: float) -> DataFrame:
    """The pairs whose arrays, as sets of nu and nv, have a Jaccard similarity of `threshold` or more; u and v are kept."""
    # a generator in between, so that each array is computed once and the filter is not pushed below it; the arrays meet in a
    # projection of their own, as a generator of higher-order functions is interpreted as a whole
    rows = pairs.select("u", "v", "nu", "nv", F.size(F.array_intersect(a, b)).alias("n"))
    rows = rows.select("u", "v", "nu", "nv", F.explode(F.array("n")).alias("both"))
    return rows.where(F.col("both") >= F.lit(threshold) * (F.col("nu") + F.col("nv") - F.col("both"))).select("u", "v")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]


def candidate_pairs(classes: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """classes(key, m0, .., bands) -> pairs(u, v), different keys that may be alike, each pair once: all of the small buckets, some
    of the larger ones; and large(band, key), the larger buckets, for joined_classes() to complete."""
    half, parts = len(BANDS) // 2, []
    for k in (0, half):  # one half of the bands after the other, so that half of the rows lie on the disks at a time
        own = classes.select("key", F.posexplode(F.slice("bands", k + 1, half)).alias("b", "band")).withColumn("b", F.col("b") + k)
        own = own.withColumn("n", F.count("*").over(Window.partitionBy("band"))).where("n > 1")
        parts.append(work.store(own.select("key", "b", "band", "n"), f"members{k}"))
    members = parts[0].unionByName(parts[1])
    large = work.store(members.where(F.col("n") > SMALL).select("band", "key"), "large")

    # a node for each bucket, and for a larger one the nodes below it: one row for each class and depth
    order = [F.array(*[m for m in MINIMA[b:] + MINIMA[:b] if m not in own][:DEEPER]) for b, own in enumerate(BANDS)]
    deeper = F.element_at(F.array(*order), F.col("b") + 1)
    path = members.where(F.col("n") > SMALL).join(classes.select("key", *MINIMA), "key").select("key", "band", deeper.alias("deeper"))
    path = path.select("key", "band", "deeper", F.explode(F.sequence(F.lit(1), F.lit(DEEPER))).alias("depth"))
    path = path.select("key", "band", "depth", F.xxhash64("band", F.slice("deeper", 1, F.col("depth"))).alias("node"))
    rows = work.store(members.select("key", "band", F.lit(0).alias("depth"), F.col("band").alias("node")).unionByName(path), "nodes")
    leader = [F.min(F.struct(F.xxhash64("key", "node", F.lit(i)).alias("h"), "key")).alias(f"l{i}") for i in range(LEADERS)]
    stats = work.store(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("depth").alias("depth"), *leader).where("n > 1"), "stats")
    rows = rows.join(stats.select("node", "n"), "node")
    first = F.min(F.when(F.col("n") <= SMALL, F.col("depth"))).over(Window.partitionBy("key", "band"))
    rows = work.store(rows.withColumn("first", first).where((F.col("n") > SMALL) | (F.col("depth") == F.col("first"))).select("node", "key", "n"), "trie")

    # whom each class meets in a node: all others of a small one, the leaders of a larger one; linear in the group's size
    leaders = F.array(*[F.col(f"l{i}.key") for i in range(LEADERS)])
    leaders = F.when(F.col("depth") == 0, leaders).otherwise(F.slice(leaders, 1, 1))
    partners = rows.where(F.col("n") <= SMALL).select("node", F.col("key").alias("partner"))
    partners = work.store(partners.unionByName(stats.where(F.col("n") > SMALL).select("node", F.explode(leaders).alias("partner"))), "partners")
    found = rows.join(partners, "node").where((F.col("key") < F.col("partner")) | ((F.col("n") > SMALL) & (F.col("key") != F.col("partner"))))
    found = work.store(found.select(*_pair("key", "partner")).distinct(), "pairs")
    work.drop("members0", f"members{half}", "nodes", "stats", "trie", "partners")
    return found, large


def parities(sets: DataFrame) -> DataFrame:
    """sets(key, value), each an array of different hashes -> (key, size, p0, ..): bit b of word w is the parity of the hashes that fall there."""
    sets = sets.select("key", F.explode(F.array("value")).alias("value"))  # a generator in between, so that no filter computes the arrays again
    at = F.sequence(F.lit(0), F.size("value") - 1, F.lit(STEP))
    rows = sets.where(F.size("value") > 0).select("key", "value", F.size("value").alias("all"), F.explode(at).alias("i"))
    # a row stands for STEP hashes, null beyond the end
    rows = rows.select("key", F.least(F.lit(STEP), F.col("all") - F.col("i")).alias("n"), *[F.get("value", F.col("i") + j).alias(f"x{j}") for j in range(STEP)])
    words = [F.expr(f"shiftrightunsigned(x{j}, 6) & {WORDS - 1}").alias(f"w{j}") for j in range(STEP)]
    rows = rows.select("key", "n", *words, *[F.expr(f"shiftleft(1L, cast(x{j} & 63 as int))").alias(f"b{j}") for j in range(STEP)])

    def parity(w: int) -> Column:
        return F.bit_xor(reduce(Column.bitwiseXOR, [F.when(F.col(f"w{j}") == w, F.col(f"b{j}")).otherwise(F.lit(0).cast("long")) for j in range(STEP)]))

    return rows.groupBy("key").agg(F.sum("n").alias("size"), *[parity(w).alias(p) for w, p in enumerate(PARITIES)])


def _may(sx: str, sy: str, x: list[str], y: list[str], threshold: float) -> Column:
    """False only for sizes and parities of sets below the threshold t: others differ in at most (1 - t) / (1 + t) of the sum of
    their sizes, and each difference turns one parity."""
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(q))) for p, q in zip(x[1:], y[1:])), F.bit_count(F.col(x[0]).bitwiseXOR(F.col(y[0]))))
    return F.greatest(differ, F.abs(F.col(sx) - F.col(sy))) * F.lit(1 + threshold) <= (F.col(sx) + F.col(sy)) * F.lit(1 - threshold) + F.lit(1e-6)


def plausible(pairs: DataFrame, traits: DataFrame, threshold: float) -> DataFrame:
    """pairs(u, v), traits as parities() makes them -> (u, v, nu, nv): the pairs that may reach the threshold, with both sizes."""
    left, right = ([F.col("key").alias(k), F.col("size").alias(f"n{k}"), *[F.col(p).alias(f"{k}{p}") for p in PARITIES]] for k in "uv")
    met = pairs.select("u", "v").join(traits.select(*left), "u").join(traits.select(*right), "v")
    return met.where(_may("nu", "nv", [f"u{p}" for p in PARITIES], [f"v{p}" for p in PARITIES], threshold)).select("u", "v", "nu", "nv")


def rest_pairs(large: DataFrame, roots: DataFrame, sets: DataFrame, work: Workspace, threshold: float, sample: int | None = None) -> DataFrame | None:
    """large(band, key), roots(node, root), sets(key, value) or what parities() made of them -> (u, v): the keys of one bucket and of
    two components that may reach the threshold, each pair once; None where no bucket holds two components.  With a sample those
    outside a bucket's largest part meet about so many others."""
    own = large.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    own = work.store(own, "parts")
    parts = own.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band")
    parts = parts.agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    few = F.lit(1) if sample else F.ceil((F.col("n") - F.col("top.n")) / CELL).cast("int")
    parts = parts.select("band", F.col("top.root").alias("major"), few.alias("few"), F.ceil(F.col("n") / (sample or CELL)).cast("int").alias("all"))
    parts = work.store(parts, "open")
    if parts.isEmpty():
        return None
    own = work.store(own.join(parts, "band"), "apart")
    buckets = own.groupBy("key").agg(F.collect_set("band").alias("bands"))
    traits = sets if "size" in sets.columns else parities(sets)
    own = own.join(work.store(traits.join(buckets, "key"), "meeting"), "key")

    def cell(many: str) -> Column:
        return F.pmod(F.xxhash64("key"), F.col(many)).cast("int")

    a = own.where("root <> major").withColumn("i", cell("few"))
    a = a.withColumn("j", cell("all") if sample else F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    a = a.select("band", "i", "j", F.col("key").alias("x"), F.col("root").alias("rx"), F.col("size").alias("sx"), F.col("bands").alias("bx"), *[F.col(p).alias(f"x{p}") for p in PARITIES])
    b = own.withColumn("j", cell("all")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("few") - 1)))
    b = b.select("band", "i", "j", F.col("key").alias("y"), F.col("root").alias("ry"), F.col("size").alias("sy"), F.col("bands").alias("by"), "major", *PARITIES)
    may = _may("sx", "sy", [f"x{p}" for p in PARITIES], PARITIES, threshold)
    # two keys of different roots meet in every bucket they share, so the least of these may stand for all
    once = F.lit(True) if sample else F.array_min(F.array_intersect("bx", "by")) == F.col("band")
    met = a.hint("merge").join(b, ["band", "i", "j"]).where((F.col("rx") != F.col("ry")) & ((F.col("ry") == F.col("major")) | (F.col("x") < F.col("y"))) & may & once)
    return work.store(met.select(*_pair("x", "y")).distinct(), "rest")


def merged_roots(roots: DataFrame, more: DataFrame, work: Workspace) -> DataFrame:
    """roots(node, root) and further links more(u, v) -> (node, root) of both: only the components that `more` touches are joined anew."""
    ends = [roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "uv"]
    edges = more.join(ends[0], "u", "left").join(ends[1], "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    moved = work.store(connected_components(edges, work).select(F.col("node").alias("root"), F.col("root").alias("least")), "moved")
    alone = moved.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("least").alias("root"))
    return roots.join(moved, "root", "left").select("node", F.coalesce("least", "root").alias("root")).unionByName(alone)


def joined_classes(links: DataFrame, large: DataFrame, traits: DataFrame, verify: Callable[[DataFrame], DataFrame], work: Workspace, threshold: float) -> DataFrame:
    """links(u, v), large(band, key), traits as parities() makes them -> (node, root): the components of the links and of all others
    within the larger buckets.  verify(pairs) gives those that reach the threshold."""
    roots = work.store(connected_components(links, work), "linked")
    for k, sample in enumerate((SAMPLE, None)):
        rest = rest_pairs(large, roots, traits, work, threshold, sample)
        if rest is None:
            break
        more = work.store(verify(rest), "more")
        if not more.isEmpty():
            roots = work.store(merged_roots(roots, more, work), f"joined{k}")
    work.drop("parts", "open", "apart", "meeting", "rest", "more", "moved")
    return roots


def with_values(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs(u, v, ..), values(key, value) -> pairs with the values of both as a and b."""
    left = values.select(F.col("key").alias("u"), F.col("value").alias("a"))
    right = values.select(F.col("key").alias("v"), F.col("value").alias("b"))
    return pairs.join(left, "u").join(right, "v")


def _first_links(lines: DataFrame, work: Workspace, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """-> links(u, v) between classes of equal lines, large(band, key), the traits of all classes in either, and what verifies pairs of these."""
    # the occurrence of least hash lends its text to the class; fixed-width buffers keep this a hash aggregate
    place = F.xxhash64("doc_id", "h", "line_no").alias("place")
    classes = work.store(signatures(lines.select("key", place, "line"), ["key", "place"]), "classes")
    pairs, large = candidate_pairs(classes.withColumn("bands", band_hashes()), work)
    where = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct().join(classes.select("key", "place"), "key")
    where, parts = work.store(where, "wanted"), []
    work.drop("classes")
    for k in (0, 1):  # one half of the classes after the other, so that half of the lines lie on the disks at a time
        half = F.xxhash64("key").bitwiseAND(1) == k
        own = lines.where(half).select("key", place, F.col("line").alias("value")).join(where.where(half), ["key", "place"])
        parts.append(work.store(own.select("key", "value").dropDuplicates(["key"]), f"texts{k}"))
    text = parts[0].unionByName(parts[1])
    traits = work.store(parities(text.select("key", F.array_distinct(shingles("value")).alias("value"))), "traits")

    def verify(pairs: DataFrame) -> DataFrame:
        return alike(with_values(plausible(pairs, traits, threshold), text), shingles("a"), shingles("b"), threshold)

    links = work.store(verify(pairs), "links")
    work.drop("pairs", "wanted")
    return links, large, traits, verify


def line_links(lines: DataFrame, work: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """-> links(u, v) between classes of equal lines: all of the small buckets, those of the larger ones that were met first."""
    return _first_links(lines, work, threshold)[0]


def line_components(lines: DataFrame, work: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """-> (key, root) of the classes of equal lines that have a link."""
    links, large, traits, verify = _first_links(lines, work, threshold)
    out = joined_classes(links, large, traits, verify, work, threshold)
    work.drop("texts0", "texts1", "traits", "large", "links")
    return out.withColumnRenamed("node", "key")


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, work: Workspace | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, h, line_no) of all lines but the first of each component."""
    work = work or Workspace(docs.sparkSession)
    lines = work.store(split_lines(docs), "lines")
    roots = line_components(lines, work, threshold)
    place = F.struct("doc_id", "h", "line_no")
    places = lines.select("key", "doc_id", "h", "line_no")
    firsts = places.groupBy("key").agg(F.min(place).alias("at"), F.count("*").alias("n"))
    firsts = firsts.join(roots, "key", "left").where("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "key"))
    firsts = work.store(firsts, "firsts")
    keep = firsts.groupBy("root").agg(F.min("at").alias("first"))
    named = firsts.join(keep, "root").select("key", "first")
    return places.join(named, "key").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "h", "line_no")


def line_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with all their columns, the text without the lines that go, and n_lines, n_removed."""
    work = Workspace(docs.sparkSession)
    losers = repeated_lines(docs.select("doc_id", "text"), threshold, work)
    gone = work.store(losers.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("t")).agg(F.collect_set("line_no").alias("gone")), "gone")
    work.drop("lines", "firsts", "linked", "joined0", "joined1")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), F.xxhash64("text").alias("h"))
    rows = rows.join(gone, rows["r"]["doc_id"].eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")), "left")
    text = F.col("r")["text"]
    parts = F.split(text, "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    kept = F.when(F.col("gone").isNull(), text).otherwise(kept)
    out = [kept.alias(c) if c == "text" else F.col("r")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*out, F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
