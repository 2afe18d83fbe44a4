"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to BITS bits each, at quantiles over all rows: numbers by their
size, strings by the order of the whole values, so that neighbouring values stay neighbours
and equal ones share a cell.  Rows are sorted by
their place on the Hilbert curve through that grid, and the sorted run is cut into shards
of equal row counts (law `rows`: counts at most one apart), so each
shard covers a compact box of every dimension and files can be pruned by any of them.

The sort deals rows out by curve index, then doc_id, so one value that a
third of all rows share is split over many tasks; ranks come from counts for
each range, never from one global window.

Null metadata takes the lowest cell; a null text has size 1 and the checksum
of no bytes.  Rows that repeat a doc_id are ordered by size and checksum and
each get a place.  Equal texts are rows like any other: their metadata and ids decide, so a group of copies
may lie in several shards.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

SHARDS, BITS, RANGES = 8, 5, 64


def _cell(rows: DataFrame, name: str, kind: str, bits: int) -> Column:
    """The cell of a column's values: how many cuts lie at or below.  There are fewer than 2**bits cuts."""
    parts = 1 << bits
    if kind != "string":
        steps = [i / parts for i in range(1, parts)]
        number = F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))
        at = rows.agg(F.percentile_approx(number, steps, 10000)).first()[0] or []
        cuts = sorted({float(v) for v in at})
        return sum(((number > F.lit(v)).cast("int") for v in cuts), F.lit(0))
    # different values with their counts, dealt out in order: the ranges' first values and counts are all that is collected
    value = F.coalesce(F.col(name), F.lit(""))
    ranges = rows.groupBy(value.alias("v")).agg(F.count("*").alias("n")).repartitionByRange(4 * parts, "v")
    ranges = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min("v").alias("v"), F.sum("n").alias("n")).collect()
    total, met, cuts = sum(r.n for r in ranges), 0, []
    for r in sorted(ranges, key=lambda r: r.p):
        if met * parts >= (len(cuts) + 1) * total and len(cuts) < parts - 1:
            cuts.append(r.v)
        met += r.n
    return sum(((value >= F.lit(v)).cast("int") for v in cuts), F.lit(0))


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of grid cells (by Skilling's transform), as a fold over the bit planes."""
    n = len(cells)
    state = F.array(*[c.cast("long") for c in cells])

    def plane(x: Column, q: Column) -> Column:
        """Undo one bit plane: reflect or exchange the low bits against the first axis."""
        low = q - 1
        for i in range(n):
            a, b = x[0], x[i]
            t = a.bitwiseXOR(b).bitwiseAND(low)
            swap = [a.bitwiseXOR(t), b.bitwiseXOR(t)] if i else [a, b]
            on = b.bitwiseAND(q) > 0
            items = [F.when(on, a.bitwiseXOR(low)).otherwise(swap[0])]
            items += [F.when(on, b).otherwise(swap[1]) if k == i else x[k] for k in range(1, n)]
            # a one-element fold holds the new axes, so that they are computed once
            x = F.aggregate(F.array(F.array(*items)), F.array(*[F.lit(0).cast("long")] * n), lambda _, v: v)
        return x

    planes = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<long>")
    x = F.aggregate(planes, state, plane)

    def gray(x: Column) -> Column:
        out = [x[0]]
        for i in range(1, n):
            out.append(x[i].bitwiseXOR(out[-1]))
        return F.array(*out)

    def interleave(g: Column) -> Column:
        t = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(g[n - 1].bitwiseAND(F.lit(1 << b)) > 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long"))
        spread = F.lit(0).cast("long")
        for b in range(bits):
            for i in range(n):
                bit = F.shiftright(g[i].bitwiseXOR(t), b).bitwiseAND(F.lit(1))
                spread = spread.bitwiseOR(F.shiftleft(bit, b * n + (n - 1 - i)))
        return spread

    one = F.transform(F.array(x), gray)
    return F.transform(one, interleave)[0]


def hilbert_shards(docs: DataFrame, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), shards: int = SHARDS, bits: int = BITS, ranges: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, dimensions...) -> (doc_id, size, text_crc32, cell0, .., hilbert, [row,] shard, slot); row is a struct of the columns to carry."""
    spark = docs.sparkSession
    work = Workspace(spark)
    kinds = dict(docs.dtypes)
    cells = [f"cell{k}" for k in range(len(dimensions))]
    cell = [_cell(docs, c, kinds[c], bits).alias(cells[k]) for k, c in enumerate(dimensions)]
    measured = [(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32")]
    rows = docs.select("doc_id", *measured, *cell, *([F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []))
    rows = rows.select("doc_id", "size", "text_crc32", *cells, hilbert_index([F.col(c) for c in cells], bits).alias("hilbert"), *(["row"] if carry else []))
    rows = work.store(rows, "rows")  # the index is computed once, not again for the sample of the sort
    order = ["hilbert", "doc_id", "size", "text_crc32"]
    parts = ranges or max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    dealt = work.store(dealt, "sorted")
    work.drop("rows")
    counts = dict(sorted((r[0], r[1]) for r in dealt.groupBy("_range").count().collect()))  # as many as ranges
    total, before, at = sum(counts.values()), {}, 0
    for key, n in counts.items():
        before[key], at = at, at + n
    base = F.lit(0).cast("long")
    if before:
        base = F.element_at(F.create_map(*[F.lit(v) for kv in before.items() for v in kv]), F.col("_range")).cast("long")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + base
    small, more = divmod(total, shards)
    edge = more * (small + 1)  # the first `more` shards have one row more
    shard = F.when(F.col("_nth") < edge, F.expr(f"_nth div {small + 1}")).otherwise(F.expr(f"(_nth - {edge}) div {max(1, small)} + {more}"))
    slot = F.when(F.col("_nth") < edge, F.col("_nth") % (small + 1)).otherwise((F.col("_nth") - edge) % max(1, small))
    return dealt.withColumn("_nth", nth).select(*[c for c in dealt.columns if c != "_range"], shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), shards: int = SHARDS, bits: int = BITS) -> None:
    """Write the documents, all columns, as one directory a shard, in curve order within each file.

    The rows themselves go through the sort, so null and repeated ids need no join.  A column named shard gives way to
    the directories' name.
    """
    placed = hilbert_shards(docs, dimensions, shards, bits, carry=tuple(c for c in docs.columns if c != "shard")).select("row", "shard", "slot")
    dealt = placed.repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot")
    dealt.select("row.*", "shard").write.partitionBy("shard").parquet(path)
