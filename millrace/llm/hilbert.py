"""Shards along a Hilbert curve, with DataFrame functions only.

Several metadata columns are quantised to a few bits each, in the order of their values; the Hilbert index
of the cell is computed JVM-side; rows are range-sorted by (index, hash of the first key column, key) and the
sorted order is cut into runs of equal row counts. With a digest of the text as the first key column, equal
texts of a cell lie together. Files cut this way cover small boxes of the metadata space, so their
min/max statistics prune on every dimension, not on the first alone.

At scale: the columns given (pass slim ones; texts can be joined later) and the index are written once to the
shared folder, so that they are computed once; the only shuffle of rows is the range sort. A cell that holds a third of all rows is split by the hash in the sort key. Global
ranks need no single-task window: the sorted rows are written to the shared folder with a row number
within their partition, and the offsets of the partitions, one row each, are joined back.

Defined results: a column of the input whose name is that of a result, in whatever case, is replaced.
Nulls in a dimension go to cell 0. Repeated rows get slots of their own. With fewer
rows than shards some shards stay empty; an empty table gives an empty one. Row counts of shards
differ by one at most, and slots are gapless from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, unlike


#: Distinct categories that one task orders, on the average; the cuts don't depend on it.
CATEGORIES = 1 << 16


@dataclass(frozen=True)
class Dimension:
    """kind: "number" is cut at quantiles of the column, "category" in runs of neighbouring values of about equal rows, "raw" is taken modulo the cells."""

    column: str
    kind: str = "number"


def category_cuts(df: DataFrame, column: str, cells: int) -> list[str]:
    """The last values of all cells but one, in the order of bytes, however many values there are.

    Up to as many values as cells have a cell each. Of more, a value ends a cell if the rows up to it, in
    shares of 1 / cells, reach a further whole share. Values are counted, ordered by range, and their running
    counts are two-level; a row a partition and the cuts alone reach the driver.
    """
    c = F.col(f"`{column}`").cast("string")
    counts = materialize(df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n")))
    many = counts.count()
    if not many:
        return []
    ordered = materialize(counts.repartitionByRange(-(-many // CATEGORIES), "v").select("v", "n", F.spark_partition_id().alias("p")))
    sizes = sorted((r["p"], r["n"]) for r in ordered.groupBy("p").agg(F.sum("n").alias("n")).collect())
    total, starts = 0, []
    for p, n in sizes:
        starts.append((p, total))
        total += n
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    runs = ordered.join(F.broadcast(df.sparkSession.createDataFrame(starts, "p int, start long")), "p").select("v", "n", upto.alias("run"))
    share = lambda run: F.expr(f"({run}) * {cells}L div {total}L")
    ends = F.lit(many <= cells) | (share("run") > share("run - n"))
    return [r["v"] for r in runs.where(ends & (F.col("run") < total)).orderBy("run").collect()]


def quantise(df: DataFrame, dims: list[Dimension], bits: int) -> list[Column]:
    """Cell numbers 0 to 2**bits - 1. The quantiles of all numeric dimensions come from one pass; their number is bounded by the bits."""
    cells = 1 << bits
    numeric = [d.column for d in dims if d.kind == "number"]
    cuts: dict[str, list[float]] = {}
    if numeric:
        probs = [i / cells for i in range(1, cells)]
        row = df.agg(*(F.percentile_approx(F.col(f"`{c}`").cast("double"), probs, 10_000).alias(f"q{i}") for i, c in enumerate(numeric))).first()
        cuts = {c: sorted(set(row[i] or [])) for i, c in enumerate(numeric)}
    out = []
    for d in dims:
        c = F.col(f"`{d.column}`")
        if d.kind == "category":
            cell = sum((F.when(c.cast("string") > v, 1).otherwise(0) for v in category_cuts(df, d.column, cells)), F.lit(0))
        elif d.kind == "raw":
            cell = F.pmod(c.cast("long"), F.lit(cells))
        else:
            cell = F.lit(0)
            for q in cuts[d.column]:
                cell = cell + F.when(c.cast("double") > q, 1).otherwise(0)
        out.append(F.coalesce(cell.cast("long"), F.lit(0)))
    return out


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The position of a cell on the Hilbert curve (Skilling 2004: undo excess work from the top bit down, then Gray-decode).

    One fold over the bits from the highest, with an array of coordinates as its state: an expression
    of fixed size, whatever the number of bits.
    """
    n = len(cells)
    if n == 1:
        return cells[0]
    x = F.array(*cells)
    masks = F.array(*(F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)))

    # One coordinate at a time, each an element of the fold, so that the expression grows with n, not with its powers.
    steps = F.flatten(F.transform(masks, lambda q: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(q.alias("q"), i.alias("i")))))

    def step(x: Column, s: Column) -> Column:
        q, p, i = s["q"], s["q"] - F.lit(1).cast("long"), s["i"]
        first, own = x[0], F.get(x, i)
        swap = first.bitwiseXOR(own).bitwiseAND(p)
        high = own.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, k: F.when(high & (k == 0), v.bitwiseXOR(p)).when(~high & ((k == 0) | (k == i)) & (i != 0), v.bitwiseXOR(swap)).otherwise(v),
        )

    x = F.aggregate(steps, x, step) if bits > 1 else x
    # Gray encode: each coordinate with the one before, as a running XOR.
    x = F.aggregate(x, F.array().cast("array<bigint>"), lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long"))))))
    last = F.element_at(x, -1)
    t = F.aggregate(masks, F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)) if bits > 1 else F.lit(0).cast("long")
    x = F.transform(x, lambda v: v.bitwiseXOR(t))
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):  # interleave
        for i in range(n):
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(x[i], b).bitwiseAND(F.lit(1).cast("long")))
    return index


def hilbert_shards(df: DataFrame, dims: list[Dimension], n_shards: int, key: list[str], bits: int = 4, partitions: int | None = None) -> DataFrame:
    """Adds hilbert, shard and slot. key: columns that order the rows of a cell (by the hash of the first, then by value).

    The result rests on a checkpoint in the shared folder: ranks stay as they are if executors are lost.
    """
    kept = unlike(df.columns, ("hilbert", "shard", "slot"))
    h, tie, row = "hilbert", free_name("_tie", df.columns), free_name("_row", df.columns)
    cells = quantise(df, dims, bits)
    names = [free_name(f"_cell{i}", df.columns) for i in range(len(cells))]
    keys = [free_name(f"_key{i}", df.columns) for i in range(len(key))]
    keyed = df.select("*", *(c.alias(n) for c, n in zip(cells, names, strict=True)))
    keyed = materialize(keyed.select(*(f"`{c}`" for c in kept), hilbert_index([F.col(n) for n in names], bits).alias(h), F.xxhash64(F.col(f"`{key[0]}`")).alias(tie), *(F.col(f"`{k}`").alias(n) for k, n in zip(key, keys, strict=True))))
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [h, tie, *keys]
    done = materialize(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(tie, *keys).withColumn(row, F.monotonically_increasing_id()))
    part, within = F.shiftright(F.col(row), 33), F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    # One row a partition: their number is a setting, not a size of the data.
    sizes = done.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).collect()
    total, offsets = 0, {}
    for r in sorted(sizes, key=lambda r: r["_p"]):
        offsets[r["_p"]], total = total, total + r["_n"]
    if not total:
        return done.select(*(f"`{c}`" for c in kept), h, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    offset, number = free_name("_offset", done.columns), free_name("_part", done.columns)
    starts = df.sparkSession.createDataFrame(list(offsets.items()), f"`{number}` int, `{offset}` long")
    ranked = done.join(F.broadcast(starts), part.cast("int") == F.col(number)).withColumn(row, within + F.col(offset))
    shard = F.expr(f"(`{row}` * {n_shards}L) div {total}L")
    start = F.expr(f"(((`{row}` * {n_shards}L) div {total}L) * {total}L + {n_shards - 1}L) div {n_shards}L")  # the first rank of the shard
    return ranked.select(*(f"`{c}`" for c in kept), h, shard.cast("int").alias("shard"), (F.col(row) - start).alias("slot"))
