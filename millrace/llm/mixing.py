"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a keyed hash. A document's virtual finish time is its source's cumulative
size in that order, divided by the source's target; a second epoch of the source follows the first in
the same order, so a document may be taken twice, never more. All entries are range-sorted by virtual
finish time, and the order is truncated where the running total would pass the budget.

At scale: within a source the taken entries are a prefix of the shuffled order, so the whole mix comes
down to two shuffle keys a source (the last one taken in either epoch). Only slim rows (source, key,
size) are shuffled to find them, in buckets of a source's hash range, so that a source with a third of
all rows is split over many tasks; texts are then filtered where they lie. The tables that reach the
driver have a row a source; their number is checked.

Defined results: a null or empty text has size 0; it is taken as often as the entries around it.
A null source is a source of its own, after all others. Rows with equal keys (repeated rows) are taken
together. An empty table, or one without words, gives targets of 0 and takes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, word_count


#: The columns that mix() adds.
RESULTS = ("size", "source_size", "target", "copies")
#: Ranges of finish times from 0 to 1.
RANGES = 8192


@dataclass(frozen=True)
class MixPolicy:
    """weights repeat over the sources in code-point order, null last. max_sources guards the driver: more is an error."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    budget: float = 1.5
    epochs: int = 2
    seed: str = "mix"
    buckets: int = 1024
    max_sources: int = 100_000


def water_fill(sizes: list[int], weights: list[float], budget: float, cap: float) -> list[float]:
    """Targets by weight that sum to the budget, none above cap times its size; the excess is reshared by weight until none is above."""
    full = [False] * len(sizes)
    while True:
        rest = budget - sum(cap * s for s, f in zip(sizes, full, strict=True) if f)
        total = sum(w for w, f in zip(weights, full, strict=True) if not f)
        targets = [cap * s if f else w / total * rest for s, w, f in zip(sizes, weights, full, strict=True)]
        above = [not f and t > cap * s for s, t, f in zip(sizes, targets, full, strict=True)]
        if not any(above):
            return [float(t) for t in targets]
        full = [f or a for f, a in zip(full, above, strict=True)]
        if all(full):
            return [float(cap * s) for s in sizes]


def shuffle_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A hash that orders a source's documents at random but always alike."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def plan_mix(slim: DataFrame, policy: MixPolicy) -> list[tuple]:
    """slim: source, key, size, in the shared folder. A tuple a source: source, source_size, target, then the last key taken in each epoch (None: none)."""
    rows = slim.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).limit(policy.max_sources + 1).collect()
    if len(rows) > policy.max_sources:
        raise ValueError(f"more than {policy.max_sources} sources: mixing weights are set by source, give coarser ones")
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be", "surrogatepass")))
    sizes = [r["s"] for r in rows]
    weights = [policy.weights[i % len(policy.weights)] for i in range(len(rows))]
    total = sum(sizes)
    if not total:
        return [(r["source"], r["s"], 0.0, *[None] * policy.epochs) for r in rows]
    budget = policy.budget * total
    targets = water_fill(sizes, weights, budget, float(policy.epochs))
    spark = slim.sparkSession
    facts = spark.createDataFrame([(r["source"], i, r["s"], t) for i, (r, t) in enumerate(zip(rows, targets, strict=True))], "_s string, rank int, source_size long, target double")
    # Cumulative sizes in two levels: sums of hash ranges first, then keys within a range.
    bits = max(0, policy.buckets.bit_length() - 1)
    hexes = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranked = slim.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("_s"))).where(F.col("target") > 0)
    per_source = [F.first(c).alias(c) for c in ("source_size", "target")]
    parts = ranked.groupBy("rank", F.shiftright(hexes, 32 - bits).cast("int").alias("bucket"), "key").agg(F.sum("size").alias("size"), *per_source)
    parts = materialize(parts)
    sums = parts.groupBy("rank", "bucket").agg(F.sum("size").alias("b"))
    before = sums.select("rank", "bucket", (F.sum("b").over(W.partitionBy("rank").orderBy("bucket")) - F.col("b")).alias("before"))
    within = parts.withColumn("cum", F.sum("size").over(W.partitionBy("rank", "bucket").orderBy("key")))
    epochs = F.explode(F.sequence(F.lit(0), F.lit(policy.epochs - 1)))
    entries = within.join(before, ["rank", "bucket"]).select("rank", "key", "size", epochs.alias("epoch"), (F.col("cum") + F.col("before")).alias("cum"), "source_size", "target")
    finish = (F.col("cum") + F.col("epoch") * F.col("source_size")) / F.col("target")
    entries = materialize(entries.select("rank", "key", "size", "epoch", finish.alias("finish")))
    # Truncate the global order: sums of ranges of finish times first, a fixed number of them; then the running total within the range where the budget is passed.
    fine = F.when(F.col("finish") < 2, F.floor(F.col("finish") * RANGES)).otherwise(2 * RANGES + F.least(F.floor(F.log2("finish") * 64), F.lit(RANGES)))
    ranges = sorted(entries.groupBy(fine.alias("r")).agg(F.sum("size").alias("s")).collect(), key=lambda r: r["r"])
    run, crossing = 0, None
    for r in ranges:
        if run + r["s"] > budget:
            crossing = r["r"]
            break
        run += r["s"]
    if crossing is None:
        taken = entries.select("rank", "epoch", "key")
    else:
        order = W.orderBy("finish", "rank", "epoch", "key").rowsBetween(W.unboundedPreceding, 0)
        edge = entries.where(fine == crossing).withColumn("_run", F.sum("size").over(order) + F.lit(run)).where(F.col("_run") <= budget).select("rank", "epoch", "key")
        taken = entries.where(fine < crossing).select("rank", "epoch", "key").unionByName(edge)
    last = {(r["rank"], r["epoch"]): r["k"] for r in taken.groupBy("rank", "epoch").agg(F.max("key").alias("k")).collect()}
    return [(r["source"], r["s"], t, *(last.get((i, e)) for e in range(policy.epochs))) for i, (r, t) in enumerate(zip(rows, targets, strict=True))]


def mix(df: DataFrame, policy: MixPolicy = MixPolicy(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Adds size, source_size, target and copies (0 to epochs)."""
    own = {n: free_name(f"_{n}", df.columns) for n in ("size", "key", "rank")}
    size, key = word_count(F.col(f"`{text}`")), shuffle_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), policy.seed)
    slim = materialize(df.select(F.col(f"`{source}`").alias("source"), key.alias("key"), size.alias("size")))
    plan = plan_mix(slim, policy)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in RESULTS]
    schema = T.StructType([T.StructField("_s", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), *(T.StructField(f"_k{e}", T.StringType()) for e in range(policy.epochs))])
    table = df.sparkSession.createDataFrame(plan, schema)  # a row a source, at most max_sources
    with_key = df.select(*kept, size.alias(own["size"]), key.alias(own["key"]))
    joined = with_key.join(F.broadcast(table), F.col(f"`{source}`").eqNullSafe(F.col("_s")), "left")
    copies = sum((F.when(F.col(own["key"]) <= F.col(f"_k{e}"), 1).otherwise(0) for e in range(policy.epochs)), F.lit(0))
    return joined.select(*kept, F.col(own["size"]).alias("size"), "source_size", "target", copies.alias("copies"))


def mixed_documents(df: DataFrame, policy: MixPolicy = MixPolicy(), **columns: str) -> DataFrame:
    """The mix itself: the columns of the input, each row as often as it is taken."""
    aside = {}
    for c in df.columns:
        if c.lower() in RESULTS:
            aside[c] = free_name(f"_{c}", [*df.columns, *aside.values()])
    mixed = mix(df.withColumnsRenamed(aside), policy, **columns)
    name = free_name("_copy", [*df.columns, *aside.values()])
    repeated = mixed.where(F.col("copies") > 0).select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in df.columns), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias(name))
    return repeated.drop(name)
