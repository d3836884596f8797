"""SimHash near-duplicates through an inverted index over byte positions with count filtering.

A fingerprint has 64 bits from the XXH64 hashes of the 3-word shingles. Two fingerprints link at max_bits
or fewer differing bits, so they differ in max_bits bytes at most and share the other positions: with two
bits, at least six of eight positional bytes. That is the guaranteed minimum of matches, and postings are
keyed by it: one list for each choice of six positions and their six bytes (28 for a fingerprint). A pair
gets into a list, and is tallied there, only if it reaches the minimum; a pair that shares seven bytes meets
in seven lists. Retained pairs are verified by counting the differing bits.

The members of a list differ in two bytes alone, so a list has 65,536 members at most, however large the
corpus and however dense a group of near copies. Each member has 136 others within two bits there, so the
links of a list are bounded by its length: pairs are never enumerated.

At scale: texts are read once, in Arrow batches, and only (doc_id, fingerprint) goes on. Equal
fingerprints are pre-aggregated before any shuffle, so a group of copies with a third of all rows is
one node. Postings are sorted within partitions and streamed, a list at a time.

Defined results: a text without words (null, empty, blank) has fingerprint zero, linked like any other.
Fewer than three words: one shingle, the whole sequence. component_id is the smallest doc_id reachable;
null doc_ids don't count, and a component with none but those has null. Repeated rows are repeated in
the result. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, trim, utf8
from .graph import components

BLOCK = 1 << 16


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint, unsigned: a bit is 1 if it is set in over half of the shingles' hashes."""
    import xxhash

    words = utf8(text).lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles: list[bytes] = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        shingles = [joined[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]
    votes = np.zeros(64, np.int64)
    for i in range(0, len(shingles), BLOCK):
        digests = b"".join(map(xxhash.xxh64_digest, shingles[i : i + BLOCK], repeat(seed)))
        votes += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(shingles)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a (signed) long; keeps the other columns."""
    names = [*df.columns, name]
    at = names.index(text)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns) + f", `{name}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((simhash(t.as_py()) for t in b.column(at)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints.view(np.int64))], names=names)

    return df.mapInArrow(run, schema)


def fingerprints(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, fp; the text stays in the Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((simhash(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(max_bits: int) -> np.ndarray:
    """Of each choice of 8 - max_bits positions, the bits of those bytes."""
    return np.array([sum(255 << 8 * i for i in kept) for kept in combinations(range(8), 8 - max_bits)], np.uint64)


def list_links(members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """u < v (as signed numbers): the pairs of a list's distinct fingerprints within max_bits bits of each other, each found from its first by its neighbours in the sorted list."""
    if len(members) <= 64:
        a, b = np.triu_indices(len(members), 1)
        near = np.bitwise_count(members[a] ^ members[b]) <= max_bits
        a, b = members[a[near]], members[b[near]]
    else:
        members = np.sort(members)
        free = np.flatnonzero(np.unpackbits(np.array([np.bitwise_or.reduce(members ^ members[0])], "<u8").view(np.uint8), bitorder="little"))  # bits in which members differ
        flips = [sum(1 << int(b) for b in some) for k in range(1, max_bits + 1) for some in combinations(free, k)]
        a, b = [], []
        for flip in flips:
            other = members ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(members, other), len(members) - 1)
            hit = (members[at] == other) & (members < other)
            a.append(members[hit])
            b.append(other[hit])
        a, b = np.concatenate(a), np.concatenate(b)
    a, b = a.view(np.int64), b.view(np.int64)
    return np.minimum(a, b), np.maximum(a, b)


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """prints: distinct fp. Returns u, v, lists: all linked pairs, and the number of lists in which they met."""
    if not 1 <= max_bits <= 2:
        raise ValueError("with more than two bits the lists are no longer short")
    masks = _masks(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_n, rest_fp = np.zeros(0, np.int32), np.zeros(0, np.uint64)

        def pairs(n: np.ndarray, fp: np.ndarray, key: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in np.flatnonzero(np.diff(edges) > 1):
                u, v = list_links(fp[edges[i] : edges[i + 1]], max_bits)
                us.append(u), vs.append(v)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        for b in batches:
            n = np.concatenate([rest_n, b.column(0).to_numpy()])
            fp = np.concatenate([rest_fp, b.column(1).to_numpy().view(np.uint64)])
            key = fp & masks[n]
            edges = np.concatenate([[0], np.flatnonzero((n[1:] != n[:-1]) | (key[1:] != key[:-1])) + 1])  # where lists begin; the last may go on in the next batch
            rest_n, rest_fp = n[edges[-1] :], fp[edges[-1] :]
            yield pairs(n, fp, key, edges)
        if len(rest_fp) > 1:
            yield pairs(rest_n, rest_fp, rest_fp, np.array([0, len(rest_fp)]))
        trim()

    signed = [int(m) for m in masks.view(np.int64)]
    postings = prints.select("fp", F.posexplode(F.array(*(F.lit(m).cast("long") for m in signed))).alias("n", "mask")).select("n", "fp", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    dealt = postings.repartition("n", "key").sortWithinPartitions("n", "key").select("n", "fp")
    return dealt.mapInArrow(run, "u long, v long").groupBy("u", "v").agg(F.count(F.lit(1)).alias("lists"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 2) -> DataFrame:
    """doc_id, fp (signed long), component_id: a row for each row."""
    prints = materialize(fingerprints(df, doc_id, text))
    return prints.join(classes(prints, max_bits).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def classes(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """prints: doc_id, fp. Returns fp, least (its smallest doc_id), component_id, and is_first: whether this fingerprint stands for its component."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = materialize(components(links(nodes.select("fp"), max_bits)))
    linked = nodes.join(roots, nodes.fp == roots.node).select("fp", "least", "root")
    order = F.struct(F.col("least").isNull(), F.col("least"), F.col("fp"))
    heads = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.min(order).alias("head"))
    known = linked.join(heads, "root").select("fp", "component_id", (F.col("head.fp") == F.col("fp")).alias("is_first"))
    whole = nodes.join(known, "fp", "left")
    return whole.select("fp", "least", F.when(F.col("is_first").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("is_first", F.lit(True)).alias("is_first"))


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that with the smallest doc_id (null last), with all its columns.

    Copies are pre-aggregated by fingerprint before the shuffle.
    """
    prints = materialize(fingerprints(df, doc_id, text))
    heads = classes(prints).where("is_first").select(F.col("fp").alias("_head"))
    name = free_name("_fp", df.columns)
    order = F.struct(F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`")))
    rows = with_fingerprint(df, text, name).groupBy(name).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), order).alias("row"))
    return rows.join(heads, F.col(name) == F.col("_head"), "left_semi").select("row.*")
