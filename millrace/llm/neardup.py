"""Near copies of texts: those that op10's operator links, and those of a Jaccard similarity of 0.8.

The operator of simhash.py comes first: texts whose fingerprints are within max_bits = 2 bits, found by its
index over byte positions, are linked as they are there. Its two bits reach few of the texts that are similar
by sets of shingles, so MinHash bands over five-word shingles, then exact Jaccard similarity, add the rest:
links are added, none is taken away, and groups are the components of both.

In this part two texts link at a Jaccard similarity of min_similarity = 0.8 or more of their sets of WIDTH-word
shingles (words are cut at ASCII white space, A-Z lower-cased; a shorter text is one shingle). The
BANDS = 28 bands of ROWS = 6 minima miss a pair at 0.8 with a probability of (1 - 0.8**6)**28, 0.02 %.
Texts that share a band, directly or through others, are one candidate group; in it every link is found
from the shingles themselves, so nothing rests on the bands but what is compared.

At scale: equal texts are pre-aggregated to one node before anything is paired. A band's
members first meet only its smallest node, so candidate rows grow with the number of nodes; a group of near
copies is done then. Members that no chain of links connects with it yet are compared with all of their band,
by chunks of both sides. Chunks are dealt by hash, so no task holds more than about MEMBERS texts of either
side, however many rows one group has, and a task's links leave it as stars, not as pairs. Only members that
share a band but no link cost more than linear work.

Defined results: texts without words (null, empty, blank) are copies of each other. Of a group the row
with the smallest doc_id stays (null last, then by the text). Nodes are 64-bit hashes of the texts. An
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, free_name, trim, utf8
from .graph import components

WIDTH, BANDS, ROWS = 5, 28, 6
SEED = 42
#: Texts of one side that a task compares at a time, on the average.
MEMBERS = 256
#: Shingles that are permuted at a time.
BLOCK = 2048
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 64, BANDS, np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Of all shingles, in order."""
    import xxhash

    n = max(1, len(words) - WIDTH + 1)
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(WIDTH)), strict=True)) if len(words) >= WIDTH else [b" ".join(words)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), ">u8").astype(np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(low, (_A[:, None] * hashes[None, i : i + BLOCK] + _B[:, None]).min(axis=1), out=low)
    h = (low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND
    return ((h ^ (h >> np.uint64(31))) * _A[:BANDS]).view(np.int64)


def prints(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, node, fp (as op10's operator has it), bands; the text stays in the Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(2)]
            fp = pa.array(np.fromiter(map(simhash.simhash, texts), np.uint64, b.num_rows).view(np.int64))
            keys = [band_keys(shingle_hashes(words_of(t))) for t in texts]
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * b.num_rows + 1, BANDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, bands], names=["doc_id", "node", "fp", "bands"])
        trim()

    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), node_column(text).alias("node"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, node long, fp long, bands array<long>")


def node_column(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def near_pairs(left: list[np.ndarray], right: list[np.ndarray], min_similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs whose sets of distinct hashes have that Jaccard similarity at least."""
    sizes = np.array([len(s) for s in right])
    values, ids = np.unique(np.concatenate(right), return_inverse=True)
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(values), bool)
    a, b = [], []
    for i, s in enumerate(left):
        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
        at = at[values[at] == s]
        mark[at] = True
        both = np.add.reduceat(mark[ids], starts, dtype=np.int64)
        mark[at] = False
        near = np.flatnonzero(both >= min_similarity * (len(s) + sizes - both))
        a.append(np.full(len(near), i))
        b.append(near)
    return np.concatenate(a), np.concatenate(b)


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n things that pairs connect, the least that each is connected with."""
    least, before = np.arange(n), None
    while before is None or not np.array_equal(least, before):
        before = least.copy()
        m = np.minimum(least[a], least[b])
        np.minimum.at(least, a, m)
        np.minimum.at(least, b, m)
        least = least[least]
    return least


def dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """left, right: key, node. Adds i and j, so that each pair of a key meets in one (key, i, j), with about MEMBERS nodes of either side at most."""
    parts = lambda df, name: df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias(name))
    chunks = parts(left, "ni").join(parts(right, "nj"), "key")
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    return (
        left.join(chunks, "key").select("key", "node", of("ni").alias("i"), every("nj").alias("j")),
        right.join(chunks, "key").select("key", "node", every("ni").alias("i"), of("nj").alias("j")),
    )


def linked(left: DataFrame, right: DataFrame, texts: DataFrame, min_similarity: float) -> DataFrame:
    """left, right: key, node. Returns u, v: links that connect those nodes of a key, one of either side, that are similar; of a task's links a spanning star for each class is enough."""

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        sets = [[np.unique(shingle_hashes(words_of(t))) for t in side.column(4).to_pylist()] for side in (one, other)]
        a, b = near_pairs(*sets, min_similarity) if sets[0] and sets[1] else (np.zeros(0, np.int64),) * 2
        nodes = np.concatenate([one.column(3).to_numpy(), other.column(3).to_numpy()]).astype(np.int64)
        least = connected(len(nodes), a, b + len(sets[0]))
        apart = nodes != nodes[least]
        found = pa.table({"u": pa.array(nodes[apart]), "v": pa.array(nodes[least][apart])})
        if len(nodes) >= MEMBERS:  # small tables are many, and leave little
            del sets
            trim()
        return found

    one, other = (side.join(texts, "node").select("key", "i", "j", "node", "text") for side in dealt(left, right))
    other = other.toDF("key2", "i2", "j2", "node2", "text2")
    return one.groupBy("key", "i", "j").cogroup(other.groupBy("key2", "i2", "j2")).applyInArrow(compare, "u long, v long")


def fingerprint_links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """nodes: node, fp. Returns u, v: each node of a component of op10's operator, and the component's smallest node."""
    found = simhash.classes(nodes.select(F.col("node").alias("doc_id"), "fp"), max_bits).select("fp", F.col("component_id").alias("v"))
    return nodes.join(found, "fp").where("node <> v").select(F.col("node").alias("u"), "v")


def classes(scratch: Scratch, df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """node, least (its smallest doc_id), is_first: whether this node stands for its group."""
    nodes = scratch.keep(prints(df, doc_id, text).groupBy("node").agg(F.min("doc_id").alias("least"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))
    close = scratch.keep(fingerprint_links(nodes.select("node", "fp"), max_bits))
    postings = nodes.select("node", F.explode("bands").alias("key"))
    heads = postings.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head")
    postings = scratch.keep(postings.join(heads, "key"))
    asked = postings.select("node").distinct()
    texts = scratch.keep(df.select(node_column(text).alias("node"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(asked, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")))
    stars = postings.where("node <> head").select(F.col("head").alias("key"), "node").distinct()
    near = scratch.keep(linked(stars.select("key", F.col("key").alias("node")).distinct(), stars, texts, min_similarity).unionByName(close))
    # Members that the links so far don't connect with their band's smallest node.
    joined = scratch.keep(components(near))
    of = lambda name, root: joined.select(F.col("node").alias(name), F.col("root").alias(root))
    labelled = postings.where("node <> head").join(of("node", "r"), "node", "left").join(of("head", "s"), "head", "left")
    others = scratch.keep(labelled.where("coalesce(r, node) <> coalesce(s, head)").select("key", "node"))
    mates = postings.join(others.select("key").distinct(), "key", "left_semi").select("key", "node")
    far = linked(others, mates, texts, min_similarity)
    edges = near.unionByName(far).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    roots = components(edges).join(nodes.select("node", "least"), "node")
    order = F.struct(F.col("least").isNull(), F.col("least"), F.col("node"))
    first = roots.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.node").alias("first"))
    checked = roots.join(first, "root").select("node", (F.col("node") == F.col("first")).alias("is_first"))
    return nodes.select("node", "least").join(checked, "node", "left").select("node", "least", F.coalesce("is_first", F.lit(True)).alias("is_first"))


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """One row of each group, that with the smallest doc_id (null last), with all its columns."""
    scratch = Scratch(df.sparkSession, "near-duplicates")
    heads = scratch.last(classes(scratch, df, doc_id, text, min_similarity, max_bits).where("is_first").select(F.col("node").alias("_head")))
    name = free_name("_node", df.columns)
    order = F.struct(F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`")))
    rows = df.withColumn(name, node_column(text)).groupBy(name).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), order).alias("row"))
    return rows.join(heads, F.col(name) == F.col("_head"), "left_semi").select("row.*")
