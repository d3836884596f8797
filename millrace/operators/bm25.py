"""Weighted multi-field BM25 over an inverted index of three tables.

postings (field, term, id, tf), doc_stats (id, length, a length a field) and term_stats (field, term, df).
Postings are made and kept as blocks (term, field, ids, tfs): what one run of documents has of a term and field, so
that a shuffle carries a term once a run, not once a posting, and nothing is sorted by posting.
A query filters blocks by its terms (pushed to the Parquet scan, whose files are sorted by term), joins
the few matching terms' statistics as a broadcast bounded by the query, and sums each document's fields
in one aggregation. Okapi BM25 with the non-negative idf; the statistics cover the whole index, or each field.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables

FIELDS = ("title", "description", "tags", "parent", "channel")
# The weights of the fields.
WEIGHTS = {"title": 3.0, "description": 1.0, "tags": 4.0, "parent": 1.5, "channel": 2.0}
#: Bytes of tokens in a run of documents, one document at least.
RUN_BYTES = 16 << 20
BLOCK = "term string, field string, ids array<bigint>, tfs array<bigint>, df bigint, new bigint, tokens bigint"


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    scope: str = "index"  # or "field": where df, length and mean length are counted
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))


@dataclass
class Index:
    base: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    blocks: DataFrame | None = None


def base_table(df: DataFrame, columns: Mapping[str, str] | None = None, limit: int | None = None, id_column: str = "id", **segmenters) -> DataFrame:
    """id, five text fields, and the tokens of each joined by spaces."""
    given = dict(columns or {})
    name = {f: tables.resolve_column(df, given.get(f), tables.CANDIDATES[f], f) for f in FIELDS}
    rows = df.limit(limit) if limit is not None else df
    texts = {f: T.tags_text(F.col(c)) if f == "tags" and "array" in df.schema[c].dataType.simpleString() else T.strip(F.coalesce(F.col(c), F.lit(""))) for f, c in name.items()}
    rows = rows.select(F.col(id_column).cast("long").alias("id"), *(texts[f].alias(f) for f in FIELDS))
    return rows.select("*", *(T.join_tokens(F.col(f), **segmenters).alias(f"{f}_terms") for f in FIELDS))


def build(base: DataFrame) -> Index:
    """Rows that share an id are one document to postings. The ids are read at once, to see whether there are such rows."""
    found = blocks(_one_row_an_id(base))
    lists = base.select("id", *(F.filter(F.split(f"{f}_terms", r"\s+"), lambda t: t != "").alias(f) for f in FIELDS))
    doc_stats = lists.select("id", *(F.size(f).cast("long").alias(f"len_{f}") for f in FIELDS)).withColumn("length", sum((F.col(f"len_{f}") for f in FIELDS), F.lit(0)))
    return Index(base, unpacked(found), doc_stats, block_statistics(found), found)


def _repeated(ids: DataFrame) -> DataFrame:
    return ids.groupBy("id").count().where("count > 1").select("id")


def _one_row_an_id(base: DataFrame) -> DataFrame:
    """id and terms; rows that share an id, if there are any, are joined."""
    names = [f"{f}_terms" for f in FIELDS]
    rows, again = base.select("id", *names), _repeated(base)
    if again.isEmpty():
        return rows
    shared = rows["id"].eqNullSafe(again["id"])
    merged = rows.join(again, shared, "left_semi").groupBy("id").agg(*(F.concat_ws(" ", F.collect_list(n)).alias(n) for n in names))
    return rows.join(again, shared, "left_anti").unionByName(merged)


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows of distinct ids: a task's runs of documents, each of which gives a row a term and field.

    df is the number of ids, new the number of those (not null) that have the term in no earlier field, tokens the sum of tfs.
    """
    return rows.mapInArrow(_blocks, BLOCK)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]), np.zeros(batch.num_rows, np.int64))
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + RUN_BYTES, "right")))
            if (found := _run(batch.slice(at, stop - at))) is not None:
                yield found
            at = stop


def _run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    words, row, field_no = [], [], []
    for k, column in enumerate(batch.columns[1:]):
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        flat = lists.flatten()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        words.append(flat.filter(pa.array(real)))
        row.append(np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))[real])
        field_no.append(np.full(len(row[-1]), k))
    encoded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    code, n, m = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.num_rows, len(FIELDS)
    if not len(code):
        return None
    cells, tf = np.unique((code * n + np.concatenate(row)) * m + np.concatenate(field_no), return_counts=True)
    pair, which = np.divmod(cells, m)
    new = np.r_[True, pair[1:] != pair[:-1]] & batch.column(0).is_valid().to_numpy(zero_copy_only=False)[pair % n]
    group = pair // n * m + which
    order = np.argsort(group, kind="stable")
    group, tf = group[order], tf[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    offsets = pa.array(np.r_[starts, len(group)].astype(np.int32))
    ids = batch.column(0).take(pa.array(pair[order] % n))
    term, which = np.divmod(group[starts], m)
    columns = [
        encoded.dictionary.take(pa.array(term)), pa.array(np.array(FIELDS, object)[which], pa.string()), pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(tf)),
        pa.array(np.diff(np.r_[starts, len(group)])), pa.array(np.add.reduceat(new[order].astype(np.int64), starts)), pa.array(np.add.reduceat(tf, starts)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "field", "ids", "tfs", "df", "new", "tokens"])


def unpacked(found: DataFrame) -> DataFrame:
    """term, id, field, tf: a row a posting."""
    pairs = found.select("term", "field", F.explode(F.arrays_zip("ids", "tfs")).alias("p"))
    return pairs.select("term", F.col("p.ids").alias("id"), "field", F.col("p.tfs").alias("tf"))


def term_statistics(postings: DataFrame) -> DataFrame:
    """field, term, df; the field '' counts documents with the term anywhere."""
    by_field = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    anywhere = postings.groupBy("term").agg(F.count_distinct("id").alias("df")).select(F.lit("").alias("field"), "term", "df")
    return by_field.unionByName(anywhere)


def block_statistics(found: DataFrame) -> DataFrame:
    """term_statistics from the sums of blocks in which no document comes twice."""
    sums = F.explode(F.array(F.struct("field", "df"), F.struct(F.lit("").alias("field"), F.col("new").alias("df")))).alias("x")
    return found.select("term", sums).groupBy("x.field", "term").agg(F.sum("x.df").alias("df")).where("df > 0")


def term_counts(index: Index) -> DataFrame:
    """field, term, df, tf of the whole index."""
    if index.blocks is not None:
        return index.blocks.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tf"))
    return index.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def save(index: Index, path: str, overwrite: bool = True) -> None:
    """Blocks lie by term, sorted by it in each file, so a query's filter skips pages and row groups.

    The base is written first, a part a call, and the rest is made from what was written, so texts are tokenised once.
    Without overwrite the part is added to an index that is there, and the statistics are made again from all its blocks.
    """
    spark, mode = index.base.sparkSession, "overwrite" if overwrite else "append"
    if overwrite:
        tables.remove(spark, f"{path}/base")
    part = f"{path}/base/part=p{uuid.uuid4().hex}"
    tables.write_parquet(index.base, part)
    stored = build(spark.read.schema(index.base.schema).parquet(part))
    tables.write_parquet(stored.blocks.repartition("term").sortWithinPartitions("term", "field"), f"{path}/blocks", mode)
    tables.write_parquet(stored.doc_stats, f"{path}/doc_stats", mode)
    found = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # Parts that share ids can't be summed: their documents are counted one by one.
    stats = block_statistics(found) if overwrite or _repeated(spark.read.parquet(f"{path}/doc_stats")).isEmpty() else term_statistics(unpacked(found))
    tables.write_parquet(stats.repartitionByRange("term").sortWithinPartitions("term"), f"{path}/term_stats", "overwrite")


def load(spark: SparkSession, path: str) -> Index:
    base, found, doc_stats, term_stats = (spark.read.parquet(f"{path}/{n}") for n in ("base", "blocks", "doc_stats", "term_stats"))
    return Index(base.drop("part"), unpacked(found), doc_stats, term_stats, found)


def effective_terms(entries: Sequence[str]) -> list[str]:
    """What the index looks up: a phrase is cut at its spaces."""
    return list(dict.fromkeys(t for e in entries for t in e.split()))


def _idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_scores(index: Index, terms: Sequence[str], p: Bm25) -> DataFrame:
    """id, field, term, s: a row a posting of the terms."""
    hits = index.postings.where(F.col("term").isin(list(terms)))
    stats = index.term_stats.where(F.col("term").isin(list(terms)))
    means = index.doc_stats.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("m"), *(F.avg(f"len_{f}").alias(f"m_{f}") for f in FIELDS))
    if p.scope == "index":
        stats = stats.where(F.col("field") == "").select("term", "df")
        on, length, mean = ["term"], F.col("length"), F.col("m")
    else:
        stats = stats.where(F.col("field") != "")
        pick = lambda prefix: F.coalesce(*(F.when(F.col("field") == f, F.col(f"{prefix}_{f}")) for f in FIELDS))
        on, length, mean = ["field", "term"], pick("len"), pick("m")
    joined = hits.join(F.broadcast(stats), on).join(index.doc_stats, "id").join(F.broadcast(means))  # stats: a few rows a query term; means: one row
    relative = F.when(mean > 0, length / mean).otherwise(0.0)
    score = _idf(F.col("df"), F.col("n")) * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * relative))
    return joined.select("id", "field", "term", score.alias("s"))


def field_scores(index: Index, terms: Sequence[str], p: Bm25, conjunctive: bool = False) -> DataFrame:
    """id and a score a field, null where it doesn't match, for documents that match in one field at least."""
    scores = term_scores(index, terms, p)
    whole = len(terms)
    out = []
    for f in FIELDS:
        here = F.col("field") == f
        s = F.sum(F.when(here, F.col("s")))
        out.append((F.when(F.sum(F.when(here, 1)) == whole, s) if conjunctive else s).alias(f"{f}_score"))
    rows = scores.groupBy("id").agg(*out)
    return rows.where(F.coalesce(*(F.col(f"{f}_score") for f in FIELDS)).isNotNull())


def total(p: Bm25) -> Column:
    return sum((F.coalesce(F.col(f"{f}_score"), F.lit(0.0)) * float(p.weights[f]) for f in FIELDS), F.lit(0.0))


def search(index: Index, args: Sequence[str], top_k: int = 20, conjunctive: bool = False, tokenize: bool = False, params: Bm25 = Bm25(), info: bool = False) -> DataFrame:
    """The top_k by total score, then id, both descending, with their ranks."""
    entries = T.query_terms(args, tokenize)
    rows = field_scores(index, effective_terms(entries), params, conjunctive).withColumn("total_score", total(params))
    # Equal documents tie, whatever order their sums were taken in: scores are compared to nine places.
    order = [F.desc(F.round("total_score", 9)), F.desc("id")]
    top = rows.orderBy(*order).limit(top_k)
    rank = F.row_number().over(W.orderBy(*order)).cast("long")  # over top_k rows
    out = top.select(rank.alias("rank"), "id", F.lit(" ".join(entries)).alias("query_text"), F.array(*map(F.lit, entries)).alias("query_terms"), "total_score", *(f"{f}_score" for f in FIELDS))
    if info:
        named = index.base.select("id", "title", "description", "tags", F.col("parent").alias("parent_channel"), "channel")
        out = out.join(named, "id", "left").select(*out.columns, *named.columns[1:])
    return out


def match_ids(index: Index, terms: Sequence[str], params: Bm25 = Bm25(), conjunctive: bool = False) -> DataFrame:
    """Ids whose weighted total is above 0."""
    return field_scores(index, terms, params, conjunctive).where(total(params) > 0).select("id")


def as_lines(found: DataFrame, chars: int = 120) -> DataFrame:
    """For display: scores rounded, the description cut."""
    shown = [F.round(c, 6).alias(c) if c.endswith("_score") else T.preview(F.col(c), chars).alias(c) if c == "description" else F.col(c) for c in found.columns]
    return found.select(*shown)
