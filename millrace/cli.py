"""Commands over Parquet files: python -m millrace.cli COMMAND --help."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import bm25, features, scoring, terms, topics
from .sources import tables


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The columns that topic searches read, found under their known names."""
    df = spark.read.parquet(path)
    name = {k: tables.resolve_column(df, None, v, k) for k, v in tables.CANDIDATES.items()}
    tags = T.tags_text_sql(F.col(name["tags"])) if "array" in df.schema[name["tags"]].dataType.simpleString() else F.col(name["tags"])
    return df.select("id", *(F.col(name[k]).alias(a) for k, a in (("title", "title"), ("description", "description"), ("channel", "channel"), ("parent", "parent_channel"))), tags.alias("tags"))


def _weights(args, fields) -> dict:
    return {f: getattr(args, f"{f}_weight") for f in fields}


def _out(df: DataFrame, path: str | None, show: int = 20) -> None:
    if path:
        tables.write_parquet(df, path)
    for r in tables.json_rows(df.limit(show)).collect():
        print(r["json"])


def bm25_build(spark, a):
    df = spark.read.parquet(a.input)
    base = bm25.base_table(df, {f: v for f in bm25.FIELDS if (v := getattr(a, f"{f}_column"))}, a.limit_rows)
    bm25.save(bm25.build(base), a.index, a.overwrite)


def bm25_query(spark, a):
    params = bm25.Bm25(weights=_weights(a, bm25.FIELDS))
    found = bm25.search(bm25.load(spark, a.index), a.terms, a.top_k, a.conjunctive, a.tokenize_query, params, a.include_info_columns)
    if a.output:
        tables.write_parquet(found, a.output)
    _out(bm25.as_lines(found, a.show_description_chars), None, a.top_k)


# The metrics' columns.
COLUMNS = {"view": "payload_viewCount", "like": "payload_likeCount", "comment": "payload_commentCountRealValue", "banana": "payload_bananaCount", "danmaku": "payload_danmakuCount", "stow": "payload_stowCount", "share": "payload_shareCount"}


# What is shown of a candidate beside its scores.
INFO = ("payload_title", "payload_description", "payload_channel_name", "payload_createTimeMillis")


def _scored(a, candidates):
    weights = {m: getattr(a, f"weight_{m}") for m in scoring.WEIGHTS}
    metrics = {m: c for m, c in COLUMNS.items() if c in candidates.columns}
    now = a.now_ms if a.now_ms is not None else int(time.time() * 1000)
    rows = scoring.decay(scoring.score(candidates, metrics, weights), a.created_column, now, a.half_life_days)
    return rows.withColumn("time_bucket", scoring.bucket(a.created_column, a.time_bucket))


def score_ids(spark, a):
    """output: all candidates, best first; selected_output: those that are selected, in their order."""
    ids = spark.read.parquet(a.ids)
    rows = scoring.load_candidates(ids, spark.read.parquet(a.flattened), "rank" if "rank" in ids.columns else None)
    scored = _scored(a, rows).persist()
    info = INFO if a.include_info_columns else ()
    top = scoring.select_top(scored, a.top_k, a.selection_mode, a.time_bucket, a.min_per_bucket, a.created_column).orderBy("sel_order")
    if a.output:
        tables.write_parquet(scoring.output_columns(scored, info).orderBy(F.desc("score"), F.desc("id")), a.output)
    _out(scoring.output_columns(top, info), a.selected_output)
    _out(scoring.distribution(top), None)


def score_subset(spark, a):
    """output: a CSV of every scored row, with its percentiles; the selection is shown."""
    df = spark.read.parquet(a.input)
    rows = tables.hash_sample(df, "id", a.limit_rows) if a.sample_method == "hash" else df.limit(a.limit_rows)
    scored = _scored(a, rows).persist()  # limit_rows at most
    top = scoring.select_top(scored, a.top_k, a.selection_mode, a.time_bucket, a.min_per_bucket, a.created_column).orderBy("sel_order")
    if a.output:
        flat = [c for c, t in scored.dtypes if not t.startswith(("array", "struct", "map"))]
        tables.write_csv(scored.select(*flat).orderBy(F.desc("score"), F.desc("id")), a.output)
    _out(scoring.output_columns(top), None, a.top_k)


def tfidf(spark, a):
    df = spark.read.parquet(a.input)
    title, description = (tables.resolve_column(df, getattr(a, f"{k}_column"), tables.CANDIDATES[k], k) for k in ("title", "description"))
    tables.write_parquet(features.tfidf(df, title, description, a.id_column, analyzer=a.analyzer, low=a.min_n, high=a.max_n, n_features=a.features), a.output)


def svd(spark, a):
    v = spark.read.parquet(a.input)
    n = a.features or features.count_features(v)[1]
    model = features.TruncatedSvd(a.components, a.n_iter, a.oversamples, a.random_state, a.max_block_mb).fit(v, n, a.fit_rows)
    print(f"explained variance: {model.explained:.6f}")
    tables.write_parquet(model.transform(v), a.output)


def sparse_topic(spark, a):
    hits = topics.sparse_topic(metadata(spark, a.metadata), spark.read.parquet(a.vectors), a.query, a.term_mode, a.seed_limit, a.top_k, a.min_score, a.exclude_seeds, a.seed_fields.split(","))
    _out(hits, a.output, a.show)


def vector_ingest(spark, a):
    points = tables.joined_points(metadata(spark, a.metadata), spark.read.parquet(a.vectors))
    print("ingested" if tables.VectorStore(spark, a.store).ingest(points, a.recreate, a.skip_existing) else "skipped")


def vector_topic(spark, a):
    a.vectors, points = None, tables.VectorStore(spark, a.store).read().select("id", "vector")
    _out(topics.sparse_topic(metadata(spark, a.metadata), points, a.query, a.term_mode, a.seed_limit, a.top_k, a.min_score, a.exclude_seeds, a.seed_fields.split(",")), a.output, a.show)


def dense_topic(spark, a):
    m, v = metadata(spark, a.metadata), spark.read.parquet(a.vectors)
    centroid, seeds = topics.build_centroid(m, v, a.query, a.term_mode, a.seed_limit, a.dimensions)
    if a.seed_output:
        tables.write_parquet(seeds, a.seed_output)
    if a.centroid_output:
        tables.write_parquet(centroid, a.centroid_output)
    if a.show_seeds:
        _out(topics.seed_preview(m, v, centroid, seeds, a.show_seeds), None)
    _out(topics.query_centroid(m, v, centroid, a.top_k, a.min_score, seeds, a.exclude_seeds), a.output)


def centroid_build(spark, a):
    centroid, seeds = topics.build_centroid(metadata(spark, a.metadata), spark.read.parquet(a.vectors), a.query, a.term_mode, a.seed_limit, a.dimensions)
    if a.seed_output:
        tables.write_parquet(seeds, a.seed_output)
    tables.write_parquet(centroid, a.centroid_output)


def centroid_query(spark, a):
    seeds = spark.read.parquet(a.seeds) if a.seeds else None
    _out(topics.query_centroid(metadata(spark, a.metadata), spark.read.parquet(a.vectors), spark.read.parquet(a.centroid), a.top_k, a.min_score, seeds, a.exclude_seeds), a.output)


def w2v_train(spark, a):
    df = spark.read.parquet(a.input)
    df = df.limit(a.limit_rows) if a.limit_rows else df
    title, description = (tables.resolve_column(df, None, tables.CANDIDATES[k], k) for k in ("title", "description"))
    model, counts = terms.train_word2vec(df, title, description, a.size, a.window, a.min_count, a.epochs, a.seed, a.sg, a.hs, a.negative, a.max_vocab, a.partitions, sample=a.sample)
    tables.write_parquet(terms.word_vectors(model, counts), a.output)


def w2v_terms(spark, a):
    found = terms.expand(spark, spark.read.parquet(a.model), a.terms, a.topn, a.min_score)
    _out(terms.keywords(found).orderBy("n") if a.keywords_only else found.orderBy("ord", "pos"), None, 10_000)


def graph(spark, a):
    words = spark.read.parquet(a.model)
    nodes, edges = terms.seed_graph(spark, words, a.terms, a.depth, a.topn, a.min_score) if a.terms else terms.vocabulary_graph(words, a.max_vocab, a.topn, a.min_score)
    n, e = terms.graph_csv(nodes, terms.dedupe_edges(edges, a.directed))
    tables.write_csv(n, f"{a.output_dir}/nodes", single=True)
    tables.write_csv(e, f"{a.output_dir}/edges", single=True)


def trend(spark, a):
    index, words = bm25.load(spark, a.index), spark.read.parquet(a.model)
    words_of = lambda t: " ".join(T.query_terms([t], tokenize=True)) if a.tokenize_query else t
    near = terms.neighbours(words, spark.createDataFrame([(a.term,)], "word string"), a.max_topk, a.min_score).orderBy("rank").collect()  # max_topk rows
    related, params = [(words_of(r["target"]), r["score"]) for r in near], bm25.Bm25(weights=_weights(a, bm25.FIELDS))
    out = terms.overlap_trend(index, spark, words_of(a.term), related, params) if a.command == "overlap-trend" else terms.expansion_trend(index, spark, words_of(a.term), related, params, a.conjunctive)
    if a.output:
        tables.write_csv(out, a.output, single=True)
    _out(out, None, a.max_topk + 1)
    _out(terms.best_step(out, "jaccard_ratio" if a.command == "overlap-trend" else "hit_count"), None)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name, run, **options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for key, value in options.items():
            flag = key if value is ... or value == "+" or value == "*" else f"--{key.replace('_', '-')}"
            if value is ...:
                p.add_argument(flag)
            elif value in ("+", "*") and isinstance(value, str):
                p.add_argument(flag, nargs=value)
            elif value is False:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=value, type=type(value) if value is not None and not isinstance(value, type) else (value or str))
                if isinstance(value, type):
                    p.set_defaults(**{key: None})
        return p

    weights = {f"{f}_weight": w for f, w in bm25.WEIGHTS.items()}
    metric_weights = {f"weight_{m}": w for m, w in scoring.WEIGHTS.items()}
    seeds = {"term_mode": "phrase", "exclude_seeds": False}
    fields = {"seed_fields": ",".join(topics.FIELDS)}
    select = {"half_life_days": 540.0, "selection_mode": "time-quota", "created_column": "payload_createTimeMillis", "now_ms": int}
    add("bm25-build", bm25_build, input=..., index=..., limit_rows=int, overwrite=False, **{f"{f}_column": str for f in bm25.FIELDS})
    add("bm25-query", bm25_query, index=..., terms="+", top_k=20, conjunctive=False, tokenize_query=False, include_info_columns=False, show_description_chars=120, output=str, **weights)
    add("score-ids", score_ids, ids=..., flattened=..., output=str, selected_output=str, include_info_columns=False, top_k=1000, time_bucket="month", min_per_bucket=1, **select, **metric_weights)
    add("score-subset", score_subset, input=..., output=str, limit_rows=20_000, sample_method="hash", top_k=30, time_bucket="year", min_per_bucket=0, **select, **metric_weights)
    add("tfidf", tfidf, input=..., output=..., id_column="id", title_column=str, description_column=str, features=1 << 20, analyzer="cjk_word", min_n=2, max_n=4)
    add("svd", svd, input=..., output=..., fit_rows=200_000, components=1024, n_iter=7, oversamples=32, random_state=42, features=int, max_block_mb=2048)
    add("sparse-topic", sparse_topic, query=..., metadata=..., vectors=..., output=str, seed_limit=20_000, top_k=100, min_score=0.15, show=20, **seeds, **fields)
    add("vector-ingest", vector_ingest, metadata=..., vectors=..., store=..., recreate=False, skip_existing=False)
    add("vector-topic", vector_topic, query=..., metadata=..., store=..., output=str, seed_limit=5000, top_k=100, min_score=0.15, show=20, **seeds, **fields)
    add("dense-topic", dense_topic, query=..., metadata=..., vectors=..., output=str, seed_limit=int, top_k=1000, min_score=0.0, show_seeds=5, dimensions=128, seed_output=str, centroid_output=str, **seeds)
    add("centroid-build", centroid_build, query=..., centroid_output=..., metadata=str, vectors=str, seed_limit=int, dimensions=128, seed_output=str, term_mode="phrase")
    add("centroid-query", centroid_query, centroid=..., metadata=..., vectors=..., output=str, seeds=str, top_k=1000, min_score=0.0, exclude_seeds=False)
    add("w2v-train", w2v_train, input=..., output=..., size=256, window=8, min_count=20, epochs=5, seed=42, sg=1, hs=0, negative=10, sample=1e-5, max_vocab=int, limit_rows=int, partitions=int)
    add("w2v-terms", w2v_terms, model=..., terms="+", topn=10, min_score=0.5, keywords_only=False)
    add("graph", graph, model=..., output_dir=..., terms="*", topn=10, min_score=0.7, depth=1, max_vocab=5000, directed=False)
    for name in ("expansion-trend", "overlap-trend"):
        add(name, trend, term=..., model=..., index=..., max_topk=20, min_score=0.5, conjunctive=False, tokenize_query=False, output=str, **weights)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main(sys.argv[1:])
