"""Each registered query against its SQL on the smallest tables; edge rows by hand."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.functions import text as T
from millrace.operators import bm25, features, scoring, terms, topics
from millrace.plans import catalogue
from millrace.sources import fixture, tables
from millrace.streaming import incremental

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def canon(rows):
    return sorted(repr(tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    listed = ", ".join(f'"{c}"' for c in columns)
    assert canon(tuple(r) for r in df.select(*columns).collect()) == canon(con.sql(f"select {listed} from ({catalogue.SQL[name]()})").fetchall())


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("text,want", [(None, []), ("  ", []), ("ABC v1.2-3 foo_bar", ["abc", "v1.2-3", "foo_bar"]), ("héllo", ["h", "llo"]), ("中文 abc中", ["中文", "abc", "中"]), ("かな漢字 ab", ["かな漢字", "ab", "漢字"]), ("字か x", ["字か", "x"]), ("!?", [])])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("x")), text) == want
    if text and text.strip():
        assert T.python_tokens(text) == want


def test_segmenters(spark):
    cut = lambda s: [s[i : i + 2] for i in range(0, len(s), 2)]
    assert one(spark, T.tokens(F.col("x"), segment_han=cut), "中文字 ab") == ["中文", "字", "ab"]
    assert one(spark, T.tokens(F.col("x"), segment_kana=str.split), "かな a1! 漢字") == ["かな", "a1", "漢字", "漢字"]


def test_tags(spark):
    kind = "array<struct<name:string>>"
    for value, plain, sql in [(None, "", ""), ([], "", ""), ([("a",), None, ("b",)], "a b", "a  b"), ([("a",), (None,), ("b",)], "a b", "a  b"), ([("",)], "", "")]:
        assert one(spark, T.tags_text(F.col("x")), value, kind) == plain
        assert one(spark, T.tags_text_sql(F.col("x")), value, kind) == sql


def test_query_arguments():
    assert T.normalize_query("  A \n b ") == ("a b", ["a", "b"])
    assert T.query_terms(["A b", " ", "a B", "c"]) == ["a b", "c"] and T.query_terms(["A-b c"], tokenize=True) == ["a-b", "c"]
    for bad in (lambda: T.normalize_query(" "), lambda: T.query_terms([" "]), lambda: T.query_terms(["!"], tokenize=True)):
        with pytest.raises(ValueError):
            bad()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, d, g, "p", "c") for i, t, d, g in rows], "id long, title string, description string, tags string, parent_channel string, channel string")


def test_bm25_edges(spark, tmp_path):
    index = bm25.build(bm25.base_table(docs(spark, [(1, "red fox", "fox", None), (2, "red", "fox", "x"), (3, None, "", "red fox"), (4, "blue", None, "")])))
    assert [r["id"] for r in bm25.search(index, ["red", "fox"], conjunctive=True).orderBy("id").collect()] == [1, 3]
    assert {r["id"] for r in bm25.search(index, ["red fox"]).collect()} == {1, 2, 3} and bm25.search(index, ["none"]).count() == 0
    assert bm25.match_ids(index, ["red"], bm25.Bm25(weights=dict.fromkeys(bm25.FIELDS, 0.0))).count() == 0
    a, b = (bm25.search(index, t).select("id", "total_score").collect() for t in (["red", "red"], ["red"]))
    assert a == b
    bm25.save(index, str(tmp_path / "i"))
    again = bm25.load(spark, str(tmp_path / "i"))
    assert bm25.search(again, ["fox"], info=True).collect() == bm25.search(index, ["fox"], info=True).collect()
    plan = bm25.search(again, ["fox"])._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [In" in plan.replace("IsNotNull(term), ", "") or "EqualTo(term,fox)" in plan


def test_bm25_append_counts_all_parts(spark, tmp_path):
    parts = docs(spark, [(i, "alpha common", "x", None) for i in range(10)]), docs(spark, [(i, "beta common", "x", None) for i in range(10, 13)])
    for k, part in enumerate(parts):
        bm25.save(bm25.build(bm25.base_table(part)), str(tmp_path / "i"), overwrite=k == 0)
    index = bm25.load(spark, str(tmp_path / "i"))
    assert bm25.search(index, ["alpha"]).count() == 10 and bm25.search(index, ["beta"]).count() == 3
    assert {r["term"]: r["df"] for r in index.term_stats.where("field = ''").collect()} == {"alpha": 10, "beta": 3, "common": 13, "x": 13, "c": 13, "p": 13}
    whole = bm25.search(bm25.build(bm25.base_table(parts[0].unionByName(parts[1]))), ["alpha", "common"]).select("id", "total_score").collect()
    assert bm25.search(index, ["alpha", "common"]).select("id", "total_score").collect() == whole


def test_stream_keeps_the_index(spark, tmp_path):
    rows = docs(spark, [(i, f"red w{i}", "fox " * i, "x") for i in range(6)])
    for part in (rows.where("id < 3"), rows.where("id >= 3")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.follow(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination(60)
    whole = bm25.search(bm25.build(bm25.base_table(rows)), ["red", "fox"]).select("id", "total_score").collect()
    assert bm25.search(incremental.load(spark, str(tmp_path / "index")), ["red", "fox"]).select("id", "total_score").collect() == whole


def test_scoring_edges(spark):
    df = spark.createDataFrame([(i, 5, v, t) for i, (v, t) in enumerate([(1, 0), (1, None), (None, 10**15), (-4, 0), (9, 1704067200000)])], "id long, a long, b long, create_ms long")
    got = {r["id"]: r for r in scoring.score(df, {"view": "a", "like": "b"}).collect()}
    assert {r["view_norm"] for r in got.values()} == {0.0}  # constant
    assert [got[i]["like_norm"] for i in range(5)] == [0.7, 0.7, 0.3, 0.3, 1.0]
    with pytest.raises(ValueError):
        scoring.score(df, {"view": "a"}, {"view": -1.0})
    aged = {r["id"]: r for r in scoring.decay(df.withColumn("score", F.lit(1.0)), "create_ms", 1704067200000, 540).collect()}
    assert aged[1]["age_days"] == 0 and aged[2]["age_days"] == 0 and aged[4]["time_decay"] == 1.0
    labels = lambda g: [r[0] for r in df.orderBy("id").select(scoring.bucket("create_ms", g)).collect()]
    assert labels("quarter")[0] == "1970-Q1" and labels("quarter")[1] == "unknown" and labels("quarter")[4] == "2024-Q1" and labels("month")[4] == "2024-01"
    with pytest.raises(ValueError):
        scoring.decay(df, "create_ms", 0, 0)


def brute_quota(counts, top_k, least):
    g = {b: min(least, n) for b, n in counts.items()}
    rest, slots = {b: n - g[b] for b, n in counts.items()}, top_k - sum(g.values())
    if slots <= 0 or not sum(rest.values()):
        return g
    e = {b: r / sum(rest.values()) * slots for b, r in rest.items()}
    out = {b: g[b] + int(e[b]) for b in g}
    for b in sorted((b for b in rest if rest[b]), key=lambda b: (-(e[b] - int(e[b])), b))[: slots - sum(map(int, e.values()))]:
        out[b] += 1
    return out


@pytest.mark.parametrize("counts,k,least", [({"a": 5, "b": 5, "c": 5}, 7, 1), ({"a": 1}, 3, 0), ({"a": 2, "b": 100}, 10, 3), ({"a": 2, "b": 2}, 4, 2)])
def test_quotas(spark, counts, k, least):
    df = spark.createDataFrame(list(counts.items()), "bucket string, n long")
    assert {r["bucket"]: r["quota"] for r in scoring.quotas(df, k, least).collect()} == brute_quota(counts, k, least)


def test_quotas_above_top_k_are_an_error(spark):
    with pytest.raises(Exception, match="above top_k"):
        scoring.quotas(spark.createDataFrame([("a", 3), ("b", 3)], "bucket string, n long"), 1, 1).collect()
    with pytest.raises(ValueError):
        scoring.quotas(spark.createDataFrame([("a", 3)], "bucket string, n long"), 1, -1)


def test_candidates_are_distinct(spark):
    ids = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (9, 3, "c")], "id long, rank long, s string")
    cat = spark.createDataFrame([(1, "t", "z"), (2, "u", "z")], "id long, title string, s string")
    assert [tuple(r) for r in scoring.load_candidates(ids, cat, "rank").collect()] == [(1, 1, "a", "t")]


def test_features(spark):
    df = spark.createDataFrame([(1, "a b a b", ""), (2, "solo", None), (3, "a b", "c")], "id long, title string, description string")
    t = {(r["id"], r["key"]): r for r in features.tfidf_terms(df, T.combine_text(F.col("title"), F.col("description")), n_features=None).collect()}
    assert t[1, "a b"]["tf"] == 2 and t[1, "a b"]["df"] == 2 and not any(k[0] == 2 for k in t)
    assert sum(r["weight"] ** 2 for k, r in t.items() if k[0] == 1) == pytest.approx(1)
    v = features.tfidf(df, "title", "description", low=1, high=2, n_features=64)
    got = {r["id"]: r["vector"] for r in v.collect()}
    assert len(got) == 3 and got[1]["indices"] == sorted(got[1]["indices"]) and features.count_features(v)[0] == 3
    assert [r["g"] for r in df.limit(1).select(F.explode(features.char_ngrams(F.lit("ab c"), 2, 2)).alias("g")).collect()] == ["ab", "b ", " c"]
    assert [r["g"] for r in df.limit(1).select(F.explode(features.char_ngrams(F.lit("ab c"), 3, 3, True)).alias("g")).collect()] == [" ab", "ab ", " c "]


def test_hashed_vectors_equal_joined_ones(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b a b", ""), (2, "solo", None), (3, "a b", "c"), (4, None, None), (5, "a b a b c d e f", "b a")], "id long, title string, description string").repartition(3)
    narrow = features.tfidf(df, "title", "description", low=1, high=3, n_features=32)
    assert "Exchange" not in narrow.drop("id")._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "").split("MapInArrow")[0]
    monkeypatch.setattr(features, "MAX_FEATURES", 1)
    wide = features.tfidf(df, "title", "description", low=1, high=3, n_features=32)
    a, b = ({r["id"]: r["vector"] for r in v.collect()} for v in (narrow, wide))
    assert a.keys() == b.keys() == {1, 2, 3, 4, 5}
    for i in a:
        assert a[i]["indices"] == b[i]["indices"] and a[i]["values"] == pytest.approx(b[i]["values"], abs=1e-6)


def test_sparse_nearest_joined_or_sent(spark, monkeypatch):
    vectors = spark.createDataFrame([(1, ([0, 3], [0.5, 0.5])), (2, ([7], [1.0])), (3, ([], [])), (4, ([3], [1.0]))], "id long, vector struct<indices: array<int>, values: array<float>>")
    centroid = spark.createDataFrame([(0, 0.6), (3, 0.8)], "idx int, weight double")
    sent = topics.sparse_nearest(vectors, centroid, 10, 0.0).collect()
    monkeypatch.setattr(topics, "MAX_FEATURES", 1)
    assert [(r["id"], pytest.approx(r["score"])) for r in topics.sparse_nearest(vectors, centroid, 10, 0.0).collect()] == [tuple(r) for r in sent]


def test_svd_finds_the_subspace(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    dense = rng.standard_normal((60, 3)) @ rng.standard_normal((3, 20))
    df = spark.createDataFrame([(i, (list(range(20)), [float(x) for x in r])) for i, r in enumerate(dense)], "id long, vector struct<indices:array<int>,values:array<float>>")
    svd = features.TruncatedSvd(3, n_iter=4, oversamples=4).fit(df, 20)
    assert svd.singular_values == pytest.approx(np.linalg.svd(dense)[1][:3], rel=1e-4) and svd.explained == pytest.approx(1, abs=1e-4)
    got = np.array([r["vector"] for r in svd.transform(df).orderBy("id").collect()])
    assert got @ got.T == pytest.approx(dense @ dense.T, abs=1e-3)
    with pytest.raises(ValueError):
        features.TruncatedSvd(100).fit(df, 200)


def test_topic_edges(spark):
    m = spark.createDataFrame([(i, f"t{i} red", "", "c", "p", "") for i in range(3)], "id long, title string, description string, channel string, parent_channel string, tags string")
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (7, [1.0, 0.0])], "id long, vector array<float>")
    got = topics.dense_topic(m, v, "t0", dimensions=2).collect()
    assert [r["id"] for r in got] == [0, 2]  # the zero vector and the id without metadata are left out
    with pytest.raises(ValueError):
        topics.query_centroid(m, v, v, exclude_seeds=True)
    with pytest.raises(ValueError):
        topics.find_seeds(m, "x", fields=["nope"])
    with pytest.raises(Exception, match="unequal"):
        topics.nearest(v, spark.createDataFrame([([1.0],)], "vector array<float>"), 1, 0.0).collect()


def test_vector_store(spark, tmp_path):
    store = tables.VectorStore(spark, str(tmp_path / "s"))
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert store.ingest(p) and not store.ingest(p, skip_existing=True, recreate=True)
    assert store.ingest(p.where("id = 1").withColumn("v", F.lit("new")))
    assert sorted(tuple(r) for r in store.read().collect()) == [(1, "new"), (2, "b")]
    assert store.ingest(spark.createDataFrame([(2, "x"), (2, "y"), (2, "z")], "id long, v string").coalesce(1))
    assert sorted(tuple(r) for r in store.read().collect()) == [(1, "new"), (2, "z")]
    assert store.ingest(p.limit(1), recreate=True) and store.read().count() == 1
    with pytest.raises(Exception, match="different ids"):
        tables.joined_points(p, p.where("id = 1").withColumn("vector", F.lit(1))).collect()


def test_graph_depth(spark):
    vec = {"a": [1.0, 0.0], "b": [0.9, 0.1], "c": [0.6, 0.5], "d": [0.1, 1.0]}
    w = spark.createDataFrame([(k, x, i) for i, (k, x) in enumerate(vec.items())], "word string, vector array<float>, count long")
    for depth in (0, 1):
        nodes, edges = terms.seed_graph(spark, w, ["a", "zz"], depth, 1, 0.1)
        assert edges.count() == depth + 1 and {r["name"] for r in nodes.where("is_seed").collect()} == {"a"}
    both = terms.dedupe_edges(terms.vocabulary_graph(w, 4, 1, 0.1)[1]).collect()
    assert all(r["source"] < r["target"] for r in both)


def test_cli_bm25(spark, tmp_path, capsys):
    docs(spark, [(1, "red", "fox", "x"), (2, "blue", "fox", "y")]).write.parquet(str(tmp_path / "d"))
    cli.main(["bm25-build", str(tmp_path / "d"), str(tmp_path / "i"), "--overwrite"])
    cli.main(["bm25-query", str(tmp_path / "i"), "fox", "--top-k", "1", "--output", str(tmp_path / "o")])
    assert '"id":2' in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "o")).count() == 1


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert fixture.catalogue(spark, DATA).count() == 200
