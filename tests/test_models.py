"""Word vectors trained with negative samples, neighbours by blocks, decomposition by stripes, quantiles from counts, and the commands that use them."""

import csv
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.operators import features, scoring, terms, word2vec


def word_rows(spark, rows):
    return spark.createDataFrame([(w, v, 1) for w, v in rows], "word string, vector array<float>, count long")


@pytest.mark.parametrize("asked_bytes,columns", [(64 << 20, 256), (40, 1)])
def test_neighbours_equal_all_pairs(spark, monkeypatch, asked_bytes, columns):
    monkeypatch.setattr(terms, "ASKED_BYTES", asked_bytes)
    monkeypatch.setattr(terms, "ASKED_COLUMNS", columns)
    rng = np.random.default_rng(0)
    rows = [(f"w{i:02d}", [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)] + [("zero", [0.0] * 3), ("none", None)]  # many ties
    asked = [f"w{i:02d}" for i in range(9)] + ["zero", "none", "nowhere"]
    want = []
    for s, x in rows:
        if s in asked and x and any(x):
            near = []
            for t, y in rows:
                if t != s and y and any(y):
                    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
                    near.append((-dot(y, x) / (dot(y, y) ** 0.5 * dot(x, x) ** 0.5), t))
            want += [(s, t, k + 1, -v) for k, (v, t) in enumerate(sorted(near)[:5]) if -v >= 0.3]
    found = terms.neighbours(word_rows(spark, rows).repartition(3), spark.createDataFrame([(w,) for w in asked], "word string"), 5, 0.3)
    got = [tuple(r) for r in found.select("source", "target", "rank", "score").orderBy("source", "rank").collect()]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=lambda w: (w[0], w[2]))]
    assert [g[3] for g in got] == [w[3] for w in sorted(want, key=lambda w: (w[0], w[2]))]


def test_neighbours_edges(spark):
    asked = spark.createDataFrame([("a",)], "word string")
    with pytest.raises(Exception, match="unequal"):
        terms.neighbours(word_rows(spark, [("a", [1.0, 0.0]), ("b", [1.0])]), asked).collect()
    assert terms.neighbours(word_rows(spark, []), asked).count() == 0
    assert terms.neighbours(word_rows(spark, [("a", [1.0])]), asked).count() == 0


@pytest.mark.parametrize("sg", [0, 1])
def test_training_finds_words_of_one_topic(spark, sg):
    rng = np.random.default_rng(1)
    topics = [[f"{t}{i}" for i in range(6)] for t in "abc"]
    rows = [(i, " ".join(rng.choice(topics[i % 3], 12)), "") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, title string, description string")
    fit = lambda: terms.train_word2vec(df, "title", "description", size=12, window=3, min_count=2, epochs=8, sg=sg, negative=5, sample=0.0, partitions=2)
    model, counts = fit()
    vectors = terms.word_vectors(model, counts).persist()
    near = terms.neighbours(vectors, vectors.select("word"), 5, -1.0).collect()
    assert len(near) == 90 and np.mean([r["source"][0] == r["target"][0] for r in near]) > 0.9
    assert np.array_equal(fit()[0].vectors, model.vectors)


def test_a_training_step_is_the_gradient():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((5, 3)), rng.standard_normal((5, 3))
    context, ok = np.array([[0, 1], [1, 3]]), np.array([[True, True], [True, False]])
    centre, wrong = np.array([2, 4]), np.array([[3, 2], [0, 1]])

    def loss(a, b):
        out = 0.0
        for c, use, z, bad in zip(context, ok, centre, wrong):
            h = a[c[use]].mean(axis=0)
            out -= np.log(1 / (1 + np.exp(-h @ b[z]))) + sum(np.log(1 / (1 + np.exp(h @ b[w]))) for w in bad if w != z)
        return out

    x, y = a.copy(), b.copy()
    word2vec.step(x, y, context, ok, centre, wrong, 1.0)
    for i in range(5):
        for d in range(3):
            up, down = b.copy(), b.copy()
            up[i, d] += 1e-6
            down[i, d] -= 1e-6
            assert y[i, d] - b[i, d] == pytest.approx(-(loss(a, up) - loss(a, down)) / 2e-6, abs=1e-6)
    one = slice(1, 2)  # with one context word the mean is the word, and its step is the gradient
    x, y = a.copy(), b.copy()
    word2vec.step(x, y, context[one], ok[one], centre[one], wrong[one], 1.0)
    h = a[1]
    g = sum(((k == 0) - 1 / (1 + np.exp(-h @ b[w]))) * b[w] for k, w in enumerate([4, 0, 1]))
    assert x[1] - a[1] == pytest.approx(g) and np.array_equal(np.delete(x, 1, 0), np.delete(a, 1, 0))


def test_training_edges(spark):
    assert word2vec.kept_share(np.array([1.0, 999.0]), 0.0).tolist() == [1, 1] and word2vec.kept_share(np.array([1.0, 999.0]), 1e-2)[1] < 0.2
    df = spark.createDataFrame([(1, "x", "")], "id long, title string, description string")
    model, counts = terms.train_word2vec(df, "title", "description", size=4)
    assert terms.word_vectors(model, counts).count() == 0
    with pytest.raises(ValueError):
        terms.train_word2vec(df, "title", "description", sg=0, hs=1)
    with pytest.raises(ValueError, match="cap the vocabulary"):
        word2vec.train(df.select(F.array("title").alias("tokens")), df.select(F.col("title").alias("word"), F.lit(1).alias("count")), 64, 2, 1, 1, max_mb=0)


def sparse(spark, dense):
    rows = [(i, ([int(k) for k in np.flatnonzero(r)], [float(x) for x in r[r != 0]])) for i, r in enumerate(dense)]
    return spark.createDataFrame(rows, "id long, vector struct<indices:array<int>,values:array<float>>")


def test_svd_by_stripes_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(features, "CELLS", 50)
    rng = np.random.default_rng(3)
    dense = (rng.standard_normal((40, 5)) @ rng.standard_normal((5, 400)) * (rng.random((40, 400)) < 0.3)).astype(np.float32).astype(float)
    dense[:, 17] = 0
    dense[4] = 0
    svd = features.TruncatedSvd(4, n_iter=30, oversamples=8)
    monkeypatch.setattr(svd, "_stripes", lambda height, width: [slice(k, min(k + 5, width)) for k in range(0, width, 5)])
    svd.fit(sparse(spark, dense), 1 << 20)
    assert 17 not in svd.active and svd.singular_values == pytest.approx(np.linalg.svd(dense)[1][:4], rel=1e-3)
    new = np.zeros((2, 500))
    new[0, [3, 17, 499]] = 1, 5, 7
    got = np.array([r["vector"] for r in svd.transform(sparse(spark, new)).orderBy("id").collect()])
    assert got[0] == pytest.approx(svd.v[np.searchsorted(svd.active, 3)], abs=1e-6) and not got[1].any()
    with pytest.raises(ValueError, match="over 0 MB"):
        features.TruncatedSvd(4, max_block_mb=0).fit(sparse(spark, dense), 400)


def test_stripes_are_bounded():
    stripes = features.TruncatedSvd(128, stripe_mb=64)._stripes(1 << 20, 160)
    assert max(s.stop - s.start for s in stripes) * (1 << 20) * 8 <= 64 << 20 and sum(s.stop - s.start for s in stripes) == 160


@pytest.mark.parametrize("n", [1, 2, 3, 100, 101, 250])
def test_quantile_equals_numpy(spark, n):
    x = np.random.default_rng(n).integers(0, 40, n).astype(float)
    df = spark.createDataFrame([(float(v), 0.0) for v in x], "a double, b double").repartition(3)
    got = scoring.log_clip_p99(df, {"a": "a", "b": "b"}).first()
    assert got["a"] == pytest.approx(np.quantile(np.log1p(x), 0.99)) and got["b"] == 0


def test_score_commands(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    rows = [(i, i * 3, i % 5, 1_600_000_000_000 + i * 86_400_000, f"t{i}") for i in range(50)]
    spark.createDataFrame(rows, "id long, payload_viewCount long, payload_likeCount long, payload_createTimeMillis long, payload_title string").write.parquet(path("all"))
    spark.range(30).write.parquet(path("ids"))
    cli.main(["score-subset", path("all"), "--output", path("csv"), "--top-k", "5", "--limit-rows", "40", "--now-ms", "1700000000000"])
    found = [r for f in glob.glob(path("csv/*.csv")) for r in csv.DictReader(open(f))]
    assert len(found) == 40 and {"view_norm", "like_norm", "score", "time_decay", "time_bucket"} <= set(found[0])
    cli.main(["score-ids", path("ids"), path("all"), "--output", path("o"), "--selected-output", path("s"), "--include-info-columns", "--top-k", "4", "--min-per-bucket", "0", "--now-ms", "1700000000000"])
    assert spark.read.parquet(path("o")).count() == 30 and spark.read.parquet(path("s")).count() == 4 and "payload_title" in spark.read.parquet(path("s")).columns


def test_word_and_centroid_commands(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    rows = [(i, "red fox" if i % 2 else "blue sea", "red fox runs" if i % 2 else "blue sea waves", "c", "p", "x") for i in range(40)]
    spark.createDataFrame(rows, "id long, title string, description string, channel string, parent_channel string, tags string").write.parquet(path("m"))
    cli.main(["w2v-train", path("m"), path("w"), "--size", "8", "--min-count", "2", "--epochs", "1", "--sample", "0", "--negative", "3"])
    assert {r["word"] for r in spark.read.parquet(path("w")).collect()} == {"red", "fox", "runs", "blue", "sea", "waves"}
    cli.main(["bm25-build", path("m"), path("i"), "--overwrite"])
    cli.main(["expansion-trend", "Fox", path("w"), path("i"), "--min-score", "-1", "--tokenize-query", "--output", path("t")])
    got = [r for f in glob.glob(path("t/*.csv")) for r in csv.DictReader(open(f))]
    assert got and got[0]["query_text"] == "fox"
    spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(40)], "id long, vector array<float>").write.parquet(path("v"))
    cli.main(["centroid-build", "red", path("c"), "--metadata", path("m"), "--vectors", path("v"), "--dimensions", "2", "--seed-output", path("s")])
    assert spark.read.parquet(path("c")).count() == 1 and spark.read.parquet(path("s")).count() == 20
