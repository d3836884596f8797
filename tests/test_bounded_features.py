"""Hashed vectors are weighted in runs of bounded size, and a decomposition makes its vectors once."""

import numpy as np
import pyarrow as pa

from millrace.operators import features
from millrace.plans import catalogue


def test_runs_hold_a_bounded_number_of_keys():
    sizes = [3, 0, 4, 9, 1, 1, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([[1] * n for n in sizes], pa.list_(pa.int32()))], names=["id", "keys"])
    runs = [r.column(0).to_pylist() for r in features._runs(batch, 1, 5)]
    assert sum(runs, []) == list(range(7)) and all(len(r) == 1 or sum(sizes[i] for i in r) <= 5 for r in runs)
    assert list(features._runs(batch.slice(0, 0), 1, 5)) == []


def test_vectors_do_not_depend_on_runs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(list("abcdefg"), i % 9)), None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, title string, description string").coalesce(1)
    read = lambda: [tuple(r) for r in features.tfidf(df, "title", "description", n_features=1 << 10).orderBy("id").collect()]
    whole = read()
    monkeypatch.setattr(features, "KEYS", 7)
    assert read() == whole and len(whole) == 60


def test_a_decomposition_reads_texts_once(spark):
    plan = catalogue.svd_vectors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "/vectors-" in plan
