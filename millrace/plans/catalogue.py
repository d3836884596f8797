"""The registered queries of the library's own operators, and the SQL each is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, features, scoring, terms, topics
from ..sources import fixture, tables

TOKEN = "[0-9a-z]+(?:[._+-][0-9a-z]+)*"
METRICS = {m: f"{m}_count" for m, _, _ in fixture.METRICS}
QUERY = ["the", "of thonre", "src3", "en"]
RELATED = [("and", 0.91), ("thing", 0.84), ("in", 0.72), ("der", 0.66), ("de la", 0.58), ("nowhereatall", 0.51)]
TOPIC = "the or"
SEED_TERMS = ["v3", "v17", "v250", "not-there"]
FLAGSHIP = "bm25_search"
QUERIES: dict = {}
SQL: dict = {}


def _query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql if callable(sql) else lambda: sql
        return f

    return add


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.catalogue(spark, sf_dir)


_SAVED: dict[tuple[str, str], str] = {}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The index of the catalogue, built and saved in the shared folder once an application, then opened."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SAVED:
        path = _folder(spark, "bm25")
        bm25.save(bm25.build(bm25.base_table(_catalogue(spark, sf_dir))), path)
        _SAVED[key] = path
    return bm25.load(spark, _SAVED[key])


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalogue(spark, sf_dir)
    return c.select("id", F.col("payload_title").alias("title"), F.col("payload_description").alias("description"), F.col("payload_channel_name").alias("channel"), F.col("payload_channel_parentName").alias("parent_channel"), T.tags_text_sql(F.col("payload_tagList")).alias("tags"))


# Tokens and text fields


@_query(f"SELECT doc_id AS id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents)")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalogue(spark, sf_dir).select("id", T.tokens(F.col("payload_description")).alias("t"))
    return rows.select("id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@_query("""SELECT doc_id AS id, lang AS tags, lower(split_part(text, chr(10), 1) || chr(10) || text || chr(10) || source) AS hay_text,
  CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS preview,
  contains(lower(text), 'the or') AS phrase, contains(lower(text), 'the') AND contains(lower(text), 'or') AS all_terms, contains(lower(text), 'the') OR contains(lower(text), 'or') AS any_terms,
  lower(text) LIKE '%th_ or%' AS wild FROM documents""")
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalogue(spark, sf_dir)
    low = F.lower("payload_description")
    return c.select(
        "id", T.tags_text(F.col("payload_tagList")).alias("tags"), T.haystack([F.col("payload_title"), F.col("payload_description"), F.col("payload_channel_name")]).alias("hay_text"), T.preview(F.col("payload_description"), 40).alias("preview"),
        T.matches(low, "the or", ["the", "or"], "phrase").alias("phrase"), T.matches(low, "the or", ["the", "or"], "all").alias("all_terms"), T.matches(low, "the or", ["the", "or"], "any").alias("any_terms"), T.matches(low, "th_ or", [], "phrase", like=True).alias("wild"),
    )


# BM25


def _postings_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT id, '{f}' AS field, unnest(regexp_extract_all(lower({f}), '{TOKEN}')) AS term FROM cat" for f in bm25.FIELDS)
    lens = ", ".join(f"len(regexp_extract_all(lower({f}), '{TOKEN}')) AS len_{f}" for f in bm25.FIELDS)
    return f"""{fixture.catalogue_sql()}, p AS (SELECT id, field, term, count(*) AS tf FROM ({parts}) GROUP BY ALL),
lens AS (SELECT *, {" + ".join(f"len_{f}" for f in bm25.FIELDS)} AS length FROM (SELECT id, {lens} FROM cat))"""


def _scores_sql(entries: list[str], conjunctive: bool = False, scope: str = "index") -> str:
    words = list(dict.fromkeys(t for e in entries for t in e.split()))
    listed = ", ".join(f"'{w}'" for w in words)
    if scope == "index":
        stats = "df AS (SELECT term, count(DISTINCT id) AS df FROM p GROUP BY term), m AS (SELECT count(*) AS n, avg(length) AS mean FROM lens)"
        joined = "p JOIN df USING (term) JOIN lens USING (id) CROSS JOIN m"
        length = "length"
    else:
        by = " UNION ALL ".join(f"SELECT id, '{f}' AS field, len_{f} AS flen FROM lens" for f in bm25.FIELDS)
        stats = f"df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL), fl AS ({by}), m AS (SELECT field, count(*) AS n, avg(flen) AS mean FROM fl GROUP BY field)"
        joined = "p JOIN df USING (field, term) JOIN fl USING (id, field) JOIN m USING (field)"
        length = "flen"
    enough = f"CASE WHEN count(*) FILTER (field = '{{0}}') = {len(words)} THEN sum(s) FILTER (field = '{{0}}') END" if conjunctive else "sum(s) FILTER (field = '{0}')"
    fields = ", ".join(f"{enough.format(f)} AS {f}_score" for f in bm25.FIELDS)
    total = " + ".join(f"{w} * coalesce({f}_score, 0)" for f, w in bm25.WEIGHTS.items())
    return f"""{_postings_sql()}, {stats},
s AS (SELECT id, field, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * {length} / mean)) AS s FROM {joined} WHERE term IN ({listed})),
f AS (SELECT id, {fields} FROM s GROUP BY id),
t AS (SELECT *, {total} AS total_score FROM f WHERE coalesce({", ".join(f"{f}_score" for f in bm25.FIELDS)}) IS NOT NULL)"""


def _search_sql(entries: list[str], k: int, **options) -> str:
    shown = ", ".join(f"round({f}_score, 6) AS {f}_score" for f in bm25.FIELDS)
    return f"WITH {_scores_sql(entries, **options)} SELECT row_number() OVER (ORDER BY round(total_score, 9) DESC, id DESC) AS rank, id, round(total_score, 6) AS total_score, {shown} FROM t ORDER BY rank LIMIT {k}"


def _search(found: DataFrame) -> DataFrame:
    return found.select("rank", "id", _r("total_score"), *(_r(f"{f}_score") for f in bm25.FIELDS))


@_query(lambda: _search_sql(QUERY, 50))
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(bm25.search(_index(spark, sf_dir), QUERY, 50))


@_query(lambda: _search_sql(["the", "and"], 50, conjunctive=True))
def bm25_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(bm25.search(_index(spark, sf_dir), ["the", "and"], 50, conjunctive=True))


@_query(lambda: _search_sql(QUERY, 50, scope="field"))
def bm25_field_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(bm25.search(_index(spark, sf_dir), QUERY, 50, params=bm25.Bm25(scope="field")))


@_query(lambda: f"WITH {_scores_sql(['thonre', 'la', 'src1'])} SELECT id FROM t WHERE total_score > 0")
def bm25_match_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.match_ids(_index(spark, sf_dir), ["thonre", "la", "src1"])


@_query(lambda: f"WITH {_postings_sql()} SELECT field, df, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens FROM (SELECT field, term, count(*) AS df, sum(tf) AS tf FROM p GROUP BY ALL) GROUP BY field, df")
def bm25_index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bm25.term_counts(_index(spark, sf_dir))
    return p.groupBy("field", "df").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))


@_query(lambda: _search_sql(QUERY, 50))
def bm25_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is saved in two parts."""
    base, path = bm25.base_table(_catalogue(spark, sf_dir)), _folder(spark, "bm25")
    bm25.save(bm25.build(base.where("id % 3 <> 0")), path)
    bm25.save(bm25.build(base.where("id % 3 = 0")), path, overwrite=False)
    return _search(bm25.search(bm25.load(spark, path), QUERY, 50))


@_query(lambda: f"WITH {_postings_sql()} SELECT field, term, count(*) AS df FROM p GROUP BY ALL UNION ALL SELECT '' AS field, term, count(DISTINCT id) AS df FROM p GROUP BY term")
def bm25_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).term_stats.select("field", "term", "df")


# Scores and selection


def _norm_sql() -> str:
    xs = ", ".join(f"ln(1 + greatest(coalesce({m}_count::DOUBLE, 0), 0)) AS x_{m}" for m in METRICS)
    norms = ", ".join(f"CASE WHEN quantile_cont(x_{m}, 0.99) OVER () > 0 AND min(x_{m}) OVER () < max(x_{m}) OVER () THEN (rank() OVER (ORDER BY x_{m}) + (count(*) OVER (PARTITION BY x_{m}) - 1) / 2) / count(*) OVER () ELSE 0 END AS {m}_norm" for m in METRICS)
    total = sum(scoring.WEIGHTS.values())
    weighted = " + ".join(f"{w} * {m}_norm" for m, w in scoring.WEIGHTS.items())
    return f"{fixture.catalogue_sql()}, x AS (SELECT id, create_ms, {xs} FROM cat), n AS (SELECT id, create_ms, {norms} FROM x), sc AS (SELECT *, ({weighted}) / {total} AS raw FROM n)"


def _decay_sql() -> str:
    ms, now, day = "make_timestamp(create_ms * 1000)", fixture.NOW_MS, scoring.DAY_MS
    return f"""{_norm_sql()}, dc AS (SELECT id, raw AS score_before_decay, greatest(({now} - coalesce(create_ms, {now})) / {day}.0, 0) AS age_days,
  coalesce(strftime({ms}, '%Y'), 'unknown') AS year, coalesce(strftime({ms}, '%Y') || '-Q' || quarter({ms}), 'unknown') AS quarter, coalesce(strftime({ms}, '%Y-%m'), 'unknown') AS month FROM sc),
ds AS (SELECT *, pow(0.5, age_days / 540) AS time_decay, score_before_decay * pow(0.5, age_days / 540) AS score FROM dc)"""


def _quota_sql(bucket: str, k: int, least: int) -> str:
    return f"""c AS (SELECT {bucket} AS bucket, count(*) AS n, least({least}, count(*)) AS g FROM ds GROUP BY ALL),
e AS (SELECT *, n - g AS r, (n - g) / sum(n - g) OVER () * ({k} - sum(g) OVER ()) AS e FROM c),
q AS (SELECT bucket, n, (g + floor(e) + CASE WHEN row_number() OVER (ORDER BY r > 0 DESC, e - floor(e) DESC, bucket) <= {k} - sum(g) OVER () - sum(floor(e)) OVER () AND r > 0 THEN 1 ELSE 0 END)::BIGINT AS quota FROM e)"""


def _select_sql(bucket: str, k: int, least: int) -> str:
    return f"""WITH {_decay_sql()}, {_quota_sql(bucket, k, least)},
r AS (SELECT ds.*, {bucket} AS time_bucket, quota, row_number() OVER (PARTITION BY {bucket} ORDER BY score DESC, id DESC) AS rn FROM ds JOIN q ON q.bucket = {bucket}),
o AS (SELECT *, row_number() OVER (ORDER BY rn > quota, CASE WHEN rn <= quota THEN time_bucket END, score DESC, id DESC) AS sel_order FROM r)
SELECT sel_order, id, time_bucket, round(score_before_decay, 6) AS score_before_decay, round(time_decay, 6) AS time_decay, round(score, 6) AS score, round(age_days, 4) AS age_days FROM o WHERE sel_order <= {k}"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.decay(scoring.score(_catalogue(spark, sf_dir), METRICS), "create_ms", fixture.NOW_MS)


def _selected(df: DataFrame) -> DataFrame:
    return df.select("sel_order", "id", "time_bucket", _r("score_before_decay"), _r("time_decay"), _r("score"), _r("age_days", 4))


@_query(lambda: f"WITH {_norm_sql()} SELECT id, {', '.join(f'round({m}_norm, 6) AS {m}_norm' for m in METRICS)}, round(raw, 6) AS score FROM sc")
def engagement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_catalogue(spark, sf_dir), METRICS).select("id", *(_r(f"{m}_norm") for m in METRICS), _r("score"))


@_query(lambda: f"WITH {fixture.catalogue_sql()} SELECT {', '.join(f'round(quantile_cont(ln(1 + greatest(coalesce({m}_count::DOUBLE, 0), 0)), 0.99), 6) AS p_{m}' for m in METRICS)} FROM cat")
def engagement_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.log_clip_p99(_catalogue(spark, sf_dir), METRICS).select(*(F.round(m, 6).alias(f"p_{m}") for m in METRICS))


@_query(lambda: _select_sql("month", 100, 1))
def rerank_time_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(scoring.rerank(_catalogue(spark, sf_dir), METRICS, fixture.NOW_MS, top_k=100, granularity="month", min_per_bucket=1))


@_query(lambda: _select_sql("quarter", 400, 30))
def rerank_quarter_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(scoring.rerank(_catalogue(spark, sf_dir), METRICS, fixture.NOW_MS, top_k=400, granularity="quarter", min_per_bucket=30))


@_query(lambda: f"WITH {_decay_sql()} SELECT row_number() OVER (ORDER BY score DESC, id DESC) AS sel_order, id, year AS time_bucket, round(score_before_decay, 6) AS score_before_decay, round(time_decay, 6) AS time_decay, round(score, 6) AS score, round(age_days, 4) AS age_days FROM ds ORDER BY 1 LIMIT 100")
def rerank_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(scoring.select_top(_scored(spark, sf_dir), 100, "score", "year"))


@_query(lambda: f"WITH {_decay_sql()}, {_quota_sql('month', 97, 2)} SELECT bucket, n, quota FROM q")
def bucket_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _scored(spark, sf_dir).groupBy(scoring.bucket("create_ms", "month").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(scoring.quotas(counts, 97, 2), "bucket").select("bucket", "n", "quota")


@_query(lambda: f"WITH {_decay_sql()} SELECT quarter AS bucket, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM ds GROUP BY quarter")
def bucket_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.distribution(_catalogue(spark, sf_dir).select(scoring.bucket("create_ms", "quarter").alias("time_bucket")))


@_query("WITH k AS (SELECT user_id AS id, min(event_id) AS first_event FROM events GROUP BY user_id) SELECT k.id, first_event, split_part(text, chr(10), 1) AS title, source AS channel FROM k JOIN documents ON doc_id = k.id")
def candidate_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id"), F.col("event_id").alias("first_event"))
    return scoring.load_candidates(events, _metadata(spark, sf_dir), "first_event").select("id", "first_event", "title", "channel")


def _of_sample(sql: str) -> str:
    """The SQL of scores, over the sample of 500 rows that hash_sample takes."""
    head = sql.replace("x AS (SELECT id", "sub AS (SELECT * FROM cat ORDER BY md5('0:' || id), id LIMIT 500), x AS (SELECT id")
    return head.replace("FROM cat), n AS", "FROM sub), n AS")


@_query(lambda: _of_sample(f"WITH {_norm_sql()} SELECT id, {', '.join(f'round({m}_norm, 6) AS {m}_norm' for m in METRICS)}, round(raw, 6) AS score FROM sc"))
def subset_scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored row of a sample, as it is written to CSV, read back."""
    sample = tables.hash_sample(_catalogue(spark, sf_dir), "id", 500)
    rows = scoring.score(sample, METRICS).select("id", *(_r(f"{m}_norm") for m in METRICS), _r("score"))
    path = _folder(spark, "scored")
    tables.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


@_query(lambda: _of_sample(_select_sql("year", 30, 0)))
def subset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = tables.hash_sample(_catalogue(spark, sf_dir), "id", 500)
    return _selected(scoring.rerank(sample, METRICS, fixture.NOW_MS, top_k=30, granularity="year", min_per_bucket=0))


# Features


def _tfidf_sql() -> str:
    grams = " UNION ALL ".join(f"SELECT id, array_to_string(t[i:i + {n - 1}], ' ') AS key FROM (SELECT id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM tok)" for n in (2, 3, 4))
    return f"""WITH {fixture.catalogue_sql()}, tok AS (SELECT id, regexp_extract_all(lower(title), '{TOKEN}') AS t FROM cat), g AS ({grams}),
tf AS (SELECT id, key, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT key, count(*) AS df FROM tf GROUP BY key),
w AS (SELECT id, key, tf, df, tf * (ln((1 + (SELECT count(*) FROM cat)) / (1 + df)) + 1)::FLOAT::DOUBLE AS w FROM tf JOIN d USING (key))
SELECT id, key, tf, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 5) AS weight FROM w"""


@_query(_tfidf_sql)
def tfidf_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.tfidf_terms(_catalogue(spark, sf_dir), F.col("payload_title"), n_features=None).select("id", "key", "tf", "df", _r("weight", 5))


def _analyzer_sql(grams: str) -> str:
    return f"""WITH {fixture.catalogue_sql()}, g AS ({grams}), tf AS (SELECT id, key, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT key, count(*) AS df FROM tf GROUP BY key),
w AS (SELECT id, key, tf, df, tf * (ln((1 + (SELECT count(*) FROM cat)) / (1 + df)) + 1)::FLOAT::DOUBLE AS w FROM tf JOIN d USING (key))
SELECT id, key, tf, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 5) AS weight FROM w"""


def _substrings_sql(table: str, sizes: tuple[int, ...]) -> str:
    return " UNION ALL ".join(f"SELECT id, substr(s, i, {n}) AS key FROM (SELECT id, s, unnest(range(1, length(s) - {n - 2})) AS i FROM {table})" for n in sizes)


@_query(lambda: _analyzer_sql(_substrings_sql("(SELECT id, regexp_replace(lower(title), '\\s+', ' ', 'g') AS s FROM cat)", (2, 3))))
def tfidf_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.tfidf_terms(_catalogue(spark, sf_dir), F.col("payload_title"), "char", 2, 3, None).select("id", "key", "tf", "df", _r("weight", 5))


@_query(lambda: _analyzer_sql(_substrings_sql("(SELECT id, ' ' || unnest(list_filter(string_split(regexp_replace(lower(title), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) || ' ' AS s FROM cat)", (3,))))
def tfidf_characters_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.tfidf_terms(_catalogue(spark, sf_dir), F.col("payload_title"), "char_wb", 3, 3, None).select("id", "key", "tf", "df", _r("weight", 5))


@_query(lambda: _analyzer_sql("SELECT id, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]{2,}')) AS key FROM cat"))
def tfidf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.tfidf_terms(_catalogue(spark, sf_dir), F.col("payload_title"), "word", 1, 1, None).select("id", "key", "tf", "df", _r("weight", 5))


@_query("SELECT count(DISTINCT vec_id) AS n_rows, max(i) AS n_features FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) WHERE embedding[i] > 0")
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([features.count_features(_sparse(spark, sf_dir))], "n_rows long, n_features long")


@_query()
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.tfidf(_catalogue(spark, sf_dir), "payload_title", "payload_description")


@_query()
def svd_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = features.tfidf(_catalogue(spark, sf_dir), "payload_title", "payload_description", low=1, high=1, n_features=1 << 10)
    path = _folder(spark, "vectors")  # the fit reads vectors several times, and texts are tokenised for each that isn't kept
    tables.write_parquet(v, path)
    v = spark.read.schema(v.schema).parquet(path)
    svd = features.TruncatedSvd(16, n_iter=3, oversamples=8).fit(v, 1 << 10)
    return svd.transform(v)


# Topics


_POSITIVE = "list_filter(range(1, 65), lambda i: embedding[i] > 0)"


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vectors whose making SQL can state: the positive positions of the dense ones."""
    v = fixture.vectors(spark, sf_dir)
    pairs = F.filter(F.transform("vector", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] > 0)
    return v.select("id", pairs.alias("p")).select("id", F.struct(F.transform("p", lambda p: p["i"]).alias("indices"), F.transform("p", lambda p: p["x"]).alias("values")).alias("vector"))


_SEEDS = "seeds AS (SELECT doc_id AS id FROM documents WHERE contains(lower(split_part(text, chr(10), 1) || chr(10) || text), '{}'))"
_UNPACKED = "u AS (SELECT vec_id AS id, i - 1 AS idx, embedding[i]::DOUBLE AS val FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) WHERE embedding[i] > 0)"


@_query(f"""WITH {_SEEDS.format("the or")}, {_UNPACKED}, c AS (SELECT idx, sum(val) AS s FROM u WHERE id IN (SELECT id FROM seeds) GROUP BY idx),
w AS (SELECT idx, s / sqrt(sum(s * s) OVER ()) AS w FROM c), s AS (SELECT id, sum(coalesce(w * val, 0)) AS score FROM u LEFT JOIN w USING (idx) WHERE id NOT IN (SELECT id FROM seeds) GROUP BY id),
r AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, id DESC) AS rank, id, score FROM s WHERE score >= 0.15 ORDER BY rank LIMIT 50)
SELECT rank, id, round(score, 6) AS score, source AS channel, lang AS tags FROM r LEFT JOIN documents ON doc_id = id""")
def sparse_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = topics.sparse_topic(_metadata(spark, sf_dir), _sparse(spark, sf_dir), TOPIC, seed_limit=None, top_k=50, exclude_seeds=True, seed_fields=("title", "description"))
    return hits.select("rank", "id", _r("score"), "channel", "tags")


_DENSE = f"{_SEEDS.format('the or')}, m AS (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings WHERE vec_id IN (SELECT id FROM seeds)), c AS (SELECT (SELECT count(DISTINCT vec_id) FROM m) AS seed_count, list(v ORDER BY i) AS vector FROM (SELECT i, avg(embedding[i]::DOUBLE)::FLOAT AS v FROM m GROUP BY i))"


def _cos(x: str, y: str) -> str:
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
    return f"{dot(x, y)} / (sqrt({dot(x, x)}) * sqrt({dot(y, y)}))"


def _dense_sql(exclude: bool) -> str:
    out = "AND vec_id NOT IN (SELECT id FROM seeds)" if exclude else ""
    return f"""WITH {_DENSE}, s AS (SELECT vec_id AS id, seed_count, {_cos("embedding", "vector")} AS score FROM embeddings JOIN documents ON doc_id = vec_id CROSS JOIN c WHERE true {out})
SELECT id, seed_count, round(score, 6) AS score, source AS channel FROM s JOIN documents ON doc_id = id WHERE score >= 0.0 ORDER BY round(s.score, 9) DESC, id LIMIT 100"""


@_query(lambda: _dense_sql(False))
def dense_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.dense_topic(_metadata(spark, sf_dir), fixture.vectors(spark, sf_dir), TOPIC, top_k=100, dimensions=64).select("id", "seed_count", _r("score"), "channel")


@_query(lambda: _dense_sql(True))
def dense_topic_without_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroid, seeds = topics.build_centroid(_metadata(spark, sf_dir), fixture.vectors(spark, sf_dir), TOPIC, dimensions=64)
    return topics.query_centroid(_metadata(spark, sf_dir), fixture.vectors(spark, sf_dir), centroid, 100, 0.0, seeds, True).select("id", "seed_count", _r("score"), "channel")


@_query(lambda: f"WITH {_DENSE} SELECT '{TOPIC}' AS phrase, 'phrase' AS term_mode, seed_count, i - 1 AS pos, round(vector[i]::DOUBLE, 5) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM c)")
def topic_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroid, _ = topics.build_centroid(_metadata(spark, sf_dir), fixture.vectors(spark, sf_dir), TOPIC, dimensions=64)
    return centroid.select("phrase", "term_mode", "seed_count", F.posexplode("vector").alias("pos", "v")).select("phrase", "term_mode", "seed_count", F.col("pos").cast("long").alias("pos"), F.round(F.col("v").cast("double"), 5).alias("v"))


@_query(lambda: f"WITH {_DENSE}, s AS (SELECT vec_id AS id, {_cos('embedding', 'vector')} AS score FROM embeddings CROSS JOIN c WHERE vec_id IN (SELECT id FROM seeds)) SELECT id, round(score, 6) AS score, source AS channel FROM (SELECT * FROM s ORDER BY round(score, 9) DESC, id LIMIT 5) JOIN documents ON doc_id = id")
def topic_seed_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, v = _metadata(spark, sf_dir), fixture.vectors(spark, sf_dir)
    centroid, seeds = topics.build_centroid(m, v, TOPIC, dimensions=64)
    return topics.seed_preview(m, v, centroid, seeds, 5).select("id", _r("score"), "channel")


@_query(lambda: f"WITH {_SEEDS.format('the')} SELECT id FROM seeds ORDER BY id LIMIT 20")
def topic_seed_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.find_seeds(_metadata(spark, sf_dir), "the", fields=("title", "description"), limit=20).select("id")


# Terms and graphs


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as word vectors."""
    return fixture.vectors(spark, sf_dir).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("word"), "vector", F.expr("1000 - id % 500").alias("count"))


_WORDS = "words AS (SELECT 'v' || vec_id AS word, embedding AS vector, 1000 - vec_id % 500 AS count FROM embeddings)"


def _near_sql(name: str, source: str, topn: int, least: float) -> str:
    return f"""{name} AS (SELECT source, target, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM (
  SELECT a.word AS source, b.word AS target, {_cos("b.vector", "a.vector")} AS score FROM words a JOIN words b ON a.word <> b.word WHERE a.word IN ({source}))) WHERE rank <= {topn} AND score >= {least})"""


_SEED_LIST = ", ".join(f"'{s}'" for s in SEED_TERMS)


@_query(lambda: f"WITH {_WORDS}, {_near_sql('n', _SEED_LIST, 10, 0.1)} SELECT source, target, rank, round(score, 6) AS score FROM n")
def nearest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(s,) for s in SEED_TERMS], "word string")
    return terms.neighbours(_words(spark, sf_dir), asked, 10, 0.1).select("source", "target", F.col("rank").cast("long").alias("rank"), _r("score"))


@_query(lambda: f"""WITH {_WORDS}, {_near_sql('n', _SEED_LIST, 10, 0.1)}, t AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(SEED_TERMS))}) v(ord, term)),
e AS (SELECT ord, 0 AS pos, term AS keyword FROM t UNION ALL SELECT ord, rank, target FROM n JOIN t ON term = source), f AS (SELECT keyword, min(ord * 1000 + pos) AS at_pos FROM e GROUP BY keyword)
SELECT keyword, row_number() OVER (ORDER BY at_pos) AS n FROM f""")
def expansion_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.keywords(terms.expand(spark, _words(spark, sf_dir), SEED_TERMS, 10, 0.1)).select("keyword", F.col("n").cast("long").alias("n"))


def _graph_sql(tail: str) -> str:
    return f"""WITH {_WORDS}, {_near_sql('e0', _SEED_LIST, 5, 0.1)}, {_near_sql('e1', f"SELECT target FROM e0 WHERE target NOT IN ({_SEED_LIST})", 5, 0.1)},
e AS (SELECT *, 0 AS hop FROM e0 UNION ALL SELECT *, 1 FROM e1),
u AS (SELECT least(source, target) AS a, greatest(source, target) AS b, score, rank, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY score DESC, hop, source, rank) AS k FROM e) {tail}"""


@_query(lambda: _graph_sql("SELECT a AS source, b AS target, printf('%.4f', score) AS score FROM u WHERE k = 1"))
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = terms.seed_graph(spark, _words(spark, sf_dir), SEED_TERMS, 1, 5, 0.1)
    return terms.dedupe_edges(edges).select("source", "target", F.format_string("%.4f", "score").alias("score"))


@_query(lambda: _graph_sql("SELECT a AS source, b AS target, printf('%.4f', score) AS score, rank, 'word2vec' AS model FROM u WHERE k = 1"))
def graph_edges_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as they are exported to CSV, read back; four of the six decimals."""
    nodes, edges = terms.seed_graph(spark, _words(spark, sf_dir), SEED_TERMS, 1, 5, 0.1)
    path = _folder(spark, "edges")
    tables.write_csv(terms.graph_csv(nodes, terms.dedupe_edges(edges))[1], path, single=True)
    rows = spark.read.schema("source string, target string, score double, rank long, model string").csv(path, header=True)
    return rows.withColumn("score", F.format_string("%.4f", "score"))


@_query(lambda: _graph_sql(f"SELECT word AS name, count AS freq, (word IN ({_SEED_LIST}))::VARCHAR AS is_seed FROM words WHERE word IN (SELECT source FROM e UNION SELECT target FROM e UNION SELECT word FROM words WHERE word IN ({_SEED_LIST}))"))
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = terms.seed_graph(spark, _words(spark, sf_dir), SEED_TERMS, 1, 5, 0.1)
    return terms.graph_csv(nodes, terms.dedupe_edges(edges))[0]


@_query(lambda: f"WITH {_WORDS}, {_near_sql('n', 'SELECT word FROM (SELECT * FROM words ORDER BY count DESC, word LIMIT 40)', 3, 0.1)} SELECT source, target, rank, round(score, 6) AS score FROM n")
def vocabulary_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = terms.vocabulary_graph(_words(spark, sf_dir), 40, 3, 0.1)
    return edges.select("source", "target", F.col("rank").cast("long").alias("rank"), _r("score"))


@_query(lambda: f"WITH {fixture.catalogue_sql()} SELECT term AS word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(title || chr(10) || description), '{TOKEN}')) AS term FROM cat) GROUP BY term HAVING count(*) >= 20")
def token_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalogue(spark, sf_dir).select(T.tokens(T.combine_text(F.col("payload_title"), F.col("payload_description"))).alias("tokens"))
    return terms.vocabulary(c, 20)


@_query()
def word2vec_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, counts = terms.train_word2vec(_catalogue(spark, sf_dir), "payload_title", "payload_description", size=16, window=4, min_count=50, epochs=1, hs=1, negative=0)
    return terms.word_vectors(model, counts).select("word", "count", "vector")


@_query()
def word2vec_negative_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, counts = terms.train_word2vec(_catalogue(spark, sf_dir), "payload_title", "payload_description", size=16, window=4, min_count=50, epochs=1, negative=5, sample=1e-3)
    return terms.word_vectors(model, counts).select("word", "count", "vector")


def _sets_sql() -> str:
    steps = [("the", -1), *((t, i) for i, (t, _) in enumerate(RELATED))]
    values = ", ".join(f"({pos}, '{w}')" for t, pos in steps for w in t.split())
    return f"{_postings_sql()}, v(pos, term) AS (VALUES {values}), h AS (SELECT DISTINCT pos, id FROM p JOIN v USING (term))"


def _expansion_sql() -> str:
    rows = ", ".join(f"({k}, {'NULL' if k == 0 else repr(RELATED[k - 1][0])}, {'NULL::DOUBLE' if k == 0 else RELATED[k - 1][1]}, '{' '.join(['the', *(t for t, _ in RELATED[:k])])}')" for k in range(len(RELATED) + 1))
    return f"""WITH {_sets_sql()}, k(topk, added_term, added_score, query_text) AS (VALUES {rows}),
c AS (SELECT k.*, (SELECT count(DISTINCT id) FROM h WHERE pos < topk) AS hit_count, (SELECT count(DISTINCT id) FROM h WHERE pos < 0) AS baseline_hit_count FROM k)
SELECT 'the' AS seed_term, topk, added_term, added_score, hit_count, baseline_hit_count, hit_count - baseline_hit_count AS delta_vs_baseline, query_text, round((hit_count - baseline_hit_count) / baseline_hit_count * 100, 6) AS pct FROM c"""


@_query(_expansion_sql)
def expansion_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = terms.expansion_trend(_index(spark, sf_dir), spark, "the", RELATED)
    return out.withColumn("pct", F.round("pct", 6))


def _overlap_sql() -> str:
    rows = ", ".join(f"({k}, '{RELATED[k - 1][0]}', {RELATED[k - 1][1]}::DOUBLE, '{' '.join(t for t, _ in RELATED[:k])}')" for k in range(1, len(RELATED) + 1))
    return f"""WITH {_sets_sql()}, k(topk, added_term, added_score, query_text) AS (VALUES {rows}), s AS (SELECT DISTINCT id FROM h WHERE pos < 0),
c AS (SELECT k.*, (SELECT count(*) FROM s) AS seed_hit_count, (SELECT count(DISTINCT id) FROM h WHERE pos >= 0 AND pos < topk) AS related_hit_count, (SELECT count(DISTINCT id) FROM h WHERE pos >= 0 AND pos < topk AND id IN (SELECT id FROM s)) AS intersection_count FROM k),
u AS (SELECT *, seed_hit_count + related_hit_count - intersection_count AS union_count FROM c)
SELECT 'the' AS seed_term, topk, added_term, added_score, seed_hit_count, related_hit_count, intersection_count, union_count, round(intersection_count / seed_hit_count, 6) AS overlap_ratio, round(intersection_count / union_count, 6) AS jaccard_ratio, query_text FROM u"""


@_query(lambda: f"SELECT * EXCLUDE (pct) FROM ({_expansion_sql()}) WHERE hit_count > 0 ORDER BY hit_count DESC, topk LIMIT 1")
def expansion_best_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.best_step(terms.expansion_trend(_index(spark, sf_dir), spark, "the", RELATED), "hit_count").drop("pct")


@_query(lambda: f"SELECT * EXCLUDE (pct, added_score) FROM ({_expansion_sql()})")
def expansion_trend_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend as it is written to CSV, read back."""
    rows, path = terms.expansion_trend(_index(spark, sf_dir), spark, "the", RELATED).drop("pct"), _folder(spark, "trend")
    tables.write_csv(rows, path, single=True)
    return spark.read.schema(rows.schema).csv(path, header=True).drop("added_score")


@_query(_overlap_sql)
def overlap_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = terms.overlap_trend(_index(spark, sf_dir), spark, "the", RELATED)
    return out.withColumn("overlap_ratio", F.round("overlap_ratio", 6)).withColumn("jaccard_ratio", F.round("jaccard_ratio", 6))


# Sinks and stores


@_query("SELECT to_json({'id': doc_id, 'channel': source, 'title': split_part(text, chr(10), 1)})::VARCHAR AS json FROM documents")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.json_rows(_metadata(spark, sf_dir).select("id", "channel", "title"))


_HAN_TEXT = "lang || '視頻 天地' || source || '人 v1.2'"


@_query(f"SELECT doc_id AS id, array_to_string(regexp_extract_all(lower({_HAN_TEXT}), '{TOKEN}|[{chr(0x3400)}-{chr(0x4DBF)}{chr(0x4E00)}-{chr(0x9FFF)}]+'), ' ') AS tokens FROM documents")
def tokenize_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("payload_channel_parentName", F.lit("視頻 天地"), "payload_channel_name", F.lit("人 v1.2"))
    return _catalogue(spark, sf_dir).select("id", T.join_tokens(text).alias("tokens"))


_KANA_TEXT = "lang || 'かな漢字 ' || source || ' 字か天地 Ab'"
_HAN, _KANA = f"{chr(0x3400)}-{chr(0x4DBF)}{chr(0x4E00)}-{chr(0x9FFF)}", f"{chr(0x3040)}-{chr(0x30FF)}"


@_query(f"SELECT doc_id AS id, array_to_string(list_concat(regexp_extract_all(lower({_KANA_TEXT}), '{TOKEN}|[{_HAN}{_KANA}]+'), list_filter(regexp_extract_all(lower({_KANA_TEXT}), '[{_HAN}]+'), lambda x: length(x) > 1)), ' ') AS tokens FROM documents")
def tokenize_kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("payload_channel_parentName", F.lit("かな漢字 "), "payload_channel_name", F.lit(" 字か天地 Ab"))
    return _catalogue(spark, sf_dir).select("id", T.join_tokens(text).alias("tokens"))


@_query("SELECT doc_id AS id, source AS channel, split_part(text, chr(10), 1) AS title FROM documents")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards in zstd, written over what was there."""
    rows, path = _metadata(spark, sf_dir).select("id", "channel", "title"), _folder(spark, "rows")
    tables.write_parquet(rows.limit(1), path)
    tables.write_parquet(rows.repartition(3), path)
    return tables.scan(spark, path, ["id", "channel", "title"])


@_query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, 10::BIGINT AS first")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = [tables.count_rows(tables.scan(spark, f"{sf_dir}/{t}.parquet")) for t in ("documents", "embeddings")]
    head = tables.scan(spark, f"{sf_dir}/documents.parquet", ["doc_id"], 10)
    return spark.createDataFrame([(*n, tables.count_rows(head))], "documents long, embeddings long, first long")


@_query("SELECT vec_id AS id, label, source AS channel FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 7 = 1")
def vector_store_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that was there is dropped, is kept when it may be skipped, and gives the points that are asked for."""
    store = tables.VectorStore(spark, _folder(spark, "store"))
    v = fixture.vectors(spark, sf_dir)
    store.ingest(v.withColumn("label", F.lit(-1)))
    metadata = _metadata(spark, sf_dir).join(v.select("id"), "id", "left_semi").select("id", "channel")
    points = tables.joined_points(metadata, v.join(metadata.select("id"), "id", "left_semi"))
    store.ingest(points.join(v.select("id", "label"), "id"), recreate=True)
    store.ingest(v.withColumn("label", F.lit(-2)).withColumn("channel", F.lit("")), skip_existing=True)
    return store.retrieve(v.where("id % 7 = 1").select("id")).select("id", "label", "channel")


@_query("SELECT vec_id AS id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 2) + 0.0 AS total FROM (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100, list_transform(embedding, lambda x: -x) FROM embeddings WHERE vec_id % 3 = 0)")
def vector_store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tables.VectorStore(spark, _folder(spark, "store"))
    v = fixture.vectors(spark, sf_dir)
    store.ingest(v, recreate=True)
    store.ingest(v.where("id % 3 = 0").select("id", F.transform("vector", lambda x: -x).alias("vector"), (F.col("label") + 100).alias("label")))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return store.read().select("id", "label", (F.round(total, 2) + F.lit(0.0)).alias("total"))

