"""The queries of the corpus operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gif, hilbert, licenses, mixing, packing, pii, quality, simhash, urls, warc
from .common import read_table, utf8, word_count  # noqa: F401

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
SHARDS = 24


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.UrlPolicy(rules=URL_RULES)).select("page_id", "host", "path", "rule", "verdict", "n_strict", "soft_weight")


def _sql_strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def op3_sql() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)
    hit = lambda t: f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){t}([^\\p{{L}}\\p{{N}}]|$)')"
    strict = " + ".join(f"{hit(t)}::INT" for t in urls.STRICT)
    soft = " + ".join(f"{w} * {hit(t)}::INT" for t, w in urls.SOFT)
    distinct = " + ".join(f"{hit(t)}::INT" for t, _ in urls.SOFT)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES {rules}),
parts AS (
  SELECT page_id, url, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    row_number() OVER () AS rid
  FROM pages),
fits AS (
  SELECT p.rid, r.rule, r.verdict, row_number() OVER (PARTITION BY p.rid ORDER BY length(r.rule) DESC, length(r.rhost) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath)),
hits AS (SELECT rid, ({strict})::INT AS n_strict, ({soft})::INT AS soft_weight, {distinct} AS n_soft FROM parts)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN n_strict > 0 OR (soft_weight >= {urls.UrlPolicy().soft_limit} AND n_soft >= {urls.UrlPolicy().soft_terms}) THEN 'block' ELSE 'allow' END) AS verdict, n_strict, soft_weight
FROM parts p JOIN hits USING (rid) LEFT JOIN fits f ON f.rid = p.rid AND f.k = 1"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_sql() -> str:
    p = mixing.MixPolicy()
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(p.weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('{p.seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, (CASE rank % {len(p.weights)} {weight} END)::DOUBLE AS w, {p.budget} * sum(source_size) OVER () AS budget, {p.epochs}.0::DOUBLE * source_size AS cap FROM r),
o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(w) OVER (ORDER BY cap / w DESC, rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w_left
  FROM w),
level AS (SELECT w_left AS total, budget::DOUBLE - full_before AS rest, cap / w AS at FROM o WHERE w / w_left * (budget::DOUBLE - full_before) <= cap ORDER BY cap / w, rank LIMIT 1),
t AS (SELECT o.source, o.rank, o.source_size, o.budget, CASE WHEN level.at IS NULL OR o.cap / o.w < level.at THEN o.cap ELSE o.w / level.total * level.rest END AS target FROM o LEFT JOIN level ON true),
k AS (
  SELECT d.doc_id, d.key, d.size, t.rank, t.source_size, t.target, t.budget, sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT rank, key, epoch, budget, (max(cum) + epoch * source_size) / target AS finish, sum(size) AS size FROM k, range({p.epochs}) x(epoch) WHERE target > 0 GROUP BY rank, key, epoch, budget, source_size, target),
n AS (SELECT rank, key, sum(size) OVER (ORDER BY finish, rank, epoch, key ROWS UNBOUNDED PRECEDING) <= budget AS taken FROM e),
c AS (SELECT rank, key, count(*) FILTER (taken) AS copies FROM n GROUP BY rank, key)
SELECT k.doc_id, k.size::BIGINT AS size, k.source_size, k.target, (k.size * coalesce(c.copies, 0))::BIGINT AS taken FROM k LEFT JOIN c ON c.rank = k.rank AND c.key = k.key"""


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", "lang", "source", "n_chars", (F.length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    dims = [hilbert.Dimension("n_chars"), hilbert.Dimension("lang", "category"), hilbert.Dimension("source", "category")]
    done = hilbert.hilbert_shards(slim, dims, SHARDS, ["text_crc32", "doc_id"])
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
    return quality.judge(docs).select(*names)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op1_sql() -> str:
    base32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    chars = " || ".join(f"substr('{base32}', (((('0x' || substr(sha, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31) + 1)::INT, 1)" for i in range(8) for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS sha FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS top FROM d)
SELECT page_id, payload_bytes, {chars} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to, NULL::VARCHAR AS error
FROM t"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sql() -> str:
    notices = ", ".join("(" + _sql_strings(t) + ")" for t in licenses.TEMPLATES)
    words = "list_filter(list_transform(regexp_split_to_array(lower({}), '[\\x20\\x09-\\x0D]+'), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT license, {words.format("notice")} AS w FROM (VALUES {notices}) v(license, notice)),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS s FROM t, range(1, len(w) - 3) r(i)),
n AS (SELECT license, count(*)::BIGINT AS n_shingles FROM ts GROUP BY license),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words.format("text")} AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT rid, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
m AS (SELECT rid, license, count(DISTINCT s)::BIGINT AS n_matched, min(pos)::BIGINT AS first_word, max(pos)::BIGINT + 5 AS end_word FROM ds JOIN ts USING (s) GROUP BY rid, license)
SELECT doc_id, license, n_matched / n_shingles AS containment, n_matched, n_shingles, first_word, end_word
FROM m JOIN n USING (license) JOIN d USING (rid) WHERE n_matched / n_shingles >= {licenses.LicensePolicy().min_containment}"""


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = gif.media_digest(gif.encode_texts(docs))
    return done.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(docs)


QUERIES = {f.__name__: f for f in (op1_warc, op2_license_scan, op3_url_filter, op4_gif_media, op5_best_fit_packing, op6_quality_rules, op7_pii, op8_mixing, op9_hilbert_shards, op10_simhash)}
SQL = {"op1_warc": op1_sql, "op2_license_scan": op2_sql, "op3_url_filter": op3_sql, "op8_mixing": op8_sql}
