import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import hilbert, mixing, urls

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://a.example.com/en/71?x", ("a.example.com", "/en/71", "example.com/en/7", "allow")),
        ("https://EXAMPLE.com/en/8", ("example.com", "/en/8", "com/en/", "block")),
        ("http://x.example.net/de/81", ("x.example.net", "/de/81", "example.net/de/8", "block")),
        ("http://notexample.net/de/81", ("notexample.net", "/de/81", "net/de/", "allow")),
        ("http://casino.example.net/de/1", ("casino.example.net", "/de/1", "net/de/", "allow")),
        ("http://casinos.example.org/x", ("casinos.example.org", "/x", None, "allow")),
        ("http://my-casino.example.org/x", ("my-casino.example.org", "/x", None, "block")),
        ("http://cheap.example.org/pills", ("cheap.example.org", "/pills", None, "block")),
        ("http://cheap.example.org/cheap", ("cheap.example.org", "/cheap", None, "allow")),
        ("http://host?q=/x", ("host", "", None, "allow")),
        ("casino", ("", "", None, "block")),
        ("", ("", "", None, "allow")),
        (None, ("", "", None, "allow")),
    ],
)
def test_url_verdicts(url, want):
    assert urls.judge(url, urls.UrlPolicy(rules=RULES))[:4] == want


def test_url_weights_decide():
    policy = urls.UrlPolicy()
    for words, verdict in (("free/win", "allow"), ("free/win/cheap", "block"), ("free/poker", "block"), ("poker", "allow"), ("poker/poker", "allow")):
        assert urls.judge(f"http://h.example/{words}", policy)[3] == verdict
    heavy = urls.UrlPolicy(soft=(("alone", 9), ("other", 1)))
    assert urls.judge("http://alone.example/", heavy)[3] == "allow" and urls.judge("http://alone.example/other", heavy)[3] == "block"


def test_url_vocabulary_from_a_file(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("bad term\tstrict\nmild\t2\nlight\t1\n\n")
    policy = urls.read_vocabulary(spark, str(tmp_path), soft_limit=3)
    assert policy.strict == ("bad term",) and policy.soft == (("light", 1), ("mild", 2))
    assert [urls.judge(u, policy)[3] for u in ("x://a/bad term", "x://a/mild", "x://mild/light", "x://mildly/light")] == ["block", "allow", "block", "allow"]
    with pytest.raises(ValueError):
        urls.read_vocabulary(spark, str(tmp_path), most=2)


def test_url_filter_clashes_in_any_case(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/", "mine", "p")], "page_id long, Path string, Host string, N_Strict string")
    got = urls.filter_urls(df, urls.UrlPolicy(rules=RULES), url="Path")
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "n_strict", "soft_weight"]
    assert got.select("host", "path", "verdict").first() == ("a.com", "/en/", "block")


def test_url_filter_keeps_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/", "mine"), (1, "http://a.com/en/", "mine"), (None, None, None)], "page_id long, url string, verdict string")
    got = urls.filter_urls(df, urls.UrlPolicy(rules=RULES)).collect()
    assert sorted(r["verdict"] for r in got) == ["allow", "block", "block"]
    assert urls.filter_urls(df.limit(0), urls.UrlPolicy(rules=RULES)).count() == 0


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_index_is_a_curve(spark, n, bits):
    cells = spark.createDataFrame([tuple(c) for c in itertools.product(range(1 << bits), repeat=n)], ", ".join(f"c{i} long" for i in range(n)))
    rows = cells.withColumn("h", hilbert.hilbert_index([F.col(f"c{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(1 << (n * bits)))
    for a, b in itertools.pairwise(rows):
        assert sum(abs(a[f"c{i}"] - b[f"c{i}"]) for i in range(n)) == 1


def test_hilbert_shards_are_even_and_gapless(spark):
    rng = random.Random(1)
    rows = [(i if i % 7 else None, "en" if i % 3 else None, rng.randrange(5000) if i % 5 else None, "x") for i in range(1001)] + [(5, "en", 7, "x")] * 300
    df = spark.createDataFrame(rows, "doc_id long, lang string, n_chars int, hilbert string")
    got = hilbert.hilbert_shards(df, [hilbert.Dimension("n_chars"), hilbert.Dimension("lang", "category")], 24, ["doc_id"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 1301 and set(by) == set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    few = hilbert.hilbert_shards(df.limit(3), [hilbert.Dimension("n_chars")], 24, ["doc_id"]).collect()
    assert len(few) == 3 and {r["slot"] for r in few} == {0}
    assert hilbert.hilbert_shards(df.limit(0), [hilbert.Dimension("n_chars")], 24, ["doc_id"]).count() == 0


def brute_curve(cells, bits):
    """The index of a cell, by walking Skilling's transform on plain numbers."""
    x, n, q = list(cells), len(cells), 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_hilbert_query_equals_brute_force(spark, tmp_path):
    """Cells, order, shards and slots of op9, on a table with repeated texts, nulls and a hot source."""
    import zlib

    import xxhash

    from millrace.llm import queries

    rng = random.Random(5)
    texts = [None, "", *("t" * rng.randrange(1, 50) for _ in range(12))]
    rows = [(i, rng.choice(texts), rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 5 + [f"s{k:02d}" for k in range(25)]), rng.randrange(300) if rng.random() < 0.9 else None) for i in range(700)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_hilbert_shards(spark, str(tmp_path)).collect()

    def category(values):
        counts = sorted((v, sum(w == v for w in values)) for v in {v for v in values if v is not None})
        if len(counts) <= 16:
            return {v: k for k, (v, _) in enumerate(counts)} | {None: 0}
        total, run, cell, out = sum(n for _, n in counts), 0, 0, {None: 0}
        for v, n in counts:
            before, run = run, run + n
            out[v] = cell
            cell += run * 16 // total > before * 16 // total
        return out

    known = sorted(r[4] for r in rows if r[4] is not None)
    cuts = sorted({known[max(0, -(-len(known) * i // 16) - 1)] for i in range(1, 16)})
    lang, source = category([r[2] for r in rows]), category([r[3] for r in rows])
    want = []
    for doc, text, lg, so, n in rows:
        raw = (text or "").encode()
        crc = zlib.crc32(raw)
        tie = xxhash.xxh64_intdigest(crc.to_bytes(8, "little"), 42)
        cell = (0 if n is None else sum(n > q for q in cuts), lang[lg], source[so])
        want.append((brute_curve(cell, 4), tie - (1 << 64) if tie >> 63 else tie, crc, doc, len(raw) + 8))
    want.sort()
    shards = [[k for k in range(700) if k * 24 // 700 == s] for s in range(24)]
    place = {k: (s, i) for s, ks in enumerate(shards) for i, k in enumerate(ks)}
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["hilbert"], r["shard"], r["slot"]) for r in got) == sorted((doc, size, crc, h, *place[k]) for k, (h, _, crc, doc, size) in enumerate(want))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_hilbert_clashing_columns_and_many_categories(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.format_string("c%03d", F.col("id") % 100).alias("Shard"), F.lit(1).alias("SLOT"), F.lit("x").alias("hilbert"))
    for most in (1 << 16, 50):
        monkeypatch.setattr(hilbert, "CATEGORIES", most)
        done = hilbert.hilbert_shards(df, [hilbert.Dimension("Shard", "category")], 4, ["doc_id"])
        assert done.columns == ["doc_id", "hilbert", "shard", "slot"]
        order = done.join(df.select("doc_id", F.col("Shard").alias("c")), "doc_id").orderBy("shard", "slot").collect()
        by_category = [h for _, h in sorted((r["c"], r["hilbert"]) for r in order)]
        assert by_category == sorted(by_category) and len(set(by_category)) == 16 and done.groupBy("shard").count().where("count = 75").count() == 4


def test_hilbert_category_cuts_do_not_depend_on_the_number_of_values(spark, monkeypatch):
    """Values alike in their first bytes, of unequal counts, by one task and by many."""
    rng = random.Random(8)
    values = [f"https://example.org/{k:04d}" for k in range(90)] + ["", "z\u00e9", "\U0001f600", "\uff5e"]
    rows = [v for v in values for _ in range(rng.choice([1, 2, 3, 60]))] + [None] * 50
    counts = sorted((v.encode(), rows.count(v)) for v in values)
    total, run, want = len(rows) - 50, 0, []
    for v, n in counts:
        run += n
        if run * 16 // total > (run - n) * 16 // total and run < total:
            want.append(v.decode())
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "doc_id long, source string").repartition(5)
    shards = []
    for most in (1 << 16, 40, 7, 1):
        monkeypatch.setattr(hilbert, "CATEGORIES", most)
        assert hilbert.category_cuts(df, "source", 16) == want
        shards.append(sorted((r["doc_id"], r["hilbert"], r["shard"], r["slot"]) for r in hilbert.hilbert_shards(df, [hilbert.Dimension("source", "category")], 24, ["doc_id"]).collect()))
    assert len(want) > 10 and all(s == shards[0] for s in shards)
    few = df.where("source < 'https://example.org/0012'")
    assert hilbert.category_cuts(few, "source", 16) == ["", *values[:11]]
    assert hilbert.category_cuts(df.where("source IS NULL"), "source", 16) == []


def test_hilbert_runs_prune(spark):
    df = spark.range(4096).select("id", (F.col("id") % 64).alias("a"), (F.col("id") / 64).cast("long").alias("b"))
    done = hilbert.hilbert_shards(df, [hilbert.Dimension("a"), hilbert.Dimension("b")], 16, ["id"], bits=4)
    boxes = done.groupBy("shard").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1")).collect()
    for c in "ab":  # a query on either column touches few of the 16 shards
        assert max(sum(r[f"{c}0"] <= v <= r[f"{c}1"] for r in boxes) for v in range(64)) <= 8


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [5, 2, 1], 45, 2) == [20.0, pytest.approx(50 / 3), pytest.approx(25 / 3)]
    assert mixing.water_fill([1, 1], [1, 1], 4, 2) == [2.0, 2.0]


def brute_mix(rows, policy):
    import hashlib

    sizes, docs = {}, []
    for doc_id, text, source in rows:
        size = len((text or "").encode().split())
        key = hashlib.md5(f"{policy.seed}:{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()
        sizes[source] = sizes.get(source, 0) + size
        docs.append((source, key, size))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = mixing.water_fill([sizes[s] for s in order], [policy.weights[i % 3] for i in range(len(order))], policy.budget * sum(sizes.values()), policy.epochs) if sum(sizes.values()) else [0.0] * len(order)
    entries = []
    for i, s in enumerate(order):
        merged = {}
        for so, key, size in docs:
            if so == s:
                merged[key] = merged.get(key, 0) + size
        for e in range(policy.epochs):
            cum = 0
            for key in sorted(merged):
                cum += merged[key]
                if targets[i]:
                    entries.append(((cum + e * sizes[s]) / targets[i], i, e, key, merged[key]))
    run, copies = 0, {}
    for _, i, _, key, size in sorted(entries):
        run += size
        if run <= policy.budget * sum(sizes.values()):
            copies[i, key] = copies.get((i, key), 0) + 1
    return sorted((size, sizes[s], targets[order.index(s)], copies.get((order.index(s), key), 0)) for s, key, size in docs)


def test_mix_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(60))), rng.choice(["a", "a", "a", "b", "c", "ä", None])) for i in range(400)]
    rows += [(None, None, "b"), (7, "same text", "b"), (7, "same text", "b"), (9, "", None), (10, "x " * 3000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("clash"))
    policy = mixing.MixPolicy()
    got = sorted((r["size"], r["source_size"], r["target"], r["copies"]) for r in mixing.mix(df, policy).collect())
    assert got == brute_mix(rows, policy)
    mixed = mixing.mixed_documents(df, policy)
    assert mixed.columns == df.columns and mixed.count() == sum(g[3] for g in got)
    assert mixing.mix(df.limit(0), policy).count() == 0
    assert [r["target"] for r in mixing.mix(df.where("text is null"), policy).collect()] == [0.0]
