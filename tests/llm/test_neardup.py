import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import neardup


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def planted(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.choice([3, 30, 250]))]
        rows.append((i, " ".join(words)))
        for k in range(rng.randrange(6)):
            w = list(words)
            for at in rng.sample(range(len(w)), rng.randint(1, min(len(w), 9))):
                w[at] = word()
            rows.append((1000 + 10 * i + k, " ".join(w)))
    return rows + [(7000, ""), (6999, None), (None, rows[0][1]), rows[5], rows[5], (8000, rows[0][1].upper()), (8001, " \n " + rows[0][1].replace(" ", "\t ") + "\r"), (8002, " \x0b")]


def brute_kept(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline

    rows = planted()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _node string").withColumn("n_chars", F.lit(1))
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    got = sorted(r["doc_id"] for r in kept.collect())
    assert got == brute_kept(rows)
    # 250 words with 3 edits are near copies
    words = [f"w{i}" for i in range(250)]
    edited = [w if i not in (40, 120, 200) else "new" for i, w in enumerate(words)]
    pair = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:125] + [w + "x" for w in words[125:]]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, pair, "").collect()) == [1, 3]
    assert neardup.deduplicate(df.limit(0)).count() == 0


def test_chunks_meet_in_pairs_and_chains_are_followed(spark, monkeypatch):
    """Groups much larger than a chunk; chains whose ends are far apart, and a band's members that aren't like its smallest node."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join([*base[i:], *(f"c{i}x{k}" for k in range(i))])) for i in range(0, 60)]  # each near to its neighbours
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(100)]
        for k in range(40):
            w = list(words)
            for at in rng.sample(range(100), rng.randint(0, 6)):
                w[at] = f"n{rng.random()}"
            rows.append((1000 * (g + 1) + k, " ".join(w)))
    monkeypatch.setattr(neardup, "MEMBERS", 3)
    monkeypatch.setattr(neardup, "BANDS", 28)
    got = sorted(r["doc_id"] for r in neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_kept(rows)


def test_near_pairs():
    sets = [np.arange(i, i + 100) for i in range(0, 60, 5)] + [np.arange(500, 600)]
    a, b = neardup.near_pairs(sets, sets, 0.8)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i in range(13) for j in range(13) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]


def test_connected():
    a, b = np.array([5, 1, 7, 3]), np.array([3, 5, 8, 2])
    assert neardup.connected(9, a, b).tolist() == [0, 1, 1, 1, 4, 1, 6, 7, 7]


def test_pipeline_stage_keeps_the_links_of_op10(spark):
    """Texts that op10's fingerprints link but sets of shingles don't; a chain goes on through links of the other kind."""
    import corpus_pipeline
    from millrace.llm import simhash

    line = [f"r{i}" for i in range(7)] * 400
    tail = lambda k, n: [f"t{k}x{i}" for i in range(n)]
    rows = [(1, [*line, *tail(1, 40)]), (2, [*line, *tail(2, 40)]), (3, [*line, *tail(2, 38), "new", "end"]), (4, tail(4, 100)), (5, [*tail(4, 98), "new", "end"]), (6, tail(6, 100))]
    rows = [(d, " ".join(w)) for d, w in rows]
    bits = lambda a, b: (simhash.simhash(rows[a][1]) ^ simhash.simhash(rows[b][1])).bit_count()
    alike = lambda a, b: len((s := shingles(rows[a][1])) & (t := shingles(rows[b][1]))) / len(s | t)
    assert bits(0, 1) <= 2 and alike(0, 1) < 0.8 and alike(1, 2) >= 0.8 and bits(3, 4) > 2 and alike(3, 4) >= 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6]
    component = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert len({component[d] for d in (1, 4, 6)}) == 3
