import base64
import collections
import hashlib
import importlib.util
import io
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bilstm, gif, licenses, pii, warc


# WARC
def test_warc_round_trip_and_damage():
    rng = random.Random(1)
    rows = [(1, "http://a/\r\nX: y", b"hello", None, False), (2, None, b"hello", 1, True), (None, "u", b"", None, False), (4, "z", rng.randbytes(700_000), None, False)]
    members = [warc.member(warc.record(*r)) for r in rows]
    for keep in (True, False):
        got = list(warc.read_records(io.BytesIO(b"".join(members)), keep))
        assert [g.error for g in got] == [None] * 4
        assert [g.payload_bytes for g in got] == [5, 5, 0, 700_000]
        assert [g.payload_digest for g in got] == [base64.b32encode(hashlib.sha1(r[2]).digest()).decode() for r in rows]
    assert got[0].fields["warc-target-uri"] == "http://a/%0D%0AX: y"
    broken = bytearray(members[1])
    broken[40] ^= 255
    got = list(warc.read_records(io.BytesIO(members[0] + bytes(broken) + members[2])))
    assert [g.error is None for g in got] == [True, False, True]
    got = list(warc.read_records(io.BytesIO(b"".join(members)[:-50])))
    assert [g.error for g in got] == [None, None, None, "truncated member"]
    lie = warc.record(5, "u", b"abc").replace(b"abc", b"abd")
    assert "digest" in next(warc.read_records(io.BytesIO(warc.member(lie)))).error


def test_warc_archive(spark):
    rows = [(i, f"u{i}", "same") for i in range(50)] + [(100, None, None), (101, "v", ""), (None, "w", "same"), (102, "x", "é" * 5000), (102, "x", "é" * 5000), (None, None, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    got = warc.archive(spark, pages, keep_payload=True).collect()
    top = collections.defaultdict(list)
    for i, _, h in rows:
        top[h or ""].append(i)
    head = {h: max((i for i in v if i is not None), default=None) for h, v in top.items()}
    want = collections.Counter()
    for i, _, h in rows:
        h = h or ""
        again = i != head[h]
        want[i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if again else "response", head[h] if again else None, None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["error"]) for r in got) == want
    assert warc.archive(spark, pages.limit(0)).count() == 0


# GIF
def test_gif_payload_round_trip():
    rng = random.Random(0)
    for n in (64, 128, 6400, 64 * 1500, 64 * 2500):
        for payload in (bytes(rng.choice(b"abcdef ") for _ in range(n)), rng.randbytes(n), b"a" * n):
            got = gif.decode(gif.encode(payload))
            assert got.error is None and b"".join(f.samples for f in got.frames) == payload


def slow_lzw(codes_bits, first):  # a plain decoder, bit by bit
    bits, at = [(byte >> k) & 1 for byte in codes_bits for k in range(8)], 0
    clear, end = 1 << first, (1 << first) + 1
    table, width, prev, out = [bytes([i]) for i in range(clear)] + [b"", b""], first + 1, None, b""
    while at + width <= len(bits):
        c = sum(bits[at + k] << k for k in range(width))
        at += width
        if c == clear:
            table, width, prev = table[: clear + 2], first + 1, None
            continue
        if c == end:
            break
        s = table[c] if c < len(table) else prev + prev[:1]
        out += s
        if prev is not None and len(table) < 4096:
            table.append(prev + s[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        prev = s
    return out


@pytest.mark.parametrize("first", [2, 4, 8])
def test_lzw_against_a_plain_decoder(first):
    rng = random.Random(first)
    for n in (1, 2, 300, 9000):
        data = bytes(rng.randrange(1 << first) for _ in range(n))
        raw = gif.lzw_encode(data, first)
        assert slow_lzw(raw, first) == data == gif.lzw_decode(raw, first, n)


def picture(frames, size=(4, 3), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    le = lambda v: v.to_bytes(2, "little")
    out = b"GIF89a" + le(size[0]) + le(size[1]) + b"\x91\0\0" + bytes(v for p in palette for v in p)
    for x, y, w, h, pixels, delay, disposal, clear, interlaced, own in frames:
        out += b"!\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + le(delay) + bytes([clear or 0]) + b"\0"
        out += b"," + le(x) + le(y) + le(w) + le(h) + bytes([(64 if interlaced else 0) | (0x81 if own else 0)])
        out += bytes(v for p in own for v in p) if own else b""
        out += b"\x02" + gif._blocks(gif.lzw_encode(bytes(pixels), 2))
    return out + b";"


def test_gif_disposal_transparency_palettes_interlace():
    full = [1] * 12
    two = [2, 3]
    rows = gif.decode(picture([(0, 0, 4, 3, full, 5, 1, None, False, None), (1, 1, 2, 1, two, 7, 2, 3, False, None), (0, 0, 1, 1, [3], 9, 3, None, False, None), (3, 2, 1, 1, [1], 1, 1, None, False, [(9, 9, 9), (8, 8, 8), (7, 7, 7), (6, 6, 6)])]))
    assert rows.error is None and [f.delay_ms for f in rows.frames] == [50, 70, 90, 10]
    a, b, c, d = (f.canvas for f in rows.frames)
    assert (a[..., 0] == 255).all()
    assert b[1, 1].tolist() == [0, 255, 0, 255] and b[1, 2].tolist() == [255, 0, 0, 255]  # 3 is transparent
    assert c[1, 1].tolist() == [0, 0, 0, 0] and c[1, 2].tolist() == [0, 0, 0, 0] and c[0, 0].tolist() == [0, 0, 255, 255]  # the box was cleared
    assert d[0, 0].tolist() == [255, 0, 0, 255] and d[2, 3].tolist() == [8, 8, 8, 255]  # as before the third; an own palette
    assert sum(rows.frames[2].histogram) == 3 * 10
    height = 9
    order = [r for s, k in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, height, k)]
    got = gif.decode(picture([(0, 0, 4, height, [r % 4 for r in order for _ in range(4)], 1, 0, None, True, None)], (4, height)))
    assert np.frombuffer(got.frames[0].samples, np.uint8).reshape(height, 4)[:, 0].tolist() == [r % 4 for r in range(height)]
    assert gif.decode(b"nothing").error and gif.decode(picture([(0, 0, 4, 3, full[:5], 1, 0, None, False, None)])).error


def test_gif_columns(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "x" * 64), (5, "é" * 40_000), (5, "é" * 40_000), (None, "abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    coded = gif.encode_texts(df).cache()
    got = gif.media_digest(coded).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        payload = gif.padded(text.encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    frames = gif.decode_frames(coded, "doc_id").where("doc_id = 5").collect()
    assert len(frames) == 4 and {f["delay_ms"] for f in frames} == {100} and all(sum(f["histogram"]) == 3 * 64 * min(1024, f["height"] if f["frame"] == 0 else 1024) for f in frames)
    assert gif.media_digest(gif.encode_texts(df.limit(0))).count() == 0


def test_gif_null_damaged_and_huge_images(spark):
    good = gif.encode(bytes(64 * 1500))
    huge = b"GIF89a\xff\xff\xff\xff\xf7\0\0"
    cut = good[: len(good) - 30]
    assert gif.decode(huge).error and not gif.decode(huge).frames and gif.decode(None).error == "no media"
    frame = b"GIF89a\1\0\1\0\x80\0\0" + bytes(6) + b",\0\0\0\0\xff\xff\xff\xff\0\2\0"
    assert "65535" in gif.decode(frame).error
    df = spark.createDataFrame([(1, bytearray(good), "a", 1), (2, None, "b", 2), (3, bytearray(huge), "c", 3), (4, bytearray(cut), "d", 4), (5, bytearray(b""), "e", 5)], "doc_id long, media binary, Feature string, ERROR int")
    done = gif.media_digest(df)
    assert [c for c in done.columns if c.lower() in ("feature", "error")] == ["feature", "error"]
    got = {r["doc_id"]: r for r in done.collect()}
    assert got[1]["error"] is None and got[1]["payload_bytes"] == 64 * 1500
    assert got[2]["error"] == "no media" and got[2]["media_bytes"] is None
    assert got[3]["error"] and got[3]["payload_bytes"] == 0 and got[5]["error"]
    assert got[4]["error"] and got[4]["payload_bytes"] == 64 * 1024  # the frames up to the damage
    rows = gif.decode_frames(df, "doc_id").collect()
    assert sum(r["doc_id"] == 4 for r in rows) == 1 and {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5}


# PII
def plain_base(text):
    import re

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@", ".", "-", "12", "4111111111111111", "255", "1.2.3.4", "+", "(", ") ", " ", "\n", "é", "300", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("9" * 200_000 + "x" * 200_000 + "@" * 1000) == []  # in linear time


def test_pii_gradients():
    from millrace.llm.bilstm import BiLstmCrf

    rng = np.random.default_rng(1)
    model = BiLstmCrf.fresh(3, embedding=4, hidden=3, seed=2)
    for k in model.params:
        model.params[k] = (model.params[k] + rng.standard_normal(model.params[k].shape) * 0.1).astype(np.float64)
    ids = rng.integers(1, 99, (3, 6))
    ids[0, 4:] = 0
    tags = rng.integers(0, 3, (3, 6)) * (ids > 0)
    _, g = model.loss_and_gradients(ids, tags)
    for k, p in model.params.items():
        at = tuple(rng.integers(0, s) for s in p.shape) if k != "E" else (ids[1, 0], 2)
        old = p[at]
        p[at] = old + 1e-3
        up, _ = model.loss_and_gradients(ids, tags)
        p[at] = old - 1e-3
        down, _ = model.loss_and_gradients(ids, tags)
        p[at] = old
        assert (up - down) / 2e-3 == pytest.approx(g[k][at], abs=1e-4)


def test_pii_held_out_accuracy_and_tricky_rows(spark):
    model = pii.tagger()
    rng = random.Random(77)
    made = [pii.labelled(rng) for _ in range(300)]
    base, every = pii.find_spans([t for t, _ in made], model)
    missed = [s for (_, gold), b, e in zip(made, base, every, strict=True) for s in gold if s not in b and s not in e]
    asked = [s for (_, gold), b in zip(made, base, strict=True) for s in gold if s not in b]
    wrong = [s for (_, gold), b, e in zip(made, base, every, strict=True) for s in e if s not in gold and s not in b]
    assert len(missed) < 0.2 * len(asked) and len(wrong) < 0.05 * len(asked)
    rows = [(1, "mail bob7@example.com, 10.0.0.1 ok"), (2, None), (3, ""), (4, "call (212) 555-0142 now"), (4, "call (212) 555-0142 now"), (None, "plain text"), (6, "word " * 50_000 + "x@y.zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r["doc_id"]: r for r in pii.detect(df).collect()}
    assert got[1]["spans"] == "email:5:21,ip:23:31" and got[1]["base_sha256"] == hashlib.sha256(b"email:5:21,ip:23:31").hexdigest()
    assert got[4]["spans"] == "phone:5:19" and got[4]["n_added"] == 1 and got[4]["n_phone"] == 0
    assert got[2]["spans"] == got[3]["spans"] == got[None]["spans"] == "" and got[6]["spans"] == "email:250000:250006"
    red = pii.redact(df)
    assert red.columns == df.columns
    assert collections.Counter(r["text"][:30] if r["text"] else r["text"] for r in red.collect())["call [PHONE] now"] == 2
    assert pii.detect(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_pii_windows_find_what_one_window_finds():
    model = pii.tagger()
    text = "lorem ipsum " * 20 + "call (212) 555-0142 now " + "dolor 12 sit " * 30 + "or 305-555-0199 end"
    base, every = pii.find_spans([text], model)
    assert {text[a:b] for _, a, b in every[0]} == {"(212) 555-0142", "305-555-0199"}


def test_pii_pruned_and_full_decoding_agree():
    model = pii.tagger()
    assert all(pii.TRIGGER.search(s) for s in ("jane.doe [at] example.com", "jane (at) mail.example.org", "jane at example.com", "jane AT example.com", "dead:beef::cafe", "fe:ed::be:ef", "a:b:c:d:e:f:a:b"))
    rng = random.Random(6)
    filler = lambda: "".join(rng.choice(["lorem ", "ipsum, ", "at the dolor. ", "sit\n", "amet ", "note: "]) for _ in range(rng.randrange(80)))
    texts = [filler() + rng.choice(["jane.doe [at] example.com", "jane (at) mail.example.org", "jane at example.com", "dead:beef::cafe", "fe:ed::be:ef"]) + " " + filler() for _ in range(60)]
    texts += [filler() + pii.make_span(rng, rng.choice(pii.KINDS)) + " " + filler() for _ in range(60)] + ["", "x", "word " * 100]
    base = [pii.base_spans(t) for t in texts]
    pruned, full = pii.added_spans(texts, base, model), pii.added_spans(texts, base, model, every=True)
    assert pruned == full and sum(map(bool, pruned[:60])) >= 30


class Marked:
    """A tagger to look at windows alone: all but tildes is a mail address."""

    def viterbi(self, ids):
        inside = (ids > 0) & (ids != ord("~") - 31)
        tags = np.where(inside, 2, 0)
        tags[:, 0] = np.where(inside[:, 0], 1, 0)
        tags[:, 1:][inside[:, 1:] & ~inside[:, :-1]] = 1
        return tags, np.ones(ids.shape)


def test_pii_long_spans_and_spans_as_long_as_the_overlap():
    for host in (3, 10, 40, 200):
        for n in (0, 5, 37, 90, 95, 96, 97, 150, 300):
            mail = "jane (at) " + " (dot) ".join(["part"] * host + ["org"])
            text = "~" * n + mail + "~" * 400
            assert pii.added_spans([text], [[]], Marked()) == [[("email", n, n + len(mail))]]
    for size in (62, 63, 64, 65):
        mail = "a (at) " + "b" * (size - 11) + ".org"
        for n in range(0, 200):
            assert pii.added_spans(["~" * n + mail + "~" * 300], [[]], Marked()) == [[("email", n, n + size)]]


def test_reconcile_takes_the_best_sum():
    spans = [(1.0, "ip", 0, 5), (3.0, "card", 3, 9), (1.5, "ip", 6, 10), (1.0, "phone", 10, 12), (1.0, "phone", 10, 12)]
    assert pii.reconcile(spans) == [("card", 3, 9), ("phone", 10, 12)]


# Licences
def brute_licenses(rows):
    import re

    cut = lambda t: [w for w in (re.sub("^[^a-z0-9]+|[^a-z0-9]+$", "", w) for w in re.split("[\x20\x09-\x0d]+", t.lower())) if w]
    shingles = lambda w: [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    out = []
    for d, t in rows:
        s = shingles(cut(t or ""))
        for name, notice in licenses.TEMPLATES:
            want = set(shingles(cut(notice)))
            at = [i for i, x in enumerate(s) if x in want]
            if len(set(s) & want) / len(want) >= 0.8:
                out.append((d if d is not None else -1, name, len(set(s) & want), len(want), at[0], at[-1] + 5))
    return sorted(out)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(None, licenses.TEMPLATES[9][1]), (0, None), (1, ""), (2, "license"), (3, "x " * 30_000 + licenses.TEMPLATES[1][1])]
    for i, (_, notice) in enumerate(licenses.TEMPLATES * 6):
        words = notice.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["changed", "THE", "licence"])
        pad = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "the", "of"]) for _ in range(rng.randrange(60)))
        rows.append((10 + i, f"{pad()} {' '.join(words).upper() if i % 5 == 0 else ' '.join(words)}\n{pad()}"))
    rows += rows[20:22]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["license"], r["n_matched"], r["n_shingles"], r["first_word"], r["end_word"]) for r in licenses.find_licenses(df).collect())
    assert got == brute_licenses(rows)
    assert licenses.find_licenses(df.limit(0)).count() == 0


def test_licenses_in_texts_that_are_nothing_else(spark):
    rows = []
    for i, (_, notice) in enumerate(licenses.TEMPLATES):  # all beginnings and ends that still match
        words = notice.split()
        rows += [(100 * i + k, " ".join(w)) for k, w in enumerate([words, words[:-1], words[1:], words[: len(words) * 9 // 10], words[len(words) // 10 :]])]
    df = spark.createDataFrame([*rows, (9999, "This work is licensed under a Creative Commons Attribution 4.0 International")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["license"], r["n_matched"], r["n_shingles"], r["first_word"], r["end_word"]) for r in licenses.find_licenses(df).collect())
    assert got == brute_licenses([(r["doc_id"], r["text"]) for r in df.collect()]) and any(g[0] == 9999 for g in got)


# The pipeline
@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet") if os.path.exists("/root/testdata/sf0.001") else pytest.skip("no test data")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    copies = collections.Counter(r["doc_id"] for r in docs.collect())
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies and max(copies.values()) <= 2
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(pii.base_spans(t) for t in texts.values())
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_viterbi_and_the_partition_function_by_enumeration():
    """All tag sequences of short texts, padded ones among them, against the best path and the loss."""
    rng = np.random.default_rng(4)
    model = bilstm.BiLstmCrf.fresh(3, embedding=4, hidden=5, seed=1)
    for name in ("T", "S", "F", "c"):
        model.params[name] = rng.standard_normal(model.params[name].shape).astype(np.float32)
    ids = rng.integers(1, bilstm.SYMBOLS, (6, 5))
    lengths = [5, 4, 3, 2, 1, 5]
    for r, n in enumerate(lengths):
        ids[r, n:] = bilstm.PAD
    gold = rng.integers(0, 3, (6, 5))
    e, _ = model.emissions(ids)
    p, total = model.params, 0.0
    tags, _ = model.viterbi(ids)
    for r, n in enumerate(lengths):
        path = lambda y: float(p["S"][y[0]] + sum(e[t, r, k] for t, k in enumerate(y)) + sum(p["T"][a, b] for a, b in itertools.pairwise(y)) + p["F"][y[-1]])  # noqa: B023, E731
        scores = {y: path(y) for y in itertools.product(range(3), repeat=n)}
        assert tuple(tags[r, :n].tolist()) == max(scores, key=scores.get)
        total += np.log(np.exp(list(scores.values())).sum()) - scores[tuple(gold[r, :n].tolist())]
    loss, _ = model.loss_and_gradients(ids, gold)
    assert loss == pytest.approx(total / 6, abs=1e-4)


def test_gif_feature_by_hand(spark):
    """The feature of a payload of several frames: each frame draws over the top rows of the canvas, and its shown pixels are counted."""
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(32, 127, 64 * 2500)))
    row = gif.media_digest(gif.encode_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    rows = np.frombuffer(text.encode(), np.uint8).reshape(-1, 64)
    canvas, counts = np.zeros((1024, 64), np.uint8), np.zeros(8, np.int64)
    for r in range(0, len(rows), 1024):
        part = rows[r : r + 1024]
        canvas[: len(part)] = part
        counts += np.bincount(canvas.ravel() >> 5, minlength=8)
    n = ",".join(map(str, [*counts] * 3))
    assert row["feature"] == f"64x1024;3 frames;{3 * gif.DELAY * 10} ms;rgb8:{n}"
