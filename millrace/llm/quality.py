"""Quality rules with n-gram perplexity.

The language model is a character 4-gram model over the words of all documents, across word ends, with
modified Kneser-Ney smoothing (Chen and Goodman 1998), one for each language. Symbols are code points as
they are, and the model grows with the corpus: nothing of it is capped, collected or broadcast.

1. Count: each task finds the distinct 4-grams of its block of texts, how often each occurs and how many
   documents hold it, and writes them to the shared folder. Spark sums them by 4-gram. A document's
   occurrences of a 4-gram count for the number of their binary digits (1 for 1, 2 for 2 or 3, 3 for 4 to 7),
   so that a long text of junk doesn't outweigh many others.
2. Smooth: the highest order counts so, lower orders count distinct left neighbours. A 4-gram that
   one document alone holds isn't in the model, nor is anything that follows from it: else a document
   would be scored by what it says itself, and noise would find itself likely. All of this is DataFrame
   code over tables keyed by 4-gram, context or suffix.
3. Score: the log probabilities go back by hash to the blocks that asked for them, where they meet the
   block's texts as sorted hash arrays, searched by bisection.

Each language has a lower and an upper band of log perplexity around the median of its documents, by
classes of length, as the perplexity of short documents is less certain. The widths are the corpus' own:
so many robust spreads of the deviations above the median, and of those below it. Too high is noise, too
low is boilerplate. Bands and counts are over all documents.

At scale: texts are read twice, once to count and once to be scored; for scoring they are compressed and
shuffled once, to the hash arrays of their block. A block is a partition of the input (so a plain scan has
blocks of spark.sql.files.maxPartitionBytes), and both passes must see the same partitions, which holds for
tables; an input with a shuffle is written as one first, and a 4-gram that wasn't counted is an error, not a
guess. What is shuffled besides is a row a distinct
4-gram of a block. Contexts have at most as many rows as there are code points, so no window is unbounded.

Defined results: a null or empty text has no words and fails the base rule. A null language is one of its
own. Of a language with a single document the model is the uniform one over its symbols. Repeated rows are
judged alike. An empty table gives an empty one. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, free_name, trim, utf8

#: Steps of log perplexity in the histograms, in nats.
STEP = 0.002
TOP = 1 << 13
#: Classes of length: powers of two of events, from 2**6 or fewer to 2**16 or more.
CLASSES, FIRST_CLASS = 11, 6
#: Rows scored at a time, and 4-grams of documents that are gathered before they are merged.
ROWS, GATHER = 400, 1 << 20
#: The bits of a code point, and the symbols of one block's alphabet before it starts anew.
BITS, ALPHABET = 21, 1 << 16
#: Models whose discounts are broadcast (five numbers each); more are joined.
BROADCAST_MODELS = 50_000
# The characters that count as symbols.
SYMBOL_CHARACTERS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
EDGE = "\n"


@dataclass(frozen=True)
class QualityPolicy:
    """widths: band half-widths in robust spreads of their own side; class_docs: classes of length with fewer documents take the spreads of the whole language."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    lower_width: float = 8.0
    upper_width: float = 8.0
    least_spread: float = 0.01
    class_docs: int = 200


def model_of(lang: str) -> Column:
    """The number of a language's model."""
    c = F.col(f"`{lang}`").cast("string")
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c))


def code_points(words: list[bytes]) -> np.ndarray:
    """Of the words, one space apart, with three edges before and one after."""
    text = EDGE * 3 + b" ".join(words).decode("utf-8", "surrogatepass") + EDGE
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hash(model: int, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, c4: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(c1), np.uint64(model & (1 << 64) - 1) * np.uint64(0xD6E8FEB86659FD93), np.uint64)
        for c, k in ((c1, 0x9E3779B97F4A7C15), (c2, 0xC2B2AE3D27D4EB4F), (c3, 0xD1342543DE82EF95), (c4, 0xA0761D6478BD642F)):
            h += (c.astype(np.uint64) + np.uint64(1)) * np.uint64(k)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def damped(n: np.ndarray) -> np.ndarray:
    """What a document's n occurrences count for: the number of binary digits of n."""
    return np.frexp(n)[1].astype(np.int64)


class GramCounter:
    """The distinct 4-grams of documents of one language: how many documents hold each, and what their occurrences count for."""

    def __init__(self):
        self.table = np.full(1 << BITS, -1, np.int32)
        self.done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._anew()

    def _anew(self) -> None:
        self.symbols = np.zeros(0, np.uint32)
        self.table.fill(-1)
        self.grams, self.docs, self.counts, self.waiting, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, points: np.ndarray) -> None:
        new = np.unique(points[self.table[points] < 0])
        if len(self.symbols) + len(new) > ALPHABET:
            self._flush()
            new = np.unique(points)
            if len(new) > ALPHABET:  # one document with that many symbols
                every, n = np.unique(np.stack([points[k : len(points) - 3 + k] for k in range(4)]), axis=1, return_counts=True)
                self.done.append((every, np.ones(len(n), np.int64), damped(n)))
                return
        self.table[new] = np.arange(len(self.symbols), len(self.symbols) + len(new))
        self.symbols = np.concatenate([self.symbols, new])
        x = self.table[points].astype(np.uint64)
        codes = np.sort(x[:-3] << np.uint64(48) | x[1:-2] << np.uint64(32) | x[2:-1] << np.uint64(16) | x[3:])
        at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        self.waiting.append((codes[at], damped(np.diff(at, append=len(codes)))))
        self.size += len(at)
        if self.size > GATHER:
            self._merge()

    def _merge(self) -> None:
        if self.waiting:
            grams, counts = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            docs = np.concatenate([self.docs, np.ones(len(grams), np.int64)])
            self.grams, at = np.unique(np.concatenate([self.grams, grams]), return_inverse=True)
            self.docs, self.counts = (np.bincount(at, x, len(self.grams)).astype(np.int64) for x in (docs, np.concatenate([self.counts, counts])))
            self.waiting, self.size = [], 0

    def _flush(self) -> None:
        self._merge()
        if len(self.grams):
            parts = [self.symbols[(self.grams >> np.uint64(shift)) & np.uint64(ALPHABET - 1)] for shift in (48, 32, 16, 0)]
            self.done.append((np.stack(parts), self.docs, self.counts))
        self._anew()

    def result(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Four rows of code points, documents, counts; a 4-gram may come more than once, each time for other documents."""
        self._flush()
        yield from self.done


def count_grams(df: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """block, model, hash, the first code point, the middle two in one number, the last, the documents of the block that hold the 4-gram, and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        counters: dict[int, GramCounter] = {}
        for b in batches:
            for m, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = utf8(t.as_py()).split()
                if words:
                    if m not in counters:
                        counters[m] = GramCounter()
                    counters[m].add(code_points(words))
        for m, counter in counters.items():
            for (c1, c2, c3, c4), docs, n in counter.result():
                k = len(n)
                columns = [np.full(k, block, np.int32), np.full(k, m, np.int64), gram_hash(m, c1, c2, c3, c4).view(np.int64), c1.astype(np.int32), c2.astype(np.int64) << BITS | c3, c4.astype(np.int32), docs, n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "model", "hash", "first", "middle", "last", "docs", "n"])
        counters.clear()
        trim()

    rows = df.select(model_of(lang).alias("m"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(run, "block int, model long, hash long, first int, middle long, last int, docs long, n long")


def discounts(table: DataFrame) -> DataFrame:
    """By model, the discounts of counts 1, 2 and 3 or more in column n; half of what is left where the counts of counts don't give one."""
    ones = table.groupBy("model").agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def one(k: int) -> Column:
        ok = (F.col("n1") > 0) & (F.col(f"n{k}") > 0)
        return F.least(F.greatest(F.when(ok, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(0.5), F.lit(0.05)), F.lit(float(k)))

    return ones.select("model", *(one(k).alias(f"d{k}") for k in (1, 2, 3)))


def level(scratch: Scratch, table: DataFrame, context: list[str]) -> DataFrame:
    """Adds own, the discounted probability of a row in its context, and back, the weight of the lower order there. Rows that aren't seen are not in the model."""
    found = scratch.keep(discounts(table))
    small = found.count() <= BROADCAST_MODELS
    d = F.when(F.col("n") >= 3, F.col("d3")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d1"))
    seen = F.col("seen")
    over = W.partitionBy("model", *context)
    rows = table.join(F.broadcast(found) if small else found, "model").withColumn("d", F.when(seen, d).otherwise(0.0)).drop("d1", "d2", "d3")
    rows = rows.withColumn("total", F.sum(F.when(seen, F.col("n")).otherwise(0)).over(over)).withColumn("cut", F.sum("d").over(over))
    own = F.when(seen, (F.col("n") - F.col("d")) / F.col("total")).otherwise(0.0)
    return rows.withColumn("own", own).withColumn("back", F.when(F.col("total") > 0, F.col("cut") / F.col("total")).otherwise(1.0)).drop("d", "total", "cut")


def log_probabilities(scratch: Scratch, grams: DataFrame) -> DataFrame:
    """hash, logp of all 4-grams in the output of count_grams, those that aren't in the model too."""
    of = F.count_if("seen").alias("n"), F.bool_or("seen").alias("seen")
    every = scratch.keep(grams.groupBy("model", "middle", "first", "last").agg(F.sum("n").alias("n"), (F.sum("docs") >= 2).alias("seen"), F.any_value("hash").alias("hash")))
    third = scratch.keep(every.groupBy("model", "middle", "last").agg(*of))
    inner = F.col("middle").bitwiseAND(F.lit((1 << BITS) - 1)).alias("inner")
    second = scratch.keep(third.groupBy("model", inner, "last").agg(*of))
    single = scratch.keep(second.groupBy("model", "last").agg(*of))
    uniform = 1.0 / F.count(F.lit(1)).over(W.partitionBy("model"))
    p = scratch.keep(level(scratch, single, []).select("model", "last", (F.col("own") + F.col("back") * uniform).alias("p")))
    p = scratch.keep(level(scratch, second, ["inner"]).join(p, ["model", "last"]).select("model", "inner", "last", (F.col("own") + F.col("back") * F.col("p")).alias("p")))
    p = level(scratch, third, ["middle"]).withColumn("inner", inner).join(p, ["model", "inner", "last"]).select("model", "middle", "last", (F.col("own") + F.col("back") * F.col("p")).alias("p"))
    top = level(scratch, every, ["middle", "first"]).join(p, ["model", "middle", "last"])
    return top.select("hash", F.log(F.col("own") + F.col("back") * F.col("p")).cast("float").alias("logp"))


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int) -> np.ndarray:
    """By document, the words that lie in windows found twice or more in it. ids and doc: of all words in order.

    Windows are compared by a rolling 64-bit hash; equal hashes are then compared word by word.
    """
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        h ^= h >> np.uint64(29)
        h = (h + doc[:n].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    starts = np.flatnonzero(doc[:n] == doc[window - 1 : window - 1 + n])
    order = starts[np.argsort(h[starts], kind="stable")]
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    a, b = order[same], order[same + 1]
    equal = doc[a] == doc[b]
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    edge = np.zeros(len(ids) + 1, np.int64)
    hit = np.unique(np.concatenate([a[equal], b[equal]]))
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def base_counts(text: str | None) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    if not text:
        return 0, 0, 0
    dup = 0
    lines = text.split("\n")
    if len(lines) > 1 and len(set(lines)) < len(lines):
        dup = sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(WHITE))
    return len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOL_CHARACTERS)), dup


SCORES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lm_model", "lm_events", "log_perplexity")


def base_batch(words: list[list[bytes]], texts: list, policy: QualityPolicy) -> list[np.ndarray]:
    """The first five of SCORES."""
    n = len(texts)
    base = np.array([base_counts(t) for t in texts], np.int64).reshape(n, 3)
    n_words = np.fromiter(map(len, words), np.int64, n)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(n_words.sum()))
    repeats = repeated_words(ids, np.repeat(np.arange(n), n_words), n, policy.window)
    return [n_words, base[:, 0], base[:, 1], base[:, 2], repeats]


def perplexities(words: list[list[bytes]], models: list[int], keys: np.ndarray, logp: np.ndarray) -> list[np.ndarray]:
    """The events and the log perplexity of texts, by a sorted hash array."""
    events, cost = np.zeros(len(words), np.int64), np.zeros(len(words))
    for i, (w, m) in enumerate(zip(words, models, strict=True)):
        if w:
            x = code_points(w)
            grams, n = np.unique(gram_hash(m, x[:-3], x[1:-2], x[2:-1], x[3:]), return_counts=True)
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            if len(keys) == 0 or not (keys[at] == grams).all():
                raise RuntimeError("a text has n-grams that weren't counted in its block: the input's partitions differ between two reads; write it as a table first")
            events[i] = len(x) - 3
            cost[i] = -(n * logp[at].astype(np.float64)).sum() / events[i]
    return [events, cost]


def score(scratch: Scratch, df: DataFrame, policy: QualityPolicy, lang: str, text: str, keep: list[str]) -> DataFrame:
    """The columns in keep, then SCORES; columns whose names clash with those of SCORES are left to the caller. Written to the shared folder."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = scratch.keep(df)
    grams = scratch.keep(count_grams(df, lang, text))
    answers = grams.select("block", "hash").join(scratch.keep(log_probabilities(scratch, grams)), "hash")
    n = len(keep)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the block, a few together, compressed."""
        block = TaskContext.get().partitionId()
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema, options=options) as writer:
                    writer.write_batch(whole.slice(i, ROWS))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.large_binary())], names=["block", "rows"])
        trim()

    types = [pa.int64()] * 7 + [pa.float64()]
    kept = [df.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(keep, kept, strict=True)), *(f"{c} long" for c in SCORES[:-1]), f"{SCORES[-1]} double"])

    def scored(texts: pa.Table, found: pa.Table) -> pa.Table:
        hashes = found.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        keys, logp = hashes[order], found.column("logp").to_numpy()[order]
        out = []
        for chunk in texts.column("rows").chunks:
            for rows in chunk:
                for b in pa.ipc.open_stream(rows.as_buffer()):
                    models, plain = b.column(n).to_pylist(), b.column(at).to_pylist()
                    words = [utf8(t).split() for t in plain]
                    made = [*base_batch(words, plain, policy), np.array(models, np.int64), *perplexities(words, models, keys, logp)]
                    out.append(pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(c, t) for c, t in zip(made, types, strict=True))], names=[*keep, *SCORES]))
        trim()
        return pa.Table.from_batches(out)

    extra = [model_of(lang).alias(free_name("_model", keep))]
    if text in keep and df.schema[text].dataType.simpleString() == "string":
        at = keep.index(text)  # not sent twice
    else:
        at = n + 1
        extra.append(F.col(f"`{text}`").cast("string").alias(free_name("_text", keep)))
    texts = df.select(*(F.col(f"`{c}`") for c in keep), *extra).mapInArrow(packed, "block int, rows binary")
    return scratch.keep(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema))


def base_failed(policy: QualityPolicy):
    return (F.col("n_words") < policy.min_words) | (100 * F.col("n_repeat_words") > policy.max_repeat_percent * F.col("n_words"))


def length_class():
    return F.least(F.greatest(F.floor(F.log2(F.greatest(F.col("lm_events"), F.lit(1)))) - FIRST_CLASS, F.lit(0)), F.lit(CLASSES - 1)).cast("int")


def spreads(hist: np.ndarray, policy: QualityPolicy) -> tuple[float, float, float]:
    """The median of a histogram, and the robust spreads below and above it."""
    middle = int(np.searchsorted(np.cumsum(hist), hist.sum() / 2))

    def side(n: np.ndarray) -> float:
        """n: by steps away from the middle; half of the middle's own documents lie on this side."""
        n = np.concatenate([[n[0] / 2], n[1:]])
        return max(1.4826 * STEP * int(np.searchsorted(np.cumsum(n), n.sum() / 2)), policy.least_spread)

    return (middle + 0.5) * STEP, side(hist[middle::-1]), side(hist[middle:])


def bands(scored: DataFrame, policy: QualityPolicy) -> DataFrame:
    """lm_model, length_class, low, high: the least and the largest log perplexity that is kept, from histograms of all documents that pass the base rule.

    A model's histogram has CLASSES * TOP rows at most.
    """
    step = F.least(F.greatest(F.floor(F.col("log_perplexity") / STEP), F.lit(0)), F.lit(TOP - 1)).cast("int")
    rows = scored.where(~base_failed(policy)).groupBy("lm_model", length_class().alias("c"), step.alias("s")).agg(F.count(F.lit(1)).alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        hist = np.zeros((CLASSES, TOP), np.int64)
        hist[pdf["c"], pdf["s"]] = pdf["n"]
        whole, out = spreads(hist.sum(axis=0), policy), []
        for c in range(CLASSES):
            middle, below, above = spreads(hist[c], policy) if hist[c].sum() >= policy.class_docs else whole
            out.append((int(pdf["lm_model"].iloc[0]), c, middle - policy.lower_width * below, middle + policy.upper_width * above))
        return pd.DataFrame(out, columns=["lm_model", "length_class", "low", "high"])

    return rows.groupBy("lm_model").applyInPandas(one, "lm_model long, length_class int, low double, high double")


def with_verdict(scored: DataFrame, found: DataFrame, policy: QualityPolicy) -> DataFrame:
    """Adds base_failed and kept. found: the bands."""
    if found.count() <= CLASSES * BROADCAST_MODELS:
        found = F.broadcast(found)
    names = {c: f"_band_{c}" for c in ("lm_model", "length_class", "low", "high")}
    found = found.withColumnsRenamed(names)
    on = (F.col("lm_model") == F.col("_band_lm_model")) & (length_class() == F.col("_band_length_class"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("_band_low"), F.col("_band_high")), F.lit(True))
    rows = scored.join(found, on, "left").withColumn("base_failed", base_failed(policy))
    return rows.withColumn("kept", ~F.col("base_failed") & inside).drop(*names.values())


def judge(df: DataFrame, policy: QualityPolicy = QualityPolicy(), doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, SCORES, base_failed, kept."""
    scratch = Scratch(df.sparkSession, "quality")
    key = free_name("_key", [*SCORES, "base_failed", "kept"])
    aside = df.select(F.col(f"`{doc_id}`").alias(key), F.col(f"`{lang}`").alias("_l"), F.col(f"`{text}`").alias("_t"))
    scored = score(scratch, aside, policy, "_l", "_t", [key])
    done = with_verdict(scored, scratch.keep(bands(scored, policy)), policy)
    return scratch.last(done.withColumnRenamed(key, doc_id))


def keep_good(df: DataFrame, policy: QualityPolicy = QualityPolicy(), lang: str = "lang", text: str = "text") -> DataFrame:
    """The rows that are kept, with their own columns. Rows are scored once and written with their scores; the bands then filter them."""
    scratch = Scratch(df.sparkSession, "quality")
    safe = {c: f"_{i}" for i, c in enumerate(df.columns)}
    aside = df.toDF(*safe.values())
    scored = score(scratch, aside, policy, safe[lang], safe[text], list(safe.values()))
    found = scratch.keep(bands(scored, policy))
    scratch.leave(scored, found)
    return with_verdict(scored, found, policy).where("kept").select(*(F.col(safe[c]).alias(c) for c in df.columns))
