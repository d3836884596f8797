"""Best-fit-decreasing packing of token sequences, with a segment tree over remaining capacities.

Lengths are whole numbers up to the sequence length, so the packing depends on the histogram of
lengths alone, and that has a fixed size. Best-fit decreasing runs on the histogram: items of one
length, and open bins of one remaining capacity, are handled as runs. The segment tree finds the
tightest open bin for a length in logarithmic time. Its result, a few thousand runs at most whatever
the size of the corpus, says which ranks of a length go to which sequences, and where.

At scale: texts are tokenised once, in Arrow batches, and written to the shared folder as slim rows.
A piece's rank among those of its length comes from two levels of counts, with rows dealt into
buckets by a hash of the row number, so that a length that a third of all pieces share is spread.
The plan that is broadcast is bounded by the sequence length.

Defined results: a null or empty text is the end token alone. Documents longer than a sequence are cut
into whole sequences, the first piece being the shorter one. Repeated rows are packed each on its own.
An empty table gives an empty one.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, materialize, trim, unlike

#: Entries of a worker's cache of chunks; when it is full, it starts anew.
CACHE = 1 << 19
#: Bytes of text that are split at a time (a longer text is alone), and chunks that are tokenised run together.
GROUP, RUN = 1 << 22, 4096

#: A space inside a run of white space, or at its end at the end of the text: there a cut before the space is not the pre-tokenizer's.
INNER_SPACE = r"[\pZ\x09-\x0D\x1C-\x1F\x85] (?:[\pZ\x09-\x0D\x1C-\x1F\x85]|\z)"
#: A chunk that can be run together with others: a space, then no white space at either end.
APART = r"(?s)\A [^\pZ\x09-\x0D\x1C-\x1F\x85](.*[^\pZ\x09-\x0D\x1C-\x1F\x85])?\z"


class ChunkEncoder:
    """Token ids of texts by the tokenizer in a file.

    A byte-level pre-tokenizer cuts before a space that has no white space on one of its sides, so the
    chunks of a text that begin at its spaces can be tokenised alone. Texts are split and their chunks
    dictionary-encoded in Arrow; each distinct chunk is tokenised once while it stays in the cache, and
    the ids of the texts are gathered by numpy. Other texts, and all texts of a tokenizer that isn't a
    plain byte-level BPE, are tokenised whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.by_chunks = self._is_byte_level(json.loads(self.tokenizer.to_str()))
        n = self.tokenizer.get_vocab_size()
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)])  # byte-level: a character of a token's name is a byte
        self._forget()

    @staticmethod
    def _is_byte_level(made: dict) -> bool:
        """Whether a cut at a chunk's edge can't change the ids: nothing but the byte-level pre-tokenizer and BPE works on the text."""
        pre = made.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        return plain and made.get("normalizer") is None and made["model"].get("type") == "BPE" and not any(not t.get("special") for t in made.get("added_tokens", []))

    def _forget(self) -> None:
        """known: the chunks; their ids follow one another in raw, those of the i-th from ends[i] to ends[i + 1]."""
        self.known = pa.array([], pa.large_string())
        self.raw, self.ends = np.zeros(1 << 16, "<u4"), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, chunks: pa.Array, ids: list[np.ndarray], ends: list[np.ndarray]) -> None:
        """ends: of the chunks of each part of the ids, from the part's begin."""
        if not len(chunks):
            return
        made = np.concatenate(ids)
        used = int(self.ends[-1])
        if used + len(made) > len(self.raw):
            self.raw = np.concatenate([self.raw[:used], np.zeros(used + 2 * len(made), "<u4")])
        self.raw[used : used + len(made)] = made
        self.known = pa.concat_arrays([self.known, chunks])
        before = used + np.cumsum([0, *(len(i) for i in ids[:-1])])
        self.ends = np.concatenate([self.ends, *(e + x for e, x in zip(ends, before.tolist(), strict=True))])

    def _learn(self, new: pa.Array) -> np.ndarray:
        """The places of new chunks. Most are tokenised many at a time, run together, and cut apart by the byte lengths of the tokens."""
        apart = pc.match_substring_regex(new, APART)
        fit, rest = new.filter(apart), new.filter(pc.invert(apart))
        place, apart = np.empty(len(new), np.int64), apart.to_numpy(zero_copy_only=False)
        place[apart], place[~apart] = len(self.known) + np.arange(len(fit)), len(self.known) + len(fit) + np.arange(len(rest))
        offsets = np.frombuffer(fit.buffers()[1], np.int64)[fit.offset : fit.offset + len(fit) + 1] if len(fit) else np.zeros(1, np.int64)
        ids, ends = [], []
        for i in range(0, len(fit), RUN):
            edges = offsets[i : i + RUN + 1]
            ids.append(self._encode([str(memoryview(fit.buffers()[2])[edges[0] : edges[-1]], "utf-8")])[0])
            ends.append(np.searchsorted(np.cumsum(self.n_bytes[ids[-1]]), edges[1:] - edges[0], side="right"))
        self._add(fit, ids, ends)
        alone = self._encode(rest.to_pylist())
        self._add(rest, alone, [np.array([len(i)]) for i in alone])
        return place

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks at these places, one after another, and where each chunk ends."""
        store = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.known), [None, pa.py_buffer(4 * self.ends), pa.py_buffer(self.raw)])
        _, ends, data = store.take(pa.array(place)).buffers()
        ends = np.frombuffer(ends, np.int64)[: len(place) + 1] // 4
        return np.frombuffer(data, "<u4")[: ends[-1]] if data is not None else np.zeros(0, "<u4"), ends

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of groups of texts without nulls, in order: all their ids and the number of each text's."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP, side="right")))
            yield self._some(texts.slice(at, stop - at))
            at = stop

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        odd = np.ones(n, bool)
        if self.by_chunks:
            odd = pc.or_(pc.match_substring_regex(texts, INNER_SPACE), pc.match_substring(texts, "\0")).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(odd)
        rest = texts.filter(pa.array(~odd)).cast(pa.large_string())
        split = pc.split_pattern(pc.replace_substring(rest, " ", "\0 "), "\0")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary
        if len(self.known) + len(distinct) > CACHE:
            self._forget()
        at = pc.index_in(distinct, value_set=self.known)
        fresh = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        at[fresh] = self._learn(distinct.filter(pa.array(fresh)))
        ids, ends = self._gather(at[coded.indices.to_numpy()])
        edges = ends[split.offsets.to_numpy() - split.offsets[0].as_py()] if len(rest) else np.zeros(1, np.int64)
        counts = np.zeros(n, np.int64)
        counts[~odd] = np.diff(edges)
        if not len(whole):
            return ids, counts
        # Texts that were tokenised whole go between the others.
        alone = self._encode(texts.take(pa.array(whole)).to_pylist())
        counts[whole] = [len(a) for a in alone]
        out, last = np.empty(int(counts.sum()), "<u4"), np.cumsum(counts)
        out[np.repeat(~odd, counts)] = ids
        for i, a in zip(whole, alone, strict=True):
            out[last[i] - len(a) : last[i]] = a
        return out, counts


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> ChunkEncoder:
    return ChunkEncoder(path or vocabulary())


def token_pieces(df: DataFrame, size: int, end_id: int = 2, path: str | None = None, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with keep_ids, the ids: a row for each piece. path: the tokenizer's file; None finds the public one where the worker runs."""
    kind = df.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = _encoder(path)
        for b in batches:
            first = 0
            for ids, counts in encoder.encode(pc.fill_null(b.column(1), "")):
                ends = np.cumsum(counts)
                n = counts + 1
                ids = np.insert(ids, ends, np.uint32(end_id))
                pieces = -(-n // size)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (n - 1) % size + 1  # the length of the first piece
                start = np.where(piece > 0, head[row] + (piece - 1) * size, 0)
                length = np.where(piece > 0, size, head[row])
                at = (np.cumsum(n) - n)[row] + start
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [b.column(0).take(pa.array(row + first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([at, [len(ids)]]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                first += len(n)
        trim()

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


class CapacityTree:
    """Counts of open bins by remaining capacity, with sums above them; finds the least capacity of at least x that has a bin, in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.leaves
        while i:
            self.sums[i] += bins
            i >>= 1

    def tightest(self, x: int) -> int | None:
        i = x + self.leaves
        while not self.sums[i]:
            while i & 1:  # a right child: go up past it
                i >>= 1
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of its level
                return None
        while i < self.leaves:
            i = 2 * i if self.sums[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, end rank, first sequence, items a sequence, offset) and the number of sequences.

    As placing items one by one, longest first, each into the tightest open bin: equal items go on filling
    the bin that took the first of them, as it has become the tightest, so a run of equal bins takes a run of items.
    """
    tree, open_bins, runs, made = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                bins = -(-left // each)
                first, made = made, made + bins
            else:
                first, bins = open_bins[room].pop()
                each = room // length
                tree.add(room, -bins)
            used = min(bins, -(-left // each))
            items = min(left, used * each)
            runs.append((length, rank, rank + items, first, each, capacity - room))
            full, rest = divmod(items, each)
            for at, n, r in ((first, full, room - each * length), (first + full, 1 if rest else 0, room - rest * length), (first + used, bins - used, room)):
                if n and r:
                    open_bins.setdefault(r, []).append((at, n))
                    tree.add(r, n)
            rank, left = rank + items, left - items
    return runs, made


def pack(pieces: DataFrame, capacity: int, length: str = "length", per_bucket: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity; keeps the other columns.

    The rows are written to the shared folder first, with a row number, so that ranks stay as they are.
    """
    row, bucket, within, rank = (free_name(n, pieces.columns) for n in ("_row", "_bucket", "_within", "_rank"))
    kept = unlike(pieces.columns, ("sequence_id", "offset"))
    rows = materialize(pieces.select(*(f"`{c}`" for c in kept)).withColumn(row, F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in rows.groupBy(f"`{length}`").agg(F.count(F.lit(1))).collect()}  # capacity rows at most
    runs, _ = best_fit_decreasing(counts, capacity)
    buckets = max(256, sum(counts.values()) // per_bucket)
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(row), F.lit(buckets)))
    sums = dealt.groupBy(F.col(f"`{length}`").alias("_l"), F.col(bucket).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("_l", "_b", (F.sum("_n").over(W.partitionBy("_l").orderBy("_b")) - F.col("_n")).alias("_before"))
    ranked = dealt.withColumn(within, F.row_number().over(W.partitionBy(length, bucket).orderBy(row)) - 1)
    ranked = ranked.join(before, (F.col(f"`{length}`") == F.col("_l")) & (F.col(bucket) == F.col("_b"))).withColumn(rank, F.col(within) + F.col("_before"))
    plan = pieces.sparkSession.createDataFrame(runs, "_len long, _from long, _to long, _first long, _each long, _at long")
    on = (F.col(f"`{length}`") == F.col("_len")) & (F.col(rank) >= F.col("_from")) & (F.col(rank) < F.col("_to"))
    place = F.expr(f"(`{rank}` - _from) div _each")
    return ranked.join(F.broadcast(plan), on).select(*(f"`{c}`" for c in kept), (F.col("_first") + place).alias("sequence_id"), (F.col("_at") + F.expr(f"(`{rank}` - _from) % _each") * F.col(f"`{length}`")).alias("offset"))


def pack_documents(df: DataFrame, size: int = 1024, **options) -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(token_pieces(df, size, **options), size)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids, from packed pieces that kept their ids. A sequence has at most its capacity of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
