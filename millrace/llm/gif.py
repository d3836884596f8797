"""GIF media columns: a decoder for any GIF, and a lossless encoder for payloads of 8-bit samples.

The decoder reads LZW code streams (deferred clear codes included), applies global and local palettes,
interlacing, transparency and disposal, and gives timed frames with their own samples, the canvas as
shown, and colour histograms. Codes are cut from the bit stream with numpy, as their widths depend on
their positions alone; strings are rebuilt with one step a code. The encoder writes grey samples,
64 wide, in frames of a bounded number of rows.

At scale: both are narrow passes over Arrow batches, a few rows at a time; nothing is shuffled. A frame
has 64 KiB of samples at most, so memory follows the longest payload alone.

Defined results: a null text is empty. An empty payload is padded as others are, to 64 zero bytes.
A damaged image gives its frames up to the damage and an error. Equal payloads give equal media.
Repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, unlike, utf8

WIDTH = 64
FRAME_ROWS = 1024
DELAY = 10
#: Rows encoded or decoded before their batch is handed on.
ROWS = 256


def _widths(first: int, n: int) -> np.ndarray:
    """Bits of the codes after a clear code: the table grows by one a code after the first, to 4096 entries."""
    nxt = (1 << first) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(nxt)).astype(np.int64) + 1, first + 1, 12)


_WIDTHS = {s: _widths(s, 8192) for s in range(2, 9)}
_STARTS = {s: np.concatenate([[0], np.cumsum(w)]) for s, w in _WIDTHS.items()}


def lzw_encode(data: bytes, first: int = 8) -> bytes:
    clear, full = 1 << first, 4096
    segments, codes = [], []
    table: dict[int, int] = {}
    get, put, nxt = table.get, codes.append, clear + 2
    if data:
        prefix = data[0]
        for b in data[1:]:
            key = prefix << 8 | b
            if (prefix := get(key)) is None:
                put(key >> 8)
                prefix = b
                table[key] = nxt
                nxt += 1
                if nxt == full:
                    put(clear)
                    segments.append(codes)
                    codes, table, nxt = [], {}, clear + 2
                    get, put = table.get, codes.append
        put(prefix)
    put(clear + 1)
    segments.append(codes)
    values = np.array([clear] + [c for s in segments for c in s], np.uint16)
    bits = np.concatenate([[first + 1], *(_WIDTHS[first][: len(s)] for s in segments)])
    grid = (values[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(grid[np.arange(12) < bits[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(raw: bytes, first: int, limit: int) -> bytes:
    """At most limit samples. Ends at the end code, at the limit, or with the data; a code that isn't in the table is an error."""
    clear, end = 1 << first, (1 << first) + 1
    data = np.frombuffer(raw + b"\0\0\0", np.uint8).astype(np.uint32)
    total, at, size, out, done = 8 * len(raw), 0, 0, [], 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, prev, seen = list(roots), None, 0
    while True:
        widths, starts = _WIDTHS[first], _STARTS[first]
        if seen >= 4096:  # the table is full: all codes have 12 bits until a clear code
            n = min(4096, (total - at) // 12)
            bits, pos = np.full(n, 12), at + 12 * np.arange(n)
        else:
            pos = at + starts[seen : seen + 4096] - starts[seen]
            bits = widths[seen : seen + 4096]
            n = int(np.searchsorted(pos + bits, total, side="right"))
            pos, bits = pos[:n], bits[:n]
        if not n:
            break
        i = pos >> 3
        codes = ((data[i] | data[i + 1] << 8 | data[i + 2] << 16) >> (pos & 7).astype(np.uint32)) & ((1 << bits) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stop[0]) if len(stop) else n
        some = codes[:used].tolist()
        if prev is None and some:
            prev = table[some[0]] if some[0] < len(table) else b""
            if not prev:
                raise ValueError("LZW code beyond the table")
            out.append(prev)
            del some[0]
        new = 4096 - len(table)
        put, add = out.append, table.append
        for c in some[:new]:
            try:
                s = table[c]
            except IndexError:
                if c > len(table):
                    raise ValueError("LZW code beyond the table") from None
                s = prev + prev[:1]
            add(prev + s[:1])
            put(s)
            prev = s
        if len(some) > new:  # the table is full
            out += map(table.__getitem__, some[new:])
            prev = out[-1]
        size += sum(map(len, out[done:]))
        done = len(out)
        if size >= limit:
            break
        if len(stop):
            at = int(pos[used] + bits[used])
            if codes[used] == end:
                break
            table, prev, seen = list(roots), None, 0
        else:
            at, seen = int(pos[-1] + bits[-1]), seen + used
    return b"".join(out)[:limit]


def _blocks(raw: bytes) -> bytes:
    return b"".join(bytes([len(raw[i : i + 255])]) + raw[i : i + 255] for i in range(0, len(raw), 255)) + b"\0"


#: The largest canvas and frame that are decoded, in pixels of four bytes.
MAX_PIXELS = 1 << 26
GREYS = bytes(v for i in range(256) for v in (i, i, i))


def encode(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """payload: rows of width samples, one at least. Frames follow each other in time, each with the next rows."""
    rows = len(payload) // width
    if not rows or len(payload) % width:
        raise ValueError("the payload isn't whole rows")
    le = lambda v: v.to_bytes(2, "little")
    out = [b"GIF89a", le(width), le(min(rows, frame_rows)), b"\xf7\0\0", GREYS]
    for r in range(0, rows, frame_rows):
        part = payload[r * width : (r + frame_rows) * width]
        out += [b"!\xf9\x04\x04", le(delay), b"\0\0,", le(0), le(0), le(width), le(len(part) // width), b"\0\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b";"])


@dataclass
class Frame:
    samples: bytes
    width: int
    height: int
    delay_ms: int
    disposal: int
    canvas: np.ndarray  # rows, columns, RGBA
    histogram: list[int]  # 8 levels each of red, green and blue


@dataclass
class Gif:
    width: int = 0
    height: int = 0
    frames: list[Frame] = field(default_factory=list)
    error: str | None = None


def histogram(canvas: np.ndarray) -> list[int]:
    """Of the pixels that show."""
    shown = canvas[canvas[..., 3] > 0] if not canvas[..., 3].all() else canvas.reshape(-1, 4)
    return [int(v) for c in range(3) for v in np.bincount(shown[:, c] >> 5, minlength=8)]


def decode(raw: bytes | None, keep_canvas: bool = True, max_pixels: int = MAX_PIXELS) -> Gif:
    """The frames up to the first fault, and the fault. A canvas or a frame of over max_pixels is a fault: a header of a few bytes may ask for gigabytes."""
    gif = Gif()
    if raw is None:
        gif.error = "no media"
        return gif
    try:
        for f in _frames(raw, gif, max_pixels):
            if not keep_canvas:
                f.canvas = None
            gif.frames.append(f)
    except (ValueError, IndexError, MemoryError) as e:
        gif.error = str(e) or type(e).__name__
    return gif


def _frames(raw: bytes, gif: Gif, max_pixels: int) -> Iterator[Frame]:
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    u16 = lambda at: raw[at] | raw[at + 1] << 8
    gif.width, gif.height, flags, at = u16(6), u16(8), raw[10], 13
    shared = None
    if flags & 128:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    if gif.width * gif.height > max_pixels:
        raise ValueError(f"a canvas of {gif.width} x {gif.height} pixels")
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    delay = disposal = 0
    clear = None
    while True:
        kind, at = raw[at], at + 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label, at = raw[at], at + 1
            if label == 0xF9:
                packed, delay = raw[at + 1], u16(at + 2)
                disposal, clear = packed >> 2 & 7, raw[at + 4] if packed & 1 else None
            while raw[at]:
                at += raw[at] + 1
            at += 1
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        x, y, w, h, flags, at = u16(at), u16(at + 2), u16(at + 4), u16(at + 6), raw[at + 8], at + 9
        if w * h > max_pixels:
            raise ValueError(f"a frame of {w} x {h} pixels")
        palette = shared
        if flags & 128:
            n = 2 << (flags & 7)
            palette, at = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
        if palette is None:
            raise ValueError("no palette")
        first, at, parts = raw[at], at + 1, []
        if not 2 <= first <= 8:
            raise ValueError("LZW code size")
        while raw[at]:
            parts.append(raw[at + 1 : at + 1 + raw[at]])
            at += raw[at] + 1
        at += 1
        samples = lzw_decode(b"".join(parts), first, w * h)
        if len(samples) < w * h:
            raise ValueError("too few samples")
        grid = np.frombuffer(samples, np.uint8).reshape(h, w)
        if flags & 64:  # interlaced: every 8th row, then between them
            order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            straight = np.empty_like(grid)
            straight[order] = grid
            grid = straight
            samples = grid.tobytes()
        before = canvas.copy() if disposal == 3 else None
        box = canvas[y : y + h, x : x + w]
        seen = grid[: box.shape[0], : box.shape[1]]
        colours = np.full((256, 4), 255, np.uint8)
        colours[: len(palette), :3] = palette
        if clear is None:
            box[...] = colours[seen]
        else:
            show = seen != clear
            box[show] = colours[seen[show]]
        yield Frame(samples, w, h, 10 * delay, disposal, canvas.copy(), histogram(canvas))
        if disposal == 2:
            box[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear = 0, 0, None


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the width."""
    return raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)


def encode_texts(df: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Replaces the text by its bytes as a GIF, and their number without padding; keeps the other columns."""
    kept = unlike(df.columns, (text, media, n_bytes))
    names, n = [*kept, n_bytes, media], len(kept)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{n_bytes}` long, `{media}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                raw = [utf8(t) for t in b.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(map(len, raw), pa.int64()), pa.array([encode(padded(r)) for r in raw], pa.binary())], names=names)

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias(free_name("_text", kept))).mapInArrow(run, schema)


def decode_frames(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row a frame: key, frame, delay_ms, disposal, width, height, samples, histogram, error (of the image)."""
    kind = df.schema[key].dataType.simpleString()
    names = ["key", "frame", "delay_ms", "disposal", "width", "height", "samples", "histogram", "error"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                gif = decode(b.column(1)[i].as_py(), keep_canvas=False)
                rows = [(k, f.delay_ms, f.disposal, f.width, f.height, f.samples, f.histogram, gif.error) for k, f in enumerate(gif.frames)] or [(None,) * 7 + (gif.error,)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(rows))), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{media}`").alias("m")).mapInArrow(run, f"key {kind}, frame int, delay_ms int, disposal int, width int, height int, samples binary, histogram array<long>, error string")
    return rows.withColumnRenamed("key", key)


def media_digest(df: DataFrame, media: str = "media") -> DataFrame:
    """Replaces the media by what reading it back gives: payload and media sizes and digests, a feature of its frames, and the error.

    Null media give nulls and an error. Of a damaged image, payload and feature are those of the frames up to the damage.
    Columns that have the name of a result are replaced.
    """
    results = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
    kept = unlike([c for c in df.columns if c != media], results)
    names, n = [*kept, *results], len(kept)
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"])

    def digest(raw: bytes | None) -> tuple:
        gif = decode(raw, keep_canvas=False)
        if raw is None:
            return None, None, None, None, None, None, gif.error
        payload = b"".join(f.samples for f in gif.frames)
        shown = [sum(v) for v in zip(*(f.histogram for f in gif.frames), strict=True)] or [0] * 24
        feature = f"{gif.width}x{gif.height};{len(gif.frames)} frames;{sum(f.delay_ms for f in gif.frames)} ms;rgb8:{','.join(map(str, shown))}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, gif.error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                out = zip(*(digest(m.as_py()) for m in b.column(n)), strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(list(c), t) for c, t in zip(out, types, strict=True))], names=names)

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{media}`").alias(free_name("_media", kept))).mapInArrow(run, schema)
