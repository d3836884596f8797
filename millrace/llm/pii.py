"""Personal data: base patterns, and spans that a character BiLSTM-CRF adds.

The tagger (bilstm.py) is trained in numpy on labelled spans: sentences made by a seeded generator, so
labels are exact, with forms the base patterns miss (spelled-out mail addresses, IPv6, cards cut by
dots, phones without a plus) and look-alikes that are none (dates, versions, prices, hashes). Its bound
is EXAMPLES. Long texts are cut into overlapping windows at fixed places; each is decoded. A span that
touches a window's inner edge is carried over into a window of twice the size around it, until it is
seen whole, however long. An exact check by kind follows, spans that meet base ones go, and the others
of a text are reconciled by weighted interval scheduling.

Every span that can pass the check holds a match of TRIGGER: a digit, an at sign, the letters "dot", the
word "at" before a name with a dot, a double colon, or a colon between hexadecimal groups. So only
windows that meet one are decoded; as windows have fixed places, the result is that of decoding all.

At scale: one narrow pass over Arrow batches; nothing is shuffled, and the broadcast tagger has a fixed
size. Memory follows the longest text of a batch and a fixed number of windows.

Defined results: a null or empty text has no spans. Spans are code-point offsets, end exclusive, by
kind, then start. Base spans of different kinds may overlap. Repeated rows give repeated rows; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bilstm
from .common import free_name, trim

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 2500
WINDOW, OVERLAP = 160, 64
#: Windows decoded at a time.
BATCH = 256
OUT = 0  # tags: 0 outside, 1 + 2k begins kind k, 2 + 2k goes on with it

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[dD][oO][tT]|\b[aA][tT]\b\s*[\])]?\s*[A-Za-z0-9-]+\.[A-Za-z0-9-]|::|(?<=[0-9A-Fa-f]):(?=[0-9A-Fa-f]{1,4}:)")
LOCAL_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind, then start: leftmost matches that don't overlap within a kind, without those that fail their test.

    Mail addresses are found from their at signs, the first group of an ip from the start of its run of
    digits: the same matches as the plain patterns give, in linear time.
    """
    out = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        if all(map(_at_most_255, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# The labelled spans that the tagger is trained on.


def _word(r: random.Random) -> str:
    w = "".join(r.choice("aeioutnrsldhmcpbgfvéèüñ") for _ in range(r.randint(1, 9)))
    return w.capitalize() if r.random() < 0.2 else w.upper() if r.random() < 0.05 else w


def _host(r: random.Random) -> list[str]:
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) + r.choice(["", str(r.randint(1, 9))]), r.choice(["example", "mail", "site"]), r.choice(["com", "org", "net", "de"])][r.randint(0, 1) :]


def luhn_number(r: random.Random, n: int) -> str:
    body = "".join(str(r.randint(0, 9)) for _ in range(n - 1))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def make_span(r: random.Random, kind: str) -> str:
    if kind == "email":
        letters = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
        name = r.choice(["", letters() + "."]) + letters() + r.choice(["", str(r.randint(1, 99))])
        at, dot = r.choice([("@", ".")] * 2 + [(" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" AT ", " DOT ")])
        return name + at + dot.join(_host(r))
    if kind == "ip":
        if r.random() < 0.5:
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        parts = [f"{r.randrange(1 << 16):x}" for _ in range(8)]
        k = r.randint(2, 7)
        return ":".join(parts) if r.random() < 0.5 else ":".join(parts[:k]) + "::" + ":".join(parts[k + 1 :][: r.randint(0, 7 - k)])
    if kind == "card":
        d = luhn_number(r, r.choice([13, 15, 16, 16, 16, 19]))
        return r.choice(["", " ", "-", ".", ".", "/"]).join(d[i : i + 4] for i in range(0, len(d), 4))
    a, b, c = (f"{r.randint(100, 999)}", f"{r.randint(100, 999)}", f"{r.randint(0, 9999):04d}")
    forms = [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{r.randint(20, 49)} {r.randint(10, 99)} {c} {b}{a[0]}", f"1-{a}-{b}-{c}", f"+{r.randint(20, 49)} {a} {b} {c}", f"0{a} {c}{b}"]
    return r.choice(forms)


def _other(r: random.Random) -> str:
    n = lambda a, b: str(r.randint(a, b))
    forms = [
        lambda: f"{n(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}",
        lambda: f"v{n(0, 9)}.{n(0, 20)}.{n(0, 9)}", lambda: f"{n(1, 999)},{r.randint(0, 999):03d}.{r.randint(0, 99):02d}", lambda: n(0, 10**9), lambda: f"{r.getrandbits(160):040x}",
        lambda: f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", lambda: f"{n(1, 99)}%", lambda: f"#{n(1, 9999)}", lambda: f"@{_word(r).lower()}",
        lambda: f"a dot {_word(r)}", lambda: "dot dot dot", lambda: f"at {n(1, 12)} am", lambda: f"{n(1, 99)}.{n(1, 99)}.{n(1, 99)}", lambda: f"{n(1, 31)}/{n(1, 12)}/{n(1990, 2030)}",
        lambda: f"pp. {n(1, 99)}-{n(100, 999)}", lambda: f"ID {n(10**6, 10**8)}-{n(10, 99)}", lambda: "".join(r.choice("0123456789") for _ in range(r.randint(16, 40))),
    ]
    return r.choice(forms)()


def labelled(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A made-up sentence and its spans."""
    text, spans = "", []
    for _ in range(r.randint(3, 16)):
        x = r.random()
        if x < 0.16:
            kind = r.choice(KINDS)
            piece = make_span(r, kind)
            before = r.choice(["", "", "", "(", "<", ": "])
            spans.append((kind, len(text) + len(before), len(text) + len(before) + len(piece)))
            text += before + piece + r.choice(["", "", "", ",", ".", ")", ">", "!!", "###", "&&&"])
        else:
            text += (_other(r) if x < 0.36 else _word(r)) + r.choice(["", "", "", "", ",", ".", "!!", "$$$"])
        text += r.choice([" "] * 9 + ["\n"])
    return text, spans


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> list[int]:
    tags = [OUT] * n
    for kind, a, b in spans:
        k = KINDS.index(kind)
        tags[a:b] = [1 + 2 * k] + [2 + 2 * k] * (b - a - 1)
    return tags


@lru_cache(maxsize=2)
def tagger(examples: int = EXAMPLES, seed: int = 11, epochs: int = 6) -> bilstm.BiLstmCrf:
    r = random.Random(seed)
    made = [labelled(r) for _ in range(examples)]
    return bilstm.train([(bilstm.symbols(t)[:WINDOW], tags_of(len(t), s)[:WINDOW]) for t, s in made], 1 + 2 * len(KINDS), epochs=epochs, batch=50, rate=0.02, seed=seed)


# Windows, decoding, reconciling.


def windows(text: str, every: bool = False) -> list[tuple[int, int]]:
    """Overlapping windows at fixed places: those that meet a trigger, or all."""
    step = WINDOW - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    if every:
        chosen = range(n)
    else:
        chosen, at = [], 0
        for m in TRIGGER.finditer(text):
            first = max(at, (m.start() - WINDOW) // step + 1)
            at = max(at, min(n, (m.end() - 1) // step + 1))
            chosen.extend(range(first, at))
    return [(k * step, min(len(text), k * step + WINDOW)) for k in chosen]


def wider(a: int, b: int, size: int, n: int) -> tuple[int, int]:
    """The window of so many characters, at places of a size/8, that has a span about in its middle."""
    step = size // 8
    at = max(0, ((a + b - size) // 2 + step // 2) // step * step)
    return at, min(n, at + size)


def spans_of(tags: list[int], margin: np.ndarray, start: int) -> list[tuple[float, str, int, int]]:
    out, i, n = [], 0, len(tags)
    while i < n:
        if tags[i] % 2:
            k, j = tags[i] // 2, i + 1
            while j < n and tags[j] == tags[i] + 1:
                j += 1
            out.append((float(margin[i:j].mean()), KINDS[k], start + i, start + j))
            i = j
        else:
            i += 1
    return out


_AT = re.compile(r"\s*(?:[\[(]\s*at\s*[\])]|\bat\b)\s*", re.I)
_DOT = re.compile(r"\s*(?:[\[(]\s*dot\s*[\])]|\bdot\b)\s*", re.I)
_PHONE_FORM = re.compile(r"(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,4}|0[0-9]{2,4}[\x20/-][0-9]{5,8}|00[0-9]{1,3}(?:[\x20.-][0-9]{2,5}){2,4}")


def passes(kind: str, s: str) -> bool:
    """The exact check of an added span."""
    if kind == "email":
        plain = _DOT.sub(".", _AT.sub("@", s, count=1))
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", plain) is not None
    if kind == "ip":
        if s.count(":") < 2 or len(s) < 6:
            return False
        try:
            return ipaddress.ip_address(s).version == 6
        except ValueError:
            return False
    d = _digits(s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9]+(?:[./-][0-9]+){2,}", s) is not None
    return 9 <= len(d) <= 15 and _PHONE_FORM.fullmatch(s) is not None


def reconcile(found: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """Of the spans of all windows, the set without overlaps that has the largest sum of scores (ties: the earlier ends)."""
    spans = sorted(set(found), key=lambda s: (s[3], s[2], s[1], -s[0]))
    ends = [s[3] for s in spans]
    best: list[float] = [0.0]
    take: list[int] = []
    for score, _, a, _ in spans:
        before = int(np.searchsorted(ends, a, side="right"))
        gain = best[before] + max(score, 1e-6)
        take.append(before if gain > best[-1] else -1)
        best.append(max(gain, best[-1]))
    out, i = [], len(spans)
    while i:
        if take[i - 1] >= 0:
            out.append(spans[i - 1][1:])
            i = take[i - 1]
        else:
            i -= 1
    return out[::-1]


def decoded(texts: list[str], jobs: list[tuple[int, int, int]], model: bilstm.BiLstmCrf) -> Iterator[tuple[int, int, int, tuple]]:
    """Of windows (text, start, end), the window and each of its spans."""
    jobs = sorted(jobs, key=lambda j: j[2] - j[1])
    k = 0
    while k < len(jobs):
        some = jobs[k : k + max(1, BATCH * WINDOW // max(WINDOW, jobs[min(k + BATCH, len(jobs)) - 1][2] - jobs[min(k + BATCH, len(jobs)) - 1][1]))]
        k += len(some)
        width = max(b - a for _, a, b in some)
        ids = np.zeros((len(some), width), np.int64)
        for r, (i, a, b) in enumerate(some):
            ids[r, : b - a] = bilstm.symbols(texts[i][a:b])
        tags, margin = model.viterbi(ids)
        for r, (i, a, b) in enumerate(some):
            row = tags[r, : b - a]
            if row.any():
                for s in spans_of(row.tolist(), margin[r], a):
                    yield i, a, b, s


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: bilstm.BiLstmCrf, every: bool = False) -> list[list[tuple[str, int, int]]]:
    """What the tagger adds to each text's base spans. every: windows without a trigger are decoded too."""
    jobs = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(t, every)]
    carry = {(i, a, b) for i, t in enumerate(texts) for a, b in windows(t)} if every else set(jobs)  # no other can have part of a span that passes without one of them having it too
    found: dict[int, list] = {}
    size = WINDOW
    while jobs:
        carried = set()
        for i, a, b, s in decoded(texts, jobs, model):
            if (s[2] > a or a == 0) and (s[3] < b or b == len(texts[i])):
                found.setdefault(i, []).append(s)
            elif size > WINDOW or (i, a, b) in carry:
                carried.add((i, s[2], s[3]))
        size *= 2
        jobs = sorted({(i, *wider(a, b, size, len(texts[i]))) for i, a, b in carried})
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, spans in found.items():
        ok = [s for s in spans if passes(s[1], texts[i][s[2] : s[3]]) and not any(s[2] < b and a < s[3] for _, a, b in base[i])]
        out[i] = reconcile(ok)
    return out


def find_spans(texts: list[str | None], model: bilstm.BiLstmCrf) -> tuple[list, list]:
    """Base spans and all spans, by kind, then start."""
    plain = [t or "" for t in texts]
    base = [base_spans(t) if TRIGGER.search(t) else [] for t in plain]
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    added = added_spans(plain, base, model)
    return base, [sorted([*b, *a], key=order) if a else b for b, a in zip(base, added, strict=True)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span becomes its kind in brackets; of overlapping ones, the union becomes the first's."""
    out, at = [], 0
    merged: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


ROWS = 1000


def _apply(df: DataFrame, text: str, kept: list[str], columns: str, types: list, make) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(tagger())
    names = [*kept, *(c.split()[0].strip("`") for c in columns.split(", "))]
    n = len(kept)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                texts = b.column(n).to_pylist()
                rows = [make(t, x, y) for t, x, y in zip(texts, *find_spans(texts, sent.value), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)
        trim()

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias(free_name("_text", kept))).mapInArrow(run, schema)


def detect(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the numbers of base spans by kind, the digest of the base spans, all spans, and n_added."""
    count = lambda spans, k: sum(s[0] == k for s in spans)

    def make(_, base, every):
        return *(count(base, k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)

    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
    return _apply(df, text, [key], "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", types, make)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with all spans of the text replaced; null stays null."""
    others = [c for c in df.columns if c != text]
    done = _apply(df, text, others, f"`{text}` string", [pa.string()], lambda t, _, every: (None if t is None else redacted(t, every) if every else t,))
    return done.select(*(f"`{c}`" for c in df.columns))
