"""URL filter: allow and block rules by host suffix and path prefix, else a weighted vocabulary.

The vocabulary is matched by an Aho-Corasick automaton, in one pass over each URL. A hit counts only
at word boundaries (no letter or digit on either side). One strict term rejects, and so do several
distinct soft terms whose weights add up to the limit. The whole operator is one narrow pass: no shuffle, and the automaton and the
rules, which are parameters, are all that is sent to the executors.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule, and is
judged by its text alone (null: allowed). Repeated rows give repeated rows. An empty table gives an
empty one. Extra columns are passed through; a result column that clashes with one replaces it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, unlike

# The vocabulary. A strict term rejects alone.
STRICT = ("adult", "casino", "hardcore", "porn", "spam", "viagra", "warez", "xxx")
# Soft terms, with weights.
SOFT = (
    ("ads", 2), ("bet", 2), ("bets", 2), ("cheap", 1), ("dating", 2), ("free", 1), ("jackpot", 2), ("loan", 2),
    ("loans", 2), ("pills", 2), ("poker", 2), ("rolex", 2), ("torrent", 2), ("track", 1), ("tracker", 1), ("win", 1),
)


@dataclass(frozen=True)
class UrlPolicy:
    """rules: (verdict, host + path), such as ("block", "com/en/"). soft_limit: the summed weight of at least soft_terms distinct soft terms that rejects.

    The vocabulary here is an example; read_vocabulary reads one of any size that a task's memory holds.
    """

    rules: tuple[tuple[str, str], ...] = ()
    strict: tuple[str, ...] = STRICT
    soft: tuple[tuple[str, int], ...] = SOFT
    soft_limit: int = 3
    soft_terms: int = 2


def read_vocabulary(spark: SparkSession, path: str, rules: tuple[tuple[str, str], ...] = (), most: int = 1_000_000, **limits: int) -> UrlPolicy:
    """A policy from a text file with a line a term: the term, a tab, and its weight or the word strict. More than most lines are an error, as every task holds them all."""
    lines = [r[0] for r in spark.read.text(path).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"a vocabulary of over {most} terms")
    terms = [line.rpartition("\t")[::2] for line in lines if line.strip()]
    return UrlPolicy(rules, tuple(sorted(t for t, w in terms if w == "strict")), tuple(sorted((t, int(w)) for t, w in terms if w != "strict")), **limits)


@lru_cache(maxsize=8)
def _automaton(policy: UrlPolicy):
    import ahocorasick

    auto = ahocorasick.Automaton()
    terms = {t: (w, False) for t, w in policy.soft} | {t: (0, True) for t in policy.strict}
    for term, (weight, strict) in terms.items():
        auto.add_word(term.lower(), (term.lower(), weight, strict))
    if terms:
        auto.make_automaton()
    rules: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in policy.rules:
        host, slash, path = rule.partition("/")
        rules.setdefault(host, []).append((slash + path, rule, verdict))
    return (auto if terms else None), rules


def _lower_ascii(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s) if not s.isascii() else s.lower()


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return _lower_ascii(host), tail[:stop]


def judge(url: str | None, policy: UrlPolicy) -> tuple[str, str, str | None, str, int, int]:
    """host, path, rule, verdict, distinct strict terms, weight of distinct soft terms."""
    auto, rules = _automaton(policy)
    host, path = split_url(url)
    best: tuple[int, int, str, str] | None = None
    labels = host.split(".") if host else []
    for i in range(len(labels)):
        suffix = ".".join(labels[i:])
        for prefix, rule, verdict in rules.get(suffix, ()):
            if path.startswith(prefix) and (best is None or (len(rule), len(suffix)) > best[:2]):
                best = (len(rule), len(suffix), rule, verdict)
    strict, soft = set(), {}
    if url and auto is not None:
        low = _lower_ascii(url)
        for end, (term, weight, is_strict) in auto.iter(low):
            start = end - len(term) + 1
            if (start and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
                continue
            if is_strict:
                strict.add(term)
            else:
                soft[term] = weight
    total = sum(soft.values())
    verdict = best[3] if best else "block" if strict or (total >= policy.soft_limit and len(soft) >= policy.soft_terms) else "allow"
    return host, path, best[2] if best else None, verdict, len(strict), total


def filter_urls(df: DataFrame, policy: UrlPolicy, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict, n_strict, soft_weight."""
    names = ("host", "path", "rule", "verdict", "n_strict", "soft_weight")
    kept = unlike(df.columns, names)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "host string, path string, rule string, verdict string, n_strict int, soft_weight int"])
    types = [pa.string()] * 4 + [pa.int32()] * 2
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(zip(*(judge(u, policy) for u in b.column(b.num_columns - 1).to_pylist()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(list(v), t) for v, t in zip(out, types, strict=True))], names=[*kept, *names])

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{url}`").alias(free_name("_url", kept))).mapInArrow(run, schema)
