"""Tokens and text fields as columns.

Latin tokens are cut JVM-side. Only rows with Han or Kana go through a pandas function, and only if a
segmenter is given; without one, a Han run is one token, and Kana text is cut into runs of its scripts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes. A token is a run of ASCII letters and digits, with inner . _ + -
LATIN = r"[0-9a-z]+(?:[._+-][0-9a-z]+)*"
HAN = "㐀-䶿一-鿿"
KANA = "぀-ヿ"
CHUNK = f"{LATIN}|[{HAN}]+"
_SPACE = r"^\s+|\s+$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row: as a lambda's variable, not as an expression in each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, _SPACE, "")


def tokens(text: Column, segment_han: Callable[[str], Sequence[str]] | None = None, segment_kana: Callable[[str], Sequence[str]] | None = None) -> Column:
    """The tokens of a text, lower-cased; null and blank have none.

    With Kana in the text, segment_kana gives the surfaces: those with Han or Kana stay whole, others
    give their Latin tokens, and then each run of two or more Han characters is added again. Else each
    Latin token is a token, and each Han run is cut by segment_han; all other characters are dropped.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_extract_all(low, F.lit(CHUNK), F.lit(0))
    kana = _kana_default(low) if segment_kana is None else _with(segment_kana, _kana_tokens)(low)
    han = plain if segment_han is None else F.when(low.rlike(f"[{HAN}]"), _with(segment_han, _han_tokens)(low)).otherwise(plain)
    return F.when(low.rlike(f"[{KANA}]"), kana).otherwise(han)


def _kana_default(low: Column) -> Column:
    surfaces = F.regexp_extract_all(low, F.lit(f"{LATIN}|[{HAN}{KANA}]+"), F.lit(0))
    again = F.filter(F.regexp_extract_all(low, F.lit(f"[{HAN}]+"), F.lit(0)), lambda s: F.char_length(s) > 1)
    return F.concat(surfaces, again)


def _han_tokens(text: str, segment) -> list[str]:
    out: list[str] = []
    for chunk in re.findall(CHUNK, text):
        if re.match(f"[{HAN}]", chunk):
            out += [s for s in (p.strip() for p in segment(chunk)) if s] or [chunk]
        else:
            out.append(chunk)
    return out


def _kana_tokens(text: str, segment) -> list[str]:
    out: list[str] = []
    for surface in (s.strip().lower() for s in segment(text)):
        out += [surface] if re.search(f"[{HAN}{KANA}]", surface) else re.findall(LATIN, surface)
    return out + [c for c in re.findall(f"[{HAN}]+", text) if len(c) > 1]


def _with(segment, cut):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t, segment))

    return run


def join_tokens(text: Column, **segmenters) -> Column:
    return F.array_join(tokens(text, **segmenters), " ")


def combine_text(title: Column, description: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit("")))


def tags_text(tags: Column) -> Column:
    """Names joined by a space; null items and null or empty names are skipped."""
    names = F.filter(F.transform(tags, lambda x: x["name"]), lambda n: n.isNotNull() & (n != ""))
    return F.coalesce(F.array_join(names, " "), F.lit(""))


def tags_text_sql(tags: Column) -> Column:
    """As above, but null names count as empty strings, so spaces double."""
    return F.coalesce(F.array_join(F.transform(tags, lambda x: F.coalesce(x["name"], F.lit(""))), " "), F.lit(""))


def haystack(fields: Sequence[Column], separator: str = "\n", lower: bool = True) -> Column:
    joined = F.concat_ws(separator, *(F.coalesce(f, F.lit("")) for f in fields))
    return F.lower(joined) if lower else joined


def preview(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def normalize_query(text: str) -> tuple[str, list[str]]:
    """The phrase, lower-cased with single spaces, and its terms; an empty one is an error."""
    phrase = re.sub(r"\s+", " ", text.strip().lower())
    if not phrase:
        raise ValueError("the query is empty")
    return phrase, phrase.split(" ")


def python_tokens(text: str) -> list[str]:
    """tokens() for a query's text, on the driver."""
    low = text.strip().lower()
    if re.search(f"[{KANA}]", low):
        return re.findall(f"{LATIN}|[{HAN}{KANA}]+", low) + [c for c in re.findall(f"[{HAN}]+", low) if len(c) > 1]
    return re.findall(CHUNK, low)


def query_terms(args: Sequence[str], tokenize: bool = False) -> list[str]:
    """Distinct terms in order. Without tokenize, a phrase stays one entry; blanks are dropped; none left is an error."""
    if tokenize:
        terms = [t for a in args for t in python_tokens(a)]
    else:
        terms = [re.sub(r"\s+", " ", a.strip().lower()) for a in args if a and a.strip()]
    terms = list(dict.fromkeys(terms))
    if not terms:
        raise ValueError("no query terms")
    return terms


def matches(text: Column, phrase: str, terms: Sequence[str], mode: str = "phrase", like: bool = False) -> Column:
    """phrase, all or any. like: % and _ in the query are wildcards; else literal substrings. An empty text matches nothing."""
    if mode not in ("phrase", "all", "any"):
        raise ValueError(f"unknown mode {mode}")
    if not phrase:
        raise ValueError("the query is empty")

    def one(t: str) -> Column:
        return text.like("%" + t.replace("\\", "\\\\") + "%") if like else F.contains(text, F.lit(t))

    parts = [phrase] if mode == "phrase" else list(terms)
    out = one(parts[0])
    for t in parts[1:]:
        out = out & one(t) if mode == "all" else out | one(t)
    return (text != "") & out
