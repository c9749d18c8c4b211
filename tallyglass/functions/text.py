"""Text normalisers, field matchers, pattern banks and features.

Two matching rules exist and give different verdicts on short numbers; they are
kept apart as ``v2`` and ``v3``.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

NUMERIC_FIELDS = ("ssn", "phone", "credit_card")

#: Patterns of personal data in outputs, and of values in raw text. The email pattern's class keeps its bar.
PII = {
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "date_of_birth": r"\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b\d{2}[-/]\d{2}[-/]\d{4}\b",
}
RAW_VALUES = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "url": r"https?://[^\s\"'<>()\]]+",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "phone": r"(?:\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}\b",
}
#: A bank for scans: all of the first, and what only the second has.
SCANNED = PII | {k: RAW_VALUES[k] for k in ("url", "ipv4")} | {"raw_phone": RAW_VALUES["phone"]}


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """NFKC; texts of ASCII alone don't reach Python."""
    ascii_only = F.regexp_like(c, F.lit(r"^\p{ASCII}*$"))
    return F.when(ascii_only, c).otherwise(_nfkc(F.when(~ascii_only, c)))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def normalize(c: Column, rule: str = "v2") -> Column:
    """Lower case, one space between words; v2 after NFKC."""
    return squeeze(nfkc(c) if rule == "v2" else c)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def field_match(field: Column, generation: Column, value: Column, rule: str = "v2") -> Column:
    """Whether the generation holds the value. v2: numbers by digits, at least four; v3: numbers without spaces, hyphens, dots and brackets, of any length."""
    numeric = field.isin(*NUMERIC_FIELDS)
    if rule == "v2":
        want, have = digits_only(value), digits_only(generation)
        number = (F.length(want) >= 4) & F.contains(have, want)
    else:
        strip = lambda c: F.regexp_replace(c, r"(?U)[\s\-().]", "")
        want = strip(value)
        number = (want != "") & F.contains(strip(generation), want)
    text = (normalize(value, rule) != "") & F.contains(normalize(generation, rule), normalize(value, rule))
    return F.coalesce(F.when(numeric, number).otherwise(text), F.lit(False))


def found(c: Column, pattern: str) -> Column:
    """All matches; digits, blanks and word bounds as Python has them, of any script."""
    wide = "(?U)" + pattern.replace(r"[^\s", r"[^\s\x1c-\x1f").replace(r"\s]", r"\s\x1c-\x1f]").replace(r"[\s.", r"[\s\x1c-\x1f.")
    return F.regexp_extract_all(c, F.lit(wide), F.lit(0))


def pii_counts(c: Column) -> list[Column]:
    return [F.size(found(F.coalesce(c, F.lit("")), p)).cast("long").alias(k) for k, p in SCANNED.items()]


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c made once for a row: what a lambda takes from outside is otherwise made anew for each element."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def word_chunks(c: Column, size: int = 32, least: int = 9) -> Column:
    """Chunks of ``size`` words; those under ``least`` words are dropped."""

    def chunks(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")))
        parts = F.transform(starts, lambda i: F.slice(w, i * size + 1, size))
        return F.transform(F.filter(parts, lambda p: F.size(p) >= least), lambda p: F.array_join(p, " "))

    return once(F.filter(F.split(c, r"\s+"), lambda x: x != ""), chunks)


def regroup_digits(c: Column, kind: str) -> Column:
    d = digits_only(c)
    pattern, shape = {"ssn": (r"^(\d{3})(\d{2})(\d{4})$", "$1-$2-$3"), "phone": (r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3"), "credit_card": (r"^(\d{4})(\d{4})(\d{4})(\d{4})$", "$1-$2-$3-$4")}[kind]
    return F.regexp_replace(d, pattern, shape)


def prompt_features(c: Column) -> dict[str, Column]:
    """n_words, n_unique, avg_len, repetition and share of function words."""
    w = F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: x != "")
    n = F.size(w)
    common = F.array(*map(F.lit, "the a an of to and in is it that for on with as at by from this be or".split()))
    unique = F.size(F.array_distinct(w))
    per = lambda x: x.cast("double") / F.nullif(n, F.lit(0))
    length = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    return {"n_words": n.cast("long"), "n_unique": unique.cast("long"), "avg_len": F.round(per(length), 9), "repetition": F.round(1 - per(unique), 9), "function_share": F.round(per(F.size(F.filter(w, lambda x: F.array_contains(common, x)))), 9)}


@F.arrow_udf(DoubleType())
def zlib_ratio(s: pa.Array) -> pa.Array:
    """Compressed by plain size; null for null and empty texts. Bytes are read where they lie in the batch, so no text is copied."""
    return pa.array([len(zlib.compress(b)) / len(b) if b is not None and len(b) else None for b in (t.as_buffer() for t in s)], pa.float64())


def common_length(a: str | None, b: str | None) -> int:
    """Length of the longest common substring, in time that follows the sum of both lengths.

    The shorter text's suffix automaton reads the longer one, falling back to shorter suffixes where it can't go on.
    """
    if not a or not b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    size, link, edges = [0], [-1], [{}]
    end = 0
    for c in a:
        new, at = len(size), end
        size.append(size[end] + 1)
        link.append(0)
        edges.append({})
        while at >= 0 and c not in edges[at]:
            edges[at][c] = new
            at = link[at]
        if at >= 0:
            old = edges[at][c]
            if size[old] == size[at] + 1:
                link[new] = old
            else:
                split = len(size)
                size.append(size[at] + 1)
                link.append(link[old])
                edges.append(dict(edges[old]))
                while at >= 0 and edges[at].get(c) == old:
                    edges[at][c] = split
                    at = link[at]
                link[old] = link[new] = split
        end = new
    best = at = run = 0
    for c in b:
        while at and c not in edges[at]:
            at = link[at]
            run = size[at]
        if c in edges[at]:
            at, run = edges[at][c], run + 1
            best = max(best, run)
    return best


@F.pandas_udf(IntegerType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")
