"""Text columns: cleaning, ordered unique lists, phrase tests, contact extraction, similarity keys.

Native expressions throughout, but for Unicode compatibility folding and hashing that Spark lacks; those
are Arrow UDFs and named so.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

# Patterns of contact details.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(\+?\d[\d\s().-]{7,}\d)"
URL = r"(?i)https?://[^\s<>\x22]+"


def collapse(c: Column) -> Column:
    """White space runs as one space, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


@F.pandas_udf(ArrayType(StringType()))
def valid_patterns(patterns: pd.Series) -> pd.Series:
    """The patterns that are regular expressions both here and in Spark; null is none (Arrow UDF: a bad one would end the job).

    What only one side knows (possessive groups, named groups, classes of Java's own) is passed by as well."""

    def good(p: str | None) -> bool:
        if not p or re.search(r"\(\?P|\\[pPQEhHvVRXG]|[*+?}]\+|\[[^\]]*(\[|&&)", p):
            return False
        try:
            re.compile(p)
        except (re.error, OverflowError):
            return False
        return not re.search(r"(^|[^\\])(\\\\)*\{(?!\d+(,\d*)?\})", p)  # a brace that Java reads as a count

    return patterns.map(lambda many: [p for p in ([] if many is None else many) if good(p)])


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    """NFKC and collapsed white space (Arrow UDF: Spark has no normal forms)."""
    return s.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()) if t else "")


@F.pandas_udf(StringType())
def ascii_slug(s: pd.Series) -> pd.Series:
    """Lower-case ASCII words joined by dashes, at most 80 characters, ``unknown`` if none (Arrow UDF)."""

    def slug(t: str | None) -> str:
        plain = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")[:80].strip("-") or "unknown"

    return s.map(slug)


@F.pandas_udf(StringType())
def program_key(domain: pd.Series, funder: pd.Series, name: pd.Series) -> pd.Series:
    """Deterministic record id: domain and name slugs and a short digest of the three parts (Arrow UDF)."""

    def slug(t: str | None, most: int) -> str:
        plain = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")[:most].strip("-") or "unknown"

    def key(d, f, n):
        digest = hashlib.blake2b(f"{d or ''}|{f or ''}|{n or ''}".encode(), digest_size=4).hexdigest()
        return f"funding_{slug(d, 30)}_{slug(n, 40)}_{digest}"

    return pd.Series([key(*x) for x in zip(domain, funder, name, strict=True)])


def plain_slug(c: Column) -> Column:
    """Slug without folding or cap; null if nothing is left (the SQL side's form)."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "(^-+)|(-+$)", "")
    return F.nullif(out, F.lit(""))


def has_text(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) > 0


def unique_by(items: Column, key) -> Column:
    """Array without later items of an equal key; items of empty key go. First spelling stays."""
    pairs = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x, i: F.struct(key(x).alias("k"), x.alias("v"), i.alias("i")))
    keys = F.transform(pairs, lambda p: p["k"])
    kept = F.filter(pairs, lambda p: (F.length(p["k"]) > 0) & (F.array_position(keys, p["k"]) == p["i"] + 1))
    return F.transform(kept, lambda p: p["v"])


def unique_text(items: Column) -> Column:
    """Case-insensitive ordered unique of cleaned strings."""
    cleaned = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: collapse(x))
    return unique_by(cleaned, lambda x: F.lower(x))


def words_only(c: Column) -> Column:
    """Lower-case letters and digits of ASCII, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def unique_words(items: Column) -> Column:
    """Ordered unique by ``words_only``."""
    return unique_by(items, words_only)


def any_contains(haystack: Column, needles: Column) -> Column:
    """Whether any text of one array contains, in normal form, any of the other: no word borders."""
    return F.exists(haystack, lambda h: F.exists(needles, lambda n: (F.length(words_only(n)) > 0) & words_only(h).contains(words_only(n))))


def emails(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), 0)
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def phones(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PHONE), 1), lambda x: collapse(x))
    return F.array_distinct(F.filter(found, lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= 9))


def urls(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL), 0)
    return unique_text(F.transform(found, lambda x: F.regexp_replace(x, r"[).,;\]]+$", "")))


def sentences(c: Column) -> Column:
    """Pieces after a full stop, question or exclamation mark and space, or at newlines; blanks go."""
    pieces = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(pieces, lambda x: collapse(x)), lambda x: F.length(x) > 0)


def _quoted(phrase: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", phrase)


def has_phrase(c: Column, phrase: str) -> Column:
    """Whole-phrase test: no ASCII letter or digit may adjoin it."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike(f"(?<![0-9a-z]){_quoted(phrase.lower())}(?![0-9a-z])")


def phrase_hits(c: Column, phrases: Sequence[str]) -> Column:
    """The phrases found, in the given order."""
    return F.array_compact(F.array(*[F.when(has_phrase(c, p), F.lit(p)) for p in phrases]))


def categories(c: Column, taxonomy: dict[str, Sequence[str]]) -> Column:
    """Names of the categories of which a phrase is found, in order."""
    tests = []
    for name, phrases in taxonomy.items():
        either = "|".join(_quoted(p.lower()) for p in phrases)
        hit = F.lower(F.coalesce(c, F.lit(""))).rlike(f"(?<![0-9a-z])({either})(?![0-9a-z])")
        tests.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*tests))


def category_evidence(c: Column, taxonomy: dict[str, Sequence[str]]) -> Column:
    """Map of each category found to the phrases that were."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), phrase_hits(c, p).alias("value")) for n, p in taxonomy.items()])
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


# Fixed value: a leading number or roman numeral and its mark, or the space behind it.
NUMBERING = r"(?i)^\s*(?:\d+|[ivxlcdm]+)(?:\s*[.)-]\s*|\s+)"


def strip_numbering(c: Column) -> Column:
    """Without a leading number and its mark."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), NUMBERING, "")


def programme_key(c: Column, funder: Column) -> Column:
    """Name without punctuation, filler words and the funder's words: a key for equal programmes."""
    drop = F.concat(F.split(words_only(funder), " "), F.array(*[F.lit(x) for x in ("programme", "program", "funding", "fund")]))
    kept = F.filter(F.split(words_only(c), " "), lambda w: ~F.array_contains(drop, w) & (F.length(w) > 0))
    return F.array_join(kept, " ")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    row = (1 << len(a)) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & ((1 << len(a)) - 1)).bit_count()


def sorted_ratio(a: str | None, b: str | None) -> float:
    """Similarity 0 to 100 of two texts with their words sorted: twice the common subsequence over both lengths."""
    x, y = " ".join(sorted((a or "").split())), " ".join(sorted((b or "").split()))
    return 100.0 if not x and not y else 200.0 * _lcs(x, y) / (len(x) + len(y))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``sorted_ratio`` of two columns (Arrow UDF: Spark's edit distance counts substitutions as one)."""
    return pd.Series([sorted_ratio(x, y) for x, y in zip(a, b, strict=True)])
