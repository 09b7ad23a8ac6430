"""URL columns: hosts, canonical forms, relevance scores."""

from __future__ import annotations

from collections.abc import Sequence
from posixpath import normpath
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query keys of trackers, endings of documents, words that say nothing about a programme.
TRACKING = ("utm_", "fbclid", "gclid", "mc_", "mkt_")
DOCUMENT_ENDINGS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tif", ".tiff")
CONTEXT_STOPWORDS = (
    "application", "brochure", "checklist", "document", "documents", "download", "form", "forms", "fund", "funding", "grant", "guide",
    "guideline", "guidelines", "investment", "loan", "media", "offer", "program", "programme", "project", "services", "support",
)
CONTEXT_LEAST = 8


def host(c: Column) -> Column:
    """Lower-case host with port; a url without scheme is read as if it had one."""
    url = F.coalesce(c, F.lit(""))
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def domain(c: Column) -> Column:
    """Host without a leading ``www.``"""
    return F.regexp_replace(host(c), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """Hosts are equal, or equal but for ``www.`` on one side."""
    x, y = host(a), host(b)
    return (x != "") & (y != "") & ((x == y) | (domain(a) == domain(b)))


def path(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical(c: Column) -> Column:
    """Canonical form of absolute urls without dot segments, natively.

    Lower-case scheme and host, no default port, fragment, trailing slash or tracking keys; query pairs
    sorted, blank values dropped. Relative urls and encoded queries need ``canonical_any``.
    """
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    scheme = F.lower(F.regexp_extract(c, whole, 1))
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise("^$")
    where = F.regexp_replace(F.lower(F.regexp_extract(c, whole, 2)), port, F.lit(""))
    way = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, whole, 3), "/+", "/"), "/$", "")
    pairs = F.filter(
        F.split(F.regexp_extract(c, whole, 4), "&"),
        lambda p: p.rlike("^[^=]+=.+") & ~F.lower(p).rlike("^(" + "|".join(TRACKING) + ")"),
    )
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(scheme, F.lit("://"), where, F.when(way == "", "/").otherwise(way), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def canonical_text(url: str, base: str | None = None) -> str:
    """Canonical form of any url, relative ones against ``base``."""
    parts = urlsplit(urljoin(base, url) if base else url)
    scheme, where = (parts.scheme or "https").lower(), parts.netloc.lower()
    for ending, kind in ((":80", "http"), (":443", "https")):
        if scheme == kind:
            where = where.removesuffix(ending)
    way = normpath(parts.path or "/")
    way = "/" + way.lstrip("/") if way != "." else "/"
    pairs = sorted((k, v) for k, v in parse_qsl(parts.query) if not k.lower().startswith(TRACKING))
    return f"{scheme}://{where}{way}" + (f"?{urlencode(pairs)}" if pairs else "")


@F.pandas_udf(StringType())
def canonical_any(url: pd.Series, base: pd.Series) -> pd.Series:
    """``canonical_text`` as an Arrow UDF: joining and form decoding have no Spark expression."""

    def one(u, b):
        try:
            return canonical_text(u, b) if u is not None else None
        except ValueError:
            return None

    return pd.Series([one(u, b) for u, b in zip(url, base, strict=True)])


def is_document(c: Column) -> Column:
    """The whole url ends as a document does; a query hides it."""
    endings = "|".join(e.replace(".", r"\.") for e in DOCUMENT_ENDINGS)
    return F.lower(F.coalesce(c, F.lit(""))).rlike(f"({endings})$")


def irrelevant(c: Column, patterns: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for p in patterns:
        out = out | low.contains(p.lower())
    return out


def relevance(url: Column, anchor: Column, keywords: Sequence[str], patterns: Sequence[str]) -> Column:
    """-100 for irrelevant urls, else 5 a keyword and 2 for a document."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(anchor, F.lit(""))))
    score = F.when(is_document(url), 2).otherwise(0)
    for k in keywords:
        score = score + F.when(hay.contains(k.lower()), 5).otherwise(0)
    return F.when(irrelevant(url, patterns), -100).otherwise(score)


def tokens(c: Column) -> Column:
    """Distinct words of three letters and more that say something."""
    stop = F.array(*[F.lit(x) for x in CONTEXT_STOPWORDS])
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), stop)


def document_relevance(url: Column, context: Column, anchor: Column) -> Column:
    """4 for a document, 4 a word that url or anchor share with the context, 2 for a telling anchor."""
    low = F.lower(F.coalesce(url, F.lit("")))
    inside = tokens(F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*", ""))
    shared = F.array_intersect(tokens(context), F.array_union(inside, tokens(anchor)))
    cue = F.lower(F.coalesce(anchor, F.lit(""))).rlike("brochure|checklist|guidelines|application form|download")
    score = F.when(is_document(low), 4).otherwise(0) + F.size(shared) * 4 + F.when(cue, 2).otherwise(0)
    return F.when(low == "", 0).otherwise(score)


def document_fits(url: Column, context: Column, anchor: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) == "", is_document(url)).otherwise(document_relevance(url, context, anchor) >= CONTEXT_LEAST)


def source_rank(url: Column, official: Column) -> Column:
    """1 the official host, 2 government, 3 a document, 4 the rest."""
    return F.when(same_site(url, official), 1).when(host(url).rlike(r"\.gov(\.|$)"), 2).when(is_document(url), 3).otherwise(4)
