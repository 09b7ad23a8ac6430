"""Classes of texts and pages by terms: funding type, scope, page type, deadline and status wording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms of each family of funding, in order of precedence.
FUNDING_TERMS = {
    "Grant": ("grant", "grant funding", "matching grant", "micro-grant", "non-repayable"),
    "Loan": ("loan", "term loan", "working capital loan", "bridging loan", "asset finance", "credit facility"),
    "Equity": ("equity", "equity finance", "equity investment", "minority stake", "venture capital"),
    "Guarantee": ("guarantee", "credit guarantee", "partial guarantee", "risk-sharing"),
}
HYBRID_TERMS = ("hybrid", "blended finance", "mezzanine", "convertible", "quasi-equity", "quasi equity")
SCOPES = (("National", ("national", "nationwide", "country-wide")), ("Province", ("province", "provincial")), ("Municipality", ("municipality", "municipal")), ("Local", ("local", "township")))
PAGE_TYPES = {
    "funding_program": "funding_programme", "funding_programme": "funding_programme", "programme": "funding_programme", "program": "funding_programme",
    "detail": "funding_programme", "product_page": "funding_programme", "listing": "funding_listing", "programme_listing": "funding_listing",
    "program_listing": "funding_listing", "funding_listing": "funding_listing", "mixed": "funding_listing", "support": "support_programme",
    "support_program": "support_programme", "support_programme": "support_programme", "technology_station": "technology_station",
    "open_call": "open_call", "call": "open_call", "call_for_applications": "open_call", "tender": "tender_procurement",
    "procurement": "tender_procurement", "tender_procurement": "tender_procurement", "news": "news_article", "article": "news_article",
    "news_article": "news_article", "generic": "generic_content", "generic_content": "generic_content", "unknown": "generic_content",
}


def _holds(c: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def _count(c: Column, terms: Sequence[str]) -> Column:
    return sum((c.contains(t).cast("int") for t in terms), F.lit(0))


def funding_type(c: Column) -> Column:
    """Struct of type and confidence. Terms are substrings; two families, or a hybrid marker, are a hybrid."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[•+/&\s]+", " ")
    hits = {k: _holds(low, v) for k, v in FUNDING_TERMS.items()}
    marked, debt = _holds(low, HYBRID_TERMS), low.contains("debt")
    families = hits["Grant"].cast("int") + (hits["Loan"] | debt).cast("int") + hits["Equity"].cast("int") + hits["Guarantee"].cast("int") + (debt | marked).cast("int")
    any_hit = hits["Grant"] | hits["Loan"] | hits["Equity"] | hits["Guarantee"] | marked | debt
    kind = F.when(~any_hit, "Unknown").when(marked | (families > 1), "Hybrid")
    sure = F.when(~any_hit, 0.0).when(marked, 0.93).when(families > 1, 0.82)
    for name, terms in FUNDING_TERMS.items():
        kind = kind.when(hits[name], name)
        sure = sure.when(hits[name], F.when(_count(low, terms) >= 2, 0.88).otherwise(0.72))
    return F.struct(kind.otherwise("Unknown").alias("type"), sure.otherwise(0.0).alias("confidence"))


def scope(c: Column) -> Column:
    """National before province before municipality before local, else unknown."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(F.lit(False), "")
    for name, words in SCOPES:
        out = out.when(_holds(low, words), name)
    return out.otherwise("Unknown")


def page_type(c: Column) -> Column:
    """Known names of page types in one spelling; anything else is generic content."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[-/ ]", "_")
    table = F.create_map(*[F.lit(x) for kv in PAGE_TYPES.items() for x in kv])
    return F.coalesce(table[key], F.lit("generic_content"))


def page_structure(c: Column, records: Column, blocks: Column, internal: Column, details: Column, applications: Column, documents: Column,
                   terms: dict[str, Sequence[str]], detail: Column) -> Column:
    """Page type by ordered rules over text terms (keys procurement, station, support, news, fundable), whether the text goes
    into ``detail``, and counts."""
    low = F.lower(F.coalesce(c, F.lit("")))
    has = {k: _holds(low, v) for k, v in terms.items()} | {"detail": detail}
    call = low.contains("open call") | low.contains("call for applications")
    many = (records > 1) | (blocks > 1) | (details > 2) | ((internal > 8) & (records <= 1))
    return (
        F.when(has["procurement"], "tender_procurement")
        .when(has["station"] & ~has["fundable"], "technology_station")
        .when(has["support"] & ~has["fundable"], "support_programme")
        .when(has["news"] & ~has["detail"] & ~has["fundable"], "news_article")
        .when(call, "open_call")
        .when(many, "funding_listing")
        .when(has["fundable"] | (applications > 0) | (documents > 0) | has["detail"], "funding_programme")
        .otherwise("generic_content")
    )


def month_range(c: Column) -> Column:
    """Struct of least and most months in wording such as ``12 to 36 months`` or ``up to 5 years``."""
    low = F.lower(F.coalesce(c, F.lit("")))
    pair, one = r"(\d+)\s*(?:to|-|–)\s*(\d+)\s*(month|year)", r"(\d+)\s*(month|year)"
    times = lambda unit: F.when(unit == "year", 12).otherwise(1)
    number = lambda p, i: F.nullif(F.regexp_extract(low, p, i), F.lit("")).cast("int")
    has_pair = low.rlike(pair)
    high = F.when(has_pair, number(pair, 2) * times(F.regexp_extract(low, pair, 3))).otherwise(number(one, 1) * times(F.regexp_extract(low, one, 2)))
    least = F.when(has_pair, number(pair, 1) * times(F.regexp_extract(low, pair, 3))).when(~low.contains("up to"), high)
    return F.struct(least.alias("low"), high.alias("high"))


def day_range(c: Column, words: Sequence[str]) -> Column:
    """Struct of least and most days, and of the sentence, of the first sentence with one of the words that tells days or weeks:
    two numbers joined by to or a dash, or one behind within. Null without one."""
    from .text import sentences

    pair, one = r"(\d+) *(?:to|-|–) *(\d+) *(day|week)", r"within +(\d+) *(day|week)"
    number = lambda s, p, i: F.nullif(F.regexp_extract(F.lower(s), p, i), F.lit("")).cast("int")
    days = lambda s, p, i: F.when(F.regexp_extract(F.lower(s), p, i) == "week", 7).otherwise(1)

    def read(s):
        both = F.lower(s).rlike(pair)
        low = F.when(both, number(s, pair, 1) * days(s, pair, 3)).otherwise(number(s, one, 1) * days(s, one, 2))
        high = F.when(both, number(s, pair, 2) * days(s, pair, 3)).otherwise(number(s, one, 1) * days(s, one, 2))
        return F.struct(low.alias("low"), high.alias("high"), s.alias("said"))

    about = F.filter(sentences(c), lambda s: _holds(F.lower(s), words))
    return F.try_element_at(F.filter(F.transform(about, read), lambda r: r["high"].isNotNull()), F.lit(1))


# Words of repayment structures with their names, in order, and names by frequency where no words tell one.
STRUCTURES = (
    (("interest-only", "interest only", "principal repayment", "capital repayment"), "interest-only period then principal repayment"),
    (("bullet repayment", "bullet payment", "balloon payment", "lump sum repayment", "single repayment", "once-off"), "bullet repayment"),
    (("repayment linked to cash flow", "linked to cash flow", "cash flow linked", "cash flow"), "repayment linked to cash flow"),
    (("monthly repayment", "monthly repayments", "monthly instalment", "monthly installments"), "monthly instalments"),
    (("quarterly repayment", "quarterly repayments", "quarterly instalment", "quarterly installments"), "quarterly repayments"),
    (("annual repayment", "annually", "annual instalment", "annual installments", "yearly", "per annum"), "annual repayments"),
    (("weekly repayment", "weekly repayments", "weekly instalment", "weekly installments"), "weekly repayments"),
    (("moratorium", "grace period", "repayment holiday", "deferred payment"), "moratorium applies"),
)
BY_FREQUENCY = {"Once-off": "bullet repayment", "Flexible": "flexible repayment schedule", "Monthly": "monthly instalments", "Quarterly": "quarterly repayments", "Annually": "annual repayments"}


def repayment_structure(c: Column, frequency: Column) -> Column:
    """Name of a repayment's structure: by the first words found, else by its frequency; null where neither tells one."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.when(F.lit(False), "")
    for words, name in STRUCTURES:
        out = out.when(_holds(low, words), name)
    for kind, name in BY_FREQUENCY.items():
        out = out.when(frequency == kind, name)
    return out
