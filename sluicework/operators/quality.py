"""Quality of programme records: the ingest score with reasons and blockers, routes, and the catalogue score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, mean_of
from ..functions.text import has_text

# What marks articles and publications, and page types that are no programmes.
ARTICLE_PATHS = (
    "press-release", "news", "media", "image", "screenshot", "publication", "article", "blog", "case-study", "case-studies",
    "success-story", "success-stories",
)
ARTICLE_NOTES = (
    "article/publication page", "article or publication page", "press release", "media release", "news article", "publication",
    "success story", "case study",
)
NOT_PROGRAMMES = ("tender_procurement", "news_article", "technology_station", "support_programme", "generic_content")
ACCEPT, REVIEW = 35, 20


def _any_of(c: Column, terms: tuple[str, ...]) -> Column:
    return c.rlike("(?i)" + "|".join(t.replace("/", "[/]") for t in terms))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns in a projection of their own, behind a one-row generator.

    Later filters and sorts then refer to the values: the optimiser cannot copy these large expressions into
    every condition above them, which would multiply planning time and work. The generator itself only passes values on, as
    what stands within one is interpreted for each row, shared parts again at every place. The test with a lambda keeps the
    projection out of the stage's one generated method, which past 8,000 bytes the JVM never compiles; alone it is split.
    """
    made = {f"_made_{n}": c for n, c in columns.items()}
    apart = F.exists(F.array(F.col(f"`{df.columns[0]}`").isNull()), lambda x: x)
    inner = df.select("*", *[c.alias(n) for n, c in made.items()], apart.alias("_apart"))
    passed = F.struct(*[F.col(m).alias(n) for m, n in zip(made, columns, strict=True)], F.col("_apart").alias("_apart_"))
    return inner.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(passed))).drop("_apart_")


def compact(items: list[Column]) -> Column:
    """Array of the different texts that are not null, in order, without a lambda (which would be interpreted)."""
    return F.array_except(F.array(*items), F.array(F.lit(None).cast("string")))


def is_article(url: Column, title: Column, notes: Column) -> Column:
    """The page reads like an article: by a term in its path or title, or a telling note. Case is left to the patterns, as lower
    case of each text costs more than the search in it."""
    some = lambda c: F.coalesce(c, F.lit(""))
    way = F.regexp_extract(some(url), r"(?i)^[a-z\x{212A}]+://[^/?#]*([^?#]*)", 1)
    all_text = F.concat_ws(" ", some(url), some(title), F.array_join(notes, " "))
    return _any_of(all_text, ARTICLE_NOTES) | _any_of(way, ARTICLE_PATHS) | _any_of(some(title), ARTICLE_PATHS)


def _filled(c: str) -> Column:
    return F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0


def score(df: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``overall_confidence``, ``quality``, ``reasons`` and ``blockers``.

    Each rule is (condition, points, reason, blocker); all are summed in one projection.
    """
    conf = F.col("overall_confidence")
    name, funder = has_text(F.col("program_name")), has_text(F.col("funder_name"))
    typed, channel = F.col("funding_type") != "Unknown", F.col("application_channel") != "Unknown"
    amount = F.col("ticket_min").isNotNull() | F.col("ticket_max").isNotNull()
    contact = has_text(F.col("application_url")) | has_text(F.col("contact_email"))
    geo = _filled("provinces") | _filled("municipalities") | (F.col("geography_scope") != "Unknown")
    open_now = F.col("deadline_type").isin("Open", "Rolling")
    fixed = ~open_now & F.col("deadline_date").isNotNull()
    past = fixed & (F.col("deadline_date") < as_of)
    ended = F.array_join("notes", " ").rlike("(?i)archived|closed")
    article = is_article(F.col("source_url"), F.col("source_title"), F.col("notes"))
    # two of the eight signals are booleans and count whatever they say, so only six can be missing
    signals = [name, funder, channel | contact, _filled("raw_eligibility"), _filled("industries"), _filled("funds_used")]
    few = sum((s.cast("int") for s in signals), F.lit(0)) == 0
    rules = [
        (article, -10, None, "Article or publication page"),
        (F.col("page_type").isin(*NOT_PROGRAMMES), -25, None, "Non-programme page type"),
        (name, 18, "Has programme name", None),
        (~name, 0, None, "Missing programme name"),
        (funder, 14, "Has funder name", None),
        (~funder, 0, None, "Missing funder name"),
        (typed, 10, "Known funding type", None),
        (~typed, 0, None, "Unknown funding type"),
        (amount, 10, "Funding amount captured", None),
        (channel, 10, "Application route available", None),
        (~channel & contact, 8, "Contact route available", None),
        (~channel & ~contact, -4, None, None),
        (_filled("raw_eligibility"), 10, "Eligibility details captured", None),
        (_filled("industries") | _filled("funds_used"), 8, "Use of funds or industry captured", None),
        (_filled("ownership_targets"), 5, "Ownership target captured", None),
        (geo, 4, "Geography captured", None),
        (_filled("related_documents"), 3, "Supporting documents linked", None),
        (open_now, 8, "Open or rolling deadline", None),
        (past, -18, None, "Expired fixed deadline"),
        (fixed & ~past, 5, "Future deadline available", None),
        (ended, -20, None, "Archived or closed programme"),
        (conf < 0.25, -10, None, "Very low extraction confidence"),
        (conf >= 0.6, 4, "High extraction confidence", None),
        (few, -10, None, None),
        (F.col("has_conflicts"), -12, None, "Conflicting field values"),
    ]
    reviews = F.size("review_reasons")
    total = sum((F.when(c, p).otherwise(0) for c, p, _, _ in rules if p), F.lit(0)) - F.least(F.lit(10), reviews * 2)
    said = [F.when(c, F.lit(r)) for c, _, r, _ in rules if r] + [F.when(reviews > 0, F.lit("Review reasons recorded"))]
    against = [F.when(c, F.lit(b)) for c, _, _, b in rules if b]
    return computed(
        computed(df, overall_confidence=mean_of(F.col("confidence"))),
        quality=clamp(total, 0, 100).cast("int"),
        reasons=compact(said),
        blockers=compact(against),
    )


def route(df: DataFrame, accept: int = ACCEPT, review: int = REVIEW) -> DataFrame:
    """Adds ``route``: accept, review or reject; acceptance is tested first."""
    named = ~F.arrays_overlap("blockers", F.array(F.lit("Missing programme name"), F.lit("Missing funder name")))
    article = F.array_contains("blockers", "Article or publication page")
    held = (F.col("quality") >= review) & (article | (F.col("quality") < accept))
    return df.withColumn("route", F.when((F.col("quality") >= accept) & named, "accept").when(held, "review").otherwise("reject"))


# Reasons and blockers of the catalogue score, in order.
VIEW_REASONS = (
    "Has programme name", "Has funder name", "Known funding type", "Funding range available", "Industry information captured",
    "Use of funds captured", "Ownership targets captured", "Eligibility details captured", "Application route available",
    "Contact or apply link available", "Open or active deadline", "Geography captured", "Supporting documents linked",
)
VIEW_BLOCKERS = (
    "Missing programme name", "Missing funder name", "Unknown funding type", "Missing application route", "Missing application contact",
    "Expired deadline", "Mostly incomplete record",
)


def flags(conditions: list[Column]) -> Column:
    """Conditions as bits of one integer, the first lowest."""
    return sum((F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def labels(bits: Column, names: tuple[str, ...]) -> Column:
    """The names whose bits are set, in order."""
    return compact([F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)])


def catalogue_score(df: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``view_quality`` (0 to 100), the score that orders the catalogue, and its reasons and blockers as bits."""
    name, funder = has_text(F.col("program_name")), has_text(F.col("funder_name"))
    typed = F.col("funding_type") != "Unknown"
    amount = F.col("ticket_min").isNotNull() | F.col("ticket_max").isNotNull()
    said = has_text(F.col("application_channel"))
    channel = said & (F.col("application_channel") != "Unknown")
    contact = said | has_text(F.col("application_url")) | has_text(F.col("contact_email")) | has_text(F.col("contact_phone"))  # an unknown channel is still a value
    open_now = F.col("deadline_type").isin("Open", "Rolling") | F.coalesce(F.col("deadline_date") >= as_of, F.lit(False))
    past = ~open_now & F.coalesce(F.col("deadline_date") < as_of, F.lit(False))
    eligible = _filled("raw_eligibility") | _filled("stages")
    geo = _filled("provinces") | _filled("municipalities") | (F.col("geography_scope") != "Unknown")
    signals = [name, funder, has_text(F.col("funding_type")), amount, _filled("industries"), _filled("funds_used"), said, contact]
    few = sum((s.cast("int") for s in signals), F.lit(0)) <= 3
    good = [name, funder, typed, amount, _filled("industries"), _filled("funds_used"), _filled("ownership_targets"), eligible, channel, contact, open_now, geo, _filled("related_documents")]
    bad = [~name, ~funder, ~typed, ~channel, ~contact, past, few]
    points = [(12, 10, 8, 8, 8, 6, 5, 8, 8, 8, 10, 5, 4), (-15, -10, -8, -10, -8, -15, -12)]
    pick = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    total = sum((pick(c, n) for side, cs in zip(points, (good, bad), strict=True) for n, c in zip(side, cs, strict=True)), pick(~amount, -4))
    return computed(df, view_quality=clamp(total, 0, 100).cast("int"), view_reasons=flags(good), view_blockers=flags(bad))


def band(c: Column) -> Column:
    return F.when(c >= 75, "high").when(c >= 45, "medium").otherwise("low")
