"""Crawled and searched records together: records to sites, quality, match and merge of both, drafts to records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, urls
from ..functions.text import programme_key, sorted_ratio, unique_text

MATCH_FROM = 88.0
"""Least similarity of two programme names, words sorted."""
NONE = F.array


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _some(c: str) -> Column:
    return F.size(_list(c)) > 0


def records_to_sites(records: DataFrame, sites: DataFrame) -> DataFrame:
    """Records (``domain, funder``) with the ``site_key`` of the first site whose domain or name they have; null without one.

    Two equi-joins instead of a test of every pair: by domain without ``www.`` and by name, then the earlier site."""
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^www[.]", "")
    named = F.lower(F.coalesce("display_name", "site_key"))
    by_host = sites.filter(bare(F.col("primary_domain")) != "").groupBy(bare(F.col("primary_domain")).alias("_host")).agg(F.min(F.struct("ord", "site_key")).alias("_a"))
    by_name = sites.filter(named != "").groupBy(named.alias("_name")).agg(F.min(F.struct("ord", "site_key")).alias("_b"))
    found = records.withColumns({"_host": bare(F.col("domain")), "_name": _low("funder")}).join(by_host, "_host", "left").join(by_name, "_name", "left")
    return found.withColumn("site_key", F.least("_a", "_b")["site_key"]).drop("_host", "_name", "_a", "_b")


def record_quality(records: DataFrame, official: Column) -> DataFrame:
    """Adds ``hybrid_confidence, hybrid_completeness, hybrid_reasons``; needs the record columns and ``confidence``.

    Confidence is the greater of the record's own and the share of nine factors; of six fields an amount of 0 counts as missing."""
    filled = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    eligible, offered = _some("criteria") | _some("eligibility"), _some("offer") | _some("terms") | _some("snippets")
    amount = F.coalesce("ticket_min", "ticket_max")
    typed = F.coalesce(F.col("funding_type"), F.lit("Unknown")) != "Unknown"
    factors = [filled("name"), filled("funder"), filled("url"), official, eligible, typed, amount.isNotNull(), offered, F.coalesce(F.col("has_evidence"), F.lit(False))]
    share = sum((F.coalesce(c, F.lit(False)).cast("int") for c in factors), F.lit(0)) / 9.0
    fields = [filled("name"), filled("funder"), filled("url"), eligible, typed, F.coalesce(amount, F.lit(0)) != 0]
    sure = F.greatest("confidence", share)
    reasons = [
        (~filled("url"), "missing_source_url"), (amount.isNull(), "missing_funding_amount"), (~eligible, "missing_eligibility"),
        (~offered, "missing_programme_details"), (sure < 0.7, "low_confidence"),
    ]
    return records.withColumns(
        {
            "hybrid_confidence": F.round(sure, 4),
            "hybrid_completeness": F.round(sum((c.cast("int") for c in fields), F.lit(0)) / 6.0, 4),
            "hybrid_reasons": F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in reasons])),
        }
    )


def critical_gap(name: Column, funder: Column, url: Column, funding_type: Column, amount: Column, eligible: Column) -> Column:
    """A record lacks something that its programme can't do without."""
    has = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    whole = has(name) & has(funder) & has(url) & (F.coalesce(funding_type, F.lit("Unknown")) != "Unknown") & amount.isNotNull() & F.coalesce(eligible, F.lit(False))
    return ~whole


SCALARS = ("url", "title", "ticket_min", "ticket_max", "currency", "budget_total", "payback_text", "payback_structure", "apply_url", "email", "phone")
LISTS = ("urls", "criteria", "offer", "terms", "documents_text", "application", "lines", "industries", "use_of_funds", "stages", "required", "related")


def matched_pairs(crawled: DataFrame, web: DataFrame) -> DataFrame:
    """``web_ord, ord``: of each searched record the crawled (or earlier searched) record that it is, itself if it is new.

    Funder and parent agree, and the page is the same or the names are alike by MATCH_FROM. Records of a funder and parent
    come together in order, as a record that found no match is a target for later ones."""
    slim = lambda df, side: df.select(
        "ord", F.lit(side).alias("side"), _low("funder").alias("f"), programme_key(F.col("parent"), F.col("funder")).alias("p"), programme_key(F.col("name"), F.col("funder")).alias("n"), F.coalesce("url", F.lit("")).alias("u")
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "ord"])
        targets: list[tuple] = []
        out = []
        for r in rows.itertuples():
            hit = next((t for t in targets if t[1] == r.u or (t[0] and r.n and sorted_ratio(t[0], r.n) >= MATCH_FROM)), None) if r.side else None
            if r.side:
                out.append((r.ord, hit[2] if hit else r.ord, hit is None))
            if hit is None:
                targets.append((r.n, r.u, r.ord))
        return pd.DataFrame(out, columns=["web_ord", "ord", "fresh"])

    both = slim(crawled, 0).unionByName(slim(web, 1))
    return both.groupBy("f", "p").applyInPandas(run, "web_ord long, ord long, fresh boolean")


def merged_records(crawled: DataFrame, web: DataFrame) -> DataFrame:
    """Crawled records with the gaps filled from their searched ones in order, lists united, the greater confidence, and the
    official page in place of another; new searched records are added. ``ord`` is unique over both tables."""
    pairs = matched_pairs(crawled, web)
    source = crawled.withColumns({"_turn": F.lit(-1).cast("long"), "target": F.col("ord")})
    found = web.join(pairs.withColumnRenamed("ord", "target"), F.col("ord") == F.col("web_ord")).withColumn("_turn", F.col("ord")).drop("web_ord", "fresh")
    rows = source.unionByName(found.select(*source.columns))
    missing = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    first = lambda c: F.min_by(F.when(~missing(c), F.col(c)), F.when(~missing(c), F.col("_turn"))).alias(c)
    own_official = F.coalesce(F.max(F.when(F.col("_turn") < 0, F.col("official"))), F.lit(False))
    better = F.min_by(F.when(F.col("official") & ~missing("url"), F.col("url")), F.when(F.col("official") & ~missing("url"), F.col("_turn")))
    base = rows.groupBy("target").agg(
        F.min_by(F.struct("name", "funder", "parent"), "_turn").alias("h"), *[first(c) for c in SCALARS if c != "url"], first("url"), own_official.alias("_own"), better.alias("_better"),
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("sources"), F.min("_turn").alias("_first"),
    )
    for c in LISTS:
        items = rows.select("target", "_turn", F.posexplode(_list(c)).alias("i", "v")).groupBy("target", F.lower("v").alias("k")).agg(F.min(F.struct("_turn", "i", "v")).alias("x"))
        base = base.join(items.groupBy("target").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias(c)), "target", "left")
    method = F.when(F.col("_first") >= 0, "web_search").when(F.col("sources") > 1, "crawl+web_search").otherwise("crawl")
    return base.withColumns({"url": F.when(~F.col("_own") & F.col("_better").isNotNull(), F.col("_better")).otherwise(F.col("url")), "method": method}).select(F.col("target").alias("ord"), "h.*", *SCALARS, *LISTS, "confidence", "sources", "method")


def persistable(records: DataFrame, least: float) -> DataFrame:
    """Records with name, funder and page; those of some but little confidence are marked for review."""
    has = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    low = (F.col("confidence") > 0) & (F.col("confidence") < least)
    return records.filter(has("name") & has("funder") & has("url")).withColumn("review", F.when(low, F.array(F.lit("hybrid_confidence_below_threshold"))).otherwise(F.array().cast("array<string>")))


# Terms by which searched drafts tell their type.
DRAFT_TERMS = {
    "Loan": ("repayment", "repayable", "loan term", "tenor", "interest", "collateral", "security", "debt"),
    "Equity": ("ownership stake", "shareholding", "equity participation", "investment exit", "equity stake"),
    "Grant": ("non-repayable", "non repayable", "grant"),
    "Guarantee": ("guarantee", "guarantees"),
    "Hybrid": ("hybrid", "blended finance", "mezzanine", "convertible"),
}
TYPES = ("Grant", "Loan", "Equity", "Guarantee", "Hybrid", "Other", "Unknown")


def draft_type(given: Column, text: Column) -> Column:
    """A given label first; else one family of terms is its type, several are a hybrid."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "•+&", "   ")
    hits = {k: low.rlike("|".join(v)) for k, v in DRAFT_TERMS.items()}
    labels = F.create_map(*[x for t in TYPES for x in (F.lit(t.lower()), F.lit(t))])
    count = sum((h.cast("int") for h in hits.values()), F.lit(0))
    found = F.when(count > 1, "Hybrid")
    for k in ("Loan", "Equity", "Grant", "Guarantee"):
        found = found.when(hits[k], k)
    return F.coalesce(labels[F.lower(F.trim(F.coalesce(given, F.lit(""))))], found.otherwise("Unknown"))


def draft_sources(drafts: DataFrame, sources: DataFrame, most: int = 8) -> DataFrame:
    """``draft, sources``: of each draft's search its sources, the one it cites first, then by official rank and url."""
    near = drafts.select("draft", "search", F.col("source_url").alias("_own")).join(sources, "search")
    order = Window.partitionBy("draft").orderBy((F.col("url") != F.coalesce("_own", F.lit(""))).cast("int"), "official_rank", "url")
    top = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return top.groupBy("draft").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]).alias("sources"))


def merged_drafts(drafts: DataFrame) -> DataFrame:
    """Drafts of equal name and page as one: values of the first that has them, lists united, the greater confidence. Drafts
    without name or page pass as they are."""
    key = F.when((_low("name") != "") & (_low("source_url") != ""), F.concat_ws("|", _low("name"), urls.canonical(F.col("source_url")))).otherwise(F.concat(F.lit("#"), "draft"))
    rows = drafts.withColumn("_k", key)
    first = lambda c: F.min_by(F.when(_low(c) != "", F.col(c)), F.when(_low(c) != "", F.col("draft"))).alias(c)
    base = rows.groupBy("_k").agg(F.min("draft").alias("draft"), first("name"), first("source_url"), first("funding_type"), first("amount_text"), F.max("confidence").alias("confidence"))
    lines = rows.select("_k", "draft", F.posexplode(_list("lines")).alias("i", "v")).groupBy("_k", F.lower("v").alias("low")).agg(F.min(F.struct("draft", "i", "v")).alias("x"))
    return base.join(lines.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("lines")), "_k", "left").drop("_k")


def drafts_to_records(drafts: DataFrame, currency: str) -> DataFrame:
    """Records of drafts that have a name and a page: type, amounts from their text, confidence per field, review below 70."""
    text = F.concat_ws(" ", F.array_join(_list("lines"), " "), "amount_text")
    made = drafts.filter((_low("name") != "") & (_low("source_url") != "")).withColumns({"range": money.money_range_of(text, F.lit(currency)), "told": money.amount_evidence_of(text, F.lit(currency))})
    low, high = F.coalesce("range.low", "told.minimum.low"), F.coalesce("range.high", "told.maximum.high")
    kind = draft_type(F.col("funding_type"), text)
    sure = F.col("confidence") / 100.0
    return made.select(
        "draft", "name", urls.canonical(F.col("source_url")).alias("url"), kind.alias("funding_type"), low.alias("ticket_min"), high.alias("ticket_max"),
        F.create_map(F.lit("program_name"), sure, F.lit("funding_type"), F.when(kind == "Unknown", F.least(sure, F.lit(0.55))).otherwise(sure), F.lit("ticket_max"), F.when(high.isNotNull(), sure).otherwise(0.0)).alias("field_confidence"),
        F.when(F.col("confidence") < 70, F.array(F.lit("web_search_confidence_below_70"))).otherwise(F.array().cast("array<string>")).alias("review"), unique_text(_list("lines")).alias("lines"),
    )


def best_by_key(records: DataFrame) -> DataFrame:
    """Of records equal in funder, name, parent and page the one of most confidence, the first of equals, in the first one's place."""
    keys = [_low("funder").alias("_f"), _low("name").alias("_n"), _low("parent").alias("_p"), F.coalesce("url", F.lit("")).alias("_u")]
    rest = F.struct(*[c for c in records.columns])
    found = records.groupBy(*keys).agg(F.max_by(rest, F.struct("confidence", -F.col("ord"))).alias("r"), F.min("ord").alias("first_ord"))
    return found.select("r.*", "first_ord")
