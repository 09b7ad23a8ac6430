"""Pages to programme records without a model: content items, what they say of each field, and the record they make."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates, money, records, text, urls
from ..sources import html
from .quality import computed

# Certainty of each kind of content, terms of the field groups, words of required documents, endings of
# domains, roles of pages by terms.
CERTAINTY = {"title": 0.95, "heading": 0.85, "section": 0.88, "interactive": 0.86, "body": 0.6}
GROUPS = {
    "eligibility": ("eligib", "criteria", "who can apply", "who qualifies", "requirements", "qualify"),
    "funding_offer": ("funding", "grant", "loan", "equity", "finance", "amount", "ticket", "investment"),
    "terms": ("repay", "interest", "term", "security", "collateral", "grace"),
    "documents": ("document", "checklist", "certificate", "proof of", "business plan"),
    "application": ("apply", "application", "submit", "portal", "contact", "deadline", "closing date"),
}
DOCUMENT_WORDS = ("document", "documents", "checklist", "certificate", "proof", "registration", "paperwork", "required")
ENDINGS = ("com", "co", "org", "net", "za", "gov", "edu", "ac", "io", "biz", "info")
ROLES = (
    ("about_contact", ("about us", "about", "contact us", "contact", "privacy", "terms and conditions")),
    ("checklist", ("checklist", "required documents", "supporting documents", "paperwork needed")),
    ("application", ("apply", "application", "register", "submission portal", "how to apply")),
    ("eligibility", ("eligibility", "criteria", "who qualifies", "requirements")),
    ("funding_detail", ("funding amount", "ticket size", "loan amount", "grant amount", "repayment", "interest rate")),
)
TYPE_ROLES = {
    "funding_listing": "listing", "tender_procurement": "procurement_notice", "news_article": "news_article", "technology_station": "technology_station",
    "support_programme": "support_detail",
}
UNTITLED = ("page", "custom", "funding products", "products and services")


def content_items(docs: DataFrame) -> DataFrame:
    """``id, place, kind, label, content, certainty``: title, first eight headings, sections, panels and body of each page, in
    that order, each text once."""
    item = lambda kind, label, content: F.struct(F.lit(kind).alias("kind"), label.alias("label"), content.alias("content"))
    none = F.lit("")
    items = F.concat(
        F.array(item("title", none, F.col("title"))), F.transform(F.slice("headings", 1, 8), lambda h: item("heading", none, h)),
        F.transform("sections", lambda s: item("section", s["heading"], s["content"])), F.transform("panels", lambda p: item("interactive", p["label"], p["content"])),
        F.array(item("body", none, F.col("text"))),
    )
    rows = docs.select("id", F.posexplode(items).alias("place", "item")).select("id", "place", "item.*").filter(F.length(F.trim("content")) > 0)
    first = rows.groupBy("id", F.lower(F.concat_ws("|", "label", "content")).alias("_k")).agg(F.min(F.struct("place", "kind", "label", "content")).alias("x"))
    sure = F.create_map(*[x for k, v in CERTAINTY.items() for x in (F.lit(k), F.lit(v))])
    return first.select("id", "x.*").withColumn("certainty", sure[F.col("kind")])


def routed(items: DataFrame) -> DataFrame:
    """``id, group, lines, certainty``: for each page and group of fields the content that speaks of it, by terms in label or text.

    The body takes part only where no section does; lists are distinct before they are gathered."""
    low = F.lower(F.concat_ws(" ", "label", "content"))
    groups = F.array_compact(F.array(*[F.when(low.rlike("|".join(v)), F.lit(k)) for k, v in GROUPS.items()]))
    hits = items.filter("kind in ('section', 'interactive', 'body')").select("id", "place", "kind", "content", "certainty", F.explode(groups).alias("group"))
    every = F.array_sort(F.collect_list(F.struct("place", "content", "kind", "certainty")))
    rows = hits.groupBy("id", "group").agg(every.alias("x"))
    parts = F.filter("x", lambda x: x["kind"] != "body")
    rows = rows.select("id", "group", F.when(F.size(parts) > 0, parts).otherwise(F.col("x")).alias("x"))
    return rows.select("id", "group", F.transform("x", lambda x: x["content"]).alias("lines"), F.array_max(F.transform("x", lambda x: x["certainty"])).alias("certainty"))


def programme_name(title: Column, headings: Column) -> Column:
    """The title up to its first separator, unless it is a support or listing title; then the first heading."""
    head = text.strip_numbering(F.trim(F.regexp_extract(F.coalesce(title, F.lit("")), r"^(.*?)(?: - | \| |$)", 1)))
    vague = F.lower(head).rlike("|".join(UNTITLED))
    first = text.strip_numbering(F.try_element_at(headings, F.lit(1)))
    own = F.nullif(F.trim(head), F.lit(""))
    return F.when(own.isNotNull() & ~records.is_support_title(head) & ~vague, own).otherwise(F.coalesce(first, own))


def funder_name(title: Column, domain: Column) -> Column:
    """What stands behind the title's first separator if it has two words and more, else the domain's name."""
    tail = F.trim(F.regexp_extract(F.coalesce(title, F.lit("")), r"^.*?\s+[-|:–—]\s+(.*)$", 1))
    parts = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), "^www[.]", ""), "[.]"), lambda x: (F.length(x) > 0) & ~x.isin(*ENDINGS))
    named = F.initcap(F.regexp_replace(F.try_element_at(parts, F.lit(1)), "[-_]", " "))
    return F.when(F.size(F.split(tail, " ")) >= 2, tail).otherwise(named)


def page_role(page_type: Column, low: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, role in TYPE_ROLES.items():
        out = out.when(page_type == kind, role)
    for role, words in ROLES:
        out = out.when(low.rlike("|".join(words)), role)
    return out.otherwise("overview")


def page_records(pages: DataFrame, as_of: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", kept: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """One record per page, with its gates, acceptance and doubts; nothing is dropped here. With ``kept`` (writes a table and
    reads it back) pages are parsed once; else each of two branches parses them."""
    docs = html.with_links(html.documents(pages, id_col, url_col, html_col))
    return document_records(kept(docs, "parsed-pages") if kept else docs, as_of)


def document_records(docs: DataFrame, as_of: Column) -> DataFrame:
    """One record per parsed page with links."""
    groups = routed(content_items(docs)).groupBy("id").pivot("group", list(GROUPS)).agg(F.first("lines"))
    none = F.array().cast("array<string>")
    d = docs.join(groups, "id", "left")
    body = F.concat_ws("\n", "title", "text", F.array_join(F.transform("panels", lambda p: p["content"]), "\n"))
    d = computed(d, body=body, domain=urls.domain(F.col("url")))
    low = F.lower("body")
    lists = {k: F.coalesce(F.col(k), none) for k in GROUPS}
    d = d.withColumns({"m": money.money_range_of("body", money.default_currency(F.col("body"), F.col("domain"))), "budget_total": money.budget_total("body", F.lit(None).cast("string")), "dl": dates.deadline_of("body", as_of)})
    contact = F.concat_ws(" ", F.array_join(lists["application"], " "), "body")
    kind = classify.funding_type(F.col("body"))
    blocks, inside = F.greatest(F.lit(1), F.size("sections")), F.size(F.filter("page_links", lambda u: u.contains(F.col("domain"))))
    page_type = records.global_page_type(F.col("body"), F.lit(1), blocks, inside, F.lit(0), F.size("apply_links"), F.size("document_links"))
    page_type = records.detail_page_type(page_type, F.col("body"), F.lit(1), blocks, inside, F.lit(0))
    emails, phones = text.emails(contact), text.phones(contact)
    channel = F.when(F.size("apply_links") > 0, "Online form").when(F.size(emails) > 0, "Email").when(low.contains("apply") | low.contains("application"), "Manual / Contact first").otherwise("Unknown")
    scope = F.when(low.contains("national"), "National").when(low.contains("province") | low.contains("provincial"), "Province").when(low.contains("municipality") | low.contains("local"), "Municipality").otherwise("Unknown")
    d = computed(
        d, page_type=page_type, funding_type=kind["type"], application_channel=channel, geography_scope=scope, contact_email=F.try_element_at(emails, F.lit(1)), contact_phone=F.try_element_at(phones, F.lit(1)),
        program_name=programme_name(F.col("title"), F.col("headings")), funder_name=funder_name(F.col("title"), F.col("domain")), raw_criteria=records.criteria(F.concat_ws("\n", F.array_join(lists["eligibility"], "\n"))),
    )
    needed = F.filter(F.concat(lists["documents"], "document_links"), lambda x: F.lower(x).rlike("|".join(DOCUMENT_WORDS)))
    out = d.select(
        "id", F.col("url").alias("source_url"), "title", "page_type", page_role(F.col("page_type"), low).alias("page_role"), "program_name", "funder_name", "funding_type",
        F.col("m.low").alias("ticket_min"), F.col("m.high").alias("ticket_max"), F.col("m.currency").alias("currency"), F.col("m.confidence").alias("ticket_confidence"), "budget_total",
        F.when(F.col("dl.kind") == "Unknown", F.lit("Unknown")).otherwise(F.col("dl.kind")).alias("deadline_type"), F.col("dl.day").alias("deadline_date"), "geography_scope", "application_channel",
        F.try_element_at("apply_links", F.lit(1)).alias("application_url"), "contact_email", "contact_phone", lists["eligibility"].alias("raw_eligibility"), "raw_criteria",
        lists["funding_offer"].alias("raw_offer"), lists["terms"].alias("raw_terms"), lists["documents"].alias("raw_documents"), lists["application"].alias("raw_application"),
        text.unique_text(needed).alias("required_documents"), F.col("document_links").alias("related_documents"), F.transform("sections", lambda s: s["heading"]).alias("funding_lines"), none.alias("notes"),
    )
    return records.accepted(records.review_marks(records.persist_gate(records.gates(out))))


# Signals of programme pages and of others, of files that are none, and of links to forms.
PROGRAMME_SIGNALS = (
    "funding", "fund", "grant", "loan", "equity", "investment", "finance", "programme", "program", "eligibility", "criteria", "apply", "application",
    "who qualifies", "support for entrepreneurs",
)
OTHER_SIGNALS = (
    "news", "article", "blog", "philosophy", "governance", "process", "procedure", "press release", "media", "publication", "report", "annual report",
    "case study", "success story", "about us", "contact us", "privacy", "terms", "policy", "faq", "download", "procurement", "tender", "pdf", "xlsx",
    "screenshot", "image", "gallery", "attachment",
)
FILE_BLOCKS = (
    "performance", "current", "signature", "report", "annual report", "news", "article", "success story", "media", "procurement", "tender", "faq", "policy",
    "governance", "process",
)
FILE_ALLOWS = (
    "fund", "funding", "programme", "program", "application", "eligibility", "criteria", "investment", "loan", "grant", "equity", "apply", "form", "checklist",
)
FORM_WORDS, GUIDE_WORDS = ("portal", "apply", "application", "register", "submit", "online", "form"), ("brochure", "checklist", "guidelines", "download", "template", "sample")
ROUTE_FROM = 8


def _hits(low: Column, terms: tuple[str, ...]) -> Column:
    return sum((low.contains(t).cast("int") for t in terms), F.lit(0))


def preflight(page_type: Column, low: Column, file_kind: Column, name: Column, chars: Column) -> Column:
    """Struct of decision (yes, no, unclear), confidence and reason before a page is read closely; the first rule that holds.

    ``low`` is the page's text in lower case, ``name`` the last part of its url, ``chars`` the length of its body."""
    strong = _hits(low, tuple(t for t in PROGRAMME_SIGNALS if t != "investment"))
    other = _hits(low, OTHER_SIGNALS)
    file_like = file_kind.isin("pdf", "docx", "xlsx", "image")
    say = lambda d, c, r: F.struct(F.lit(d).alias("decision"), c.alias("confidence"), F.lit(r).alias("reason"))
    sure = lambda x: F.lit(x).cast("double")
    dropped = page_type.isin(*records.DROPPED_TYPES)
    split = F.when((page_type == "generic_content") & (strong >= 2), 0.55).otherwise(0.95)
    allowed, blocked = (_hits(low, t) + _hits(name, t) > 0 for t in (FILE_ALLOWS, FILE_BLOCKS))
    return (
        F.when(dropped, say("no", split, "page type"))
        .when((_hits(low, ("philosophy", "governance", "process", "procedure")) > 0) & (strong == 0), say("no", sure(0.97), "governance or philosophy"))
        .when(file_like & ~allowed & (strong == 0), say("no", sure(0.96), "file without programme terms"))
        .when(file_like & blocked & (strong == 0), say("no", sure(0.94), "report or media file"))
        .when((other >= 2) & (strong == 0), say("no", sure(0.93), "article, media or policy"))
        .when(strong >= 2, say("yes", sure(0.9), "programme signals"))
        .when((strong == 1) & (other == 0) & (chars >= 600), say("yes", sure(0.8), "one programme signal"))
        .otherwise(say("unclear", sure(0.55), ""))
    )


def application_route(links: Column, page: Column, low: Column) -> Column:
    """The application link of most points, if it has ROUTE_FROM: words of forms and portals count for it, of guides, uploads,
    documents and the page itself against it; of equals the first."""
    own = urls.domain(page)

    def points(u: Column) -> Column:
        url = F.lower(u)
        online = url.contains("online.") | url.contains("portal")
        away = F.when((urls.domain(u) != "") & (urls.domain(u) != own), F.when(url.rlike("portal|apply|application|online"), 6).otherwise(-2)).otherwise(0)
        score = (
            F.when(url.rlike("|".join(FORM_WORDS)), 18).otherwise(0) + F.when(online, 10).otherwise(0) + F.when(online & low.contains("application portal"), 10).otherwise(0)
            - F.when(url.rlike("|".join(GUIDE_WORDS)), 18).otherwise(0) - F.when(url.contains("/wp-content/uploads/"), 24).otherwise(0) + away
            - F.when(F.regexp_replace(url, "/+$", "") == F.regexp_replace(F.lower(page), "/+$", ""), 6).otherwise(0)
        )
        return F.when(urls.is_document(u), -100).otherwise(score)

    ranked = F.array_sort(F.transform(links, lambda u, i: F.struct((-points(u)).alias("p"), i.alias("i"), u.alias("u"))))
    best = F.try_element_at(ranked, F.lit(1))
    return F.when(-best["p"] >= ROUTE_FROM, best["u"])


def linked_documents(docs: DataFrame, most: int = 4) -> DataFrame:
    """``id, document``: documents of a page on its own domain that share words with its title, address and headings, the first
    ``most`` links only."""
    context = F.concat_ws(" ", "title", "url", F.array_join(F.slice("headings", 1, 8), " "))
    rows = docs.select("id", "url", context.alias("context"), F.posexplode(F.slice("document_links", 1, most)).alias("place", "document"))
    fits = (urls.domain(F.col("document")) == urls.domain(F.col("url"))) & urls.document_fits(F.col("document"), F.col("context"), F.lit(""))
    return rows.filter(fits).select("id", "place", "document")


def document_evidence(links: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, group, line``: of each linked document with a text (``document, text``) one line tagged with its name, in up to four
    groups of fields by its terms."""
    rows = links.join(texts.filter(F.length(F.trim("text")) > 0), "document")
    name = F.regexp_extract("document", "([^/]+)$", 1)
    line = F.concat(F.lit("["), name, F.lit("] "), F.substring(text.collapse(F.col("text")), 1, 400))
    low = F.lower("text")
    groups = F.array_compact(F.array(*[F.when(low.rlike("|".join(v)), F.lit(k)) for k, v in GROUPS.items()]))
    return rows.select("id", "place", F.explode(F.slice(groups, 1, 4)).alias("group"), line.alias("line"))


SAYS_NOTHING = ("fund", "funding", "programme", "program", "facility", "finance", "investment")
"""Fixed values: words that don't set programmes apart."""


def _telling(c: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*SAYS_NOTHING))
    return F.array_distinct(words)


def missed_candidates(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates of a page (``id, heading``) that none of its records (``id, name``) is: names are equal, or all telling words
    of the shorter one are shared. Pages with one candidate, or as many records as candidates, have none."""
    counts = candidates.groupBy("id").agg(F.count(F.lit(1)).alias("_c")).join(found.groupBy("id").agg(F.count(F.lit(1)).alias("_r")), "id", "left")
    few = counts.filter((F.col("_c") > 1) & (F.coalesce("_r", F.lit(0)) < F.col("_c"))).select("id")
    a, b = _telling(F.col("heading")), _telling(F.col("name"))
    shared = F.size(F.array_intersect(a, b))
    same = (F.lower(F.trim("heading")) == F.lower(F.trim("name"))) | ((F.size(a) > 0) & (F.size(b) > 0) & (shared >= F.least(F.size(a), F.size(b))))
    named = found.select(F.col("id").alias("_id"), "name")
    return candidates.join(few, "id", "left_semi").join(named, (F.col("id") == F.col("_id")) & same, "left_anti")
