"""Content of pages as evidence of record fields: each item is routed to buckets of fields by its terms, and what it says of
them becomes rows ``(id, place, field, value, confidence, method)``.

One automaton finds the terms of all buckets in one walk over an item's text; amounts, deadlines and repayments are read
only where an item goes to their bucket. Rows stay with their page, so nothing is shuffled before they are folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates, money, records, text
from ..functions.terms import with_hits
from .builder import funder_name
from .quality import computed

# Terms of the buckets, in order; words of fields; certainties.
BUCKETS = {
    "program": ("about", "overview", "summary", "programme", "program", "what is", "who we are"),
    "eligibility": ("eligibility", "criteria", "requirements", "who can apply", "who qualifies", "qualifying", "applicant requirements", "funding requirements", "selection criteria"),
    "funding": ("funding", "fund", "grant", "loan", "equity", "investment", "finance", "offer", "budget", "amount", "capital"),
    "terms": ("terms", "conditions", "repayment", "payback", "interest", "tenor", "term", "moratorium", "grace period", "security", "collateral"),
    "documents": ("document", "documents", "checklist", "guidelines", "brochure", "download", "certificate", "proof", "registration"),
    "application": ("apply", "application", "portal", "submit", "submission", "register", "how to apply", "application process"),
    "deadline": ("deadline", "closing date", "opening date", "intake", "applications close", "closing"),
    "contact": ("contact", "email", "phone", "telephone", "whatsapp", "call us"),
    "geography": ("national", "province", "municipality", "local", "south africa", "regional"),
}
SUPPORTING = "supporting"
TOLD, SHARED = ("title", "heading", "section", "interactive"), ("title", "heading", "body")
SEVERAL = ("multi_program_page", "parent_page")
DOCUMENT_WORDS = ("document", "documents", "checklist", "certificate", "proof", "registration", "download")
FORM_WORDS = ("apply", "application", "portal", "register", "submit")
SCOPES = (
    ("National", ("national", "countrywide", "south africa")), ("Province", ("province", "provincial")), ("Municipality", ("municipality", "municipal")), ("Local", ("local", "regional")),
)
LEAST = {
    "program_name": 0.95, "funder_name": 0.9, "source_page_title": 0.9, "eligibility": 0.84, "funding": 0.82, "terms": 0.82, "documents": 0.8, "required_documents": 0.8, "application": 0.82,
    "application_url": 0.86, "online": 0.82, "address": 0.84, "manual": 0.7, "deadline": 0.8, "deadline_date": 0.88, "contact": 0.9, "contact_text": 0.75, "geography": 0.72,
}
MOST_CHARS = 900


def _has(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def routed_items(items: DataFrame) -> DataFrame:
    """``items (id, place, kind, label, content, certainty, structure)`` with ``said``, their text, and ``buckets``.

    An item without terms is of the programme if it is a title, heading or section, else supporting. On pages of several
    programmes what all share (title, headings, body) says nothing of one: titles and headings are of the programme, the
    rest is supporting. Items without text are left out."""
    said = text.collapse(F.concat_ws(" ", "label", "content"))
    rows = items.withColumn("said", said).filter("said <> ''").withColumn("_low", F.lower("said"))
    names = [b for b, words in BUCKETS.items() for _ in words]
    rows = with_hits(rows, "_low", [w for words in BUCKETS.values() for w in words])
    listed = F.array(*[F.lit(n) for n in names])
    found = F.array_distinct(F.transform("hits", lambda k: listed[k]))  # places ascend, so buckets come in order
    alone = F.when(F.col("kind").isin(*TOLD), F.array(F.lit("program"))).otherwise(F.array(F.lit(SUPPORTING)))
    shared = F.when(F.col("kind").isin("title", "heading"), F.array(F.lit("program"))).otherwise(F.array(F.lit(SUPPORTING)))
    several = F.col("structure").isin(*SEVERAL) & F.col("kind").isin(*SHARED)
    buckets = F.when(F.coalesce(several, F.lit(False)), shared).when(F.size(found) > 0, found).otherwise(alone)
    return rows.withColumn("buckets", buckets).drop("_low", "hits")


def field_evidence(routed: DataFrame, as_of: Column) -> DataFrame:
    """``id, place, field, value, confidence, method`` of routed items; numbers and days as text. The confidence is the item's
    own or that of the way it was read, whichever is greater."""
    within = lambda b: F.array_contains("buckets", b)
    only = lambda b: F.when(within(b), F.col("said"))
    rows = routed.withColumns({"_money": only("funding"), "_day": only("deadline")})
    rows = rows.withColumns({"m": money.money_range_of("_money", F.lit(None).cast("string")), "d": dates.deadline_of("_day", as_of)})
    said, own = F.col("said"), F.col("certainty")
    scope = F.when(F.lit(False), "")
    for name, words in SCOPES:
        scope = scope.when(_has(F.lower("said"), words), name)
    title = text.strip_numbering(F.trim(F.regexp_extract("said", r"^(.*?)(?: - | \| |$)", 1)))
    papers = F.filter(text.sentences(F.when(F.length(F.trim(F.col("content"))) > 0, F.col("content")).otherwise(said)), lambda s: _has(F.lower(s), DOCUMENT_WORDS))
    forms = F.filter(text.urls(said), lambda u: _has(F.lower(u), FORM_WORDS))
    is_title, reach = F.col("kind") == "title", within("application") | within("contact")
    first = lambda x: F.try_element_at(x, F.lit(1))
    # read once for each item, and only where its buckets ask for it: the rows below are made in a generator, which is interpreted
    rows = computed(
        rows, _pay=F.when(within("terms"), records.repayment(said)), _criteria=F.when(within("eligibility"), records.criteria(said)), _papers=F.when(within("documents"), papers),
        _form=F.when(within("application"), first(forms)), _mail=F.when(reach, first(text.emails(said))), _phone=F.when(reach, first(text.phones(said))),
        _scope=F.when(within("geography"), scope), _title=F.when(is_title, title), _funder=F.when(is_title, funder_name(said, F.lit(None).cast("string"))), _snippet=F.substring("said", 1, MOST_CHARS),
    )
    rows = computed(rows, _structure=F.when(within("terms"), classify.repayment_structure(said, F.col("_pay")["frequency"])))
    pay, criteria, papers, form, mail, phone, scope, title, funder, snippet = (F.col(f"_{c}") for c in ("pay", "criteria", "papers", "form", "mail", "phone", "scope", "title", "funder", "snippet"))
    sure = lambda k: F.greatest(own, F.lit(LEAST[k]))
    told = lambda c: F.greatest(own, c)
    rules: list[tuple[Column, str, Column, Column, str]] = []

    def rule(when: Column, field: str, value: Column, confidence: Column, method: str) -> None:
        rules.append((when, field, value, confidence, method))

    rule(is_title, "program_name", F.coalesce(F.nullif(F.trim(title), F.lit("")), said), sure("program_name"), "deterministic_parser")
    rule(is_title, "funder_name", funder, sure("funder_name"), "deterministic_parser")
    rule(is_title, "source_page_title", said, sure("source_page_title"), "direct_page_evidence")
    rule(within("eligibility"), "raw_eligibility", snippet, sure("eligibility"), "heading_based_inference")
    rule(within("eligibility"), "raw_criteria", F.when(F.size(criteria) > 0, F.array_join(criteria, "\n")).otherwise(snippet), sure("eligibility"), "deterministic_parser")
    rule(within("funding"), "raw_offer", snippet, sure("funding"), "heading_based_inference")
    rule(within("funding"), "ticket_min", F.col("m.low").cast("string"), told(F.col("m.confidence")), "regex_from_prose")
    rule(within("funding"), "ticket_max", F.col("m.high").cast("string"), told(F.col("m.confidence")), "regex_from_prose")
    rule(within("funding"), "budget_total", F.coalesce("m.high", "m.low").cast("string"), told(F.col("m.confidence")), "regex_from_prose")
    rule(within("funding"), "currency", F.col("m.currency"), told(F.col("m.confidence")), "regex_from_prose")
    rule(within("terms"), "raw_terms", snippet, sure("terms"), "heading_based_inference")
    rule(within("terms"), "payback_months_min", pay["low"].cast("string"), told(pay["confidence"]), "regex_from_prose")
    rule(within("terms"), "payback_months_max", pay["high"].cast("string"), told(pay["confidence"]), "regex_from_prose")
    rule(within("terms"), "grace_months", pay["grace"].cast("string"), told(pay["confidence"]), "regex_from_prose")
    rule(within("terms"), "repayment_frequency", F.when(pay["frequency"] != "Unknown", pay["frequency"]), told(pay["confidence"]), "regex_from_prose")
    rule(within("terms"), "payback_structure", F.col("_structure"), told(pay["confidence"]), "regex_from_prose")
    rule(within("documents"), "raw_documents", snippet, sure("documents"), "heading_based_inference")
    rule(within("documents"), "required_documents", F.nullif(F.array_join(papers, "\n"), F.lit("")), sure("required_documents"), "deterministic_parser")
    rule(within("application"), "raw_application", snippet, sure("application"), "heading_based_inference")
    rule(within("application"), "application_url", form, sure("application_url"), "regex_from_prose")
    rule(within("application"), "application_channel", F.when(form.isNotNull(), "Online form"), sure("online"), "regex_from_prose")
    rule(within("application") & form.isNull() & mail.isNull() & phone.isNull(), "application_channel", F.lit("Manual / Contact first"), sure("manual"), "regex_from_prose")
    for bucket, least in (("application", "address"), ("contact", "contact")):
        rule(within(bucket), "contact_email", mail, sure(least), "regex_from_prose")
        rule(within(bucket), "contact_phone", phone, sure(least), "regex_from_prose")
    rule(within("contact"), "raw_application", snippet, sure("contact_text"), "heading_based_inference")
    rule(within("deadline"), "raw_terms", snippet, sure("deadline"), "heading_based_inference")
    rule(within("deadline"), "deadline_date", F.col("d.day").cast("string"), sure("deadline_date"), "regex_from_prose")
    rule(within("deadline"), "deadline_type", F.col("d.kind"), sure("deadline"), "regex_from_prose")
    rule(within("geography"), "geography_scope", scope, sure("geography"), "regex_from_prose")
    told_rows = F.array(*[F.struct(F.lit(f).alias("field"), F.when(w, v).alias("value"), c.cast("double").alias("confidence"), F.lit(m).alias("method")) for w, f, v, c, m in rules])
    return rows.select("id", "place", F.inline(F.filter(told_rows, lambda x: x["value"].isNotNull())))


def folded_fields(evidence: DataFrame) -> DataFrame:
    """``id, field, value, confidence, n``: of each page and field the value of the first item that tells one, the greatest
    confidence, and how many tell it. Of a page's items only so many rows as there are fields reach the shuffle from a task."""
    return evidence.groupBy("id", "field").agg(F.min_by("value", F.struct("place", F.col("value"))).alias("value"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
