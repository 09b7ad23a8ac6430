"""Hand-made cases: operators over small tables written here, and what they must give, as literal tables in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.functions import classify, dates, money, records, text, urls
from sluicework.operators import builder, hybrid, resolve
from sluicework.sources import html
from sluicework.plans.views import kept


def _values(names: str, rows: list[tuple]) -> str:
    """Rows as a SQL table."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(float(v)) + "::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


_LONG = "word " * 200
# (case, url, status, html, type, site rule, reason)
RENDER = [
    (1, "https://a.example/x.pdf", 500, None, "", False, None),
    (2, "https://a.example/", 200, _LONG, "text/html", True, "adapter-browser-rule"),
    (3, "https://a.example/", 429, _LONG, "text/html", False, "restricted-or-rate-limited-status"),
    (4, "https://a.example/", 500, _LONG, "text/html", False, "http-fetch-failed"),
    (5, "https://a.example/", 200, "", "text/html", False, "http-fetch-failed"),
    (6, "https://a.example/", 200, "<p>Just a moment</p>" + _LONG, "text/html", False, "browser-challenge"),
    (7, "https://a.example/", 200, "<p>This site requires JavaScript</p>" + _LONG, "text/html", False, "javascript-required"),
    (8, "https://a.example/", 200, "<p>short page</p>", "text/html", False, "thin-html"),
    (9, "https://a.example/", 200, "<script>a</script><script>b</script><p>" + "word " * 60 + "</p>", "text/html", False, "spa-shell"),
    (10, "https://a.example/", 200, '<div id="root">' + "word " * 100 + "</div>", "text/html", False, "app-shell"),
    (11, "https://a.example/", 200, '<div id="root">' + _LONG + "</div>", "text/html", False, None),
    (12, "https://a.example/", 200, "<p>" + "word " * 60 + "</p>", "text/html", False, None),
    (13, "https://a.example/x.pdf?v=1", 404, None, "", False, "http-fetch-failed"),
]


def render_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why pages need a browser."""
    d = spark.createDataFrame([r[:6] for r in RENDER], "id int, url string, status int, html string, kind string, rule boolean")
    return d.select("id", records.render_reason(F.col("url"), F.col("status"), F.col("html"), F.col("kind"), F.col("rule")).alias("reason"))


# (text, kind, day, confidence), as seen on 2026-01-10
DEADLINES = [
    ("Applications close on 15 May 2026.", "FixedDate", "2026-05-15", 0.9),
    ("Deadline: 5 Mar 2027", "FixedDate", "2027-03-05", 0.9),
    ("closing date 31-12-2026", "FixedDate", "2026-12-31", 0.9),
    ("The closing date is 01/02/2026 at noon.", "FixedDate", "2026-02-01", 0.9),
    ("Submissions close March 3rd, 2026.", "FixedDate", "2026-03-03", 0.9),
    ("Deadline 2 January", "FixedDate", "2027-01-02", 0.9),
    ("Deadline: 2 February, no later.", "FixedDate", "2026-02-02", 0.9),
    ("The intake starts on 2026-04-01 and runs for a year.", "FixedDate", "2026-04-01", 0.72),
    ("Held on 1 March 2026. The closing date is 9 June 2026.", "FixedDate", "2026-06-09", 0.9),
    ("Applications are considered on a rolling basis.", "Rolling", None, 0.88),
    ("This fund is open year-round; deadline 1 May 2026 for reports.", "Open", None, 0.9),
    ("Ongoing and rolling stock is financed.", "Unknown", None, 0.0),
    ("Minimum of 51% black female ownership.", "Unknown", None, 0.0),
    ("The deadline is 30 February 2026.", "Unknown", None, 0.0),
    ("", "Unknown", None, 0.0),
]


def deadline_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines of many shapes of dates."""
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(DEADLINES)], "id int, t string")
    d = d.select("id", dates.deadline_of("t", F.lit("2026-01-10").cast("date")).alias("d"))
    return d.select("id", "d.kind", F.col("d.day").cast("string").alias("day"), "d.confidence")


# (text, low, high, currency, confidence)
AMOUNTS = [
    ("Funding ranges between R500k and R5m for qualifying SMEs.", 5e5, 5e6, "ZAR", 0.9),
    ("Applicants may receive up to R10 million for equipment purchases.", None, 1e7, "ZAR", 0.9),
    ("Applications close in 2020.", None, None, None, 0.0),
    ("The programme has 2024 participants and 350 applications.", None, None, None, 0.0),
    ("Call 011 555 0100 for details.", None, None, None, 0.0),
    ("Tender number T2025/004 closes on 12/05/2026.", None, None, None, 0.0),
    ("Applicants need 51% black ownership.", None, None, None, 0.0),
    ("Support is for TRL 4-7 technologies.", None, None, None, 0.0),
    ("Postal code 2001 applies.", None, None, None, 0.0),
    ("The loan amount is ZAR 1 million for qualifying businesses.", None, 1e6, "ZAR", 0.65),
    ("Ideal R300–R500m for strategic expansion opportunities.", 3e8, 5e8, "ZAR", 0.9),
    ("The fund targets US$20–US$40m investments and can scale to R1.35 billion.", 2e7, 4e7, "USD", 0.9),
    ("Funding from R 250 000 to R 1,500,000.", 250000.0, 1500000.0, "ZAR", 0.9),
    ("Grants of £75 000 per firm.", None, 75000.0, "GBP", 0.65),
    ("Loans with a minimum of $2m.", 2e6, None, "USD", 0.9),
]


def amount_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, M3, M4: amounts of many wordings, and numbers that are none."""
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(AMOUNTS)], "id int, t string")
    d = d.select("id", money.money_range_of("t", F.lit("ZAR")).alias("m"))
    return d.select("id", "m.low", "m.high", "m.currency", "m.confidence")


# (text, domain, ideal low, ideal high, minimum, maximum, range low, range high, currency)
EVIDENCE = [
    ("Min R100m. Ideal R300–R500m. Funding is for strategic infrastructure deals.", "", 3e8, 5e8, 1e8, None, None, None, None),
    ("Loans of at least $5 000. Loans not exceeding $90 000. Loans of at least $7 000.", "", None, None, 5000.0, 90000.0, None, None, None),
    ("Grant funding between R1m and R2m in Rand terms. Typical ticket R1.5m.", "", 1.5e6, 1.5e6, None, None, 1e6, 2e6, "ZAR"),
    ("Nothing is said here.", "fund.co.za", None, None, None, None, None, None, "ZAR"),
]


def evidence_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M7: what sentences say of ideal, least and most amounts, and the currency that a text or domain implies."""
    d = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(EVIDENCE)], "id int, t string, domain string")
    d = d.select("id", money.amount_evidence_of("t", F.lit(None).cast("string")).alias("e"), money.default_currency(F.col("t"), F.col("domain")).alias("implied"))
    return d.select(
        "id", F.col("e.ideal.low").alias("ideal_low"), F.col("e.ideal.high").alias("ideal_high"), F.col("e.minimum.low").alias("least"), F.col("e.maximum.high").alias("most"),
        F.col("e.range.low").alias("range_low"), F.col("e.range.high").alias("range_high"), "implied",
    )


# (ord, domain, name, funder, parent, url, document, apply url, role, type, cluster)
_P, _L = "funding_programme", "funding_listing"
RECORDS = [
    (1, "a.org", "Seed Fund", "Agency", "", "https://a.org/p/seed", None, "", "overview", _P, 1),
    (2, "a.org", "seed  fund", "agency", "", "https://a.org/p/seed/how-to-apply", None, "", "application", _P, 1),  # equal names: key, name, funder
    (3, "a.org", "Eligibility", "Agency", "", "https://a.org/p/seed", None, "", "eligibility", _P, 1),  # same page, generic name
    (4, "a.org", "Growth Loan", "Agency", "", "https://a.org/p/seed", None, "", "overview", _P, 4),  # same page, other telling name
    (5, "b.org", "", "Agency", "", "https://a.org/p/seed", None, "", "overview", _P, 1),  # same page, other domain
    (6, "b.org", "Seed Fund", "Agency", "", "https://b.org/x", None, "", "overview", _P, 6),  # other domain, no page shared
    (7, "c.org", "Bridge", "Fund C", "Main", "https://c.org/bridge", None, "", "overview", _P, 7),
    (8, "c.org", "Bridge", "Fund C", "Other", "https://c.org/bridge-2", None, "", "overview", _P, 7),  # key, name, funder, roles outweigh the parent
    (9, "c.org", "Bridge", "Fund C", "Other", "https://c.org/news/bridge", None, "", "generic", "news_article", 9),  # a news page: unsure, then parents part
    (10, "d.org", "", "", "", "https://d.org/w/loan/eligibility", "https://d.org/doc.pdf", "", "eligibility", _P, 10),
    (11, "d.org", "", "", "", "https://d.org/z", "https://d.org/doc.pdf", "https://d.org/apply", "overview", _P, 10),  # document and roles, 20 points: unsure, then nameless records of one document
    (12, "d.org", "", "Bank D", "", "https://d.org/w/loan/criteria", None, "", "checklist", _P, 10),  # both name the path w/loan
]


def _records(spark: SparkSession) -> DataFrame:
    rows = [(r[0], r[1], r[2], r[3], r[4], r[5], [r[5]], [r[6]] if r[6] else [], r[7], r[8], r[9]) for r in RECORDS]
    return spark.createDataFrame(rows, resolve.FIELDS)


def star_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy stars by the pair rules, in blocks."""
    return resolve.star_clusters(_records(spark), kept).select("ord", "cluster")


# (site key, name, domain), (ord, domain, funder, site)
SITES = [("s1", "Alpha Fund", "www.alpha.org"), ("s2", "Beta", "beta.org"), ("s3", "Alpha Fund", "third.org"), ("s4", None, "fourth.org")]
SITE_RECORDS = [(1, "alpha.org", "Nobody", "s1"), (2, "third.org", "Beta", "s2"), (3, "x.org", "ALPHA FUND", "s1"), (4, "third.org", "", "s3"), (5, "none.org", "none", None), (6, None, "s4", "s4")]


def site_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to the first site of their domain or name."""
    sites = spark.createDataFrame([(i, *s) for i, s in enumerate(SITES)], "ord int, site_key string, display_name string, primary_domain string")
    d = spark.createDataFrame([r[:3] for r in SITE_RECORDS], "id int, domain string, funder string")
    return hybrid.records_to_sites(d, sites).select("id", "site_key")


_HYBRID = (
    "ord long, name string, funder string, parent string, url string, official boolean, title string, ticket_min double, ticket_max double, currency string, budget_total double, payback_text string, "
    "payback_structure string, apply_url string, email string, phone string, " + ", ".join(f"{c} array<string>" for c in hybrid.LISTS) + ", confidence double"
)


def _hybrid(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(ord, name, funder, parent, url, official, least, email, lines, confidence) as whole records."""
    out = []
    for o, name, funder, parent, url, official, least, email, lines, sure in rows:
        lists = {"lines": lines, "urls": [url]}
        out.append((o, name, funder, parent, url, official, None, least, None, None, None, None, None, None, email, None, *(lists.get(c, []) for c in hybrid.LISTS), sure))
    return spark.createDataFrame(out, _HYBRID)


CRAWLED = [
    (1, "Seed Funding Programme", "Alpha", "", "https://news.example/seed", False, None, None, ["grant"], 0.4),
    (2, "Growth Loan", "Alpha", "", "https://alpha.org/growth", True, 5.0, "", ["loan"], 0.9),
    (3, "Growth Loan", "Beta", "", "https://beta.org/growth", True, None, None, [], 0.5),
]
WEB = [
    (11, "Alpha Seed", "ALPHA", "", "https://alpha.org/seed", True, 7.0, "a@alpha.org", ["Grant", "voucher"], 0.8),  # 1: equal key, official page
    (12, "Loan, growth", "alpha", None, "https://x.example/1", False, 9.0, "b@x.example", [], 0.3),  # 2: words sorted
    (13, "Anything", "Beta", "", "https://beta.org/growth", True, None, "c@beta.org", [], 0.5),  # 3: same page
    (14, "Brand new", "Beta", "", "https://beta.org/new", True, None, None, ["x"], 0.7),  # new
    (15, "brand NEW fund", "Beta", "", "https://y.example/", False, 1.0, None, ["X", "y"], 0.2),  # joins 14
    (16, "Growth Loan", "Beta", "Main", "https://beta.org/growth", True, None, None, [], 0.6),  # other parent
]
HYBRID = [
    (1, "https://alpha.org/seed", 7.0, "a@alpha.org", "grant|voucher", 0.8, 2, "crawl+web_search"),
    (2, "https://alpha.org/growth", 5.0, "b@x.example", "loan", 0.9, 2, "crawl+web_search"),
    (3, "https://beta.org/growth", None, "c@beta.org", "", 0.5, 2, "crawl+web_search"),
    (14, "https://beta.org/new", 1.0, None, "x|y", 0.7, 2, "web_search"),
    (16, "https://beta.org/growth", None, None, "", 0.6, 1, "web_search"),
]


def hybrid_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched records matched with crawled ones and merged."""
    m = hybrid.merged_records(_hybrid(spark, CRAWLED), _hybrid(spark, WEB))
    return m.select("ord", "url", F.col("ticket_min").alias("least"), "email", F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "|").alias("lines"), "confidence", "sources", "method")


# (draft, search, name, source url, type, amount text, lines, confidence)
DRAFTS = [
    (1, 1, "Seed Grant", "https://A.org/seed/?utm_source=x", None, "R1m to R2m", ["A non-repayable grant of up to R2 million."], 80),
    (2, 1, "seed grant", "https://a.org/seed", "Grant", "", ["Second line."], 90),
    (3, 1, "", "https://a.org/none", None, "", [], 50),
    (4, 2, "Growth", "https://b.org/g", None, "minimum R5m", ["Loan with interest and an equity stake."], 60),
    (5, 2, "Bond", "https://b.org/h", "loan", "", [], 70),
]
SOURCES = [(1, "https://z.org/1", 4), (1, "https://a.org/seed", 2), (1, "https://a.org/b", 1), (2, "https://b.org/h", 3), (2, "https://c.org", 3), *((2, f"https://d.org/{i}", 4) for i in range(9))]
DRAFT_RECORDS = [
    (1, "https://a.org/seed", "Grant", 1e6, 2e6, 0.9, "", 2),
    (4, "https://b.org/g", "Hybrid", 5e6, None, 0.6, "web_search_confidence_below_70", 1),
    (5, "https://b.org/h", "Loan", None, None, 0.7, "", 0),
]
DRAFT_SOURCES = [
    (1, "https://a.org/b|https://a.org/seed|https://z.org/1"), (2, "https://a.org/seed|https://a.org/b|https://z.org/1"), (3, "https://a.org/b|https://a.org/seed|https://z.org/1"),
    (4, "https://b.org/h|https://c.org|" + "|".join(f"https://d.org/{i}" for i in range(6))), (5, "https://b.org/h|https://c.org|" + "|".join(f"https://d.org/{i}" for i in range(6))),
]


def _drafts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DRAFTS, "draft int, search int, name string, source_url string, funding_type string, amount_text string, lines array<string>, confidence int")


def draft_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts merged and made records."""
    r = hybrid.drafts_to_records(hybrid.merged_drafts(_drafts(spark)), "ZAR")
    return r.select("draft", "url", "funding_type", "ticket_min", "ticket_max", F.col("field_confidence")["funding_type"].alias("sure"), F.array_join("review", "|").alias("review"), F.size("lines").alias("n_lines"))


def source_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight sources of each draft."""
    s = hybrid.draft_sources(_drafts(spark), spark.createDataFrame(SOURCES, "search int, url string, official_rank int"))
    return s.select("draft", F.array_join("sources", "|").alias("sources"))


# (url, base, canonical)
URLS = [
    ("HTTP://Example.COM:80/a/../b/./c/?utm_source=x&b=2&a=1#top", None, "http://example.com/b/c?a=1&b=2"),
    ("//cdn.example/x//y", "https://example.com/p/q", "https://cdn.example/x/y"),
    ("../docs/form.pdf?x=%41&y=", "https://example.com/p/q/r", "https://example.com/p/docs/form.pdf?x=A"),
    ("https://example.com:443", None, "https://example.com/"),
    ("?page=2&gclid=1", "https://example.com/list/", "https://example.com/list?page=2"),
]


def url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form of relative and encoded urls."""
    d = spark.createDataFrame([(i, u, b) for i, (u, b, _) in enumerate(URLS)], "id int, u string, b string")
    return d.select("id", urls.canonical_any("u", "b").alias("canonical"))


# (text, records, blocks, internal, details, applications, documents, type)
PAGES = [
    ("Request for proposal: supply of grant software", 1, 1, 0, 0, 0, 0, "tender_procurement"),
    ("Technology station services", 1, 1, 0, 0, 0, 0, "technology_station"),
    ("Technology station with a grant", 1, 1, 0, 0, 0, 0, "funding_programme"),
    ("Mentorship and training", 1, 1, 0, 0, 0, 0, "support_programme"),
    ("Our latest news", 1, 1, 0, 0, 0, 0, "news_article"),
    ("News: eligibility and repayment", 1, 1, 0, 0, 0, 0, "funding_programme"),
    ("Open call for loans", 1, 1, 0, 0, 0, 0, "open_call"),
    ("Our loans", 1, 1, 9, 0, 0, 0, "funding_listing"),
    ("Our loans", 1, 3, 0, 0, 0, 0, "funding_listing"),
    ("Welcome", 1, 1, 0, 0, 1, 0, "funding_programme"),
    ("Welcome", 1, 1, 0, 0, 0, 0, "generic_content"),
    ("", 0, 0, 0, 3, 0, 0, "funding_listing"),
]


def page_type_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global page types by terms and counts."""
    d = spark.createDataFrame([(i, *r[:7]) for i, r in enumerate(PAGES)], "id int, t string, r int, b int, i int, d int, a int, o int")
    return d.select("id", records.global_page_type(*[F.col(c) for c in "trbidao"]).alias("page_type"))


# (texts in, words folded, slug, numbering gone, phrase)
TEXTS = [
    ("  Ünï code\t ﬁne ", "Ünï code fine", "uni-code-fine", "Ünï code ﬁne", False),
    ("1. The Fund", "1. The Fund", "1-the-fund", "The Fund", True),
    ("iv) Loan fund's terms", "iv) Loan fund's terms", "iv-loan-fund-s-terms", "Loan fund's terms", True),
    ("Refunds", "Refunds", "refunds", "Refunds", False),
    ("!!!", "!!!", "unknown", "!!!", False),
]


def text_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folding, slugs, numbering and whole phrases."""
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(TEXTS)], "id int, t string")
    t = F.col("t")
    return d.select("id", text.folded("t").alias("folded"), text.ascii_slug("t").alias("slug"), text.collapse(text.strip_numbering(t)).alias("bare"), text.has_phrase(t, "fund").alias("fund"))


# (url, html)
HTML = [
    ("https://www.growth-fund.org.za/seed-grant", """<html><head><title>1. Seed Grant - National Growth Fund</title><meta name="description" content="Early money"></head><body>
        <nav><a href="/">Home</a></nav><h1>Seed Grant</h1><h2>Eligibility</h2><p>Applicants must be registered firms. Firms are open to all; staff do not qualify.</p>
        <h2>Funding offer</h2><p>A non-repayable grant between R50 000 and R500 000 for young firms.</p>
        <h2>How to apply</h2><p>Mail seed@growth-fund.org.za. Applications close on 5 March 2027.</p><a href="apply?utm_source=x">Apply now</a><a href="/files/Checklist.PDF">Documents</a></body></html>"""),
    ("https://works.example/notices/7", "<title>Notice 7</title><h1>Request for proposal: paving</h1><p>Bid number 7/2026. Compulsory briefing on 3 May 2026.</p>"),
    ("https://bank.example/loans", """<title>Loan products | Bank</title><h2>Bridge Loan</h2><p>Short loans of up to R2 million.</p><h2>Asset Loan - Read more</h2><p>For machines.</p><h2>asset loan</h2><p>For machines and vehicles of all firms.</p>
        <h2>Contact us</h2><p>Write.</p><h2>Stock Loan</h2>"""),
    ("https://paper.example/2026/fair", "<title>The fair</title><form><p>Our latest news story: the fair was announced."),
    ("https://empty.example/", None),
]
PAGE_RECORDS = [
    (0, "funding_programme", "application", "Seed Grant", "National Growth Fund", "Grant", 5e4, 5e5, "ZAR", "FixedDate", "2027-03-05", "National", "Online form", "https://www.growth-fund.org.za/apply", "seed@growth-fund.org.za",
     "Applicants must be registered firms.|Firms are open to all",
     "Mail seed@growth-fund.org.za. Applications close on 5 March 2027. Apply nowDocuments|https://www.growth-fund.org.za/files/Checklist.PDF", None, ""),
    (1, "tender_procurement", "procurement_notice", "Notice 7", "Works", "Unknown", None, None, None, "FixedDate", "2026-05-03", "Unknown", "Unknown", None, None, "", "", "page_type",
     "invalid_funder_name|unconfirmed_page_type"),
    (2, "funding_listing", "listing", "Loan products", "Bank", "Loan", None, 2e6, "ZAR", "Unknown", None, "Unknown", "Unknown", None, None, "", "", None, "invalid_funder_name|unconfirmed_page_type"),
    (3, "news_article", "news_article", "The fair", "Paper", "Unknown", None, None, None, "Unknown", None, "Unknown", "Unknown", None, None, "", "", "page_type", "invalid_funder_name|unconfirmed_page_type"),
    (4, "generic_content", "overview", "", "Empty", "Unknown", None, None, None, "Unknown", None, "Unknown", "Unknown", None, None, "", "", "page_type",
     "invalid_program_name|invalid_funder_name|unconfirmed_page_type"),
]
CANDIDATES = [
    (0, 2, "Funding offer", "A non-repayable grant between R50 000 and R500 000 for young firms.", 0), (1, 0, "Request for proposal: paving", "Bid number 7/2026. Compulsory briefing on 3 May 2026.", 0),
    (2, 0, "Bridge Loan", "Short loans of up to R2 million.", 0), (2, 2, "asset loan", "For machines and vehicles of all firms.", 0),
]


def _html(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *h) for i, h in enumerate(HTML)], "page_id int, url string, html string")


def record_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made records."""
    r = builder.page_records(_html(spark), F.lit("2026-01-10").cast("date"))
    return r.select(
        "id", "page_type", "page_role", "program_name", "funder_name", "funding_type", "ticket_min", "ticket_max", "currency", "deadline_type", F.col("deadline_date").cast("string").alias("deadline"),
        "geography_scope", "application_channel", "application_url", "contact_email", F.array_join("raw_criteria", "|").alias("criteria"), F.array_join("required_documents", "|").alias("documents"),
        "acceptance", F.array_join("doubts", "|").alias("doubts"),
    )


def candidate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing sections as candidates, best per label, and the links that belong to them."""
    d = html.with_links(html.documents(_html(spark)))
    c = html.candidates(d).join(d.select("id", "page_links"), "id")
    return c.select("id", "place", "heading", "content", F.size(html.scoped_links(F.col("heading"), F.col("page_links"))).alias("n_links"))


# (page type, text, file kind, name, chars, decision, confidence)
PREFLIGHT = [
    ("news_article", "grant and loan", "unsupported", "x", 900, "no", 0.95), ("generic_content", "apply for a grant", "unsupported", "x", 9, "no", 0.55), ("funding_programme", "our philosophy", "unsupported", "x", 9, "no", 0.97),
    ("funding_programme", "minutes", "pdf", "minutes.pdf", 9, "no", 0.96), ("funding_programme", "figures", "pdf", "form-report.pdf", 9, "no", 0.94), ("funding_programme", "press release and gallery", "unsupported", "x", 9, "no", 0.93),
    ("funding_programme", "a grant: apply", "unsupported", "x", 9, "yes", 0.9), ("funding_programme", "one loan", "unsupported", "x", 700, "yes", 0.8), ("funding_programme", "one loan", "unsupported", "x", 70, "unclear", 0.55),
]
# (links, page, text, route)
ROUTES = [
    (["https://a.org/form.pdf", "https://a.org/apply", "https://online.b.org/apply"], "https://a.org/p", "", "https://online.b.org/apply"), (["https://a.org/apply"], "https://a.org/apply/", "", "https://a.org/apply"),
    (["https://a.org/guidelines/apply", "https://a.org/x"], "https://a.org/p", "", None), ([], "https://a.org/p", "", None), (["https://a.org/wp-content/uploads/portal"], "https://a.org/", "the application portal", "https://a.org/wp-content/uploads/portal"),
]


def preflights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: what is decided of pages before they are read closely."""
    d = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(PREFLIGHT)], "id int, t string, l string, k string, n string, c int")
    return d.select("id", builder.preflight(*[F.col(x) for x in "tlknc"]).alias("p")).select("id", "p.decision", "p.confidence")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application link of most points."""
    d = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(ROUTES)], "id int, l array<string>, p string, t string")
    return d.select("id", builder.application_route(F.col("l"), F.col("p"), F.col("t")).alias("route"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that belong to a page, and the groups of fields that their texts speak of."""
    d = spark.createDataFrame([
        (1, "https://a.org/seed-grant", "Seed Grant", ["Who qualifies"], ["https://a.org/seed-grant-checklist.pdf", "https://b.org/seed.pdf", "https://a.org/annual.pdf", "https://www.a.org/seed.docx", "https://a.org/seed-fifth.pdf"]),
        (2, "https://a.org/none", "", [], []),
    ], "id int, url string, title string, headings array<string>, document_links array<string>")
    texts = spark.createDataFrame([("https://a.org/seed-grant-checklist.pdf", "Proof of tax\nrequirements"), ("https://www.a.org/seed.docx", "Nothing here"), ("https://a.org/annual.pdf", "loan")], "document string, text string")
    e = builder.document_evidence(builder.linked_documents(d), texts)
    return e.select("id", "place", "group", "line")


def missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed programmes that no record stands for."""
    c = spark.createDataFrame([(1, "Bridge Loan"), (1, "Asset Finance Facility"), (1, "Women Growth Fund"), (2, "Alone"), (3, "One Loan"), (3, "Two Loan")], "id int, heading string")
    f = spark.createDataFrame([(1, "bridge loan "), (1, "Growth fund for women")], "id int, name string")
    return builder.missed_candidates(c, f)


# (label, type)
ALIASES = [("Programme-Listing", "funding_listing"), ("call for applications", "open_call"), ("News/Article", "news_article"), ("press", "generic_content"), (" product page", "funding_programme"), ("mixed", "funding_listing"), (None, "generic_content")]


def alias_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page types by their other names."""
    d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ALIASES)], "id int, a string")
    return d.select("id", classify.page_type(F.col("a")).alias("page_type"))


# (ord, funder, name, parent, url, confidence), (kept ord, first ord)
BEST = [(1, "A", "x", None, "u", 0.5), (2, "a", "X", "", "u", 0.5), (3, "A", "X", "", "u", 0.7), (4, "A", "x", "p", "u", 0.1), (5, None, None, None, None, None)]


def best_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal keys the record of most confidence."""
    d = spark.createDataFrame(BEST, "ord long, funder string, name string, parent string, url string, confidence double")
    return hybrid.best_by_key(d).select("ord", "first_ord")


QUERIES = {
    "c5_render_reasons": render_reasons, "m12_deadline_cases": deadline_cases, "m4_amount_cases": amount_cases, "m5_amount_evidence": evidence_cases,
    "e1_star_clusters": star_cases, "j1_records_to_sites": site_cases, "e9_hybrid_records": hybrid_cases, "h23_draft_records": draft_cases,
    "j13_draft_sources": source_cases, "u1_relative_urls": url_cases, "g9_page_types": page_type_cases, "s1_text_cases": text_cases,
    "g8_type_aliases": alias_cases, "e10_best_by_key": best_cases, "h15_record_cases": record_cases, "h13_candidate_cases": candidate_cases,
    "c20_preflights": preflights, "h19_routes": routes, "h29_linked_documents": linked, "h14_missed_candidates": missed,
}
ORACLE_SQL = {
    "c5_render_reasons": _values("id, reason", [(r[0], r[6]) for r in RENDER]),
    "m12_deadline_cases": _values("id, kind, day, confidence", [(i, *r[1:]) for i, r in enumerate(DEADLINES)]),
    "m4_amount_cases": _values("id, low, high, currency, confidence", [(i, *r[1:]) for i, r in enumerate(AMOUNTS)]),
    "m5_amount_evidence": _values("id, ideal_low, ideal_high, least, most, range_low, range_high, implied", [(i, *r[2:]) for i, r in enumerate(EVIDENCE)]),
    "e1_star_clusters": _values("ord, cluster", [(r[0], r[10]) for r in RECORDS]),
    "j1_records_to_sites": _values("id, site_key", [(r[0], r[3]) for r in SITE_RECORDS]),
    "e9_hybrid_records": _values("ord, url, least, email, lines, confidence, sources, method", HYBRID),
    "h23_draft_records": _values("draft, url, funding_type, ticket_min, ticket_max, sure, review, n_lines", DRAFT_RECORDS),
    "j13_draft_sources": _values("draft, sources", DRAFT_SOURCES),
    "u1_relative_urls": _values("id, canonical", [(i, r[2]) for i, r in enumerate(URLS)]),
    "g9_page_types": _values("id, page_type", [(i, r[7]) for i, r in enumerate(PAGES)]),
    "s1_text_cases": _values("id, folded, slug, bare, fund", [(i, *r[1:]) for i, r in enumerate(TEXTS)]),
    "g8_type_aliases": _values("id, page_type", [(i, r[1]) for i, r in enumerate(ALIASES)]),
    "e10_best_by_key": _values("ord, first_ord", [(3, 1), (4, 4), (5, 5)]),
    "c20_preflights": _values("id, decision, confidence", [(i, *r[5:]) for i, r in enumerate(PREFLIGHT)]),
    "h19_routes": _values("id, route", [(i, r[3]) for i, r in enumerate(ROUTES)]),
    "h29_linked_documents": _values('id, place, "group", line', [(1, 0, g, "[seed-grant-checklist.pdf] Proof of tax requirements") for g in ("eligibility", "documents")]),
    "h14_missed_candidates": _values("id, heading", [(1, "Asset Finance Facility"), (3, "One Loan"), (3, "Two Loan")]),
    "h13_candidate_cases": _values("id, place, heading, content, n_links", CANDIDATES),
    "h15_record_cases": _values("id, page_type, page_role, program_name, funder_name, funding_type, ticket_min, ticket_max, currency, deadline_type, deadline, geography_scope, application_channel, "
                                "application_url, contact_email, criteria, documents, acceptance, doubts", PAGE_RECORDS),
}
