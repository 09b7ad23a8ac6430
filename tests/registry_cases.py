"""Hand-made cases of taxonomies, registry, users, evidence and views, and what they must give, as literal tables in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.functions import taxonomy
from sluicework.operators import registry
from cases import _values

# (text, scope, provinces, towns, postal codes)
PLACES = [
    ("Nationwide scheme of Gauteng", "National", "Gauteng", "", ""),
    ("For firms in Tshwane, Gauteng 0001 - 0299 and 2001", "Municipality", "Gauteng", "Tshwane", "0001-0299|2001"),
    ("KwaZulu Natal and kwazulu-natal, code 4001", "Province", "KwaZulu-Natal", "", ""),
    ("Regional funds across Africa", "International", "", "", ""),
    ("Township shops", "Local", "", "", ""),
    (None, "Unknown", "", "", ""),
]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope, provinces, municipalities and postal ranges."""
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(PLACES)], "id int, t string").select("id", taxonomy.geography(F.col("t"), ("Tshwane", "Cape Town")).alias("g"))
    return d.select("id", "g.scope", *[F.array_join(f"g.{c}", "|").alias(c) for c in ("provinces", "municipalities", "postal_codes")])


TERMS = [
    ("industry", 0, "Farming", "Land", 0, "farm", 0.6, 0.1, 0.95), ("industry", 0, "Farming", "Land", 1, "crop", 0.6, 0.1, 0.95), ("industry", 1, "Mining", None, 0, "mine", 0.6, 0.1, 0.95),
    ("use", 0, "Stock", None, 0, "stock", 0.6, 0.08, 0.9), *(("certificate", 0, "Tax", None, i, t, 0.75, 0.05, 0.95) for i, t in enumerate(("tax", "clearance", "vat", "sars", "pin"))),
]
TEXTS = [(1, "Farms with CROPS and livestock."), (2, "Tax clearance, VAT, SARS PIN."), (3, "Nothing"), (4, None)]


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "taxonomy string, ord int, category string, parent string, term_ord int, term string, base double, step double, cap double")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of pluggable taxonomies, as substrings, with confidence."""
    c = taxonomy.classified(spark.createDataFrame(TEXTS, "id int, text string"), _terms(spark))
    return c.select("id", "taxonomy", "category", "parent", "confidence", F.array_join("terms", "|").alias("terms"))


def known_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether names are categories."""
    return taxonomy.valid_category(_terms(spark), spark.createDataFrame([("farming",), ("Fishing",), (None,)], "value string"), "industry")


# (domain, key, name)
DOMAINS = [("https://www.TheFund.org/x", "fund", "Thefund"), ("idc.co.za", "idc", "IDC"), ("growth-fund.org", "growth-fund", "Growth Fund"), ("the.example", "the", "THE"), ("", "", ""), (None, "", "")]


def domain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and names of sites by their domains."""
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(DOMAINS)], "id int, d string")
    return d.select("id", taxonomy.domain_key(F.col("d")).alias("key"), taxonomy.domain_name(F.col("d")).alias("name"))


# (text, percentages, thresholds)
SHARES = [
    ("Minimum of 51% black ownership; 30 % women in 51% of firms.", "51%|30 %", "Minimum of 51% black ownership|51% black|30 % women"),
    ("At least 26% shareholding.", "26%", "At least 26% shareholding"),
    ("None.", "", ""),
]


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages and shares of owners."""
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(SHARES)], "id int, t string")
    return d.select("id", F.array_join(taxonomy.percentages(F.col("t")), "|").alias("percentages"), F.array_join(taxonomy.ownership_thresholds(F.col("t")), "|").alias("thresholds"))


# (values, items, badges)
LISTS = [
    (["One. Two! one.", None, "Three\nTwo!"], "One.|Two!|Three", "One. Two! one.|Three\nTwo!"),
    (["Youth-led", "BLACK women", "youth led", "Other"], "Youth-led|BLACK women|youth led|Other", "Youth-owned eligible|Women-owned eligible|Other"),
    (None, "", ""),
]


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of sections, and badges of ownership targets."""
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(LISTS)], "id int, v array<string>")
    return d.select("id", F.array_join(taxonomy.section_items(F.col("v")), "|").alias("items"), F.array_join(taxonomy.badges(F.col("v")), "|").alias("badges"))


# (kind, sections, panels, headings, body, structure, role in, role out)
STRUCTURES = [
    ("pdf", 5, 0, ["Fund"], "", "document", "Programme Detail", "overview"), ("html", 1, 0, [], "Apply at the portal", "application_form", "criteria", "eligibility"),
    ("html", 3, 0, ["Our products"], "Apply for a loan", "parent_page", "NEWS", "news_article"), ("html", 1, 2, ["Steps"], "x", "multi_program_page", "x", "generic"),
    ("html", 1, 0, [], "A grant", "single_program_page", None, "generic"), ("html", 0, 0, [], "Hello", "generic_page", "about/contact", "about_contact"),
]


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How pages are built, and roles by their other names."""
    d = spark.createDataFrame([(i, *r[:5], r[6]) for i, r in enumerate(STRUCTURES)], "id int, k string, s int, p int, h array<string>, b string, r string")
    return d.select("id", taxonomy.structure(*[F.col(c) for c in "ksphb"]).alias("structure"), taxonomy.page_role(F.col("r")).alias("role"))


# (text, low, high)
TURNOVERS = [("Loans of R9m. Annual turnover between R1m and R5m. Revenue up to R7m.", 1e6, 5e6), ("Sales matter. Turnover of at least R2 million.", None, 2e6), ("Loans of R9m.", None, None)]


def turnovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: turnover ranges from the first sentence about turnover that has an amount."""
    d = taxonomy.turnover_range(spark.createDataFrame([(i, r[0]) for i, r in enumerate(TURNOVERS)], "id int, t string"), "t")
    return d.select("id", "turnover.low", "turnover.high")


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array of sites over the registry; active ones by name."""
    old = spark.createDataFrame([("a", "Old A", "a.org", None, ["u"], None, False, True, ["kept"], 0), ("c", "C", "c.org", None, [], None, False, True, None, 0)], registry.SITE + ", seq long")
    body = '[{"site_key":"a","display_name":"New A","active":true,"seed_urls":["x","y"],"seq":1},{"site_key":"b","display_name":"B","active":false,"seq":2},{"site_key":"a","display_name":"Newest A","active":true,"seq":3}]'
    payloads = spark.createDataFrame([(body,), ('{"no":"array"}',)], "body string")
    new = registry.recordset(payloads, "body", registry.SITE + ", seq long").drop("place")
    sites = registry.registered(old, new, "seq")
    return registry.active_sites(sites).select("site_key", "display_name", F.coalesce(F.array_join("seed_urls", "|"), F.lit("")).alias("seeds"), F.lit(registry.rejected(payloads, "body").count()).alias("rejects"))


def user_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups over users; which rows are of admins."""
    old = spark.createDataFrame([("u1", "a@x", "A", "admin", 0)], "id string, email string, full_name string, role string, seq long")
    meta = [("u1", "new@x", '{"role":"applicant","name":"Ann"}', 1), ("u2", "bob@y", '{"role":"ADMIN"}', 1), ("u3", None, None, 1), ("u4", "c@z", '{"full_name":"Cy","name":"no"}', 1)]
    users = registry.signed_up(old, spark.createDataFrame(meta, "id string, email string, meta string, at long"), "at")
    admin = registry.of_admins(users.select(F.col("id").alias("user_id")), users).withColumn("admin", F.lit(True))
    return users.join(admin, F.col("id") == F.col("user_id"), "left").select("id", "email", "full_name", "role", F.coalesce("admin", F.lit(False)).alias("admin"))


EVIDENCE = [
    (1, "name", "llm_only_inference", 0.9, "Weak"), (1, "name", "regex_from_prose", 0.5, "Strong"), (1, "tags", "parent_page_inheritance", 0.7, "B"), (1, "tags", "parent_page_inheritance", 0.2, "a"), (2, "amount", "unknown way", 0.3, "5"),
]


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of fields by their best evidence, and records with what evidence adds."""
    e = spark.createDataFrame(EVIDENCE, "program_id int, field string, method string, confidence double, value string")
    records = spark.createDataFrame([(1, "", ["A"], {"tags": 0.9}), (2, "Kept", None, None), (3, "Alone", [], {})], "program_id int, name string, tags array<string>, confidence map<string,double>")
    folded = registry.folded_evidence(records, e, ["name"], ["tags"])
    best = registry.field_confidence(e).withColumnRenamed("confidence", "best")
    out = folded.join(best, "program_id", "left")
    return out.select("program_id", "name", F.array_join("tags", "|").alias("tags"), F.array_join(registry.by_confidence(F.col("confidence")), "|").alias("surest"), F.coalesce(F.to_json("best"), F.lit("")).alias("best"))


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as the catalogue shows them."""
    cols = "program_id int, funder_name string, source_domain string, source_url string, title string, provinces array<string>, municipalities array<string>, geography_scope string, funding_type string, deadline_type string, deadline_date date, confidence map<string,double>, approval_status string"
    rows = [
        (1, " Fund ", "d", "u", " T ", ["P"], ["P", "M"], "Province", "Loan", "Open", None, {"a": 0.2, "b": 0.6}, "approved"),
        (2, "", "d.org", "", None, None, None, "", "Bursary", "FixedDate", None, None, None),
        (3, None, None, None, None, [], [], "National", None, "Rolling", None, {}, "pending"),
    ]
    v = registry.catalogue_view(spark.createDataFrame(rows, cols), F.lit("2026-01-01").cast("date"))
    return v.withColumn("geography", F.array_join("geography", "|"))


QUERIES = {
    "g3_places": places, "g13_categories": categories, "g14_known_categories": known_categories, "s28_domain_names": domain_names, "s20_shares": shares, "s19_list_items": list_items,
    "g12_structures": structures, "m8_turnovers": turnovers, "b15_registry_upsert": registry_upsert, "b18_user_upsert": user_upsert,  "k10_evidence": evidence,  "c17_view": view, 
}
ORACLE_SQL = {
    "g3_places": _values("id, scope, provinces, municipalities, postal_codes", [(i, *r[1:]) for i, r in enumerate(PLACES)]),
    "g13_categories": _values("id, taxonomy, category, parent, confidence, terms", [(1, "industry", "Farming", "Land", 0.8, "farm|crop"), (1, "use", "Stock", None, 0.68, "stock"), (2, "certificate", "Tax", None, 0.95, "tax|clearance|vat|sars|pin")]),
    "g14_known_categories": _values("value, known", [("farming", True), ("Fishing", False), (None, False)]),
    "s28_domain_names": _values("id, key, name", [(i, *r[1:]) for i, r in enumerate(DOMAINS)]),
    "s20_shares": _values("id, percentages, thresholds", [(i, *r[1:]) for i, r in enumerate(SHARES)]),
    "s19_list_items": _values("id, items, badges", [(i, *r[1:]) for i, r in enumerate(LISTS)]),
    "g12_structures": _values("id, structure, role", [(i, r[5], r[7]) for i, r in enumerate(STRUCTURES)]),
    "m8_turnovers": _values("id, low, high", [(i, *r[1:]) for i, r in enumerate(TURNOVERS)]),
    "b15_registry_upsert": _values("site_key, display_name, seeds, rejects", [("a", "Newest A", "", 1), ("c", "C", "", 1)]),
    "b18_user_upsert": _values("id, email, full_name, role, admin", [("u1", "new@x", "Ann", "admin", True), ("u2", "bob@y", "bob", "admin", True), ("u3", "", "", "applicant", False), ("u4", "c@z", "Cy", "applicant", False)]),
    "k10_evidence": _values("program_id, name, tags, surest, best", [(1, "Weak", "A|B", "name|tags", '{"name":0.5,"tags":0.7}'), (2, "Kept", "", "amount", '{"amount":0.3}'), (3, "Alone", "", "", "")]),
    "c17_view": _values("program_id, provider, source_url, source_name, geography, funding_type, status, scrape_confidence, approval_status", [
        (1, "Fund", "u", "T", "P|M|Province", "loan", "active", 0.4, "approved"), (2, "d.org", "#", "d.org", "Unknown", "unknown", "draft", 0.5, "pending"),
        (3, "Unknown provider", "#", "Unknown provider", "National", "unknown", "active", 0.0, "pending")]),
}
