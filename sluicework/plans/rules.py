"""Rule queries over programme rows, urls and templated texts, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language, records
from .views import PROGRAMMES_SQL, programmes, table


def repayment_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months, grace and frequency read from templated wording."""
    k, n = F.col("o_orderkey") % 3, F.col("o_orderkey") % 50 + 2
    say = (
        F.when(k == 0, F.format_string("Repay over %d to %d months, monthly, with a grace period of 6 months.", n, n + 12))
        .when(k == 1, F.format_string("Repayable in up to %d years with quarterly instalments.", n))
        .otherwise(F.lit("Terms on request."))
    )
    d = table(spark, sf_dir, "orders").select("o_orderkey", records.repayment(say).alias("r"))
    return d.select("o_orderkey", "r.low", "r.high", "r.grace", "r.frequency", "r.confidence")


def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent names, context keys and leaf slugs of page urls."""
    u = F.regexp_replace(F.regexp_replace("url", "/(\\d+)", "/seed-fund/stage-$1-eligibility"), "[?#].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", u.alias("u"))
    return p.select("page_id", records.parent_from_path(F.col("u")).alias("parent"), F.array_join(records.path_contexts(F.col("u")), ",").alias("context"), records.leaf_base(F.col("u")).alias("leaf"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of programme rows."""
    score = records.completeness(["program_name", "funder_name", "application_url", "contact_email"], ["provinces", "industries", "notes"])
    return programmes(spark, sf_dir).select("pid", score.alias("completeness"))


def persist_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which programme rows are kept, why not, what a reviewer should see, and acceptance."""
    p = programmes(spark, sf_dir).drop("raw_eligibility").withColumnsRenamed({"has_eligibility": "x"})
    p = p.withColumns({
        "title": F.col("source_title"), "ticket_confidence": F.col("conf_a"),
        "program_name": F.when(F.col("pk") % 37 == 0, "Funding opportunities").when(F.col("pk") % 41 == 0, F.concat(F.lit("Bid no. "), "pk")).otherwise(F.col("program_name")),
        "notes": F.when(F.col("pk") % 43 == 0, F.array(F.lit("Graduate careers"))).when(F.col("pk") % 47 == 0, F.array(F.lit("press release, read more, story"))).otherwise(F.array().cast("array<string>")),
    })
    p = records.accepted(records.review_marks(records.persist_gate(records.gates(p))))
    return p.select("pid", "persist.ok", "persist.reason", F.array_join("review", "|").alias("review"), "acceptance", F.array_join("doubts", "|").alias("doubts"))


FIELDS = (
    {"name": "c_name", "kind": "string", "required": True, "pattern": "^Customer"},
    {"name": "c_mktsegment", "kind": "integer", "required": False},
    {"name": "c_acctbal", "kind": "float", "required": True},
)


def field_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of generic records by a field list."""
    c = table(spark, sf_dir, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 5 == 0, F.upper("c_name")).otherwise(F.col("c_name")))
    return c.select("c_custkey", F.array_join(records.field_errors(FIELDS), "|").alias("errors"))


PATTERNS = ("{} funding programmes", "{} grants", "{} loans", "apply {}")


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts of each funder, hints first, at most four."""
    hints = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("seed"), F.lit("SEED"), F.lit("grants")))
    q = records.query_texts(F.col("s_name"), hints, PATTERNS, 4)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(q).alias("place", "query"))


def business_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years in business, employees, expiry wording."""
    say = F.format_string("At least %d years in business and %d employees%s.", F.col("p_size"), F.col("p_size") * 3, F.when(F.col("p_size") % 4 == 0, F.lit(", now closed")).otherwise(F.lit("")))
    p = table(spark, sf_dir, "part").select("p_partkey", say.alias("t"))
    return p.select(
        "p_partkey", records.years_in_business(F.col("t")).alias("years"), records.employees(F.col("t")).alias("staff"),
        records.looks_expired(F.col("t"), F.lit(None).cast("date"), F.current_date()).alias("expired"),
    )


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest languages of each document by common words, letters and scripts."""
    d = language.languages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.transform("languages", lambda x: x["lang"]), "|")
    return d.select("doc_id", names.alias("langs"), (F.round(F.element_at("languages", -1)["score"] * 1000) / 1000).alias("last_score"), language.multilingual(F.col("languages")).alias("several"))


def _languages_sql() -> str:
    low = "lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))"
    scores = []
    for lang, words in language.COMMON_WORDS.items():
        listed = ", ".join(f"'{w}'" for w in words)
        letters = language.LETTERS[lang]
        share = f"(length(low) - length(regexp_replace(low, '[{letters}]', '', 'g'))) / greatest(length(low), 1)::DOUBLE * 5" if letters else "0"
        extra = f"CASE WHEN regexp_matches(low, '[{'-'.join(language.SCRIPTS[lang])}]') THEN 10 ELSE 0 END" if lang in language.SCRIPTS else "0"
        scores.append(f"{{'s': len(list_filter(words, lambda w: w IN ({listed}))) / n * 10 + {share} + {extra}, 'i': {-len(scores)}, 'l': '{lang}'}}")
    return f"""WITH t AS (SELECT doc_id, text, {low} AS low FROM documents),
        w AS (SELECT *, regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}_]+') AS words, greatest(len(string_split(low, ' ')), 1)::DOUBLE AS n FROM t),
        r AS (SELECT doc_id, low, list_reverse_sort(list_filter([{', '.join(scores)}], lambda x: x.s > 0)) AS r FROM w),
        p AS (SELECT doc_id, CASE WHEN length(low) < 10 OR len(r) = 0 THEN [{{'s': 0.5, 'l': 'en'}}] ELSE list_transform(r[1:3], lambda x: {{'s': round(x.s / r[1].s, 4), 'l': x.l}}) END AS p FROM r)
        SELECT doc_id, array_to_string(list_transform(p, lambda x: x.l), '|') AS langs, round(p[-1].s, 3) AS last_score, coalesce(p[2].s >= 0.3, false) AS several FROM p"""


def united_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered unions, intersection and difference of lists."""
    a = F.array(F.upper("p_brand"), "p_type", F.lit("x"))
    b = F.array("p_brand", F.lit("y"), F.lit("X"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(records.united(a, b), "|").alias("both"), F.arrays_overlap(a, b).alias("meet"), F.array_join(F.array_except(b, a), "|").alias("rest")
    )


def _counted(terms):
    return lambda c: "(" + " + ".join(f"CAST(contains({c}, '{t}') AS INT)" for t in terms) + ")"


_SQL_FUNDABLE, _SQL_NOT_FUNDING, _SQL_RISKY = _counted(records.FUNDABLE), _counted(records.NOT_FUNDING), _counted((*records.PROCUREMENT, *records.NEWS))

QUERIES = {
    "m11_repayment_terms": repayment_terms,
    "s24_url_names": url_names,
    "s12_completeness": completeness,
    "c6_persist_gate": persist_gate,
    "n11_field_errors": field_errors,
    "a19_search_texts": search_texts,
    "m10_business_numbers": business_numbers,
    "g15_languages": languages,
    "n1_united_lists": united_lists,
}

_PATH = "string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/([0-9]+)', '/seed-fund/stage-\\1-eligibility'), '/')"
_PARTS = f"list_filter({_PATH}, lambda s: s <> '')"
_GATED = f"""WITH {PROGRAMMES_SQL}, g AS (SELECT *, CASE WHEN pk % 37 = 0 THEN 'Funding opportunities' WHEN pk % 41 = 0 THEN 'Bid no. ' || CAST(pk AS VARCHAR) ELSE program_name END AS nm,
      CASE WHEN pk % 43 = 0 THEN 'graduate careers' WHEN pk % 47 = 0 THEN 'press release, read more, story' ELSE '' END AS nt FROM programmes),
    h AS (SELECT *, lower(concat_ws(' ', nm, funder_name, source_url, source_title, page_type, funding_type, nt)) AS rec,
      lower(concat_ws(' ', nm, CASE WHEN has_documents THEN 'guidelines.pdf' END)) AS ev FROM g),
    k AS (SELECT *, funding_type <> 'Unknown' OR coalesce(ticket_min, ticket_max, budget_total) IS NOT NULL OR {_SQL_FUNDABLE('ev')} > 0 AS fundable,
      {_SQL_NOT_FUNDING('rec')} > 0 AS nonf, trim(coalesce(nm, '')) = '' OR lower(nm) = 'funding opportunities' OR lower(nm) = lower(coalesce(funder_name, '')) AS gen FROM h),
    m AS (SELECT *, fundable OR application_url IS NOT NULL OR application_channel <> 'Unknown' AS core FROM k)"""
_REASON = """CASE WHEN nonf AND NOT fundable THEN 'record looks like non-funding programme content'
    WHEN gen AND NOT core THEN 'record looks like a generic institutional or listing page without core funding evidence'
    WHEN page_type = 'funding_listing' AND funding_type = 'Unknown' AND NOT core THEN 'funding listing lacks concrete funding evidence'
    WHEN page_type IN ('funding_programme', 'funding_listing') OR (page_type = 'open_call' AND fundable) THEN NULL
    ELSE 'page_type ' || page_type || ' is not persistable funding programme content' END"""
_TENDER = "(regexp_matches(lower(coalesce(nm, '')), '\\b(bid|tender|rfp|rfq)[\\s#:.-]*[0-9]') OR " + " OR ".join(f"contains(lower(coalesce(nm, '')), '{t}')" for t in records.TENDER_TITLES) + ")"
ORACLE_SQL = {
    "m11_repayment_terms": """WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS k, o_orderkey % 50 + 2 AS n FROM orders)
        SELECT o_orderkey, CASE k WHEN 0 THEN n END::INT AS low, CASE k WHEN 0 THEN n + 12 WHEN 1 THEN n * 12 END::INT AS high, CASE k WHEN 0 THEN 6 END::INT AS grace,
          CASE k WHEN 0 THEN 'Monthly' WHEN 1 THEN 'Quarterly' ELSE 'Unknown' END AS frequency, CASE k WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 ELSE 0.25 END::DOUBLE AS confidence FROM o""",
    "s24_url_names": f"""WITH p AS (SELECT page_id, {_PARTS} AS parts FROM pages)
        SELECT page_id, 'Seed Fund' AS parent, CASE WHEN len(parts) >= 3 THEN parts[-2] ELSE '' END AS context, regexp_replace(parts[-1], '-eligibility$', '') AS leaf FROM p""",
    "s12_completeness": f"""WITH {PROGRAMMES_SQL} SELECT pid, 2 * (CAST(coalesce(program_name, '') <> '' AS INT) + CAST(funder_name IS NOT NULL AS INT) + CAST(application_url IS NOT NULL AS INT)
        + CAST(contact_email IS NOT NULL AS INT) + CAST(province IS NOT NULL AS INT) + CAST(industry IS NOT NULL AS INT) + CAST(note <> '' AS INT)) AS completeness FROM programmes""",
    "c6_persist_gate": f"""{_GATED} SELECT pid, ({_REASON}) IS NULL AS ok, {_REASON} AS reason,
        concat_ws('|', CASE WHEN funding_type = 'Unknown' THEN 'funding_type is Unknown' END, CASE WHEN gen THEN 'programme_name is generic or institution-level' END,
          CASE WHEN nonf THEN 'source page resembles careers/procurement/non-funding content' END,
          CASE WHEN coalesce(ticket_min, ticket_max) IS NOT NULL AND conf_a < 0.7 THEN 'amount evidence is weak' END,
          CASE WHEN page_type IN ('funding_listing', 'news_article', 'tender_procurement') THEN 'page_type ' || page_type || ' requires review' END,
          CASE WHEN {_TENDER} THEN 'programme_name looks like a tender title' END,
          CASE WHEN {_SQL_RISKY('rec')} >= 3 AND {_SQL_RISKY('rec')} >= {_SQL_FUNDABLE('rec')} THEN 'source page contains mostly article/news/procurement wording' END) AS review,
        CASE WHEN page_type IN ('tender_procurement', 'news_article') THEN 'page_type' WHEN page_type = 'funding_listing' AND funding_type = 'Unknown' THEN 'listing_unknown_funding_type' END AS acceptance,
        concat_ws('|', CASE WHEN length(trim(coalesce(nm, ''))) < 4 OR lower(nm) = 'funding opportunities' OR {_TENDER} THEN 'invalid_program_name' END,
          CASE WHEN NOT contains(trim(coalesce(funder_name, '')), ' ') THEN 'invalid_funder_name' END, CASE WHEN page_type <> 'funding_programme' THEN 'unconfirmed_page_type' END) AS doubts FROM m""",
    "n11_field_errors": """SELECT c_custkey, concat_ws('|', CASE WHEN c_custkey % 7 = 0 THEN 'c_name: missing' END, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 = 0 THEN 'c_name: unlike its pattern' END,
        'c_mktsegment: not a number') AS errors FROM customer""",
    "a19_search_texts": """WITH q AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN [s_name || ' seed', s_name || ' grants', s_name || ' funding programmes', s_name || ' loans']
          ELSE [s_name || ' funding programmes', s_name || ' grants', s_name || ' loans', 'apply ' || s_name] END AS q FROM supplier)
        SELECT s_suppkey, unnest(range(4))::INT AS place, unnest(q) AS query FROM q""",
    "g15_languages": _languages_sql(),
    "m10_business_numbers": "SELECT p_partkey, p_size AS years, p_size * 3 AS staff, p_size % 4 = 0 AS expired FROM part",
    "n1_united_lists": """SELECT p_partkey, concat_ws('|', upper(p_brand), p_type, 'x', 'y') AS both, false AS meet, concat_ws('|', p_brand, 'y', 'X') AS rest FROM part""",
}
