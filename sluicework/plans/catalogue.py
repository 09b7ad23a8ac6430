"""Catalogue queries over programme-shaped rows, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records, urls
from ..functions.numbers import mean_of, ordered, status, view_status
from ..operators import catalog, matching, quality
from .views import AS_OF, PROGRAMMES_SQL, kept, programmes, table


def day() -> Column:
    """The day that stands for now."""
    return F.lit(AS_OF).cast("date")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.catalogue_score(quality.route(quality.score(programmes(spark, sf_dir), day())), day())


_NAME = "(program_name IS NOT NULL AND trim(program_name) <> '')"
_FUNDER = "(funder_name IS NOT NULL AND trim(funder_name) <> '')"
_CONTACT = "(application_url IS NOT NULL OR contact_email IS NOT NULL)"
_GEO = "(province IS NOT NULL OR geography_scope <> 'Unknown')"
_AMOUNT = "(ticket_min IS NOT NULL OR ticket_max IS NOT NULL)"
_PAST = f"(deadline_type NOT IN ('Open', 'Rolling') AND deadline_date IS NOT NULL AND deadline_date < DATE '{AS_OF}')"
_FUTURE = f"(deadline_type NOT IN ('Open', 'Rolling') AND deadline_date IS NOT NULL AND deadline_date >= DATE '{AS_OF}')"
_ARTICLE = "(source_url LIKE '%/news/%')"
_ENDED = "(note LIKE 'Archived%')"
_BLOCKERS = [
    (_ARTICLE, "Article or publication page"),
    ("page_type IN ('news_article', 'tender_procurement')", "Non-programme page type"),
    (f"NOT {_NAME}", "Missing programme name"),
    (f"NOT {_FUNDER}", "Missing funder name"),
    ("funding_type = 'Unknown'", "Unknown funding type"),
    (_PAST, "Expired fixed deadline"),
    (_ENDED, "Archived or closed programme"),
    ("conf < 0.25", "Very low extraction confidence"),
    ("has_conflicts", "Conflicting field values"),
]


def _points(rules: list[tuple[str, int]]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in rules)


_FEW = f"NOT {_NAME} AND NOT {_FUNDER} AND application_channel = 'Unknown' AND NOT {_CONTACT} AND NOT has_eligibility AND industry IS NULL AND use_of_funds IS NULL"
_QUALITY = _points(
    [
        (_ARTICLE, -10), ("page_type IN ('news_article', 'tender_procurement')", -25), (_NAME, 18), (_FUNDER, 14), ("funding_type <> 'Unknown'", 10),
        (_AMOUNT, 10), ("application_channel <> 'Unknown'", 10), (f"application_channel = 'Unknown' AND {_CONTACT}", 8),
        (f"application_channel = 'Unknown' AND NOT {_CONTACT}", -4), ("has_eligibility", 10), ("industry IS NOT NULL OR use_of_funds IS NOT NULL", 8),
        ("has_ownership", 5), (_GEO, 4), ("has_documents", 3), ("deadline_type IN ('Open', 'Rolling')", 8), (_PAST, -18), (_FUTURE, 5), (_ENDED, -20),
        ("conf < 0.25", -10), ("conf >= 0.6", 4), (_FEW, -10), ("has_conflicts", -12),
    ]
)
_FUTURE_OPEN = f"(deadline_type IN ('Open', 'Rolling') OR coalesce(deadline_date >= DATE '{AS_OF}', false))"
_EXPIRED = f"(NOT {_FUTURE_OPEN} AND coalesce(deadline_date < DATE '{AS_OF}', false))"
_MOSTLY_EMPTY = f"(CAST({_NAME} AS INT) + CAST({_FUNDER} AS INT) + 1 + CAST({_AMOUNT} AS INT) + CAST(industry IS NOT NULL AS INT) + CAST(use_of_funds IS NOT NULL AS INT) + 2 <= 3)"
# (condition, points if it holds, points if not, reason, blocker)
_VIEW_RULES = [
    (_NAME, 12, -15, "Has programme name", "Missing programme name"), (_FUNDER, 10, -10, "Has funder name", "Missing funder name"),
    ("funding_type <> 'Unknown'", 8, -8, "Known funding type", "Unknown funding type"), (_AMOUNT, 8, -4, "Funding range available", None),
    ("industry IS NOT NULL", 8, 0, "Industry information captured", None), ("use_of_funds IS NOT NULL", 6, 0, "Use of funds captured", None),
    ("has_ownership", 5, 0, "Ownership targets captured", None), ("(has_eligibility OR stage IS NOT NULL)", 8, 0, "Eligibility details captured", None),
    ("application_channel <> 'Unknown'", 8, -10, "Application route available", "Missing application route"), ("true", 8, -8, "Contact or apply link available", "Missing application contact"),
    (_FUTURE_OPEN, 10, 0, "Open or active deadline", None), (_GEO, 5, 0, "Geography captured", None), ("has_documents", 4, 0, "Supporting documents linked", None),
]
_VIEW = " + ".join(f"CASE WHEN {c} THEN {y} ELSE {n} END" for c, y, n, _, _ in _VIEW_RULES) + f" + CASE WHEN {_EXPIRED} THEN -15 ELSE 0 END + CASE WHEN {_MOSTLY_EMPTY} THEN -12 ELSE 0 END"
_VIEW_REASONS = "[" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, _, _, r, _ in _VIEW_RULES) + "]"
_VIEW_BLOCKERS = "[" + ", ".join([f"CASE WHEN NOT {c} THEN '{b}' END" for c, _, _, _, b in _VIEW_RULES if b] + [f"CASE WHEN {_EXPIRED} THEN 'Expired deadline' END", f"CASE WHEN {_MOSTLY_EMPTY} THEN 'Mostly incomplete record' END"]) + "]"
_BLOCKED = "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{b}' END" for c, b in _BLOCKERS) + ")"
SCORED_SQL = f"""{PROGRAMMES_SQL},
confident AS (SELECT *, round((conf_a + conf_b) / 2, 4) AS conf FROM programmes),
rated AS (SELECT *, greatest(0, least(100, {_QUALITY} - least(10, n_reviews * 2)))::INT AS quality,
    greatest(0, least(100, {_VIEW}))::INT AS view_quality, {_VIEW_REASONS} AS view_reasons, {_VIEW_BLOCKERS} AS view_blockers, {_BLOCKED} AS blocked FROM confident),
scored AS (SELECT *, CASE WHEN quality >= 35 AND {_NAME} AND {_FUNDER} THEN 'accept'
    WHEN quality >= 20 AND ({_ARTICLE} OR quality < 35) THEN 'review' ELSE 'reject' END AS route FROM rated)
"""


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality, route and low-confidence flag of every programme."""
    found = _scored(spark, sf_dir)
    return found.select(
        "pid", "quality", F.array_join("blockers", "|").alias("blocked"), "route", (F.col("overall_confidence") < 0.45).alias("low_confidence")
    )


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: how many programmes take each route, and what they lack."""
    found = _scored(spark, sf_dir)
    lacks = lambda b: F.count_if(F.array_contains("blockers", b))
    return found.groupBy("route").agg(
        F.count(F.lit(1)).alias("n"),
        lacks("Missing programme name").alias("no_name"),
        lacks("Missing funder name").alias("no_funder"),
        lacks("Unknown funding type").alias("no_type"),
        F.count_if(F.col("overall_confidence") < 0.45).alias("low_confidence"),
    )


def record_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered amounts, status, shown status and mean confidence."""
    p = programmes(spark, sf_dir)
    low, high = ordered(F.col("ticket_min"), F.col("ticket_max"))
    return p.select(
        "pid",
        low.alias("low"),
        high.alias("high"),
        status(F.col("notes"), F.col("deadline_type"), F.col("deadline_date"), day()).alias("status"),
        view_status(F.col("deadline_type"), F.col("deadline_date"), day()).alias("view_status"),
        mean_of(F.col("confidence")).alias("confidence"),
    )


def best_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best record of each page by the seven ranks, and how many it had."""
    found = _scored(spark, sf_dir)
    signals = ["ticket_min", "ticket_max", "budget_total", "application_url", "contact_email", "contact_phone"]
    name = F.trim(F.coalesce("program_name", F.lit("")))
    slim = found.select(
        urls.canonical(F.col("source_url")).alias("page"), "pid", "quality", F.col("ai_enriched").cast("int").alias("ai"), F.floor(F.col("overall_confidence") * 100).cast("int").alias("conf100"),
        sum((F.col(c).isNotNull().cast("int") for c in signals), F.lit(0)).alias("signals"), F.size("blockers").alias("n_blockers"),
        F.when(records.is_support_title(name) | name.endswith(":"), 0).otherwise(1).alias("plain"), F.when(F.size(F.split(name, " ")) >= 10, 0).otherwise(1).alias("short"),
    )
    order = F.struct("quality", "ai", "conf100", "signals", -F.col("n_blockers"), "plain", "short", -F.col("pid"))
    best = slim.groupBy("page").agg(F.max_by(F.struct("pid", "quality", "ai", "conf100", "signals", "n_blockers"), order).alias("b"), F.count(F.lit(1)).alias("n_rows"))
    return best.select("page", "b.*", "n_rows")


def published_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of accepted, approved programmes the best of each page, all of them ranked."""
    found = catalog.published(_scored(spark, sf_dir).filter("route = 'accept'")).withColumn("conf100", F.floor(F.col("overall_confidence") * 100).cast("int"))
    slim = found.select("source_url", "pid", F.col("program_name").alias("title"), "quality", "view_quality", "conf100")
    best = catalog.best_by(slim, ["source_url"], [F.desc("quality"), F.desc("conf100"), "pid"])
    order = [F.desc("view_quality"), F.desc("quality"), F.col("title"), F.col("pid")]
    return matching.ranked(best, order, kept).select("place", "pid", "title", "view_quality", "quality", quality.band(F.col("view_quality")).alias("band"))


def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved programmes of high or good score whose text holds a word."""
    found = catalog.published(_scored(spark, sf_dir))
    text = F.lower(F.concat_ws(" ", "program_name", "funder_name", "industry", "use_of_funds"))
    hit = text.contains("brand#1") & ((F.col("view_quality") >= 70) | (quality.band(F.col("view_quality")) == "high"))
    return found.filter(hit).select("pid", "program_name", "view_quality")


# Answers of the profile form, by market segment, and amounts by band of the balance: the options that make kinds of profiles.
_FORM = {
    "BUILDING": (["Brand#1", "brand 3"], "idea", ["Women"], [], 3, 12, ["Loan"]),
    "AUTOMOBILE": (["Brand#2"], "early", [], ["polished"], 8, 40, ["Grant", "Equity"]),
    "MACHINERY": (["Brand#4", "brass", "BRASS"], "growth", ["women-owned"], ["steel"], None, 25, []),
    "HOUSEHOLD": ([], "established", ["youth"], [], 12, None, ["hybrid"]),
    "FURNITURE": (["Brand#5", " "], "new", [], ["copper", "tin"], 5, 9, ["Guarantee", "loan"]),
}


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "segment string, sectors array<string>, stage string, ownership_targets array<string>, use_of_funds array<string>, years_operating int, employees int, preferred_types array<string>"
    answers = F.broadcast(spark.createDataFrame([(k, *v) for k, v in _FORM.items()], form))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    level = F.floor(F.col("c_acctbal") / 4000).cast("int")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(answers, F.col("c_mktsegment") == F.col("segment")).withColumn("level", level)
    return rows.select(
        F.col("c_custkey").alias("user_id"), F.lit("South Africa").alias("country"), F.col("n_name").alias("province"), F.lit(None).cast("string").alias("municipality"),
        "sectors", "stage", "ownership_targets", "use_of_funds", "preferred_types", "years_operating", "employees",
        F.when(F.col("level") >= 0, F.col("level") * 12000).alias("requested_min"), F.when(F.col("level") != 1, (F.col("level") + 1) * 12000 + 8000).alias("requested_max"),
        F.when(F.col("level") != 2, F.col("level") * 20000 + 5000).alias("turnover_min"), (F.col("level") * 20000 + 25000).alias("turnover_max"),
    )


def _form_sql() -> str:
    lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    none = lambda x: "NULL" if x is None else str(x)
    return "VALUES " + ", ".join(f"('{k}', {lists(v[0])}, '{v[1]}', {lists(v[2])}, {lists(v[3])}, {none(v[4])}, {none(v[5])}, {lists(v[6])})" for k, v in _FORM.items())


_N = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"
_ANY = lambda hay, needles: f"coalesce(list_bool_or(list_transform(list_filter({needles}, lambda n: {_N('n')} <> ''), lambda n: {' OR '.join(f'contains({_N(h)}, {_N(chr(110))})' for h in hay)})), false)"
_STAGE_LISTS = "CASE stage_asked " + " ".join(f"WHEN '{k}' THEN [" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in matching.STAGE_WORDS.items()) + " ELSE [" + ", ".join(f"'{w}'" for w in matching.STAGE_WORDS["early"]) + "] END"
PROFILES_SQL = f"""form(segment, sectors, stage_asked, owned_asked, use_asked, years, staff, types) AS ({_form_sql()}),
profiles AS (SELECT c_custkey AS user_id, n_name AS own_place, form.*, floor(c_acctbal / 4000)::INT AS lv FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN form ON segment = c_mktsegment),
kinds AS (SELECT DISTINCT own_place, segment, lv, sectors, {_STAGE_LISTS} AS stage_words, owned_asked, use_asked, years, staff, types,
    CASE WHEN lv >= 0 THEN lv * 12000 END AS f_min, CASE WHEN lv <> 1 THEN (lv + 1) * 12000 + 8000 END AS f_max,
    CASE WHEN lv <> 2 THEN lv * 20000 + 5000 END AS t_min, lv * 20000 + 25000 AS t_max FROM profiles)"""
_WANTS = "(coalesce(f_min, 0) <> 0 OR coalesce(f_max, 0) <> 0)"
_OVERLAP = "coalesce(coalesce(ticket_min, ticket_max) <= coalesce(f_max, f_min) AND coalesce(f_min, f_max) <= coalesce(ticket_max, ticket_min), false)"
_ELIGIBLE = "CASE WHEN has_eligibility THEN 'must be registered' END"
# (reason, condition, points, blocker, condition of the blocker, points): the match rules
_MATCH_RULES = [
    ("Strong industry match", "ind", 28, "No clear industry match", "NOT ind AND len(sectors) > 0", -10),
    ("Geography match", "geo", 20, "Geography may be out of scope", "NOT geo", -18),
    ("Within funding range", f"({_WANTS} AND {_OVERLAP})", 18, "Requested amount may not fit this programme", f"NOT ({_WANTS} AND {_OVERLAP}) AND (f_min IS NOT NULL OR f_max IS NOT NULL)", -20),
    ("Business stage match", "stg", 10, None, None, 0),
    ("Ownership target match", "own", 10, None, None, 0),
    ("Use-of-funds match", "usd", 10, None, None, 0),
    ("Years-in-business match", "coalesce(years BETWEEN years_min AND years_max, false)", 6, None, None, 0),
    ("Turnover range overlaps", "coalesce(t_min <= turnover_max AND t_max >= turnover_min, false)", 6, None, None, 0),
    ("Employee count match", "coalesce(staff BETWEEN staff_min AND staff_max, false)", 6, None, None, 0),
    ("Preferred funding type", f"list_contains(list_transform(types, lambda t: {_N('t')}), {_N('funding_type')})", 8, None, None, 0),
]
_MATCH = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" + (f" + CASE WHEN {n} THEN {m} ELSE 0 END" if b else "") for _, c, p, b, n, m in _MATCH_RULES)
_TAGS = (
    "list_filter(list_concat([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c, *_ in _MATCH_RULES) + "], view_reasons, CASE WHEN match < 50 THEN ["
    + ", ".join(f"CASE WHEN {n} THEN '{b}' END" for _, _, _, b, n, _ in _MATCH_RULES if b) + "] ELSE [] END, CASE WHEN view_quality < 50 THEN view_blockers ELSE [] END), lambda x: x IS NOT NULL)[1:6]"
)
# one row for each kind and place of profiles, as programmes see no more of them
PAIRS_SQL = f"""{SCORED_SQL}, {PROFILES_SQL},
texts AS MATERIALIZED (SELECT DISTINCT segment, sectors, stage_words, owned_asked, use_asked FROM kinds),
slim AS MATERIALIZED (SELECT pid, coalesce(program_name, '') AS title, view_quality, view_reasons, view_blockers, ticket_min, ticket_max, years_min, years_max, turnover_min, turnover_max, staff_min, staff_max,
    funding_type, industry, use_of_funds, stage, has_ownership, has_eligibility, province, geography_scope FROM scored),
sides AS MATERIALIZED (SELECT slim.* EXCLUDE (view_reasons, view_blockers), segment, {_ANY(['industry', 'use_of_funds', 'stage', _ELIGIBLE], 'sectors')} AS ind, {_ANY(['stage'], 'stage_words')} AS stg,
    {_ANY(["CASE WHEN has_ownership THEN 'women-owned' END"], 'owned_asked')} AS own, {_ANY(['use_of_funds'], 'use_asked')} AS usd FROM slim CROSS JOIN texts),
pairs AS (SELECT sides.*, kinds.* EXCLUDE (segment, stage_words, owned_asked, use_asked), geography_scope = 'National' OR coalesce(contains({_N('province')}, {_N('own_place')}), false) AS geo
  FROM sides JOIN kinds USING (segment)),
matched AS (SELECT *, greatest(0, least(100, {_MATCH}))::INT AS match FROM pairs),
blended AS (SELECT *, CAST(floor(view_quality * 0.4::DOUBLE + match * 0.6::DOUBLE + 0.5) AS INT) AS importance FROM matched)"""


def profile_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all programmes the five of most importance for each profile, with tags."""
    top = matching.best_for_profiles(_scored(spark, sf_dir), _profiles(spark, sf_dir), 5)
    return top.select("user_id", "place", "pid", "match", "importance", quality.band(F.col("importance")).alias("band"), F.array_join("tags", "|").alias("tags"))


def preview_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many previews each profile has of each status, over all programmes.

    Programmes that the preview can't tell apart (by what kinds of profiles ask, amounts exactly) are counted once, with their
    number; so are profiles of one kind."""
    none = F.array().cast("array<string>")
    p = programmes(spark, sf_dir).withColumn("geography", F.when(F.col("geography_scope") == "Unknown", none).otherwise(F.array(F.when(F.col("pk") % 3 == 0, "Southern Africa").otherwise(F.coalesce("province", F.lit("elsewhere"))))))
    users = _profiles(spark, sf_dir).select("user_id", F.col("sectors").alias("f_sectors"), F.regexp_extract(F.lower("province"), "|".join(matching.PREVIEW_PLACES), 0).alias("f_country"), F.col("preferred_types").alias("f_types"), F.col("requested_min").alias("f_min"), F.col("requested_max").alias("f_max"))
    kind = ["f_sectors", "f_country", "f_types", "f_min", "f_max"]
    kinds = kept(users.select(*kind).distinct().withColumn("kind", F.sha2(F.to_json(F.struct(*kind)), 256)), "preview-kinds")
    # amounts are told apart only by the bounds asked for: the greatest least one below, the least greatest one above
    asked = kinds.agg(F.array_sort(F.collect_set(F.col("f_min").cast("double"))).alias("f"), F.array_sort(F.collect_set(F.col("f_max").cast("double"))).alias("t"))
    p = p.crossJoin(F.broadcast(asked))  # one row
    low = F.coalesce(F.try_element_at(F.filter("t", lambda b: b >= F.col("ticket_min")), F.lit(1)), F.lit(float("inf")))
    high = F.coalesce(F.try_element_at(F.filter("f", lambda b: b <= F.col("ticket_max")), F.lit(-1)), F.lit(float("-inf")))
    p = p.withColumns({"ticket_min": F.when(F.col("ticket_min").isNotNull(), low), "ticket_max": F.when(F.col("ticket_max").isNotNull(), high)})
    p = p.groupBy(F.col("industries").alias("sectors"), "geography", "funding_type", "ticket_min", "ticket_max").agg(F.count(F.lit(1)).alias("n"))
    # of a profile's country only the words that count are kept, so kinds of profiles are as many as the form has answers, not as users: a stated query set against all rows
    seen = matching.preview(p.crossJoin(F.broadcast(kinds))).groupBy("kind", "preview_status").agg(F.sum("n").alias("n"), F.max("preview").alias("best"))
    return users.withColumn("kind", F.sha2(F.to_json(F.struct(*kind)), 256)).select("user_id", "kind").join(seen, "kind").drop("kind")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are filled or part filled as a stored table, those open or part filled as a batch over it, urgent ones
    twice; the batch's last row wins, priority is kept."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.lit(0).cast("bigint").alias("seq"))
    again = o.filter("o_orderstatus <> 'F'").withColumns({"o_totalprice": F.col("o_totalprice") + 1, "o_orderpriority": F.lit("none"), "seq": F.lit(1).cast("bigint")})
    later = again.filter("o_totalprice > 100000").withColumns({"o_orderstatus": F.lit("Y"), "seq": F.lit(2).cast("bigint")})
    return catalog.upsert(o.filter("o_orderstatus <> 'O'"), again.unionByName(later), ["o_orderkey"], "seq", keep=("o_orderpriority",))


def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved programmes that are not published yet join the published ones (loans so far)."""
    p = programmes(spark, sf_dir).select("pid", "program_name", "approval_status", "funding_type")
    return catalog.backfill(p.filter("funding_type = 'Loan' and approval_status = 'approved'"), p, ["pid"]).drop("funding_type")


def children_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sub-programmes, with the newest filled order of equal priority, customer and day of the week as
    parent; the others stay with a note."""
    o = table(spark, sf_dir, "orders").withColumns({"name": F.lower("o_orderpriority"), "funder": F.concat(F.lit("C"), F.col("o_custkey") % 500), "domain": F.dayofweek("o_orderdate").cast("string")})
    parents = o.filter("o_orderstatus = 'F'").select("name", "funder", "domain", F.col("o_orderkey").alias("program_id"), "o_orderdate")
    kids = o.select(F.col("o_orderkey").alias("child_id"), F.upper("name").alias("name"), F.concat(F.lit(" "), F.lower("funder")).alias("funder"), "domain")
    out = catalog.with_parent(kids, parents, ["name", "funder", "domain"], [F.desc("o_orderdate"), F.desc("program_id")])
    return out.select("child_id", "parent_id", "parent_note")


def registry_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as new sites, with the fields that a stored site (one with a positive balance) already takes."""
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_acctbal", F.col("s_name").alias("display_name"), F.concat(F.lit("K"), "s_nationkey", F.lit("-"), F.floor(F.col("s_acctbal") / 1000)).alias("site_key"),
        F.concat(F.lit("d"), F.col("s_suppkey") % 70, F.lit(".example")).alias("primary_domain"), F.concat(F.lit("A"), F.floor(F.col("s_acctbal") / 100)).alias("adapter_key"),
    )
    stored = s.filter("s_acctbal > 0").select(F.upper("display_name").alias("display_name"), F.lower("site_key").alias("site_key"), "primary_domain", "adapter_key")
    out = catalog.duplicates_of(s, stored, ["display_name", "site_key", "primary_domain", "adapter_key"])
    return out.select("s_suppkey", F.array_join("taken", ",").alias("taken"))


QUERIES = {
    "r1_quality_scores": quality_scores,
    "k2_route_counts": route_counts,
    "m14_record_invariants": record_invariants,
    "b8_best_per_page": best_per_page,
    "w1_published_ranked": published_ranked,
    "c14_catalogue_search": catalogue_search,
    "r6_profile_matches": profile_matches,
    "r9_preview_matches": preview_matches,
    "b11_upsert": upserted,
    "b14_backfill": backfilled,
    "j6_children_with_parents": children_with_parents,
    "b20_registry_duplicates": registry_duplicates,
}

_BAND = lambda c: f"CASE WHEN {c} >= 75 THEN 'high' WHEN {c} >= 45 THEN 'medium' ELSE 'low' END"
ORACLE_SQL = {
    "r1_quality_scores": f"WITH {SCORED_SQL} SELECT pid, quality, blocked, route, conf < 0.45 AS low_confidence FROM scored",
    "k2_route_counts": f"""WITH {SCORED_SQL} SELECT route, count(*) AS n, count_if(NOT {_NAME}) AS no_name, count_if(NOT {_FUNDER}) AS no_funder,
        count_if(funding_type = 'Unknown') AS no_type, count_if(conf < 0.45) AS low_confidence FROM scored GROUP BY route""",
    "m14_record_invariants": f"""WITH {PROGRAMMES_SQL} SELECT pid, CASE WHEN ticket_min > ticket_max THEN ticket_max ELSE ticket_min END AS low,
        CASE WHEN ticket_min > ticket_max THEN ticket_min ELSE ticket_max END AS high,
        CASE WHEN note LIKE 'Suspended%' THEN 'suspended' WHEN note LIKE 'Archived%' THEN 'closed' WHEN deadline_type IN ('Open', 'Rolling') THEN 'active'
          WHEN deadline_date IS NULL THEN 'unknown' WHEN deadline_date < DATE '{AS_OF}' THEN 'closed' ELSE 'active' END AS status,
        CASE WHEN deadline_date IS NULL THEN CASE WHEN deadline_type IN ('Open', 'Rolling') THEN 'active' ELSE 'draft' END
          WHEN deadline_date < DATE '{AS_OF}' THEN 'closed' WHEN deadline_date - DATE '{AS_OF}' <= 14 THEN 'closing_soon' ELSE 'active' END AS view_status,
        round((conf_a + conf_b) / 2, 4) AS confidence FROM programmes""",
    "b8_best_per_page": f"""WITH {SCORED_SQL}, s AS (SELECT source_url AS page, pid, quality, ai_enriched::INT AS ai, floor(conf * 100)::INT AS conf100,
          CAST(ticket_min IS NOT NULL AS INT) + CAST(ticket_max IS NOT NULL AS INT) + CAST(budget_total IS NOT NULL AS INT) + CAST(application_url IS NOT NULL AS INT)
            + CAST(contact_email IS NOT NULL AS INT) + CAST(contact_phone IS NOT NULL AS INT) AS signals,
          CASE WHEN blocked = '' THEN 0 ELSE len(string_split(blocked, '|')) END::INT AS n_blockers FROM scored)
        SELECT page, pid, quality, ai, conf100, signals, n_blockers, count(*) OVER (PARTITION BY page) AS n_rows FROM s
        QUALIFY row_number() OVER (PARTITION BY page ORDER BY quality DESC, ai DESC, conf100 DESC, signals DESC, n_blockers, pid) = 1""",
    "w1_published_ranked": f"""WITH {SCORED_SQL}, best AS (SELECT *, program_name AS title FROM scored WHERE route = 'accept' AND approval_status = 'approved'
          QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY quality DESC, floor(conf * 100)::INT DESC, pid) = 1)
        SELECT row_number() OVER (ORDER BY view_quality DESC, quality DESC, title, pid) AS place, pid, title, view_quality, quality, {_BAND('view_quality')} AS band FROM best""",
    "c14_catalogue_search": f"""WITH {SCORED_SQL} SELECT pid, program_name, view_quality FROM scored WHERE approval_status = 'approved' AND view_quality >= 70
        AND contains(lower(concat_ws(' ', program_name, funder_name, industry, use_of_funds)), 'brand#1')""",
    "r6_profile_matches": f"""WITH {PAIRS_SQL}, titles AS (SELECT pid, row_number() OVER (ORDER BY title, pid) AS rank FROM slim),
        lists AS (SELECT own_place, segment, lv, max_by(pid, (importance, view_quality, match, -rank), 5) AS pids FROM blended JOIN titles USING (pid) GROUP BY own_place, segment, lv),
        best AS (SELECT own_place, segment, lv, unnest(pids) AS pid FROM lists)
        SELECT user_id, place, pid, match, importance, band, tags FROM (SELECT p.user_id, row_number() OVER (PARTITION BY p.user_id ORDER BY importance DESC, view_quality DESC, match DESC, title, b.pid)::INT AS place, b.pid, match, importance,
          {_BAND('importance')} AS band, array_to_string({_TAGS}, '|') AS tags
        FROM (SELECT user_id, own_place, segment, lv FROM profiles) p JOIN best t USING (own_place, segment, lv) JOIN blended b ON b.pid = t.pid AND b.own_place = t.own_place AND b.segment = t.segment AND b.lv = t.lv
          JOIN (SELECT pid, view_reasons, view_blockers FROM slim) w ON w.pid = b.pid)""",
    "r9_preview_matches": f"""WITH {PROGRAMMES_SQL}, {PROFILES_SQL},
        p AS (SELECT industry, CASE WHEN geography_scope <> 'Unknown' THEN CASE WHEN pk % 3 = 0 THEN 'Southern Africa' ELSE coalesce(province, 'elsewhere') END END AS region, funding_type,
            ticket_min AS lo, ticket_max AS hi, count(*) AS n FROM programmes GROUP BY ALL),
        pre AS (SELECT own_place, segment, lv, n, region IS NOT NULL AND (lower(region) LIKE '%africa%' OR lower(region) LIKE '%malawi%' OR lower(own_place) LIKE '%africa%') AS fits,
            CASE WHEN coalesce(list_bool_or(list_transform(sectors, lambda s: contains(lower(industry), lower(s)))), false) THEN 35 ELSE 0 END + CASE WHEN fits THEN 30 ELSE 0 END
            + CASE WHEN list_contains(types, funding_type) THEN 20 ELSE 0 END + CASE WHEN coalesce(hi >= f_min AND lo <= f_max, false) THEN 15 ELSE 0 END AS preview FROM p CROSS JOIN kinds),
        c AS (SELECT own_place, segment, lv, CASE WHEN preview >= 80 THEN 'high_fit' WHEN preview >= 60 THEN 'medium_fit' WHEN NOT fits THEN 'manual_review' ELSE 'low_fit' END AS preview_status,
            sum(n)::BIGINT AS n, max(preview)::INT AS best FROM pre GROUP BY ALL)
        SELECT user_id, preview_status, n, best FROM profiles JOIN c USING (own_place, segment, lv)""",
    "b11_upsert": """WITH stored AS (SELECT * FROM orders WHERE o_orderstatus <> 'O'), batch AS (SELECT * FROM orders WHERE o_orderstatus <> 'F')
        SELECT coalesce(b.o_orderkey, s.o_orderkey) AS o_orderkey,
          CASE WHEN b.o_orderkey IS NULL THEN s.o_orderstatus WHEN b.o_totalprice + 1 > 100000 THEN 'Y' ELSE b.o_orderstatus END AS o_orderstatus,
          CASE WHEN b.o_orderkey IS NULL THEN s.o_totalprice ELSE b.o_totalprice + 1 END AS o_totalprice,
          coalesce(s.o_orderpriority, 'none') AS o_orderpriority,
          CASE WHEN b.o_orderkey IS NULL THEN 0 WHEN b.o_totalprice + 1 > 100000 THEN 2 ELSE 1 END::BIGINT AS seq
        FROM stored s FULL JOIN batch b ON s.o_orderkey = b.o_orderkey""",
    "b14_backfill": f"WITH {PROGRAMMES_SQL} SELECT pid, program_name, approval_status FROM programmes WHERE approval_status = 'approved'",
    "j6_children_with_parents": """WITH o AS (SELECT *, lower(o_orderpriority) AS name, o_custkey % 500 AS funder, dayofweek(o_orderdate) AS day FROM orders), newest AS (SELECT name, funder, day, o_orderkey AS parent_id FROM o WHERE o_orderstatus = 'F'
          QUALIFY row_number() OVER (PARTITION BY name, funder, day ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        SELECT o_orderkey AS child_id, parent_id, CASE WHEN parent_id IS NULL THEN 'parent not found' END AS parent_note FROM o LEFT JOIN newest USING (name, funder, day)""",
    "b20_registry_duplicates": """WITH x AS (SELECT s_suppkey, s_acctbal, s_name AS a, s_nationkey || '-' || floor(s_acctbal / 1000)::BIGINT AS b, s_suppkey % 70 AS c, floor(s_acctbal / 100)::BIGINT AS d FROM supplier),
        st AS (SELECT * FROM x WHERE s_acctbal > 0)
        SELECT s_suppkey, concat_ws(',', CASE WHEN a IN (SELECT a FROM st) THEN 'display_name' END, CASE WHEN b IN (SELECT b FROM st) THEN 'site_key' END,
          CASE WHEN c IN (SELECT c FROM st) THEN 'primary_domain' END, CASE WHEN d IN (SELECT d FROM st) THEN 'adapter_key' END) AS taken FROM x""",
}
