"""Operators of taxonomies, page rules, registry, evidence, drafts and records over the given tables, with the SQL they equal.

Texts that the tables lack are made of their values by templates; what must be read from them is known from the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, money, moneycheck, records, taxonomy, text
from ..operators import adapters, builder, catalog, evidence, hybrid, registry, resolve
from ..sources import html, paged
from .pages import _LINES, _ONCE, _PLAIN, _SECTIONS_SQL
from ..operators.matching import ranked
from .views import AS_OF, PROGRAMMES_SQL, folder, kept, programmes, table

_any_sql = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_count_sql = lambda c, words: "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"


def _choose(key: Column, *values) -> Column:
    """The value whose place is the key's remainder."""
    out = F.when(F.lit(False), F.lit(None))
    for k, v in enumerate(values):
        out = out.when(key % len(values) == k, v if isinstance(v, Column) else F.lit(v))
    return out


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with white space collapsed, without a leading number, their slug, and a phrase looked for."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(text.collapse(t), 256).alias("collapsed"), F.sha2(text.strip_numbering(t), 256).alias("bare"), text.plain_slug(F.substring(t, 1, 60)).alias("slug"),
        text.has_phrase(t, "the").alias("has_the"),
    )


def render_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why pages, as fetched with some status and body, need a browser."""
    k = F.col("page_id")
    body = F.when(k % 10 == 3, F.concat(F.lit("<p>Just a moment</p>"), "html")).when(k % 10 == 4, "").when(k % 10 == 5, F.regexp_extract("html", "<title>[\\s\\S]*?</title>", 0)).otherwise(F.col("html"))
    status = F.when(k % 10 == 0, 403).when(k % 10 == 1, 500).when(k % 10 == 2, 204).otherwise(200)
    d = table(spark, sf_dir, "pages").select("page_id", "url", status.alias("status"), body.alias("body"))
    why = records.render_reason(F.col("url"), F.col("status"), F.col("body"), F.lit("text/html"), k % 17 == 0)
    return d.select("page_id", why.alias("reason"), records.fetched(F.col("status"), F.col("body"), F.lit("text/html")).alias("fetched"))


def _counts() -> list[Column]:
    k = F.col("doc_id")
    return [F.lit(1), (k % 4).cast("int"), (k % 11).cast("int"), F.when(k % 5 == 0, 3).otherwise(0), F.when(k % 7 == 0, 1).otherwise(0), F.when(k % 13 == 0, 1).otherwise(0)]


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page types of documents by their terms and by counts of blocks and links; of listings in detail, that of a programme."""
    r, b, i, d, a, o = _counts()
    kind = records.global_page_type(F.col("text"), r, b, i, d, a, o)
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("page_type"))


def preflights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: whether documents are read closely, by page type, terms, kind of file and length."""
    r, b, i, d, a, o = _counts()
    docs = table(spark, sf_dir, "documents").withColumn("kind", F.when(F.col("lang") == "de", "pdf").when(F.col("lang") == "fr", "image").otherwise("html"))
    say = builder.preflight(records.global_page_type(F.col("text"), r, b, i, d, a, o), F.lower("text"), F.col("kind"), F.lower("source"), F.length("text"))
    return docs.select("doc_id", say.alias("p")).select("doc_id", "p.decision", "p.confidence", "p.reason")


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How pages are built, by their words, sections and headings."""
    d = html.documents(table(spark, sf_dir, "pages"))
    return d.select(F.col("id").alias("page_id"), taxonomy.structure(F.lit("html"), F.size("sections"), F.size("panels"), F.col("headings"), F.col("text")).alias("structure"))


def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and name of the site of every page."""
    return table(spark, sf_dir, "pages").select("page_id", taxonomy.domain_key(F.col("url")).alias("key"), taxonomy.domain_name(F.col("url")).alias("name"))


_PLACES = ("Eastern Cape", "Free State", "Gauteng", "KwaZulu-Natal", "Limpopo", "Mpumalanga", "North West", "Northern Cape", "Western Cape")
_TOWNS = ("Tshwane", "Cape Town")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope, provinces, towns and postal ranges of texts made of orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    province, town = _choose(c, *_PLACES), _choose(c, *_TOWNS)
    low, high = (k % 1000 + 1000).cast("string"), (k % 1000 + 1500).cast("string")
    say = _choose(
        k, F.concat(F.lit("Nationwide scheme of "), province), F.concat(F.lit("For firms in "), town, F.lit(", "), province, F.lit(" "), low, F.lit(" - "), high, F.lit(" and "), high),
        F.concat(F.lower(province), F.lit(" only, code "), low), "Regional funds across Africa", F.concat(F.lit("Township shops of customer "), c.cast("string")), "Nothing of the kind",
    )
    g = taxonomy.geography(say, _TOWNS)
    return table(spark, sf_dir, "orders").select("o_orderkey", g.alias("g")).select("o_orderkey", "g.scope", *[F.array_join(f"g.{x}", "|").alias(x) for x in ("provinces", "municipalities", "postal_codes")])


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of owners and sentences of sections in texts made of orders."""
    k = F.col("o_orderkey")
    n, m = (k % 90 + 10).cast("string"), (k % 50 + 1).cast("string")
    say = _choose(k, F.concat(F.lit("Minimum of "), n, F.lit("% black ownership; "), m, F.lit(" % women in "), n, F.lit("% of firms.")), F.concat(F.lit("At least "), n, F.lit("% shareholding.")), "None.")
    items = F.array(F.concat(F.lit("First "), m, F.lit(". Second! first "), m, F.lit(".")), F.lit(None).cast("string"), F.lit("Third\nSecond!"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(taxonomy.percentages(say), "|").alias("percentages"), F.array_join(taxonomy.ownership_thresholds(say), "|").alias("thresholds"),
        F.array_join(taxonomy.section_items(items), "|").alias("items"),
    )


def amount_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M7, M8: what sentences say of ideal, least and most amounts, the implied currency, and turnover."""
    k = F.col("o_orderkey")
    x, y = (k % 50 + 1).cast("string"), (k % 100 + 100).cast("string")
    z, a = (k % 100 + 250).cast("string"), F.floor("o_totalprice").cast("long")
    say = _choose(
        k, F.concat(F.lit("Min R"), x, F.lit("m. Ideal R"), y, F.lit("–R"), z, F.lit("m. Funding is for strategic infrastructure deals.")),
        F.concat(F.lit("Loans of at least $"), a.cast("string"), F.lit(". Loans not exceeding $"), (a * 2).cast("string"), F.lit(".")),
        F.concat(F.lit("Grant funding between R"), x, F.lit("m and R"), z, F.lit("m in Rand terms.")), "Nothing is said here.",
    )
    d = table(spark, sf_dir, "orders").select("o_orderkey", say.alias("t"), F.when(k % 4 == 3, "fund.co.za").otherwise("").alias("domain"), F.concat(F.lit("Loans of R9m. Annual turnover between R"), x, F.lit("m and R"), z, F.lit("m.")).alias("trade"))
    d = taxonomy.turnover_range(d, "trade").withColumns({"e": money.amount_evidence_of("t", F.lit(None).cast("string")), "implied": money.default_currency(F.col("t"), F.col("domain"))})
    return d.select(
        "o_orderkey", F.col("e.ideal.low").alias("ideal_low"), F.col("e.ideal.high").alias("ideal_high"), F.col("e.minimum.low").alias("least"), F.col("e.maximum.high").alias("most"),
        F.col("e.range.low").alias("range_low"), F.col("e.range.high").alias("range_high"), "implied", F.col("turnover.low").alias("turnover_low"), F.col("turnover.high").alias("turnover_high"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of parts; the taxonomy is the table's own: the words of part types, by length."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.split("p_type", " ")).alias("w")).distinct()
    terms = words.select(F.lit("kind").alias("taxonomy"), F.length("w").alias("ord"), F.concat(F.lit("letters "), F.length("w")).alias("category"), F.lit(None).cast("string").alias("parent"), F.ascii("w").alias("term_ord"), F.col("w").alias("term"), F.lit(0.6).alias("base"), F.lit(0.1).alias("step"), F.lit(0.75).alias("cap"))
    c = taxonomy.classified(p.select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand").alias("said")), terms, "p_partkey", "said", 20)
    return c.select("p_partkey", "category", "confidence", F.array_join(F.array_sort("terms"), "|").alias("terms"))


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of sites (suppliers, eight a payload) over a registry; active ones."""
    s = table(spark, sf_dir, "supplier")
    key, seeds = F.concat(F.lit("k"), F.col("s_suppkey") % 400).alias("site_key"), F.array(F.concat(F.lit("https://s.example/"), "s_suppkey")).alias("seed_urls")
    none = F.lit(None).cast("string")
    last = s.filter("s_acctbal >= 5000").groupBy(key).agg(F.max_by(F.struct("s_suppkey", "s_name"), "s_suppkey").alias("r"))
    old = last.select("site_key", F.col("r.s_name").alias("display_name"), none.alias("primary_domain"), none.alias("adapter_key"), F.array(F.lit("old")).alias("seed_urls"), none.alias("adapter_config"), F.lit(False).alias("ai_enrichment_required"), F.lit(True).alias("active"), F.array(F.lit("kept")).alias("notes"), F.lit(0).cast("long").alias("seq"))
    site = F.struct(key, F.col("s_name").alias("display_name"), seeds, (F.col("s_nationkey") % 3 > 0).alias("active"), F.col("s_suppkey").cast("long").alias("seq"))
    payloads = s.filter("s_acctbal < 5000").groupBy(F.expr("s_suppkey div 8").alias("part")).agg(F.to_json(F.collect_list(site)).alias("body"))
    new = registry.recordset(payloads, "body", registry.SITE + ", seq long").drop("place")
    sites = registry.registered(old, new, "seq")
    return sites.filter("active").select("site_key", "display_name", F.array_join("seed_urls", "|").alias("seeds"), F.coalesce(F.array_join("notes", "|"), F.lit("")).alias("notes"))


def user_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups of customers over users; which rows are of admins."""
    c = table(spark, sf_dir, "customer")
    ident, mail = F.concat(F.lit("u"), "c_custkey").alias("id"), F.concat(F.lower("c_name"), F.lit("@x.example"))
    old = c.filter("c_acctbal > 0").select(ident, mail.alias("email"), F.upper("c_name").alias("full_name"), F.when(F.col("c_nationkey") == 3, "admin").otherwise("applicant").alias("role"), F.lit(0).cast("long").alias("seq"))
    meta = F.to_json(F.create_map(F.lit("role"), F.when(F.col("c_nationkey") < 2, "ADMIN").otherwise("guest"), F.when(F.col("c_nationkey") % 2 == 0, "name").otherwise("other"), F.col("c_name")))
    new = c.filter("c_mktsegment <> 'BUILDING'").select(ident, F.when(F.col("c_nationkey") != 4, mail).alias("email"), meta.alias("meta"), F.col("c_custkey").alias("at"))
    users = registry.signed_up(old, new, "at")
    admin = registry.of_admins(users.select(F.col("id").alias("user_id")), users).withColumn("admin", F.lit(True))
    return users.join(admin, F.col("id") == F.col("user_id"), "left").select("id", "email", "full_name", "role", F.coalesce("admin", F.lit(False)).alias("admin"))


_WAYS = ("llm_only_inference", "regex_from_prose", "parent_page_inheritance", "unheard of")


def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence of fields: confidence by the best of each, and records with what evidence adds."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("program_id"), F.col("event_type").alias("field"), _choose(k, *_WAYS).alias("method"), (k % 997 / 1000).alias("confidence"), F.concat(F.lit("v"), k % 7).alias("value"))
    rows = e.groupBy("program_id").agg(F.count_if(F.col("method") == "regex_from_prose").alias("n"))
    own = rows.select("program_id", F.when(F.col("n") % 2 == 0, "").otherwise("kept").alias("click"), F.lit(None).cast("string").alias("view"), F.array(F.lit("own"), F.lit("V1")).alias("purchase"), F.create_map(F.lit("click"), F.lit(0.5)).alias("confidence"))
    folded = registry.folded_evidence(own, e, ["click", "view"], ["purchase"])
    best = registry.field_confidence(e).withColumnRenamed("confidence", "best")
    out = folded.join(best, "program_id", "left")
    return out.select("program_id", "click", "view", F.array_join("purchase", "|").alias("purchase"), F.col("confidence")["click"].alias("sure_click"), F.col("best")["click"].alias("best_click"), F.element_at(registry.by_confidence(F.col("best")), 1).alias("surest"))


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All programmes as the catalogue shows them."""
    p = programmes(spark, sf_dir).select(
        F.col("pid").alias("program_id"), "funder_name", F.when(F.col("sk") % 46 == 0, "").otherwise("www.example.com").alias("source_domain"), "source_url", F.when(F.col("pk") % 2 == 0, F.col("source_title")).alias("title"), "provinces", "municipalities",
        "geography_scope", "funding_type", "deadline_type", "deadline_date", F.when(F.col("pk") % 3 > 0, F.col("confidence")).alias("confidence"), "approval_status",
    )
    v = registry.catalogue_view(p, F.lit(AS_OF).cast("date"))
    return v.withColumn("geography", F.array_join("geography", "|"))


def best_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of orders equal as records the one of most confidence, in the first one's place."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("funder"), F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("name"), F.lit(None).cast("string").alias("parent"), F.concat(F.lit("u"), F.col("o_custkey") % 100).alias("url"), F.floor(F.col("o_totalprice") / 1000).alias("confidence"))
    return hybrid.best_by_key(o).select("ord", "first_ord", "confidence")


def records_to_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records to the first supplier's site of their domain or name."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("s"), "s_suppkey").alias("site_key"), F.when(F.col("s_nationkey") > 4, F.col("s_name")).alias("display_name"), F.concat(F.lit("WWW.d"), F.col("s_suppkey") % 70, F.lit(".org")).alias("primary_domain"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("d"), F.col("o_custkey") % 90, F.lit(".org")).alias("domain"), F.format_string("SUPPLIER#%09d", F.col("o_custkey") % 150).alias("funder"))
    return hybrid.records_to_sites(o, s).select("o_orderkey", "site_key")


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    amount = F.when(k % 2 == 0, F.concat(F.lit("R"), (c % 50 + 1).cast("string"), F.lit("m to R"), (c % 50 + 60).cast("string"), F.lit("m"))).otherwise("")
    url = F.concat(F.lit("https://S"), c % 9, F.lit(".org/?utm_source=x"))
    return table(spark, sf_dir, "orders").select(k.alias("draft"), c.alias("search"), F.when(k % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("name"), url.alias("source_url"), F.when(k % 40 == 1, "grant").alias("funding_type"), amount.alias("amount_text"), F.array("o_orderstatus").alias("lines"), (k % 60 + 40).cast("int").alias("confidence"))


def draft_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as searched drafts, merged by name and page and made records."""
    d = _drafts(spark, sf_dir).withColumn("source_url", F.concat(F.lit("https://S.org/"), "search", F.lit("/?utm_source=x")))
    r = hybrid.drafts_to_records(hybrid.merged_drafts(d), "ZAR")
    return r.select("draft", "url", "funding_type", "ticket_min", "ticket_max", F.col("field_confidence")["funding_type"].alias("sure"), F.array_join("review", "|").alias("review"), F.array_join(F.array_sort("lines"), "|").alias("lines"))


def draft_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight sources of each draft: the one it cites, then by rank and url."""
    k = F.col("o_orderkey")
    sources = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("search"), F.concat(F.lit("https://S"), k % 9, F.lit(".org/?utm_source=x")).alias("url"), (k % 4 + 1).cast("int").alias("official_rank")).distinct()
    s = hybrid.draft_sources(_drafts(spark, sf_dir), sources)
    return s.select("draft", F.sha2(F.array_join("sources", "|"), 256).alias("sources_sha256"), F.size("sources").alias("n"))


def star_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, in greedy stars by the pair rules."""
    c = F.col("o_custkey")
    url = F.concat(F.lit("https://d.org/"), F.col("o_orderkey"))
    none = F.array().cast("array<string>")
    r = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("d"), c % 300).alias("domain"), F.concat(F.lit("P"), F.substring(F.md5((c % 300).cast("string")), 1, 12)).alias("name"), F.concat(F.lit("F"), c % 7).alias("funder"),
        F.lit("").alias("parent"), url.alias("url"), F.array(url).alias("urls"), none.alias("documents"), F.lit("").alias("apply_url"), F.lit("overview").alias("role"), F.lit("funding_programme").alias("page_type"),
    )
    return resolve.star_clusters(r, kept).select("ord", "cluster")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last patch of each customer over the table, and which rows it changed."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.lit("1990-01-01").alias("updated_at"))
    p = c.filter("c_acctbal < 2000").select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"), F.lit(1).alias("seq"))
    p = p.unionByName(c.filter("c_acctbal < 1000").select("c_custkey", F.lit("HOUSEHOLD").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"), F.lit(2).alias("seq")))
    new = registry.patched(c, p, "c_custkey", "seq")
    return registry.touched(c, new, "c_custkey", F.lit("1995-01-01")).select("c_custkey", "c_mktsegment", "c_acctbal", "updated_at")


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest checkpoints of each user's visits, the newest of all marked."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("checkpoint_id"), (F.col("user_id") % 50).alias("run_id"), F.col("ts").alias("updated_at"))
    last = registry.latest_checkpoint(e).select("checkpoint_id", F.lit(True).alias("newest"))
    return registry.pruned(e, 2).join(last, "checkpoint_id", "left").select("checkpoint_id", "run_id", F.coalesce("newest", F.lit(False)).alias("newest"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records sent in batches that time out above two, and the sums of what came back."""

    def send(rows: list[dict]) -> dict:
        if len(rows) > 2:
            raise TimeoutError
        return {"stored": len(rows), "kinds": sorted({r["p_brand"] for r in rows})}

    results = registry.uploaded(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), send)
    return registry.merged_results(results, ["stored"], ["kinds"]).select(F.col("stored").cast("long").alias("stored"), F.array_join("kinds", "|").alias("kinds"))


def checked_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of offers held against their evidence: right ones, and numbers of phones, years and shares taken for money."""
    k, a = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    say = _choose(
        k, F.concat(F.lit("Grant funding between R"), a.cast("string"), F.lit(" and R"), (a * 2).cast("string"), F.lit(" for firms.")), F.concat(F.lit("Call 011 555 "), (k % 9000 + 1000).cast("string"), F.lit(" for details.")),
        "Apply before 2026.", "Support for all firms.", F.concat(F.lit("Owners hold 51% of R"), (k % 50 + 1).cast("string"), F.lit("m")), F.concat(F.lit("The loan amount is ZAR "), (k % 9 + 1).cast("string"), F.lit(" million.")),
    )
    budget = F.when(k % 12 == 0, 2020.0).when(k % 12 == 6, a * 10.0)
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.array(say, F.lit(None).cast("string")).alias("s"), F.lit("Offer").alias("t"), a.cast("double").alias("low"), F.when(k % 6 != 3, a * 2.0).alias("high"), budget.alias("budget"), F.lit(None).cast("string").alias("cur"))
    c = moneycheck.checked_amounts("s", "t", "low", "high", "budget", "cur")
    return d.select("o_orderkey", c.alias("c")).select("o_orderkey", "c.*")


def page_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter of every page, its settings with the site's laid over them, and the page's role.

    Adapters are the pages' own domains of three labels, and com and org as a whole; a site of an even number of letters has a config."""
    p = table(spark, sf_dir, "pages")
    parts = F.split(F.regexp_extract("url", "^https?://([^/?#]*)", 1), "[.]")
    end = lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")
    found = p.filter(F.size(parts) > 2).select(end(3).alias("domain")).filter("domain like 'th%'").union(p.select(end(1)).filter(end(1).isin("com", "org"))).distinct()
    listed = found.select(F.length("domain").cast("long").alias("ord"), F.col("domain").alias("adapter_key"), "domain")
    found = adapters.with_adapter(p.select("page_id", "url"), listed)
    one = lambda *x: F.array(*[F.lit(v) for v in x])
    none = F.array().cast("array<string>")
    base = listed.select("adapter_key", one("/en/1").alias("child_page_terms"), none.alias("parent_page_terms"), none.alias("application_support_terms"), none.alias("supporting_programme_terms"), one("page=2").alias("support_page_terms"), one("/fr").alias("allowed_path_prefixes"), F.lit(50).alias("max_pages"), F.lit(True).alias("strict_path_prefixes"), F.lit("balanced").alias("crawl_mode"), F.create_map(F.lit("a"), F.lit("b")).alias("merge_aliases"))
    config = listed.filter(F.length("domain") % 2 == 0).select("adapter_key", none.alias("child_page_terms"), one("/es/", " ").alias("parent_page_terms"), one("/DE/").alias("allowed_path_prefixes"), (F.length("domain") - 14).alias("max_pages"), F.lit(False).alias("strict_path_prefixes"), F.lit(" ").alias("crawl_mode"), F.create_map(F.lit("a"), F.lit("c"), F.lit("d"), F.lit("e")).alias("merge_aliases"))
    rows = found.join(adapters.configured(base, config), "adapter_key", "left")
    k = F.col("page_id")
    role = adapters.page_role(F.col("url"), F.lit(None), F.lit("text"), (k % 3).cast("int"), (k % 2).cast("int"), (k % 11).cast("int"), (k % 4).cast("int"), F.when(k % 5 == 0, 1).otherwise(0), F.lit(0), F.lit("generic_content"))
    return rows.select("page_id", "adapter_key", "max_pages", F.col("strict_path_prefixes").cast("int").alias("strict_path_prefixes"), "crawl_mode", F.col("merge_aliases")["a"].alias("alias"), F.coalesce(F.size("merge_aliases"), F.lit(-1)).alias("n_aliases"), role.alias("role"))


def publish_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published orders after a feed of changes: filled ones are published, open and part filled ones change."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("program_id"), F.col("o_orderpriority").alias("name"), "o_orderstatus", "o_totalprice")
    final = o.filter("o_orderstatus <> 'O'").select("program_id", "name", F.lit("approved").alias("approval_status"), F.lit("old").alias("published_at"), F.lit("approved").alias("source_approval_status"))
    one = o.filter("o_orderstatus <> 'F'").select(F.lit("update").alias("op"), F.lit(1).alias("seq"), "program_id", F.upper("name").alias("name"), F.when(F.col("o_totalprice") > 100000, "approved").when(F.col("o_totalprice") > 50000, "rejected").alias("approval_status"))
    two = o.filter("o_totalprice > 250000").select(F.lit("DELETE").alias("op"), F.lit(2).alias("seq"), "program_id", F.lit(None).cast("string").alias("name"), F.lit("approved").alias("approval_status"))
    three = o.filter("o_totalprice > 400000").select(F.lit("insert").alias("op"), F.lit(3).alias("seq"), "program_id", F.lit("again").alias("name"), F.lit("approved").alias("approval_status"))
    return catalog.published_changes(final, one.union(two).union(three), now=F.lit("new"))


def paged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of JSON read through the source of paged tables, with a pushed filter."""
    where = folder(spark, "json-pages")
    pages = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 500").alias("page")).agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_brand", "p_retailprice"))).alias("value"))
    pages.repartition("page").write.partitionBy("page").text(where)
    return paged.read_pages(spark, where, "p_partkey long, p_name string, p_brand string, p_retailprice double").filter("p_brand = 'Brand#2'").select("p_partkey", "p_name", "p_retailprice")


def titles_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, customers' segments and languages' words in the order of a reader, not of bytes: letters
    before case, accents and marks."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.substring("text", 1, 400), r"[\s\p{Punct}]+")).alias("title"))
    names = words.union(table(spark, sf_dir, "part").select("p_name")).union(table(spark, sf_dir, "customer").select("c_mktsegment")).filter("title <> ''").distinct()
    return ranked(names, [F.collate("title", "UNICODE"), F.col("title")], kept).select("title", "place")


SPEED_WORDS = ("turnaround", "processing time")


def speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of processing, and structures of repayment, read from texts made of orders."""
    k = F.col("o_orderkey")
    n, m = (k % 20 + 1).cast("string"), (k % 20 + 9).cast("string")
    say = _choose(
        k, F.concat(F.lit("Open for 3 days. Turnaround is "), n, F.lit(" to "), m, F.lit(" weeks.")), F.concat(F.lit("Processing time: within "), n, F.lit(" days. Turnaround 1-2 days.")), F.concat(F.lit("Turnaround times vary. Processing time "), n, F.lit("-"), m, F.lit(" days.")), "Paid in 5 days.",
    )
    pay = _choose(k, "Interest-only at first, monthly repayments later.", "A balloon payment.", "Linked to cash flow.", "Repay weekly: weekly instalment of R5.", "A grace period applies.", "As agreed.", None)
    often = _choose(k, "Unknown", "Monthly")
    d = table(spark, sf_dir, "orders").select("o_orderkey", classify.day_range(say, SPEED_WORDS).alias("d"), classify.repayment_structure(pay, often).alias("structure"))
    return d.select("o_orderkey", "d.low", "d.high", "d.said", "structure")


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all pages with the buckets of fields that they speak of; on pages of several sections what all share is set apart."""
    docs = kept(html.documents(table(spark, sf_dir, "pages"), built=True), "built-pages")
    items = builder.content_items(docs)
    built = docs.select("id", taxonomy.structure(F.lit("html"), F.size("outline"), F.lit(0), F.col("headings"), F.col("text")).alias("structure"))
    routed = evidence.routed_items(items.join(built, "id"))
    return routed.select(F.col("id").alias("page_id"), "place", "kind", F.array_join("buckets", "|").alias("buckets"))


def order_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of texts made of orders (a page a customer, an item an order), folded by page."""
    k, a = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    say = _choose(
        k, F.concat(F.lit("Seed "), F.col("o_orderstatus"), F.lit(" | Agency of Trade")), F.concat(F.lit("Loan funding from R"), a.cast("string"), F.lit(" to R"), (a * 2).cast("string"), F.lit(" on offer.")),
        F.concat(F.lit("Apply at https://a.example/apply/"), (k % 5).cast("string"), F.lit(" today.")), F.concat(F.lit("Contact us by email: d"), (k % 7).cast("string"), F.lit("@a.example")), "Municipality of the coast", F.concat(F.lit("Deadline: 2027-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")), "Nothing else",
    )
    kind = _choose(k, "title", "section", "section", "interactive", "body", "section", "body")
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), k.alias("place"), kind.alias("kind"), F.lit("").alias("label"), say.alias("content"), F.lit(0.5).alias("certainty"), F.lit("single_program_page").alias("structure"))
    found = evidence.folded_fields(evidence.field_evidence(evidence.routed_items(items), F.lit("2026-01-10").cast("date")))
    return found.select(F.col("id").alias("page"), "field", F.when(F.col("value").rlike(r"^[0-9.]+(E[0-9]+)?$"), F.col("value").cast("double").cast("long").cast("string")).otherwise(F.col("value")).alias("value"), "confidence", "n")


QUERIES = {
    "s1_document_texts": document_texts, "c5_page_reasons": render_reasons, "g9_document_types": page_types, "c20_document_preflights": preflights, "g12_page_structures": structures,
    "s28_site_names": site_names, "g3_order_places": places, "s20_order_shares": shares, "m5_order_amounts": amount_evidence, "g13_part_categories": categories,
    "b15_supplier_sites": registry_upsert, "b18_customer_users": user_upsert, "k10_event_evidence": event_evidence, "c17_programme_views": view, "e10_best_orders": best_by_key,
    "j1_order_sites": records_to_sites, "h23_order_drafts": draft_records, "j13_order_sources": draft_sources, "e1_order_stars": star_clusters,
    "c12_checked_amounts": checked_amounts, "x2_page_adapters": page_adapters, "b13_publish_feed": publish_feed, "a16_paged_table": paged_table, "w1_titles_by_locale": titles_by_locale,
    "m9_order_speeds": speeds, "h26_page_routes": page_routes, "h17_order_evidence": order_evidence, "b19_patches": patches, "t4_checkpoints": checkpoints, "b10_uploads": uploads,
}

_TYPE_SQL = f"""CASE WHEN {_any_sql('low', records.PROCUREMENT)} THEN 'tender_procurement' WHEN {_any_sql('low', records.STATIONS)} AND NOT fundable THEN 'technology_station'
    WHEN {_any_sql('low', records.SUPPORT)} AND NOT fundable THEN 'support_programme' WHEN {_any_sql('low', records.NEWS)} AND {_count_sql('low', records.DETAILS)} < 2 AND NOT fundable THEN 'news_article'
    WHEN contains(low, 'open call') OR contains(low, 'call for applications') THEN 'open_call' WHEN doc_id % 4 > 1 OR doc_id % 5 = 0 OR doc_id % 11 > 8 THEN 'funding_listing'
    WHEN fundable OR doc_id % 7 = 0 OR doc_id % 13 = 0 OR {_count_sql('low', records.DETAILS)} >= 2 THEN 'funding_programme' ELSE 'generic_content' END"""
_DOCS_SQL = f"d AS (SELECT *, lower(coalesce(text, '')) AS low FROM documents), e AS (SELECT *, {_any_sql('low', records.FUNDABLE)} AS fundable FROM d), f AS (SELECT *, {_TYPE_SQL} AS page_type FROM e)"
_STRONG = tuple(t for t in builder.PROGRAMME_SIGNALS if t != "investment")
_SHOWN = r"""length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))"""
_SLUG = lambda c: f"nullif(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-'), '')"
_CASE = lambda key, values: "CASE " + " ".join(f"WHEN {key} % {len(values)} = {k} THEN '{v}'" for k, v in enumerate(values)) + " END"
ORACLE_SQL = {
    "s1_document_texts": rf"""SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[\s\x{{0B}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))) AS collapsed,
        sha256(regexp_replace(coalesce(text, ''), '(?i)^\s*(?:\d+|[ivxlcdm]+)(?:\s*[.)-]\s*|\s+)', '')) AS bare, {_SLUG("coalesce(substr(text, 1, 60), '')")} AS slug,
        regexp_matches(lower(coalesce(text, '')), '(^|[^0-9a-z])the([^0-9a-z]|$)') AS has_the FROM documents""",
    "c5_page_reasons": f"""WITH p AS (SELECT page_id, CASE page_id % 10 WHEN 0 THEN 403 WHEN 1 THEN 500 WHEN 2 THEN 204 ELSE 200 END AS status,
            CASE page_id % 10 WHEN 3 THEN '<p>Just a moment</p>' || html WHEN 4 THEN '' WHEN 5 THEN regexp_extract(html, '<title>[\\s\\S]*?</title>', 0) ELSE html END AS body FROM pages),
        q AS (SELECT *, lower(body) AS low, {_SHOWN} AS shown, status BETWEEN 200 AND 399 AND trim(body) <> '' AS fetched FROM p)
        SELECT page_id, fetched, CASE WHEN page_id % 17 = 0 THEN 'adapter-browser-rule' WHEN status = 403 THEN 'restricted-or-rate-limited-status' WHEN NOT fetched THEN 'http-fetch-failed'
          WHEN {_any_sql('low', records.CHALLENGES)} THEN 'browser-challenge' WHEN {_any_sql('low', records.NEED_SCRIPTS)} THEN 'javascript-required' WHEN shown < 220 THEN 'thin-html'
          WHEN shown < 450 AND len(string_split(low, '<script')) > 2 THEN 'spa-shell' WHEN shown < 650 AND {_any_sql('low', [s.replace("'", "''") for s in records.SHELLS])} THEN 'app-shell' END AS reason FROM q""",
    "g9_document_types": f"WITH {_DOCS_SQL} SELECT doc_id, page_type FROM f",
    "c20_document_preflights": f"""WITH {_DOCS_SQL}, g AS (SELECT *, {_count_sql('low', _STRONG)} AS strong, {_count_sql('low', builder.OTHER_SIGNALS)} AS other, lang IN ('de', 'fr') AS file, lower(source) AS name FROM f),
        h AS (SELECT *, CASE WHEN page_type IN ({", ".join(f"'{t}'" for t in records.DROPPED_TYPES)}) THEN 1 WHEN {_any_sql('low', ('philosophy', 'governance', 'process', 'procedure'))} AND strong = 0 THEN 2
          WHEN file AND strong = 0 AND NOT ({_any_sql('low', builder.FILE_ALLOWS)} OR {_any_sql('name', builder.FILE_ALLOWS)}) THEN 3 WHEN file AND strong = 0 AND ({_any_sql('low', builder.FILE_BLOCKS)} OR {_any_sql('name', builder.FILE_BLOCKS)}) THEN 4
          WHEN other >= 2 AND strong = 0 THEN 5 WHEN strong >= 2 THEN 6 WHEN strong = 1 AND other = 0 AND length(text) >= 600 THEN 7 ELSE 8 END AS rule FROM g)
        SELECT doc_id, CASE WHEN rule < 6 THEN 'no' WHEN rule < 8 THEN 'yes' ELSE 'unclear' END AS decision,
          CASE rule WHEN 1 THEN CASE WHEN page_type = 'generic_content' AND strong >= 2 THEN 0.55 ELSE 0.95 END WHEN 2 THEN 0.97 WHEN 3 THEN 0.96 WHEN 4 THEN 0.94 WHEN 5 THEN 0.93 WHEN 6 THEN 0.9 WHEN 7 THEN 0.8 ELSE 0.55 END::DOUBLE AS confidence,
          CASE rule WHEN 1 THEN 'page type' WHEN 2 THEN 'governance or philosophy' WHEN 3 THEN 'file without programme terms' WHEN 4 THEN 'report or media file' WHEN 5 THEN 'article, media or policy' WHEN 6 THEN 'programme signals'
            WHEN 7 THEN 'one programme signal' ELSE '' END AS reason FROM h""",
    "g12_page_structures": f"""WITH p AS (SELECT page_id, lower({_PLAIN("regexp_extract(html, '<h1>([\\s\\S]*?)</h1>', 1)")}) AS heads, lower(array_to_string({_LINES("regexp_extract(html, '(<div class=\\\"ad\\\">[\\s\\S]*?</article>)', 1)")}, chr(10))) AS body FROM pages),
        q AS (SELECT page_id, heads || ' ' || body AS low FROM p)
        SELECT page_id, CASE WHEN {_any_sql('low', taxonomy.APPLY_SIGNALS)} AND NOT {_any_sql('low', taxonomy.FUND_SIGNALS)} THEN 'application_form' WHEN {_any_sql('low', taxonomy.FUND_SIGNALS)} THEN 'single_program_page' ELSE 'generic_page' END AS structure FROM q""",
    "s28_site_names": """WITH h AS (SELECT page_id, regexp_replace(split_part(split_part(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www[.]', ''), '/', 1), '.', 1), '[^a-z0-9]+', '-', 'g') AS k FROM pages),
        s AS (SELECT page_id, trim(k, '-') AS k, trim(CASE WHEN starts_with(trim(k, '-'), 'the') THEN substr(trim(k, '-'), 4) ELSE trim(k, '-') END, '-') AS short, trim(replace(k, '-', ' ')) AS w FROM h)
        SELECT page_id, CASE WHEN starts_with(k, 'the') AND length(k) > 3 AND short <> '' THEN short ELSE k END AS key,
          CASE WHEN length(w) <= 4 THEN upper(w) ELSE array_to_string(list_transform(string_split(w, ' '), lambda x: upper(x[1]) || x[2:]), ' ') END AS name FROM s""",
    "g3_order_places": f"""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, {_CASE('o_custkey', _PLACES)} AS province, {_CASE('o_custkey', _TOWNS)} AS town, o_orderkey % 1000 + 1000 AS low FROM orders)
        SELECT o_orderkey, CASE k WHEN 0 THEN 'National' WHEN 1 THEN 'Municipality' WHEN 2 THEN 'Province' WHEN 3 THEN 'International' WHEN 4 THEN 'Local' ELSE 'Unknown' END AS scope,
          CASE WHEN k < 3 THEN province ELSE '' END AS provinces, CASE WHEN k = 1 THEN town ELSE '' END AS municipalities, CASE WHEN k = 1 THEN low || '-' || (low + 500) || '|' || (low + 500) ELSE '' END AS postal_codes FROM o""",
    "s20_order_shares": """WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS k, o_orderkey % 90 + 10 AS n, o_orderkey % 50 + 1 AS m FROM orders)
        SELECT o_orderkey, CASE k WHEN 0 THEN n || '%|' || m || ' %' WHEN 1 THEN n || '%' ELSE '' END AS percentages,
          CASE k WHEN 0 THEN 'Minimum of ' || n || '% black ownership|' || n || '% black|' || m || ' % women' WHEN 1 THEN 'At least ' || n || '% shareholding' ELSE '' END AS thresholds, 'First ' || m || '.|Second!|Third' AS items FROM o""",
    "m5_order_amounts": """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, (o_orderkey % 50 + 1) * 1e6 AS x, (o_orderkey % 100 + 100) * 1e6 AS y, (o_orderkey % 100 + 250) * 1e6 AS z, floor(o_totalprice) AS a FROM orders)
        SELECT o_orderkey, CASE WHEN k = 0 THEN y END::DOUBLE AS ideal_low, CASE WHEN k = 0 THEN z END::DOUBLE AS ideal_high, CASE k WHEN 0 THEN x WHEN 1 THEN a END::DOUBLE AS least, CASE WHEN k = 1 THEN a * 2 END::DOUBLE AS most,
          CASE WHEN k = 2 THEN x END::DOUBLE AS range_low, CASE WHEN k = 2 THEN z END::DOUBLE AS range_high, CASE WHEN k > 1 THEN 'ZAR' END AS implied, x::DOUBLE AS turnover_low, z::DOUBLE AS turnover_high FROM o""",
    "g13_part_categories": """WITH w AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS w FROM part), t AS (SELECT p_partkey, lower(concat_ws(' ', p_name, p_type, p_brand)) AS said FROM part),
        h AS (SELECT p_partkey, length(w) AS n, w FROM t JOIN w ON contains(said, lower(w)))
        SELECT p_partkey, 'letters ' || n AS category, round(least(0.75, 0.6 + 0.1 * count(*)), 4)::DOUBLE AS confidence, string_agg(w, '|' ORDER BY w) AS terms FROM h GROUP BY p_partkey, n""",
    "b15_supplier_sites": """WITH s AS (SELECT *, 'k' || (s_suppkey % 400) AS site_key FROM supplier), o AS (SELECT site_key, max(s_suppkey) AS k, arg_max(s_name, s_suppkey) AS name FROM s WHERE s_acctbal >= 5000 GROUP BY site_key),
        n AS (SELECT site_key, max(s_suppkey) AS k, arg_max(s_name, s_suppkey) AS name, arg_max(s_nationkey, s_suppkey) % 3 > 0 AS active FROM s WHERE s_acctbal < 5000 GROUP BY site_key)
        SELECT coalesce(n.site_key, o.site_key) AS site_key, coalesce(n.name, o.name) AS display_name, CASE WHEN n.k IS NULL THEN 'old' ELSE 'https://s.example/' || n.k END AS seeds, CASE WHEN o.k IS NULL THEN '' ELSE 'kept' END AS notes
        FROM o FULL JOIN n USING (site_key) WHERE coalesce(n.active, true)""",
    "b18_customer_users": """WITH c AS (SELECT *, 'u' || c_custkey AS id, lower(c_name) || '@x.example' AS mail FROM customer),
        o AS (SELECT id, mail AS email, upper(c_name) AS full_name, CASE WHEN c_nationkey = 3 THEN 'admin' ELSE 'applicant' END AS role FROM c WHERE c_acctbal > 0),
        n AS (SELECT id, CASE WHEN c_nationkey = 4 THEN '' ELSE mail END AS email, CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE lower(c_name) END AS full_name, CASE WHEN c_nationkey < 2 THEN 'admin' ELSE 'applicant' END AS role FROM c WHERE c_mktsegment <> 'BUILDING'),
        u AS (SELECT coalesce(n.id, o.id) AS id, coalesce(n.email, o.email) AS email, coalesce(n.full_name, o.full_name) AS full_name, coalesce(o.role, n.role) AS role FROM o FULL JOIN n USING (id))
        SELECT *, role = 'admin' AS admin FROM u""",
    "k10_event_evidence": f"""WITH e AS (SELECT user_id AS program_id, event_type AS field, event_id % 4 AS way, event_id % 997 / 1000 AS confidence, 'v' || (event_id % 7) AS value FROM events),
        r AS (SELECT *, CASE way WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS rank FROM e), b AS (SELECT program_id, field, round(arg_max(confidence, (rank, confidence)), 4) AS c FROM r GROUP BY ALL),
        p AS (SELECT program_id, count(*) FILTER (WHERE way = 1) % 2 = 0 AS bare, arg_max(value, (confidence, value)) FILTER (WHERE field = 'click') AS click, arg_max(value, (confidence, value)) FILTER (WHERE field = 'view') AS view,
            list_sort(list_distinct(list(value) FILTER (WHERE field = 'purchase' AND value <> 'v1'))) AS bought, max(confidence) FILTER (WHERE field = 'click') AS sure FROM e GROUP BY program_id)
        SELECT program_id, CASE WHEN bare THEN coalesce(click, '') ELSE 'kept' END AS click, view, array_to_string(list_concat(['own', 'V1'], coalesce(bought, [])), '|') AS purchase, greatest(0.5, coalesce(sure, 0))::DOUBLE AS sure_click,
          (SELECT c FROM b WHERE b.program_id = p.program_id AND field = 'click')::DOUBLE AS best_click, (SELECT arg_min(field, (-c, field)) FROM b WHERE b.program_id = p.program_id) AS surest FROM p""",
    "c17_programme_views": f"""WITH {PROGRAMMES_SQL}, v AS (SELECT *, CASE WHEN trim(coalesce(funder_name, '')) <> '' THEN trim(funder_name) WHEN sk % 46 = 0 THEN 'Unknown provider' ELSE 'www.example.com' END AS provider FROM programmes)
        SELECT pid AS program_id, provider, source_url, CASE WHEN pk % 2 = 0 AND trim(coalesce(source_title, '')) <> '' THEN trim(source_title) ELSE provider END AS source_name, concat_ws('|', province, geography_scope) AS geography,
          CASE WHEN lower(funding_type) IN ('grant', 'equity', 'loan', 'guarantee', 'hybrid') THEN lower(funding_type) ELSE 'unknown' END AS funding_type,
          CASE WHEN deadline_date IS NULL THEN CASE WHEN deadline_type IN ('Open', 'Rolling') THEN 'active' ELSE 'draft' END WHEN deadline_date < DATE '{AS_OF}' THEN 'closed' WHEN deadline_date - DATE '{AS_OF}' <= 14 THEN 'closing_soon' ELSE 'active' END AS status,
          CASE WHEN pk % 3 > 0 THEN (conf_a + conf_b) / 2 ELSE 0.5 END::DOUBLE AS scrape_confidence, approval_status FROM v""",
    "e10_best_orders": """WITH o AS (SELECT *, floor(o_totalprice / 1000)::BIGINT AS c FROM orders)
        SELECT arg_max(o_orderkey, (c, -o_orderkey)) AS ord, min(o_orderkey) AS first_ord, max(c) AS confidence FROM o GROUP BY o_orderstatus, lower(o_orderpriority), o_custkey % 100""",
    "j1_order_sites": """WITH s AS (SELECT s_suppkey AS ord, 'd' || (s_suppkey % 70) || '.org' AS host, CASE WHEN s_nationkey > 4 THEN lower(s_name) ELSE 's' || s_suppkey END AS name FROM supplier),
        h AS (SELECT host, min(ord) AS a FROM s GROUP BY host), n AS (SELECT name, min(ord) AS b FROM s GROUP BY name)
        SELECT o_orderkey, 's' || least(a, b) AS site_key FROM orders LEFT JOIN h ON host = 'd' || (o_custkey % 90) || '.org' LEFT JOIN n ON name = printf('supplier#%09d', o_custkey % 150)""",
    "h23_order_drafts": """WITH d AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE lower(o_orderpriority) END AS name FROM orders),
        g AS (SELECT min(o_orderkey) AS draft, o_custkey, bool_or(o_orderkey % 40 = 1) AS typed, bool_or(o_orderkey % 2 = 0) AS told, max(o_orderkey % 60 + 40) AS c, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS lines FROM d WHERE name <> '' GROUP BY name, o_custkey)
        SELECT draft, 'https://s.org/' || o_custkey AS url, CASE WHEN typed THEN 'Grant' ELSE 'Unknown' END AS funding_type, CASE WHEN told THEN (o_custkey % 50 + 1) * 1e6 END::DOUBLE AS ticket_min, CASE WHEN told THEN (o_custkey % 50 + 60) * 1e6 END::DOUBLE AS ticket_max,
          CASE WHEN typed THEN c / 100.0 ELSE least(c / 100.0, 0.55) END::DOUBLE AS sure, CASE WHEN c < 70 THEN 'web_search_confidence_below_70' ELSE '' END AS review, lines FROM g""",
    "j13_order_sources": """WITH s AS (SELECT DISTINCT o_custkey, 'https://S' || (o_orderkey % 9) || '.org/?utm_source=x' AS url, o_orderkey % 4 + 1 AS rank FROM orders),
        r AS (SELECT o.o_orderkey AS draft, s.url, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY (s.url <> 'https://S' || (o.o_custkey % 9) || '.org/?utm_source=x')::INT, rank, s.url) AS n FROM orders o JOIN s USING (o_custkey))
        SELECT draft, sha256(string_agg(url, '|' ORDER BY n)) AS sources_sha256, count(*)::INT AS n FROM r WHERE n <= 8 GROUP BY draft""",
    "e1_order_stars": "SELECT o_orderkey AS ord, min(o_orderkey) OVER (PARTITION BY o_custkey % 300, o_custkey % 7) AS cluster FROM orders",
    "b19_patches": """SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN 'HOUSEHOLD' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal BETWEEN 1000 AND 1999.9999 THEN 0 ELSE c_acctbal END AS c_acctbal,
        CASE WHEN (c_acctbal < 1000 AND c_mktsegment <> 'HOUSEHOLD') OR c_acctbal BETWEEN 1000 AND 1999.9999 THEN '1995-01-01' ELSE '1990-01-01' END AS updated_at FROM customer""",
    "t4_checkpoints": """WITH e AS (SELECT event_id AS checkpoint_id, user_id % 50 AS run_id, ts FROM events)
        SELECT checkpoint_id, run_id, row_number() OVER (ORDER BY ts DESC, checkpoint_id) = 1 AS newest FROM e QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, checkpoint_id) <= 2""",
    "b10_uploads": "SELECT count(*) AS stored, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS kinds FROM part",
    "c12_checked_amounts": """WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderkey % 12 AS m, floor(o_totalprice) AS a FROM orders)
        SELECT o_orderkey, CASE WHEN k IN (0, 5) THEN a END::DOUBLE AS low, CASE WHEN k IN (0, 5) THEN a * 2 END::DOUBLE AS high, CASE WHEN m = 6 THEN a * 10 END::DOUBLE AS budget, CASE WHEN k IN (0, 5) THEN 'ZAR' END AS currency,
          CASE k WHEN 0 THEN CASE WHEN m = 0 THEN 'invalid_money_context' END WHEN 3 THEN 'weak_money_evidence' WHEN 5 THEN 'weak_money_evidence' ELSE 'invalid_money_context' END AS reason,
          CASE WHEN k IN (1, 2, 4) THEN 'invalid money evidence context' WHEN k = 3 THEN 'money amount could not be validated from evidence' END AS error FROM o""",
    "x2_page_adapters": r"""WITH p AS (SELECT page_id, lower(url) AS low, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]*)', 1), '^www[.]', '') AS host, string_split(regexp_extract(url, '^https?://([^/?#]*)', 1), '.') AS raw,
            rtrim(regexp_extract(lower(url), '^https?://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages),
        ad AS (SELECT DISTINCT array_to_string(raw[-3:], '.') AS d FROM p WHERE len(raw) > 2 AND array_to_string(raw[-3:], '.') LIKE 'th%' UNION SELECT DISTINCT raw[-1] FROM p WHERE raw[-1] IN ('com', 'org')),
        h AS (SELECT DISTINCT host FROM p), up AS (SELECT host, arg_max(d, length(d)) AS d FROM h JOIN ad ON host = d OR ends_with(host, '.' || d) GROUP BY host),
        down AS (SELECT host, arg_min(d, (length(d), d)) AS d FROM h JOIN ad ON ends_with(d, '.' || host) GROUP BY host),
        f AS (SELECT p.*, coalesce(up.d, down.d) AS d FROM p LEFT JOIN up USING (host) LEFT JOIN down USING (host)),
        g AS (SELECT *, d IS NOT NULL AND length(d) % 2 = 0 AS own, page_id % 3 AS r FROM f)
        SELECT page_id, d AS adapter_key, CASE WHEN own AND length(d) > 14 THEN length(d) - 14 WHEN d IS NOT NULL THEN 50 END::INT AS max_pages, CASE WHEN d IS NOT NULL THEN (NOT own)::INT END AS strict_path_prefixes, CASE WHEN d IS NOT NULL THEN 'balanced' END AS crawl_mode,
          CASE WHEN own THEN 'c' WHEN d IS NOT NULL THEN 'b' END AS alias, CASE WHEN own THEN 2 WHEN d IS NOT NULL THEN 1 ELSE -1 END::INT AS n_aliases,
          CASE WHEN d IS NOT NULL AND contains(low, '/en/1') THEN 'child' WHEN own AND contains(low, '/es/') THEN 'parent' WHEN d IS NOT NULL AND contains(low, 'page=2') THEN CASE WHEN r <= 1 THEN 'support-document' ELSE 'detail' END
            WHEN d IS NOT NULL AND (path = CASE WHEN own THEN '/de' ELSE '/fr' END OR starts_with(path, CASE WHEN own THEN '/de/' ELSE '/fr/' END)) THEN 'programme_index_page' WHEN r > 1 THEN 'listing'
            WHEN page_id % 5 = 0 THEN CASE WHEN r > 0 THEN 'detail' ELSE 'support' END WHEN page_id % 4 > 0 THEN CASE WHEN page_id % 4 > 2 THEN 'listing' ELSE 'detail' END WHEN page_id % 11 > 8 THEN 'listing' ELSE 'generic_content' END AS role FROM g""",
    "b13_publish_feed": """WITH l AS (SELECT *, CASE WHEN o_totalprice > 400000 THEN 3 WHEN o_totalprice > 250000 THEN 2 WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS step FROM orders)
        SELECT o_orderkey AS program_id, CASE step WHEN 3 THEN 'again' WHEN 1 THEN upper(o_orderpriority) ELSE o_orderpriority END AS name, 'approved' AS approval_status, CASE WHEN step > 0 THEN 'new' ELSE 'old' END AS published_at, 'approved' AS source_approval_status
        FROM l WHERE step = 3 OR (step = 1 AND o_totalprice > 100000) OR (step = 0 AND o_orderstatus <> 'O')""",
    "a16_paged_table": "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_brand = 'Brand#2'",
    "w1_titles_by_locale": r"""WITH w AS (SELECT unnest(regexp_split_to_array(substr(text, 1, 400), '[\s\x{0B}!-/:-@\[-`{-~]+')) AS title FROM documents),
        n AS (SELECT DISTINCT title FROM (SELECT title FROM w UNION ALL SELECT p_name FROM part UNION ALL SELECT c_mktsegment FROM customer) WHERE title <> '')
        SELECT title, row_number() OVER (ORDER BY icu_sort_key(title, 'und'), title) AS place FROM n""",
    "m9_order_speeds": """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey % 7 AS p, o_orderkey % 20 + 1 AS n, o_orderkey % 20 + 9 AS m FROM orders)
        SELECT o_orderkey, CASE k WHEN 0 THEN n * 7 WHEN 3 THEN NULL ELSE n END::INT AS low, CASE k WHEN 0 THEN m * 7 WHEN 1 THEN n WHEN 2 THEN m END::INT AS high,
          CASE k WHEN 0 THEN 'Turnaround is ' || n || ' to ' || m || ' weeks.' WHEN 1 THEN 'Processing time: within ' || n || ' days.' WHEN 2 THEN 'Processing time ' || n || '-' || m || ' days.' END AS said,
          CASE p WHEN 0 THEN 'interest-only period then principal repayment' WHEN 1 THEN 'bullet repayment' WHEN 2 THEN 'repayment linked to cash flow' WHEN 3 THEN 'weekly repayments' WHEN 4 THEN 'moratorium applies'
            ELSE CASE WHEN o_orderkey % 2 = 1 THEN 'monthly instalments' END END AS structure FROM o""",
    "h26_page_routes": f"""WITH {_SECTIONS_SQL}, p AS (SELECT page_id, {_PLAIN("regexp_extract(html, '<title>([\\s\\S]*?)</title>', 1)")} AS title, {_PLAIN("regexp_extract(html, '<h1>([\\s\\S]*?)</h1>', 1)")} AS head,
            {_LINES("regexp_extract(html, '<article>([\\s\\S]*?)</article>', 1)")} AS inner_, {_LINES("regexp_extract(html, '(<div class=\"ad\">[\\s\\S]*?</article>)', 1)")} AS every, (SELECT count(*) FROM s WHERE s.page_id = pages.page_id) AS n FROM pages),
        i AS (SELECT page_id, n, head, 0 AS place, 'title' AS kind, '' AS label, title AS content FROM p UNION ALL SELECT page_id, n, head, 1, 'heading', '', head FROM p
          UNION ALL SELECT page_id, n, head, 2, 'section', head, array_to_string({_ONCE('inner_[2:]')}, chr(10)) FROM p UNION ALL SELECT page_id, n, head, 3, 'body', '', array_to_string({_ONCE('every')}, chr(10)) FROM p),
        j AS (SELECT * FROM i WHERE trim(content) <> '' QUALIFY row_number() OVER (PARTITION BY page_id, lower(label || '|' || content) ORDER BY place) = 1),
        k AS (SELECT *, lower(trim(regexp_replace(label || ' ' || content, '\\s+', ' ', 'g'))) AS low FROM j),
        b AS (SELECT *, concat_ws('|', {", ".join(f"CASE WHEN {_any_sql('low', w)} THEN '{n}' END" for n, w in evidence.BUCKETS.items())}) AS hit FROM k)
        SELECT page_id, place::INT AS place, kind, CASE WHEN n > 1 AND kind IN ('title', 'heading') THEN 'program' WHEN n > 1 AND kind = 'body' THEN 'supporting' WHEN hit <> '' THEN hit WHEN kind = 'body' THEN 'supporting' ELSE 'program' END AS buckets FROM b""",
    "h17_order_evidence": """WITH o AS (SELECT *, o_orderkey % 7 AS k, floor(o_totalprice)::BIGINT AS a FROM orders),
        e AS (SELECT o_custkey AS page, o_orderkey AS place, unnest(CASE k
            WHEN 0 THEN [{'f': 'program_name', 'v': 'Seed ' || o_orderstatus, 'c': 0.95}, {'f': 'funder_name', 'v': 'Agency of Trade', 'c': 0.9}, {'f': 'source_page_title', 'v': 'Seed ' || o_orderstatus || ' | Agency of Trade', 'c': 0.9}]
            WHEN 1 THEN [{'f': 'raw_offer', 'v': 'Loan funding from R' || a || ' to R' || (a * 2) || ' on offer.', 'c': 0.82}, {'f': 'ticket_min', 'v': a::VARCHAR, 'c': 0.9}, {'f': 'ticket_max', 'v': (a * 2)::VARCHAR, 'c': 0.9}, {'f': 'budget_total', 'v': (a * 2)::VARCHAR, 'c': 0.9}, {'f': 'currency', 'v': 'ZAR', 'c': 0.9}]
            WHEN 2 THEN [{'f': 'raw_application', 'v': 'Apply at https://a.example/apply/' || (o_orderkey % 5) || ' today.', 'c': 0.82}, {'f': 'application_url', 'v': 'https://a.example/apply/' || (o_orderkey % 5), 'c': 0.86}, {'f': 'application_channel', 'v': 'Online form', 'c': 0.82}]
            WHEN 3 THEN [{'f': 'raw_application', 'v': 'Contact us by email: d' || (o_orderkey % 7) || '@a.example', 'c': 0.75}, {'f': 'contact_email', 'v': 'd' || (o_orderkey % 7) || '@a.example', 'c': 0.9}]
            WHEN 4 THEN [{'f': 'geography_scope', 'v': 'Municipality', 'c': 0.72}]
            WHEN 5 THEN [{'f': 'raw_terms', 'v': 'Deadline: 2027-03-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0'), 'c': 0.8}, {'f': 'deadline_date', 'v': '2027-03-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0'), 'c': 0.88}, {'f': 'deadline_type', 'v': 'FixedDate', 'c': 0.8}]
            ELSE [] END) AS x FROM o)
        SELECT page, x.f AS field, arg_min(x.v, place) AS value, max(x.c)::DOUBLE AS confidence, count(*) AS n FROM e GROUP BY page, x.f""",
}
