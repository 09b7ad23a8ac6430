"""Extraction queries over pages, documents and templated texts, with the SQL they equal where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, dates, money, text, urls
from ..operators import builder, resolve, sections
from ..operators.matching import ranked_per
from ..sources import html
from .views import kept, table

KEYWORDS, IRRELEVANT = ("/en/", "blog", "html"), ("ads-track", "/login")


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page url in four spellings of one address."""
    u = F.col("url")
    shouted = F.regexp_replace(u, "^https?://[^/]*", "")
    head = F.regexp_extract(u, "^(https?://[^/]*)", 1)
    forms = F.array(u, F.concat(F.upper(head), shouted), F.concat(u, F.lit("#part")), F.concat(F.regexp_replace(u, "[?#].*$", ""), F.lit("?utm_medium=mail&b=2&a=1")))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("form", "url"))


_URLS_SQL = """forms AS (SELECT page_id, unnest([0, 1, 2, 3]) AS form, unnest([url, upper(regexp_extract(url, '^(https?://[^/]*)', 1)) || regexp_replace(url, '^https?://[^/]*', ''),
    url || '#part', regexp_replace(url, '[?#].*$', '') || '?utm_medium=mail&b=2&a=1']) AS url FROM pages)"""


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form, host and domain."""
    u = F.col("url")
    return _urls(spark, sf_dir).select("page_id", "form", urls.canonical(u).alias("canonical"), urls.host(u).alias("host"), urls.domain(u).alias("domain"))


def url_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of a site that matter, best first; of a link's spellings the best score counts."""
    u = F.col("url")
    found = _urls(spark, sf_dir).filter("form in (0, 3)").filter(urls.same_site(u, F.concat(F.lit("http://"), urls.domain(u)))).select(urls.canonical(u).alias("link"), urls.host(u).alias("host"), urls.relevance(u, F.lit(""), KEYWORDS, IRRELEVANT).alias("score"))
    best = found.groupBy("host", "link").agg(F.max("score").alias("score")).filter("score > 0")
    return ranked_per(best, ["host"], [F.desc("score"), F.col("link")], kept)


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H2, H3, H4, H5, H6, H7: title, counts and size of each parsed page."""
    d = html.documents(table(spark, sf_dir, "pages"))
    return d.select(
        F.col("id").alias("page_id"), "title", F.size("headings").alias("n_headings"), F.size("links").alias("n_links"),
        F.size("sections").alias("n_sections"), F.length("text").alias("text_chars"),
    )


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages as candidate records, best per label."""
    return html.candidates(html.documents(table(spark, sf_dir, "pages"))).select("id", "place", "heading", F.length("content").alias("chars"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses, phone-like numbers and urls of each document that has any."""
    t = F.col("text")
    d = table(spark, sf_dir, "documents").select("doc_id", text.emails(t).alias("e"), text.phones(t).alias("p"), text.urls(t).alias("u"))
    return d.filter("size(e) + size(p) + size(u) > 0").select("doc_id", F.array_join("e", "|").alias("emails"), F.size("p").alias("n_phones"), F.size("u").alias("n_urls"))


def built_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, with whether and why it would be dropped."""
    r = builder.page_records(table(spark, sf_dir, "pages"), F.lit("2026-01-10").cast("date"), kept=kept)
    return r.select("id", "page_type", "page_role", "program_name", "funder_name", "funding_type", "application_channel", "persist.ok", "acceptance", F.size("raw_criteria").alias("n_criteria"))


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.documents(table(spark, sf_dir, "pages"), built=True)


def section_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: every heading of every page in its tree."""
    t = sections.section_tree(_built(spark, sf_dir))
    return t.select(F.col("id").alias("page_id"), "node", "parent", "depth", "last", "level", "heading", F.length("content").alias("chars"), F.sha2("content", 256).alias("content_sha256"))


def section_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section with the headings above it and the text of all sections under it."""
    t = sections.subtrees(_built(spark, sf_dir))
    return t.select(F.col("id").alias("page_id"), "node", F.array_join("path", " > ").alias("path"), F.sha2("text", 256).alias("text_sha256"))


def scoped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each page that is its article, without tables."""
    t = sections.scoped_text(_built(spark, sf_dir), include=("article",), exclude=("table", ".share"))
    return t.select(F.col("id").alias("page_id"), F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


BLOCK_WORDS = ("funding", "grant", "the", "una")


def element_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of pages that may hold a programme."""
    b = sections.element_blocks(_built(spark, sf_dir), BLOCK_WORDS, (".ad",))
    return b.select(F.col("id").alias("page_id"), "tag", "heading", F.length("content").alias("chars"), F.sha2("content", 256).alias("content_sha256"))


def content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages, where of those that say the same the fuller one stays."""
    b = sections.content_blocks(_built(spark, sf_dir))
    return b.select(F.col("id").alias("page_id"), "place", "heading", F.sha2("content", 256).alias("content_sha256"))


def record_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record with the block that it is of."""
    docs = kept(html.with_links(_built(spark, sf_dir)), "built-pages")
    records = builder.document_records(docs, F.lit("2026-01-10").cast("date")).withColumn("record", F.lit(0))
    best = sections.best_blocks(records, sections.content_blocks(docs))
    return best.select(F.col("id").alias("page_id"), "place", "heading", "score", F.length("content").alias("chars"))


TAXONOMY = {"articles": ("the", "der", "la", "le"), "links": ("and", "und", "et", "y"), "places": ("in", "on", "dans", "en", "von")}


def keyword_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of each document whose phrases it holds, as whole words."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.categories(F.col("text"), TAXONOMY), "|").alias("categories"))


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made of order prices by six templates."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("a"), (F.floor("o_totalprice") * 2 + 1000).cast("long").alias("b"), F.col("o_orderdate").cast("date").alias("day"))
    k = F.col("o_orderkey") % 6
    say = (
        F.when(k == 0, F.format_string("Grant funding between R%d and R%d for firms.", "a", "b"))
        .when(k == 1, F.format_string("Loan funding of up to R%d is on offer.", "b"))
        .when(k == 2, F.format_string("Equity investment with a minimum of $%d each.", "a"))
        .when(k == 3, F.format_string("Funding from R%d million to R%d million by guarantee.", F.col("a") % 90 + 1, F.col("a") % 90 + 100))
        .when(k == 4, F.format_string("The fund pays R%d as blended finance.", "a"))
        .otherwise(F.format_string("Call 011 %d for tender number %d.", "a", "b"))
    )
    return o.select("o_orderkey", "a", "b", "day", say.alias("offer"))


def money_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 to M4: bounds and currency read from templated texts; the oracle has the numbers put in."""
    d = _offers(spark, sf_dir).withColumn("m", money.money_range_of("offer", F.lit(None).cast("string")))
    return d.select("o_orderkey", F.col("m.low").alias("low"), F.col("m.high").alias("high"), F.col("m.currency").alias("currency"))


def offer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding type, confidence and scope of templated texts."""
    d = _offers(spark, sf_dir).withColumn("g", classify.funding_type(F.col("offer")))
    return d.select("o_orderkey", F.col("g.type").alias("type"), F.col("g.confidence").alias("confidence"), classify.scope(F.concat("offer", F.lit(" Provincial scheme"))).alias("scope"))


def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadline kind and date, and months, read from templated texts."""
    k = F.col("o_orderkey") % 4
    d = _offers(spark, sf_dir)
    say = (
        F.when(k == 0, F.concat(F.lit("Apply by "), F.date_format("day", "d MMMM yyyy"), F.lit(" for 12 to 36 months")))
        .when(k == 1, F.concat(F.lit("Closing date "), F.date_format("day", "yyyy-MM-dd"), F.lit(", up to 5 years")))
        .when(k == 2, F.lit("Reviewed on a rolling basis, 6 months"))
        .otherwise(F.lit("Applications are open"))
    )
    d = d.select("o_orderkey", dates.deadline_of(say, F.lit("1995-01-01").cast("date")).alias("d"), classify.month_range(say).alias("m"))
    return d.select("o_orderkey", F.col("d.kind").alias("kind"), F.col("d.day").cast("string").alias("day"), F.col("m.low").alias("low"), F.col("m.high").alias("high"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("d"), F.col("o_custkey") % 200).alias("domain"),
        F.when(F.col("o_orderkey") % 9 == 0, "Eligibility").otherwise(F.col("o_orderpriority")).alias("name"),
        F.col("o_orderstatus").alias("funder"), F.lit("").alias("parent"), F.concat(F.lit("u"), F.col("o_custkey")).alias("url"),
        F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).alias("amount"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("completeness"),
        F.array(F.col("o_orderpriority"), F.concat(F.lit("s"), F.col("o_orderstatus"))).alias("tags"),
    )


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, clustered by keys and merged."""
    c = resolve.clusters(_records(spark, sf_dir))
    m = resolve.merged(c, ["amount"], ["tags"])
    return m.select("cluster", "size", "survivor", "amount", F.array_join(F.array_sort("tags"), "|").alias("tags"))


_OFFER_SQL = "SELECT *, o_orderkey % 6 AS k, floor(o_totalprice)::BIGINT AS a, floor(o_totalprice)::BIGINT * 2 + 1000 AS b, CAST(o_orderdate AS DATE) AS d FROM orders"
_CANON = r"""lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))
    || CASE WHEN regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/$', '') END
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p LIKE '%=_%' AND NOT p LIKE 'utm_%')), '&'), ''), '')"""
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"

QUERIES = {
    "u1_canonical_urls": canonical_urls,
    "u6_url_scores": url_scores,
    "h1_parsed_pages": parsed_pages,
    "h13_page_candidates": page_candidates,
    "h9_section_trees": section_trees,
    "h10_element_blocks": element_blocks,
    "h11_subtrees": section_subtrees,
    "h11_scoped_pages": scoped_pages,
    "h12_content_blocks": content_blocks,
    "h15_page_records": built_records,
    "h20_record_blocks": record_blocks,
    "s7_contacts": contacts,
    "s11_keyword_map": keyword_map,
    "m4_money_ranges": money_ranges,
    "g1_offer_types": offer_types,
    "m12_deadlines": deadlines,
    "e6_merged_records": merged_records,
}

# Pages as SQL reads them: an article holds one heading, paragraphs, and paragraphs that begin with a line in bold.
_PLAIN = lambda x: f"""regexp_replace(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')"""
_LINES = lambda x: f"""list_filter(list_transform(string_split(regexp_replace(replace({x}, chr(10), ' '), '<[^>]*>', chr(10), 'g'), chr(10)), lambda y: {_PLAIN('y')}), lambda y: y <> '')"""
_ONCE = lambda x: f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"
_SECTIONS_SQL = f"""a AS (SELECT page_id, regexp_extract(html, '<article>([\\s\\S]*?)</article>', 1) AS body FROM pages),
    q AS (SELECT page_id, unnest(string_split(replace(replace(body, '<h1>', chr(1) || '1'), '<p><b>', chr(1) || '7'), chr(1))[2:]) AS part, unnest(range(len(string_split(replace(replace(body, '<h1>', chr(1) || '1'), '<p><b>', chr(1) || '7'), chr(1))) - 1))::INT AS node FROM a),
    r AS (SELECT page_id, node, left(part, 1)::INT AS level, {_PLAIN("regexp_extract(part, '^.([\\s\\S]*?)(?:</h1>|<br>)', 1)")} AS heading, {_LINES("regexp_replace(part, '^.[\\s\\S]*?(?:</h1>|<br>)', '')")} AS lines FROM q),
    s AS (SELECT page_id, node, level, heading, array_to_string({_ONCE('lines')}, chr(10)) AS content, CASE WHEN level = 1 THEN -1 ELSE 0 END::INT AS parent,
        CASE WHEN level = 1 THEN 0 ELSE 1 END::INT AS depth, CASE WHEN level = 1 THEN max(node) OVER (PARTITION BY page_id) ELSE node END::INT AS last FROM r)"""
_ONE_OF = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"

_HITS = lambda ws: "regexp_matches(lower(coalesce(text, '')), '(^|[^0-9a-z])(" + "|".join(ws) + ")([^0-9a-z]|$)')"
ORACLE_SQL = {
    "h9_section_trees": f"WITH {_SECTIONS_SQL} SELECT page_id, node, parent, depth, last, level, heading, length(content)::INT AS chars, sha256(content) AS content_sha256 FROM s",
    "h11_subtrees": f"""WITH {_SECTIONS_SQL}, u AS (SELECT x.page_id, x.node, y.node AS k, CASE WHEN y.node = x.node THEN y.content WHEN y.content = '' THEN y.heading ELSE y.heading || chr(10) || y.content END AS said
          FROM s AS x JOIN s AS y ON x.page_id = y.page_id AND y.node BETWEEN x.node AND x.last)
        SELECT page_id, node, CASE WHEN depth = 0 THEN heading ELSE (SELECT heading FROM s AS t WHERE t.page_id = s.page_id AND t.node = 0) || ' > ' || heading END AS path,
          (SELECT sha256(coalesce(string_agg(said, chr(10) ORDER BY k) FILTER (WHERE said <> ''), '')) FROM u WHERE u.page_id = s.page_id AND u.node = s.node) AS text_sha256 FROM s""",
    "h11_scoped_pages": f"""WITH a AS (SELECT page_id, array_to_string({_LINES("regexp_extract(html, '<article>([\\s\\S]*?)</article>', 1)")}, chr(10)) AS t FROM pages)
        SELECT page_id, length(t)::INT AS chars, sha256(t) AS text_sha256 FROM a""",
    "h10_element_blocks": f"""WITH b AS (SELECT page_id, 'article' AS tag, {_PLAIN("regexp_extract(html, '<h1>([\\s\\S]*?)</h1>', 1)")} AS heading,
            array_to_string({_LINES("regexp_extract(html, '<article>([\\s\\S]*?)</article>', 1)")}, ' ') AS content FROM pages
          UNION ALL SELECT page_id, 'div', '', {_PLAIN("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")} FROM pages)
        SELECT page_id, tag, heading, length(content)::INT AS chars, sha256(content) AS content_sha256 FROM b
        WHERE length(content) BETWEEN 40 AND 3500 AND lower(heading) NOT IN ({", ".join(f"'{h}'" for h in sections.PART_HEADINGS)})
          AND (length(content) >= 120 OR {_ONE_OF('lower(content)', BLOCK_WORDS)} OR (length(heading) >= 4 AND {_ONE_OF('lower(heading)', sections.PROGRAMME_WORDS)}))""",
    "h12_content_blocks": f"""WITH RECURSIVE {_SECTIONS_SQL},
        h AS (SELECT page_id, node, heading, content, lower(heading) AS k, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS c FROM s),
        g AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY node) AS n, {{'heading': heading, 'content': content, 'k': k, 't': CASE WHEN starts_with(c, k) THEN trim(substr(c, length(k) + 1)) ELSE c END}} AS b
          FROM h WHERE k <> '' AND CASE WHEN starts_with(c, k) THEN trim(substr(c, length(k) + 1)) ELSE c END <> ''),
        f(page_id, n, acc) AS (SELECT page_id, n, [b] FROM g WHERE n = 1 UNION ALL
          SELECT page_id, n, CASE WHEN hit > 0 THEN list_transform(acc, lambda o, i: CASE WHEN i = hit AND length(b.k) + length(b.t) > length(o.k) + length(o.t) THEN b ELSE o END) ELSE list_append(acc, b) END
          FROM (SELECT g.page_id, g.n, acc, b, coalesce(list_position(list_transform(acc, lambda o: (contains(o.k, b.k) OR contains(b.k, o.k)) AND (contains(o.t, b.t) OR contains(b.t, o.t))), true), 0) AS hit
            FROM f JOIN g ON g.page_id = f.page_id AND g.n = f.n + 1)),
        z AS (SELECT page_id, unnest(acc) AS b, unnest(range(len(acc)))::INT AS place FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC) = 1)
        SELECT page_id, place, b.heading AS heading, sha256(b.content) AS content_sha256 FROM z
        UNION ALL SELECT page_id, 0, heading, sha256(array_to_string({_ONCE('said')}, chr(10))) FROM (SELECT page_id, {_PLAIN("regexp_extract(html, '<title>([\\s\\S]*?)</title>', 1)")} AS heading,
            {_LINES("regexp_extract(html, '(<div class=\"ad\">[\\s\\S]*?</article>)', 1)")} AS said FROM pages WHERE page_id NOT IN (SELECT page_id FROM z)) AS n""",
    "u1_canonical_urls": f"WITH {_URLS_SQL} SELECT page_id, form, {_CANON} AS canonical, {_HOST} AS host, regexp_replace({_HOST}, '^www[.]', '') AS domain FROM forms",
    "u6_url_scores": f"""WITH {_URLS_SQL}, s AS (SELECT {_CANON} AS link, {_HOST} AS host, CASE WHEN url LIKE '%ads-track%' OR url LIKE '%/login%' THEN -100
          ELSE 5 * (CAST(url LIKE '%/en/%' AS INT) + CAST(url LIKE '%blog%' AS INT) + CAST(url LIKE '%html%' AS INT)) END AS score FROM forms WHERE form IN (0, 3)),
        b AS (SELECT host, link, max(score) AS score FROM s GROUP BY host, link HAVING max(score) > 0)
        SELECT host, link, score, row_number() OVER (PARTITION BY host ORDER BY score DESC, link) AS place FROM b""",
    "s11_keyword_map": "SELECT doc_id, concat_ws('|', " + ", ".join(f"CASE WHEN {_HITS(v)} THEN '{k}' END" for k, v in TAXONOMY.items()) + ") AS categories FROM documents",
    "m4_money_ranges": f"""WITH o AS ({_OFFER_SQL}) SELECT o_orderkey, CASE k WHEN 0 THEN a WHEN 2 THEN a WHEN 3 THEN (a % 90 + 1) * 1e6 END::DOUBLE AS low,
        CASE k WHEN 0 THEN b WHEN 1 THEN b WHEN 3 THEN (a % 90 + 100) * 1e6 WHEN 4 THEN a END::DOUBLE AS high, CASE k WHEN 2 THEN 'USD' WHEN 5 THEN NULL ELSE 'ZAR' END AS currency FROM o""",
    "g1_offer_types": f"""WITH o AS ({_OFFER_SQL}) SELECT o_orderkey, CASE k WHEN 0 THEN 'Grant' WHEN 1 THEN 'Loan' WHEN 2 THEN 'Equity' WHEN 3 THEN 'Guarantee' WHEN 4 THEN 'Hybrid' ELSE 'Unknown' END AS type,
        CASE k WHEN 0 THEN 0.88 WHEN 1 THEN 0.72 WHEN 2 THEN 0.88 WHEN 3 THEN 0.72 WHEN 4 THEN 0.93 ELSE 0 END::DOUBLE AS confidence, 'Province' AS scope FROM o""",
    "m12_deadlines": f"""WITH o AS ({_OFFER_SQL}) SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 'Rolling' WHEN 3 THEN 'Open' ELSE 'FixedDate' END AS kind,
        CASE WHEN o_orderkey % 4 < 2 THEN CAST(d AS VARCHAR) END AS day, CASE o_orderkey % 4 WHEN 0 THEN 12 WHEN 2 THEN 6 END::INT AS low, CASE o_orderkey % 4 WHEN 0 THEN 36 WHEN 1 THEN 60 WHEN 2 THEN 6 END::INT AS high FROM o""",
    "e6_merged_records": """WITH r AS (SELECT o_orderkey AS ord, 'd' || CAST(o_custkey % 200 AS VARCHAR) AS domain, o_orderkey % 9 = 0 AS generic, o_orderpriority AS name, o_orderstatus AS funder, o_custkey AS url,
          CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS amount, floor(o_totalprice / 1000)::BIGINT AS comp FROM orders),
        s AS (SELECT *, min(ord) OVER (PARTITION BY domain, name, funder) AS seed FROM r WHERE NOT generic), p AS (SELECT url, min(seed) AS seed FROM s GROUP BY url),
        own AS (SELECT url, min(ord) AS seed FROM r WHERE generic GROUP BY url),
        c AS (SELECT ord, seed AS cluster, name, funder, amount, comp FROM s UNION ALL
          SELECT ord, coalesce(p.seed, own.seed) AS cluster, name, funder, amount, comp FROM r LEFT JOIN p USING (url) LEFT JOIN own USING (url) WHERE generic),
        t AS (SELECT cluster, unnest([name, 's' || funder]) AS v, ord FROM c),
        u AS (SELECT cluster, string_agg(v, '|' ORDER BY v) AS tags FROM (SELECT DISTINCT cluster, v FROM t) GROUP BY cluster)
        SELECT cluster, count(*) AS size, arg_min(ord, (-comp, ord)) AS survivor, arg_min(amount, (-comp, ord)) FILTER (WHERE amount IS NOT NULL) AS amount, any_value(tags) AS tags
        FROM c JOIN u USING (cluster) GROUP BY cluster""",
}
