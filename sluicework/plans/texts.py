"""Helpers of texts, links, sources and records over the given tables, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, numbers, records, taxonomy, text, urls
from ..operators import catalog, hybrid
from ..sources import files, tables
from ..sources.html import spread
from .given import _choose
from .views import folder, kept, table


def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links made of page urls and titles: documents, rank of their source, how they fit the page."""
    u = F.col("url")
    host = F.regexp_extract("url", "^(https?://[^/?#]*)", 1)
    word = F.regexp_extract(F.lower("html"), "<title>[^<]*?([a-z]{3,})", 1)
    forms = F.array(u, F.concat(host, F.lit("/files/"), word, F.lit("-guide.pdf")), F.concat(F.lit("https://trade.gov/x/"), F.upper(word)), F.lit("https://other.example/a.docx?x=1"), F.lit("https://other.example/a.DOCX"))
    d = table(spark, sf_dir, "pages").select("page_id", host.alias("official"), word.alias("word"), F.posexplode(forms).alias("form", "url"))
    anchor = F.when(F.col("form") == 4, F.concat(F.lit("Download "), "word")).otherwise("")
    return d.select("page_id", "form", urls.is_document(u).alias("document"), urls.source_rank(u, F.col("official")).alias("rank"), urls.document_relevance(u, F.concat(F.lit("the "), "word", F.lit(" and a")), anchor).alias("score"))


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Helpers of texts over the names of parts."""
    n, t, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    items = F.array(n, F.concat(F.upper(n), F.lit("!")), t, F.lit(" "), b)
    said = F.concat(F.lit("About a "), n, F.lit(". It is of "), b, F.lit("! Made as "), t, F.lit("\n\nabout A "), n, F.lit("."))
    title = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Eligibility of "), n)).otherwise(n)
    return spread(table(spark, sf_dir, "part")).select(
        "p_partkey", F.array_join(text.unique_words(items), "|").alias("unique_items"), text.any_contains(F.array(n), F.array(F.lit("RING!"), F.lit(""), F.lit("wid-get"))).alias("any_hit"),
        F.size(text.sentences(said)).alias("n_sentences"), records.best_snippet(F.array(n, t, b)).alias("best"), records.is_support_title(title).alias("support"),
        F.array_join(records.matching_sentences(said, ("about",), 4), "|").alias("about"), text.programme_key(F.concat(n, F.lit(" Funding programme, "), b), b).alias("key"),
    )


def host_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each host."""
    return tables.seeds_by_host(table(spark, sf_dir, "pages").select("page_id", "url"), ord_col="page_id")


def table_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a JSON snapshot, as lines twice, and as CSV, and read again."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.array("o_orderpriority", F.lit('a "b",\n')).alias("tags"), F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(1.0)).alias("extraction_confidence"))
    snap, lines, csv = (folder(spark, n) for n in ("snapshot", "lines", "csv"))
    tables.snapshot(o, snap)
    tables.append_lines(o, lines)
    tables.append_lines(o.filter("o_orderstatus = 'F'"), lines)
    tables.export_csv(o, csv)
    back = [("json", tables.scan_json(spark, snap, o.schema)), ("lines", tables.scan_json(spark, lines, o.schema)), ("none", tables.scan_json(spark, lines + "-no", o.schema))]
    agg = lambda name, d, tag: d.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.max(tag).alias("tag")).select(F.lit(name).alias("source"), "o_orderstatus", "n", "keys", "tag")
    out = agg("csv", spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(csv).withColumn("o_orderkey", F.col("o_orderkey").cast("long")), F.concat_ws("/", F.col("overall_confidence"), F.get_json_object("tags", "$[1]")))
    for name, d in back:
        out = out.union(agg(name, d, F.concat_ws("/", F.col("extraction_confidence")["a"].cast("string"), F.col("tags")[1])))
    return out


def order_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from order to last shipment, and the share of items shipped within 60 days."""
    item = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"), F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first"), F.collect_list("l_shipdate").alias("days"))
    o = table(spark, sf_dir, "orders").join(item, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    soon = F.size(F.filter("days", lambda d: d <= F.col("o_orderdate") + F.expr("interval 60 days")))
    return o.select("o_orderkey", numbers.seconds_between(F.col("o_orderdate"), F.col("last")).alias("seconds"), numbers.percent(F.when(F.col("n").isNull(), 0).otherwise(soon), F.coalesce("n", F.lit(0))).cast("long").alias("soon"))


def stage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages and frequencies told by texts made of orders."""
    k = F.col("o_orderkey")
    say = _choose(k, "Seed money for a start-up that wants to scale.", "For MATURE firms, paid annually or per month", "Growth per quarter", "None", None)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(records.stages(say), "|").alias("stages"), records.first_of(say, records.FREQUENCIES).alias("frequency"))


def hybrid_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of orders as hybrid records, those that may be kept, and their marks."""
    k = F.col("o_orderkey")
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    r = table(spark, sf_dir, "orders").select(
        k.alias("ord"), F.when(k % 7 > 0, F.col("o_orderpriority")).alias("name"), F.when(k % 5 > 0, F.col("o_orderstatus")).otherwise("").alias("funder"), F.when(k % 3 > 0, "u").alias("url"), some(k % 2 == 0).alias("criteria"), some(k % 11 == 0).alias("eligibility"), some(k % 4 == 0).alias("offer"),
        some(F.lit(False)).alias("terms"), some(k % 13 == 0).alias("snippets"), F.when(k % 6 > 1, F.lit(0.0)).alias("ticket_min"), F.when(k % 6 > 3, F.col("o_totalprice")).alias("ticket_max"), F.when(k % 9 > 2, "Loan").alias("funding_type"), (k % 8 == 0).alias("has_evidence"), (k % 100 / 100.0).alias("confidence"), (k % 10 > 4).alias("official"),
    )
    q = hybrid.record_quality(r, F.col("official"))
    held = hybrid.persistable(q, 0.5).select("ord", F.array_join("review", "|").alias("review"), F.lit(True).alias("held"))
    return q.join(held, "ord", "left").select("ord", "hybrid_confidence", "hybrid_completeness", F.array_join("hybrid_reasons", "|").alias("reasons"), F.coalesce("held", F.lit(False)).alias("held"), F.coalesce("review", F.lit("")).alias("review"))


def replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored orders (filled) with those of the batch's customers (open, over 300000) in place."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    batch = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O' and o_totalprice > 300000").select("o_custkey", "o_orderkey", "o_orderstatus")
    return catalog.replace_partition(o.filter("o_orderstatus = 'F'"), batch, "o_custkey")


def dedupe_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the order of merged records (funder, name, domain; null as an empty text), and their place back in the order they came."""
    from ..operators.matching import ranked

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("funder"), F.when(F.col("o_custkey") % 9 > 0, F.col("o_orderpriority")).alias("name"), F.concat(F.lit("d"), F.col("o_custkey") % 50).alias("domain"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return ranked(o, [blank("funder"), blank("name"), blank("domain"), F.col("o_orderkey")], kept).select("o_orderkey", "place")


def page_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a site's rules let a page's url in, its score by depth, and the names that its path tells."""
    u, one = F.col("url"), lambda *x: F.array(*[F.lit(v) for v in x])
    gate = records.url_gate(u, one("PAGE=2"), one("/en/1", "/DE/2"), F.when(F.col("page_id") % 5 > 0, one("/fr", "/es/")), one("example.NET"))
    return table(spark, sf_dir, "pages").select("page_id", gate.alias("passes"), records.crawl_score(u, F.lit(""), ("/en/", "html"), ("#top",), (F.col("page_id") % 3).cast("int")).alias("score"), records.parent_from_path(u).alias("parent"), records.leaf_base(F.concat(F.regexp_replace(u, "[?#].*$", ""), F.lit("-How-to-apply/"))).alias("leaf"))


def document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that documents hold, and their lines, each once, cut to a length."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(taxonomy.signals(t, ("archive", "the ", "und ", "que ", "licensed")), "|").alias("signals"), F.sha2(files.compact(t, 600), 256).alias("compact"))


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts without what a site's patterns match (bad ones passed by), and with its aliases."""
    n = F.col("p_name")
    patterns = F.when(F.col("p_size") % 7 > 0, F.array(F.lit("^(small|red) "), F.lit("("), F.lit("e+[rt]$"), F.lit("x{"), F.lit(None).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", taxonomy.without_patterns(n, patterns).alias("bare"), taxonomy.merge_name(F.concat(n, F.lit("  "), n), {"ring": "loop", "loop ": "", "red": "blue red"}).alias("merged"))


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: totals of budgets told by texts made of orders."""
    k, a = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    say = _choose(k, F.concat(F.lit("Grants of R5m. The total budget is R"), a.cast("string"), F.lit(" a year.")), F.concat(F.lit("A fund size of $"), (k % 90 + 1).cast("string"), F.lit(" million. Budget R1m.")), "No budget is told.", F.concat(F.lit("Grants of R"), a.cast("string")), None)
    return table(spark, sf_dir, "orders").select("o_orderkey", say.alias("t")).select("o_orderkey", money.budget_total("t", F.lit(None).cast("string")).alias("budget"))


def clean_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' texts, lists and maps without NUL characters."""
    dirty = lambda c: F.concat(F.substring(c, 1, 3), F.lit("\0"), F.substring(c, 4, 99), F.lit("\0"))
    c = table(spark, sf_dir, "customer").select("c_custkey", dirty("c_name").alias("name"), F.array(dirty("c_mktsegment"), F.lit(None)).alias("segments"), F.create_map(F.lit("k\0"), F.struct(dirty("c_name").alias("n"))).alias("nested"))
    out = tables.without_nul(c)
    return out.select("c_custkey", "name", F.concat_ws("|", "segments").alias("segments"), F.map_keys("nested")[0].alias("key"), F.map_values("nested")[0]["n"].alias("inner"))


def search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources of searches (one a language), each url once, with kind and rank."""
    p = table(spark, sf_dir, "pages")
    form = F.array(F.col("url"), F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/Brochure.PDF?x=1")), F.col("url"))
    rows = p.select(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("search"), "page_id", F.posexplode(form).alias("n", "url")).select("search", (F.col("page_id") * 3 + F.col("n")).alias("ord"), "url", F.concat(F.lit("t"), "page_id").alias("title"), F.when(F.col("page_id") % 2 == 0, "Example.ORG").otherwise("example.net").alias("domain"))
    return tables.search_sources(rows)


QUERIES = {
    "u3_link_kinds": link_kinds, "s13_part_texts": part_texts, "a20_host_seeds": host_seeds, "b1_round_trips": table_round_trips, "m19_order_durations": order_durations, "g6_order_stages": stage_labels,
    "r10_order_quality": hybrid_quality, "j9_replaced_partitions": replaced_partitions, "w7_dedupe_order": dedupe_order,
    "c3_page_gates": page_gates, "g17_document_signals": document_signals, "s26_clean_names": clean_names, "m6_order_budgets": budgets, "b9_clean_payloads": clean_payloads, "a18_search_sources": search_sources,
}
_WORDS = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_ENDS = "|".join(e.replace(".", "[.]") for e in urls.DOCUMENT_ENDINGS)
_SAYS = "[" + ", ".join(f"'{w}'" for w in urls.CONTEXT_STOPWORDS) + "]"
_TOKENS = lambda c: f"list_filter(list_distinct(regexp_split_to_array(lower({c}), '[^a-z0-9]+')), lambda w: length(w) > 2 AND NOT list_contains({_SAYS}, w))"
ORACLE_SQL = {
    "u3_link_kinds": f"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS official, regexp_extract(lower(html), '<title>[^<]*?([a-z]{{3,}})', 1) AS word, url FROM pages),
        f AS (SELECT page_id, official, word, unnest([0, 1, 2, 3, 4])::INT AS form, unnest([url, official || '/files/' || word || '-guide.pdf', 'https://trade.gov/x/' || upper(word), 'https://other.example/a.docx?x=1', 'https://other.example/a.DOCX']) AS u FROM p),
        g AS (SELECT *, regexp_matches(lower(u), '({_ENDS})$') AS document, CASE WHEN form = 4 THEN 'Download ' || word ELSE '' END AS anchor FROM f)
        SELECT page_id, form, document, CASE WHEN form < 2 THEN 1 WHEN form = 2 THEN 2 WHEN document THEN 3 ELSE 4 END::INT AS rank,
          (CASE WHEN document THEN 4 ELSE 0 END + 4 * len(list_intersect({_TOKENS("'the ' || word || ' and a'")}, list_concat({_TOKENS("regexp_replace(lower(u), '^[a-z][a-z0-9+.-]*://[^/?#]*', '')")}, {_TOKENS('anchor')}))) + CASE WHEN form = 4 THEN 2 ELSE 0 END)::INT AS score FROM g""",
    "s13_part_texts": f"""WITH p AS (SELECT *, {_WORDS('p_name')} AS n, {_WORDS('p_type')} AS t, {_WORDS('p_brand')} AS b FROM part)
        SELECT p_partkey, concat_ws('|', p_name, CASE WHEN t <> n THEN p_type END, CASE WHEN b <> n AND b <> t THEN p_brand END) AS unique_items, contains(n, 'ring') OR contains(n, 'wid get') AS any_hit, 4::INT AS n_sentences,
          CASE WHEN length(p_name) >= length(p_type) AND length(p_name) >= length(p_brand) THEN p_name WHEN length(p_type) >= length(p_brand) THEN p_type ELSE p_brand END AS best, p_size % 5 = 0 AS support, 'About a ' || p_name || '.' AS about,
          array_to_string(list_filter(string_split(n || ' funding programme ' || b, ' '), lambda w: NOT list_contains(list_concat(string_split(b, ' '), ['programme', 'program', 'funding', 'fund']), w)), ' ') AS key FROM p""",
    "a20_host_seeds": "SELECT regexp_extract(lower(url), '^https?://([^/?#]*)', 1) AS host, arg_min(url, page_id) AS url FROM pages GROUP BY ALL",
    "b1_round_trips": """SELECT source, o_orderstatus, CASE WHEN source = 'lines' AND o_orderstatus = 'F' THEN 2 ELSE 1 END * count(*) AS n, (CASE WHEN source = 'lines' AND o_orderstatus = 'F' THEN 2 ELSE 1 END * sum(o_orderkey))::BIGINT AS keys,
          CASE WHEN source = 'csv' THEN '0.75' ELSE '0.5' END || '/a "b",' || chr(10) AS tag FROM orders, (VALUES ('csv'), ('json'), ('lines')) AS s(source) GROUP BY source, o_orderstatus""",
    "m19_order_durations": """WITH i AS (SELECT l_orderkey, max(l_shipdate) AS last, count(*) AS n FROM lineitem GROUP BY l_orderkey),
        s AS (SELECT l_orderkey, count(*) AS soon FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate + INTERVAL 60 DAY GROUP BY l_orderkey)
        SELECT o_orderkey, CASE WHEN last >= o_orderdate THEN epoch(last) - epoch(o_orderdate) END::DOUBLE AS seconds, CASE WHEN n > 0 THEN floor(coalesce(soon, 0) * 100.0 / n + 0.5) ELSE 0 END::BIGINT AS soon
        FROM orders LEFT JOIN i ON i.l_orderkey = o_orderkey LEFT JOIN s ON s.l_orderkey = o_orderkey""",
    "g6_order_stages": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Startup|Growth' WHEN 1 THEN 'Established' WHEN 2 THEN 'Growth' ELSE '' END AS stages, CASE o_orderkey % 5 WHEN 1 THEN 'Monthly' WHEN 2 THEN 'Quarterly' ELSE 'Unknown' END AS frequency FROM orders""",
    "r10_order_quality": """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 7 > 0 AS a, o_orderkey % 5 > 0 AS b, o_orderkey % 3 > 0 AS c, o_orderkey % 2 = 0 OR o_orderkey % 11 = 0 AS e, o_orderkey % 4 = 0 OR o_orderkey % 13 = 0 AS o, o_orderkey % 9 > 2 AS t,
            o_orderkey % 6 > 1 AS m, o_orderkey % 8 = 0 AS v, o_orderkey % 10 > 4 AS f, o_orderkey % 100 / 100.0 AS conf FROM orders),
        q AS (SELECT *, greatest(conf, (a::INT + b::INT + c::INT + f::INT + e::INT + t::INT + m::INT + o::INT + v::INT) / 9.0) AS sure FROM r)
        SELECT k AS ord, round(sure, 4)::DOUBLE AS hybrid_confidence, round((a::INT + b::INT + c::INT + e::INT + t::INT) / 6.0, 4)::DOUBLE AS hybrid_completeness,
          concat_ws('|', CASE WHEN NOT c THEN 'missing_source_url' END, CASE WHEN NOT m THEN 'missing_funding_amount' END, CASE WHEN NOT e THEN 'missing_eligibility' END, CASE WHEN NOT o THEN 'missing_programme_details' END, CASE WHEN sure < 0.7 THEN 'low_confidence' END) AS reasons,
          a AND b AND c AS held, CASE WHEN a AND b AND c AND conf > 0 AND conf < 0.5 THEN 'hybrid_confidence_below_threshold' ELSE '' END AS review FROM q""",
    "j9_replaced_partitions": """WITH b AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000)
        SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM b) UNION ALL SELECT * FROM b""",
    "w7_dedupe_order": "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE o_orderpriority END, 'd' || (o_custkey % 50), o_orderkey) AS place FROM orders",
    "c3_page_gates": r"""WITH p AS (SELECT *, lower(url) AS low, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg FROM pages)
        SELECT page_id, CASE WHEN contains(low, 'page=2') THEN false WHEN contains(low, '/en/1') OR contains(low, '/de/2') THEN true WHEN page_id % 5 = 0 THEN true WHEN starts_with(lower(path), '/fr') OR starts_with(lower(path), '/es/') THEN true ELSE contains(low, 'example.net') END AS passes,
          CASE WHEN NOT contains(low, '#top') THEN 5 * contains(low, '/en/')::INT + 5 * contains(low, 'html')::INT - 2 * (page_id % 3) END::INT AS score,
          CASE WHEN len(list_filter(seg, lambda x: lower(x) NOT IN ('funding', 'programmes', 'programs', 'products', 'services', 'about', 'home', 'en'))) >= 2 THEN upper(seg[1][1]) || seg[1][2:] END AS parent, CASE WHEN ends_with(path, '/') THEN '' ELSE lower(seg[-1]) END AS leaf FROM p""",
    "g17_document_signals": r"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)
        SELECT doc_id, concat_ws('|', CASE WHEN contains(low, 'archive') THEN 'archive' END, CASE WHEN contains(low, 'the ') THEN 'the ' END, CASE WHEN contains(low, 'und ') THEN 'und ' END, CASE WHEN contains(low, 'que ') THEN 'que ' END, CASE WHEN contains(low, 'licensed') THEN 'licensed' END) AS signals,
          sha256(substr(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)), 1, 600)) AS compact FROM d""",
    "s26_clean_names": r"""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN p_name ELSE trim(regexp_replace(regexp_replace(p_name, '^(small|red) ', '', 'g'), 'e+[rt]$', '', 'g')) END AS bare,
        trim(regexp_replace(replace(replace(replace(p_name || ' ' || p_name, 'ring', 'loop'), 'loop ', ''), 'red', 'blue red'), '\s+', ' ', 'g')) AS merged FROM part""",
    "m6_order_budgets": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN (o_orderkey % 90 + 1) * 1e6 END::DOUBLE AS budget FROM orders",
    "b9_clean_payloads": "SELECT c_custkey, c_name AS name, c_mktsegment AS segments, 'k' AS key, c_name AS inner FROM customer",
    "a18_search_sources": r"""WITH u AS (SELECT regexp_extract(url, '/([a-z]{2})/', 1) AS search, page_id, unnest([0, 1, 2]) AS n, unnest([url, regexp_replace(url, '[?#].*$', '') || '/Brochure.PDF?x=1', url]) AS url FROM pages)
        SELECT search, url, arg_min('t' || page_id, page_id * 3 + n) AS title, arg_min(CASE WHEN n = 1 THEN 'official_document' ELSE 'official_website' END, page_id * 3 + n) AS source_type,
          arg_min(CASE WHEN contains(lower(url), CASE WHEN page_id % 2 = 0 THEN 'example.org' ELSE 'example.net' END) THEN 1 ELSE 4 END, page_id * 3 + n)::INT AS official_rank FROM u GROUP BY search, url""",
}
