"""Streams restart where they stopped; the crawl equals a heap."""

import heapq

from pyspark.sql import functions as F

from sluicework.sources import tables
from sluicework.streaming import recovery, visits


def test_replace_and_restart(spark, tmp_path):
    src, store, check = (str(tmp_path / x) for x in ("src", "store", "check"))
    row = "site string, n int"
    spark.createDataFrame([("a", 1), ("b", 1)], row).write.parquet(src + "/one")
    read = lambda: spark.readStream.schema(row).option("recursiveFileLookup", "true").parquet(src)
    visits.run_once(read(), visits.replace_sites(store), check)
    spark.createDataFrame([("a", 2)], row).write.parquet(src + "/two")
    visits.run_once(read(), visits.replace_sites(store), check)
    table = lambda: sorted((r.site, r.n) for r in spark.read.parquet(store).collect())
    assert table() == [("a", 2), ("b", 1)]
    visits.run_once(read(), visits.replace_sites(store), check)  # nothing new: no further batch
    visits.replace_sites(store)(spark.createDataFrame([("a", 2)], row), 9)  # a batch again, under any number
    assert table() == [("a", 2), ("b", 1)]


def test_crawl_is_best_first(spark, tmp_path):
    links = {"r": [("x", 5), ("y", 9)], "y": [("z", 7), ("x", 5)], "z": [("w", 20)]}
    rows = [(s, u, sc) for s, v in links.items() for u, sc in v]
    got = visits.crawl(spark, spark.createDataFrame([("t", "r", 1)], "target string, url string, score int"), spark.createDataFrame(rows, "src string, url string, score int"), str(tmp_path), 10)
    heap, seen, want, born = [(-1, 0, "r", 0)], set(), [], 0
    while heap:
        _, _, url, level = heapq.heappop(heap)
        if url in seen:
            continue
        seen.add(url)
        want.append(url)
        born += 1
        if level < 2:
            for u, sc in links.get(url, []):
                heapq.heappush(heap, (-sc, born, u, level + 1))
    assert [r.url for r in got.orderBy("round").collect()] == want


def test_decision_cache(spark):
    rows = spark.createDataFrame([("p", "t")], "a string, b string").withColumn("key", visits.decision_key("a", "b"))
    cache = rows.select("key", F.lit("reject").alias("decision"), F.lit(0.9).alias("confidence"))
    assert visits.cached_decisions(rows, cache).first().decision == "reject"
    assert visits.cached_decisions(rows, cache.withColumn("confidence", F.lit(0.5))).first().decision is None


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], "x\0y")], "id int, tags array<string>, s string")
    tables.snapshot(df, str(tmp_path / "j"))
    assert tables.scan_json(spark, str(tmp_path / "j"), df.schema).first().tags == ["a"]
    assert tables.scan_json(spark, str(tmp_path / "none"), df.schema).count() == 0
    assert tables.flat(df).first().tags == '["a"]'
    assert tables.without_nul(df).first().s == "xy"
    deep = spark.createDataFrame([(["a\0"], {"k\0": "v\0"}, ("n\0", 1))], "a array<string>, m map<string,string>, s struct<x:string,y:int>")
    assert tuple(tables.without_nul(deep).first()) == (["a"], {"k": "v"}, ("n", 1))
    old = spark.createDataFrame([("Quarterly", ["n"]), ("Monthly", None)], "repayment_frequency string, notes array<string>")
    assert [(r.repayment_frequency, len(r.notes or [])) for r in tables.legacy_payload(old).collect()] == [("Variable", 2), ("Monthly", 0)]
    (tmp_path / "seeds.json").write_text('["https://a.com/1", {"url": "https://b.org"}, {"seed_urls": ["https://c.org/x", "https://a.com/2"]}, {"no": 1}, " "]')
    assert [r.url for r in tables.seed_urls(spark, str(tmp_path / "seeds.json")).orderBy("ord").collect()] == ["https://a.com/1", "https://b.org", "https://c.org/x", "https://a.com/2"]
    rated = tables.search_sources(spark.createDataFrame([(1, 0, "https://a.org/x.pdf?v", "T", "a.org"), (1, 1, "https://a.org/x.pdf?v", "U", "a.org"), (1, 2, "https://z.org", None, "a.org")], "search int, ord int, url string, title string, domain string"))
    assert sorted(tuple(r) for r in rated.collect()) == [(1, "https://a.org/x.pdf?v", "T", "official_document", 1), (1, "https://z.org", None, "official_website", 4)]
    tables.page_snapshots(spark.createDataFrame([("https://www.a.org/", "h"), ("https://a.org/x/Y?z", "i")], "url string, html string"), str(tmp_path / "raw"))
    assert sorted((r.domain, r["name"]) for r in spark.read.parquet(str(tmp_path / "raw")).collect()) == [("a.org", "index"), ("a.org", "x-y")]
    urls = spark.createDataFrame([(2, "https://a.com/2"), (1, "https://a.com/1"), (3, "b.org/x")], "ord int, url string")
    assert sorted(map(tuple, tables.seeds_by_host(urls).collect())) == [("a.com", "https://a.com/1"), ("b.org", "b.org/x")]


def test_retry_policies():
    plain = recovery.Backoff(tries=3, first=1.0, longest=3.0, luck=lambda: 1.0)
    assert [plain.delay(n) for n in (1, 2, 3)] == [1.0, 2.0, 3.0] and plain.again(2, ValueError()) and not plain.again(3, ValueError())
    assert not plain.again(1, KeyboardInterrupt())
    learning = recovery.Learning(tries=3)
    assert learning.again(1, ValueError()) and not learning.again(2, ValueError()) and learning.delay(2) == 3.0
    for _ in range(9):
        learning.success("ValueError")
    assert learning.again(2, ValueError()) and learning.delay(2) == 2.0


def test_catalog(spark, tmp_path):
    from sluicework.catalog_api import Catalog

    cat = Catalog(spark, str(tmp_path), F.lit("2026-01-01").cast("date"))
    spark.createDataFrame([(1, "approved", "2025-01-01"), (2, "pending", "2025-02-01"), (3, "approved", None)], "program_id int, approval_status string, updated_at string").write.parquet(f"{tmp_path}/programmes")
    site = "site_key string, display_name string, primary_domain string, adapter_key string"
    spark.createDataFrame([("a", "A", "a.org", "x")], site).write.parquet(f"{tmp_path}/sites")
    assert [r.program_id for r in cat.final_programmes().collect()] == [1, 3] and cat.programmes(False).count() == 1
    cat.approve(spark.createDataFrame([(2,)], "program_id int"))
    assert [r.program_id for r in cat.final_programmes().collect()] == [2, 1, 3]
    assert cat.create_site(spark.createDataFrame([("b", "a", "b.org", "x")], site)) == ["display_name", "adapter_key"]
    assert cat.create_site(spark.createDataFrame([("b", "B", "b.org", "y")], site)) == []
    cat.update_site(spark.createDataFrame([("b", "Best")], "site_key string, display_name string"))
    assert [r.display_name for r in cat.sites().collect()] == ["A", "Best"]
    cat.delete_site(spark.createDataFrame([("a",)], "site_key string"))
    assert [r.site_key for r in cat.sites().collect()] == ["b"]


def test_sitemaps(spark):
    import gzip

    from sluicework.sources import files

    page = lambda *urls: ("<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>").encode()
    index = lambda *urls: ("<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>").encode()
    maps = [
        ("https://a.org/sitemap.xml", index("https://a.org/deep.xml", "https://other.org/x.xml")), ("https://a.org/deep.xml", gzip.compress(index("https://a.org/deeper.xml"))),
        ("https://a.org/deeper.xml", page("https://www.a.org/3", "https://z.org/no")), ("https://a.org/own.xml", page("https://a.org/1")), ("https://other.org/x.xml", page("https://a.org/no")),
        ("https://b.org/sitemap.xml", b"\x1f\x8bbroken"),
    ]
    got = files.site_pages(
        spark.createDataFrame(maps, "source string, content binary"), spark.createDataFrame([("a.org", "User-agent: *\nSitemap: https://a.org/own.xml\n")], "host string, content string"),
        spark.createDataFrame([("a.org",), ("b.org",)], "host string"),
    )
    assert sorted(map(tuple, got.collect())) == [("a.org", "https://a.org/1"), ("a.org", "https://www.a.org/3")]


def test_command_line(spark, tmp_path, capsys):
    from sluicework.__main__ import main

    spark.createDataFrame([(1, "https://a.org/x", "<title>Seed Grant - Big Fund</title><p>A grant of R5m</p>")], "page_id int, url string, html string").write.parquet(f"{tmp_path}/pages")
    main(["records", f"{tmp_path}/pages", f"{tmp_path}/records", "--as-of", "2026-01-01"])
    main(["export-csv", f"{tmp_path}/records", f"{tmp_path}/csv"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().program_name == "Seed Grant"
