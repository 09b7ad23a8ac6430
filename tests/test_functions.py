"""Column functions against plain cases."""

import pytest
from pyspark.sql import functions as F

from sluicework.functions import classify, money, numbers, text, urls
from sluicework.sources import html


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first().r


def test_text(spark):
    assert one(spark, "  a   b\n", text.collapse) == "a b"
    assert one(spark, None, text.collapse) == ""
    assert one(spark, ["Ab", "aB ", "", "c"], text.unique_text, "array<string>") == ["Ab", "c"]
    assert one(spark, "Mail A@B.com, a@b.com", text.emails) == ["a@b.com"]
    assert one(spark, "call +27 11 555 1234 or 12-34", text.phones) == ["+27 11 555 1234"]
    assert one(spark, "see https://x.org/a). now", text.urls) == ["https://x.org/a"]
    assert one(spark, "A b. C d! e\nf", text.sentences) == ["A b.", "C d!", "e", "f"]
    assert one(spark, "The Fund x", lambda c: text.has_phrase(c, "fund")) is True
    assert one(spark, "refunds", lambda c: text.has_phrase(c, "fund")) is False
    assert one(spark, "IV. Terms", text.strip_numbering) == "Terms"
    assert one(spark, "--", text.plain_slug) is None
    assert text.sorted_ratio("b a", "a b") == 100.0
    assert text.sorted_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)


def test_slug_udfs(spark):
    assert one(spark, "Été & Co", text.ascii_slug) == "ete-co"
    assert one(spark, "ﬁ  x", text.folded) == "fi x"
    row = spark.createDataFrame([("a.org", "F", "P")], "d string, f string, n string").select(text.program_key("d", "f", "n")).first()[0]
    assert row.startswith("funding_a-org_p_") and len(row.rsplit("_", 1)[1]) == 8


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://A.com:80/x/", "http://a.com/x"),
        ("https://a.com", "https://a.com/"),
        ("https://a.com/x?utm_source=1&b=2&a=1#f", "https://a.com/x?a=1&b=2"),
        ("https://a.com/x?b=", "https://a.com/x"),
    ],
)
def test_canonical(spark, url, want):
    assert one(spark, url, urls.canonical) == want
    assert urls.canonical_text(url) == want


def test_relative_urls():
    assert urls.canonical_text("../b", "https://a.com/x/y") == "https://a.com/b"


def test_url_rules(spark):
    assert one(spark, "https://www.a.com/p.pdf", urls.is_document) is True
    assert one(spark, "https://www.a.com/p.pdf?x=1", urls.is_document) is False
    df = spark.createDataFrame([("www.a.com", "a.com", True), ("b.a.com", "a.com", False), ("", "a.com", False)], "x string, y string, w boolean")
    assert all(r.w == r.g for r in df.select("w", urls.same_site(F.col("x"), F.col("y")).alias("g")).collect())
    row = spark.createDataFrame([("https://a.com/seed-capital.pdf", "Seed Capital", "x")], "u string, t string, a string")
    assert row.select(urls.document_relevance(F.col("u"), F.col("t"), F.col("a"))).first()[0] == 12


def test_numbers(spark):
    df = spark.createDataFrame([(5.0, 1.0, None, 3.0)], "a double, b double, c double, d double")
    low, high = numbers.ordered(F.col("a"), F.col("b"))
    r = df.select(low, high, numbers.overlap(F.col("a"), F.col("c"), F.col("b"), F.col("d")), numbers.overlap(F.col("c"), F.col("c"), F.col("b"), F.col("d"))).first()
    assert tuple(r) == (1.0, 5.0, False, False)
    assert one(spark, 2.5, numbers.half_up, "double") == 3
    assert one(spark, {"a": 0.5, "b": 1.0}, numbers.mean_of, "map<string,double>") == 0.75
    assert one(spark, None, numbers.mean_of, "map<string,double>") == 0.0


@pytest.mark.parametrize(
    ("said", "low", "high", "currency"),
    [
        ("Funding between R500 000 and R2 million", 5e5, 2e6, "ZAR"),
        ("R300-R500m for growth funding", 3e8, 5e8, "ZAR"),
        ("up to R10 million per firm", None, 1e7, "ZAR"),
        ("a minimum of $5 billion", 5e9, None, "USD"),
        ("The grant is R250,000.", None, 250000.0, "ZAR"),
        ("Established in 2015", None, None, None),
        ("Tel 011 555 1234", None, None, None),
        ("tender number 445566", None, None, None),
        ("funding covers 50% of costs", None, None, None),
        ("TRL 4 to 6", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_money(said, low, high, currency):
    got = money.money_range(said)
    assert got[0] == pytest.approx(low) if low is not None else got[0] is None
    assert got[1] == pytest.approx(high) if high is not None else got[1] is None
    assert got[2] == currency


def test_classes(spark):
    kind = lambda s: tuple(one(spark, s, classify.funding_type))
    assert kind("A loan and a grant") == ("Hybrid", 0.82)
    assert kind("blended finance") == ("Hybrid", 0.93)
    assert kind("venture capital equity") == ("Equity", 0.88)
    assert kind("nothing") == ("Unknown", 0.0) and kind(None) == ("Unknown", 0.0)
    assert one(spark, "Call for applications", classify.page_type) == "open_call"
    assert one(spark, None, classify.page_type) == "generic_content"
    assert tuple(one(spark, "2 to 3 years", classify.month_range)) == (24, 36)


def test_html():
    page = html.parse("<title>T &amp; U</title><script>'</p>'</script><nav><a href='/n'>n</a></nav><h1>One</h1><p>a<p>b<h2>Two</h2><p>c")
    assert page["title"] == "T & U" and page["headings"] == ["One", "Two"]
    assert page["sections"] == [{"heading": "One", "content": "a\nb"}, {"heading": "Two", "content": "c"}]
    assert page["links"] == [{"href": "/n", "text": "n"}] and page["text"] == "One\na\nb\nTwo\nc"
    assert html.parse(None)["text"] == ""


def test_html_of_broken_pages():
    assert "kept" in html.parse("<p>a<![bogus[ x ]]><p>kept")["text"]
    assert html.parse("<nav>menu<p>text of the page")["text"] == "menu\ntext of the page"  # never closed: not told apart
    assert html.parse("<div><nav>menu</div><nav>more</nav></nav><p>text")["text"] == "text"  # closed with its parent
    assert [x["href"] for x in html.parse("<a href=1>x<a href=2>y</a>")["links"]] == ["1", "2"]
    page = html.parse("<details><summary>Who?</summary>All</details><b id=t role=tab>Tab</b><div role=tabpanel aria-labelledby=t>Panel</div><meta property=og:title content=T><script type='application/ld+json'>{}</script>")
    assert page["panels"] == [{"kind": "accordion", "label": "Who?", "content": "All"}, {"kind": "tab", "label": "Tab", "content": "Panel"}]
    assert page["title"] == "T" and page["data"] == ["{}"]
