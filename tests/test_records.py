"""Record rules, file readers and language scores against plain cases."""

import io
import zipfile

from pyspark.sql import functions as F

from sluicework.functions import language, records
from sluicework.sources import files


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first().r


def test_rules(spark):
    assert one(spark, "We need: must be registered; open to women; excluded: banks", records.criteria) == ["We need: must be registered", "open to women"]
    assert one(spark, "For startup and growth firms", records.stages) == ["Startup", "Growth"]
    assert tuple(one(spark, "12 to 36 months, 6 month grace, quarterly", records.repayment))[:4] == (12, 36, 6, "Quarterly")
    assert one(spark, ["ab", "abc", "xyz"], records.best_snippet, "array<string>") == "abc"
    assert one(spark, [], records.best_snippet, "array<string>") is None
    assert one(spark, "Eligibility Criteria", records.is_support_title) is True
    assert one(spark, 'noise {"a": 1} tail', lambda c: records.salvaged_json(c, "a int")).a == 1
    assert one(spark, "https://a.com/funding/seed-fund/apply", records.parent_from_path) == "Seed Fund"
    assert one(spark, "https://a.com/x", records.parent_from_path) is None


def test_gates(spark):
    df = spark.createDataFrame([("https://a.com/p/x", ["x"], [], ["/p"], []), ("https://a.com/p/y", ["x"], [], ["/p"], []), ("https://a.com/q", [], [], ["/p"], ["q"]), ("https://a.com/z", [], [], [], [])], "u string, e array<string>, i array<string>, p array<string>, t array<string>")
    got = [r[0] for r in df.select(records.url_gate(*[F.col(c) for c in "ueipt"])).collect()]
    assert got == [False, True, True, True]
    pages = spark.createDataFrame([(200, "<p>" + "word " * 200 + "<a href=x>", "text/html"), (403, "x", None), (200, "", "application/pdf"), (200, "<div id=\"root\"></div>", None)], "s int, h string, t string")
    assert [r[0] for r in pages.select(records.fetched(F.col("s"), F.col("h"), F.col("t"))).collect()] == [True, False, True, True]


def test_language(spark):
    rows = [(1, "der hund und die katze von mir ist nicht da"), (2, "kurz"), (3, None), (4, "他是我的人 这是 的 的"), (5, "1234567890 !!"), (6, "كان هذا في البيت من")]
    got = {r.i: [tuple(x) for x in r.languages] for r in language.languages(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert got[1][0] == (1.0, "de") and got[2] == got[3] == got[5] == [(0.5, "en")] and got[4][0][1] == "zh" and got[6][0][1] == "ar"


def docx(paragraphs, row):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(map(p, paragraphs)) + "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark):
    rows = [("a.pdf", b"BT (Hello) Tj [(Wor) 3 (ld)] TJ ET"), ("b.docx", docx(["One"], ["x", "y"])), ("c.docx", b"no zip"), ("d.txt", "é".encode()), ("e.png", b""), ("f.pdf", None)]
    got = {r.path: (r.kind, r.text, r.note) for r in files.texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.pdf"] == ("pdf", "Hello\nWorld", None)
    assert got["b.docx"] == ("docx", "One\nx | y", None)
    assert got["c.docx"][1:] == ("", "unreadable: BadZipFile")
    assert got["d.txt"][1] == "é" and got["e.png"][2] == "image files have no reader" and got["f.pdf"][2] == "no text"
    maps = spark.createDataFrame([("s", "<urlset><url><loc> https://a.com/1 </loc></url></urlset>")], "source string, xml string")
    assert [tuple(r) for r in files.sitemap_urls(maps).collect()] == [("s", "https://a.com/1", False)]
    pages = spark.createDataFrame([("https://a.com/x/1",), ("https://a.com/y",)], "url string")
    assert [r.url for r in files.allowed(pages, spark.createDataFrame([("a.com", "/x")], "host string, disallow string")).collect()] == ["https://a.com/y"]
