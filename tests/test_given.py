"""Money checks, adapters, publish feed and versions, paged source, terms, workbook limits."""

import json

import pytest
from pyspark.sql import functions as F

from sluicework.catalog_api import Catalog
from sluicework.functions import moneycheck, taxonomy, terms
from sluicework.operators import adapters, catalog
from sluicework.sources import files, paged


def test_amounts_against_evidence():
    check = moneycheck.checked
    assert check(["Grants of R1m to R2m."], "", 1e6, 2e6, None, None) == (1e6, 2e6, None, "ZAR", None, None)
    assert check(["Call 011 555 0100"], "", 5.0, None, 7.0, "ZAR")[:5] == (None, None, None, "ZAR", "invalid_money_context")
    assert check(["No number"], None, 5.0, None, None, None)[4] == "weak_money_evidence"
    assert check(None, None, 5.0, None, None, None)[4] == "weak_money_evidence" and check([], "", None, None, None, "ZAR") == (None, None, None, "ZAR", None, None)
    assert check(["Budget: 51% of R9m"], "", 1.0, 2.0, 9e6, None)[:5] == (None, None, 9e6, None, "invalid_money_context")
    assert check(["Loans of R1m to R2m."], "", None, None, 2024.0, None)[2:5] == (None, "ZAR", "invalid_money_context")
    assert check(["About ZAR in general."], "", 3.0, None, None, None)[4] == "weak_money_evidence"


def test_adapter_of_urls_and_settings(spark):
    rows = spark.createDataFrame([(1, "https://www.a.org/x"), (2, "https://b.a.org"), (3, "https://c.b.a.org/"), (4, "https://e.net"), (5, None), (6, "https://zz.io"), (7, "https://xa.org")], "id int, url string")
    known = spark.createDataFrame([(3, "wide", "a.org"), (1, "deep", "www.b.a.org"), (2, "later", "A.org"), (4, "sub", "d.e.net"), (5, "none", None)], "ord long, adapter_key string, domain string")
    got = {r.id: r.adapter_key for r in adapters.with_adapter(rows, known).collect()}
    assert got == {1: "later", 2: "deep", 3: "deep", 4: "sub", 5: None, 6: None, 7: None}
    shape = "adapter_key string, child_page_terms array<string>, allow_root_url boolean, max_pages int, crawl_mode string, merge_aliases map<string,string>"
    base = spark.createDataFrame([("a", ["x"], True, 5, "wide", {"k": "v", "o": "p"}), ("b", None, None, None, None, None)], shape)
    config = spark.createDataFrame([("a", [" ", ""], False, 0, " ", {"k": "w", " ": "gone"}), ("b", [" t "], None, 7, "deep", {"n": "m"}), ("c", [], None, None, None, None)], shape)
    out = {r.adapter_key: tuple(r)[1:] for r in adapters.configured(base, config).collect()}
    assert out == {"a": (["x"], False, 5, "wide", {"k": "w", "o": "p"}), "b": (["t"], None, 7, "deep", {"n": "m"})}


def test_feed_of_changes(spark):
    shape = "op string, seq int, program_id int, name string, approval_status string"
    feed = [("insert", 1, 1, "a", "approved"), ("update", 2, 1, "b", None), ("update", 1, 2, "c", "approved"), ("delete", 2, 2, None, None), ("INSERT", 5, 3, "d", "approved"), ("update", 1, 4, "e", "rejected")]
    final = spark.createDataFrame([(1, "old", "approved", "then", "approved"), (4, "old", "approved", "then", "approved"), (9, "old", "approved", "then", "approved")], "program_id int, name string, approval_status string, published_at string, source_approval_status string")
    out = {r.program_id: (r.name, r.published_at) for r in catalog.published_changes(final, spark.createDataFrame(feed, shape), now=F.lit("now")).collect()}
    assert out == {3: ("d", "now"), 9: ("old", "then")}


def test_versions_survive_killed_writes(spark, tmp_path):
    root = f"file://{tmp_path}/cat"
    spark.createDataFrame([(1, "x")], "id int, v string").write.parquet(f"{root}/sites")
    c = Catalog(spark, root, F.current_date())
    c._replace("sites", c.table("sites").withColumn("v", F.lit("y")))
    opened = c.table("sites")
    spark.createDataFrame([(1, "lost")], "id int, v string").write.parquet(f"{root}/_data/sites/half")  # a writer that died before its last step
    assert [tuple(r) for r in c.table("sites").collect()] == [(1, "y")]
    c._replace("sites", c.table("sites").unionByName(spark.createDataFrame([(2, "z")], "id int, v string")))
    assert [tuple(r) for r in opened.collect()] == [(1, "y")] and c.table("sites").count() == 2
    with pytest.raises(RuntimeError):  # made from a version that is not the newest any more
        c._replace("sites", opened, read="000000000001-old")
    assert c.table("sites").count() == 2


def test_paged_source_pushes_filters(spark, tmp_path):
    for n, body in enumerate(([{"a": 1, "b": "x"}, {"a": 2}], {"items": [{"a": 3, "b": "x", "c": 0}]}, [])):
        (tmp_path / f"{n}.json").write_text(json.dumps(body))
    df = paged.read_pages(spark, f"file://{tmp_path}", "a long, b string, d double")
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x", None), (2, None, None), (3, "x", None)]
    hit = df.filter("b = 'x'").select("a")
    assert sorted(r.a for r in hit.collect()) == [1, 3] and df.filter("b is null").count() == 1
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").replace("RuntimeFilters", "")  # nothing is left for Spark to test
    assert df.filter("d > 1.5").count() == 0


def test_terms_in_texts(spark):
    words = ["a b", "b", "", "ab", "b"]
    rows = spark.createDataFrame([(1, "xa bab"), (2, None), (3, ""), (4, "b"), (5, "éb b9")], "id int, t string")
    got = {r.id: r.hits for r in terms.with_hits(rows, "t", words).collect()}
    assert got == {1: [0, 1, 3, 4], 2: [], 3: [], 4: [1, 4], 5: [1, 4]}
    assert {r.id: r.hits for r in terms.with_hits(rows, "t", words, whole=True).collect()} == {1: [], 2: [], 3: [], 4: [1, 4], 5: [1, 4]}
    assert terms.with_hits(rows, "t", []).filter("size(hits) > 0").count() == 0


def test_taxonomies_grow(spark):
    shape = "taxonomy string, ord int, category string, parent string, term_ord int, term string, base double, step double, cap double"
    old = spark.createDataFrame([("t", 0, "Farm", None, 0, "farm", 0.6, 0.1, 0.9)], shape)
    new = spark.createDataFrame([("t", "farm", None, 1, "crop", 0.6, 0.1, 0.9), ("t", "Farm", None, 2, "FARM", 0.6, 0.1, 0.9), ("t", "Mine", None, 0, "ore", 0.6, 0.1, 0.9), ("u", "New", None, 0, "n", 0.6, 0.1, 0.9)], shape.replace("ord int, category", "category", 1))
    grown = taxonomy.added_category(old, new)
    assert [tuple(r) for r in taxonomy.listed_categories(grown, "t").select("ord", "category", "terms").collect()] == [(0, "Farm", ["farm"]), (0, "farm", ["crop"]), (1, "Mine", ["ore"])]
    assert taxonomy.listed_categories(grown, "u").first().ord == 0


def test_shares_of_owners():
    read = taxonomy.shares_of_owners
    assert read("At least 51% black-owned and minimum of 30.5 % women ownership; 25% youth; 1234% youth; not less than 10%") == ["At least 51% black-owned", "minimum of 30.5 % women ownership", "not less than 10%", "51% black-owned", "30.5 % women", "25% youth"]
    assert read(None) == [] and read("100% blackish, x5% youth, 5%") == []


def test_workbook_limits_are_noted(monkeypatch):
    import io
    import zipfile

    rows = "".join(f'<row><c><v>{k}</v></c><c><v>{k}</v></c></row>' for k in range(300))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{files._S[1:-1]}"><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{files._S[1:-1]}"><sheetData>{rows}</sheetData></worksheet>')
    text, note = files.read_text("xlsx", data.getvalue())
    assert note == files.CUT and len(text.split("\n")) == 201
    text, note = files.read_text("xlsx", data.getvalue(), most_rows=None, most_cells=None)
    assert note is None and len(text.split("\n")) == 301
    assert files.read_text("xlsx", data.getvalue(), most_rows=None, most_cells=10)[1] == files.CUT


def test_terms_take_only_the_text_to_python(spark):
    rows = spark.createDataFrame([(1, "a grant", "long"), (2, None, None)], "id int, t string, other string")
    got = terms.with_hits(rows, "t", ["grant", "a", "x"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert [(r.id, r.other, r.hits) for r in got.orderBy("id").collect()] == [(1, "long", [0, 1]), (2, None, [])]


def test_parts_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    from sluicework.plans import texts

    spark.createDataFrame([(k, f"ring {k}", "tin", "Brand#1", k) for k in range(200)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = texts.part_texts(spark, str(tmp_path))
    assert found.count() == 200
    assert found.groupBy(F.spark_partition_id()).count().count() > 4
