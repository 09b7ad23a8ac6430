"""Queries against their SQL on small tables of odd rows."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

from test_entry import rows

DATA = "/root/testdata"


def both(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return rows(entry.queries()[name](spark, str(folder)).toPandas()), rows(con.execute(entry.oracle_sql()[name]).df())


def test_languages_of_equal_scores(spark, tmp_path):
    """Scores that are equal but for the order of their sums (4563), and a last digit between two (3351)."""
    spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").filter("doc_id in (3351, 4563)").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = both(spark, "g15_languages", tmp_path, ["documents"])
    assert len(got) == 2 and got == want


@pytest.mark.parametrize("heading", ["Mi.", "Vi auxre", "12.155.1.2 Rees", "3 Ci. "])
def test_blocks_whose_headings_begin_like_numbers(spark, tmp_path, heading):
    """Headings of words that are Roman letters, or of digits."""
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").filter("html like '%<p><b>%'").orderBy("page_id").limit(3).toPandas()
    pages["html"] = [re.sub("<p><b>[^<]*<br>", f"<p><b>{heading}<br>", h) for h in pages["html"]]
    spark.createDataFrame(pages).write.parquet(f"{tmp_path}/pages.parquet")
    got, want = both(spark, "h12_content_blocks", tmp_path, ["pages"])
    assert got == want
