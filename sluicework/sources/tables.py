"""Scans and sinks of record tables: JSON snapshots, lines, CSV exports, seeds grouped by host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.numbers import mean_of
from ..functions.urls import domain, host, path


def scan_json(spark: SparkSession, path: str, schema: StructType, lines: bool = True) -> DataFrame:
    """Records by a given schema; a missing path is an empty table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def flat(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Columns as a CSV can hold them: nested ones as JSON text."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema if f.name not in drop])


def export_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ("field_evidence", "page_debug_package")) -> None:
    """Records as CSV with a header, and their mean confidence where they have a map of it."""
    if "extraction_confidence" in df.columns:
        df = df.withColumn("overall_confidence", mean_of(F.col("extraction_confidence")))
    flat(df, drop).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def seeds_by_host(urls: DataFrame, url: str = "url", ord_col: str = "ord") -> DataFrame:
    """The first url of each host."""
    rows = urls.select(host(F.col(url)).alias("host"), F.struct(ord_col, url).alias("u")).filter("host <> ''")
    return rows.groupBy("host").agg(F.min("u").alias("u")).select("host", F.col(f"u.{url}").alias(url))


def _cleaned(c, kind):
    """A value of any type without NUL characters in its texts, keys of maps included."""
    if kind.simpleString() == "string":
        return F.translate(c, "\0", "")
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _cleaned(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_keys(F.transform_values(c, lambda _, v: _cleaned(v, kind.valueType)), lambda k, _: _cleaned(k, kind.keyType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_cleaned(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def without_nul(df: DataFrame) -> DataFrame:
    """All texts, however deep, without NUL characters."""
    return df.select(*[_cleaned(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


LEGACY_FREQUENCIES = ("Weekly", "Monthly", "Variable", "Unknown")
"""Fixed values: repayment frequencies that older stores take."""


def legacy_payload(df: DataFrame) -> DataFrame:
    """Records for a store that knows the older repayment frequencies only: others become variable, with a note."""
    new = (F.coalesce("repayment_frequency", F.lit("")) != "") & ~F.col("repayment_frequency").isin(*LEGACY_FREQUENCIES)
    note = F.concat(F.lit("repayment frequency "), "repayment_frequency", F.lit(" stored as Variable"))
    notes = F.coalesce("notes", F.array().cast("array<string>"))
    cols = {"notes": F.when(new, F.array_distinct(F.concat(notes, F.array(note)))).otherwise(F.col("notes")), "repayment_frequency": F.when(new, "Variable").otherwise(F.col("repayment_frequency"))}
    return without_nul(df.withColumns(cols))


def seed_urls(spark: SparkSession, path: str) -> DataFrame:
    """``ord, url`` of a JSON array that mixes urls and objects with a ``url`` or a list of ``seed_urls``, in order."""
    text = spark.read.option("wholetext", True).text(path)
    items = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "item"))
    listed = F.coalesce(F.from_json(F.get_json_object("item", "$.seed_urls"), "array<string>"), F.array(F.coalesce(F.get_json_object("item", "$.url"), F.when(~F.col("item").startswith("{"), F.col("item")))))
    rows = items.select("place", F.posexplode(listed).alias("n", "url")).filter(F.length(F.trim(F.coalesce("url", F.lit("")))) > 0)
    return rows.select((F.shiftleft(F.col("place").cast("long"), 32) + F.col("n")).alias("ord"), F.trim("url").alias("url"))


def page_snapshots(pages: DataFrame, root: str) -> None:
    """Raw pages and what came with them, by domain; the name of a page is a slug of its path."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(path(F.col("url"))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    named = pages.withColumns({"domain": domain(F.col("url")), "name": F.when(slug == "", "index").otherwise(F.substring(slug, 1, 120))})
    named.write.mode("append").partitionBy("domain").parquet(root)


def reports(root: str, **tables: DataFrame) -> None:
    """Review queue, merge trace, summaries and the like, each a table of its own that is written anew."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def search_sources(rows: DataFrame) -> DataFrame:
    """Sources of searches (``search, ord, url, title, domain``), each url once: its kind, and rank 1 on the funder's own domain."""
    low = F.lower("url")
    document = low.endswith(".pdf") | low.contains(".pdf?") | low.rlike("annual-report|brochure|guideline|application-form")
    rated = rows.withColumns({"source_type": F.when(document, "official_document").otherwise("official_website"), "official_rank": F.when(low.contains(F.lower("domain")), 1).otherwise(4)})
    first = rated.groupBy("search", "url").agg(F.min(F.struct("ord", "title", "source_type", "official_rank")).alias("x"))
    return first.select("search", "url", "x.title", "x.source_type", "x.official_rank")
