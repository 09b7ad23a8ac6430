"""Documents from bytes: kinds by type or ending, text of PDF, Word and Excel files, sitemaps.

The readers use the standard library only; a file that cannot be read gives an empty text and a note.
"""

from __future__ import annotations

import gzip
import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS, MOST_CELLS = 200, 2000
"""Rows of a sheet and cells of a workbook that are read unless asked otherwise; what is left out is noted."""
CUT = "cut: not all rows were read"
BATCH = 4 << 20
"""Letters of text in one Arrow batch, about."""


def kind(url: Column, content_type: Column) -> Column:
    """image, pdf, docx, xlsx, text or unsupported, by content type or else by ending."""
    t, u = F.lower(F.coalesce(content_type, F.lit(""))), F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[?#].*$", "")
    return (
        F.when(t.startswith("image/") | u.rlike(r"\.(png|jpe?g|gif|webp|bmp|tiff?)$"), "image")
        .when(t.contains("pdf") | u.endswith(".pdf"), "pdf")
        .when(t.contains("wordprocessing") | u.endswith(".docx"), "docx")
        .when(t.contains("spreadsheet") | u.endswith(".xlsx"), "xlsx")
        .when(t.startswith("text/") | u.rlike(r"\.(txt|csv|md)$"), "text")
        .otherwise("unsupported")
    )


def pdf_text(data: bytes) -> str:
    """Strings of the text operators of a PDF, streams inflated where they can be."""
    chunks = [data]
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", data, re.S):
        try:
            chunks.append(zlib.decompress(m[1].rstrip(b"\r\n")))
        except zlib.error:
            continue
    out = []
    for chunk in chunks:
        for m in re.finditer(rb"\(((?:\\.|[^()\\])*)\)\s*Tj|\[((?:[^\]\\]|\\.)*)\]\s*TJ", chunk):
            parts = [m[1]] if m[1] is not None else re.findall(rb"\(((?:\\.|[^()\\])*)\)", m[2])
            out.append(re.sub(rb"\\(.)", rb"\1", b"".join(parts)).decode("latin-1"))
    return "\n".join(x for x in out if x.strip())


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with cells joined by bars."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    inside = {p for t in root.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    lines = [said(p) for p in root.iter(f"{_W}p") if p not in inside]
    lines += [" | ".join(said(c) for c in r.iter(f"{_W}tc")) for r in root.iter(f"{_W}tr")]
    return "\n".join(x for x in lines if x)


def xlsx_text(data: bytes, most_rows: int | None = MOST_ROWS, most_cells: int | None = MOST_CELLS) -> tuple[str, str | None]:
    """Sheets with a heading each and tab-joined rows, and a note if rows of a sheet or cells of the workbook over the limits
    were left out; None is no limit."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in e.iter(f"{_S}t")) for e in root.iter(f"{_S}si")]
    names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    files = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    lines, cells, cut = [], 0, None
    for name, file in zip(names, files, strict=False):
        lines.append(f"[Sheet: {name}]")
        rows = list(ElementTree.fromstring(book.read(file)).iter(f"{_S}row"))
        if most_rows is not None and len(rows) > most_rows:
            rows, cut = rows[:most_rows], CUT
        for row in rows:
            if most_cells is not None and cells >= most_cells:
                return "\n".join(lines), CUT
            values = []
            for c in row.iter(f"{_S}c"):
                v = c.find(f"{_S}v")
                text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if v is None else (v.text or "")
                values.append(shared[int(text)] if c.get("t") == "s" and text else text)
            cells += len(values)
            if any(values):
                lines.append("\t".join(values))
    return "\n".join(lines), cut


READERS = {"pdf": pdf_text, "docx": docx_text, "xlsx": xlsx_text, "text": lambda b: b.decode("utf-8", "replace")}


def read_text(what: str, data: bytes | None, **limits: int | None) -> tuple[str, str | None]:
    """(text, note) of one file; the note says why a text is empty, or that it isn't whole. ``limits`` are those of
    ``xlsx_text``."""
    if what not in READERS:
        return "", f"{what} files have no reader"
    try:
        found = READERS[what](data or b"", **limits) if what == "xlsx" else READERS[what](data or b"")
    except Exception as e:  # a broken file is a row with a note, not a failed job
        return "", f"unreadable: {type(e).__name__}"
    found, cut = found if isinstance(found, tuple) else (found, None)
    return found, cut if found.strip() else "no text"


def texts(files: DataFrame, **limits: int | None) -> DataFrame:
    """``path, kind, text, note`` of a table ``path, content (binary)``, such as Spark's binaryFile source gives; ``limits``:
    ``most_rows, most_cells`` of workbooks."""
    rows = files.select("path", kind(F.col("path"), F.lit(None).cast("string")).alias("kind"), "content")

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for k in range(batch.num_rows):
                what = batch.column(1)[k].as_py()
                held.append((batch.column(0)[k].as_py(), what, *read_text(what, batch.column(2)[k].as_py(), **limits)))
                size += len(held[-1][2])
                if size >= BATCH or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*held, strict=True)], names=["path", "kind", "text", "note"])
                    held, size = [], 0

    return rows.mapInArrow(run, "path string, kind string, text string, note string")


def compact(c: Column, most: int) -> Column:
    """Unique lines, cut to a length."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return F.substring(F.array_join(F.array_distinct(lines), "\n"), 1, most)


def site_pages(sitemaps: DataFrame, robots: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """``host, loc``: pages of the sitemaps that robots files and the usual places name, indexes followed to a depth, on the
    host itself only.

    sitemaps: ``source, content`` (fetched maps, packed or not); robots: ``host, content``; seeds: ``host``."""
    from ..functions.urls import domain, host

    def run(batches):
        for batch in batches:
            texts_ = []
            for x in batch.column(1).to_pylist():
                try:
                    texts_.append(unzipped(x or b"").decode("utf-8", "replace"))
                except (OSError, EOFError):  # a broken archive is an empty map
                    texts_.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts_, type=pa.string())], names=["source", "xml"])

    maps = sitemap_urls(sitemaps.select("source", F.col("content").cast("binary")).mapInArrow(run, "source string, xml string").filter("xml like '%<loc>%'"))
    named = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)
    usual = seeds.select("host", F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("source"))
    level = usual.unionByName(robots.select("host", F.explode(named).alias("source"))).distinct()
    found = None
    for _ in range(depth + 1):
        here = level.join(maps, "source").filter(domain(F.col("loc")) == F.regexp_replace(F.lower("host"), "^www[.]", ""))
        pages = here.filter(~F.col("is_index")).select("host", "loc")
        found = pages if found is None else found.unionByName(pages)
        level = here.filter("is_index").select("host", F.col("loc").alias("source")).distinct()
    return found.filter(host(F.col("loc")) != "").distinct()


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """``source, loc, is_index`` of sitemap texts (``source, xml``)."""
    loc = F.expr("xpath(xml, '//*[local-name()=\"loc\"]/text()')")
    index = F.col("xml").contains("<sitemapindex")
    return maps.select("source", F.explode(loc).alias("loc"), index.alias("is_index")).withColumn("loc", F.trim("loc"))


def unzipped(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def allowed(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """Pages of which no disallowed path of their host is the beginning."""
    from ..functions.urls import host, path

    p = pages.withColumns({"_h": host(F.col("url")), "_p": path(F.col("url"))})
    r = robots.select(F.col("host").alias("_h"), F.col("disallow"))
    return p.join(r, (p["_h"] == r["_h"]) & p["_p"].startswith(r["disallow"]), "left_anti").drop("_h", "_p")
