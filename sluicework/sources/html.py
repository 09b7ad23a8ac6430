"""Pages to documents: title, headings, sections, links and text of HTML, by a tolerant tree of events.

One pass of the standard parser per page inside an Arrow batch; Spark has no HTML expression. Scripts,
styles and navigation are left out of the text; unclosed tags need no repair, as only block borders count.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import DOCUMENT_ENDINGS, canonical_text

# Elements whose text is not content, and those that end a line.
SILENT = {"script", "style", "noscript", "template", "svg"}
NOISE = {"nav", "footer", "header", "aside", "form"}
BLOCK = {"main", "details", "summary", "p", "div", "li", "tr", "br", "section", "article", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


EMPHASIS = {"h1", "h2", "h3", "h4", "strong", "b"}
ELEMENTS = {"article", "section", "li", "div", "tr", "table"}
LAYOUT = ("menu", "sidebar", "footer", "header", "nav", "breadcrumb", "toolbar", "masthead", "site-nav")
RUN_IN = 7
"""Level of a heading that is a line in bold: below all others."""


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def unbalanced(html: str) -> set[str]:
    """Noise elements that are opened more often than closed: their text can't be told from the page's, and stays."""
    low = html.lower()
    return {t for t in NOISE if len(re.findall(rf"<{t}[\s>]", low)) > len(re.findall(rf"</{t}\s*>", low))}


class Page(HTMLParser):
    """Collects what a page holds. Open elements lie on a stack; an end tag closes all that its element still has open."""

    def __init__(self, plain: set[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.plain = plain
        self.title, self.headings, self.links = "", [], []
        self.lines: list[str] = []
        self.sections: list[tuple[str, list[str]]] = []
        self.meta: dict[str, str] = {}
        self.data: list[str] = []
        self.tabs: dict[str, str] = {}
        self.panels: list[list] = []  # kind, label or the id of its tab, texts
        self._line: list[str] = []
        self._open: list[tuple[str, dict]] = []
        self._heading, self._link, self._label = None, None, None
        self.marks: list[tuple[int, str, int]] = []  # level, heading, line behind it
        self.elements: list[dict] = []
        self._said: list[str] = []  # texts of headings and bold words, in order
        self._bold: list | None = None  # texts of bold words, whether they began the line, whether still open

    def _within(self, tags: set[str]) -> bool:
        return any(t in tags for t, _ in self._open)

    @property
    def _noise(self) -> bool:
        return any(t in NOISE and t not in self.plain for t, _ in self._open)

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag in BLOCK or tag in NOISE:
            self._flush()
        if tag == "meta" and (name := at.get("name") or at.get("property")) and at.get("content"):
            self.meta.setdefault(name.lower(), " ".join(at["content"].split()))
        if tag in HEADING:
            self._heading = []
        if tag in ("b", "strong") and self._bold is None and self._heading is None and not self._noise:
            self._bold = [[], not "".join(self._line).strip(), True]
        if tag in ELEMENTS:
            names = f"{at.get('class', '')} {at.get('id', '')}".lower()
            odd = any(t in NOISE - {"form"} or any(x in f"{a.get('class', '')} {a.get('id', '')}".lower() for x in LAYOUT) for t, a in self._open)
            noise = odd or any(x in names for x in LAYOUT)
            at = at | {"@": len(self.elements)}
            self.elements.append({"tag": tag, "names": names.strip(), "noise": noise, "first": len(self.lines), "upto": None, "said": len(self._said), "heading": "", "links": [len(self.links), None]})
        if tag == "a" and at.get("href"):
            self._end_link()
            self._link = [at["href"], []]
        if tag == "summary" or at.get("role") == "tab":
            self._label = [at.get("id", ""), []]
        if tag == "details":
            self.panels.append(["accordion", None, []])
        elif at.get("role") == "tabpanel":
            self.panels.append(["tab", at.get("aria-labelledby", ""), []])
        if tag not in VOID:
            panel = len(self.panels) - 1 if tag == "details" or at.get("role") == "tabpanel" else None
            self._open.append((tag, at | ({"#": panel} if panel is not None else {})))

    def handle_endtag(self, tag):
        if tag in BLOCK or tag in NOISE:
            self._flush()
        if tag in HEADING and self._heading is not None:
            text = " ".join("".join(self._heading).split())
            self._heading = None
            if text and not self._noise:
                self._line = []
                self.headings.append(text)
                self.sections.append((text, []))
                self.lines.append(text)
                self.marks.append((int(tag[1]), text, len(self.lines)))
                if tag in EMPHASIS:
                    self._said.append(text)
        if tag in ("b", "strong") and self._bold is not None:
            self._bold[2] = False
        if tag == "a":
            self._end_link()
        if any(t == tag for t, _ in self._open):
            while self._open:
                t, at = self._open.pop()
                if "@" in at:
                    self._end_element(at["@"])
                if self._label is not None and (t == "summary" or at.get("role") == "tab"):
                    self._end_label(t, at)
                if t == tag:
                    break

    def _end_element(self, k):
        e = self.elements[k]
        self._end_bold("")
        e["upto"], e["links"][1] = len(self.lines), len(self.links)
        if len(self._said) > e["said"]:
            e["heading"] = self._said[e["said"]]

    def _end_bold(self, line):
        """Bold words end with their line; where they are all of it, it is a heading."""
        if self._bold is None:
            return
        text = " ".join("".join(self._bold[0]).split())
        if text:
            self._said.append(text)
            if line and text == line and self._bold[1]:
                self.marks.append((RUN_IN, text, len(self.lines)))
        self._bold = None

    def _end_label(self, tag, at):
        text = " ".join("".join(self._label[1]).split())
        if tag == "summary" and self.panels:
            self.panels[-1][1] = text
        elif at.get("id"):
            self.tabs[at["id"]] = text
        self._label = None

    def _end_link(self):
        if self._link is not None:
            self.links.append((self._link[0], " ".join("".join(self._link[1]).split())))
            self._link = None

    def handle_data(self, data):
        tag, at = self._open[-1] if self._open else ("", {})
        if tag == "script" and at.get("type") == "application/ld+json":
            self.data.append(data.strip())
        if self._within(SILENT):
            return
        if tag == "title":
            self.title += data
            return
        if self._link is not None:
            self._link[1].append(data)
        if self._label is not None:
            self._label[1].append(data)
        else:
            for _, held in self._open:
                if "#" in held:
                    self.panels[held["#"]][2].append(data)
        if self._heading is not None:
            self._heading.append(data)
        elif not self._noise:
            self._line.append(data)
            if self._bold is not None and self._bold[2]:
                self._bold[0].append(data)

    def _flush(self):
        text = " ".join("".join(self._line).split())
        self._line = []
        if text:
            self.lines.append(text)
            self._end_bold(text)
            if self.sections:
                self.sections[-1][1].append(text)

    def outline(self) -> list[dict]:
        """Headings in order, each with the lines up to the next one, its parent (the last heading before it of a lower level;
        -1: none), its depth, and the last heading under it: the subtree of heading k is the headings k to ``last``."""
        out, path = [], []
        for k, (level, heading, first) in enumerate(self.marks):
            upto = self.marks[k + 1][2] - 1 if k + 1 < len(self.marks) else len(self.lines)
            while path and out[path[-1]]["level"] >= level:
                path.pop()
            body = dict.fromkeys(self.lines[first:upto])
            out.append({"level": level, "heading": heading, "content": "\n".join(body), "parent": path[-1] if path else -1, "depth": len(path), "last": k})
            for above in path:
                out[above]["last"] = k
            path.append(k)
        return out

    def done(self) -> dict:
        self._flush()
        self._end_link()
        for k, e in enumerate(self.elements):
            if e["upto"] is None:
                self._end_element(k)
        seen, sections = set(), []
        for heading, body in self.sections:
            key = (heading.lower(), "\n".join(body).lower())
            if key not in seen:
                seen.add(key)
                sections.append({"heading": heading, "content": "\n".join(dict.fromkeys(body))})
        panels = [{"kind": k, "label": label if k == "accordion" else self.tabs.get(label, ""), "content": " ".join("".join(x).split())} for k, label, x in self.panels]
        return {
            "title": " ".join(self.title.split()) or self.meta.get("og:title", ""),
            "headings": self.headings,
            "sections": sections,
            "links": [{"href": h, "text": t} for h, t in dict.fromkeys(self.links)],
            "text": "\n".join(dict.fromkeys(self.lines)),
            "panels": [p for p in panels if p["content"]],
            "summary": self.meta.get("description") or self.meta.get("og:description") or "",
            "data": [d for d in self.data if d],
            "outline": self.outline(),
            "lines": self.lines,
            "elements": [e | {"links": [{"href": h, "text": t} for h, t in self.links[e["links"][0] : e["links"][1]]]} for e in self.elements],
        }


def parse(html: str | None) -> dict:
    """Parts of one page; null is an empty page. Marked sections that the parser can't read count as text."""
    html = html or ""
    for source in (html, html.replace("<!", "&lt;!")):
        page = Page(unbalanced(html))
        try:
            page.feed(source)
            page.close()
        except AssertionError:
            continue
        return page.done()
    return Page().done()


SCHEMA = (
    "title string, headings array<string>, sections array<struct<heading:string,content:string>>, links array<struct<href:string,text:string>>, text string, "
    "panels array<struct<kind:string,label:string,content:string>>, summary string, data array<string>"
)
_pair = lambda *names: pa.list_(pa.struct([(n, pa.string()) for n in names]))
_TYPES = [pa.string(), pa.list_(pa.string()), _pair("heading", "content"), _pair("href", "text"), pa.string(), _pair("kind", "label", "content"), pa.string(), pa.list_(pa.string())]
_NAMES = ["title", "headings", "sections", "links", "text", "panels", "summary", "data"]
# parts that say how a page is built, given on demand
TREE_SCHEMA = (
    "outline array<struct<level:int,heading:string,content:string,parent:int,depth:int,last:int>>, lines array<string>, "
    "elements array<struct<tag:string,names:string,noise:boolean,first:int,upto:int,heading:string,links:array<struct<href:string,text:string>>>>"
)
_TREE_TYPES = [
    pa.list_(pa.struct([("level", pa.int32()), ("heading", pa.string()), ("content", pa.string()), ("parent", pa.int32()), ("depth", pa.int32()), ("last", pa.int32())])),
    pa.list_(pa.string()),
    pa.list_(pa.struct([("tag", pa.string()), ("names", pa.string()), ("noise", pa.bool_()), ("first", pa.int32()), ("upto", pa.int32()), ("heading", pa.string()), ("links", _pair("href", "text"))])),
]
_TREE_NAMES = ["outline", "lines", "elements"]


TASKS_A_CORE = 4
"""Tasks for each core where rows are dealt over the cluster."""


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks for all cores, for work that costs far more than moving them."""
    spark = rows.sparkSession
    return rows.repartition(max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def documents(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", built: bool = False) -> DataFrame:
    """``id, url`` and the parts of each page; with ``built`` also its outline, all its lines and its elements.

    Pages are dealt over the cluster first: a file of few row groups would be parsed, and all that follows done, by few tasks."""
    names, types = (_NAMES + _TREE_NAMES, _TYPES + _TREE_TYPES) if built else (_NAMES, _TYPES)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    source = spread(source)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = [parse(h.as_py()) for h in part.column(2)]
                cols = [pa.array([m[n] for m in made], type=t) for n, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["id", "url", *names])

    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"id {kind}, url string, {SCHEMA}" + (f", {TREE_SCHEMA}" if built else ""))


# What links to applications and documents are told by, and labels that are no programme's.
APPLY_WORDS = ("apply", "application", "portal", "register")
NO_LABELS = (
    "eligibility", "eligibility criteria", "requirements", "how to apply", "application", "application process", "documents", "required documents", "overview",
    "terms", "support", "contact", "contact us", "about", "about us", "home", "news", "faq", "faqs", "share", "menu", "search",
)


def with_links(docs: DataFrame) -> DataFrame:
    """Adds ``apply_links, document_links, page_links``: the page's links in canonical form, each once, by kind."""

    def run(batches):
        for batch in batches:
            kinds: tuple[list, list, list] = ([], [], [])
            for url, links in zip(batch.column(1).to_pylist(), batch.column(batch.schema.get_field_index("links")).to_pylist(), strict=True):
                held: tuple[dict, dict, dict] = ({}, {}, {})
                for link in links or []:
                    try:
                        full = canonical_text(link["href"], url)
                    except ValueError:
                        continue
                    if not full.startswith(("http://", "https://")):
                        continue
                    held[2].setdefault(full)
                    if full.lower().endswith(DOCUMENT_ENDINGS):
                        held[1].setdefault(full)
                    elif any(w in full.lower() or w in (link["text"] or "").lower() for w in APPLY_WORDS):
                        held[0].setdefault(full)
                for out, h in zip(kinds, held, strict=True):
                    out.append(list(h))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(k, type=pa.list_(pa.string())) for k in kinds)], names=[*batch.schema.names, "apply_links", "document_links", "page_links"])

    kind = dict(docs.dtypes)["id"]
    built = "outline" in docs.columns
    names, shape = (_NAMES + _TREE_NAMES, f"{SCHEMA}, {TREE_SCHEMA}") if built else (_NAMES, SCHEMA)
    return docs.select("id", "url", *names).mapInArrow(run, f"id {kind}, url string, {shape}, apply_links array<string>, document_links array<string>, page_links array<string>")


def candidate_label(c):
    """A heading as the name of a candidate: without a call to action at its end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\s*[-–|:]?\s*(read more|learn more|apply now|find out more|view details)\s*$", ""), r"\s+", " "))


def is_label(c):
    """4 to 110 letters, at most twelve words, and not the heading of a part of a page."""
    return F.length(c).between(4, 110) & (F.size(F.split(c, " ")) <= 12) & ~F.lower(c).isin(*NO_LABELS)


def candidates(docs: DataFrame) -> DataFrame:
    """Sections of a page as candidate records, with their place: those with a telling label and some content; of one label
    the section with the longest content."""
    rows = docs.select("id", "url", F.posexplode("sections").alias("place", "section"))
    rows = rows.select("id", "url", "place", candidate_label(F.col("section.heading")).alias("heading"), F.col("section.content").alias("content"))
    rows = rows.filter(is_label(F.col("heading")) & (F.length("content") > 0))
    best = rows.groupBy("id", "url", F.lower("heading").alias("_k")).agg(F.max_by(F.struct("place", "heading", "content"), F.struct(F.length("content"), -F.col("place"))).alias("x"))
    return best.select("id", "url", "x.*")


def scoped_links(label, links):
    """Links that share a word of four letters and more with a candidate's label."""
    words = F.filter(F.split(F.lower(label), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    return F.filter(links, lambda u: F.exists(words, lambda w: F.lower(u).contains(w)))
