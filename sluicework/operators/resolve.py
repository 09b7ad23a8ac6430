"""Entity resolution: records of one programme found by pair rules within blocks, merged with provenance.

``star_clusters`` is the full way: keys that any rule needs make blocks, and within a block the first record takes all
that match it. ``clusters`` is the short way for complete tables: domain, name, funder and parent agree, or a page is
shared and a name is missing, both as equal-key tests by two aggregations. What is merged keeps the best record's
values, fills its gaps from the others in order, and unites lists.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_text

# Names that say nothing about a programme.
GENERIC_NAMES = (
    "eligibility", "eligibility criteria", "requirements", "how to apply", "application", "application process", "documents",
    "required documents", "funding", "funding offer", "terms", "overview", "support",
)


def key_of(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def named(c: str) -> Column:
    k = key_of(c)
    return (k != "") & ~k.isin(*GENERIC_NAMES) & ~k.endswith(":")


def clusters(records: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Adds ``cluster``: the least ``ord`` of the record's cluster.

    Needs ``domain, name, funder, parent, url``. Nameless records join the first named one of their page.
    """
    keys = ["_d", "_n", "_f", "_p"]
    rows = records.select("*", key_of("domain").alias("_d"), key_of("name").alias("_n"), key_of("funder").alias("_f"), key_of("parent").alias("_p"), named("name").alias("_named"))
    seeds = rows.filter("_named").groupBy(*keys).agg(F.min(ord_col).alias("_seed"))
    full = rows.filter("_named").join(seeds, keys)
    pages = full.groupBy("url").agg(F.min("_seed").alias("_seed"))
    first = rows.filter("not _named").groupBy("url").agg(F.min(ord_col).alias("_own"))
    rest = rows.filter("not _named").join(pages, "url", "left").join(first, "url", "left")
    rest = rest.withColumn("_seed", F.coalesce("_seed", "_own", F.col(ord_col))).drop("_own")
    out = full.unionByName(rest)
    return out.withColumnRenamed("_seed", "cluster").drop(*keys, "_named")


def merged(clustered: DataFrame, scalars: list[str], lists: list[str], best: str = "completeness", ord_col: str = "ord") -> DataFrame:
    """One row per cluster: each scalar from the best record that has it, lists as ordered unions, member ids."""
    rank = F.struct((-F.col(best)).alias("b"), F.col(ord_col).alias("o"))
    has = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") & (F.col(c).cast("string") != "Unknown")
    aggs = [F.min_by(F.when(has(c), F.col(c)), F.when(has(c), rank)).alias(c) for c in scalars]
    base = clustered.groupBy("cluster").agg(*aggs, F.count(F.lit(1)).alias("size"), F.min_by(ord_col, rank).alias("survivor"))
    for c in lists:  # distinct values first, so that what is gathered has no copies
        items = clustered.select("cluster", rank.alias("r"), F.posexplode(c).alias("i", "v")).groupBy("cluster", F.lower("v").alias("k"))
        items = items.agg(F.min(F.struct("r", "i", "v")).alias("x"))
        united = items.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias(c))
        base = base.join(united, "cluster", "left")
    return base


def trace(clustered: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Size and members (as rows) of clusters that merged more than one record."""
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return clustered.select("cluster", ord_col).join(sizes.filter("size > 1"), "cluster")


def unique_evidence(evidence: DataFrame, fingerprint: list[str]) -> DataFrame:
    """Evidence rows without later ones of an equal fingerprint."""
    return evidence.groupBy(*fingerprint).agg(F.min("ord").alias("ord"))


# Path segments that group programmes, endings of support pages, roles that complete one another, page types
# that hold no programme, points of a programme's nature, and the order of page types in a merge.
HUB_SEGMENTS = (
    "products-services", "product-services", "products", "services", "funding", "funding-solutions", "programmes", "programs", "opportunities", "support",
)
SUPPORT_TERMS = (
    "apply", "application", "applications", "programme-guidelines", "program-guidelines", "guidelines", "eligibility", "criteria", "checklist",
    "documents", "required-documents", "how-to-apply", "application-form", "overview",
)
SUPPORT_ENDINGS = (
    "apply", "application", "applications", "guidelines", "eligibility", "criteria", "checklist", "documents", "required-documents", "how-to-apply",
    "application-form", "overview", "background", "preamble", "contact-details", "disclaimer", "other-conditions", "adjudication-process",
    "post-investment-monitoring", "terms-and-structure", "timing", "deadline", "terms",
)
ROLE_ENDINGS = (
    "apply", "application", "applications", "eligibility", "criteria", "checklist", "documents", "required-documents", "how-to-apply",
    "application-form", "overview", "terms", "funding", "register", "contact",
)
PROGRAMME_ROLES = ("overview", "eligibility", "application", "checklist", "funding_detail")
NO_PROGRAMME_TYPES = ("news_article", "tender_procurement", "generic_content")
NATURE_POINTS = {"Direct Funding": 12, "Voucher Support": 6, "Non-Financial Support": -8}
TYPE_ORDER = {"funding_programme": 4, "open_call": 3, "funding_listing": 2}
MERGE_FROM, SEPARATE_TO = 65, 15


def _segments(url: str) -> list[str]:
    return [x for x in url.split("://", 1)[-1].split("?")[0].split("#")[0].split("/")[1:] if x]


def _without_ending(segment: str, endings: tuple[str, ...]) -> str:
    for e in sorted(endings, key=len, reverse=True):
        if segment == e:
            return ""
        if segment.endswith("-" + e):
            return segment[: -len(e) - 1]
    return segment


def url_keys(urls: list[str]) -> set[str]:
    """Segments that pages of one programme share: the parent of a support page, and the last one without a support ending."""
    out = set()
    for parts in map(_segments, urls):
        low = [x.lower().replace("_", "-") for x in parts]
        if low and (base := _without_ending(low[-1].lstrip("0123456789").lstrip(".)- "), SUPPORT_ENDINGS)):
            out.add(("leaf", base))
        if len(low) >= 3 and low[-2] not in HUB_SEGMENTS and (any(t in low[-1] for t in SUPPORT_TERMS) or _without_ending(low[-1], SUPPORT_ENDINGS)):
            out.add(("context", low[-2]))
    return out


def group_key(r: dict) -> str:
    """Domain with funder and name, else with the path of the first page that has one, support endings left out."""
    name = r["name"] or r["parent"]
    if name and r["funder"]:
        return f"{r['domain']}:{r['funder']}:{name}"
    for url in r["urls"]:
        parts = [x.lower() for x in _segments(url)]
        if parts:
            last = _without_ending(parts[-1], ROLE_ENDINGS)
            if key := "/".join([*parts[:-1], *([last] if last else [])]):
                return f"{r['domain']}:{key}"
    return f"{r['domain']}:{(r['urls'] or [''])[0].lower()}"


def compared(row: dict) -> dict:
    """A record in the form that the pair rules compare: names in lower case, sets of pages and links."""
    low = lambda x: " ".join(str(x or "").lower().split())
    urls = list(dict.fromkeys(canonical_text(u) for u in [*(row.get("urls") if row.get("urls") is not None else []), row.get("url")] if u))
    apply_url = row.get("apply_url") or ""
    out = {"ord": row["ord"], "domain": row.get("domain") or "", "name": low(row.get("name")), "funder": low(row.get("funder")), "parent": low(row.get("parent")), "urls": urls}
    documents = set(row["documents"] if row.get("documents") is not None else [])
    keys = url_keys(urls)
    return out | {
        "context": {k for kind, k in keys if kind == "context"}, "keys": {k for _, k in keys}, "documents": documents, "apply": apply_url,
        "links": documents | ({apply_url} if apply_url else set()), "role": row.get("role") or "generic", "type": row.get("page_type") or "generic_content", "group": group_key(out),
    }


def generic_name(name: str) -> bool:
    return not name or name in GENERIC_NAMES or name.endswith(":")


def shared_evidence(a: dict, b: dict) -> bool:
    return bool(a["keys"] & b["keys"] or a["links"] & b["links"] or (a["parent"] and a["parent"] == b["parent"]))


def judge_points(a: dict, b: dict) -> int:
    """Points for two records of one domain being one; MERGE_FROM merges, SEPARATE_TO and less keeps apart."""
    unlike = lambda k: bool(a[k] and b[k] and a[k] != b[k])
    same = lambda k: bool(a[k] and a[k] == b[k])
    parts = [
        (a["group"] == b["group"], 40), (same("name"), 18), (same("funder"), 14), (same("parent"), 10), (bool(set(a["urls"]) & set(b["urls"])), 35),
        (bool(a["documents"] & b["documents"]), 10), (same("apply"), 12), ({a["role"], b["role"]} <= set(PROGRAMME_ROLES), 10), (a["type"] != b["type"], 4),
        (a["type"] in NO_PROGRAMME_TYPES, -30), (b["type"] in NO_PROGRAMME_TYPES, -30), (unlike("name") and a["parent"] != b["parent"], -35), (unlike("funder"), -20),
    ]
    return sum(p for c, p in parts if c)


def one_programme(a: dict, b: dict, judged: bool = True, decided: dict | None = None) -> bool:
    """Whether two records are one programme: a shared page decides first, even between domains, then the judge, decisions
    given from outside (by pair of ``ord``), then parents, paths and names."""
    unlike = lambda k: bool(a[k] and b[k] and a[k] != b[k])
    if set(a["urls"]) & set(b["urls"]):
        clash = unlike("name") and not (generic_name(a["name"]) or generic_name(b["name"]))
        return not (clash or unlike("parent") or unlike("funder"))
    if a["domain"] != b["domain"]:
        return False
    if judged:
        points = judge_points(a, b)
        if points >= MERGE_FROM or points <= SEPARATE_TO:
            return points >= MERGE_FROM
    complete = all(x[k] for x in (a, b) for k in ("name", "funder"))
    equal = a["name"] == b["name"] and a["funder"] == b["funder"]
    if complete and equal and decided and (a["ord"], b["ord"]) in decided:
        return decided[a["ord"], b["ord"]]
    if unlike("parent") or (a["context"] and b["context"] and not a["context"] & b["context"]):
        return False
    if not complete:
        return shared_evidence(a, b) and not unlike("name") and not unlike("funder")
    if not equal:
        return shared_evidence(a, b) and (generic_name(a["name"]) or generic_name(b["name"])) and a["funder"] == b["funder"]
    return a["parent"] == b["parent"]


def star(rows: list[dict], judged: bool = True) -> dict:
    """``ord`` of each record to that of its cluster: the first record left takes all that match it, and so on."""
    left, out = sorted((compared(r) for r in rows), key=lambda r: r["ord"]), {}
    while left:
        seed, rest = left[0], []
        for r in left:
            if r is seed or one_programme(seed, r, judged):
                out[r["ord"]] = seed["ord"]
            else:
                rest.append(r)
        left = rest
    return out


FIELDS = "ord long, domain string, name string, funder string, parent string, url string, urls array<string>, documents array<string>, apply_url string, role string, page_type string"
_FIELDS = [f.split()[0] for f in FIELDS.split(", ")]


def block_keys(records: DataFrame) -> DataFrame:
    """``ord, key``: what two records must share for any pair rule to merge them (page, or domain with a name, link, path or parent)."""

    def run(batches):
        for batch in batches:
            pairs = []
            for row in batch.to_pylist():
                r = compared(row)
                inside = {f"n {r['name']}", f"g {r['group']}", f"p {r['parent']}", *(f"k {k}" for k in r["keys"]), *(f"l {k}" for k in r["links"])} - {"n ", "p "}
                pairs += [(r["ord"], f"u {u}") for u in r["urls"]] + [(r["ord"], f"{r['domain']} {k}") for k in inside]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], type=pa.int64()), pa.array([p[1] for p in pairs], type=pa.string())], names=["ord", "key"])

    return records.select(*_FIELDS).mapInArrow(run, "ord long, key string")


def key_nodes(keys: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """``ord, keys`` of records with keys that others have, and ``keys, node``: records of equal keys as one, the least of them.

    A key of one record links nothing and is left out; rounds then go over nodes, however many records a node has."""
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    sets = keep(keys.join(shared, "key").groupBy("ord").agg(F.array_sort(F.collect_list("key")).alias("keys")), "key-sets")
    return sets, keep(sets.groupBy("keys").agg(F.min("ord").alias("node")), "key-nodes")


def blocks(records: DataFrame, keep) -> DataFrame:
    """``ord, block``: components of records that share keys, by least labels in rounds; each round is written by ``keep``.

    Labels go over keys, so a key that many records share costs a partial minimum, never a pair."""
    keys = keep(block_keys(records).select("ord", F.xxhash64("key").alias("key")).distinct(), "block-keys")
    sets, nodes = key_nodes(keys, keep)
    links = nodes.select("node", F.explode("keys").alias("key"))
    now = nodes.select("node", F.col("node").alias("block"))
    while True:
        least = links.join(now, "node").groupBy("key").agg(F.min("block").alias("low"))
        new = links.join(least, "key").groupBy("node").agg(F.min("low").alias("low"))
        new = now.join(new, "node").select("node", F.least("block", "low").alias("block"), F.col("block").alias("old"))
        jumped = new.join(now.select(F.col("node").alias("block"), F.col("block").alias("next")), "block")  # labels are nodes too
        now = keep(jumped.select("node", F.least("block", "next").alias("block"), "old"), "blocks")
        done = now.filter("block <> old").isEmpty()
        now = now.select("node", "block")
        if done:
            linked = sets.join(nodes, "keys").join(now, "node").select("ord", "block")
            return keys.select("ord").distinct().join(linked, "ord", "left").select("ord", F.coalesce("block", "ord").alias("block"))


def star_clusters(records: DataFrame, keep, judged: bool = True) -> DataFrame:
    """Adds ``cluster`` to records (``FIELDS``): greedy stars in order of ``ord``, each block in one task.

    Records of different blocks match under no rule, so the stars equal those over the whole table."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = star(rows.to_dict("records"), judged)
        return pd.DataFrame({"ord": list(found), "cluster": list(found.values())})

    rows = records.select(*_FIELDS).join(blocks(records, keep), "ord")
    return records.join(rows.groupBy("block").applyInPandas(run, "ord long, cluster long"), "ord")


def merged_programmes(clustered: DataFrame) -> DataFrame:
    """One record per cluster (needs ``FIELDS``, ``completeness, confidence, nature, amount, notes``), best record first.

    The order is completeness, confidence and nature, then ``ord``. Empty fields are filled from the next record that has
    them; a telling name goes before a generic one, programme pages before calls before listings; lists are united."""
    points = F.create_map(*[x for k, v in NATURE_POINTS.items() for x in (F.lit(k), F.lit(v))])
    worth = F.col("completeness") + F.floor(F.col("confidence") * 100) + F.coalesce(points[F.col("nature")], F.lit(0))
    rows = clustered.withColumn("_rank", F.struct((-worth).alias("w"), F.col("ord").alias("o")))
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).isin("", "Unknown")
    first = lambda c: F.min_by(F.when(~empty(c), F.col(c)), F.when(~empty(c), F.col("_rank"))).alias(c)
    order = F.create_map(*[x for k, v in TYPE_ORDER.items() for x in (F.lit(k), F.lit(-v))])
    telling = named("name")
    role = ~empty("role") & (F.col("role") != "generic")
    base = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("ord", "_rank").alias("survivor"),
        F.coalesce(F.min_by(F.when(telling, F.col("name")), F.when(telling, F.col("_rank"))), F.min_by(F.when(~empty("name"), F.col("name")), F.when(~empty("name"), F.col("_rank")))).alias("name"),
        first("funder"), first("parent"), first("apply_url"), first("amount"), F.min_by("domain", "_rank").alias("domain"),
        F.min_by("page_type", F.struct(F.coalesce(order[F.col("page_type")], F.lit(0)), "_rank")).alias("page_type"),
        F.coalesce(F.min_by(F.when(role, F.col("role")), F.when(role, F.col("_rank"))), F.lit("generic")).alias("role"), F.max("confidence").alias("confidence"),
    )
    for c in ("urls", "documents", "notes"):
        items = rows.select("cluster", F.col("_rank").alias("r"), F.posexplode(c).alias("i", "v")).groupBy("cluster", F.lower("v").alias("k")).agg(F.min(F.struct("r", "i", "v")).alias("x"))
        united = items.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias(c))
        base = base.join(united, "cluster", "left")
    many = F.size(F.coalesce("urls", F.array().cast("array<string>"))) > 1
    return base.withColumn("review", F.when(many, F.array(F.lit("merged_multi_page_record"))).otherwise(F.array().cast("array<string>")))
