"""Site registry, users, patches, checkpoints, evidence and views over the catalogue's tables."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.html import spread
from .catalog import latest_by, upsert

SITE = "site_key string, display_name string, primary_domain string, adapter_key string, seed_urls array<string>, adapter_config string, ai_enrichment_required boolean, active boolean, notes array<string>"


def active_sites(sites: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Active sites by name; another table where there are none."""
    found = sites.filter("active").select(*[f.split()[0] for f in SITE.split(", ") if not f.startswith("notes")])
    return (fallback if fallback is not None and found.isEmpty() else found).orderBy("display_name")


def rows_of(table: DataFrame, columns: list[str], equal: dict | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a table by the terms of a REST request: columns, equal values, order and count; Spark pushes them down."""
    out = table
    for c, v in (equal or {}).items():
        out = out.filter(F.col(c) == v)
    out = out.select(*columns)
    out = out.orderBy(*order) if order else out
    return out.limit(limit) if limit is not None else out


def recordset(payloads: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of the JSON arrays in a column, with ``place``; what is no array gives none (see ``rejected``)."""
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in schema.split(", "))
    return payloads.select(F.posexplode(F.from_json(column, f"array<struct<{fields}>>")).alias("place", "r")).select("place", "r.*")


def rejected(payloads: DataFrame, column: str) -> DataFrame:
    """Payloads that are no JSON array."""
    return payloads.filter(~F.coalesce(F.trim(column).startswith("[") & F.json_array_length(column).isNotNull(), F.lit(False)))


def registered(sites: DataFrame, payload: DataFrame, order: str) -> DataFrame:
    """The registry with the sites of a batch in place of those of their key; the last of a key wins, notes are kept."""
    return upsert(sites, payload, ["site_key"], order, keep=("notes",))


def touched(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """``new`` with ``updated_at``: now where a row differs from the old one of its key, else as it was."""
    rest = [c for c in new.columns if c not in (key, "updated_at")]
    before = old.select(F.col(key), F.struct(*rest).alias("_old"), F.col("updated_at").alias("_was"))
    same = F.struct(*rest).eqNullSafe(F.col("_old"))
    return new.drop("updated_at").join(before, key, "left").withColumn("updated_at", F.when(same, F.col("_was")).otherwise(now)).drop("_old", "_was")


def signed_up(users: DataFrame, events: DataFrame, order: str) -> DataFrame:
    """Users with those of a batch of sign-ups (``id, email, meta``, JSON): new ones get a role, known ones keep theirs."""
    field = lambda c: F.get_json_object("meta", f"$.{c}")
    name = F.coalesce(field("full_name"), field("name"), F.split(F.coalesce("email", F.lit("")), "@")[0])
    role = F.when(F.lower(F.coalesce(field("role"), F.lit(""))) == "admin", "admin").otherwise("applicant")
    new = events.select("id", F.coalesce("email", F.lit("")).alias("email"), name.alias("full_name"), role.alias("role"), F.col(order).alias("seq"))
    return upsert(users, new, ["id"], "seq", keep=("role",))


def of_admins(rows: DataFrame, users: DataFrame, by: str = "user_id") -> DataFrame:
    """Rows whose user is an admin."""
    return rows.join(users.filter("role = 'admin'").select(F.col("id").alias(by)), by, "left_semi")


def patched(table: DataFrame, patches: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with the fields that patches set (a null sets nothing); the last patch of a key wins; unknown keys are left out."""
    fields = [c for c in patches.columns if c not in (key, order)]
    last = latest_by(patches, [key], order).select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    out = table.join(last, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def uploaded(records: DataFrame, send: Callable[[list[dict]], dict], batch: int = 5) -> DataFrame:
    """Results of sending records in batches (``sent, result``), halved on a timeout down to single records.

    Records are dealt over the cluster and batches cut within partitions; ``send`` must bear repeats, as a lost executor's
    records are sent again."""

    def push(rows: list[dict]):
        try:
            yield len(rows), send(rows)
        except TimeoutError:
            if len(rows) == 1:
                raise
            half = (len(rows) + 1) // 2
            yield from push(rows[:half])
            yield from push(rows[half:])

    def written(result: dict) -> str:
        try:
            return json.dumps(result, allow_nan=False)
        except (TypeError, ValueError):  # values that JSON lacks
            return pd.Series(result).to_json()

    def run(parts):
        for part in parts:
            rows = part.to_dict("records")
            found = [x for lo in range(0, len(rows), batch) for x in push(rows[lo : lo + batch])]
            yield pd.DataFrame({"sent": [n for n, _ in found], "result": [written(r) for _, r in found]})

    return spread(records).mapInPandas(run, "sent long, result string")


def merged_results(results: DataFrame, numbers: list[str], lists: list[str]) -> DataFrame:
    """One row: sums of the numbers of all results (JSON) and the distinct items of their lists, sorted.

    One pass, as every pass over ``uploaded`` sends all records again."""
    field = lambda c: F.get_json_object("result", f"$.{c}")
    none = F.array().cast("array<struct<c:string,v:string>>")
    named = lambda c: F.transform(F.from_json(field(c), "array<string>"), lambda v: F.struct(F.lit(c).alias("c"), v.alias("v")))
    items = [F.coalesce(named(c), none) for c in lists]
    rows = results.select(*[field(c).cast("double").alias(f"_n{i}") for i, c in enumerate(numbers)], F.posexplode_outer(F.concat(none, *items)).alias("_at", "_item"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    sums = rows.agg(*[F.sum(F.when(first, F.col(f"_n{i}"))).alias(c) for i, c in enumerate(numbers)], F.collect_set(F.when(F.col("_item.v").isNotNull(), F.col("_item"))).alias("_items"))
    of = lambda c: F.array_sort(F.transform(F.filter("_items", lambda x: x["c"] == c), lambda x: x["v"]))
    return sums.select(*numbers, *[of(c).alias(c) for c in lists])


# Rank of the ways in which evidence was found.
METHODS = {
    "direct_page_evidence": 5, "deterministic_parser": 4, "regex_from_prose": 3, "heading_based_inference": 2, "parent_page_inheritance": 1,
    "llm_only_inference": 0,
}


def field_confidence(evidence: DataFrame, methods: dict[str, int] | None = None) -> DataFrame:
    """``program_id, confidence``: of each field the confidence of its best evidence, by way and then by confidence."""
    rank = F.create_map(*[x for k, v in (methods or METHODS).items() for x in (F.lit(k), F.lit(v))])
    best = evidence.groupBy("program_id", "field").agg(F.max_by("confidence", F.struct(F.coalesce(rank[F.col("method")], F.lit(0)), "confidence")).alias("c"))
    return best.groupBy("program_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.round("c", 4))))).alias("confidence"))


def by_confidence(scores: Column) -> Column:
    """Fields of a confidence map, surest first, then by name."""
    return F.transform(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("c"), e["key"].alias("k")))), lambda e: e["k"])


def merged_confidence(a: Column, b: Column) -> Column:
    """The greater confidence of each field."""
    none = F.create_map().cast("map<string,double>")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: F.greatest(x, y))


def folded_evidence(records: DataFrame, evidence: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """Records (``program_id``) with what evidence (``program_id, field, value, confidence``) adds: empty fields take the surest
    value, lists are united with all values, and the greater confidence of a field is kept."""
    out = records
    best = evidence.filter(F.col("field").isin(*scalars)).groupBy("program_id").pivot("field", scalars).agg(F.max_by("value", F.struct("confidence", "value")))
    out = out.join(best.select("program_id", *[F.col(c).alias(f"_{c}") for c in scalars]), "program_id", "left")
    for c in lists:
        items = evidence.filter(F.col("field") == c).groupBy("program_id").agg(F.array_sort(F.collect_set("value")).alias(f"_{c}"))
        out = out.join(items, "program_id", "left")
    sure = evidence.groupBy("program_id", "field").agg(F.max("confidence").alias("c")).groupBy("program_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "c")))).alias("_sure"))
    none = F.array().cast("array<string>")
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin("", "Unknown")
    cols = {c: F.when(empty(c), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in scalars} | {c: text.unique_text(F.concat(F.coalesce(c, none), F.coalesce(f"_{c}", none))) for c in lists}
    out = out.join(sure, "program_id", "left").withColumns(cols | {"confidence": merged_confidence(F.col("confidence"), F.col("_sure"))})
    return out.select(*records.columns)


def latest_checkpoint(checkpoints: DataFrame, run_id: str | None = None) -> DataFrame:
    """The newest checkpoint, of a run or of all."""
    rows = checkpoints if run_id is None else checkpoints.filter(F.col("run_id") == run_id)
    return rows.orderBy(F.desc("updated_at"), "checkpoint_id").limit(1)


def pruned(checkpoints: DataFrame, keep: int = 10) -> DataFrame:
    """The newest checkpoints of each run."""
    newest = Window.partitionBy("run_id").orderBy(F.desc("updated_at"), "checkpoint_id")
    return checkpoints.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep).drop("_n")


# Funding types that the catalogue shows.
SHOWN_TYPES = ("grant", "equity", "loan", "fellowship", "guarantee", "hybrid", "other", "unknown")


def catalogue_view(records: DataFrame, as_of: Column) -> DataFrame:
    """Records as the catalogue shows them: defaults, places united, mean confidence (a half without any), shown status."""
    from ..functions.numbers import view_status

    some = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    none = F.array().cast("array<string>")
    provider = F.when(some("funder_name"), F.trim("funder_name")).when(some("source_domain"), F.col("source_domain")).otherwise("Unknown provider")
    places = F.array_distinct(F.concat(F.coalesce("provinces", none), F.coalesce("municipalities", none), F.when(some("geography_scope"), F.array("geography_scope")).otherwise(none)))
    kind = F.lower(F.coalesce("funding_type", F.lit("unknown")))
    values = F.map_values("confidence")
    mean = F.when(F.col("confidence").isNull(), 0.5).otherwise(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(values), F.lit(1)))
    return records.select(
        "program_id", provider.alias("provider"), F.when(some("source_url"), F.col("source_url")).otherwise("#").alias("source_url"),
        F.when(some("title"), F.trim("title")).otherwise(provider).alias("source_name"), F.when(F.size(places) > 0, places).otherwise(F.array(F.lit("Unknown"))).alias("geography"),
        F.when(kind.isin(*SHOWN_TYPES), kind).otherwise("unknown").alias("funding_type"), view_status(F.col("deadline_type"), F.col("deadline_date"), as_of).alias("status"),
        mean.alias("scrape_confidence"), F.coalesce("approval_status", F.lit("pending")).alias("approval_status"),
    )


def eligibility_signals(conditions: dict[str, Column]) -> Column:
    """Names of the signals that a record has, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]))
