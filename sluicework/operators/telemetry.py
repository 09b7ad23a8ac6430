"""Run telemetry: totals, per-site reports, statuses, gap ratios, budgets, resume filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(c: Column) -> Column:
    """Sum in decimals, equal in any order."""
    return F.sum(c.cast("decimal(18,4)"))


def run_status(errors: Column, good: Column) -> Column:
    """Failed if there are errors and nothing good, partial if there are errors, else success, even of nothing.

    What is good differs: pages fetched for crawls, merged records for hybrid runs, accepted and reviewed records for
    search runs."""
    return F.when((errors > 0) & (F.coalesce(good, F.lit(0)) == 0), "failed").when(errors > 0, "partial").otherwise("success")


def page_records(records: DataFrame, site: str = "site", page: str = "url") -> DataFrame:
    """Records of each site's pages: pages, those with several records, the most of one page; in two steps, so that no page's
    records are gathered."""
    pages = records.filter(F.col(page).isNotNull()).groupBy(site, page).agg(F.count(F.lit(1)).alias("n"))
    return pages.groupBy(site).agg(F.count(F.lit(1)).alias("candidate_pages"), F.count_if(F.col("n") > 1).alias("multi_pages"), F.max("n").alias("most_of_a_page"))


def site_report(visits: DataFrame, site: str = "site", outcome: str = "outcome", seconds: str = "seconds") -> DataFrame:
    """Counters of each site: pages, successes, skips by reason, weighted seconds, status."""
    ok, failed, skipped = (F.count_if(F.col(outcome) == x) for x in ("ok", "failed", "skipped"))
    return (
        visits.groupBy(site)
        .agg(
            F.count(F.lit(1)).alias("pages"),
            ok.alias("ok"),
            failed.alias("failed"),
            skipped.alias("skipped"),
            exact_sum(F.when(F.col(outcome) == "ok", F.col(seconds))).alias("ok_seconds"),
            F.count_distinct(F.col("url")).alias("urls"),
        )
        .withColumn("mean_seconds", F.when(F.col("ok") > 0, F.round(F.col("ok_seconds").cast("double") / F.col("ok"), 4)))
        .withColumn("status", run_status(F.col("failed"), F.col("ok")))
    )


def run_totals(report: DataFrame) -> DataFrame:
    """Totals over sites; the mean of seconds is weighted by good pages."""
    return report.agg(
        F.count(F.lit(1)).alias("sites"),
        F.sum("pages").alias("pages"),
        F.sum("ok").alias("ok"),
        F.sum("failed").alias("failed"),
        F.count_if(F.col("status") == "partial").alias("partial_sites"),
        F.round(F.coalesce((F.sum("ok_seconds") / F.nullif(F.sum("ok"), F.lit(0))).cast("double"), F.lit(0.0)), 4).alias("mean_seconds"),
    )


def reason_counts(rows: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Map of reason to count for each key: two sums, none of which gathers rows."""
    counted = rows.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("counts"))


def budget(calls: DataFrame, ident: str, key: str, order: list, per_key: int) -> DataFrame:
    """Adds whether a call is within the budget of its key and, if so, how many were ``used`` with it.

    Only the first calls of a key are numbered, cut down before the shuffle; a key with most of the calls is no burden."""
    first = calls.withColumn("used", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("used") <= per_key)
    out = calls.join(first.select(ident, "used"), ident, "left")
    return out.withColumn("allowed", F.col("used").isNotNull())


def combine(telemetry: DataFrame, decisions: DataFrame, key: str | list[str]) -> DataFrame:
    """Full outer of two counters by site, missing sides as zero."""
    joined = telemetry.join(decisions, key, "full_outer")
    return joined.na.fill(0)


def not_done(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Targets that no finished run holds."""
    return targets.join(done.select(key).distinct(), key, "left_anti")
