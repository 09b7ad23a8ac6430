"""Telemetry queries over events as page visits, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import telemetry
from ..operators.matching import top_per
from ..streaming.visits import site_counts
from .views import folder, table

VISITS_SQL = """visits AS (SELECT event_id, ts, user_id % 50 AS site, value AS seconds, event_type,
    CASE WHEN event_id % 10 < 6 THEN 'ok' WHEN event_id % 10 < 8 THEN 'failed' ELSE 'skipped' END AS outcome,
    'u' || CAST(user_id AS VARCHAR) AS url FROM events)"""
SITES_SQL = f"""{VISITS_SQL}, sites AS (SELECT site, count(*) AS pages, count_if(outcome = 'ok') AS ok, count_if(outcome = 'failed') AS failed,
    count_if(outcome = 'skipped') AS skipped, sum(CASE WHEN outcome = 'ok' THEN CAST(seconds AS DECIMAL(18, 4)) END) AS ok_seconds, count(DISTINCT url) AS urls
  FROM visits GROUP BY site)"""
_STATUS = "CASE WHEN failed > 0 AND ok = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'success' END"


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(table(spark, sf_dir, "events"))


def _shaped(e: DataFrame) -> DataFrame:
    """Events as page visits; batches and streams alike."""
    turn = F.col("event_id") % 10
    return e.select(
        "event_id", "ts", (F.col("user_id") % 50).alias("site"), F.col("value").alias("seconds"), "event_type",
        F.when(turn < 6, "ok").when(turn < 8, "failed").otherwise("skipped").alias("outcome"),
        F.concat(F.lit("u"), F.col("user_id")).alias("url"),
    )


def site_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, K4, K5: counters, weighted seconds, records of pages and status of each site."""
    v = _visits(spark, sf_dir)
    report = telemetry.site_report(v).drop("ok_seconds")
    return report.join(telemetry.page_records(v.filter("outcome = 'ok'")), "site", "left")


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: status of each day's run of each kind: crawls by pages, hybrid runs by purchases, search runs by purchases and views."""
    v = _visits(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "site").agg(
        F.count_if(F.col("outcome") == "failed").alias("errors"), F.count_if(F.col("outcome") == "ok").alias("fetched"),
        F.count_if(F.col("event_type") == "purchase").alias("merged"), F.count_if(F.col("event_type").isin("purchase", "view")).alias("found"),
    )
    status = lambda good: telemetry.run_status(F.col("errors"), F.col(good))
    return v.select(F.col("day").cast("string").alias("day"), "site", status("fetched").alias("crawl"), status("merged").alias("hybrid"), status("found").alias("search"))


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all sites."""
    return telemetry.run_totals(telemetry.site_report(_visits(spark, sf_dir)))


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipped visits of each site by reason, as a map."""
    counted = telemetry.reason_counts(_visits(spark, sf_dir).filter("outcome = 'skipped'"), ["site"], "event_type")
    return counted.select("site", F.to_json("counts").alias("counts"))


def gap_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of failures of each event type; nothing gives 0."""
    v = _visits(spark, sf_dir)
    return v.groupBy("event_type").agg(F.round(F.avg((F.col("outcome") == "failed").cast("double")), 6).alias("failure_rate"), F.count(F.lit(1)).alias("n"))


def call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls of each url's funder are within five, and the number used with those."""
    calls = _visits(spark, sf_dir).filter("outcome = 'ok'").select("event_id", "ts", F.col("url").alias("funder"))
    return telemetry.budget(calls, "event_id", "funder", ["ts", "event_id"], 5).select("event_id", "used", "allowed")


def combined_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By day and site, good visits to expensive pages and failed ones to cheap pages, full outer."""
    v = _visits(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    crawl = v.filter("outcome = 'ok' and seconds > 80").groupBy("day", "site").agg(F.count(F.lit(1)).alias("crawled"))
    web = v.filter("outcome = 'failed' and seconds < 20").groupBy("day", "site").agg(F.count(F.lit(1)).alias("searched"))
    return telemetry.combine(crawl, web, ["day", "site"])


def resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets (a url on a day) that no good visit has finished."""
    v = _visits(spark, sf_dir).withColumn("target", F.concat_ws(" ", "url", F.to_date("ts")))
    return telemetry.not_done(v.select("target", "site").distinct(), v.filter("outcome = 'ok'"), "target")


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest visits of each site."""
    v = _visits(spark, sf_dir).select("site", "event_id", "ts")
    return top_per(v, ["site"], [F.desc_nulls_last("ts"), F.desc("event_id")], 3).select("site", "place", "event_id")


def retry_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: outcomes in hours of each day (tumbling windows)."""
    v = _visits(spark, sf_dir)
    return v.groupBy(F.date_trunc("day", "ts").alias("day"), "outcome").agg(F.count(F.lit(1)).alias("n"))


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each site and outcome by a stream that works off all files, its state in a checkpoint."""
    path = folder(spark, "stream")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: a stream takes a plain path for a folder
    counts = site_counts(_shaped(events))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/counts")

    run = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/counts")


def fallback_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every site, failed ones or not, its first five distinct kinds of failure in order of time."""
    v = _visits(spark, sf_dir)
    first = v.filter("outcome = 'failed'").groupBy("site", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    listed = top_per(first, ["site"], ["at"], 5).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("place", "event_type"))).alias("x"))
    sites = v.select("site").distinct().join(listed, "site", "left")
    return sites.select("site", F.array_join(F.transform(F.coalesce("x", F.array()), lambda s: s["event_type"]), "|").alias("reasons"))


QUERIES = {
    "t3_streamed_counts": streamed_counts,
    "k7_fallback_reasons": fallback_reasons,
    "k4_site_report": site_report,
    "k5_run_states": run_states,
    "k1_run_totals": run_totals,
    "k14_skip_reasons": skip_reasons,
    "k6_gap_ratios": gap_ratios,
    "k17_call_budget": call_budget,
    "j10_combined_sites": combined_sites,
    "j8_resumable": resumable,
    "w4_latest_runs": latest_runs,
    "t0_daily_outcomes": retry_rates,
}

ORACLE_SQL = {
    "t3_streamed_counts": f"WITH {VISITS_SQL} SELECT site, outcome, count(*) AS n FROM visits GROUP BY site, outcome",
    "k7_fallback_reasons": f"""WITH {VISITS_SQL}, f AS (SELECT site, event_type, min((ts, event_id)) AS began FROM visits WHERE outcome = 'failed' GROUP BY site, event_type),
        p AS (SELECT site, event_type, row_number() OVER (PARTITION BY site ORDER BY began) AS place FROM f), l AS (SELECT site, string_agg(event_type, '|' ORDER BY place) AS reasons FROM p WHERE place <= 5 GROUP BY site)
        SELECT site, coalesce(reasons, '') AS reasons FROM (SELECT DISTINCT site FROM visits) LEFT JOIN l USING (site)""",
    "k4_site_report": f"""WITH {SITES_SQL}, per AS (SELECT site, url, count(*) AS n FROM visits WHERE outcome = 'ok' GROUP BY site, url),
        rec AS (SELECT site, count(*) AS candidate_pages, count(*) FILTER (WHERE n > 1) AS multi_pages, max(n) AS most_of_a_page FROM per GROUP BY site)
        SELECT site, pages, ok, failed, skipped, urls, CASE WHEN ok > 0 THEN round(CAST(ok_seconds AS DOUBLE) / ok, 4) END AS mean_seconds, {_STATUS} AS status,
          candidate_pages, multi_pages, most_of_a_page FROM sites LEFT JOIN rec USING (site)""",
    "k5_run_states": f"""WITH {VISITS_SQL}, d AS (SELECT CAST(ts AS DATE) AS day, site, count(*) FILTER (WHERE outcome = 'failed') AS errors, count(*) FILTER (WHERE outcome = 'ok') AS a,
          count(*) FILTER (WHERE event_type = 'purchase') AS b, count(*) FILTER (WHERE event_type IN ('purchase', 'view')) AS c FROM visits GROUP BY 1, 2)
        SELECT CAST(day AS VARCHAR) AS day, site, """
    + ", ".join(f"CASE WHEN errors = 0 THEN 'success' WHEN {x} = 0 THEN 'failed' ELSE 'partial' END AS {n}" for x, n in (("a", "crawl"), ("b", "hybrid"), ("c", "search")))
    + " FROM d",
    "k1_run_totals": f"""WITH {SITES_SQL} SELECT count(*) AS sites, sum(pages)::BIGINT AS pages, sum(ok)::BIGINT AS ok, sum(failed)::BIGINT AS failed,
        count_if(failed > 0 AND failed < pages) AS partial_sites, round(coalesce(CAST(sum(ok_seconds) AS DOUBLE) / sum(ok), 0), 4) AS mean_seconds FROM sites""",
    "k14_skip_reasons": f"""WITH {VISITS_SQL}, c AS (SELECT site, event_type, count(*) AS n FROM visits WHERE outcome = 'skipped' GROUP BY site, event_type)
        SELECT site, '{{' || string_agg('"' || event_type || '":' || CAST(n AS VARCHAR), ',' ORDER BY event_type) || '}}' AS counts FROM c GROUP BY site""",
    "k6_gap_ratios": f"""WITH {VISITS_SQL} SELECT event_type, round(avg(CASE WHEN outcome = 'failed' THEN 1.0::DOUBLE ELSE 0 END), 6) AS failure_rate, count(*) AS n FROM visits GROUP BY event_type""",
    "k17_call_budget": f"""WITH {VISITS_SQL}, c AS (SELECT event_id, count(*) OVER (PARTITION BY url ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM visits WHERE outcome = 'ok')
        SELECT event_id, CASE WHEN used <= 5 THEN used END AS used, used <= 5 AS allowed FROM c""",
    "j10_combined_sites": f"""WITH {VISITS_SQL}, v AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM visits), a AS (SELECT day, site, count(*) AS crawled FROM v WHERE outcome = 'ok' AND seconds > 80 GROUP BY day, site),
        b AS (SELECT day, site, count(*) AS searched FROM v WHERE outcome = 'failed' AND seconds < 20 GROUP BY day, site)
        SELECT day, site, coalesce(crawled, 0) AS crawled, coalesce(searched, 0) AS searched FROM a FULL JOIN b USING (day, site)""",
    "j8_resumable": f"""WITH {VISITS_SQL}, v AS (SELECT *, url || ' ' || CAST(CAST(ts AS DATE) AS VARCHAR) AS target FROM visits)
        SELECT DISTINCT target, site FROM v WHERE target NOT IN (SELECT target FROM v WHERE outcome = 'ok')""",
    "w4_latest_runs": f"""WITH {VISITS_SQL} SELECT site, row_number() OVER (PARTITION BY site ORDER BY ts DESC NULLS LAST, event_id DESC)::INT AS place, event_id FROM visits
        QUALIFY place <= 3""",
    "t0_daily_outcomes": f"WITH {VISITS_SQL} SELECT date_trunc('day', ts)::TIMESTAMP AS day, outcome, count(*) AS n FROM visits GROUP BY 1, 2",
}
