"""Programme-, profile- and run-shaped views over the driver tables, in Spark and in SQL."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1997-01-01"
"""The day that stands for now; every status and score takes it as an argument."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's, or one beside the warehouse where none is set; on a cluster that
    must not be a folder of one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    beside = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not spark.sparkContext.master.startswith("local") and ("://" not in beside or beside.startswith("file:")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return beside


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read back: what follows starts from the table."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``scratch``; what is written there goes when the driver ends."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before the interpreter
            return


_PROGRAMMES = """
base AS (SELECT l_partkey AS pk, l_suppkey AS sk, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, max(l_shipdate) AS shipped,
    min(l_discount) AS d1, max(l_discount) AS d2 FROM {lineitem} GROUP BY l_partkey, l_suppkey),
programmes AS (SELECT pk * 100000 + sk AS pid, pk, sk,
    CASE WHEN pk % 17 = 0 THEN '' ELSE p_name END AS program_name,
    CASE WHEN sk % 23 = 0 THEN NULL ELSE s_name END AS funder_name,
    CASE p_size % 6 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Grant' WHEN 2 THEN 'Loan' WHEN 3 THEN 'Equity' WHEN 4 THEN 'Guarantee' ELSE 'Hybrid' END AS funding_type,
    CASE WHEN pk % 5 = 0 THEN NULL WHEN sk % 10 = 3 THEN hi ELSE lo END AS ticket_min,
    CASE WHEN pk % 7 = 0 THEN NULL WHEN sk % 10 = 3 THEN lo ELSE hi END AS ticket_max,
    CASE sk % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Online form' ELSE 'Email' END AS application_channel,
    CASE WHEN sk % 4 = 0 THEN NULL ELSE 'https://apply.example.com/' || CAST(sk AS VARCHAR(20)) END AS application_url,
    CASE WHEN sk % 6 = 0 THEN NULL ELSE 's' || CAST(sk AS VARCHAR(20)) || '@example.com' END AS contact_email,
    CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE n_name END AS province,
    CASE WHEN s_nationkey % 5 = 0 THEN 'National' WHEN s_nationkey % 5 = 1 THEN 'Unknown' ELSE 'Province' END AS geography_scope,
    CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS industry,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS use_of_funds,
    pk % 9 = 0 AS has_ownership, pk % 4 <> 0 AS has_eligibility, pk % 6 = 0 AS has_documents,
    CASE p_size % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Open' WHEN 2 THEN 'Rolling' ELSE 'FixedDate' END AS deadline_type,
    CASE WHEN p_size % 4 = 3 THEN CAST(shipped AS DATE) END AS deadline_date,
    CASE WHEN sk % 11 = 0 THEN 'Archived programme' WHEN sk % 31 = 0 THEN 'Suspended until review' ELSE '' END AS note,
    pk % 13 = 0 AS has_conflicts, CAST(sk % 7 AS INT) AS n_reviews, d1 * 10 AS conf_a, d2 * 10 AS conf_b,
    CASE pk % 19 WHEN 0 THEN 'news_article' WHEN 1 THEN 'tender_procurement' WHEN 2 THEN 'funding_listing' ELSE 'funding_programme' END AS page_type,
    'https://www.example.com/' || CASE WHEN pk % 29 = 0 THEN 'news/' ELSE 'p/' END || CAST(pk % 500 AS VARCHAR(20)) AS source_url,
    p_name AS source_title, CASE WHEN sk % 2 = 0 THEN 'approved' ELSE 'pending' END AS approval_status,
    CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Startup' WHEN 2 THEN 'Early stage' WHEN 3 THEN 'Growth and expansion' ELSE 'Established' END AS stage,
    CASE WHEN p_size % 3 > 0 THEN p_size % 10 END AS years_min, CASE WHEN p_size % 4 > 0 THEN p_size % 10 + 6 END AS years_max,
    CASE WHEN p_size % 2 = 0 THEN p_size * 1000 END AS turnover_min, CASE WHEN p_size % 2 = 0 THEN p_size * 1000 + 40000 END AS turnover_max,
    CASE WHEN p_size % 3 = 0 THEN p_size END AS staff_min, CASE WHEN p_size % 3 = 0 THEN p_size + 30 END AS staff_max,
    pk % 10 = 0 AS ai_enriched, CASE WHEN sk % 5 = 0 THEN '011 555 0100' END AS contact_phone, CASE WHEN pk % 8 = 0 THEN hi * 10 END AS budget_total
  FROM base JOIN {part} ON pk = p_partkey JOIN {supplier} ON sk = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey)
"""
_TABLES = ("lineitem", "part", "supplier", "nation")
PROGRAMMES_SQL = _PROGRAMMES.format(**{n: n for n in _TABLES})


def programmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programme-shaped rows: one per part and supplier, with arrays and a confidence map."""
    flat = spark.sql(f"WITH {_PROGRAMMES} SELECT * FROM programmes", **{n: table(spark, sf_dir, n) for n in _TABLES})
    none = F.array().cast("array<string>")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c))).otherwise(none)
    when = lambda c, v: F.when(F.col(c), F.array(F.lit(v))).otherwise(none)
    return flat.select(
        "*",
        one("province").alias("provinces"),
        none.alias("municipalities"),
        one("industry").alias("industries"),
        one("use_of_funds").alias("funds_used"),
        one("stage").alias("stages"),
        when("has_ownership", "women-owned").alias("ownership_targets"),
        when("has_eligibility", "must be registered").alias("raw_eligibility"),
        when("has_documents", "guidelines.pdf").alias("related_documents"),
        F.when(F.col("note") == "", none).otherwise(F.array("note")).alias("notes"),
        F.slice(F.array(*[F.lit(x) for x in "abcdefg"]), 1, F.col("n_reviews")).alias("review_reasons"),
        F.create_map(F.lit("program_name"), F.col("conf_a"), F.lit("funding_type"), F.col("conf_b")).alias("confidence"),
    )
