"""Streams of page visits: restartable per-site upsert, windows with late data, decision cache, crawl rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def site_counts(visits: DataFrame) -> DataFrame:
    """Running counts of outcomes of each site; works on batches and streams."""
    return visits.groupBy("site", "outcome").agg(F.count(F.lit(1)).alias("n"))


def windowed(visits: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Extension: counts in tumbling windows, rows later than the watermark left out."""
    return visits.withWatermark("ts", late).groupBy(F.window("ts", length), "outcome").agg(F.count(F.lit(1)).alias("n"))


def replace_sites(stored_path: str, key: str = "site"):
    """A ``foreachBatch`` function: each batch replaces the stored rows of the sites it holds.

    The table is partitioned by site and only the batch's partitions are overwritten, so a batch costs what it holds,
    whatever its number, and one that is repeated after a failure gives the same table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(stored_path)

    return write


def run_once(stream: DataFrame, write, checkpoint: str) -> None:
    """Works off all that has arrived, then stops; a later call goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def decision_key(*columns: str) -> Column:
    """Key of the decision cache: digest of the content."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def cached_decisions(rows: DataFrame, cache: DataFrame, least: float = 0.85) -> DataFrame:
    """Rows with the cached decision of their key, where it is a sure rejection."""
    sure = cache.filter((F.col("decision") == "reject") & (F.col("confidence") >= least)).select("key", "decision").dropDuplicates(["key"])
    return rows.join(sure, "key", "left")


def crawl(
    spark: SparkSession, seeds: DataFrame, links: DataFrame, scratch: str, rounds: int, per_target: int = 50, depth: int = 2, queue: int = 500, per_page: int = 120
) -> DataFrame:
    """Best-first crawl over a table of links, one page per target and round: ``target, url, score, round``.

    seeds: ``target, url, score``; links: ``src, url, score``. Each round takes the best waiting url of every
    target (ties: first come, then url), adds the ``per_page`` best links of what it took, and drops what was seen and
    what goes beyond the best ``queue`` of a target. Each round's pages are a table of their own in ``scratch``."""
    best = Window.partitionBy("target").orderBy(F.desc("score"), "born", "url")
    of_page = Window.partitionBy("src").orderBy(F.desc("score"), "url")
    links = links.withColumn("_n", F.row_number().over(of_page)).filter(F.col("_n") <= per_page).drop("_n").withColumnsRenamed({"score": "s", "url": "u"})
    waiting = seeds.select("target", "url", "score", F.lit(0).alias("level"), F.lit(0).alias("born")).dropDuplicates(["target", "url"])
    done = None
    for n in range(min(rounds, per_target)):
        took = waiting.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
        took = _kept(took.withColumn("round", F.lit(n)), scratch)
        if took.isEmpty():
            break
        done = took if done is None else done.unionByName(took)
        fresh = took.filter(F.col("level") < depth).join(links, F.col("url") == F.col("src"))
        fresh = fresh.select("target", F.col("u").alias("url"), F.col("s").alias("score"), (F.col("level") + 1).alias("level"), F.lit(n + 1).alias("born"))
        merged = waiting.unionByName(fresh).groupBy("target", "url").agg(F.min(F.struct("born", "level", (-F.col("score")).alias("m"))).alias("x"))
        waiting = merged.join(done.select("target", "url"), ["target", "url"], "left_anti").select("target", "url", (-F.col("x.m")).alias("score"), F.col("x.level").alias("level"), F.col("x.born").alias("born"))
        waiting = _kept(waiting.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= queue).drop("_n"), scratch)
    return done if done is not None else waiting.limit(0).withColumn("round", F.lit(0))


def _kept(df: DataFrame, scratch: str) -> DataFrame:
    path = f"{scratch}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
