"""Command line: ``python -m sluicework <command> ...`` over tables in a folder."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import builder
from .plans.views import kept
from .sources import tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sluicework")
    sub = parser.add_subparsers(dest="command", required=True)
    records = sub.add_parser("records", help="pages (Parquet: page_id, url, html) to records")
    export = sub.add_parser("export-csv", help="records (Parquet) to CSV")
    seeds = sub.add_parser("seeds", help="a seed file (JSON) to the first url of each host")
    merge = sub.add_parser("dedupe", help="records with the columns of the pair rules (Parquet) to clusters")
    for p in (records, export, seeds, merge):
        p.add_argument("source")
        p.add_argument("target")
    records.add_argument("--as-of", required=True, help="the day that stands for now, yyyy-mm-dd")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sluicework").getOrCreate()
    if args.command == "records":
        builder.page_records(spark.read.parquet(args.source), F.lit(args.as_of).cast("date")).write.mode("overwrite").parquet(args.target)
    elif args.command == "export-csv":
        tables.export_csv(spark.read.parquet(args.source), args.target)
    elif args.command == "seeds":
        tables.seeds_by_host(tables.seed_urls(spark, args.source)).write.mode("overwrite").json(args.target)
    else:
        from .operators.resolve import star_clusters

        star_clusters(spark.read.parquet(args.source), kept).write.mode("overwrite").parquet(args.target)
    print(json.dumps({"command": args.command, "target": args.target}))


if __name__ == "__main__":
    main()
