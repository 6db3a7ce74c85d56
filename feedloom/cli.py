"""Command line: extract, scan and parsedate over local pages."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.dates import match
from .functions.text import date_text
from .operators.export import to_json
from .plans.pipeline import Extractor, Finder


def _pages(spark: SparkSession, path: str, url: str | None):
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    from .sources.pages import from_files

    return from_files(spark, path, F.lit(url) if url else None)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="feedloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("extract", "scan"):
        p = sub.add_parser(name)
        p.add_argument("path", help="a Parquet file of pages, or HTML files")
        p.add_argument("--url", help="the page's URL, for HTML files")
        p.add_argument("-v", "--verbose", action="store_true")
    p = sub.add_parser("parsedate")
    p.add_argument("text")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("feedloom").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if getattr(args, "verbose", False) else "ERROR")
    if args.command == "parsedate":
        row = spark.range(1).select(match(date_text(F.lit(args.text))).alias("m")).select("m.key", "m.dt").first()
        print(row["key"], row["dt"])
    elif args.command == "extract":
        for row in to_json(Extractor(spark, 150).extract(_pages(spark, args.path, args.url))[0]).toLocalIterator():
            print(row["json"])
    else:
        for row in Finder(spark).find(_pages(spark, args.path, args.url), extractrss=True).toJSON().toLocalIterator():
            print(row)
    return 0
