"""New items of pages that keep arriving: each micro-batch is extracted, and items seen before are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline import Extractor

PAGES = "page_id long, url string, html string, fetched timestamp"


def pages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files of pages with their time of fetching."""
    reader = spark.readStream.schema(PAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def extract_new(stream: DataFrame, out: str, checkpoint: str, text_limit: int = 50, reuse_patterns: bool = False, **trigger):
    """Starts a query that appends the new items of each micro-batch to `out` in a folder per batch.

    An item is new if no earlier batch wrote its id. With reuse_patterns, a page is matched by the date patterns that earlier
    batches found on its host alone, if they found any. A batch replayed after a failure looks at the batches before it only and
    writes its own folder again, so each batch counts once.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        latest = df.groupBy("page_id").agg(F.max_by(F.struct("url", "html", "fetched"), "fetched").alias("p")).select("page_id", "p.*")
        before = earlier(spark, out, number)
        if reuse_patterns and before is not None:
            known = before.groupBy(host(F.col("url")).alias("host")).agg(F.collect_set("t_key").alias("cached_p"))
            latest = latest.withColumn("host", host(F.col("url"))).join(known, "host", "left").drop("host")
        extractor = Extractor(spark, text_limit)
        dated = extractor.dated(latest)
        items = extractor.items(latest, dated).join(latest.select("page_id", "url", "fetched"), "page_id").dropDuplicates(["unique_id"])
        if before is not None:
            items = items.join(before.select("unique_id"), "unique_id", "left_anti")
        items.write.mode("overwrite").parquet(f"{out}/batch={number}")
        dated.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def host(url):
    return F.regexp_extract(url, "://([^/?#]*)", 1)


def earlier(spark: SparkSession, out: str, number: int) -> DataFrame | None:
    """The items that batches before `number` wrote; None if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [f.getPath().getName() for f in files.listStatus(path)]
    paths = [f"{out}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < number]
    return spark.read.parquet(*paths) if paths else None


def first_seen(items: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of items (unique_id, fetched, ...) without those whose id came within delay before."""
    return items.withWatermark("fetched", delay).dropDuplicatesWithinWatermark(["unique_id"])
