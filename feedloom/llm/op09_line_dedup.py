"""Line dedup: range-partitioned line hashes, secondary sort, keep bitmaps. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 20
MIN_DOCS = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _print(text: Column) -> Column:
    """Tells apart different texts that share an id."""
    return F.hash(F.coalesce(text, F.lit("")))


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, print, keep, n_dropped) for every document that loses lines; the others keep all.

    keep is a run-length-coded bitmap of the kept lines: an array of (start, length), lines counted from 0.
    A line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased. A key of min_chars code points
    or more that min_docs different ids hold loses its lines everywhere but in the largest of these ids.
    Hashes are of 128 bits. Rows with an equal id count as one document; rows without an id lose lines like any
    others but count for none. Null and empty texts have one empty line. An empty table gives no rows.

    Keys with more lines than `limit` are found by counts over 65,536 bins and settled by pre-aggregation (at most
    total / limit of them, so their table may be broadcast); all others are range-partitioned by hash, sorted by
    document and position, and streamed, so that no task holds more than limit lines of a key.
    """
    lines = (
        df.select(F.col(id_col).alias("doc_id"), _print(F.col(text_col)).alias("print"), F.posexplode(_lines(common.ascii_lower(F.col(text_col)))).alias("pos", "line"))
        .where(f"char_length(line) >= {int(min_chars)}")
        .withColumn("key", F.btrim("line", F.lit(common.SPACES)))
        .where(f"char_length(key) >= {int(min_chars)}")
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.reverse("key")).alias("h2"), "doc_id", "print", "pos")
    )
    lines = common.cut(lines, "lines")
    bins = lines.groupBy(F.shiftrightunsigned("h1", 48).alias("bin")).agg(F.count("*").alias("n"))
    bins = common.cut(bins, "bins")  # 65,536 rows at most
    total = bins.agg(F.sum("n")).first()[0] or 0
    limit = max(1000, 4 * total // 65536)
    full = F.broadcast(bins.where(F.col("n") > limit).select("bin"))  # fewer than 16,384 rows
    hot = (
        lines.withColumn("bin", F.shiftrightunsigned("h1", 48))
        .join(full, "bin", "left_semi")
        .groupBy("h1", "h2", "doc_id")
        .agg(F.count("*").alias("n"))
        .groupBy("h1", "h2")
        .agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"), F.max("doc_id").alias("holder"))
        .where(F.col("n") > limit)
        .drop("n")
    )
    hot = F.broadcast(common.cut(hot, "hot"))  # at most total / limit rows, fewer than 16,384
    known = lines.join(hot, ["h1", "h2"]).where(F.col("docs") >= min_docs).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    order = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    whole = Window.partitionBy("h1", "h2")
    streamed = (
        lines.join(hot, ["h1", "h2"], "left_anti")
        .repartitionByRange("h1", "h2")
        .withColumn("first", F.when(F.lag("pos").over(order).isNull() | ~F.lag("doc_id").over(order).eqNullSafe(F.col("doc_id")), 1).otherwise(0))
        .withColumn("nth", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("docs", F.max(F.when(F.col("doc_id").isNotNull(), F.col("nth"))).over(whole))
        .where((F.col("docs") >= min_docs) & (F.col("nth") > 1))
    )
    lost = known.select("doc_id", "print", "pos").unionByName(streamed.select("doc_id", "print", "pos"))
    gone = lost.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    # the gap before each dropped line is a run of kept lines; the last run is open
    edges = "transform(gone, (p, i) -> struct(if(i = 0, 0, gone[i - 1] + 1) AS start, if(i = 0, p, p - gone[i - 1] - 1) AS length))"
    tail = "array(struct(gone[size(gone) - 1] + 1 AS start, 1000000000 AS length))"
    return gone.select("doc_id", "print", F.expr(f"concat(filter({edges}, r -> r.length > 0), {tail})").alias("keep"), F.size("gone").cast("long").alias("n_dropped"))


def kept_text(text: Column, keep: Column) -> Column:
    """The kept lines joined by newline; all lines where keep is null."""
    lines = _lines(text)
    runs = F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["length"])))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(runs, "\n"))


def with_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """df with the columns _keep and _dropped of keep_bitmaps beside its own."""
    maps = keep_bitmaps(df, id_col, text_col, **kw).select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), F.col("keep").alias("_keep"), F.col("n_dropped").alias("_dropped"))
    # the bitmaps are the hash side: texts are moved once and never sorted
    return df.join(maps.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_id")) & (_print(F.col(text_col)) == F.col("_print")), "left").drop("_id", "_print")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return with_bitmaps(docs).select(
        "doc_id",
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.encode(kept_text(F.col("text"), F.col("_keep")), "UTF-8"), 256).alias("kept_sha256"),
    )
