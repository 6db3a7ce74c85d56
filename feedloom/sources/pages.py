"""Pages: files, bytes and their character sets, content types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
#: MIME types of feeds, compared as they are (a charset makes them miss).
FEED_CONTENT_TYPES = ["application/rss+xml", "application/rdf+xml", "application/atom+xml", "application/xml", "text/xml"]


def _one_byte(content: Column, charset: str) -> Column:
    """Bytes of a charset with one byte a letter that Spark doesn't know: its upper half is mapped letter by letter."""
    upper = [(bytes([i]).decode("latin-1"), bytes([i]).decode(charset, "replace")) for i in range(128, 256)]
    changed = [(a, b) for a, b in upper if a != b and b != "\ufffd"]
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(a for a, _ in changed), "".join(b for _, b in changed))


def decode(content: Column) -> Column:
    """Bytes to text: by byte order mark, then the charset that the page names, then UTF-8 if valid, else windows-1252."""
    head = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    named = F.regexp_extract(head, "charset\\s*=\\s*[\"']?\\s*([a-z0-9_.:-]+)", 1)
    mark = F.hex(F.substring(content, 1, 3))
    latin = named.isin("iso-8859-1", "latin-1", "latin1", "us-ascii")
    return (
        F.when(mark == "EFBBBF", F.decode(F.substring(content, 4, 1 << 30), "UTF-8"))
        .when(mark.startswith("FFFE") | mark.startswith("FEFF"), F.decode(content, "UTF-16"))
        .when(named.isin("windows-1251", "cp1251"), _one_byte(content, "cp1251"))
        .when(latin, _one_byte(content, "cp1252"))
        .when(F.call_function("is_valid_utf8", content.cast("string")), F.decode(content, "UTF-8"))
        .otherwise(_one_byte(content, "cp1252"))
    )


def from_files(spark: SparkSession, path: str, base_url: Column | None = None) -> DataFrame:
    """Pages (page_id, url, html) from HTML files; the URL is the file's path unless given."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("page_id"), (base_url if base_url is not None else F.col("path")).alias("url"), decode(F.col("content")).alias("html"))


def is_feed(content_type: Column) -> Column:
    return F.coalesce(content_type.isin(FEED_CONTENT_TYPES), F.lit(False))


def dispatch(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feeds, pages) of responses (url, final_url, content_type, content): two filtered plans, feeds skip the HTML stage."""
    feed = is_feed(F.col("content_type"))
    decoded = decode(F.col("content"))
    feeds = responses.where(feed).select(F.col("final_url").alias("url"), decoded.alias("xml"))
    pages = responses.where(~feed).select(F.xxhash64("final_url").alias("page_id"), F.col("final_url").alias("url"), decoded.alias("html"))
    return feeds, pages


def documents(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents (url, xml), pages (page_id, url, html)) of fetched candidates: any may turn out to be a feed, whatever its type;
    those without a feed's type may be pages. They keep the URL that was asked for, by which they are looked up."""
    there = fetched.where("content IS NOT NULL")
    decoded = decode(F.col("content"))
    html = there.where(~is_feed(F.col("content_type"))).select(F.xxhash64("url").alias("page_id"), "url", decoded.alias("html"))
    return there.select("url", decoded.alias("xml")), html
