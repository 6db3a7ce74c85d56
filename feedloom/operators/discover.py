"""Feed discovery: the feeds that a page names, by four heuristics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import extension, joined, last_segment, path, stem

METHODS = ["link", "img", "name", "segment", "text", "extension"]


def _kind(word: Column) -> Column:
    return F.when(word == "rss", "rss").otherwise("undefined")


def _head(name: Column) -> Column:
    """rss or feed if the name starts so and isn't about feedback."""
    return F.when(~name.contains("feedback"), F.nullif(F.regexp_extract(name, "^(rss|feed)", 1), F.lit("")))


def autodiscovered(nodes: DataFrame) -> DataFrame:
    kind = F.lower(F.try_element_at("attrs", F.lit("type")))
    feedtype = F.when(kind == "application/atom+xml", "atom").when(kind == "application/rss+xml", "rss")
    found = nodes.where("tag = 'link'").where(F.lower(F.try_element_at("attrs", F.lit("rel"))) == "alternate")
    found = found.where(F.map_contains_key("attrs", "href") & (kind.isNull() | feedtype.isNotNull()))
    return found.select(
        "page_id", "nid", F.lit(0).alias("step"), F.col("attrs")["href"].alias("raw"), feedtype.alias("feedtype"), F.try_element_at("attrs", F.lit("title")).alias("title"), F.lit(1.0).alias("confidence"), F.lit("link").alias("method")
    )


def from_images(nodes: DataFrame) -> DataFrame:
    head = _head(last_segment(path(F.col("attrs")["src"])))
    images = nodes.where("tag = 'img'").where(F.map_contains_key("attrs", "src")).select("page_id", "nid", "parent_nid", F.col("attrs").alias("img"), head.alias("head")).where("head IS NOT NULL")
    links = nodes.where("tag = 'a'").where(F.map_contains_key("attrs", "href")).select("page_id", F.col("nid").alias("parent_nid"), F.col("attrs").alias("a"))
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    said = [at("a", "title"), at("a", "alt"), at("img", "title"), at("img", "alt")]
    title = F.coalesce(*[F.nullif(s, F.lit("")) for s in said], F.when(F.coalesce(*said).isNotNull(), F.lit("")))
    return images.join(links, ["page_id", "parent_nid"]).select(
        "page_id", "nid", F.lit(1).alias("step"), F.col("a")["href"].alias("raw"), _kind(F.col("head")).alias("feedtype"), title.alias("title"), F.lit(0.5).alias("confidence"), F.lit("img").alias("method")
    )


def from_anchors(nodes: DataFrame) -> DataFrame:
    """By an anchor's last path segment, any segment, its text, its extension. After the first anchor found by its text no
    further anchor of the page is looked at."""
    p = path(F.col("attrs")["href"])
    name = last_segment(p)
    segment = F.get(F.filter(F.reverse(F.split(p, "/", -1)), lambda s: s.isin("rss", "feed")), F.lit(0))
    parents = nodes.where("kind = 'element'").select("page_id", F.col("nid").alias("parent_nid"), F.col("tag").alias("parent_tag"))
    a = nodes.where("tag = 'a'").where(F.map_contains_key("attrs", "href")).select(
        "page_id", "nid", "parent_nid", F.col("attrs")["href"].alias("raw"), _head(stem(name)).alias("head"), segment.alias("segment"),
        F.coalesce(F.lower("text").contains("rss"), F.lit(False)).alias("says"), F.nullif(F.regexp_extract(extension(name), "^(rss|xml)", 1), F.lit("")).alias("ext"),
    )
    a = a.join(parents, ["page_id", "parent_nid"], "left")
    method = (
        F.when(F.col("head").isNotNull(), "name").when(F.col("segment").isNotNull(), "segment").when(F.col("says"), "text")
        .when(F.col("ext").isNotNull() & (F.col("parent_tag") == "a"), "extension")
    )
    kind = F.when(F.col("method") == "text", F.lit("rss")).otherwise(_kind(F.coalesce("head", "segment", "ext")))
    stop = F.min(F.when(F.col("method") == "text", F.col("nid"))).over(Window.partitionBy("page_id"))
    found = a.withColumn("method", method).where("method IS NOT NULL").withColumn("stop", stop).where("stop IS NULL OR nid <= stop")
    return found.select("page_id", "nid", F.lit(2).alias("step"), "raw", kind.alias("feedtype"), F.lit(None).cast("string").alias("title"), F.lit(0.5).alias("confidence"), "method")


def candidates(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, ord, url, raw, feedtype, title, confidence, method) in order.

    Links that announce feeds all stay; an image's or an anchor's goes if its URL, as written, came before. Then URLs are
    resolved, so two may become one.
    """
    every = autodiscovered(nodes).unionByName(from_images(nodes)).unionByName(from_anchors(nodes))
    first = F.row_number().over(Window.partitionBy("page_id", "raw").orderBy("step", "nid"))
    kept = every.withColumn("nth", first).where("step = 0 OR nth = 1")
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("step", "nid"))
    return kept.withColumn("ord", order).join(pages.select("page_id", F.col("url").alias("page_url")), "page_id").select(
        "page_id", "page_url", "ord", joined(F.col("page_url"), F.col("raw")).alias("url"), "raw", "feedtype", "title", "confidence", "method"
    )


def report(found: DataFrame) -> DataFrame:
    """Unverified candidates: the title is the URL, the type always rss."""
    return found.select("page_id", "page_url", "ord", F.col("url").alias("title"), "url", F.lit("rss").alias("feedtype"))


def verified(found: DataFrame, parsed: DataFrame, include_entries: bool = False) -> DataFrame:
    """Candidates whose feed document (parsed: url, title, language, num_entries, entries) has a title."""
    feeds = parsed.select("url", "title", "language", "num_entries", *(["entries"] if include_entries else []))
    return found.drop("title").join(feeds, "url").select(
        "page_id", "page_url", "ord", "title", "url", F.coalesce("feedtype", F.lit("undefined")).alias("feedtype"), "num_entries", "language", *(["entries"] if include_entries else [])
    )
