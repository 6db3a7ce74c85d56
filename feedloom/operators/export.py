"""Feeds as JSON and ATOM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feeds(header: DataFrame, items: DataFrame, cache: DataFrame) -> DataFrame:
    """One row per page: the header, its items in order, and the pattern cache."""
    raw = F.col("raw_html") if "raw_html" in items.columns else F.lit(None).cast("string")
    item = F.struct("cord", "i", F.struct("title", "description", "pubdate", "unique_id", raw.alias("raw_html"), F.struct("links", "images").alias("extra"), "link").alias("item"))
    grouped = items.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cord", "i", item["item"]["unique_id"].alias("k"), item["item"].alias("item"))), _by_place), lambda x: x["item"]).alias("items"))
    pats = cache.select("page_id", F.struct(F.col("pats").alias("pats")).alias("cache"))
    return header.join(grouped, "page_id", "left").join(pats, "page_id", "left")


def _by_place(a: Column, b: Column) -> Column:
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(a["cord"] != b["cord"], order(a["cord"], b["cord"])).otherwise(order(a["i"], b["i"]))


def to_json(feeds: DataFrame) -> DataFrame:
    """(page_id, json): dates in ISO form, raw HTML null as bytes have no JSON."""
    plain = F.transform("items", lambda x: x.withField("raw_html", F.lit(None).cast("string")))
    return feeds.select("page_id", F.to_json(F.struct("title", "language", "link", "description", plain.alias("items"), "cache"), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("json"))


def _xml(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def to_atom(feeds: DataFrame, public_url: Column | None = None, logo: Column | None = None) -> DataFrame:
    """(page_id, atom): one ATOM document per feed: id, title, language, updated (the latest item's date), links, logo, entries.

    public_url is where the document itself will stand.
    """
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = lambda x: F.concat(
        F.lit("<entry><id>"), _xml(x["unique_id"]), F.lit("</id><title>"), _xml(x["title"]), F.lit("</title><updated>"), stamp(x["pubdate"]), F.lit("</updated><published>"), stamp(x["pubdate"]),
        F.lit('</published><link href="'), _xml(x["link"]), F.lit('"/><summary>'), _xml(x["description"]), F.lit("</summary></entry>"),
    )
    items = F.coalesce("items", F.array().cast(feeds.schema["items"].dataType))
    own = F.concat(F.lit('<link rel="self" href="'), _xml(public_url), F.lit('"/>')) if public_url is not None else F.lit("")
    picture = F.when(logo.isNotNull(), F.concat(F.lit("<logo>"), _xml(logo), F.lit("</logo>"))).otherwise("") if logo is not None else F.lit("")
    latest = F.array_max(F.transform(items, lambda x: x["pubdate"]))
    updated = F.when(latest.isNotNull(), F.concat(F.lit("<updated>"), stamp(latest), F.lit("</updated>"))).otherwise("")
    return feeds.select(
        "page_id",
        F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom" xml:lang="'), _xml(F.col("language")), F.lit('"><id>'), _xml(F.col("link")), F.lit("</id><title>"), _xml(F.col("title")), F.lit("</title>"),
            updated, own, F.lit('<link rel="alternate" href="'), _xml(F.col("link")), F.lit('"/>'), picture, F.array_join(F.transform(items, entry), ""), F.lit("</feed>"),
        ).alias("atom"),
    )
