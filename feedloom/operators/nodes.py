"""Columns and filters of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import match
from ..functions.text import blank, date_text, strip


def xpath(path: Column) -> Column:
    """A node's position as an XPath from html, counted from 1."""
    return F.concat(F.lit("//html"), F.array_join(F.transform(path, lambda x: F.concat(F.lit("/*["), (x + 1).cast("string"), F.lit("]"))), ""))


def path_key(path: Column) -> Column:
    return F.array_join(path.cast("array<string>"), "_")


def path_hash(path: Column) -> Column:
    return F.md5(path_key(path))


def same_path(a: Column, b: Column, limit: int | None = None) -> Column:
    """Two paths are equal, of each the first `limit` steps if given."""
    return a == b if limit is None else F.slice(a, 1, limit) == F.slice(b, 1, limit)


def shared_path(a: Column, b: Column) -> Column:
    """The steps that two paths have in common, from the root."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, F.lit(False))
    return F.slice(a, 1, F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int"))


def relation(nodes: DataFrame) -> DataFrame:
    """(page_id, nid, relation): each node's place as a struct of its path, XPath, hash, level, parent and child index."""
    place = F.struct("path", xpath(F.col("path")).alias("xpath"), path_hash(F.col("path")).alias("hash"), "level", "parent_nid", "child_idx", "tag")
    return nodes.select("page_id", "nid", place.alias("relation"))


def short_text(nodes: DataFrame, limit: int = 50) -> DataFrame:
    """Elements whose first text node has fewer than limit code points; no text counts as none."""
    return nodes.where((F.col("kind") == "element") & (F.coalesce(F.char_length("xp_text"), F.lit(0)) < limit))


def date_match(text: Column, tail: Column, as_of_year: int | None = None, keys=None) -> Column:
    """The date that a node's text, or else its tail, starts with."""
    return F.coalesce(match(date_text(text), as_of_year, keys), match(date_text(tail), as_of_year, keys))


def with_dates(nodes: DataFrame, as_of_year: int | None = None, keys=None) -> DataFrame:
    """nodes with m: struct(key, text, dt) or null. Each node is matched once; the expressions work on nodes with a digit only."""
    return nodes.withColumn("m", date_match(F.col("text"), F.col("tail"), as_of_year, keys))


def feed_header(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, title, language, link, description, title_extracted) of every page."""
    heads = nodes.where("tag = 'head'").select("page_id", F.col("nid").alias("parent_nid"))
    titles = nodes.where("tag = 'title'").join(heads, ["page_id", "parent_nid"]).groupBy("page_id").agg(F.min_by("text", "nid").alias("t"))
    title = F.coalesce(strip(F.col("t")), F.concat(F.lit("News from "), F.col("url")))
    return pages.select("page_id", "url").join(titles, "page_id", "left").select(
        "page_id", title.alias("title"), F.lit("en").alias("language"), F.col("url").alias("link"), title.alias("description"), F.col("t").isNotNull().alias("title_extracted")
    )


def annotation_types(tag: Column, text: Column, tail: Column, kind: Column, children: Column, attrs: Column, dated: Column) -> Column:
    """The types of a node as an array, in their fixed order; their names are fixed values."""
    script = F.coalesce(tag == "script", F.lit(False))
    has_text, has_tail = ~blank(text) & ~script, ~blank(tail)
    empty = ~has_text & ~has_tail
    return F.array_compact(
        F.array(
            F.when(has_text, "tag:type:text"),
            F.when(has_tail, "tag:type:tail"),
            F.when(empty, "tag:type:empty"),
            F.when(children == 0, "tag:type:last"),
            F.when((children == 1) & empty, "tag:type:wrapper"),
            F.when((tag == "a") & F.map_contains_key(attrs, "href"), "tag:type:url"),
            F.when(tag.isin("h1", "h2", "h3", "h4", "b", "strong"), "tag:type:bold"),
            F.when((tag == "img") & F.map_contains_key(attrs, "src"), "tag:type:img"),
            F.when(dated, "tag:type:date"),
        )
    )


def by_page() -> Window:
    return Window.partitionBy("page_id").orderBy("nid")
