"""Extraction and discovery as whole plans over pages (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import date_text
from ..operators import blocks as B
from ..operators import clusters as C
from ..operators import discover as D
from ..operators import export as X
from ..operators import items as I
from ..operators import nodes as N
from ..sources import feeds as feed_source
from ..sources import pages as page_source
from ..sources.html import nodes as node_table


class Extractor:
    """Pages to feeds.

    text_limit: date nodes have fewer code points of text; patterns: keys of date patterns to keep to (a page may also
    bring its own in a column cached_p); as_of_year: the year of dates without one; strict_rfc: resolve links by the RFC.
    """

    def __init__(self, spark: SparkSession, text_limit: int = 50, patterns: list[str] | None = None, as_of_year: int | None = None, strict_rfc: bool = False, partitions: int | None = None):
        self.spark, self.text_limit, self.patterns, self.as_of_year, self.strict_rfc, self.partitions = spark, text_limit, patterns, as_of_year, strict_rfc, partitions

    def dated(self, pages: DataFrame, raw: bool = False) -> DataFrame:
        """The node table with the column m; persisted, as several steps read it. Call unpersist when done.

        The steps join by page and node. Nodes are partitioned by page, which serves all of these joins once Spark is told
        that a part of a join's keys will do.
        """
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        table = node_table(pages, partitions=self.partitions, raw=raw)
        keys = self.patterns
        if keys is None and "cached_p" in pages.columns:
            table = table.join(pages.select("page_id", "cached_p"), "page_id", "left")
            keys = F.col("cached_p")
        out = N.with_dates(table, self.as_of_year, keys)
        return out.drop("cached_p").persist()

    def clusters(self, dated: DataFrame) -> DataFrame:
        return C.clusters(dated, self.text_limit)

    def spans(self, dated: DataFrame) -> DataFrame:
        return B.spans(B.blocks(self.clusters(dated), dated), dated)

    def items(self, pages: DataFrame, dated: DataFrame | None = None, raw: bool = False) -> DataFrame:
        dated = self.dated(pages, raw) if dated is None else dated
        spans = self.spans(dated)
        slim = dated.select("page_id", "nid", "kind", "tag", "text", "tail", "attrs", "m")
        out = I.items(B.annotations(spans, slim), pages, self.strict_rfc)
        if raw:
            out = out.join(I.raw_html(spans, dated), ["page_id", "snode", "cord", "i"], "left")
        return out

    def extract(self, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(feeds, metrics): a row per page each."""
        dated = self.dated(pages, raw=True)
        items = self.items(pages, dated, raw=True).persist()  # the feeds and the pattern cache both read it
        feeds = X.feeds(N.feed_header(dated, pages), items, I.pattern_cache(items))
        return feeds, self.metrics(pages, dated)

    def learn(self, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """extract without any pattern cache."""
        return Extractor(self.spark, self.text_limit, None, self.as_of_year, self.strict_rfc, self.partitions).extract(pages.drop("cached_p"))

    def metrics(self, pages: DataFrame, dated: DataFrame) -> DataFrame:
        """(page_id, page_length, num_nodes, num_textcompared, num_datematched, num_clusters, title_extracted) per page.

        A node's text is compared, and its tail if the text is no date.
        """
        by_text = F.col("m").isNotNull() & (F.col("m.text") == date_text(F.col("text")))
        compared = F.when(F.col("text").isNotNull(), 1).otherwise(0) + F.when(F.col("tail").isNotNull() & ~F.coalesce(by_text, F.lit(False)), 1).otherwise(0)
        short = N.short_text(dated, self.text_limit).groupBy("page_id").agg(F.count("*").alias("num_nodes"), F.sum(compared).alias("num_textcompared"), F.count("m").alias("num_datematched"))
        groups = self.clusters(dated).groupBy("page_id").agg(F.countDistinct("snode").alias("num_clusters"))
        head = N.feed_header(dated, pages).select("page_id", "title_extracted")
        size = pages.select("page_id", F.octet_length(F.encode("html", "UTF-8")).cast("long").alias("page_length"))
        out = size.join(short, "page_id", "left").join(groups, "page_id", "left").join(head, "page_id", "left")
        return out.fillna(0, ["num_nodes", "num_textcompared", "num_datematched", "num_clusters"])


class Finder:
    """Pages to the feeds that they name."""

    def __init__(self, spark: SparkSession, partitions: int | None = None):
        self.spark, self.partitions = spark, partitions

    def candidates(self, pages: DataFrame) -> DataFrame:
        slim = node_table(pages, partitions=self.partitions, raw=False).where("tag IN ('link', 'img', 'a') OR kind = 'element'").persist()
        return D.candidates(slim, pages)

    def find(
        self, pages: DataFrame, feed_documents: DataFrame | None = None, noverify: bool = True, include_entries: bool = False, extractrss: bool = False,
        force_htmlparse: bool = False, candidate_pages: DataFrame | None = None,
    ) -> DataFrame:
        """The report: a row per feed of each page. Verifying needs feed_documents (url, xml), the fetched candidates.

        With force_htmlparse, candidates that are no feeds but pages (candidate_pages: page_id, url, html) are searched in turn;
        the verified feeds that they name are added, unless the page names them itself.
        """
        found = self.candidates(pages)
        if noverify:
            out = D.report(found)
        else:
            if feed_documents is None:
                raise ValueError("verifying needs feed_documents")
            parsed = feed_source.parse(feed_documents)
            out = D.verified(found, parsed, include_entries)
            if force_htmlparse:
                if candidate_pages is None:
                    raise ValueError("force_htmlparse needs candidate_pages")
                inner = D.verified(self.candidates(candidate_pages), parsed, include_entries).drop("page_id", "ord").withColumnRenamed("page_url", "via")
                more = found.select("page_id", "page_url", F.col("url").alias("via")).distinct().join(inner, "via").dropDuplicates(["page_id", "url"])
                out = out.unionByName(more.join(out.select("page_id", "url"), ["page_id", "url"], "left_anti").drop("via"), allowMissingColumns=True)
        if extractrss:
            extractor = Extractor(self.spark, partitions=self.partitions)
            dated = extractor.dated(pages)
            items = extractor.items(pages, dated)
            count = items.groupBy("page_id").agg(F.count("*").cast("int").alias("num_entries"), *([F.collect_list("title").alias("entries")] if include_entries else []))
            header = N.feed_header(dated, pages).select("page_id", F.col("link").alias("page_url"), "title", F.col("link").alias("url"), F.lit("html").alias("feedtype"))
            out = out.unionByName(header.join(count, "page_id"), allowMissingColumns=True)
        return out

    def scan(self, responses: DataFrame, fetched: DataFrame | None = None, noverify: bool = True, include_entries: bool = False, extractrss: bool = False, force_htmlparse: bool = False) -> DataFrame:
        """find over responses (url, final_url, content_type, content): those of a feed's type are feeds themselves.

        fetched holds the responses of the candidates, needed for verifying and force_htmlparse. A response that is null gives no row.
        """
        feeds, pages = page_source.dispatch(responses.where("content IS NOT NULL"))
        direct = direct_feed(feeds, include_entries).withColumn("page_url", F.col("url"))
        documents = inner = None
        if fetched is not None:
            documents, inner = page_source.documents(fetched)
        rest = self.find(pages, documents, noverify, include_entries, extractrss, force_htmlparse, inner)
        return rest.unionByName(direct, allowMissingColumns=True)

    def find_deep(self, pages: DataFrame, targets: DataFrame, feed_documents: DataFrame) -> DataFrame:
        """One level down: candidates that are no feeds but pages (targets: page_id, url, html) give their own verified candidates."""
        parsed = feed_source.parse(feed_documents)
        found = self.candidates(pages)
        direct = D.verified(found, parsed).select("page_id", "page_url", "url", "feedtype", F.lit(0).alias("depth"))
        open_ = found.join(parsed.select("url"), "url", "left_anti").select("page_id", "page_url", "url").distinct()
        below = targets.join(open_.select("url").distinct(), "url", "left_semi")
        second = D.verified(self.candidates(below), parsed).select(F.col("page_url").alias("via"), "url", "feedtype")
        deep = open_.select("page_id", "page_url", F.col("url").alias("via")).join(second, "via").select("page_id", "page_url", "url", "feedtype", F.lit(1).alias("depth"))
        return direct.unionByName(deep)


def direct_feed(feed_documents: DataFrame, include_entries: bool = False) -> DataFrame:
    """A URL that is itself a feed: one row with its title, the type always rss."""
    more = ["entries"] if include_entries else []
    return feed_source.parse(feed_documents).select("url", "title", F.lit("rss").alias("feedtype"), "num_entries", "language", *more)
