"""Listing pages made from the orders table, so that expected items follow from its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _day(c: str) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def rows(orders: DataFrame) -> DataFrame:
    """(page_id, k, d, key): the orders of each customer in order."""
    made = F.array_sort(F.collect_list(F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("key"))))
    return orders.groupBy(F.col("o_custkey").alias("page_id")).agg(made.alias("r"))


def _entry(x: Column, date: Column, kind: str) -> Column:
    key = x["key"].cast("string")
    link = F.concat(F.lit('<a href="/o/'), key, F.lit("?utm_source=x&amp;id="), key, F.lit('">Order number '), key, F.lit(" placed</a>"))
    if kind == "table":
        return F.concat(F.lit("<tr><td>"), date, F.lit("</td><td>"), link, F.lit("</td></tr>"))
    if kind == "pairs":
        return F.concat(F.lit("<p>"), date, F.lit("</p><p>"), link, F.lit("</p>"))
    return F.concat(F.lit("<li><span>"), date, F.lit("</span>"), link, F.lit("</li>"))


def pages(orders: DataFrame, kind: str = "list") -> DataFrame:
    """(page_id, url, html): one page per customer. kind: list, table, pairs (date and text in a paragraph each) or
    halves (odd and even orders in a list each)."""
    made = rows(orders)
    entry = lambda x: _entry(x, F.date_format(x["at"], "dd/MM/yyyy"), kind)
    every = F.transform("r", entry)
    if kind == "table":
        body = F.concat(F.lit("<table><tbody>"), F.array_join(every, ""), F.lit("</tbody></table>"))
    elif kind == "pairs":
        body = F.concat(F.lit("<div>"), F.array_join(every, ""), F.lit("</div>"))
    elif kind == "halves":
        half = lambda n: F.array_join(F.filter(every, lambda _, i: i % 2 == n), "")
        body = F.concat(F.lit("<ul>"), half(0), F.lit("</ul><ul>"), half(1), F.lit("</ul>"))
    else:
        body = F.concat(F.lit("<ul>"), F.array_join(every, ""), F.lit("</ul>"))
    url = F.concat(F.lit("http://c"), F.col("page_id").cast("string"), F.lit(".example.com/news/"))
    html = F.concat(F.lit("<html><head><title> Orders of "), F.col("page_id").cast("string"), F.lit(" </title></head><body>"), body, F.lit("</body></html>"))
    return made.select("page_id", url.alias("url"), html.alias("html"))


def link_pages(nation: DataFrame) -> DataFrame:
    """(page_id, url, html): a page per nation that names feeds in every way."""
    key = F.col("n_nationkey").cast("string")
    t = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    html = t(
        '<html><head><link rel="alternate" type="application/atom+xml" href="/atom', key, '.xml" title="', F.col("n_name"), '"><link rel="ALTERNATE" type="text/html" href="/m"><link rel="alternate" href="/x', key,
        '"></head><body><a href="/news', key, '"><img src="/i/rss_icon.png" alt="RSS"></a><a href="/feed/">x</a><a href="/feedback">f</a><a href="/rss/news', key, '.html">n</a><a href="/feed/">again</a>',
        F.when(F.col("n_nationkey") % 2 == 0, t('<a href="/all', key, '">Our RSS</a>')).otherwise(F.lit("")), '<a href="/rss2.xml">later</a></body></html>',
    )
    return nation.select(F.col("n_nationkey").cast("long").alias("page_id"), t("http://n", key, ".example/n/").alias("url"), html.alias("html"))


def feed_documents(nation: DataFrame) -> DataFrame:
    """(url, xml): an RSS document at each page's /x and, of every third, an ATOM document at /atom; each with as many entries as the
    key mod 4."""
    key = F.col("n_nationkey").cast("string")
    n = (F.col("n_nationkey") % 4).cast("int")
    host = F.concat(F.lit("http://n"), key, F.lit(".example"))
    entry = lambda tag: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < n), lambda i: F.concat(F.lit(f"<{tag}><title>e"), i.cast("string"), F.lit(f"</title></{tag}>"))), "")
    rss = nation.select(F.concat(host, F.lit("/x"), key).alias("url"), F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>News of '), F.col("n_name"), F.lit("</title><language>en</language>"), entry("item"), F.lit("</channel></rss>")).alias("xml"))
    atom = nation.where("n_nationkey % 3 = 0").select(F.concat(host, F.lit("/atom"), key, F.lit(".xml")).alias("url"), F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom of '), F.col("n_name"), F.lit("</title>"), entry("entry"), F.lit("</feed>")).alias("xml"))
    return rss.unionByName(atom)
