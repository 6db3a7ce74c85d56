"""The registered queries of the feed engine, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.dates import MONTHS, match
from ..functions.text import date_text
from ..operators import blocks as B
from ..operators import discover as D
from ..operators import items as I
from ..operators import nodes as N
from ..sources import feeds as feed_source
from ..sources import pages as P
from ..sources.html import nodes as node_table
from . import synth
from .pipeline import Extractor, Finder, direct_feed


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def _partitions(spark: SparkSession) -> int | None:
    """Four times the cluster's cores where shuffles make fewer partitions than that; else none, as pages need not be dealt out."""
    few = 4 * spark.sparkContext.defaultParallelism
    return few if int(spark.conf.get("spark.sql.shuffle.partitions")) < few else None


def _nodes(spark, d):
    return node_table(_read(spark, d, "pages"), partitions=_partitions(spark), raw=False)


def _listing(spark, d, kind="list"):
    pages = synth.pages(_read(spark, d, "orders"), kind)
    return pages, Extractor(spark, partitions=_partitions(spark))


def _items(spark, d, kind="list"):
    pages, ex = _listing(spark, d, kind)
    dated = ex.dated(pages)
    return ex.items(pages, dated), dated, pages, ex


def page_title(spark, d):
    pages = _read(spark, d, "pages")
    return N.feed_header(_nodes(spark, d), pages).select("page_id", "title")


def feed_header(spark, d):
    return N.feed_header(_nodes(spark, d), _read(spark, d, "pages"))


def url_clean(spark, d):
    return _read(spark, d, "pages").select("page_id", U.clean(F.col("url")).alias("url"))


def url_query_kept(spark, d):
    pairs = F.filter(U.query_pairs(U.query_of(F.col("url"))), lambda p: ~U.is_junk(p["k"]))
    return _read(spark, d, "pages").select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.k", "p.v")


def url_query_dropped(spark, d):
    pairs = F.filter(U.query_pairs(U.query_of(F.col("url"))), lambda p: U.is_junk(p["k"]))
    return _read(spark, d, "pages").select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.k", "p.v")


def _hrefs(spark, d):
    a = _nodes(spark, d).where("tag = 'a'").where(F.map_contains_key("attrs", "href")).select("page_id", "nid", F.col("attrs")["href"].alias("href"))
    return a.join(_read(spark, d, "pages").select("page_id", "url"), "page_id").select("page_id", "nid", U.clean(U.absolute(F.col("url"), F.col("href"))).alias("link"))


def links_absolute(spark, d):
    return _hrefs(spark, d).groupBy("page_id", "link").agg(F.count("*").alias("n"))


def links_distinct(spark, d):
    first = _hrefs(spark, d).groupBy("page_id", "link").agg(F.min("nid").alias("nid"))
    links = first.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nid", "link"))), lambda x: x["link"]).alias("links"))
    return links.select("page_id", F.posexplode("links").alias("pos", "link")).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


def tag_counts(spark, d):
    return _nodes(spark, d).where("kind = 'element' AND tag NOT IN ('html', 'head', 'body')").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def page_script_excluded(spark, d):
    nodes = _nodes(spark, d)
    types = N.annotation_types(F.col("tag"), F.col("text"), F.col("tail"), F.col("kind"), F.col("children"), F.col("attrs"), F.lit(False))
    return nodes.where("tag IN ('script', 'style')").select("page_id", "tag", F.array_contains(types, "tag:type:text").alias("is_text"))


def node_paths(spark, d):
    """Every item of a listing page by its place: child indexes, level, XPath and hash."""
    pages, _ = _listing(spark, d)
    nodes = node_table(pages, partitions=_partitions(spark), raw=False).where("tag = 'li'")
    return nodes.select("page_id", F.col("child_idx").cast("long").alias("pos"), F.col("level").cast("long").alias("level"), N.path_key(F.col("path")).alias("path"), N.xpath(F.col("path")).alias("xpath"), N.path_hash(F.col("path")).alias("hash"))


def tag_paths(spark, d):
    pages, _ = _listing(spark, d)
    nodes = node_table(pages, partitions=_partitions(spark), raw=False, tag_path=True)
    return nodes.groupBy(F.array_join("tag_path", "/").alias("tags")).agg(F.count("*").alias("n"))


def _dates(spark, d, shape):
    at = F.col("o_orderdate")
    texts = {
        "iso": F.date_format(at, "yyyy-MM-dd"), "dmy": F.date_format(at, "dd/MM/yyyy"), "named": F.date_format(at, "d MMMM yyyy"),
        "reject": F.concat(F.lit("Published - "), F.date_format(at, "dd-MM-yyyy")), "bracket": F.date_format(at, "'['dd/MM/yyyy']'"), "time": F.date_format(at, "dd.MM.yyyy '10:30'"),
        "noyear": F.date_format(at, "d MMMM"),
    }
    m = match(date_text(texts[shape]), as_of_year=2020)
    return _read(spark, d, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", F.col("m.key").alias("key"), F.date_format("m.dt", "yyyy-MM-dd HH:mm:ss").alias("dt"))


def _date_query(shape):
    return lambda spark, d: _dates(spark, d, shape)


def date_languages(spark, d):
    """Order dates written with month names of three other languages."""
    german = F.element_at(F.array(*[F.lit(x) for x in "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()]), F.month("o_orderdate"))
    french = F.element_at(F.array(*[F.lit(x) for x in "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()]), F.month("o_orderdate"))
    spanish = F.element_at(F.array(*[F.lit(x) for x in "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()]), F.month("o_orderdate"))
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    texts = F.array(F.concat(day, F.lit(". "), german, F.lit(" "), year), F.concat(day, F.lit(" "), french, F.lit(" "), year), F.concat(day, F.lit(" de "), spanish, F.lit(" de "), year))
    each = _read(spark, d, "orders").select("o_orderkey", F.posexplode(texts).alias("lang", "t"))
    return each.select("o_orderkey", F.col("lang").cast("long").alias("lang"), F.date_format(match(date_text(F.col("t")))["dt"], "yyyy-MM-dd").alias("dt"))


def date_pattern_subset(spark, d):
    """Two shapes of date, of which the second alone is allowed."""
    at = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(at, "dd/MM/yyyy")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    m = match(text, keys=["dt:date:date_4"])
    return _read(spark, d, "orders").select("o_orderkey", F.date_format(m["dt"], "yyyy-MM-dd").alias("dt"))


def date_cached_time(spark, d):
    """A date and time under the key of the date alone, and under that of both."""
    text = F.date_format("o_orderdate", "dd/MM/yyyy '10:30'")
    say = lambda key: F.date_format(match(text, keys=[key])["dt"], "yyyy-MM-dd HH:mm")
    return _read(spark, d, "orders").select("o_orderkey", say("dt:date:date_1").alias("day"), say("dt:date:date_1:time").alias("moment"), say("dt:date:date_2").alias("none"))


def date_cached_month(spark, d):
    """Every language's month names under that language's own key, and under another's."""
    langs = list(MONTHS)
    months = F.array(*[F.array(*[F.lit(m.split("|")[0]) for m in MONTHS[x].split(" ")]) for x in langs])
    each = _read(spark, d, "orders").select("o_orderkey", "o_orderdate", F.explode(F.sequence(F.lit(0), F.lit(len(langs) - 1))).alias("l"))
    name = F.get(F.get(months, F.col("l")), F.month("o_orderdate") - 1)
    text = F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), name, F.year("o_orderdate").cast("string"))
    lang = F.get(F.array(*[F.lit(x) for x in langs]), F.col("l"))
    m = match(date_text(text), keys=F.array(F.lit("dt:date:date_1"), F.concat(F.lit("dt:date:"), lang, F.lit("_dmy_full"))))
    return each.select("o_orderkey", lang.alias("lang"), m["key"].alias("key"), F.date_format(m["dt"], "yyyy-MM-dd").alias("dt"))


def _short(limit):
    def query(spark, d):
        made = _read(spark, d, "events").select(F.col("event_id").alias("page_id"), F.concat(F.lit("<p>"), F.repeat(F.lit("x"), (F.col("event_id") % 200).cast("int")), F.lit("</p>")).alias("html"))
        nodes = node_table(made, partitions=_partitions(spark), raw=False)
        return N.short_text(nodes, limit).where("tag = 'p'").select("page_id", F.coalesce(F.char_length("xp_text"), F.lit(0)).cast("long").alias("n"))

    return query


def cluster_sizes(spark, d):
    pages, ex = _listing(spark, d)
    return ex.clusters(ex.dated(pages)).groupBy("page_id", "cord").agg(F.count("*").alias("n")).select("page_id", "n")


def cluster_first_loss(spark, d):
    pages, ex = _listing(spark, d, "halves")
    return ex.clusters(ex.dated(pages)).groupBy("page_id", "snode").agg(F.count("*").alias("n")).groupBy("page_id").agg(F.sum("n").alias("n"), F.count("*").alias("clusters"))


def cluster_tbody(spark, d):
    pages, ex = _listing(spark, d, "table")
    dated = ex.dated(pages)
    tags = dated.select("page_id", F.col("nid").alias("snode"), "tag")
    return ex.clusters(dated).groupBy("page_id", "snode").agg(F.count("*").alias("n")).join(tags, ["page_id", "snode"]).select("page_id", "tag", "n")


def _blocks(spark, d, kind):
    pages, ex = _listing(spark, d, kind)
    dated = ex.dated(pages)
    return B.blocks(ex.clusters(dated), dated)


def block_widths(spark, d):
    return _blocks(spark, d, "pairs").select("page_id", F.col("i").cast("long").alias("i"), F.col("position").cast("long").alias("position"), F.col("shift").cast("long").alias("shift"), "entity")


def block_last_width(spark, d):
    return _blocks(spark, d, "list").where("is_last").select("page_id", F.col("shift").cast("long").alias("shift"))


def annotation_types(spark, d):
    pages, ex = _listing(spark, d)
    dated = ex.dated(pages)
    anns = B.annotations(ex.spans(dated), dated)
    types = N.annotation_types(F.col("tag"), F.col("text"), F.col("tail"), F.col("kind"), F.col("children"), F.col("attrs"), F.col("m").isNotNull())
    return anns.groupBy("aid", "tag", F.array_join(types, ",").alias("types")).agg(F.count("*").alias("n")).select(F.col("aid").cast("long").alias("aid"), "tag", "types", "n")


def items_basic(spark, d):
    it = _items(spark, d)[0]
    return it.select("page_id", F.col("i").cast("long").alias("i"), "title", F.date_format("pubdate", "yyyy-MM-dd").alias("pubdate"), "link")


def items_title_desc(spark, d):
    return _items(spark, d, "pairs")[0].select("page_id", F.col("i").cast("long").alias("i"), "title", "description")


def items_links(spark, d):
    return _items(spark, d)[0].select("page_id", F.explode("links").alias("link"))


def items_unique_id(spark, d):
    return _items(spark, d, "table")[0].select("page_id", "unique_id", "t_key")


def items_last_date_wins(spark, d):
    """A second date in each entry, in a text too long for a date node of its own: the last one is the item's."""
    made = synth.rows(_read(spark, d, "orders"))
    entry = lambda x: F.concat(F.lit("<li><p>"), F.date_format(x["at"], "dd/MM/yyyy"), F.lit("</p><b>Order number "), x["key"].cast("string"), F.lit(" placed</b><i>"), F.date_format(F.date_add(x["at"], 3), "dd/MM/yyyy"), F.lit(" is the day on which this very order left the warehouse</i></li>"))
    pages = made.select("page_id", F.concat(F.lit("http://c"), F.col("page_id"), F.lit(".example.com/")).alias("url"), F.concat(F.lit("<ul>"), F.array_join(F.transform("r", entry), ""), F.lit("</ul>")).alias("html"))
    return Extractor(spark, partitions=_partitions(spark)).items(pages).select("page_id", F.date_format("pubdate", "yyyy-MM-dd").alias("pubdate"), "title")


def items_raw_html(spark, d):
    pages, ex = _listing(spark, d)
    return ex.items(pages, ex.dated(pages, raw=True), raw=True).select("page_id", F.col("i").cast("long").alias("i"), "raw_html")


def feed_pattern_cache(spark, d):
    return I.pattern_cache(_items(spark, d)[0]).select("page_id", F.array_join("pats", ",").alias("pats"))


def feed_counts(spark, d):
    return _items(spark, d, "pairs")[0].groupBy("page_id").agg(F.count("*").alias("num_entries"))


def session_metrics(spark, d):
    pages, ex = _listing(spark, d)
    return ex.metrics(pages, ex.dated(pages)).select("page_id", "page_length", "num_nodes", "num_textcompared", "num_datematched", "num_clusters", "title_extracted")


def feed_json(spark, d):
    """The exported JSON, read back: title and the number of items."""
    pages, ex = _listing(spark, d)
    from ..operators.export import to_json

    js = to_json(ex.extract(pages)[0])
    return js.select("page_id", F.get_json_object("json", "$.title").alias("title"), F.coalesce(F.json_array_length(F.get_json_object("json", "$.items")), F.lit(0)).cast("long").alias("n"))


def feed_atom(spark, d):
    """The exported ATOM documents, parsed again by the feed reader."""
    pages, ex = _listing(spark, d)
    from ..operators.export import to_atom

    docs = to_atom(ex.extract(pages)[0]).select(F.col("page_id").cast("string").alias("url"), F.col("atom").alias("xml"))
    return feed_source.parse(docs).select(F.col("url").cast("long").alias("page_id"), "title", F.col("num_entries").cast("long").alias("n"))


def _candidates(spark, d, method):
    found = Finder(spark).candidates(synth.link_pages(_read(spark, d, "nation"))).where(F.col("method") == method)
    return found.select("page_id", "url", "feedtype", "title", "confidence")


def _candidate_query(method):
    return lambda spark, d: _candidates(spark, d, method)


def discover_dedupe(spark, d):
    found = Finder(spark).candidates(synth.link_pages(_read(spark, d, "nation")))
    return found.select("page_id", F.col("ord").cast("long").alias("ord"), "method", "url")


def discover_report(spark, d):
    return Finder(spark).find(synth.link_pages(_read(spark, d, "nation"))).select("page_id", "title", "url", "feedtype")


def discover_extractrss(spark, d):
    """Pages without any feed of their own: the extractor's items stand for one."""
    pages, _ = _listing(spark, d)
    return Finder(spark, _partitions(spark)).find(pages, extractrss=True).select("page_id", "title", "url", "feedtype", F.col("num_entries").cast("long").alias("num_entries"))


def feed_parse(spark, d):
    return direct_feed(synth.feed_documents(_read(spark, d, "nation"))).select("url", "title", "feedtype", F.col("num_entries").cast("long").alias("num_entries"), "language")


def feed_verify(spark, d):
    nation = _read(spark, d, "nation")
    out = Finder(spark).find(synth.link_pages(nation), synth.feed_documents(nation), noverify=False)
    return out.select("page_id", "url", "title", "feedtype", F.col("num_entries").cast("long").alias("num_entries"))


def feed_malformed(spark, d):
    """Feeds with bare ampersands, entities of HTML, remarks after the end, open tags and unknown prefixes; and no feeds at all."""
    t = lambda title, more="": F.concat(F.lit("<rss><channel><title>"), F.lit(title), F.col("n_name"), F.lit(f"</title><item><title>one</title></item>{more}</channel></rss>"))
    rows = F.array(
        t("A & B "), t("A&nbsp;B&eacute; "), F.concat(t("C "), F.lit("<!-- made today --> ")), t("D ", "<item><title>two"), t("E ", "<item><media:x y=1></item>"), t("F ", "<item><title><![CDATA[a & <b>]]></title></item>"),
        F.lit("<rss><channel><item></rss>"), F.lit("<html><rss>"), F.lit(""), F.lit(None).cast("string"), F.lit("<rss"),
    )
    docs = _read(spark, d, "nation").select("n_nationkey", F.posexplode(rows).alias("k", "xml")).select(F.concat_ws("/", "n_nationkey", "k").alias("url"), "xml")
    return feed_source.parse(docs).select("url", "title", F.col("num_entries").cast("long").alias("n"), F.array_join("entries", "|").alias("entries"))


def _responses(spark, d):
    """Responses of each nation's page and, as type text/xml, of its feed; and of the candidates that the pages name."""
    nation = _read(spark, d, "nation")
    kind = lambda df, c, t: df.select("url", F.col("url").alias("final_url"), F.lit(t).alias("content_type"), F.encode(c, "UTF-8").alias("content"))
    pages, feeds = kind(synth.link_pages(nation), "html", "text/html"), kind(synth.feed_documents(nation), "xml", "text/xml")
    gone = nation.select(F.lit("http://gone/").alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("binary").alias("content")).limit(1)
    return pages, feeds, gone


def find_direct(spark, d):
    """Start URLs that are pages and start URLs that are feeds, in one call."""
    pages, feeds, gone = _responses(spark, d)
    out = Finder(spark).scan(pages.unionByName(feeds).unionByName(gone), feeds, noverify=False)
    return out.select("page_url", "url", "title", "feedtype", F.col("num_entries").cast("long").alias("num_entries"))


def find_html_parse(spark, d):
    """Pages that name a page that names the feeds: found with force_htmlparse only."""
    pages, feeds, _ = _responses(spark, d)
    link = F.concat(F.lit('<a href="'), F.col("url"), F.lit('">our rss</a>'))
    top = pages.select(F.concat(F.lit("http://top/"), F.xxhash64("url")).alias("url"), F.col("url").alias("below"), F.encode(link, "UTF-8").alias("content"))
    top = top.select("url", F.col("url").alias("final_url"), F.lit("text/html").alias("content_type"), "content")
    out = Finder(spark).scan(top, pages.unionByName(feeds), noverify=False, force_htmlparse=True)
    return out.groupBy("url", "title", "feedtype").agg(F.count("*").alias("n"))


def find_entries(spark, d):
    nation = _read(spark, d, "nation")
    out = Finder(spark).find(synth.link_pages(nation), synth.feed_documents(nation), noverify=False, include_entries=True)
    return out.select("page_id", "url", F.posexplode("entries").alias("pos", "entry")).select("page_id", "url", F.col("pos").cast("long").alias("pos"), "entry")


def discover_extension(spark, d):
    """An anchor inside another, named by its extension alone."""
    key = F.col("n_nationkey").cast("string")
    html = F.concat(F.lit('<a href="/in/'), key, F.lit('"><a href="/data/news'), key, F.lit('.xml">n</a></a><a href="/data/other.xml">o</a>'))
    pages = _read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.concat(F.lit("http://n"), key, F.lit(".example/")).alias("url"), html.alias("html"))
    return Finder(spark).candidates(pages).select("page_id", "url", "feedtype", "method")


def url_absolute(spark, d):
    """References of all six kinds against three pages of each nation."""
    bases = F.array(*[F.lit(x) for x in ("/a/b.html", "/a/", "")])
    refs = F.array(*[F.lit(x) for x in ("/x", "x.html", "./x", "https://z/q", "", "//cdn/x")])
    host = F.concat(F.lit("http://h"), F.col("n_nationkey"))
    each = _read(spark, d, "nation").select("n_nationkey", host.alias("host"), F.posexplode(bases).alias("b", "base")).select("n_nationkey", "host", "b", "base", F.posexplode(refs).alias("r", "ref"))
    return each.select("n_nationkey", F.col("b").cast("long").alias("b"), F.col("r").cast("long").alias("r"), U.absolute(F.concat("host", "base"), F.col("ref")).alias("link"))


def feed_json_items(spark, d):
    """The items of the exported JSON, read back whole."""
    pages, ex = _listing(spark, d)
    from ..operators.export import to_json

    item = "array<struct<title:string,description:string,pubdate:string,unique_id:string,link:string,extra:struct<links:array<string>>>>"
    got = to_json(ex.extract(pages)[0]).select("page_id", F.posexplode(F.from_json(F.get_json_object("json", "$.items"), item)).alias("i", "x"))
    return got.select("page_id", F.col("i").cast("long").alias("i"), "x.title", "x.description", "x.pubdate", "x.link", F.array_join("x.extra.links", ",").alias("links"))


def feed_atom_items(spark, d):
    """The entries of the exported ATOM documents, and their links to themselves."""
    pages, ex = _listing(spark, d)
    from ..operators.export import to_atom

    docs = to_atom(ex.extract(pages)[0], F.concat(F.lit("http://atom/"), F.col("page_id")), F.lit("http://logo/"))
    own = F.regexp_extract("atom", 'rel="self" href="([^"]*)"', 1).alias("self")
    parsed = feed_source.parse(docs.select(F.col("page_id").cast("string").alias("url"), F.col("atom").alias("xml")))
    each = parsed.select(F.col("url").cast("long").alias("page_id"), "language", F.posexplode("entries").alias("i", "title"))
    return each.join(docs.select("page_id", own), "page_id").select("page_id", F.col("i").cast("long").alias("i"), "title", "language", "self")


def block_histogram(spark, d):
    """How often each distance of neighbouring blocks occurs."""
    from pyspark.sql import Window

    blocks = _blocks(spark, d, "pairs")
    w = Window.partitionBy("page_id", "snode").orderBy("i")
    return B.histogram(blocks.withColumn("diff", F.lead("position").over(w) - F.col("position"))).groupBy("page_id", F.col("diff").cast("long").alias("diff")).agg(F.sum("n").alias("n"))


def node_relations(spark, d):
    """The place of each link of a listing, and the steps that it shares with the page's first."""
    pages, _ = _listing(spark, d)
    nodes = node_table(pages, partitions=_partitions(spark), raw=False).where("tag = 'a'")
    first = nodes.groupBy("page_id").agg(F.min_by("path", "nid").alias("one"))
    told = N.relation(nodes).join(first, "page_id")
    path = F.col("relation.path")
    return told.select("page_id", "relation.xpath", N.same_path(path, F.col("one")).alias("same"), N.same_path(path, F.col("one"), 3).alias("beside"), F.size(N.shared_path(path, F.col("one"))).cast("long").alias("shared"))


def discover_deep(spark, d):
    """A page of each region links to the pages of its nations, which name the feeds."""
    nation = _read(spark, d, "nation")
    below = synth.link_pages(nation)
    links = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<a href="http://n'), F.col("n_nationkey"), F.lit('.example/n/">rss')))), "")
    top = nation.groupBy(F.col("n_regionkey").cast("long").alias("page_id")).agg(links.alias("html"))
    top = top.select("page_id", F.concat(F.lit("http://r"), F.col("page_id"), F.lit(".example/")).alias("url"), "html")
    out = Finder(spark).find_deep(top, below, synth.feed_documents(nation))
    return out.select("page_url", "url", "feedtype", F.col("depth").cast("long").alias("depth"))


def content_type_dispatch(spark, d):
    kinds = F.array(*[F.lit(x) for x in [*P.FEED_CONTENT_TYPES, "text/html", "text/xml; charset=utf-8", "application/json"]])
    rows = _read(spark, d, "nation").select("n_nationkey", F.explode(F.concat(kinds, F.array(F.lit(None).cast("string")))).alias("content_type"))
    return rows.groupBy("content_type", P.is_feed(F.col("content_type")).alias("is_feed")).agg(F.count("*").alias("n"))


def charset_decode(spark, d):
    """Names in three encodings come back as they were."""
    name = F.concat(F.col("n_name"), F.lit(" Čé"), F.lit("ü"))
    latin = F.concat(F.col("n_name"), F.lit(" éü"))
    rows = _read(spark, d, "nation").select(
        "n_nationkey",
        P.decode(F.encode(name, "UTF-8")).alias("utf8"),
        P.decode(F.encode(latin, "ISO-8859-1")).alias("latin"),
        P.decode(F.encode(name, "UTF-16")).alias("utf16"),
    )
    return rows


def url_join(spark, d):
    """References of every kind against a page, by the RFC."""
    refs = F.array(*[F.lit(x) for x in ["/x", "x", "../x", "./x?a=1#f", "//cdn/x", "http://z/y", "?q", "#f", ""]])
    pages = _read(spark, d, "pages").select("page_id", F.concat(F.lit("http://h"), F.col("page_id"), F.lit(".example/a/b/c.html")).alias("url"))
    return pages.select("page_id", F.posexplode(refs).alias("k", "ref"), "url").select("page_id", F.col("k").cast("long").alias("k"), U.joined(F.col("url"), F.col("ref")).alias("link"))


_QUERIES = [
    page_title, feed_header, url_clean, url_query_kept, url_query_dropped, links_absolute, links_distinct, tag_counts, page_script_excluded, node_paths, tag_paths, date_languages, date_pattern_subset,
    cluster_sizes, cluster_first_loss, cluster_tbody, block_widths, block_last_width, annotation_types, items_basic, items_title_desc, items_links, items_unique_id, items_last_date_wins, items_raw_html,
    feed_pattern_cache, feed_counts, session_metrics, feed_json, feed_atom, discover_dedupe, discover_report, discover_extractrss, feed_parse, feed_verify, discover_deep, content_type_dispatch, charset_decode, url_join,
    date_cached_time, date_cached_month, feed_malformed, find_direct, find_html_parse, find_entries, discover_extension, url_absolute, feed_json_items, feed_atom_items, block_histogram, node_relations,
]
QUERIES = {f.__name__: f for f in _QUERIES}
QUERIES |= {f"date_parse_{s}": _date_query(s) for s in ("iso", "dmy", "named", "bracket", "time", "noyear")} | {"date_reject_prefix": _date_query("reject")}
QUERIES |= {"short_text_50": _short(50), "short_text_150": _short(150)}
QUERIES |= {f"discover_{m}": _candidate_query(m) for m in ("link", "img", "name", "segment", "text")}

_TITLE = "replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '\"'), '&amp;', '&')"
_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
_ORDERS = """o AS (SELECT o_custkey AS page_id, o_orderkey AS key, o_orderdate AS od,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
e AS (SELECT *, 'Order number ' || key || ' placed' AS title, strftime(od, '%d/%m/%Y') AS d, 'http://c' || page_id || '.example.com/o/' || key || '?id=' || key AS link FROM o)"""
_ITEMS = f"WITH {_ORDERS} SELECT {{}} FROM e WHERE n > 1"
_DATE = "SELECT o_orderkey, {} AS key, {} AS dt FROM orders"
_AT = "strftime(o_orderdate, '%Y-%m-%d')"
_HREF = f"""h AS (SELECT page_id, {_HOST} AS host, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS k FROM pages),
l AS (SELECT page_id, k, 'http://' || host || replace(replace(href, '&quot;', '"'), '&amp;', '&') AS link FROM h)"""
_PAIRS = r"""p AS (SELECT page_id, unnest(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&')) AS kv FROM pages),
q AS (SELECT page_id, split_part(kv, '=', 1) AS k, split_part(kv, '=', 2) AS v FROM p WHERE kv <> '')"""
_N = "n AS (SELECT n_nationkey AS k, n_name AS name FROM nation)"
_FOUND = f"""{_N}, f AS (
  SELECT k, 1 AS s, 'link' AS method, 'http://n' || k || '.example/atom' || k || '.xml' AS url, 'atom' AS feedtype, name AS title, 1.0::DOUBLE AS confidence FROM n
  UNION ALL SELECT k, 2, 'link', 'http://n' || k || '.example/x' || k, NULL, NULL, 1.0 FROM n
  UNION ALL SELECT k, 3, 'img', 'http://n' || k || '.example/news' || k, 'rss', 'RSS', 0.5 FROM n
  UNION ALL SELECT k, 4, 'name', 'http://n' || k || '.example/feed/', 'undefined', NULL, 0.5 FROM n
  UNION ALL SELECT k, 5, 'segment', 'http://n' || k || '.example/rss/news' || k || '.html', 'rss', NULL, 0.5 FROM n
  UNION ALL SELECT k, 6, 'text', 'http://n' || k || '.example/all' || k, 'rss', NULL, 0.5 FROM n WHERE k % 2 = 0
  UNION ALL SELECT k, 6, 'name', 'http://n' || k || '.example/rss2.xml', 'rss', NULL, 0.5 FROM n WHERE k % 2 = 1)"""
_DOCS = f"""{_N}, docs AS (
  SELECT k, 'http://n' || k || '.example/x' || k AS url, 'News of ' || name AS title, k % 4 AS num_entries, 'en' AS language FROM n
  UNION ALL SELECT k, 'http://n' || k || '.example/atom' || k || '.xml', 'Atom of ' || name, k % 4, NULL FROM n WHERE k % 3 = 0)"""

ORACLE = {
    "page_title": f"SELECT page_id, trim({_TITLE}) AS title FROM pages",
    "feed_header": f"SELECT page_id, trim({_TITLE}) AS title, 'en' AS language, url AS link, trim({_TITLE}) AS description, true AS title_extracted FROM pages",
    "url_clean": r"""SELECT page_id, CASE WHEN url LIKE '%?%' THEN split_part(url, '?', 1) || CASE WHEN url LIKE '%utm\_source=feed' ESCAPE '\' THEN '' ELSE '?' || split_part(url, '?', 2) END ELSE url END AS url FROM pages""",
    "url_query_kept": f"WITH {_PAIRS} SELECT page_id, k, v FROM q WHERE k <> 'utm_source'",
    "url_query_dropped": f"WITH {_PAIRS} SELECT page_id, k, v FROM q WHERE k = 'utm_source'",
    "links_absolute": f"WITH {_HREF} SELECT page_id, link, count(*) AS n FROM l GROUP BY ALL",
    "links_distinct": f"WITH {_HREF}, m AS (SELECT page_id, link, min(k) AS k FROM l GROUP BY ALL) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, link FROM m",
    "tag_counts": r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<(script|style)>.*?</', '<\1>', 'gs'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
      SELECT page_id, tag, count(*) AS n FROM t WHERE tag NOT IN ('html', 'head', 'body') GROUP BY ALL""",
    "page_script_excluded": "SELECT page_id, tag, tag = 'style' AS is_text FROM pages, (VALUES ('script'), ('style')) v(tag)",
    "node_paths": f"""WITH {_ORDERS} SELECT page_id, i AS pos, 4::BIGINT AS level, '0_1_0_' || i AS path, '//html/*[1]/*[2]/*[1]/*[' || (i + 1) || ']' AS xpath, md5('0_1_0_' || i) AS hash FROM e""",
    "tag_paths": """WITH c AS (SELECT count(DISTINCT o_custkey) AS p, count(*) AS o FROM orders) SELECT v.tags, CASE WHEN v.per = 1 THEN p ELSE o END AS n FROM c,
      (VALUES ('html', 1), ('html/head', 1), ('html/head/title', 1), ('html/body', 1), ('html/body/ul', 1), ('html/body/ul/li', 2), ('html/body/ul/li/span', 2), ('html/body/ul/li/a', 2)) v(tags, per)""",
    "date_languages": f"SELECT o_orderkey, lang, {_AT} AS dt FROM orders, (VALUES (0::BIGINT), (1), (2)) v(lang)",
    "date_pattern_subset": f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN {_AT} END AS dt FROM orders",
    "date_parse_iso": _DATE.format("'dt:date:date_4'", f"{_AT} || ' 00:00:00'"),
    "date_parse_dmy": _DATE.format("'dt:date:date_1'", f"{_AT} || ' 00:00:00'"),
    "date_parse_named": _DATE.format("'dt:date:en_dmy_full'", f"{_AT} || ' 00:00:00'"),
    "date_parse_bracket": _DATE.format("'dt:date:date_1'", f"{_AT} || ' 00:00:00'"),
    "date_parse_time": _DATE.format("'dt:date:date_2:time'", f"{_AT} || ' 10:30:00'"),
    "date_parse_noyear": _DATE.format("'dt:date:en_dm_full'", "'2020' || strftime(o_orderdate, '-%m-%d') || ' 00:00:00'"),
    "date_reject_prefix": _DATE.format("NULL::VARCHAR", "NULL::VARCHAR"),
    "short_text_50": "SELECT event_id AS page_id, event_id % 200 AS n FROM events WHERE event_id % 200 < 50",
    "short_text_150": "SELECT event_id AS page_id, event_id % 200 AS n FROM events WHERE event_id % 200 < 150",
    "cluster_sizes": _ITEMS.format("page_id, count(*) AS n") + " GROUP BY page_id",
    "cluster_first_loss": f"""WITH {_ORDERS} SELECT page_id, n::BIGINT AS n,
      CASE WHEN n = 2 THEN 1 WHEN n = 3 THEN 2 ELSE 3 END::BIGINT AS clusters FROM (SELECT DISTINCT page_id, n FROM e) WHERE n > 1""",
    "cluster_tbody": _ITEMS.format("page_id, 'table' AS tag, count(*) AS n") + " GROUP BY page_id",
    "block_widths": _ITEMS.format("page_id, i, 2 * i AS position, 2::BIGINT AS shift, d AS entity"),
    "block_last_width": _ITEMS.format("DISTINCT page_id, 1::BIGINT AS shift"),
    "annotation_types": f"""WITH {_ORDERS}, c AS (SELECT count(*) AS n FROM e WHERE n > 1) SELECT v.aid, v.tag, v.types, c.n FROM c,
      (VALUES (0::BIGINT, 'li', 'tag:type:empty'), (1, 'span', 'tag:type:text,tag:type:last,tag:type:date'), (2, 'a', 'tag:type:text,tag:type:last,tag:type:url')) v(aid, tag, types)""",
    "items_basic": _ITEMS.format("page_id, i, title, strftime(od, '%Y-%m-%d') AS pubdate, link"),
    "items_title_desc": _ITEMS.format("page_id, i, title, title AS description"),
    "items_links": _ITEMS.format("page_id, link"),
    "items_unique_id": _ITEMS.format("page_id, md5(d || title || title) AS unique_id, 'dt:date:date_1' AS t_key"),
    "items_last_date_wins": _ITEMS.format("page_id, strftime(od + INTERVAL 3 DAY, '%Y-%m-%d') AS pubdate, title"),
    "items_raw_html": _ITEMS.format("""page_id, i, '<li><span>' || d || '</span><a href="/o/' || key || '?utm_source=x&amp;id=' || key || '">' || title || '</a></li>' AS raw_html"""),
    "feed_pattern_cache": _ITEMS.format("DISTINCT page_id, 'dt:date:date_1' AS pats"),
    "feed_counts": _ITEMS.format("page_id, count(*) AS num_entries") + " GROUP BY page_id",
    "session_metrics": f"""WITH {_ORDERS} SELECT page_id, (length('<html><head><title> Orders of  </title></head><body><ul></ul></body></html>') + length(page_id::VARCHAR)
      + sum(length('<li><span></span><a href="/o/?utm_source=x&amp;id="></a></li>') + length(d) + 2 * length(key::VARCHAR) + length(title)))::BIGINT AS page_length,
      5 + 3 * count(*) AS num_nodes, 1 + 2 * count(*) AS num_textcompared, count(*) AS num_datematched, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END::BIGINT AS num_clusters, true AS title_extracted FROM e GROUP BY page_id""",
    "feed_json": f"WITH {_ORDERS} SELECT page_id, 'Orders of ' || page_id AS title, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS n FROM e GROUP BY page_id",
    "feed_atom": f"WITH {_ORDERS} SELECT page_id, 'Orders of ' || page_id AS title, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS n FROM e GROUP BY page_id",
    "discover_dedupe": f"WITH {_FOUND}, g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) AS ord FROM f) SELECT k::BIGINT AS page_id, ord, method, url FROM g",
    "discover_report": f"WITH {_FOUND} SELECT k::BIGINT AS page_id, url AS title, url, 'rss' AS feedtype FROM f",
    "discover_extractrss": f"WITH {_ORDERS} SELECT page_id, 'Orders of ' || page_id AS title, 'http://c' || page_id || '.example.com/news/' AS url, 'html' AS feedtype, count(*) AS num_entries FROM e WHERE n > 1 GROUP BY page_id",
    "feed_parse": f"WITH {_DOCS} SELECT url, title, 'rss' AS feedtype, num_entries::BIGINT AS num_entries, language FROM docs",
    "feed_verify": f"WITH {_DOCS} SELECT k::BIGINT AS page_id, url, title, CASE WHEN url LIKE '%atom%' THEN 'atom' ELSE 'undefined' END AS feedtype, num_entries::BIGINT AS num_entries FROM docs",
    "discover_deep": f"""WITH {_DOCS}, r AS (SELECT n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY '<a href="http://n' || n_nationkey) AS nth, n_regionkey AS r FROM nation)
      SELECT 'http://r' || r.r || '.example/' AS page_url, url, CASE WHEN url LIKE '%atom%' THEN 'atom' ELSE 'undefined' END AS feedtype, 1::BIGINT AS depth FROM docs JOIN r USING (k) WHERE nth = 1""",
    "content_type_dispatch": """SELECT v.c AS content_type, v.f AS is_feed, count(*) AS n FROM nation, (VALUES ('application/rss+xml', true), ('application/rdf+xml', true), ('application/atom+xml', true), ('application/xml', true),
      ('text/xml', true), ('text/html', false), ('text/xml; charset=utf-8', false), ('application/json', false), (NULL, false)) v(c, f) GROUP BY ALL""",
    "charset_decode": "SELECT n_nationkey, n_name || ' Čéü' AS utf8, n_name || ' éü' AS latin, n_name || ' Čéü' AS utf16 FROM nation",
    "url_join": """SELECT page_id, k, replace(link, 'HOST', 'http://h' || page_id || '.example') AS link FROM pages, (VALUES (0::BIGINT, 'HOST/x'), (1, 'HOST/a/b/x'), (2, 'HOST/a/x'), (3, 'HOST/a/b/x?a=1#f'), (4, 'http://cdn/x'),
      (5, 'http://z/y'), (6, 'HOST/a/b/c.html?q'), (7, 'HOST/a/b/c.html#f'), (8, 'HOST/a/b/c.html')) v(k, link)""",
    "date_cached_time": f"SELECT o_orderkey, {_AT} || ' 00:00' AS day, {_AT} || ' 10:30' AS moment, NULL::VARCHAR AS none FROM orders",
    "date_cached_month": f"SELECT o_orderkey, lang, 'dt:date:' || lang || '_dmy_full' AS key, {_AT} AS dt FROM orders, (VALUES ('en'), ('de'), ('fr'), ('es'), ('pt'), ('ru'), ('bg'), ('cz')) v(lang)",
    "feed_malformed": """SELECT n_nationkey || '/' || k AS url, p || n_name AS title, n, e AS entries FROM nation, (VALUES (0, 'A & B ', 1::BIGINT, 'one'), (1, 'A' || chr(160) || 'B' || chr(233) || ' ', 1, 'one'), (2, 'C ', 1, 'one'),
      (3, 'D ', 2, 'one|two'), (4, 'E ', 2, 'one'), (5, 'F ', 2, 'one|a & <b>')) v(k, p, n, e)""",
    "find_direct": f"""WITH {_DOCS} SELECT 'http://n' || k || '.example/n/' AS page_url, url, title, CASE WHEN url LIKE '%atom%' THEN 'atom' ELSE 'undefined' END AS feedtype, num_entries::BIGINT AS num_entries FROM docs
      UNION ALL SELECT url, url, title, 'rss', num_entries::BIGINT FROM docs""",
    "find_html_parse": f"WITH {_DOCS} SELECT url, title, CASE WHEN url LIKE '%atom%' THEN 'atom' ELSE 'undefined' END AS feedtype, 1::BIGINT AS n FROM docs",
    "find_entries": f"WITH {_DOCS} SELECT k::BIGINT AS page_id, url, pos, 'e' || pos AS entry FROM docs, (VALUES (0::BIGINT), (1), (2)) v(pos) WHERE pos < num_entries",
    "discover_extension": "SELECT n_nationkey::BIGINT AS page_id, 'http://n' || n_nationkey || '.example/data/news' || n_nationkey || '.xml' AS url, 'undefined' AS feedtype, 'extension' AS method FROM nation",
    "url_absolute": """SELECT n_nationkey, b, r, replace(link, 'HOST', 'http://h' || n_nationkey) AS link FROM nation, (VALUES (0::BIGINT, 0::BIGINT, 'HOST/x'), (0, 1, 'x.html'), (0, 2, 'HOST/a/x'), (0, 3, 'https://z/q'), (0, 4, 'HOST'), (0, 5, 'HOST//cdn/x'),
      (1, 0, 'HOST/x'), (1, 1, 'HOST/a/x.html'), (1, 2, 'HOST/a/x'), (1, 3, 'https://z/q'), (1, 4, 'HOST'), (1, 5, 'HOST//cdn/x'), (2, 0, 'HOST/x'), (2, 1, 'x.html'), (2, 2, 'http://x'), (2, 3, 'https://z/q'), (2, 4, 'HOST'), (2, 5, 'HOST//cdn/x')) v(b, r, link)""",
    "feed_json_items": _ITEMS.format("page_id, i, title, title AS description, strftime(od, '%Y-%m-%dT%H:%M:%S') AS pubdate, link, link AS links"),
    "feed_atom_items": _ITEMS.format("page_id, i, title, 'en' AS language, 'http://atom/' || page_id AS self"),
    "block_histogram": _ITEMS.format("page_id, 2::BIGINT AS diff, count(*) - 1 AS n") + " GROUP BY page_id",
    "node_relations": f"""WITH {_ORDERS} SELECT page_id, '//html/*[1]/*[2]/*[1]/*[' || (i + 1) || ']/*[2]' AS xpath, i = 0 AS same, true AS beside, CASE WHEN i = 0 THEN 5 ELSE 3 END::BIGINT AS shared FROM e""",
}
for _m in ("link", "img", "name", "segment", "text"):
    ORACLE[f"discover_{_m}"] = f"WITH {_FOUND} SELECT k::BIGINT AS page_id, url, feedtype, title, confidence FROM f WHERE method = '{_m}'"
