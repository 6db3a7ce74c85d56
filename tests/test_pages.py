"""Extraction and discovery on hand-written pages, one per rule."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from feedloom.plans.pipeline import Extractor, Finder
from feedloom.plans.queries import ORACLE, QUERIES
from feedloom.sources.html import nodes as node_table
from feedloom.sources.html import parse

BASE = "http://h.example/n/"


def li(d, t, h):
    return f'<li><span>{d}</span><a href="{h}">{t}</a></li>'


def page(body, title="<title> T </title>"):
    return f"<html><head>{title}</head><body>{body}</body></html>"


VIDEO = '<div class="video-box"><a href="https://www.youtube.com/watch?v={v}?autoplay=1"><div><span class="video-icon"><img height="100" src="/img/site/play.png" width="100"/></span><div><div><div class="video-date-time"><small>{d}</small><span class="space-separator"> | </span><small>{h}</small></div><div class="video-title">{t}</div></div></div></div></a></div>'
G1 = page(
    '<div><div class="first-column">' + VIDEO.format(v="YlKa2LZgxhE", d="18/06/2018", h="02:12", t="Blockchain Challenge: coders at the EIB")
    + '</div><div class="second-column">' + VIDEO.format(v="T_7OmSDSXtc", d="04/06/2018", h="01:32", t="A brighter life for Kenyan women")
    + VIDEO.format(v="d-btxsYT9hI", d="05/06/2018", h="03:12", t="Jujuy Verde â€“ new horizons for women waste-pickers in Argentina") + "</div></div>",
    "<title>European Investment Bank (EIB)</title>",
)
PAGES = {
    "B1": page("<ul>" + li("01/02/2020", "First headline here", "/a?utm_source=x&amp;id=1") + li("02/02/2020", "Second headline here", "/a?id=2") + "</ul>"),
    "B2": page("<ul>" + li("01/02/2020", "First headline here", "/a") + "</ul>"),
    "B3": page("<div>" + "".join(f"<p><i>0{i}/02/2020</i>Headline number {i}</p>" for i in (1, 2)) + "</div><div>" + "".join(f"<p><i>0{i}/02/2020</i>Headline number {i}</p>" for i in (3, 4, 5)) + "</div>"),
    "B4": page("<div><p>01/02/2020</p><p>Headline number one</p><p>02/02/2020</p><p>Headline number two</p><p>extra text paragraph</p><p>03/02/2020</p><p>Headline number three</p></div>"),
    "B5": page("<div><p>01/02/2020</p><p>Headline number one</p><p>More text in paragraph</p><p>02/02/2020</p><p>Headline number two</p><p>03/02/2020</p><p>Headline number three</p><p>04/02/2020</p><p>Headline number four</p><p>05/02/2020</p><p>Headline number five</p><p>Footer paragraph text</p></div>"),
    "B6": page("<table><tbody>" + "".join(f"<tr><td>0{i}/02/2020</td><td>headline text {i}</td></tr>" for i in (1, 2)) + "</tbody></table>"),
    "B7": page("<ul>" + 2 * "<li><span>01/02/2020</span><!-- c -->Tail headline text</li>" + "</ul>"),
    "B8": page("<ul>" + 2 * "<li><br>01/02/2020<b>Headline number one</b></li>" + "</ul>"),
    "B9": page("<ul>" + 2 * "<li><br>10 February 2020<b>Headline number one</b></li>" + "</ul>"),
    "B10": page("<ul>" + li("[01/02/2020]", "Same headline text", "/a") + li("[02/02/2020]", "Same headline text", "/a") + "</ul>"),
    "B11": page("<div><p>01/02/2020</p><section><p>02/02/2020</p></section></div>"),
    "B14": page("<ul>" + "".join(f"<li><span>0{i}/02/2020</span><script>var x = 'a long script';</script><style>p {{ margin: 0 }} long</style></li>" for i in (1, 2)) + "</ul>"),
    "G1": G1,
    "none": None,
    "blank": "  ",
}


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, BASE if k != "G1" else "http://www.eib.org/en/index.htm?lang=en", h) for i, (k, h) in enumerate(PAGES.items())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {}
    for limit in (50, 150):
        ex = Extractor(spark, limit)
        dated = ex.dated(pages, raw=True)
        items = ex.items(pages, dated, raw=True).orderBy("page_id", "cord", "i").collect()
        sizes = ex.clusters(dated).groupBy("page_id", "snode").agg(F.count("*").alias("n"), F.min("cord").alias("c")).orderBy("page_id", "c").collect()
        names = list(PAGES)
        out[limit] = ({k: [r for r in items if names[r["page_id"]] == k] for k in PAGES}, {k: [r["n"] for r in sizes if names[r["page_id"]] == k] for k in PAGES})
    return out


def test_golden(made):
    one, two = made[150][0]["G1"]
    assert one["title"] == one["description"] == "Blockchain Challenge: coders at the EIB"
    assert one["unique_id"] == "f9d359f76118076c5331ffec3cdb82eb"
    assert one["link"] == "https://www.youtube.com/watch?v=YlKa2LZgxhE?autoplay=1" and one["images"] == ["http://www.eib.org/img/site/play.png"]
    assert two["title"] == "A brighter life for Kenyan women" and two["description"].startswith("Jujuy Verde")
    assert two["unique_id"] == "9caef61535352d2734d122c0e092b011"
    assert str(two["pubdate"]) == "2018-06-05 00:00:00" and str(one["pubdate"]) == "2018-06-18 00:00:00"
    assert len(two["links"]) == 2 and len(two["images"]) == 1
    assert one["t_key"] == "dt:date:date_1"
    assert one["raw_html"].startswith('<div class="first-column"><div class="video-box"><a href="https://www.youtube')


def test_basic(made):
    items, sizes = made[50]
    b1 = items["B1"]
    assert [r["link"] for r in b1] == ["http://h.example/a?id=1", "http://h.example/a?id=2"]
    assert [r["unique_id"] for r in b1] == ["4830dc7782fa4f909be30f31cd37661f", "165d378ac0f8293823381e8fab387b7b"]
    assert items["B2"] == [] and sizes["B2"] == []
    assert items["none"] == [] and items["blank"] == []


def test_clusters_and_widths(made):
    items, sizes = made[50]
    assert sizes["B3"] == [2, 1, 2] and len(items["B3"]) == 4
    assert [r["description"] for r in items["B4"]] == ["Headline number one", "extra text paragraph", "Headline number three"] or items["B4"][1]["description"].endswith("extra text paragraph")
    assert items["B5"][-1]["description"].endswith("Footer paragraph text")
    assert len(items["B6"]) == 2 and sizes["B11"] == []


def test_text_rules(made):
    items = made[50][0]
    assert [(r["title"], r["description"], r["link"], r["unique_id"]) for r in items["B7"]] == 2 * [(None, None, BASE, "5f4d237e048630225d89594ea758f6c3")]
    assert [r["title"] for r in items["B8"]] == 2 * ["Headline number one"]
    assert [r["title"] for r in items["B9"]] == 2 * ["10 February 2020"] and items["B9"][0]["description"] == "10 February 2020\nHeadline number one"
    assert [r["unique_id"] for r in items["B10"]] == ["36010319234cd889a58db71e36646156", "47aa000aeed45383c3b2aa7466f57404"]
    assert all("margin" in r["title"] for r in items["B14"])
    assert hashlib.md5(b"x").hexdigest()


def test_tag_paths(spark):
    """Every node has its own page's tags, whatever the page's id, by the parsing stage alone."""
    rows = [(1, page("<ul><li>a<!-- c --></li></ul>")), (1, page("<p><b>x</b></p>")), (None, page("<p>y</p>"))]
    made = node_table(spark.createDataFrame(rows, "page_id long, html string"), raw=False, tag_path=True)
    got = sorted("/".join(t or "" for t in r["tag_path"]) for r in made.where("tag IS NULL OR tag NOT IN ('html', 'head', 'body', 'title')").collect())
    assert got == ["html/body/p", "html/body/p", "html/body/p/b", "html/body/ul", "html/body/ul/li", "html/body/ul/li/"]


def test_tag_paths_reads_pages_once(spark, tmp_path):
    spark.sql("SELECT 5L AS o_custkey, id AS o_orderkey, timestamp'2020-01-02' AS o_orderdate FROM range(3)").write.parquet(str(tmp_path / "orders.parquet"))
    df = QUERIES["tag_paths"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 1
    count = {"html/body/ul/li" + x: 3 for x in ("", "/a", "/span")} | {"html" + x: 1 for x in ("", "/head", "/head/title", "/body", "/body/ul")}
    assert {r["tags"]: r["n"] for r in df.collect()} == count


TITLES = ["of a&amp;&amp;&amp", "b&quot", "c &lt;&copy &notit; &amp", " d &eacute;&#65; "]


def titled(spark, path):
    rows = [(i, BASE, page("<p>x</p>", f"<title>{t}</title>")) for i, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    return ["of a&&&amp", "b&quot", "c <&copy &notit; &amp", "d \u00e9A"]


def test_title_cut_within_a_reference(spark, tmp_path):
    """A name is a reference with its semicolon only, as in the SQL."""
    want = titled(spark, tmp_path)
    assert {r["page_id"]: r["title"] for r in QUERIES["page_title"](spark, str(tmp_path)).collect()} == dict(enumerate(want))
    first = duckdb.sql(ORACLE["page_title"].replace("pages", f"'{tmp_path}/pages.parquet/*.parquet'") + " WHERE page_id < 2 ORDER BY page_id").fetchall()
    assert first == [*enumerate(want[:2])]


def test_header_of_a_title_cut_within_a_reference(spark, tmp_path):
    want = titled(spark, tmp_path)
    got = {r["page_id"]: tuple(r)[1:] for r in QUERIES["feed_header"](spark, str(tmp_path)).collect()}
    assert got == {i: (t, "en", BASE, t, True) for i, t in enumerate(want)}
    sql = duckdb.sql(ORACLE["feed_header"].replace("pages", f"'{tmp_path}/pages.parquet/*.parquet'") + " WHERE page_id < 2").fetchall()
    assert {r[0]: r[1:] for r in sql} == {i: got[i] for i in (0, 1)}


def test_references_in_attributes_and_raw_text():
    root = parse('<body><a href="/x?a=1&copy=2&amp=3&amp;d=4" title=a&amp>t &amp</a><!-- &amp &amp; --><script>&amp; &amp</script></body>')
    a, comment, script = root.children[0].children
    assert a.attrs == {"href": "/x?a=1&copy=2&amp=3&d=4", "title": "a&amp"} and a.text == "t &amp"
    assert (comment.text, script.text) == (" &amp &amp; ", "&amp; &amp")


def test_discovery(spark):
    html = page(
        '<a href="/news"><img src="/i/rss_icon.png" alt="RSS"></a><a href="/feed/">x</a><a href="/feedback">f</a><a href="/rss/news.html">n</a><a href="/feed/">again</a><a href="/all">Our RSS</a><a href="/rss2.xml">later</a>',
        '<link rel="alternate" type="application/atom+xml" href="/atom.xml" title="A"><link rel="ALTERNATE" type="text/html" href="/m"><link rel="alternate" href="/x">',
    )
    pages = spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")
    got = Finder(spark).candidates(pages).orderBy("ord").collect()
    host = "http://h.example"
    assert [(r["url"], r["feedtype"], r["title"], r["confidence"], r["method"]) for r in got] == [
        (host + "/atom.xml", "atom", "A", 1.0, "link"), (host + "/x", None, None, 1.0, "link"), (host + "/news", "rss", "RSS", 0.5, "img"), (host + "/feed/", "undefined", None, 0.5, "name"),
        (host + "/rss/news.html", "rss", None, 0.5, "segment"), (host + "/all", "rss", None, 0.5, "text"),
    ]
    report = Finder(spark).find(pages).collect()
    assert len(report) == 6 and all(r["title"] == r["url"] and r["feedtype"] == "rss" for r in report)


def test_stream_drops_nothing_new(spark, tmp_path):
    from feedloom.streaming.items import extract_new, pages

    rows = spark.createDataFrame([(1, BASE, PAGES["B1"], None)], "page_id long, url string, html string, fetched string").withColumn("fetched", F.current_timestamp())
    rows.write.parquet(str(tmp_path / "in"))
    query = extract_new(pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_cli(spark, tmp_path, capsys):
    from feedloom.cli import main

    spark.createDataFrame([(1, BASE, PAGES["B1"])], "page_id long, url string, html string").write.parquet(str(tmp_path / "p.parquet"))
    assert main(["parsedate", "18/06/2018"], spark) == 0 and main(["extract", str(tmp_path / "p.parquet")], spark) == 0
    out = capsys.readouterr().out
    assert "dt:date:date_1" in out and "First headline here" in out
