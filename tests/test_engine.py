"""Date catalogue, malformed feeds, fetching over loopback, streaming over two batches, exports."""

import random
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from test_pages import BASE, PAGES

from feedloom.functions import dates
from feedloom.plans.pipeline import Extractor
from feedloom.sources import feeds, http

SAMPLES = {"dmy": "{w}5 {m} 2018", "mdy": "{w}{m} 5, 2018", "ymd": "2018 {m} 5", "dm": "5 {m}", "md": "{m} 5"}
NUMBERS = {1: "05/06/2018", 2: "05.06.2018", 3: "05-06-2018", 4: "2018-06-05", 5: "2018/06/05", 6: "2018.06.05", 7: "05/06/18", 8: "05.06.18", 9: "05-06-18", 10: "20180605", 11: "05 06 2018"}


def sample(key: str) -> str:
    name, time = key.removeprefix("dt:date:").removesuffix(":time"), " 10:30" if key.endswith(":time") else ""
    if name.startswith("date_"):
        return NUMBERS[int(name[5:])] + time
    lang, shape, style = name.split("_")
    month = next(n for n, i, of, how in dates.named_months() if (of, how, i) == (lang, style, 6))
    return SAMPLES[shape.removeprefix("w")].format(w="Tag, " if shape.startswith("w") else "", m=month) + time


def test_every_pattern_of_the_catalogue(spark):
    """A sample of each pattern matches its own expression, and gives its own key where that alone is allowed."""
    rows = [(key, expr, sample(key), [key]) for key, expr, _, _ in dates.catalogue()]
    df = spark.createDataFrame(rows, "key string, expr string, text string, allowed array<string>")
    m = dates.match(F.col("text"), as_of_year=2018, keys=F.col("allowed"))
    got = df.select("key", "text", F.expr("regexp_like(text, expr)").alias("fits"), m["key"].alias("found"), F.date_format(m["dt"], "yyyy-MM-dd HH:mm").alias("dt")).collect()
    assert [(r["key"], r["text"]) for r in got if not r["fits"]] == []
    want = lambda r: "2018-06-05 10:30" if r["key"].endswith(":time") else "2018-06-05 00:00"
    assert [(r["key"], r["text"], r["found"], r["dt"]) for r in got if r["found"] != r["key"] or r["dt"] != want(r)] == []
    assert len(rows) >= 348


def test_learnt_patterns_hold_in_other_months(spark):
    rows = [("3. April 2019", "de_dmy_full"), ("5 mai 2018", "fr_dmy_full"), ("7 abril 2018", "pt_dmy_full"), ("18/06/2018 10:30", "date_1")]
    df = spark.createDataFrame([(t, ["dt:date:" + k]) for t, k in rows], "t string, k array<string>")
    got = [r["m"]["key"] for r in df.select(dates.match(F.col("t"), keys=F.col("k")).alias("m")).collect()]
    assert got == ["dt:date:" + k for _, k in rows]


def test_feeds_never_raise():
    base = '<?xml version="1.0"?><rss><channel><title>T &amp; U</title><language>en</language><item><title>a</title></item><item><title>b</title></item></channel></rss>'
    assert feeds.read(base) == ("T & U", "en", 2, ["a", "b"])
    r = random.Random(3)
    for _ in range(3000):
        text = list(base)
        for _ in range(r.randrange(1, 12)):
            at = r.randrange(len(text))
            text[at : at + r.randrange(3)] = r.choice(["<", ">", "&", "&nbsp;", "\x00", "]]>", "<![CDATA[", "<!--", '"', "</", "é", "<?", "<!DOCTYPE x ["])
        found = feeds.read("".join(text))
        assert found is None or isinstance(found[0], str)
    assert feeds.read("<rss>" * 5000) is None


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/page")
            self.end_headers()
            return
        self.send_response(200 if self.path == "/page" else 404)
        self.send_header("Content-Type", "text/html")
        self.end_headers()
        self.wfile.write(f"<p>{self.headers['User-agent']}</p>".encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(spark, site):
    urls = spark.createDataFrame([(f"{site}/page",), (f"{site}/moved",), (f"{site}/none",), ("no url",), (None,), ("http://127.0.0.1:1/",)], "url string")
    got = [(r["url"], r["final_url"], r["content_type"], bytes(r["content"]) if r["content"] else None) for r in http.fetch(urls, agent="feedloom test", timeout=10).collect()]
    body = b"<p>feedloom test</p>"
    assert got == [(f"{site}/page", f"{site}/page", "text/html", body), (f"{site}/moved", f"{site}/page", "text/html", body), *[(u, None, None, None) for u in (f"{site}/none", "no url", None, "http://127.0.0.1:1/")]]


def test_source(spark, site):
    spark.dataSource.register(http.HttpSource)
    got = spark.read.format("http_pages").option("urls", f"{site}/page {site}/none").load().collect()
    assert sorted((r["url"], r["final_url"]) for r in got) == sorted([(f"{site}/page", f"{site}/page"), (f"{site}/none", None)])


@pytest.mark.parametrize("reuse", [False, True])
def test_second_batch_brings_new_items_only(spark, tmp_path, reuse):
    from feedloom.streaming.items import extract_new, pages

    def arrive(html, day):
        row = spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string").withColumn("fetched", F.expr(f"timestamp'2020-01-0{day} 00:00:00'"))
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        extract_new(pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), reuse_patterns=reuse).awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    first = arrive(PAGES["B1"], 1)
    assert first.count() == 2
    assert arrive(PAGES["B1"], 2).count() == 2
    title = re.search(r">([^<>]{11,})<", PAGES["B1"])[1]
    last = arrive(PAGES["B1"].replace(title, "A headline that nobody has seen"), 3)
    assert last.count() == 3 and last.where("title = 'A headline that nobody has seen'").count() == 1


def test_cached_patterns_of_a_page(spark):
    rows = [(1, BASE, PAGES["B1"], None), (2, BASE, PAGES["B1"], ["dt:date:date_4"]), (3, BASE, PAGES["B1"], ["dt:date:date_1"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, cached_p array<string>")
    got = {r["page_id"]: r["count"] for r in Extractor(spark).items(df).groupBy("page_id").count().collect()}
    assert got == {1: 2, 3: 2}


def test_long_listing_stays_linear(spark):
    """20,000 entries on one page: blocks meet their own nodes only."""
    entries = "".join(f"<li><b>{1 + i % 28:02}/06/2018</b><a href='/n{i}'>Headline number {i}</a></li>" for i in range(20_000))
    df = spark.createDataFrame([(1, BASE, f"<ul>{entries}</ul>")], "page_id long, url string, html string")
    assert Extractor(spark).items(df).count() == 20_000
