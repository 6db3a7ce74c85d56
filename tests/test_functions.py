"""URL and date functions against tables of cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.functions import dates, urls
from feedloom.functions.text import date_text

ABSOLUTE = [
    ("http://h/a/b.html", "/x", "http://h/x"), ("https://h/a/", "/x", "http://h/x"), ("http://h/a/", "x.html", "http://h/a/x.html"), ("http://h/a/b.html", "x.html", "x.html"),
    ("http://h", "x.html", "x.html"), ("http://h/a/b.html", "./x", "http://h/a/x"), ("http://h/a", "", "http://h"), ("h.org/a", "/x", "http://h.org/x"), ("http://h/a/?p=1", "x", "http://h/a/?p=1x"),
    ("http://h/a/", "//cdn/x", "http://h//cdn/x"), ("http://h/a/", "mailto:m@x", "http://h/a/mailto:m@x"), ("http://h/a/", "HTTP://z/", "http://h/a/HTTP://z/"), ("http://h/a/", "https://z/q", "https://z/q"),
]
CLEAN = [
    ("http://h/p?utm_source=a&id=7&utm_medium=b", "http://h/p?id=7"), ("http://h/p?utm_source=feed", "http://h/p"), ("http://h/p?utm_source=feed#top", "http://h/p"), ("http://h/p?UTM_Source=a&b=", "http://h/p?b="),
    ("http://h/p?PHPSESSID=abc", "http://h/p?PHPSESSID=abc"), ("http://h/p?a=1&a=2", "http://h/p?a=1"), ("http://h/p?q=x%20y#f", "http://h/p?q=x y"), ("http://h/p?x", "http://h/p?x="), ("http://h/p#f", "http://h/p#f"),
    ("http://h/p?", "http://h/p"), ("http://h/p;jsessionid=" + "0" * 32 + "?id=1", "http://h/p?id=1"), ("HTTP://H/p", "http://H/p"),
]
DATES = [
    ("18/06/2018", "2018-06-18", "dt:date:date_1"), ("05/06/2018", "2018-06-05", "dt:date:date_1"), ("2017-09-27", "2017-09-27", "dt:date:date_4"), ("1 jul 2016", "2016-07-01", "dt:date:en_dmy_short"),
    ("27-01-2018", "2018-01-27", "dt:date:date_3"), ("Published - 27-01-2018", None, None), ("[01/02/2020]", "2020-02-01", "dt:date:date_1"), (" [01/02/2020]", None, None), ("1 jul 2016", "2016-07-01", "dt:date:en_dmy_short"),
    ("02:12", None, None), ("31/02/2020", None, None), ("[]", None, None), ("Monday, 5 June 2018", "2018-06-05", None), ("June 5, 2018 and more", "2018-06-05", None), ("3. März 2019", "2019-03-03", None),
    ("12 февраля 2020", "2020-02-12", None), ("5 de octubre de 2017", "2017-10-05", None), ("15. srpna 2016", "2016-08-15", None), ("7 юли 2018", "2018-07-07", None), ("1 février 2020", "2020-02-01", None), ("20180612", "2018-06-12", None), (None, None, None), ("", None, None),
]


def test_absolute_and_clean(spark):
    got = spark.createDataFrame(ABSOLUTE, "r string, u string, e string").select("e", urls.absolute(F.col("r"), F.col("u")).alias("g")).collect()
    assert [r["g"] for r in got] == [r["e"] for r in got]
    got = spark.createDataFrame(CLEAN, "u string, e string").select("e", urls.clean(F.col("u")).alias("g")).collect()
    assert [r["g"] for r in got] == [r["e"] for r in got]


def test_dates(spark):
    m = dates.match(date_text(F.col("t")), as_of_year=2020)
    got = spark.createDataFrame([(t,) for t, _, _ in DATES], "t string").select("t", m.alias("m")).collect()
    for row, (text, day, key) in zip(got, DATES):
        assert (row["m"]["dt"].date().isoformat() if row["m"] else None) == day, text
        if key:
            assert row["m"]["key"] == key
    assert len(dates.catalogue()) >= 348
    assert len({k for k, *_ in dates.catalogue()}) == len(dates.catalogue())


def test_date_keys_limit_the_patterns(spark):
    df = spark.createDataFrame([("18/06/2018",), ("2018-06-18 10:30",)], "t string")
    got = df.select(dates.match(F.col("t"), keys=["dt:date:date_4:time"]).alias("m")).collect()
    assert got[0]["m"] is None and got[1]["m"]["dt"] == datetime.datetime(2018, 6, 18, 10, 30)


@pytest.mark.parametrize("base,ref,want", [("http://a/b/c/d;p?q", "../g", "http://a/b/g"), ("http://a/b/c/d;p?q", "g?y#s", "http://a/b/c/g?y#s"), ("http://a/b/c/d;p?q", "../../../g", "http://a/g"), ("http://a", "g", "http://a/g")])
def test_join(spark, base, ref, want):
    assert spark.range(1).select(urls.joined(F.lit(base), F.lit(ref))).first()[0] == want
