"""Fetching URLs: of a table, or as a Python data source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = "url string, final_url string, content_type string, content binary, user_agent string"


def get(url: str | None, agent: str | None, timeout: float) -> tuple:
    """The row of FIELDS of one URL; nulls where nothing could be fetched."""
    from http.client import HTTPException
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url or "", headers={"User-agent": agent} if agent else {}), timeout=timeout) as answer:
            return url, answer.geturl(), answer.headers.get("content-type"), answer.read(), agent
    except (OSError, ValueError, HTTPException):
        return url, None, None, None, agent


def fetch(urls: DataFrame, url_col: str = "url", agent: str | None = None, timeout: float = 30) -> DataFrame:
    """FIELDS of every row of urls, fetched by the executors; a URL that fails, a malformed or null one has null content.

    The rows are fetched once per evaluation: write the result before using it twice.
    """

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 16):  # a few answers in memory at a time
                rows = [get(u, agent, timeout) for u in batch.column(0).slice(at, 16).to_pylist()]
                kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["url", "final_url", "content_type", "content", "user_agent"])

    from ..plans.code import ship

    ship(urls.sparkSession)
    return urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(work, FIELDS)


class Urls(InputPartition):
    def __init__(self, urls):
        self.urls = urls


class HttpReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.agent = options.get("user_agent")
        self.timeout = float(options.get("timeout", 30))
        self.batch = int(options.get("batch", 16))

    def partitions(self):
        return [Urls(self.urls[i : i + self.batch]) for i in range(0, len(self.urls), self.batch)] or [Urls([])]

    def read(self, partition):
        for url in partition.urls:
            yield get(url, self.agent, self.timeout)


class HttpSource(DataSource):
    """spark.dataSource.register(HttpSource); spark.read.format("http_pages").option("urls", "http://a http://b").load()"""

    @classmethod
    def name(cls):
        return "http_pages"

    def schema(self):
        return FIELDS

    def reader(self, schema):
        return HttpReader(self.options)
