"""Items: the ordered fold of a block's annotations into a title, a description, links, images, a date and an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, let, strip
from ..functions.urls import absolute, clean

KEYS = ["page_id", "snode", "cord", "i", "entity"]


def _fold(events: Column) -> Column:
    """struct(title, description) of events (s stripped, r raw length, tail)."""

    def texts(x):
        events, t, title = x["e"], x["t"], x["title"]
        starts = F.transform(events, lambda e, i: (i + 1 >= t) & (e["r"] > 10) & (e["tail"] | (e["s"] != title)))
        told = let(F.array_position(starts, F.lit(True)), lambda d: F.when(d > 0, F.array_join(F.transform(F.filter(events, lambda e, i: (i + 1 >= d) & (e["r"] > 10)), lambda e: e["s"]), "\n")))
        return F.struct(title.alias("title"), F.when(t > 0, F.coalesce(told, title)).alias("description"))

    first = lambda e: F.array_position(F.transform(e, lambda x: F.char_length(x["s"]) > 10), F.lit(True))
    placed = let(events, lambda e: let(first(e), lambda t: F.struct(e.alias("e"), t.alias("t"), F.when(t > 0, F.get(e, (t - 1).cast("int"))["s"]).alias("title"))))
    return let(placed, texts)


def item_id(entity: Column, title: Column, description: Column) -> Column:
    return F.md5(F.encode(F.concat(entity, F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))), "UTF-8"))


def items(annotations: DataFrame, pages: DataFrame, strict_rfc: bool = False) -> DataFrame:
    """(page_id, snode, cord, i, title, description, pubdate, unique_id, links, images, link, t_key).

    annotations holds the block's nodes with m; pages is (page_id, url). Comments are passed over, their tails too. The
    first text of over ten letters is the title; what follows makes the description, or the title does. The last date of the
    block is the item's; a block without a date or entity gives no item.
    """
    script = F.coalesce(F.col("tag") == "script", F.lit(False))
    event = lambda c, tail: F.struct(F.coalesce(strip(c), F.lit("")).alias("s"), F.coalesce(F.char_length(c), F.lit(0)).alias("r"), F.lit(tail).alias("tail"))
    of_text = F.when(~blank(F.col("text")) & ~script & F.col("m").isNull(), event(F.col("text"), False))
    of_tail = F.when(~blank(F.col("tail")), event(F.col("tail"), True))
    href = F.when(F.col("tag") == "a", F.try_element_at("attrs", F.lit("href")))
    src = F.when(F.col("tag") == "img", F.try_element_at("attrs", F.lit("src")))
    seen = annotations.where("kind <> 'comment'").select(
        *KEYS, "aid", F.array_compact(F.array(of_text, of_tail)).alias("events"), href.alias("href"), src.alias("src"), "m"
    )
    sorted_of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("aid", c)))), lambda x: x[c])
    told = seen.groupBy(*KEYS).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("events") > 0, F.struct("aid", "events")))), lambda x: x["events"])).alias("events"),
        sorted_of("href").alias("hrefs"), sorted_of("src").alias("srcs"), F.max_by("m", F.when(F.col("m").isNotNull(), F.col("aid"))).alias("m"),
    ).where("m IS NOT NULL AND entity IS NOT NULL")
    told = told.join(pages.select("page_id", "url"), "page_id")
    told = told.withColumn("said", _fold(F.col("events")))
    resolve = lambda arr: F.array_distinct(F.transform(arr, lambda u: clean(absolute(F.col("url"), u, strict_rfc))))
    told = told.withColumn("links", resolve(F.col("hrefs"))).withColumn("images", resolve(F.col("srcs")))
    link = F.coalesce(clean(absolute(F.col("url"), F.get("links", F.lit(0)), strict_rfc)), clean(F.col("url")))
    return told.select(
        "page_id", "snode", "cord", "i", "said.title", "said.description", F.col("m.dt").alias("pubdate"), item_id(F.col("entity"), F.col("said.title"), F.col("said.description")).alias("unique_id"),
        "links", "images", link.alias("link"), F.col("m.key").alias("t_key"),
    )


def raw_html(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, snode, cord, i, raw_html): the markup of each block's children, tails included."""
    pieces = nodes.select("page_id", F.explode(F.array(F.struct(F.col("start_pos").alias("pos"), F.col("head").alias("piece")), F.struct(F.col("end_pos").alias("pos"), F.col("foot").alias("piece")))).alias("p")).select("page_id", "p.*")
    keys = ["page_id", "snode", "cord", "i"]
    inside = spans.select(*keys, F.explode(F.sequence("lo_pos", "hi_pos")).alias("pos")).join(pieces, ["page_id", "pos"])
    return inside.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("raw_html"))


def pattern_cache(items: DataFrame) -> DataFrame:
    """(page_id, pats): the distinct pattern keys of a page's items, in order of appearance."""
    first = items.groupBy("page_id", "t_key").agg(F.min(F.struct("cord", "i")).alias("at"))
    return first.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "t_key"))), lambda x: x["t_key"]).alias("pats"))
