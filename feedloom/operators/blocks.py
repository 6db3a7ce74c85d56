"""Blocks: runs of children of a cluster's ancestor, one per date, and the annotations in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def histogram(diffs: DataFrame) -> DataFrame:
    """(page_id, snode, diff, n, last_i): how often each difference of neighbouring positions occurs, and where last."""
    return diffs.where("diff IS NOT NULL").groupBy("page_id", "snode", "diff").agg(F.count("*").alias("n"), F.max("i").alias("last_i"))


def typical_width(diffs: DataFrame) -> DataFrame:
    """(page_id, snode, width): the distinct difference whose last occurrence comes first."""
    return histogram(diffs).groupBy("page_id", "snode").agg(F.min_by("diff", "last_i").alias("width"))


def blocks(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, snode, cord, i, position, shift, entity) of each block.

    A table's first tbody child stands for the table. A block starts at the child that holds its date and reaches to the next
    date's; the last has the typical width (none in a cluster of one date). entity is the date's text: stripped, but of
    the last block as it was matched. A block other than the last whose node has neither text nor tail is left out.
    """
    tables = nodes.where("tag = 'table'").select("page_id", F.col("nid").alias("parent_nid"))
    inner = nodes.where("tag = 'tbody'").join(tables, ["page_id", "parent_nid"]).groupBy("page_id", F.col("parent_nid").alias("snode")).agg(F.min("nid").alias("tbody"))
    placed = clusters.join(inner, ["page_id", "snode"], "left").withColumn("root", F.coalesce("tbody", "snode"))
    levels = nodes.select("page_id", F.col("nid").alias("root"), F.col("level").alias("root_level"), F.col("children").alias("root_children"))
    placed = placed.join(levels, ["page_id", "root"])
    under = F.array_contains("anc", F.col("root"))
    placed = placed.withColumn("position", F.when(under, F.get("path", F.col("root_level"))).otherwise(F.get("path", F.lit(1)))).where("position IS NOT NULL")
    order = Window.partitionBy("page_id", "snode").orderBy("i")
    diffs = placed.withColumn("diff", F.lead("position").over(order) - F.col("position"))
    width = typical_width(diffs)
    last = F.col("i") == F.col("n") - 1
    own = strip(F.coalesce("text", "tail"))
    entity = F.when(~last, own).when(F.coalesce(F.col("text") != "", F.lit(False)), strip(F.col("m.text"))).otherwise(own)
    out = diffs.join(width, ["page_id", "snode"], "left").select(
        "page_id", "snode", "root", "root_children", "cord", "i", "nid", "position", F.when(last, F.coalesce("width", F.lit(0))).otherwise(F.col("diff")).alias("shift"), entity.alias("entity"), last.alias("is_last")
    )
    return out.where("is_last OR entity IS NOT NULL")


def spans(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """blocks with lo and hi, the first and last node of their children's subtrees; blocks without children go.

    The first and the last child are found by their indexes, so a block meets two rows, whatever its page's size.
    """
    has = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("int")
    child = nodes.where("parent_nid IS NOT NULL").select("page_id", F.col("parent_nid").alias("root"), "child_idx", "nid", "end_nid", has("start_pos").alias("start"), has("end_pos").alias("stop"))
    first = child.select("page_id", "root", F.col("child_idx").alias("position"), F.col("nid").alias("lo"), F.col("start").alias("lo_pos"))
    end = child.select("page_id", "root", F.col("child_idx").alias("last"), F.col("end_nid").alias("hi"), F.col("stop").alias("hi_pos"))
    keys = ["page_id", "snode", "root", "cord", "i", "position", "shift", "entity"]
    placed = blocks.where("shift > 0").select(*keys, (F.least(F.col("position") + F.col("shift"), "root_children") - 1).alias("last"))
    return placed.join(first, ["page_id", "root", "position"]).join(end, ["page_id", "root", "last"]).select(*keys, "lo", "hi", "lo_pos", "hi_pos")


def annotations(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per node of each block, aid counting them from 0 in document order: a subtree's nodes are numbered in a row."""
    each = spans.select("*", F.posexplode(F.sequence("lo", "hi")).alias("aid", "nid"))
    return each.join(nodes, ["page_id", "nid"])
