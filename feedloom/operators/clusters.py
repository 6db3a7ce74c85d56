"""Clusters: date nodes that follow each other on one level, grouped by their shared ancestor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nodes import by_page, short_text


def shared_ancestor(a: Column, b: Column) -> Column:
    """The deepest common element of two ancestor arrays (root first) of one length; null if there is none."""
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: x == y), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s["n"] + F.when(s["go"] & e, 1).otherwise(0)).alias("n"), (s["go"] & e).alias("go"))
    )["n"]
    return F.get(a, same - 1)


def clusters(dated: DataFrame, limit: int = 50) -> DataFrame:
    """(page_id, snode, cord, i, n, nid, ...) : the nodes of each cluster in order.

    dated is the node table with m. Consecutive date nodes of one level belong to the cluster of their shared ancestor (of a
    tbody: its parent). The very first pair of a page gives both nodes, any later pair only its second: later clusters
    lack their first date. cord numbers clusters by first appearance.
    """
    w = by_page()
    found = short_text(dated, limit).where("m IS NOT NULL")
    cur = F.struct("nid", "level", "anc", "path", "text", "tail", "m")
    pairs = found.select("page_id", "nid", cur.alias("cur"), F.lag(cur).over(w).alias("prev")).where("prev IS NOT NULL AND cur.level = prev.level")
    pairs = pairs.withColumn("lca", shared_ancestor(F.col("cur.anc"), F.col("prev.anc"))).where("lca IS NOT NULL").withColumn("ord", F.row_number().over(w))
    bodies = dated.where("tag = 'tbody' AND parent_nid IS NOT NULL").select("page_id", F.col("nid").alias("lca"), F.col("parent_nid").alias("up"))
    pairs = pairs.join(bodies, ["page_id", "lca"], "left").withColumn("snode", F.coalesce("up", "lca"))
    both = F.when(F.col("ord") == 1, F.array("prev", "cur")).otherwise(F.array("cur"))
    each = pairs.select("page_id", "snode", "ord", F.posexplode(both).alias("k", "x"))
    group = Window.partitionBy("page_id", "snode")
    seq = group.orderBy("ord", "k")
    return each.select(
        "page_id", "snode", F.min("ord").over(group).alias("cord"), (F.row_number().over(seq) - 1).alias("i"), F.count("*").over(group).alias("n"),
        "x.nid", "x.path", "x.anc", "x.text", "x.tail", "x.m",
    )
