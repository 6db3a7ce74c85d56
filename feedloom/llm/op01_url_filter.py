"""URL filters: a tree of path templates per host, judged by smoothed labelled purity, beside explicit rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rules of the registered query: (action, host/path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Path segments below this level are one tail wildcard.
DEPTH = 6
#: A branch stays apart from its siblings only with so many rows and so large a z score.
SUPPORT, Z = 10, 2.58
#: Bands of the labelled rate in which a node's branches are pooled before they are held against each other.
BANDS = 16
#: Weight of the parent's rate in a child's, in labelled rows; the rate at which a template is rejected.
SMOOTH, REJECT = 4.0, 0.5


def host_of(url: Column) -> Column:
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(action, rule) of the longest rule that fits, or null. Rules are a short list of the driver's."""
    out = None
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        hit = F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<action:string,rule:string>")


def unlike(known: Column, bad: Column, known2: Column, bad2: Column) -> Column:
    """Whether two labelled rates differ, by the two-proportion z test."""
    n, n2 = F.greatest(known, F.lit(1)), F.greatest(known2, F.lit(1))
    pooled = (bad + bad2) / F.greatest(known + known2, F.lit(1))
    return F.abs(bad / n - bad2 / n2) > Z * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / n2))


def merge(apart: DataFrame) -> DataFrame:
    """apart (host, template, segment, known, bad) with the column kept, the name of the segment's cluster.

    Branches of a node are pooled by bands of their rate; neighbouring bands go together, from the lowest on, as long as the
    test doesn't tell the next one from those already together. A node has BANDS bands at most, however many branches.
    A cluster is named after its only branch, or as {first branch+number of others}.
    """
    node = ["host", "template"]
    apart = apart.withColumn("band", F.expr(f"cast(least(bad * {BANDS} div known, {BANDS - 1}) AS int)"))
    bands = apart.groupBy(*node, "band").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    bands = bands.groupBy(*node).agg(F.sort_array(F.collect_list(F.struct("band", "known", "bad"))).alias("bands"))
    start = F.expr("named_struct('known', 0L, 'bad', 0L, 'first', -1, 'out', cast(array() AS array<struct<band:int,first:int>>))")

    def step(acc: Column, x: Column) -> Column:
        fresh = (acc["known"] == 0) | unlike(acc["known"], acc["bad"], x["known"], x["bad"])
        first = F.when(fresh, x["band"]).otherwise(acc["first"])
        return F.struct(
            F.when(fresh, x["known"]).otherwise(acc["known"] + x["known"]).alias("known"),
            F.when(fresh, x["bad"]).otherwise(acc["bad"] + x["bad"]).alias("bad"),
            first.alias("first"),
            F.concat(acc["out"], F.array(F.struct(x["band"].alias("band"), first.alias("first")))).alias("out"),
        )

    first = bands.select(*node, F.inline(F.aggregate("bands", start, step, lambda acc: acc["out"])))
    member = apart.join(first, [*node, "band"]).select(*node, "segment", "first")
    name = F.when(F.col("n") == 1, F.col("least")).otherwise(F.concat(F.lit("{"), F.col("least"), F.lit("+"), F.col("n") - 1, F.lit("}")))
    cluster = member.groupBy(*node, "first").agg(F.min("segment").alias("least"), F.count("*").alias("n")).select(*node, "first", name.alias("kept"))
    return member.join(cluster, [*node, "first"]).select(*node, "segment", "kept")


def templates(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """rows (host, segments, y, ...) with the column template: the path with variable segments as `*`.

    Level by level, each node's children are counted. A child stands apart if it is frequent and its labelled rate of
    bad rows differs from its siblings' (two-proportion z test); those apart that are alike are merged with each other
    (`merge`), and their descendants count together. All other children are variable, or like the whole, and are merged into
    the wildcard. Counting pre-aggregates, so a host may hold any share of the rows; its size plays no part, so growth of
    its siblings alone merges no child. At most rows / SUPPORT children of a level stand apart, and where those are many the
    joins with them shuffle.
    """
    rows = rows.withColumn("template", F.lit(""))
    for level in range(depth):
        seg = F.get("segments", F.lit(level))
        here = rows.select("host", "template", "y", seg.alias("segment")).where("segment IS NOT NULL")
        child = here.groupBy("host", "template", "segment").agg(F.count("*").alias("n"), F.count("y").alias("known"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).where(F.col("n") >= SUPPORT)
        node = here.groupBy("host", "template").agg(F.count("*").alias("all_n"), F.count("y").alias("all_known"), F.coalesce(F.sum("y"), F.lit(0)).alias("all_bad"))
        rest_known, rest_bad = F.col("all_known") - F.col("known"), F.col("all_bad") - F.col("bad")
        apart = (
            child.join(node, ["host", "template"])
            .where((F.col("known") > 0) & (rest_known > 0) & unlike(F.col("known"), F.col("bad"), rest_known, rest_bad))
            .select("host", "template", "segment", "known", "bad")
        )
        apart = common.cut(apart, "branches")
        if apart.isEmpty():
            rows = rows.withColumn("template", F.when(seg.isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/*"))))
            continue
        apart = common.broadcast_if_small(common.cut(merge(apart), "clusters"))
        rows = rows.withColumn("segment", seg).alias("r").join(
            apart.alias("k"), (F.col("r.host") == F.col("k.host")) & (F.col("r.template") == F.col("k.template")) & (F.col("r.segment") == F.col("k.segment")), "left"
        ).select(
            *[F.col(f"r.{c}") for c in rows.columns if c != "template"],
            F.when(F.col("r.segment").isNull(), F.col("r.template")).otherwise(F.concat(F.col("r.template"), F.lit("/"), F.coalesce("k.kept", F.lit("*")))).alias("template"),
        )
    return rows.withColumn("template", F.when(F.size("segments") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], depth: int = DEPTH) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row of pages (page_id, url, label_id).

    labels has (label_id, y), y 1 for a bad page; a page without a label counts for its template but not for
    the purity. The rate of bad rows is smoothed from the whole table to the host to the template; a template is
    blocked at REJECT or more, and its purity is the smoothed rate of its verdict. Null urls and urls without `://`
    have an empty host and path and share one template. Repeated rows repeat, repeated labels count once (the
    worst), null labels never. An empty table gives no rows; without labels all is allowed. Other columns are ignored.
    """
    known = labels.where("label_id IS NOT NULL AND y IS NOT NULL").groupBy("label_id").agg(F.max("y").alias("y"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label_id").join(known, "label_id", "left").drop("label_id")
    rows = rows.withColumn("segments", F.filter(F.split("path", "/", -1), lambda s: s != ""))
    rows = common.cut(templates(common.cut(rows, "urls"), depth), "templates")
    count = [F.count("y").alias("known"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")]
    by = rows.groupBy("host", "template").agg(*count)
    whole = rows.agg(*count).first()
    prior = (whole["bad"] + 1) / (whole["known"] + 2) if whole["known"] else 0.0
    host = by.groupBy("host").agg(((F.sum("bad") + SMOOTH * prior) / (F.sum("known") + SMOOTH)).alias("host_rate"))
    judged = by.join(host, "host").select(
        F.col("host").alias("_host"), F.col("template").alias("_template"), ((F.col("bad") + SMOOTH * F.col("host_rate")) / (F.col("known") + SMOOTH)).alias("rate")
    )
    judged = common.broadcast_if_small(common.cut(judged, "judged"))
    hit = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("rate") >= REJECT, "block").otherwise("allow")
    return rows.join(judged, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template"))).select(
        "page_id", "host", "path", hit["rule"].alias("rule"), F.coalesce(hit["action"], method).alias("verdict"), "template", F.greatest("rate", 1 - F.col("rate")).alias("purity")
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; the label is that of the document whose number the path names, bad if of low quality or toxic."""
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url", F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS bigint)").alias("label_id"))
    labels = common.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("y"))
    return judge(pages, labels, RULES)
