"""Embedding near-dedup: an exact range join in the chord metric of the unit sphere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Vectors that a cell aims at, pivots of all labels together at most, vectors of a side of one piece of work.
CELL, PIVOTS, BLOCK = 8192, 4096, 4096
#: Rows of a block's matrix that are worked on at once.
STRIP = 512


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(float) if raw else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(nodes: DataFrame, pivots: dict[tuple, tuple[np.ndarray, np.ndarray]], radius: float) -> DataFrame:
    """nodes with home, the cell of the nearest pivot, and cells, all those that may hold a vector within radius.

    w of cell j is nearer to pivot j than to v's pivot i. By the triangle inequality v is within radius of such a w only if
    d(v, j) - d(v, i) <= 2 * radius; and, sharper for chords, if v is within radius of the plane between i and j.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors at most

    def work(batches):
        import pyarrow as pa

        table = shared.value
        for batch in batches:
            kinds = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            raw = batch.column(4).to_pylist()
            home, cells = np.zeros(batch.num_rows, np.int32), [[0]] * batch.num_rows
            for kind in set(kinds) & table.keys():
                at = [i for i, k in enumerate(kinds) if k == kind]
                p, between = table[kind]
                d = np.sqrt(np.maximum(2 - 2 * (_unit([raw[i] for i in at]) @ p.T), 0))
                near = d.argmin(1)
                own = d[np.arange(len(at)), near][:, None]
                slack = radius + 1e-9
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d * d - own * own) / (2 * between[near])
                may = (d - own <= 2 * slack) & ~(plane > slack)
                may[np.arange(len(at)), near] = True
                for i, h, m in zip(at, near, may):
                    home[i] = h
                    cells[i] = np.flatnonzero(m).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "home", "cells"])

    return common.arrow_map(nodes, work, "label int, dim int, node long, c long, v binary, home int, cells array<int>")


def _compare(threshold: float):
    def work(group):
        """Rows (kind, a, b): 0, a node and the vectors that it links with here; 1, an edge of a spanning forest."""
        import pyarrow as pa

        role = group.column("role").to_numpy()
        node, c = group.column("node").to_numpy(), group.column("c").to_numpy()
        raw = group.column("v").combine_chunks().to_pylist()
        x = _unit(raw)
        left, right = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        strips = [slice(i, i + STRIP) for i in range(0, len(left), STRIP)]
        hit = np.zeros((len(left), len(right)), bool)
        for s in strips:
            hit[s] = (x[left[s]] @ x[right].T >= threshold) & (node[left[s]][:, None] != node[right][None, :])
        rows, cols = hit.any(1), hit.any(0)
        left, right, hit = left[rows], right[cols], hit[np.ix_(rows, cols)]
        links = hit @ c[right]
        # components of the two-sided graph of nodes, by least label
        names, at = np.unique(np.concatenate([node[left], node[right]]), return_inverse=True)
        i, j, label = at[: len(left)], at[len(left) :], np.arange(len(names), dtype=np.int32)
        big = np.int32(len(names))
        while len(names):
            new = label.copy()
            for s in strips[: -(-len(left) // STRIP)]:
                np.minimum.at(new, i[s], np.where(hit[s], label[j][None, :], big).min(1))
                np.minimum.at(new, j, np.where(hit[s], label[i[s]][:, None], big).min(0))
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        far = np.flatnonzero(label != np.arange(len(names)))
        kind = np.concatenate([np.zeros(len(left), np.int32), np.ones(len(far), np.int32)])
        a = np.concatenate([node[left], names[far]]).astype(np.int64)
        b = np.concatenate([links, names[label[far]]]).astype(np.int64)
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a), "b": pa.array(b)})

    return work


def dedup(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of df.

    Vectors link if their labels and lengths are equal and their cosine, in double precision, is threshold or more.
    n_links counts the other vectors linked with directly, component_id is the smallest id reachable, kept says that it is
    the row's own. Vectors that are null, zero, hold null or non-finite components or have no label or id link with
    nothing; without an id the component is null and the row is kept. Repeated rows, and several vectors of one id, are
    vectors of their own that share an id (equal ones link). An empty table gives no rows; other columns are ignored.

    Equal vectors are one node. Cells of more than BLOCK vectors are compared in blocks, so a piece of work has
    2 * BLOCK vectors at most, whatever the groups; only counts and spanning edges leave it.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = df.sparkSession
    vec = F.col(vec_col).cast("array<float>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), vec.alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    prints = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(3), F.reverse("v")).alias("h2")]

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            flat = [np.array(v, np.float32).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[3:], pa.array([len(v) // 4 for v in flat], pa.int32()), pa.array(flat, pa.binary())], names=["vec_id", "label", "h1", "h2", "dim", "v"])

    good = common.arrow_map(rows.where("ok").select("vec_id", "label", "v", *prints), pack, "vec_id long, label int, h1 long, h2 long, dim int, v binary")
    good = common.cut(good, "vectors")
    nodes = good.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("low"), F.count("*").alias("c"), F.min("v").alias("v"))
    nodes = common.cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # one id may have several vectors
    member = good.select("vec_id", "label", "dim", "h1", "h2").join(nodes.select("label", "dim", "h1", "h2", "node", "c"), ["label", "dim", "h1", "h2"]).select("vec_id", "node", "c")

    total = nodes.count()
    size = max(CELL, -(-2 * total // PIVOTS))
    many = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * size)  # PIVOTS / 4 rows at most
    drawn = nodes.join(F.broadcast(many), ["label", "dim"]).where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.expr(f"cast(1073741824.0 / {size} as bigint)"))
    found: dict[tuple, list] = {}
    for r in drawn.select("label", "dim", "node", "v").orderBy("node").limit(PIVOTS).collect():
        found.setdefault((r["label"], r["dim"]), []).append(bytes(r["v"]))
    pivots = {}
    for key, raw in found.items():
        p = _unit(raw)
        pivots[key] = (p, np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0)))
    placed = common.cut(_cells(nodes.select("label", "dim", "node", "c", "v"), pivots, float(np.sqrt(2 - 2 * threshold))), "cells")

    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    homes = placed.groupBy("label", "dim", F.col("home").alias("cell")).agg(F.count("*").alias("h"))
    guests = placed.select("label", "dim", F.explode("cells").alias("cell")).groupBy("label", "dim", "cell").agg(F.count("*").alias("g"))
    parts = common.broadcast_if_small(common.cut(homes.join(guests, ["label", "dim", "cell"]).select("label", "dim", "cell", blocks("h").alias("hb"), blocks("g").alias("gb")), "parts"))
    turn = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30))
    at = ["label", "dim", "cell"]
    side = placed.select("label", "dim", "node", "c", "v", "home", F.explode("cells").alias("cell")).join(parts, at)
    b, g = F.pmod(turn, F.col("hb")).cast("int"), F.pmod(turn, F.col("gb")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_guest = F.transform(every("hb"), lambda i: F.struct(i.alias("i"), g.alias("j"), F.when((F.col("cell") == F.col("home")) & (i == b), 3).otherwise(2).alias("role")))
    as_home = F.when(F.col("cell") == F.col("home"), F.filter(F.transform(every("gb"), lambda j: F.struct(b.alias("i"), j.alias("j"), F.lit(1).alias("role"))), lambda s: s["j"] != g)).otherwise(F.array().cast("array<struct<i:int,j:int,role:int>>"))
    work = side.select(*at, "node", "c", "v", F.explode(F.concat(as_guest, as_home)).alias("t")).select(*at, "t.i", "t.j", "t.role", "node", "c", "v")
    common.ship(spark)
    out = common.cut(work.groupBy(*at, "i", "j").applyInArrow(_compare(threshold), "kind int, a long, b long"), "links")

    links = out.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    comp = common.components(out.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")), "vectors")
    named = common.cut(nodes.select("node", "low").join(common.broadcast_if_small(comp), "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    least = common.cut(named.groupBy("component").agg(F.min("low").alias("component_id")), "least")
    named = common.cut(named.join(common.broadcast_if_small(least), "component").join(links, "node", "left").select("node", F.coalesce("links", F.lit(0)).alias("links"), "component_id"), "named")
    linked = member.join(common.broadcast_if_small(named), "node").select("vec_id", (F.col("c") - 1 + F.col("links")).alias("n_links"), "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.read(spark, sf_dir, "embeddings"))
