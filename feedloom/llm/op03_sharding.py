"""Sharding by a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VIRTUAL_NODES = 256
#: Leading bits of a ring position that the range lookup joins on.
CELL_BITS = 12
LAW = "rows"


def _ring(shards: int, virtual: int) -> tuple[list[int], list[int]]:
    """The 64-bit hash positions of the virtual nodes, clockwise, and their owners. A node keeps its place at any shard count."""
    import hashlib

    nodes = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s) for s in range(shards) for v in range(virtual))
    return [p for p, _ in nodes], [s for _, s in nodes]


def arc_ranges(positions: list[int]) -> list[dict]:
    """[{cell, after, upto, arc}]: a position of the cell (its top CELL_BITS) in (after, upto] is of the arc that ends at node `arc`.

    Arcs are split at the cells' bounds, so that a lookup is an equi-join on the cell with one or a few rows each.
    """
    width, out = 1 << (64 - CELL_BITS), []
    low = -(1 << 63) - 1
    for arc, at in [*enumerate(positions), (0, (1 << 63) - 1)]:  # past the last node comes the first
        while low < at:
            cell = (low + 1) // width
            upto = min(at, (cell + 1) * width - 1)
            # the lowest position has none before it in 64 bits: `after` is then null
            out.append({"cell": cell, "after": low if low >= -(1 << 63) else None, "upto": upto, "arc": arc})
            low = upto
    return out


def plan_ring(counts: dict[int, int], owners: list[int], shards: int) -> list[dict]:
    """Where each run of an arc's rows goes: [{arc, lo, hi, shard, base}], rows lo..hi-1 get slots base...

    Every shard holds floor(n / shards) rows, the first n mod shards one more. Rows wait at their own arc; its
    owner takes what fits, the rest goes on to the next arc, until none waits. Work and memory depend on
    the ring's size, not on the rows.
    """
    n, arcs = sum(counts.values()), len(owners)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    taken, out = [0] * shards, []
    waiting: dict[int, list[tuple[int, int, int]]] = {a: [(a, 0, c)] for a, c in counts.items() if c}
    while waiting:
        onward: dict[int, list[tuple[int, int, int]]] = {}
        for a in sorted(waiting):
            s = owners[a]
            for arc, lo, hi in waiting[a]:
                fit = min(hi - lo, room[s] - taken[s])
                if fit:
                    out.append({"arc": arc, "lo": lo, "hi": lo + fit, "shard": s, "base": taken[s]})
                    taken[s] += fit
                if lo + fit < hi:
                    onward.setdefault((a + 1) % arcs, []).append((arc, lo + fit, hi))
        waiting = onward
    return out


def shard(df: DataFrame, id_col: str, text_col: str, shards: int = 40, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """One row per row of df: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `rows`).

    A row's place on the ring is a hash of its id, size and text checksum; the next virtual node clockwise owns it. Counts
    of any two shards differ by one at most, so what a full shard has no room for goes on clockwise. With a shard more, the
    rows of the new shard's arcs move and some of those that overflow. Nulls: a null text has size 16 and checksum 0; a null id is a key like any other. Repeated
    rows are counted before they are moved, then dealt out one by one: they take neighbouring slots. An empty
    table gives no rows. Other columns of df are ignored, whatever their names.
    """
    if shards < 1 or virtual < 1:
        raise ValueError("shards and virtual must be positive")
    positions, owners = _ring(shards, virtual)
    ring = common.local_rows(df.sparkSession, arc_ranges(positions), "cell:int,after:long,upto:long,arc:int")
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    keys = (
        df.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("n"))
        .withColumn("pos", F.xxhash64("doc_id", "size", "text_crc32"))
        .withColumn("cell", F.shiftright("pos", 64 - CELL_BITS).cast("int"))
        .join(F.broadcast(ring), "cell")  # at most 2**CELL_BITS rows more than the ring has nodes
        .where("pos <= upto AND (after IS NULL OR pos > after)")
        .select("doc_id", "size", "text_crc32", "n", "pos", "arc")
    )
    keys = common.cut(keys, "ring")
    counts = {r["arc"]: r["n"] for r in keys.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # one row per arc at most
    runs = plan_ring(counts, owners, shards)
    plan = common.local_rows(df.sparkSession, runs, "arc:int,lo:long,hi:long,shard:int,base:long")
    before = "coalesce(sum(n) OVER (PARTITION BY arc ORDER BY pos, doc_id, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    ranked = keys.withColumn("first", F.expr(before))
    alone = ranked.where("n = 1").select("doc_id", "size", "text_crc32", "arc", F.col("first").alias("rank"))
    # copies: pieces of 4096 first, so that a huge group is dealt out by many tasks
    pieces = ranked.where("n > 1").select("doc_id", "size", "text_crc32", "arc", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 4096"))).alias("piece")).repartition("piece", "doc_id")
    copies = pieces.select("doc_id", "size", "text_crc32", "arc", F.explode(F.sequence(F.expr("first + piece * 4096"), F.expr("first + least(n, piece * 4096 + 4096) - 1"))).alias("rank"))
    return (
        alone.unionByName(copies)
        .join(F.broadcast(plan), "arc")  # at most a few rows per arc of the fixed ring
        .where("rank >= lo AND rank < hi")
        .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.read(spark, sf_dir, "documents"), "doc_id", "text", 40)
