"""N-gram Jaccard join by vertical partitioning.

The global order of the shingles is that of their 64-bit hashes. Cutting this order into fragments cuts every
document's sorted set into segments. Two uses of the fragments:

* Candidates. Two sets with Jaccard t differ in few shingles for their sizes. Cut into a fourth more fragments than that,
  they agree in a fifth of their segments at least. So only documents with that many equal segments are ever compared: this
  is exact, and a passage that many documents share makes no candidates unless it fills segments.
* Counting. For two sets that may link, the overlaps of the segments of each fragment are counted apart and summed per pair.

Only components are wanted, so rows stay in proportion to documents: equal sets are one node; each node is compared with the
likely centre of its group (minhash votes); then nodes of different components that may still link are brought together
and counted block by block, and only edges of a spanning forest leave a block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SALTS = common.mix64(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
#: Fragments in which overlaps are counted, a power of two.
FRAGMENTS = 4
#: Wide keys that are broadcast at most (beyond, their holders are found by a shuffle join).
KEYS = 2_000_000
#: Holders of a key whose pairs are counted key by key; keys of more are wide.
FEW = 16
#: Holders and sketch bytes of a block of a wide key, shingles of a block of a group, followers of one copy of a centre.
HOLDERS, SKETCHES, SHINGLES, FOLLOWERS = 8192, 1 << 24, 1_000_000, 2000
#: Keys in a packed row; keys that one look-up in a task handles at a time, about.
ROW, LOOKUP = 64, 200_000
#: Text bytes that are shingled at once.
SLICE = 1 << 21
#: Stands for a null id; it sorts last.
NO_ID = (1 << 63) - 1


def band_starts(percent: int, upto: int) -> list[int]:
    """Sizes at which bands start: a set's partner is in its band or a neighbouring one."""
    out = [1]
    while out[-1] <= upto:
        out.append(100 * out[-1] // percent + 1)
    return out


def allowance(a, b, percent: int):
    """Most shingles that sets of a and b shingles may differ in."""
    return (100 - percent) * (a + b) // (100 + percent)


class Schemes:
    """The fragments of each pair of neighbouring bands.

    In a scheme of f fragments, linked sets have at least t = least() segments equal. Each set leaves out keys of at most
    spare = (t - 1) // 3 empty segments and of as many wide ones, those last in an order of all keys. Then a linked pair
    still shares an empty or a wide key, or has least(a, b) - 2 * spare others in common.
    """

    def __init__(self, percent: int):
        self.percent, self.starts = percent, band_starts(percent, 1 << 20)

    def of(self, n: int) -> list[tuple[int, int]]:
        """(scheme, fragments) for a set of n shingles: as the smaller of a pair, and as the larger."""
        while self.starts[-1] <= n:
            self.starts.append(100 * self.starts[-1] // self.percent + 1)
        b = int(np.searchsorted(self.starts, n, "right")) - 1
        return [(j, self.fragments(j)) for j in (b, b + 1) if j]  # scheme j: the smaller set is of band j - 1

    def most(self, j: int) -> int:
        small = self.starts[j] - 1
        return int(allowance(small, 100 * small // self.percent, self.percent))

    def fragments(self, j: int) -> int:
        """More than the sets of a pair may differ in, by a fourth: that many segments at least are equal."""
        return self.most(j) + self.most(j) // 4 + 1

    def spare(self, j: int) -> int:
        return (self.most(j) // 4) // 3

    def least(self, a: int, b: int) -> int:
        """Keys of few holders that linked sets of a and b shingles share, unless they share an empty or a wide one."""
        self.of(min(a, b))
        j = int(np.searchsorted(self.starts, min(a, b), "right"))
        return self.fragments(j) - int(allowance(a, b, self.percent)) - 2 * self.spare(j)

    def keys(self, h: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """For each scheme a 64-bit key for each fragment (equal segments have equal keys), and the spare."""
        u, total = common.U, np.zeros(len(h) + 1, common.U)
        np.cumsum(common.mix64(h), out=total[1:])
        out, spare = [], []
        for j, parts in self.of(len(h)):
            f = np.arange(parts, dtype=u)
            at = np.concatenate([[0], np.searchsorted(((h >> u(32)) * u(parts)) >> u(32), f, "right")])
            key = common.mix64(np.diff(total[at]) + f * u(0x9E3779B97F4A7C15) + u(j * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
            left = np.flatnonzero(at[1:] == at[:-1])[::-1][: self.spare(j)]
            out.append(np.delete(key, left) if len(left) else key)
            spare.append(self.spare(j))
        return out, spare


def marks(h: np.ndarray, parts: int) -> np.ndarray:
    """A byte for each of the even parts (a power of two) of the hash order: sets that differ in d shingles differ in d bytes at most."""
    u, total = common.U, np.zeros(len(h) + 1, common.U)
    np.cumsum(common.mix64(h ^ common.U(0xAAAAAAAAAAAAAAAA)), out=total[1:])
    at = np.searchsorted(h >> u(64 - parts.bit_length() + 1), np.arange(parts, dtype=u), "right")
    return (np.diff(total[np.concatenate([[0], at])]) & u(255)).astype(np.uint8)


def width(n: int, percent: int, times: int) -> int:
    return 1 << max(4, int(times * allowance(n, n, percent)).bit_length())


def sketch(h: np.ndarray, percent: int) -> bytes:
    """marks at four bits each, about two parts a shingle that may differ. Adding neighbouring parts halves a sketch."""
    x = marks(h, width(len(h), percent, 2)) & 15
    return (x[::2] | x[1::2] << 4).tobytes()


def opened(packed: bytes, parts: int) -> np.ndarray:
    """A sketch's numbers, halved to parts of them."""
    x = np.frombuffer(packed, np.uint8)
    x = np.stack([x & 15, x >> 4], 1).ravel()
    while len(x) > parts:
        x = (x[::2] + x[1::2]) & 15
    return x


def _sets(column, k: int):
    data, offsets = common.text_buffers(column)
    for _, h, at in common.doc_words(data, offsets):
        for a, b in zip(at[:-1], at[1:]):
            yield common.shingles(h[a:b], k)


def _slices(batch, text: int):
    """Slices of a batch with about SLICE bytes of text."""
    _, offsets = common.text_buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1, at + 1)
        yield batch.slice(at, min(end, batch.num_rows) - at)
        at = end


def _mark(text: str = "text") -> Column:
    """With the id, what a row of docs is known by: rows equal in both are repeats of one document."""
    return F.xxhash64(text)


def fingerprints(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, t, n, s1, s2, m0..m7, sketch) of every row: text mark, size, set hash of 128 bits, minhashes."""
    names = ["doc_id", "t", "n", "s1", "s2", *[f"m{i}" for i in range(len(SALTS))], "sketch"]

    def work(batches):
        import pyarrow as pa

        u = common.U
        for whole in batches:
            for batch in _slices(whole, 2):
                n, s, m, packed = [], [], [], []
                for h in _sets(batch.column(2), k):
                    n.append(len(h))
                    if len(h):
                        x = common.mix64(h)
                        s.append((x.sum(dtype=u), common.mix64(x ^ u(0x5555555555555555)).sum(dtype=u)))
                        m.append([(a * h).min() for a in SALTS])
                        packed.append(sketch(h, percent))
                    else:
                        s.append((0, 0))
                        m.append(np.zeros(len(SALTS), u))
                        packed.append(b"")
                s, m = np.array(s, u).reshape(-1, 2).view(np.int64), np.array(m, u).reshape(-1, len(SALTS)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in (*s.T, *m.T)], pa.array(packed, pa.binary())], names=names)

    longs = ", ".join(f"{c} long" for c in names[:-1])
    return common.arrow_map(docs.select("doc_id", "t", "text"), work, f"{longs}, sketch binary")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (x, y) of pairs whose sketches (node, n, sketch) don't differ too much: no linked pair is lost."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"k_{c}"))
    both = pairs.join(side("y"), "y").join(side("x"), "x").where(100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = []
            for a, b, most in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), allowance(n, 0, percent)):
                parts = 2 * min(len(a), len(b))
                keep.append(int((opened(a, parts) != opened(b, parts)).sum()) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return common.arrow_map(both.select("x", "y", "n_x", "n_y", "k_x", "k_y"), work, "x long, y long")


def _votes(nodes: DataFrame) -> DataFrame:
    """Pairs (x, y): each node y that shares a minhash with others, and the node x that most of them share theirs with.

    A minhash may be that of any share of the nodes: counts and centres pre-aggregate and are written, so that the joins with
    them broadcast or, beyond that size, have two plain sides, of which Spark splits a skewed one.
    """
    pairs = F.explode(F.array(*[F.xxhash64(F.lit(i), f"m{i}") for i in range(len(SALTS))]))
    each = nodes.select("node", pairs.alias("m"))
    shared = common.cut(each.groupBy("m").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    each = common.cut(each.join(common.broadcast_if_small(shared), "m"), "votes")
    weight = common.cut(each.groupBy("node").agg(F.sum("c").alias("w")), "weights")
    each = common.cut(each.join(weight, "node").select("m", "node", "w"), "votes")
    lead = each.groupBy("m").agg(F.max(F.struct("w", (-F.col("node")).alias("x"))).alias("best")).select("m", (-F.col("best.x")).alias("x"))
    votes = each.join(common.broadcast_if_small(common.cut(lead, "centres")), "m").where("x <> node").groupBy("node", "x").agg(F.count("*").alias("v"))
    best = votes.groupBy("node").agg(F.max(F.struct("v", (-F.col("x")).alias("x"))).alias("best"))
    return best.select((-F.col("best.x")).alias("x"), F.col("node").alias("y"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of wanted (low, t, ...) but these two, with the text of the document of that id and mark. Repeated rows repeat."""
    rest = [c for c in wanted.columns if c not in ("low", "t")]
    return docs.join(common.broadcast_if_small(wanted.withColumnRenamed("low", "doc_id")), ["doc_id", "t"]).select(*rest, "text")


def _segments(texts: DataFrame, k: int) -> DataFrame:
    """texts' columns but text, then (v, n, segment): the hashes of each fragment of the texts' sets."""
    rest = [f for f in texts.schema.fields if f.name != "text"]

    def work(batches):
        import pyarrow as pa

        for whole in batches:
            for part in _slices(whole, len(rest)):
                row, v, n, values, ends = [], [], [], [], [0]
                for i, h in enumerate(_sets(part.column(len(rest)), k)):
                    for f, piece in enumerate(_fragments(h)):
                        if len(piece):
                            row.append(i)
                            v.append(f)
                            n.append(len(h))
                            values.append(piece)
                            ends.append(ends[-1] + len(piece))
                flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i).take(take) for i in range(len(rest))], pa.array(v, pa.int32()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=[*[f.name for f in rest], "v", "n", "segment"],
                )

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rest)
    return common.arrow_map(texts.select(*[f.name for f in rest], "text"), work, f"{head}v int, n long, segment array<long>")


def _fragments(h: np.ndarray) -> list[np.ndarray]:
    return np.split(h, np.searchsorted(h, np.arange(1, FRAGMENTS, dtype=common.U) * common.U((1 << 64) // FRAGMENTS)))


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (x, y) of pairs with 100 * intersection >= percent * union: partial overlaps by fragment, summed per pair.

    y is moved once per pair; x, a centre, once for every FOLLOWERS of its pairs, so no key of the join is hot.
    """
    known = nodes.select("node", "low", "t")
    hot = common.cut(pairs.groupBy("x").agg(F.count("*").alias("c")), "centres").select("x", F.ceil(F.col("c") / FOLLOWERS).cast("int").alias("copies"))
    salted = pairs.join(common.broadcast_if_small(hot.where("copies > 1")), "x", "left").select("x", "y", F.pmod(F.xxhash64("y"), F.coalesce("copies", F.lit(1))).cast("int").alias("salt"))
    ask = common.cut(salted.join(known.withColumnRenamed("node", "y"), "y"), "pairs")
    lead = common.cut(hot.join(known.withColumnRenamed("node", "x"), "x"), "centres")
    one = _segments(_texts(docs, ask), k).select("x", "salt", "v", "y", F.col("n").alias("n_y"), F.col("segment").alias("s_y"))
    two = _segments(_texts(docs, lead), k).select("x", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), "v", F.col("n").alias("n_x"), F.col("segment").alias("s_x"))
    part = one.join(two, ["x", "salt", "v"]).select("x", "y", "v", "n_x", "n_y", F.size(F.array_intersect("s_x", "s_y")).alias("common"))
    # rows of a repeated document count once
    total = part.groupBy("x", "y", "n_x", "n_y").agg(*[F.max(F.when(F.col("v") == f, F.col("common"))).alias(f"c{f}") for f in range(FRAGMENTS)])
    overlap = sum((F.coalesce(f"c{f}", F.lit(0)) for f in range(FRAGMENTS)), F.lit(0))
    return total.where(100 * overlap >= percent * (F.col("n_x") + F.col("n_y") - overlap)).select("x", "y")


class Sweep:
    """Finds a spanning forest of the pairs of some sets that may link or, with their hashes, that do.

    n must rise. Pairs of one component or, given sides, of one side are left out.
    """

    def __init__(self, n: np.ndarray, comp: np.ndarray, mark: np.ndarray, percent: int, side: np.ndarray | None = None, sets: list | None = None):
        self.n, self.comp, self.mark, self.percent, self.side = n, comp, mark, percent, side
        self.parts = [_fragments(h) for h in sets] if sets is not None else None

    def edges(self) -> list[tuple[int, int]]:
        n, comp, mark, out = self.n, self.comp, self.mark, []
        label = np.unique(comp, return_inverse=True)[1] if self.parts is not None else np.arange(len(n))
        upto = np.searchsorted(n, 100 * n // self.percent, "right")
        for q in range(len(n) - 1):
            other = np.arange(q + 1, upto[q])
            good = (label[other] != label[q]) & (comp[other] != comp[q])
            if self.side is not None:
                good &= self.side[other] != self.side[q]
            other = other[good]
            if not len(other):
                continue
            other = other[(mark[other] != mark[q]).sum(1) <= allowance(n[other], n[q], self.percent)]
            for x in other:
                if label[x] != label[q] and (self.parts is None or self.linked(q, x)):
                    out.append((q, int(x)))
                    label[label == label[x]] = label[q]
        return out

    def linked(self, a: int, b: int) -> bool:
        """Partial overlaps fragment by fragment, summed; given up once the rest can't reach the bound."""
        x, y, both = self.parts[a], self.parts[b], int(self.n[a] + self.n[b])
        need = -(-self.percent * both // (100 + self.percent))
        rest, total = sum(min(len(p), len(q)) for p, q in zip(x, y)), 0
        for p, q in zip(x, y):
            rest -= min(len(p), len(q))
            if len(p) and len(q):
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                total += int((q[at] == p).sum())
            if total + rest < need:
                return False
        return 100 * total >= self.percent * (both - total)


def _keyed(batch, k: int, schemes: Schemes):
    """Nodes, sizes, components, all keys, and each key's row, scheme (numbered through) and spare, for (node, component, text)."""
    n, keys, own, group, spare, g = [], [], [], [], [], 0
    for i, h in enumerate(_sets(batch.column(2), k)):
        n.append(len(h))
        if len(h):
            for key, s in zip(*schemes.keys(h)):
                keys.append(key)
                own.append(np.full(len(key), i))
                group.append(np.full(len(key), g))
                spare.append(np.full(len(key), s))
                g += 1
    ids, comp = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, common.U), (own, np.int64), (group, np.int64), (spare, np.int64))]
    return ids, np.array(n, np.int64), comp, *flat


LOW = np.uint64((1 << 48) - 1)


def _shared_keys(rest: DataFrame, shingles: int, k: int, percent: int) -> DataFrame:
    """Rows (kind, key, doc, n, comp): (1, key, holders) of wide keys, (2, a, b, n_a, n_b) for each pair and key of few holders.

    rest: (node, component, text). Keys go to their range p in packed rows. Of a piece of work's holders of a key, one of each
    component goes, marked if there were more; a key is wide if components share it and one was marked, or many do.
    """
    spark = rest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rate = 5 * (100 - percent) / (100 + percent)  # keys a shingle
    spread = min(max(8 * parts, int(rate * shingles / LOOKUP)), 1 << 31)

    def pack(batches):
        import pyarrow as pa

        u, schemes = common.U, Schemes(percent)
        kinds = [pa.int32()] + [pa.binary()] * 5
        for whole in batches:
            for batch in _slices(whole, 2):
                doc, n, comp, key, row, _, _ = _keyed(batch, k, schemes)
                if not len(key):
                    continue
                order = np.lexsort((comp[row], key))
                key, row = key[order], row[order]
                same = np.zeros(len(key), bool)
                same[1:] = (key[1:] == key[:-1]) & (comp[row[1:]] == comp[row[:-1]])
                more = np.zeros(len(key), bool)
                more[:-1] = same[1:] & (doc[row[1:]] != doc[row[:-1]])
                more = np.logical_or.reduceat(more, np.flatnonzero(~same))
                key, row = key[~same], row[~same]
                p = ((key >> u(32)) * u(spread)) >> u(32)  # rises with the key
                new = np.concatenate([[True], p[1:] != p[:-1]])
                start = np.flatnonzero(new)
                place = np.arange(len(p)) - np.repeat(start, np.diff(np.append(start, len(p))))
                lo = np.flatnonzero(place % ROW == 0)
                hi = np.append(lo[1:], len(p))
                six = np.ascontiguousarray((key & LOW).view(np.uint8).reshape(-1, 8)[:, :6])
                d, c, m = doc[row], comp[row] - doc[row], n[row]
                out = [(int(p[a]), six[a:b].tobytes(), d[a:b].tobytes(), c[a:b].tobytes(), m[a:b].astype(np.uint32).tobytes(), more[a:b].tobytes()) for a, b in zip(lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["p", "k", "d", "c", "n", "m"])

    def find(rows):
        six = np.concatenate([r[0] for r in rows])
        key = np.zeros((len(six) // 6, 8), np.uint8)
        key[:, :6] = six.reshape(-1, 6)
        key = key.view(np.int64).ravel()
        doc, comp, n, more = (np.concatenate([r[i].view(t) for r in rows]) for i, t in ((1, np.int64), (2, np.int64), (3, np.uint32), (4, bool)))
        comp = doc + comp
        order = np.lexsort((doc, comp, key))
        key, doc, comp, n, more = key[order], doc[order], comp[order], n[order].astype(np.int64), more[order]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])  # a repeated document holds a key once
        more = np.logical_or.reduceat(more, np.flatnonzero(once))
        key, doc, comp, n = key[once], doc[once], comp[once], n[once]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        shared = comp[first] != comp[first + size - 1]
        wide = shared & (np.logical_or.reduceat(more, first) | (size > FEW))
        none = np.zeros(int(wide.sum()), np.int64)
        yield none + 1, key[first[wide]], size[wide], none, none
        few = np.repeat(shared & ~wide, size)
        key, doc, comp, n = key[few], doc[few], comp[few], n[few]
        for step in range(1, FEW):
            # each holder with the one `step` places on, where both are of one key
            x = np.flatnonzero((key[: len(key) - step] == key[step:]) & (comp[: len(key) - step] != comp[step:])) if len(key) > step else np.zeros(0, np.int64)
            x = x[100 * np.minimum(n[x], n[x + step]) >= percent * np.maximum(n[x], n[x + step])]
            if len(x):
                swap = doc[x] > doc[x + step]
                p, q = np.where(swap, x + step, x), np.where(swap, x, x + step)
                yield np.full(len(x), 2), doc[p], doc[q], n[p], n[q]

    def match(batches):
        import pyarrow as pa

        def blocks():
            at, rows = None, []
            for batch in batches:
                p = batch.column(0).to_numpy()
                cuts = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1, [len(p)]])
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if p[a] != at and rows:
                        yield from find(rows)
                        rows = []
                    at = p[a]
                    rows.append([_joined(batch.column(i).slice(a, b - a)) for i in range(1, 6)])
            if rows:
                yield from find(rows)

        for kind, *rest in blocks():
            if len(kind):
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *[pa.array(x, pa.int64()) for x in rest]], names=["kind", "key", "doc", "n", "comp"])

    packed = common.arrow_map(rest, pack, "p int, k binary, d binary, c binary, n binary, m binary")
    packed = packed.repartition(parts, "p").sortWithinPartitions("p")
    return common.cut(common.arrow_map(packed, match, "kind int, key long, doc long, n long, comp long"), "keys")


def _joined(column) -> np.ndarray:
    """A copy of all bytes of a binary Arrow column."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy()


def _holders(rest: DataFrame, wide: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, node, n, comp) of the holders of wide keys (key, c); of each scheme the `spare` keys of most holders are left out."""
    asked = wide.count()
    sought = None
    if asked <= KEYS:
        got = wide.toPandas().sort_values("key")  # KEYS rows at most
        sought = rest.sparkSession.sparkContext.broadcast((got["key"].to_numpy(np.int64), got["c"].to_numpy(np.int64)))

    def look(batches):
        import pyarrow as pa

        schemes = Schemes(percent)
        for whole in batches:
            for batch in _slices(whole, 2):
                doc, n, comp, key, row, group, spare = _keyed(batch, k, schemes)
                key = (key & LOW).astype(np.int64)
                if sought is not None:
                    known, count = sought.value
                    at = np.searchsorted(known, key)
                    at[at == len(known)] = 0
                    hit = np.flatnonzero(known[at] == key) if len(known) else np.zeros(0, np.int64)
                    hit = hit[np.lexsort((key[hit], count[at[hit]], group[hit]))]
                    last = np.flatnonzero(np.append(group[hit][1:] != group[hit][:-1], True))
                    behind = np.repeat(last, np.diff(np.concatenate([[-1], last]))) - np.arange(len(hit))  # keys of more holders
                    hit = hit[behind >= spare[hit]]
                    key, row = key[hit], row[hit]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc[row], n[row], comp[row])], names=["key", "node", "n", "comp"])

    found = common.arrow_map(rest, look, "key long, node long, n long, comp long")
    if sought is None:
        found = common.cut(found, "all").join(wide.select("key"), "key", "left_semi")
    return common.cut(found.dropDuplicates(["key", "node"]), "holders")


def _blocks(b: Column, node: Column) -> Column:
    """Of b blocks, the pairs (i, j) that a node goes to, and its own block."""
    own = F.pmod(F.xxhash64(node), b).cast("int")
    return F.transform(F.sequence(F.lit(0), b - 1), lambda i: F.struct(F.least(i, own).alias("i"), F.greatest(i, own).alias("j"), own.alias("own")))


def _by_block(batches, width: int):
    """The rows of each run of equal first three columns, as lists of the columns after these."""
    at, rows = None, []
    for batch in batches:
        for r in zip(*[batch.column(i).to_pylist() for i in range(width)]):
            if r[:3] != at and rows:
                yield at, list(zip(*rows))
                rows = []
            at = r[:3]
            rows.append(r[3:])
    if rows:
        yield at, list(zip(*rows))


def _candidates(rest: DataFrame, nodes: DataFrame, shingles: int, k: int, percent: int) -> DataFrame:
    """Edges (u, v) between nodes of different components: each pair that may link is joined by a path of them.

    Pairs of holders of keys of few are counted: linked sets share a part of their segments. Holders of wide keys are compared by
    sketches, block by block, and a block's edges are a spanning forest.
    """
    found = _shared_keys(rest, shingles, k, percent)
    counted = found.where("kind = 2").groupBy(F.col("key").alias("a"), F.col("doc").alias("b"), F.col("n").alias("n_a"), F.col("comp").alias("n_b")).agg(F.count("*").alias("c"))

    def enough(batches):
        import pyarrow as pa

        schemes = Schemes(percent)
        for batch in batches:
            a, b, c = (batch.column(i).to_pylist() for i in (2, 3, 4))
            keep = [z >= schemes.least(x, y) for x, y, z in zip(a, b, c)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    few = common.arrow_map(counted, enough, "u long, v long")
    wide = common.cut(found.where("kind = 1").groupBy("key").agg(F.max("doc").alias("c")), "wide")
    if not wide.limit(1).count():
        return few
    held = _holders(rest, wide, k, percent).join(nodes.select("node", "sketch"), "node")
    held = common.cut(held.select("key", "node", "n", "comp", "sketch"), "holders")
    size = held.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.octet_length("sketch")).alias("s"))
    large = size.select("key", F.ceil(F.greatest(F.col("c") / HOLDERS, F.col("s") / SKETCHES)).cast("int").alias("b")).where("b > 1")
    large = common.broadcast_if_small(common.cut(large, "large"))
    work = held.join(large, "key", "left").select("key", F.explode(_blocks(F.coalesce("b", F.lit(1)), F.col("node"))).alias("t"), "n", "comp", "node", "sketch")
    work = work.select("key", "t.i", "t.j", "t.own", "n", "comp", "node", "sketch")

    def compare(batches):
        import pyarrow as pa

        for (_, i, j), cols in _by_block(batches, 8):
            own, n, comp, node = (np.array(x, np.int64) for x in cols[:4])
            parts = 2 * min(map(len, cols[4]))
            mark = np.stack([opened(x, parts) for x in cols[4]])
            got = np.array(Sweep(n, comp, mark, percent, own if i != j else None).edges(), np.int64).reshape(-1, 2)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(node[got[:, c]]) for c in (0, 1)], names=["u", "v"])

    spread = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.repartition(spread, "key", "i", "j").sortWithinPartitions("key", "i", "j", "n")
    return common.arrow_map(work, compare, "u long, v long").unionByName(few)


def _grouped(docs: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between nodes (with component) of different components that edges join: a spanning forest of them for each block.

    The texts of a group of nodes come together, in blocks of about SHINGLES shingles; a text is moved once, or once for
    each block of a larger group.
    """
    group = common.components(edges, "groups").withColumnRenamed("component", "g")
    members = common.cut(group.join(nodes.select("node", "component", "low", "t", "n"), "node"), "members")
    size = members.groupBy("g").agg(F.sum("n").alias("s")).select("g", F.ceil(F.col("s") / SHINGLES).cast("int").alias("b")).where("b > 1")
    large = common.broadcast_if_small(common.cut(size, "large"))
    work = members.join(large, "g", "left").select("low", "t", "g", F.coalesce("b", F.lit(1)).alias("b"), "n", "component", "node")
    work = _texts(docs, common.cut(work, "members"))
    work = work.select("g", F.explode(_blocks(F.col("b"), F.col("node"))).alias("t"), "n", "component", "node", "text").select("g", "t.i", "t.j", "t.own", "n", "component", "node", "text")

    def compare(batches):
        import pyarrow as pa

        for (_, i, j), cols in _by_block(sets(batches), 8):
            own, n, comp, node = (np.array(x, np.int64) for x in cols[:4])
            once = np.unique(node, return_index=True)[1]  # repeated rows are one node
            once = once[np.argsort(n[once], kind="stable")]
            own, n, comp, node = own[once], n[once], comp[once], node[once]
            if len(set(comp.tolist())) < 2:
                continue
            hashes = [np.frombuffer(cols[4][x], common.U) for x in once]
            mark = np.stack([marks(h, width(int(n[0]), percent, 8)) for h in hashes])
            got = np.array(Sweep(n, comp, mark, percent, own if i != j else None, hashes).edges(), np.int64).reshape(-1, 2)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(node[got[:, c]]) for c in (0, 1)], names=["u", "v"])

    def sets(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in _slices(whole, 7):
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array([h.tobytes() for h in _sets(batch.column(7), k)], pa.binary())], names=batch.schema.names)

    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.repartition(spread, "g", "i", "j").sortWithinPartitions("g", "i", "j")
    return common.arrow_map(work, compare, "u long, v long")


def grouped(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, n_shingles, component_id, leader) of every row: t marks the text (see _mark); leader says that the row's id
    and mark are the least of its component. A row without shingles leads itself. In doc_id and component_id, NO_ID stands for null."""
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("t", _mark())
    prints = common.cut(fingerprints(docs, k, percent), "prints")
    held = ["n", *[f"m{i}" for i in range(len(SALTS))], "sketch"]
    nodes = prints.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "t", *held)).alias("r"))
    nodes = nodes.select("s1", "s2", F.col("r.doc_id").alias("low"), *[f"r.{c}" for c in ("t", *held)], F.monotonically_increasing_id().alias("node"))
    nodes = common.cut(nodes, "nodes")
    votes = common.cut(plausible(common.cut(_votes(nodes), "votes"), nodes, percent), "votes")
    links = common.cut(verified(docs, nodes, votes, k, percent).select(F.col("x").alias("u"), F.col("y").alias("v")), "links")
    first = common.components(links, "first")
    placed = nodes.select("node", "low", "t", "n").join(common.broadcast_if_small(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = common.cut(placed, "placed")
    shingles = nodes.agg(F.sum("n")).first()[0] or 0
    rest = _texts(docs, placed.select("low", "t", "node", "component"))
    edges = common.cut(_candidates(rest, nodes.select("node", "sketch"), shingles, k, percent), "candidates")
    if edges.limit(1).count():
        more = common.cut(_grouped(docs, placed, edges, k, percent), "links")
        first = common.components(links.unionByName(more), "all")
    placed = placed.drop("component").join(common.broadcast_if_small(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = common.cut(placed.select("node", "low", "t", "component"), "placed")
    best = placed.groupBy("component").agg(F.min(F.struct("low", "t")).alias("best"))
    best = common.cut(best.select("component", F.col("best.low").alias("component_id"), F.col("best.t").alias("best_t")), "leaders")
    named = common.cut(nodes.select("node", "s1", "s2").join(placed.select("node", "component"), "node").join(best, "component").select("s1", "s2", "component_id", "best_t"), "named")
    linked = prints.where("n > 0").select("doc_id", "t", "n", "s1", "s2").join(named, ["s1", "s2"])
    leads = (F.col("doc_id") == F.col("component_id")) & (F.col("t") == F.col("best_t"))
    linked = linked.select("doc_id", "t", F.col("n").alias("n_shingles"), "component_id", leads.alias("leader"))
    alone = prints.where("n = 0").select("doc_id", "t", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("leader"))
    return linked.unionByName(alone)


def join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Words are runs of anything but [\\x20\\x09-\\x0D], A-Z lower-cased; a set holds the distinct k-word shingles, or the
    one of all words if there are fewer. Two documents link when 100 * intersection >= percent * union;
    component_id is the smallest id reachable, null only if no row of the component has an id. Null and empty texts have no
    shingles and no links. Equal sets always link. A row repeated gets the same result again; rows of one id with
    different texts, and rows without an id, are documents of their own. An empty table gives no rows; other columns are ignored.
    """
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return grouped(docs, k, percent, id_col, text_col).select(back("doc_id"), "n_shingles", back("component_id"))


def leaders(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id (without an id, last) and text mark.

    Of a row that is repeated one stays, too; rows without shingles (null and empty texts) all stay.
    """
    found = common.cut(grouped(docs, k, percent, id_col, text_col), "groups")
    names = ["_id", "_t"]
    marked = docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("_t", _mark(F.col(text_col).cast("string")))
    known = found.where("n_shingles > 0").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "leader")
    gone = common.cut(known.where("NOT leader").select(*names).distinct(), "gone")
    twice = common.cut(known.where("leader").groupBy(*names).agg(F.count("*").alias("c")).where("c > 1").select(*names), "repeated")
    kept = marked.join(common.broadcast_if_small(gone), names, "left_anti")
    if twice.limit(1).count():
        few = common.broadcast_if_small(twice)
        kept = kept.join(few, names, "left_anti").unionByName(kept.join(few, names, "left_semi").dropDuplicates(names))
    return kept.select(*docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.read(spark, sf_dir, "documents"), k=3, percent=90)
