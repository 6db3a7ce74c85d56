"""Benchmark decontamination by the q-gram lemma: counts in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Length of a q-gram in bytes; the longest piece of an item that is searched for and the step between pieces; edits a byte.
Q, PIECE, STEP, RATE = 8, 96, 48, 0.1
#: Bytes of benchmark text that one pass looks for; a larger benchmark takes more passes.
PASS_BYTES = 8 << 20
#: Bytes of document text worked on at once.
BLOCK = 1 << 19
TABLE = 1 << 22


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data with A-Z lower-cased and runs of white space as one space; and where each byte stood."""
    white = common._SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(white[1:] & white[:-1])
    at = np.flatnonzero(keep)
    out = common._FOLD[data[at]]
    out[white[at]] = 32
    return out, at


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each position, its Q = 8 bytes as a number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


class Index:
    """The q-grams of the benchmark's pieces.

    An occurrence of a piece of m bytes with e edits shares m + 1 - Q - Q * e q-grams with it, all within e
    diagonals. A piece's edits are as many as leave one q-gram. Items under Q bytes have none: they are in `short`.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.text, self.first, self.length, self.edits = [], [], [], [], []
        self.short: dict[bytes, list[int]] = {}
        base, seen = 0, []
        for item, text in items:
            raw, _ = normal(np.frombuffer((text or "").strip().encode(), np.uint8))
            m = len(raw)
            if m < Q:
                if m:
                    self.short.setdefault(raw.tobytes(), []).append(item)
                continue
            starts = [0] if m <= PIECE else sorted({*range(0, m - PIECE, STEP), m - PIECE})
            for s in starts:
                piece = raw[s : s + PIECE]
                self.item.append(item)
                self.text.append(piece.tobytes())
                self.first.append(base + s)
                self.length.append(len(piece))
                self.edits.append(min(int(RATE * len(piece)), (len(piece) - Q) // Q))
                seen.append((grams(piece), base + s, len(self.item) - 1))
            base += m + PIECE
        code = np.concatenate([g for g, _, _ in seen]) if seen else np.zeros(0, np.uint64)
        at = np.concatenate([np.arange(len(g)) + b for g, b, _ in seen]) if seen else np.zeros(0, np.int64)
        piece = np.concatenate([np.full(len(g), p) for g, _, p in seen]) if seen else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.at, self.piece = at[order], piece[order]
        self.code, self.start = np.unique(code[order], return_index=True)
        self.stop = np.append(self.start[1:], len(order))
        self.first, self.length, self.edits = (np.array(x, np.int64) for x in (self.first, self.length, self.edits))
        self.need = self.length + 1 - Q - Q * self.edits
        self.width = max(int(self.edits.max()), 1) if len(self.edits) else 1
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.slot(self.code)] = True

    @staticmethod
    def slot(code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def regions(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(piece, least diagonal of a band) whose shared q-grams meet the piece's bound."""
        code = grams(text)
        pos = np.flatnonzero(self.maybe[self.slot(code)])
        if not len(pos):
            return []
        k = np.searchsorted(self.code, code[pos])
        k[k == len(self.code)] = 0
        true = self.code[k] == code[pos]
        pos, k = pos[true], k[true]
        out = []
        count = self.stop[k] - self.start[k]
        ends = np.cumsum(count)
        lo = 0
        while lo < len(pos):  # pieces of work of bounded size; a band's hits are near each other, so pieces overlap
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2_000_000, "right")), lo + 1)
            back = max(int(np.searchsorted(pos, pos[lo] - 2 * PIECE)), 0)
            out += self._bands(pos[back:hi], k[back:hi], count[back:hi])
            lo = hi
        return out

    def _bands(self, pos, k, count):
        total = int(count.sum())
        skip = np.repeat(np.cumsum(count) - count, count)
        entry = np.repeat(self.start[k], count) + np.arange(total) - skip
        piece = self.piece[entry]
        diagonal = np.repeat(pos, count) - self.at[entry] + self.first[piece]  # where the piece would start
        # a match's hits lie in two neighbouring cells of 2 widths at most: with too few in both, none is in a dense band
        cell = (diagonal // (2 * self.width)).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slot = lambda x: ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(42)
        own = slot(cell).astype(np.int64)
        held, need = np.bincount(own, minlength=TABLE), self.need[piece]
        near = held[own]
        maybe = np.flatnonzero(2 * near >= need) if len(need) else np.zeros(0, np.int64)
        # cells with under half of the bound stay beside one that has the rest
        thin = np.flatnonzero(2 * near < need)
        side = np.maximum(*(held[slot(cell[thin] + np.uint64(d)).astype(np.int64)] for d in (0xD1B54A32D192ED03, (1 << 64) - 0xD1B54A32D192ED03))) if len(thin) else thin
        dense = np.sort(np.concatenate([maybe, thin[near[thin] + side >= need[thin]]]))
        piece, diagonal = piece[dense], diagonal[dense]
        if not len(piece):
            return []
        band = diagonal // self.width  # band j covers the diagonals from j to j + 2 widths
        low = int(band.min()) - 1
        key = np.concatenate([piece << 32 | band - low, piece << 32 | band - 1 - low])
        key, n = np.unique(key, return_counts=True)
        key = key[n >= self.need[key >> 32]]
        return [(k >> 32, ((k & 0xFFFFFFFF) + low) * self.width) for k in key.tolist()]


def align(piece: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of piece that starts in text within low..high, or None beyond `most` edits.

    Only diagonals from low - most to high + most are computed.
    """
    at = max(low, 0)
    exact = text.find(piece, at, max(high, 0) + len(piece))
    if exact >= 0:
        return 0, exact, exact + len(piece)
    m, base = len(piece), low - most
    width = high - low + 2 * most + 1
    t = np.full(m + width + 1, 256, np.int32)
    a, b = max(base, 0), min(base + m + width, len(text))
    if a >= b:
        return None
    t[a - base : b - base] = np.frombuffer(text[a:b], np.uint8)
    # cost[d]: row i of the piece against text base + i + d; begin[d]: where that match starts
    far = m + width + 9
    d = np.arange(width)
    cost = np.where((base + d >= 0) & (base + d <= len(text)), 0, far)
    begin = base + d
    for i in range(m):
        diag = cost + (t[i : i + width] != piece[i])
        gone = np.append(cost[1:] + 1, far)  # the piece's byte is missing in the text
        new = np.minimum(diag, gone)
        start = np.where(diag <= gone, begin, np.append(begin[1:], 0))
        run = new - d  # bytes of the text beside the piece
        reach = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == reach, d, 0))
        cost, begin = reach + d, start[source]
        if i % 8 == 7 and int(cost.min()) > most:
            return None
    end = base + m + d
    cost = np.where((end >= 0) & (end <= len(text)), cost, far)
    best = int(cost.argmin())
    if cost[best] > most:
        return None
    return int(cost[best]), int(begin[best]), int(end[best])


def _texts(data: np.ndarray, offsets: np.ndarray):
    """Yield (first row, normal text, raw place of each of its bytes, bounds of its rows, pieces found before).

    A text of more than 2 * BLOCK bytes comes in blocks of normal text that overlap by 2 * PIECE, more than any match.
    """
    i, n, over = 0, len(offsets) - 1, 2 * PIECE
    while i < n:
        j = min(max(int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1, i + 1), n)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * BLOCK:
            text, where = normal(data[lo:hi])
            yield i, text, where + lo, np.searchsorted(where, offsets[i : j + 1] - lo), set()
        else:
            text, where, done = np.zeros(0, np.uint8), np.zeros(0, np.int64), set()
            for a in range(lo, hi, BLOCK):
                more, at = normal(data[a : min(a + BLOCK, hi)])
                if len(more) and a > lo and common._SPACE[data[a]] and common._SPACE[data[a - 1]]:
                    more, at = more[1:], at[1:]  # a run of white space goes on
                text, where = np.concatenate([text[-over:], more]), np.concatenate([where[-over:], at + a])
                yield i, text, where, np.array([0, len(text)]), done
        i = j


def _search(index: Index, data: np.ndarray, offsets: np.ndarray):
    """Yield (row, item, start byte, end byte, edits, bytes compared) for each piece found, and for each short item."""
    for first, text, where, bounds, done in _texts(data, offsets):
        if len(text) < Q:
            continue
        raw = text.tobytes()
        for piece, low in index.regions(text):
            most = int(index.edits[piece])
            # a band may touch two texts: each is tried by itself
            r0 = max(int(np.searchsorted(bounds, max(low, 0), "right")) - 1, 0)
            r1 = max(int(np.searchsorted(bounds, low + 2 * index.width + int(index.length[piece]), "right")) - 1, 0)
            for r in range(r0, min(r1, len(bounds) - 2) + 1):
                s, e = int(bounds[r]), int(bounds[r + 1])
                if e - s < Q or (r, piece) in done:
                    continue
                left = max(s, low - PIECE)
                hit = align(index.text[piece], raw[left : min(e, low + 2 * index.width + 2 * PIECE)], low - left, low + 2 * index.width - left, most)
                if hit:
                    done.add((r, piece))
                    edits, x, y = hit
                    x, y = max(x, 0) + left, y + left
                    yield first + r, index.item[piece], int(where[x]), int(where[y - 1]) + 1, edits, int(index.length[piece])
    if index.short:
        for r in range(len(offsets) - 1):
            raw = data[offsets[r] : offsets[r + 1]].tobytes()
            bare = raw.strip(common.SPACES.encode())
            if bare and len(bare.translate(None, common.SPACES.encode())) < Q:
                a = int(offsets[r]) + raw.index(bare)
                for item in index.short.get(normal(np.frombuffer(bare, np.uint8))[0].tobytes(), ()):
                    yield r, item, a, a + len(bare), 0, len(bare)


def _passes(benchmark: DataFrame, item_col: str, item_text: str) -> list:
    """Broadcast lists of (item, text), PASS_BYTES of text each, about."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    parts = [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p) if passes > 1 else items for p in range(passes)]
    return [spark.sparkContext.broadcast(sorted((r["item"], r["text"]) for r in part.collect())) for part in parts]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits, matched) for each document and each benchmark item that it holds.

    An item counts as held if a piece of it (PIECE bytes at every STEP, or the whole of a shorter item) stands in the text with
    RATE edits a byte at most, letters of A-Z in either case and white space collapsed; an excerpt of PIECE + STEP bytes
    holds a piece wherever it starts. An item of under Q bytes is held by a text that is nothing else. start and end are code
    points around all pieces found, matched the bytes of these pieces, edits their edits. Clean documents have no row.
    Null and empty texts and items, and items without an id, match nothing; repeated rows repeat; empty tables give no rows.
    The benchmark's index is broadcast, PASS_BYTES of text at most: a larger benchmark takes several passes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for shared in _passes(benchmark, item_col, item_text):

        def work(batches, shared=shared):
            import pyarrow as pa

            index = Index(shared.value)
            for batch in batches:
                data, offsets = common.text_buffers(batch.column(1))
                best: dict[tuple[int, int], list[int]] = {}
                for row, item, a, b, edits, m in _search(index, data, offsets):
                    x = best.setdefault((row, item), [a, b, 0, 0])
                    x[0], x[1], x[2], x[3] = min(x[0], a), max(x[1], b), x[2] + edits, x[3] + m
                if not best:
                    continue
                rows = sorted(best)
                point = lambda r, b: int(((data[offsets[r] : b] & 0xC0) != 0x80).sum())
                cols = [[point(r, best[r, it][0]) for r, it in rows], [point(r, best[r, it][1]) for r, it in rows], [best[k][2] for k in rows], [best[k][3] for k in rows]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r for r, _ in rows])), *[pa.array(c, pa.int64()) for c in ([it for _, it in rows], *cols)]],
                    names=["doc_id", "item_id", "start", "end", "edits", "matched"],
                )

        found = common.arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), work, f"doc_id {kind}, item_id long, start long, end long, edits long, matched long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no item in the sense of find, each judged by its own text: ids play no part."""
    place, names = docs.columns.index(text_col), docs.columns
    for shared in _passes(benchmark, item_col, item_text):

        def work(batches, shared=shared):
            import pyarrow as pa

            index = Index(shared.value)
            for batch in batches:
                data, offsets = common.text_buffers(batch.column(place))
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in _search(index, data, offsets)]] = False
                yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(keep))

        docs = common.arrow_map(docs, work, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
