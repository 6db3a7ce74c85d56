"""Decontamination against a plain alignment of every piece, at borders of blocks, cells and bands."""

import random

import numpy as np
import pytest
from test_operators import prose

from feedloom.llm import op06_decontaminate as op6


def plain(piece: bytes, text: bytes) -> int:
    """Least edits of a match of piece anywhere in text (semi-global alignment by rows of numpy)."""
    t = np.frombuffer(text, np.uint8)
    row, step = np.zeros(len(t) + 1, int), np.arange(len(t) + 1)
    for c in piece:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def held(index: op6.Index, text: str) -> set:
    raw = op6.normal(np.frombuffer(text.encode(), np.uint8))[0].tobytes()
    return {index.item[p] for p in range(len(index.text)) if plain(index.text[p], raw) <= index.edits[p]}


def edited(r, text, n):
    b = list(text)
    for _ in range(n):
        at = r.randrange(len(b))
        kind = r.randrange(3)
        b[at : at + (kind != 1)] = [r.choice("qxz")] if kind < 2 else []
    return "".join(b)


def search(index, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    return list(op6._search(index, np.frombuffer(b"".join(raw), np.uint8), offsets))


def test_edits_near_the_budget():
    r = random.Random(6)
    items = [(i, prose(700 + i, 9 + i % 8)[: 20 + 12 * i]) for i in range(24)]
    index = op6.Index(items)
    texts = [prose(i, 20) + " " * (i % 3) + edited(r, items[i % 24][1], r.randrange(14)) + prose(i + 50, 20) for i in range(240)]
    want = {(i, item) for i, t in enumerate(texts) for item in held(index, t)}
    assert {(row, item) for row, item, *_ in search(index, texts)} == want
    assert 60 < len(want) < 230


@pytest.mark.parametrize("blanks", [0, 3000])
def test_borders_of_long_texts(blanks):
    items = [(i, prose(900 + i, 12)) for i in range(8)]
    index = op6.Index(items)
    filler = "".join(prose(i, 2000) + " " for i in range(110))
    for shift in (-150, -97, -60, -10, 0, 40):
        long = list(filler[: 2 * op6.BLOCK + 200_000])
        for i, (_, text) in enumerate(items[:3]):
            at = (i + 1) * (op6.BLOCK // 1) + shift
            long[at : at + 1] = " " + text.replace(" ", " " + " \n" * (blanks // 2)) + " "
        long = "".join(long)
        assert len(long) > 2 * op6.BLOCK
        found = search(index, [long, items[5][1]])
        by = {}
        for row, item, a, b, edits, m in found:
            assert edits == 0 and " ".join(long[a:b].split()) in items[item][1] or row == 1
            by[row, item] = by.get((row, item), 0) + m
        # no piece counts twice
        assert by == {(row, item): sum(len(t) for t, i in zip(index.text, index.item) if i == item) for row, item in ((0, 0), (0, 1), (0, 2), (1, 5))}


def test_short_items_and_rows(spark):
    bench = spark.createDataFrame([(1, "Yes no"), (2, "x"), (3, prose(5, 30)), (None, prose(6, 30)), (4, None), (5, "  ")], "item_id long, text string")
    rows = [(1, " yes \n NO "), (2, "yes no maybe"), (None, "X"), (None, prose(5, 30)), (4, None), (4, ""), (5, prose(6, 30)), (6, "x" * 9), (7, "a" + prose(5, 30) + "b"), (7, "a" + prose(5, 30) + "b")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, item_id int, edits string")
    got = sorted(((x["doc_id"] or 0, x["item_id"], x["start"], x["end"]) for x in op6.find(docs, bench).collect()))
    n = len(prose(5, 30))
    assert got == [(0, 2, 0, 1), (0, 3, 0, n), (1, 1, 1, 9), (7, 3, 1, n + 1), (7, 3, 1, n + 1)]
    kept = op6.clean(docs, bench)
    assert kept.schema == docs.schema and [x["doc_id"] for x in kept.orderBy("doc_id").collect()] == [2, 4, 4, 5, 6]
