"""Embedding near-dedup: shared ids, clashing columns, empty tables, and a table that links, against brute force."""

from collections import Counter

import numpy as np
import pytest

from feedloom.llm import op10_embedding_dedup as op10

SCHEMA = "vec_id long, embedding array<float>, label int, node long, c long, v string, low string"


def brute(rows, threshold=0.93):
    """For each row its links and the least id reachable."""
    x = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for _, v, _ in rows]
    links, group = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if rows[a][2] == rows[b][2] and x[a] @ x[b] >= threshold:
                links[a] += 1
                links[b] += 1
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return [(links[i], min(rows[j][0] for j in range(len(rows)) if group[j] == group[i])) for i in range(len(rows))]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 7, 8, "x", "y") for i, v, c in rows], SCHEMA)


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [0.0, 1.0, 0.01], 0), (3, [1.0, 0.0, 0.02], 0), (3, [1.0, 0.0, 0.02], 0), (4, [0.0, 0.0, 1.0], 0), (4, [0.0, 0.0, 1.0], 1)]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in op10.dedup(frame(spark, rows)).collect())
    assert got == Counter((i, *w) for (i, _, _), w in zip(rows, brute(rows)))


@pytest.mark.parametrize("block,cell", [(4096, 8192), (8, 16)])
def test_crowds(spark, monkeypatch, block, cell):
    monkeypatch.setattr(op10, "BLOCK", block)
    monkeypatch.setattr(op10, "CELL", cell)
    r, rows = np.random.default_rng(5), []
    for i in range(240):
        centre = np.random.default_rng(100 + i % 9).normal(size=16)
        rows.append((i // 2 * 2 if i % 11 == 0 else i, (centre + (0.3 * r.normal(size=16) if i % 4 else 0)).astype(np.float32).tolist(), i % 2))
    got = Counter((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in op10.dedup(frame(spark, rows)).collect())
    want = brute(rows)
    assert got == Counter((i, n, c, i == c) for (i, _, _), (n, c) in zip(rows, want)) and sum(n for n, _ in want) > 300


def test_empty(spark):
    assert op10.dedup(frame(spark, [])).count() == 0
    null = [(None, [1.0], 1), (1, None, 1), (2, [1.0], None)]
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in op10.dedup(frame(spark, null)).collect()} == {(None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True)}
