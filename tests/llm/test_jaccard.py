"""The Jaccard join on repeated rows, shared ids, missing ids and small blocks, against brute force."""

import random
from collections import Counter

import pytest
from test_operators import brute_components, prose

from feedloom.llm import op07_jaccard_join as op7


def family(seed, n, most, words=60):
    """Copies of one text with up to `most` words changed: many pairs stand near the threshold."""
    base, out = prose(seed, words).split(), []
    for i in range(n):
        r, copy = random.Random(seed * 1000 + i), list(base)
        for _ in range(r.randrange(most + 1)):
            copy[r.randrange(words)] = f"new{seed}x{i}x{r.randrange(99)}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def crowd():
    texts = family(1, 60, 4) + family(2, 40, 9, 120) + family(3, 30, 2, 20) + [prose(i, 3 + 9 * i) for i in range(40)]
    return list(enumerate(texts))


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_crowds(spark, monkeypatch, crowd, k, percent, small):
    if small:
        for name, value in (("HOLDERS", 8), ("SHINGLES", 300), ("FOLLOWERS", 3), ("KEYS", 0)):
            monkeypatch.setattr(op7, name, value)
    rows = crowd + crowd[::3] + crowd[:5]  # repeated rows
    got = op7.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent).collect()
    want = brute_components(crowd, k, percent)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if (r["n_shingles"], r["component_id"]) != want[r["doc_id"]]] == []
    assert 5 < len({c for _, c in want.values()}) < len(crowd) - 5


def test_ids(spark):
    """One id with two texts, rows without an id, columns with clashing names."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    near = lambda t: t.rsplit(" ", 1)[0] + " end"
    rows = [(1, a), (1, b), (5, near(b)), (6, near(a)), (None, c), (None, near(c)), (7, c), (None, prose(4, 50)), (None, prose(5, 50)), (None, None), (8, ""), (8, "")]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, node int, t int, component string")
    got = Counter((r["doc_id"], r["component_id"]) for r in op7.join(df, 5, 80).collect())
    assert got == Counter([(1, 1), (1, 1), (5, 1), (6, 1), (None, 7), (None, 7), (7, 7), (None, None), (None, None), (None, None), (8, 8), (8, 8)])
    kept = op7.leaders(df.unionByName(df), 5, 80)
    assert kept.columns == df.columns
    # of the two texts of id 1 each leads a component of its own; repeated rows are one, rows without shingles all stay
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (1, b), (7, c), (None, prose(4, 50)), (None, prose(5, 50)), *[(None, None), (8, ""), (8, "")] * 2])


def test_sweep_is_exact():
    import numpy as np

    from feedloom.llm import common

    r = np.random.default_rng(1)
    base = common.mix64(np.arange(1, 200, dtype=np.uint64))
    sets = sorted((np.sort(np.concatenate([r.choice(base, 150, False), common.mix64(r.integers(1000, 9999, int(r.integers(0, 60))).astype(np.uint64))])) for _ in range(60)), key=len)
    sets = [np.unique(x) for x in sets]
    sets.sort(key=len)
    n = np.array([len(x) for x in sets])
    mark = np.stack([op7.marks(x, op7.width(int(n[0]), 60, 8)) for x in sets])
    got = op7.Sweep(n, np.arange(60), mark, 60, None, sets)
    for a in range(60):
        for b in range(a + 1, 60):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert got.linked(a, b) == (100 * both >= 60 * (n[a] + n[b] - both))
            assert (mark[a] != mark[b]).sum() <= n[a] + n[b] - 2 * both
    up = list(range(60))
    for a, b in got.edges():
        assert got.linked(a, b)
        up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
    assert all(up[a] == up[b] for a in range(60) for b in range(a + 1, 60) if got.linked(a, b))
