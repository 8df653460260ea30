"""Neighbours and hops against brute force."""

import random

import numpy as np
import pytest

from millrace.operators import neighbours
from millrace.operators.hops import hops_from
from millrace.operators.neighbours import nearest_neighbours


def vectors(spark, many, size=16, seed=1, hot=0):
    """Vectors around some middles; ``hot`` copies of one of them."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, size)) * 3
    rows = [(k, (middles[rng.integers(12)] + rng.normal(size=size)).round(4).tolist()) for k in range(many)]
    rows += [(many + k, rows[0][1]) for k in range(hot)]
    return rows, spark.createDataFrame(rows, "id long, v array<float>")


def brute(rows, queries, k):
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i in queries:
        d = ((m - m[ids.tolist().index(i)]) ** 2).sum(axis=1)
        out[i] = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def as_lists(found):
    out = {}
    for r in sorted(found.collect()):
        out.setdefault(r.query, []).append(r.neighbour)
    return out


@pytest.mark.parametrize("block, cells, hot", [(4096, None, 0), (40, 9, 300), (7, 1, 20)])
def test_exact_neighbours(spark, monkeypatch, block, cells, hot):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "ASKED", 3)
    rows, df = vectors(spark, 700, hot=hot)
    found = nearest_neighbours(df.where("id % 50 = 0"), df, key="id", vector="v", k=7, probes=2, cells=cells, exact=True)
    assert as_lists(found) == brute(rows, range(0, 700 + hot, 50), 7)


def test_recall_of_some_cells(spark):
    """Eight cells of 63 hold nine of ten neighbours, and far fewer distances are taken than there are pairs."""
    rows, df = vectors(spark, 4000)
    found = as_lists(nearest_neighbours(df.where("id % 100 = 0"), df, key="id", vector="v", k=10))
    want = brute(rows, range(0, 4000, 100), 10)
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want) and all(len(x) == 10 for x in found.values())


def test_neighbours_of_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (None, [0.0, 0.1]), (5, [1.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for exact in (False, True):
        assert as_lists(nearest_neighbours(df, df, key="id", vector="v", k=5, exact=exact)) == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
        assert nearest_neighbours(df.where("false"), df, key="id", vector="v", k=5, exact=exact).count() == nearest_neighbours(df, df.where("false"), key="id", vector="v", k=5, exact=exact).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_hops_against_search(spark, seed):
    rng = random.Random(seed)
    shares = [(rng.randrange(60), rng.randrange(70)) for _ in range(75)] + [(None, 3), (4, None), (200, 300), (201, 300), (500, 1), (500, 1)]
    start = [(0,), (1,), (None,), (999,)]
    want, last = {0: 0, 1: 0, 999: 0}, {0, 1, 999}
    step = 0
    while last:
        step += 1
        values = {v for n, v in shares if n in last and v is not None}
        last = {n for n, v in shares if v in values and n is not None} - set(want)
        want |= dict.fromkeys(last, step)
    df = spark.createDataFrame(shares, "n long, v long")
    found = hops_from(df, spark.createDataFrame(start, "n long"), node="n", through="v")
    assert {r.n: r.hops for r in found.collect()} == want and found.count() == len(want)
    near = hops_from(df, spark.createDataFrame(start, "n long"), node="n", through="v", most=1)
    assert {r.n: r.hops for r in near.collect()} == {n: h for n, h in want.items() if h < 2}
    assert hops_from(df, spark.createDataFrame([], "n long"), node="n", through="v").count() == 0
