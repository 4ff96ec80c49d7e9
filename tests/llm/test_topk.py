import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import topk_search
from lanewise.llm.topk_search import cover_tree, top_k

KIND = "vec_id bigint, embedding array<double>, rank string, v string"


def brute(rows, k, asks):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in sound:
        if asks(q):
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in sound if i != q)[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


def got(df, k=5):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 5 == 0, k).collect()}


@pytest.mark.parametrize("spread", ["random", "clustered", "copies"])
def test_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk_search, "CANDIDATES", 150)
    monkeypatch.setattr(topk_search, "QUERIES", 30)
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 6))
    if spread == "clustered":
        x = r.normal(size=(8, 6))[r.integers(0, 8, 600)] * 5 + x * 0.05
    if spread == "copies":
        x[::3] = x[0]
    rows = [(i, v.tolist(), "a", "b") for i, v in enumerate(x)]
    assert got(spark.createDataFrame(rows, KIND)) == brute(rows, 5, lambda q: q % 5 == 0)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], "", ""), (5, [1.0, 2.0], "", ""), (3, None, "", ""), (4, [1.0, None], "", ""), (10, [math.nan, 1.0], "", ""), (None, [1.0, 1.0], "", ""), (7, [math.inf, 0.0], "", ""), (8, [], "", ""), (9, [3.0], "", ""), (15, [-1e15, 3e15], "", ""), (20, [2e15, 1e15], "", "")]
    assert got(spark.createDataFrame(rows, KIND)) == brute(rows, 5, lambda q: q % 5 == 0)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], KIND)) == set()


def test_fewer_than_k(spark):
    rows = [(0, [1.0], "", ""), (1, [2.0], "", "")]
    assert got(spark.createDataFrame(rows, KIND)) == {(0, 1, 1, 256 * 512)}


def test_cover_tree_covers():
    points = np.random.default_rng(0).normal(size=(3000, 5))
    order, root = cover_tree(points)
    assert sorted(order.tolist()) == list(range(3000))
    todo, depth = [(root, 1)], 0
    while todo:
        node, level = todo.pop()
        depth = max(depth, level)
        mine = points[order[node.start : node.end]]
        assert np.sqrt(((mine - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert [c.start for c in node.children][0] == node.start and node.children[-1].end == node.end
        todo += [(c, level + 1) for c in node.children]
    assert depth < 40


def test_nodes_are_pruned_in_clustered_data():
    r = np.random.default_rng(2)
    x = r.normal(size=(12, 8))[r.integers(0, 12, 6000)] * 20 + r.normal(size=(6000, 8)) * 0.1
    search = topk_search.Search(x[:600], np.arange(600), x, np.arange(6000), 5)
    search.run()
    assert search.pairs < 0.6 * 600 * 6000
