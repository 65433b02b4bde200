"""Rounds over blocks of a graph: the same choices as in plain Python, without a row for each edge and run."""

import random

import numpy as np
import pytest

from nullgauge.operators import adjacency, graph, stability


def records(spark) -> int:
    """Rows that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_moves_of_many_runs_shuffle_no_row_for_each_edge_and_run(spark):
    n, runs = 60, 40
    rng = random.Random(1)
    edges = spark.createDataFrame([(a, b, rng.randint(1, 9)) for a in range(n) for b in range(a + 1, n)], "src long, dst long, w long").cache()
    both = n * (n - 1)
    assert edges.count() == both // 2
    before = records(spark)
    found, _ = stability.batched_moves(edges, spark.createDataFrame([(k, 1.0) for k in range(runs)], "run int, resolution double"), most_rounds=2, most_levels=1)
    assert found.count() == n * runs
    assert records(spark) - before < both * runs


@pytest.mark.parametrize("own_first", [False, True])
@pytest.mark.parametrize("cells", [10, 1_000_000])
def test_best_labels_equal_the_plain_choice(monkeypatch, own_first, cells):
    monkeypatch.setattr(adjacency, "CELLS", cells)
    rng = np.random.default_rng(3)
    n, m, total = 40, 25, 50.0
    src = np.sort(rng.integers(0, n, 120 if cells > 10 else 90))
    label, w, now = rng.integers(0, m, len(src)), rng.integers(1, 4, len(src)).astype(float), rng.integers(0, m, n)
    k, k_label, rank = rng.integers(1, 5, n).astype(float), rng.integers(5, 9, m).astype(float), rng.permutation(m)
    got = adjacency._best(n, src, label, w, now, k, 0.5 * k, k_label, rank, total, 1e-9, own_first)
    for x in range(n):
        to = {int(now[x]): 0.0}
        for at in np.flatnonzero(src == x):
            to[int(label[at])] = to.get(int(label[at]), 0.0) + w[at]
        gain = {y: v - 0.5 * k[x] * (k_label[y] - (k[x] if y == now[x] else 0.0)) / (2 * total) + (1e-9 if y == now[x] else 0.0) for y, v in to.items()}
        assert got[x] == max(gain, key=lambda y: (gain[y], own_first and y == now[x], rank[y]))


def test_triangles_equal_the_plain_count_without_a_row_for_each_wedge(spark, monkeypatch):
    monkeypatch.setattr(adjacency, "EDGES", 300)
    rng = random.Random(5)
    n = 70
    pairs = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.9 if a < 3 else 0.6)}
    edges = spark.createDataFrame([(a - 20, b - 20, 1) for a, b in sorted(pairs)], "src long, dst long, w long").cache()
    edges.count()
    before = records(spark)
    got = {r.node + 20: r.triangles for r in graph.triangles(edges).collect()}
    near = {k: {b if a == k else a for a, b in pairs if k in (a, b)} for k in range(n)}
    assert got == {k: sum((a, b) in pairs for a in near[k] for b in near[k]) for k in range(n)}
    assert records(spark) - before < sum(len(x) * (len(x) - 1) for x in near.values()) // 6


def test_walks_shuffle_no_row_for_each_edge_and_set(spark):
    n, sets = 60, 30
    edges = spark.createDataFrame([(a, b, a + b) for a in range(n) for b in range(a + 1, n)], "src long, dst long, w long").cache()
    edges.count()
    seeds = spark.createDataFrame([(f"s{k}", k) for k in range(sets)], "seed_set string, node long")
    before = records(spark)
    assert graph.random_walk(edges, seeds, steps=3).count() == n * sets
    assert records(spark) - before < n * (n - 1) * sets
