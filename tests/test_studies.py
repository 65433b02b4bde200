"""Studies of many repetitions against plain loops and planted structure."""

import random

import numpy as np
from pyspark.sql import functions as F

from nullgauge.operators import designs, graph, recovery, stability


def cliques(n, size):
    pairs = [(size * b + i, size * b + j) for b in range(n) for i in range(size) for j in range(i)] + [(size * b, size * (b + 1)) for b in range(n - 1)]
    return [(min(p), max(p), 1) for p in pairs]


def plain_modularity(edges, label):
    m, strength = sum(w for _, _, w in edges), {}
    for a, b, w in edges:
        strength[a], strength[b] = strength.get(a, 0) + w, strength.get(b, 0) + w
    mass = {}
    for k, s in strength.items():
        mass[label[k]] = mass.get(label[k], 0) + s
    return sum(w for a, b, w in edges if label[a] == label[b]) / m - sum(x * x for x in mass.values()) / (4 * m * m)


def plain_louvain(edges):
    """The best of one-node-at-a-time moves with merges of whole labels, until nothing gains."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    label, improved = {k: k for k in nodes}, True
    while improved:
        improved = False
        for group in [[k] for k in nodes] + [[k for k in nodes if label[k] == x] for x in set(label.values())]:
            now = plain_modularity(edges, label)
            for target in {label[b] for a, b, _ in edges if a in group} | {label[a] for a, b, _ in edges if b in group}:
                other = label | dict.fromkeys(group, target)
                if plain_modularity(edges, other) > now + 1e-12:
                    label, now, improved = other, plain_modularity(edges, other), True
    return label


def test_planted_cliques_are_stable_over_seeds(spark):
    rows = cliques(4, 6)
    edges = spark.createDataFrame(rows, "src long, dst long, w long")
    runs = spark.createDataFrame([(100 * g + s, x) for g, x in enumerate((0.5, 1.0, 2.0)) for s in range(3)], "run int, resolution double")
    found, record = stability.batched_moves(edges, runs)
    assert record[-1][2] == 0
    found = found.join(runs, "run").cache()
    each = {x.run: x.modularity for x in stability.modularities(edges, found).collect()}
    best = plain_modularity(rows, plain_louvain(rows))
    assert all(each[100 + s] >= 0.99 * best for s in range(3))
    summary = {x.resolution: x for x in stability.stability(stability.pairwise_rand(found, "resolution"), "resolution").collect()}
    assert summary[1.0].ari_mean == summary[1.0].ari_min == 1.0 and summary[1.0].pairs == 3
    together = stability.consensus(edges, found.select("run", "node", "label")).collect()
    assert len({x.label for x in together}) == 4 and all(x.size == 6 and 0 < x.confidence <= 1 for x in together)


def test_a_optimal_picks_equal_the_plain_greedy(spark):
    rng = random.Random(8)
    rows = [(a, b, round(rng.random(), 3)) for a in range(30) for b in range(a, 30) if rng.random() < 0.25]
    got = [(r.a, r.b) for r in designs.a_optimal_pairs(spark.createDataFrame(rows, "a long, b long, score double"), 6, 5.0).orderBy("step").collect()]
    low, high = min(r[2] for r in rows), max(r[2] for r in rows)
    inverse, left, want = np.eye(30) / designs.RIDGE, sorted(rows), []
    for _ in range(6):
        gains = []
        for a, b, s in left:
            u = np.zeros(30)
            u[a] += 1
            u[b] += 1
            v = inverse @ u
            gains.append((round(float(v @ v / (1 + u @ v) + 5.0 * (s - low) / (high - low)), 6), (-a, -b), u))
        _, (a, b), u = max(gains, key=lambda x: x[:2])
        v = inverse @ u
        inverse -= np.outer(v, v) / (1 + u @ v)
        want.append((-a, -b))
        left = [r for r in left if r[:2] != want[-1]]
    assert got == want
    assert designs.suggested_entities(40) == 10 and designs.suggested_entities(1) == 4


def test_power_needs_four_entities_and_follows_the_noise(spark):
    even = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    rows = [("even", *p) for p in even] + [("thin", 0, 1), ("thin", 2, 3), ("thin", 0, 2)]
    frame = spark.createDataFrame(rows, "design string, a long, b long")
    quiet = {x.design: x.power for x in designs.power_of_designs(frame, 3.0, 0.1, 12, 39).collect()}
    loud = {x.design: x.power for x in designs.power_of_designs(frame, 0.1, 3.0, 12, 39).collect()}
    assert quiet["thin"] == loud["thin"] == 0.0 and quiet["even"] > loud["even"]


def test_hidden_members_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(g, p, rng.random() < 0.5) for g in range(12) for p in range(60) if rng.random() < 0.3]
    monkeypatch.setattr(recovery, "GROUPS", 5)
    monkeypatch.setattr(recovery, "MEMBERS", 17)
    got = {x.g: (x.hits, round(x.ap, 9)) for x in recovery.hidden_member_precision(spark.createDataFrame(rows, "g long, p long, hidden boolean")).collect()}
    holds = {g: {p for x, p, _ in rows if x == g} for g in range(12)}
    for g in range(12):
        shown, hidden = {p for x, p, h in rows if x == g and not h}, {p for x, p, h in rows if x == g and h}
        score = {p: sum(len(shown & holds[o]) for o in range(12) if o != g and p in holds[o]) for p in range(60)}
        ranked = sorted((p for p in score if score[p] and p not in shown), key=lambda p: (-score[p], p))
        places = [k + 1 for k, p in enumerate(ranked) if p in hidden]
        assert (g in got) == bool(places)
        assert not places or got[g] == (len(places), round(sum((k + 1) / x for k, x in enumerate(places)) / len(places), 9))


def test_walks_equal_a_dense_matrix(spark):
    rng = random.Random(2)
    rows = [(a, b, rng.randint(1, 5)) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.5]
    edges = spark.createDataFrame(rows, "src long, dst long, w long")
    seeds = spark.createDataFrame([(0, 1), (0, 3), (1, 5)], "seed_set long, node long")
    got = {(x.seed_set, x.node): x.score for x in graph.random_walk(edges, seeds, 0.3, 10).collect()}
    w = np.zeros((12, 12))
    for a, b, x in rows:
        w[a, b] = w[b, a] = x
    step = w / w.sum(1)[:, None]
    for s, members in ((0, [1, 3]), (1, [5])):
        start = np.zeros(12)
        start[members] = 1 / len(members)
        score = start
        for _ in range(10):
            score = 0.7 * score @ step + 0.3 * start
        assert all(abs(got.get((s, k), 0.0) - score[k]) < 1e-12 for k in range(12))


def test_labels_spread_until_none_wants_another(spark):
    rows = cliques(3, 6)
    edges = spark.createDataFrame(rows, "src long, dst long, w long")
    label = {x.node: x.label for x in graph.label_propagation(edges).collect()}
    for node in label:
        votes = {}
        for a, b, w in rows:
            if node in (a, b):
                other = label[b if node == a else a]
                votes[other] = votes.get(other, 0) + w
        assert votes.get(label[node], 0) == max(votes.values())
    assert graph.label_propagation(edges.filter(F.col("src") < 0)).count() == 0
