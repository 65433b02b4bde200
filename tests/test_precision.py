"""Nulls by order statistics, rewired graphs, paths that meet half-way and neighbourhoods in two spaces."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nullgauge.operators import draws, features, graph, nulls


def test_top_null_has_the_exact_mean_of_the_largest(spark):
    rng = random.Random(4)
    values = sorted(rng.choice([rng.random(), 0.5]) for _ in range(60))
    pool = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "id int, v double")
    grid = spark.createDataFrame([(1,), (2,), (7,), (40,)], "n long")
    got = {x.n: x for x in nulls.fit_top_null(pool, "v", ("id",), grid, top=1, draws=3000).collect()}
    for n, x in got.items():
        weight = (np.arange(1, 61) / 60) ** n - (np.arange(60) / 60) ** n
        mean = float(weight @ np.array(values))
        sd = float(weight @ (np.array(values) - mean) ** 2) ** 0.5
        assert abs(x.null_mean - mean) < 4 * sd / 3000**0.5 and abs(x.null_sd - sd) < 0.1 * sd + 1e-9
    drawn = np.sort(np.random.default_rng(1).choice(values, (20000, 7)))[:, -3:].mean(1)
    three = nulls.fit_top_null(pool, "v", ("id",), grid, top=3, draws=3000)
    seven = three.filter("n = 7").first()
    assert abs(seven.null_mean - drawn.mean()) < 5 * drawn.std() / 3000**0.5 and abs(seven.p95 - np.quantile(drawn, 0.95)) < 0.03
    # two values are all there are at a count of two
    two = nulls.fit_top_null(pool, "v", ("id",), grid, top=2, draws=3000).filter("n = 2").first()
    assert abs(two.null_mean - np.mean(values)) < 4 * np.std(values) / 6000**0.5
    with pytest.raises(ValueError, match="too few"):
        nulls.fit_top_null(pool.limit(10), "v", ("id",), grid)


def test_rewired_graphs_keep_their_sums(spark):
    rng = random.Random(5)
    rows = [(a, b, 1) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.9 if a == 0 else 0.15)]
    edges = spark.createDataFrame(rows, "src long, dst long, w long")
    for kept, report in (graph.expected_degrees(edges, "a"), graph.permuted_ends(edges, "a")):
        x, found = report.first(), kept.collect()
        assert x.drawn == len(rows) and x.kept == len(found) == len({(k.src, k.dst) for k in found}) == x.drawn - x.loops - x.doubles
        assert all(k.src < k.dst for k in found) and {(k.src, k.dst) for k in found} != {(a, b) for a, b, _ in rows}
    # the permutation moves far ends only: drawn ends, loops included, are the old ones
    ends = Counter(x for a, b, _ in rows for x in (a, b))
    kept = Counter(x for k in graph.permuted_ends(edges, "a")[0].collect() for x in (k.src, k.dst))
    assert all(kept[n] <= ends[n] for n in range(40))
    means = Counter()
    for s in range(12):
        means.update(x for k in graph.expected_degrees(edges, f"s{s}")[0].collect() for x in (k.src, k.dst))
    assert means[0] == max(means.values()) and abs(sum(means.values()) / 12 - 2 * len(rows)) < 0.35 * 2 * len(rows)
    none = edges.filter("src < 0")
    assert graph.expected_degrees(none, "a")[1].first().drawn == graph.permuted_ends(none, "a")[1].first().drawn == 0


@pytest.mark.parametrize("most", [1, 3, 6])
def test_meeting_paths_equal_walking_every_path(spark, most):
    rng = random.Random(most)
    links = {(a, b) for a in range(30) for b in range(30) if a != b and rng.random() < 0.07}
    ends, starts = {3, 7, 11}, {0, 1, 2, 3, 20}
    want, lengths = {}, {}

    def walk(start, path):
        for a, b in links:
            if a == path[-1] and b not in path:
                if b in ends:
                    want.setdefault(start, []).append(len(path))
                elif len(path) < most:
                    walk(start, path + [b])

    for s in starts:
        walk(s, [s])
    edges = spark.createDataFrame([(a, b) for a, b in links], "src long, dst long")
    found, sizes = graph.meeting_paths(edges, spark.createDataFrame([(s,) for s in starts] * 2, "node long"), spark.createDataFrame([(t,) for t in ends], "node long"), 0.45, most)
    got = {x.source: (x.hops, x.paths, round(x.score, 9)) for x in found.collect()}
    assert got == {s: (min(v), len(v), round(sum(0.45**k for k in v), 9)) for s, v in want.items()}
    lengths = {(x.side, x.length) for x in sizes.collect()}
    assert max(k for _, k in lengths) == -(-most // 2)
    plain = {x.source: x.paths for x in graph.path_sums(edges, spark.createDataFrame([(s,) for s in starts], "node long"), spark.createDataFrame([(t,) for t in ends], "node long"), most=most).collect()}
    assert plain == {s: x[1] for s, x in got.items()}


def test_trustworthiness_equals_full_ranks(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(70, 6)), 1)
    x[5] = x[6]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    small = rows.select("vec_id", F.slice("embedding", 1, 2).alias("embedding"))
    got = {r.query_id: r for r in features.trustworthiness(rows, small, rows.filter("vec_id % 5 = 0"), 4, block=16).collect()}
    assert set(got) == set(range(0, 70, 5))

    def order(q, v):
        d = np.round(((v - v[q]) ** 2).sum(1), 9)
        return [int(i) for i in np.lexsort((np.arange(70), d)) if i != q]

    for q, r in got.items():
        rank = {i: k + 1 for k, i in enumerate(order(q, x))}
        near = [rank[i] for i in order(q, x[:, :2])[:4]]
        assert r.shared == sum(k <= 4 for k in near) and r.penalty == sum(max(0, k - 4) for k in near)
        assert abs(r.trust - (1 - 2 * r.penalty / (4 * (140 - 13)))) < 1e-12
    few = features.trustworthiness(rows.limit(5), small.join(rows.limit(5), "vec_id", "left_semi"), rows.limit(1), 2)
    assert few.first().trust is None


def test_written_rounds_keep_rows_and_types(spark):
    x = spark.range(5).withColumn("v", F.when(F.col("id") > 2, F.lit(1.5)))
    again = draws.written(x)
    assert dict(again.dtypes) == dict(x.dtypes) and sorted(again.collect()) == sorted(x.collect())
    assert draws.written(x.filter("id < 0")).count() == 0
