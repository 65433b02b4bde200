"""Rounds over a graph: they go on until nothing wants to move, and leave neither their tables nor the graph on the disks."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from nullgauge.operators import adjacency, graph, intervals, recovery, stability
from nullgauge.operators.draws import shared_folder
from tests.test_adjacency import records


def tables(spark) -> int:
    folder = shared_folder(spark).removeprefix("file://")
    return sum(x.startswith(("round-", "blocks-", "packs-")) for x in os.listdir(folder))


def dense(spark, n=40):
    rng = random.Random(4)
    return spark.createDataFrame([(a - 7, b - 7, rng.randint(1, 4)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.7], "src long, dst long, w long").cache()


@pytest.fixture
def orders(tmp_path):
    rows = "SELECT i // 4 AS l_orderkey, CAST(hash(i) % 60 AS BIGINT) AS l_suppkey FROM range(2400) t(i)"
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    return str(tmp_path)


def test_sweep_ends_when_no_node_wants_to_move(spark, orders):
    rows = entry.queries()["o152_resolution_sweep"](spark, orders).collect()
    assert len(rows) == 7 and all(x.unsettled == 0 for x in rows)


def test_consensus_starts_from_settled_runs(spark, orders, monkeypatch):
    seen, moves = [], stability.batched_moves

    def noted(*args, **kwargs):
        out = moves(*args, **kwargs)
        seen.append(sum(x[2] for x in out[1]))
        return out

    monkeypatch.setattr(stability, "batched_moves", noted)
    assert entry.queries()["o153_consensus"](spark, orders).count() == 60
    assert seen == [0, 0]


def test_rounds_between_blocks_equal_those_in_one_task_and_leave_no_tables(spark, monkeypatch):
    edges = dense(spark)
    runs = spark.createDataFrame([(k, x) for k, x in enumerate((0.5, 1.0, 1.0, 2.0))], "run int, resolution double")
    whole = {(x.run, x.node): x.label for x in stability.batched_moves(edges, runs)[0].collect()}
    monkeypatch.setattr(adjacency, "EDGES", 300)
    before = tables(spark)
    found, record = stability.batched_moves(edges, runs)
    assert {(x.run, x.node): x.label for x in found.collect()} == whole and len(whole) == 160
    assert sum(x[1] for x in record) > 8 and record[0][2] == 0
    # the communities of each level are kept, rounds are not
    assert tables(spark) - before <= 2 * len(record)


def test_ids_far_apart_move_like_others(spark):
    rows = [(a, b, 1) for k in (0, 5) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(0, 5, 1)]
    wide = [(a * 10**17, b * 10**17, w) for a, b, w in rows]
    runs = spark.createDataFrame([(k, 1.0) for k in range(9)], "run int, resolution double")
    found = stability.batched_moves(spark.createDataFrame(wide, "src long, dst long, w long"), runs)[0].collect()
    assert len(found) == 90
    assert all(len({x.label for x in found if x.run == r and (x.node >= 5 * 10**17) == side}) == 1 for r in range(9) for side in (False, True))


def test_steps_of_walks_shuffle_no_node(spark):
    edges = dense(spark)
    seeds = spark.createDataFrame([("a", 0), ("b", 1), ("b", 99)], "seed_set string, node long")

    def sent(steps: int) -> int:
        before = records(spark)
        walks = graph.random_walk(edges, seeds, steps=steps).collect()
        assert abs(sum(x.score for x in walks if x.seed_set == "a") - 1) < 1e-9
        return records(spark) - before

    few, kept = sent(2), tables(spark)
    assert sent(12) - few < 10 * 40
    assert tables(spark) - kept <= 4


def test_spreading_labels_equal_in_blocks_and_leave_no_tables(spark, monkeypatch):
    edges = dense(spark)
    whole = {x.node: x.label for x in graph.label_propagation(edges).collect()}
    monkeypatch.setattr(adjacency, "EDGES", 200)
    before = tables(spark)
    assert {x.node: x.label for x in graph.label_propagation(edges).collect()} == whole and len(whole) == 40
    assert tables(spark) - before <= 2


def test_components_meet_over_fewer_edges(spark, monkeypatch):
    monkeypatch.setattr(adjacency, "EDGES", 150)
    edges = dense(spark).unionByName(spark.createDataFrame([(100 + k, 101 + k, 1) for k in range(0, 60, 1)] + [(300, 300, 1)], "src long, dst long, w long")).cache()
    expected = {k: -7 for k in range(-7, 33)} | {k: 100 for k in range(100, 161)} | {300: 300}
    assert {x.node: x.component for x in graph.component_labels(edges).collect()} == expected
    assert graph._forest(edges).count() < edges.count() // 2
    words = spark.createDataFrame([("b", "a", 1), ("c", "d", 1), ("d", "b", 1)], "src string, dst string, w long")
    assert {x.component for x in graph.component_labels(words).collect()} == {"a"}


def test_triangles_are_counted_in_jobs_that_free_their_copies(spark, monkeypatch):
    edges = dense(spark)
    whole = {x.node: x.triangles for x in graph.triangles(edges).collect()}
    monkeypatch.setattr(adjacency, "EDGES", 60)
    monkeypatch.setattr(graph, "FIRSTS", 6)
    before = tables(spark)
    assert {x.node: x.triangles for x in graph.triangles(edges).collect()} == whole
    assert tables(spark) - before > 2


def test_hidden_members_are_scored_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    rows = spark.createDataFrame([(g, p, rng.random() < 0.5) for g in range(14) for p in range(50) if rng.random() < 0.3], "g long, p long, hidden boolean")
    whole = {x.g: (x.hits, round(x.ap, 9)) for x in recovery.hidden_member_precision(rows).collect()}
    for name, n in (("GROUPS", 3), ("MEMBERS", 11), ("AT_ONCE", 2)):
        monkeypatch.setattr(recovery, name, n)
    before = tables(spark)
    assert {x.g: (x.hits, round(x.ap, 9)) for x in recovery.hidden_member_precision(rows).collect()} == whole and len(whole) == 14
    assert tables(spark) - before == 2 + 3 * 3


def test_bootstrap_draws_come_in_parts(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id % 3 AS g", "id", "CAST(id * id % 17 AS DOUBLE) AS v")

    def means() -> list[list[float]]:
        return [[round(x, 9) for x in r] for r in intervals.bootstrap_means(rows, "g", "id", "v", 10, "boot").orderBy("g").collect()]

    whole = means()
    monkeypatch.setattr(intervals, "DRAWS", 600)
    before = tables(spark)
    assert means() == whole and len(whole) == 3
    assert tables(spark) - before == 3
