"""Properties of the library's operators on small tables."""

import pytest
from pyspark.sql import functions as F

from nullgauge.functions import scalars
from nullgauge.operators import decide, draws, graph, nulls, significance, tables


def test_equal_counts_keep_the_ranking(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("e"), draws.uniform("v", F.col("id")).alias("v"), "id")
    scored = nulls.scores(rows, "e", "v", "top_3_mean")
    null = nulls.fit_null(rows, "v", ("v", "id"), nulls.default_grid(scored), "top_3_mean", draws=50)
    z = nulls.calibrate(scored, null).toPandas()
    assert z.sort_values("score").entity.tolist() == z.sort_values("z").entity.tolist()


def test_null_refuses_small_pools(spark):
    rows = spark.range(10).select("id", F.col("id").cast("double").alias("v"))
    with pytest.raises(ValueError, match="too few"):
        nulls.fit_null(rows, "v", ("id",), spark.createDataFrame([(2,)], "n long"), "best_of_n")


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(100).withColumn("u", draws.u32("s", F.col("id")))
    a, b = (tables.fingerprint(rows.repartition(n)).first() for n in (1, 7))
    assert a == b


def test_power_values(spark):
    row = spark.range(1).select(F.round(significance.min_detectable_effect(F.lit(26)), 3).alias("x")).first()
    assert row.x == 1.099
    assert (significance.required_n(0.8), significance.required_n(0.2)) == (50, 785)
    with pytest.raises(ValueError):
        significance.required_n(0.5, alpha=0.0)


def test_components_and_modularity_of_cliques(spark):
    edges = [(b + i, b + j, 1) for b in (0, 10, 20) for i in range(4) for j in range(i + 1, 4)]
    e = spark.createDataFrame(edges, "src long, dst long, w long")
    assert graph.component_labels(e).select("component").distinct().count() == 3
    labels = graph.degrees(e).select("node", F.floor(F.col("node") / 10).alias("label"))
    assert abs(graph.modularity(e, labels).first()[0] - 2 / 3) < 1e-9


def test_balanced_pairs_equal_the_sequential_scan(spark):
    rows = [(a, 100 + b, float((a * 7 + b * 13) % 29)) for a in range(6) for b in range(5)]
    got = {(r.a, r.b) for r in decide.balanced_pairs(spark.createDataFrame(rows, "a long, b long, score double"), 8, 2).collect()}
    used, want = {}, set()
    for a, b, s in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if used.get(a, 0) < 2 and used.get(b, 0) < 2 and len(want) < 8:
            want.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    assert got == want


def test_rate_interval(spark):
    x = spark.createDataFrame([("1-5 / 10 000",), ("<1 / 1 000 000",), (">1 / 1000",), ("unknown",)], "t string").select(scalars.rate_interval(F.col("t")).alias("i")).collect()
    assert [tuple(r.i) if r.i else None for r in x] == [(1e-4, 5e-4), (0.0, 1e-6), (1e-3, 1e-2), None]


def test_contract_reports_all_problems(spark):
    df = spark.createDataFrame([(1, None), (1, 5.0)], "a long, b double")
    got = {tuple(r) for r in tables.contract_problems(df, {"a": {"unique": True}, "b": {"min": 6}, "c": {}}).collect()}
    assert got == {("a", "not unique"), ("b", "null"), ("b", "under minimum"), ("c", "missing")}
