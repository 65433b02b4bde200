"""Readers on invented files."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from nullgauge.operators import graph, nulls, significance
from nullgauge.sources import readers, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_commented_and_ragged_rows(spark, tmp_path):
    path = write(tmp_path / "a.tsv", "#one\n#two\ndatabase_id\tname\tn\nX:1\talpha\t3\nX:2\tbeta\nX:3\tgamma\tmany\n")
    assert [tuple(r) for r in readers.read_commented_tsv(spark, path, {"database_id": "string", "name": "string", "n": "int"}).collect()] == [("X:1", "alpha", 3), ("X:3", "gamma", None)]


def test_ontology_stanzas(spark, tmp_path):
    path = write(tmp_path / "o.obo", 'format-version: 1.2\n\n[Term]\nid: T:1\nname: root\n\n[Term]\nid: T:2\nname: leaf\nis_a: T:1 ! root\nis_a: T:0\nxref: M:7 "note"\nsynonym: "a \\"b\\"" EXACT []\nis_obsolete: true\n\n[Typedef]\nid: part_of\n')
    rows = {r.id: r for r in readers.read_obo(spark, path).collect()}
    assert set(rows) == {"T:1", "T:2"} and rows["T:2"].is_a == ["T:1", "T:0"] and rows["T:2"].xref == ["M:7"] and rows["T:2"].obsolete and not rows["T:1"].obsolete


def test_members_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/cells.tsv", "Gene\tCell\tvalue\nA\tc1\t2.5\nB\tc2\t1\n")
        z.writestr("readme.txt", "no")
    assert sorted(map(tuple, readers.read_archive_tsv(spark, str(tmp_path / "a.zip"), r"\.tsv$", ["Gene", "value", "absent"]).collect())) == [("x/cells.tsv", "A", "2.5", None), ("x/cells.tsv", "B", "1", None)]
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name, body in (("p/1.json", '{"id": "p1", "features": [{"type": "f", "excluded": true}]}'), ("p/2.json", "broken")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body.encode()))
    docs = readers.read_archive_json(spark, str(tmp_path / "b.tar.gz"), r"\.json$", "id string, features array<struct<type: string, excluded: boolean>>")
    got = {r.member: r.doc for r in docs.collect()}
    assert got["p/1.json"].id == "p1" and got["p/1.json"].features[0].excluded and got["p/2.json"].id is None


def test_matrix_panel_and_vectors(spark, tmp_path):
    m = readers.read_wide_matrix(spark, write(tmp_path / "m.csv", "row,AB (1),C D (22)\nr1,-0.5,\nr2,1,nan\n"), "row")
    assert sorted(map(tuple, m.collect())) == [("r1", "AB", 0.5), ("r2", "AB", -1.0)]
    mutations, folds = readers.read_panel(spark, write(tmp_path / "p.csv", "id,P1,P2,D1,D2\na,K,-,10,\nb,.,R,0,NA\n"), "id", ["D1", "D2"])
    assert [tuple(r) for r in mutations.collect()] == [("a", "1K")] and [tuple(r) for r in folds.collect()] == [("a", "D1", 1.0)]
    v = readers.read_vectors(spark, write(tmp_path / "v.csv", "gene,z_a,b,z_c\ng,1.5,9,x\n"), "gene")
    assert v.first().vector == [1.5, 0.0]


def test_features_in_a_cell(spark):
    cell = 'DOMAIN 12..45; /note="kinase"; REGION 7; DOMAIN <3..>9'
    got = spark.range(1).select(readers.typed_features(F.lit(cell), ["DOMAIN", "REGION"]).alias("f")).first().f
    assert [(x.kind, x.start, x.end, x.note) for x in got] == [("DOMAIN", 12, 45, "kinase"), ("REGION", 7, 7, None), ("DOMAIN", 3, 9, None)]


def test_byte_order_marks_and_hashes(spark, tmp_path):
    assert readers.read_bom_csv(spark, write(tmp_path / "b.csv", "﻿year,n\n2020,1\n")).columns == ["year", "n"]
    h = spark.range(1).select(sinks.fnv1a(F.lit("foobar")).alias("a"), sinks.fnv1a(F.lit("")).alias("b")).first()
    assert (h.a, h.b) == (0xBF9CF968, 0x811C9DC5)


def test_missing_layers_are_named(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "here"))
    found, missing = sinks.read_layers(spark, {"here": str(tmp_path / "here"), "gone": str(tmp_path / "gone")})
    assert found["here"].count() == 3 and missing == ["gone"]


def test_mean_nulls_refuse_what_they_cannot_use(spark):
    rows = spark.range(60).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"), (F.col("id") % 5).alias("block"))
    counts = spark.createDataFrame([(2,), (9,)], "n long")
    with pytest.raises(ValueError, match="doesn't span"):
        nulls.fit_mean_null(rows, "id", "v", counts, grid=[2, 5])
    with pytest.raises(ValueError, match="blocks are too few"):
        nulls.fit_mean_null(rows, "id", "v", counts, blocks="block")
    with pytest.raises(ValueError, match="no block"):
        nulls.fit_mean_null(rows.withColumn("block", F.when(F.col("id") > 3, F.col("block"))), "id", "v", counts, blocks="block")
    with pytest.raises(ValueError, match="too few for a null"):
        nulls.fit_mean_null(rows.limit(10), "id", "v", counts)
    with pytest.raises(ValueError, match="unequal"):
        nulls.fit_mean_null(rows.withColumn("v", F.when(F.col("id") == 1, F.array(F.lit(1.0))).otherwise(F.col("v"))), "id", "v", counts)
    assert nulls.fit_mean_null(rows, "id", "v", counts, draws=5).count() >= 2


def test_unknown_baselines_list_what_exists(spark):
    log = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "variant string, outcome double")
    with pytest.raises(ValueError, match="there are a, b"):
        nulls.baseline_pool(log, "variant", "c", "outcome")
    assert nulls.baseline_pool(log, "variant", "b", "outcome").count() == 0 and nulls.permutation_pool(log, "outcome").count() == 1


def test_turned_directions_keep_pair_sums(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 1, 1.0), (1, 3, 4.0)], "src long, dst long, w double")
    turned = {(r.src, r.dst): r.w for r in nulls.flipped_directions(e, "s", 1).collect()}
    assert turned[1, 2] + turned[2, 1] == 6 and {turned[1, 2], turned[2, 1]} == {5.0, 1.0} and {turned[1, 3], turned[3, 1]} == {4.0, 0.0}


def test_exact_tests_and_ranks(spark):
    two = spark.createDataFrame([("x", 3, 1, 1, 3), ("y", 8, 2, 1, 5), ("z", 0, 0, 0, 0)], "k string, a long, b long, c long, d long")
    p = {r.k: r.p for r in significance.fisher_exact(two, ["k"]).collect()}
    assert abs(p["x"] - 0.4857142857) < 1e-9 and abs(p["y"] - 0.03496503) < 1e-7 and p["z"] == 1


def test_components_and_closure_on_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).alias("w"))
    labels = graph.component_labels(edges)
    assert labels.count() == 301 and labels.select("component").distinct().collect()[0][0] == 0
    c = graph.closure(edges.filter("src < 200"), "src", "dst")
    assert c.count() == 200 * 201 / 2 and c.agg(F.max("depth")).first()[0] == 200


def test_pieces_of_labels(spark):
    pairs = [(8 * b + i, 8 * b + j, 1) for b in range(4) for i in range(8) for j in range(i)] + [(0, 8, 1), (8, 16, 1), (16, 24, 1)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in pairs], "src long, dst long, w long")
    pieces = graph.disconnected_labels(edges, spark.createDataFrame([(k, k // 16) for k in range(32)], "node long, label long"))
    assert {(r.label, r.size, r.pieces) for r in pieces.collect()} == {(0, 16, 1), (1, 16, 1)}
