"""File formats: each query writes its table in a format to the shared folder and reads it back with the reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.draws import dealt, scratch
from ..sources import readers, sinks
from .base import Tables, query, r
from .calibration import _SCREEN, _screen


def _s(c: str):
    return F.col(c).cast("string")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey % 7 <> 0")
def o001_tsv(t: Tables):
    """Suppliers from tab-separated files; every seventh has a blank name, its key, and goes."""
    folder = scratch(t._spark, "o001")
    t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, " ").otherwise(F.col("s_name")).alias("s_name"), "s_nationkey").write.csv(folder, sep="\t", header=True, emptyValue="")
    return readers.read_tsv(t._spark, folder, {"s_suppkey": "long", "s_name": "string", "s_nationkey": "int"}, key="s_name")


@query("SELECT o_orderkey AS database_id, o_orderpriority AS frequency, o_totalprice AS weight FROM orders WHERE o_orderkey % 9 <> 4")
def o002_commented_tsv(t: Tables):
    """Orders below a commented preamble; every ninth row is ragged."""
    folder = scratch(t._spark, "o002")
    row = F.concat_ws("\t", _s("o_orderkey"), "o_orderpriority", F.when(F.col("o_orderkey") % 9 != 4, _s("o_totalprice")))
    head = t.region.select(F.explode(F.array(F.lit("#description: orders"), F.lit("#version: 1"), F.lit("database_id\tfrequency\tweight"))).alias("value"))
    head.unionByName(t.orders.select(row.alias("value"))).write.text(folder)
    return readers.read_commented_tsv(t._spark, folder, {"database_id": "long", "frequency": "string", "weight": "double"})


@query("""SELECT 'C:' || c_custkey AS id, c_name AS name, 'N:' || c_nationkey AS is_a, 'SEG:' || c_mktsegment AS xref, CASE WHEN c_custkey % 2 = 0 THEN 'buyer "' || c_custkey || '"' END AS synonym, c_custkey % 11 = 3 AS obsolete FROM customer
UNION ALL SELECT 'N:' || n_nationkey, n_name, 'R:' || n_regionkey, NULL, NULL, false FROM nation""")
def o003_obo(t: Tables):
    """Customers and nations as ontology terms; a typedef stanza is left out."""
    folder = scratch(t._spark, "o003")
    c = t.customer.select(F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: C:"), _s("c_custkey")), F.concat(F.lit("name: "), "c_name"), F.concat(F.lit("is_a: N:"), _s("c_nationkey"), F.lit(" ! nation")), F.concat(F.lit("xref: SEG:"), "c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('synonym: "buyer \\"'), _s("c_custkey"), F.lit('\\"" EXACT []'))), F.when(F.col("c_custkey") % 11 == 3, "is_obsolete: true")).alias("value"))
    n = t.nation.select(F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: N:"), _s("n_nationkey")), F.concat(F.lit("name: "), "n_name"), F.concat(F.lit("is_a: R:"), _s("n_regionkey"))).alias("value"))
    d = t.region.select(F.lit("[Typedef]\nid: part_of\nname: part of").alias("value"))
    c.unionByName(n).unionByName(d).write.option("lineSep", "\n\n").text(folder)
    o = readers.read_obo(t._spark, folder)
    return o.select("id", "name", F.get("is_a", F.lit(0)).alias("is_a"), F.get("xref", F.lit(0)).alias("xref"), F.regexp_replace(F.get("synonym", F.lit(0)), r"\\(.)", "$1").alias("synonym"), "obsolete")


@query("SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 4) AS quantity, min(l_returnflag) AS first_flag FROM lineitem GROUP BY 1")
def o004_xml_records(t: Tables):
    """Orders as XML records with an element for each line."""
    folder = scratch(t._spark, "o004")
    # a file is one task's when it is read, so an order's lines are dealt to tasks of a bounded number of lines
    lines = dealt(t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag"), t.lineitem.count(), "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("Quantity"), F.col("l_returnflag").alias("Flag"))).alias("Line"))
    lines.withColumnRenamed("l_orderkey", "OrderKey").write.format("xml").option("rowTag", "Order").option("rootTag", "Orders").save(folder)
    x = readers.read_xml_records(t._spark, folder, "Order", "OrderKey long, Line array<struct<Quantity: double, Flag: string>>")
    e = x.select(F.col("OrderKey").alias("l_orderkey"), F.explode_outer("Line").alias("line"))
    return e.groupBy("l_orderkey").agg(F.count("line").alias("n_lines"), r(F.sum("line.Quantity"), 4).alias("quantity"), F.min("line.Flag").alias("first_flag"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1, 2")
def o005_gzip_tsv(t: Tables):
    """Lines from gzip files, spread after the scan."""
    folder = scratch(t._spark, "o005")
    t.lineitem.select("l_returnflag", "l_linestatus", "l_extendedprice").write.csv(folder, sep="\t", header=True, compression="gzip")
    x = readers.read_tsv(t._spark, folder, {"l_returnflag": "string", "l_linestatus": "string", "l_extendedprice": "double"}, tasks=t._spark.sparkContext.defaultParallelism)
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r(F.avg("l_extendedprice"), 4).alias("price"))


@query("SELECT o_custkey AS collection, count(*) AS datasets, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
def o008_json_arrays(t: Tables):
    """Collections with nested lists of datasets, from JSON arrays."""
    folder = scratch(t._spark, "o008")
    sets = t.orders.groupBy(F.col("o_custkey").alias("collection")).agg(F.collect_list(F.struct(F.col("o_totalprice").alias("total"), F.array("o_orderpriority").alias("tags"))).alias("datasets"))
    sets.select(F.to_json(F.array(F.struct("collection", "datasets"))).alias("value")).write.text(folder)
    x = readers.read_json_arrays(t._spark, folder, "collection: long, datasets: array<struct<total: double, tags: array<string>>>")
    d = x.select("collection", F.explode("datasets").alias("d"))
    return d.groupBy("collection").agg(F.count("*").alias("datasets"), r(F.sum("d.total"), 2).alias("total"), F.count_if(F.array_contains("d.tags", "1-URGENT")).alias("urgent"))


@query("SELECT p_brand AS row_id, p_type AS symbol, round(-avg(l_extendedprice), 4) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def o009_wide_matrix(t: Tables):
    """A brand by type matrix of mean prices, its sign turned."""
    folder = scratch(t._spark, "o009")
    kinds = [x.p_type for x in t.part.select("p_type").distinct().orderBy("p_type").collect()]
    wide = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").pivot("p_type", kinds).agg(F.avg("l_extendedprice"))
    wide.toDF("p_brand", *[f"{c} ({k})" for k, c in enumerate(kinds)]).write.csv(folder, header=True)
    m = readers.read_wide_matrix(t._spark, folder, "p_brand")
    return m.select("row_id", "symbol", r("value", 4).alias("value"))


@query("SELECT DISTINCT p_brand AS symbol FROM part")
def o010_symbols(t: Tables):
    folder = scratch(t._spark, "o010")
    t.part.select(F.concat("p_brand", F.lit(" ("), _s("p_partkey"), F.lit(")")).alias("Gene")).write.csv(folder, header=True)
    return readers.read_symbols(t._spark, folder, "Gene")


@query("""SELECT c_custkey AS row_id, CASE WHEN substr(c_mktsegment, 1, 1) <> 'B' THEN '10' || substr(c_mktsegment, 1, 1) END AS first_mutation, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS fold_a, CASE WHEN c_custkey % 3 <> 0 THEN 1.0 END AS fold_b
FROM customer WHERE c_acctbal > 0 OR c_custkey % 3 <> 0""")
def o011_panel(t: Tables):
    """Customers as isolates: two positions and two drugs."""
    folder = scratch(t._spark, "o011")
    acid = F.substring("c_mktsegment", 1, 1)
    t.customer.select("c_custkey", F.when(acid == "B", "-").otherwise(acid).alias("P10"), F.lit(".").alias("P22"), F.col("c_acctbal").alias("A"), F.when(F.col("c_custkey") % 3 == 0, "NA").otherwise("10").alias("B")).write.csv(folder, header=True)
    mutations, folds = readers.read_panel(t._spark, folder, "c_custkey", ["A", "B"])
    wide = folds.groupBy("row_id").pivot("drug", ["A", "B"]).agg(F.max("log_fold"))
    out = wide.join(mutations.groupBy("row_id").agg(F.min("mutation").alias("first_mutation")), "row_id", "left")
    return out.select(F.col("row_id").cast("long").alias("row_id"), "first_mutation", r("A").alias("fold_a"), F.col("B").alias("fold_b"))


@query("SELECT p_partkey AS row_id, round(p_retailprice + CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END, 4) AS total FROM part")
def o012_vectors(t: Tables):
    """Feature vectors; one component isn't a number in every fifth size."""
    folder = scratch(t._spark, "o012")
    t.part.select("p_partkey", F.col("p_retailprice").alias("z_a"), F.lit("x").alias("other"), F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(_s("p_size")).alias("z_b")).write.csv(folder, header=True)
    v = readers.read_vectors(t._spark, folder, "p_partkey")
    return v.select(F.col("row_id").cast("long").alias("row_id"), r(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'DOMAIN' ELSE 'REGION' END AS kind, CAST(l_quantity AS INT) AS s, CAST(l_quantity AS INT) + l_linenumber AS e, l_returnflag AS note FROM lineitem
), d AS (SELECT DISTINCT l_orderkey, kind, s, e, note FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, s - e, kind, note) AS place FROM d)
SELECT l_orderkey, kind, s AS start, e AS "end", note, CAST(place AS INT) AS place FROM k WHERE place <= 2""")
def o013_typed_features(t: Tables):
    """Features named in a text cell of an order, the first two by place and then length."""
    kind = F.when(F.col("l_returnflag") == "R", "DOMAIN").otherwise("REGION")
    one = F.concat(kind, F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(".."), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).cast("string"), F.lit('; /note="'), "l_returnflag", F.lit('"'))
    cells = t.lineitem.groupBy("l_orderkey").agg(F.concat_ws("; ", F.collect_set(one)).alias("cell"))
    f = cells.select("l_orderkey", F.explode(readers.typed_features(F.col("cell"), ["DOMAIN", "REGION"])).alias("f")).select("l_orderkey", "f.*")
    from ..operators.ranks import top_k

    return top_k(f, ("l_orderkey",), 2, F.asc("start"), F.asc(F.col("start") - F.col("end")), F.asc("kind"), F.asc("note")).withColumn("place", F.col("place").cast("int"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1")
def o014_bom_csv(t: Tables):
    """Orders from files that begin with a byte order mark."""
    folder = scratch(t._spark, "o014")
    t.orders.select(F.year("o_orderdate").alias("﻿year"), "o_orderkey").write.csv(folder, header=True)
    return readers.read_bom_csv(t._spark, folder).groupBy(F.col("year").cast("int").alias("year")).agg(F.count("*").alias("n"))


@query(_SCREEN + "SELECT entity, n, round((score - null_mean) / null_sd, 5) AS z FROM z")
def o015_calibrated_sink(t: Tables):
    """The calibrated table written by falling z and read back."""
    folder = scratch(t._spark, "o015")
    z, null = _screen(t)
    sinks.write_calibrated(z.select("entity", "n", "score", "null_mean", "null_sd", "z"), null, folder)
    back = t._spark.read.csv(f"{folder}/entities", header=True, schema="entity long, n long, score double, null_mean double, null_sd double, z double")
    return back.select("entity", "n", r("z", 5).alias("z"))


@query("SELECT 'price_by_flag' AS metric, l_returnflag, round(avg(l_extendedprice), 4) AS value, '42' AS seed, '0.05' AS threshold FROM lineitem GROUP BY l_returnflag")
def o016_measurement_sink(t: Tables):
    """A measurement beside its run metadata."""
    folder = scratch(t._spark, "o016")
    sinks.write_measurement(t.lineitem.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("value")), folder, "price_by_flag", seed=42, threshold=0.05)
    meta = t._spark.read.parquet(f"{folder}/run_metadata").groupBy("metric").pivot("name", ["seed", "threshold"]).agg(F.first("value"))
    return t._spark.read.parquet(f"{folder}/price_by_flag").withColumn("metric", F.lit("price_by_flag")).join(meta, "metric").withColumn("value", r("value", 4))


@query("""WITH h AS (SELECT list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, 1 + length(c_name)), lambda i: ascii(substr(c_name, CAST(i AS INT), 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS h, c_custkey FROM customer)
SELECT CAST(h % 128 AS INT) AS shard, count(*) AS n, min(c_custkey) AS least FROM h GROUP BY 1""")
def o017_sharded_export(t: Tables):
    """Customers dealt to 128 shards by the hash of their names, read back by folder."""
    folder = scratch(t._spark, "o017")
    sinks.write_shards(t.customer.select("c_custkey", "c_name"), "c_name", folder)
    return t._spark.read.parquet(folder).groupBy("shard").agg(F.count("*").alias("n"), F.min("c_custkey").alias("least"))


@query("""SELECT c_custkey, n_orders, n_nation, (n_orders IS NOT NULL)::INT + (n_nation IS NOT NULL)::INT AS layers, 'lost' AS missing FROM (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1)
FULL JOIN (SELECT c_custkey, c_nationkey AS n_nation FROM customer WHERE c_acctbal > 0) USING (c_custkey)""")
def o018_layers(t: Tables):
    """Two written layers merged; a third one is missing, which is reported and not an error."""
    folder = scratch(t._spark, "o018")
    t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders")).write.parquet(f"{folder}/orders")
    t.customer.filter("c_acctbal > 0").select("c_custkey", F.col("c_nationkey").alias("n_nation")).write.parquet(f"{folder}/nations")
    found, missing = sinks.read_layers(t._spark, {k: f"{folder}/{k}" for k in ("orders", "nations", "lost")})
    both = found["orders"].join(found["nations"], "c_custkey", "full")
    return both.withColumns({"layers": F.col("n_orders").isNotNull().cast("int") + F.col("n_nation").isNotNull().cast("int"), "missing": F.lit(",".join(missing))})
