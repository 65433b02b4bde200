"""Decision reports on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decide, tables
from .base import Tables, query, r

_EVIDENCE = """
WITH v AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') AS recurrent, count(*) FILTER (l_quantity > 40) / CAST(count(*) AS DOUBLE) AS indel, count(*) FILTER (l_quantity < 16) / CAST(count(*) AS DOUBLE) AS lof, count(*) FILTER (l_discount > 0.08) AS endpoints, count(*) FILTER (l_tax > 0.04) / CAST(count(*) AS DOUBLE) AS unclear FROM lineitem GROUP BY 1
), x AS (SELECT p_partkey, p_type, p_retailprice, CASE WHEN p_size % 5 > 0 THEN recurrent END AS recurrent, indel, CASE WHEN p_size % 7 > 0 THEN lof END AS lof, CASE WHEN p_size % 3 > 0 THEN 0.5 END AS private, CASE WHEN p_size % 4 = 0 THEN p_size % 8 = 0 END AS essential, CASE WHEN p_size % 2 = 0 THEN p_size / 50.0 END AS dependent, endpoints, CASE WHEN p_size % 11 > 0 THEN unclear END AS unclear FROM part JOIN v ON l_partkey = p_partkey
), a AS (SELECT *, coalesce(recurrent >= 10, false) AS s1, coalesce(indel <= 0.5, false) AS s2, coalesce(lof >= 0.3, false) AS s3, coalesce(private IS NOT NULL AND lof >= 0.3, false) AS s4,
  coalesce(CASE WHEN essential THEN false WHEN dependent IS NOT NULL THEN dependent < 0.9 WHEN essential IS NOT NULL THEN true END, false) AS s5, endpoints > 0 AS g1, coalesce(CASE WHEN essential IS NOT NULL THEN NOT essential ELSE dependent < 0.9 END, false) AS g2, coalesce(unclear < 0.6, false) AS g3 FROM x)
"""


def _assessed(t: Tables) -> DataFrame:
    n = F.count("*")
    v = t.lineitem.groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("recurrent"), (F.count_if(F.col("l_quantity") > 40) / n).alias("indel"), (F.count_if(F.col("l_quantity") < 16) / n).alias("lof"), F.count_if(F.col("l_discount") > 0.08).alias("endpoints"), (F.count_if(F.col("l_tax") > 0.04) / n).alias("unclear"))
    size = F.col("p_size")
    x = t.part.join(v, F.col("l_partkey") == F.col("p_partkey")).withColumns(
        {
            "recurrent": F.when(size % 5 > 0, F.col("recurrent")),
            "lof": F.when(size % 7 > 0, F.col("lof")),
            "private": F.when(size % 3 > 0, 0.5),
            "essential": F.when(size % 4 == 0, size % 8 == 0),
            "dependent": F.when(size % 2 == 0, size / 50),
            "unclear": F.when(size % 11 > 0, F.col("unclear")),
        }
    )
    strategies, gates = decide.assessment(*[F.col(c) for c in ("recurrent", "indel", "lof", "private", "essential", "dependent", "endpoints", "unclear")])
    return x.withColumns({"strategies": strategies, "gates": gates})


@query(_EVIDENCE + "SELECT p_partkey, s1::INT + s2::INT + s3::INT + s4::INT + s5::INT AS admitted, g1::INT + g2::INT + g3::INT AS passed FROM a")
def o172_assessment(t: Tables) -> DataFrame:
    """Admitted strategies and passed gates of every part."""
    a = _assessed(t)
    return a.select("p_partkey", F.size(F.filter("strategies", lambda s: s["admitted"])).alias("admitted"), F.size(F.filter("gates", lambda g: g["passed"])).alias("passed"))


@query(_EVIDENCE + """, k AS (SELECT * FROM a WHERE (s1 OR s2 OR s3 OR s4 OR s5) AND g1 AND g2 AND g3 ORDER BY p_retailprice DESC, p_partkey LIMIT 12)
SELECT p_partkey, p_type, count(*) OVER (PARTITION BY p_type) AS in_module, (SELECT max(c) FROM (SELECT count(*) AS c FROM k GROUP BY p_type)) <= 4 AS spread FROM k""")
def o173_shortlist(t: Tables) -> DataFrame:
    """Twelve parts by price that pass, and whether they spread over types."""
    s = decide.shortlist(_assessed(t), [F.desc("p_retailprice"), F.asc("p_partkey")], 12, "p_type")
    return s.select("p_partkey", "p_type", "in_module", "spread")


_PAIRS = "SELECT l_partkey AS a, l_suppkey + 1000000 AS b, sum(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2"


def _pairs(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).agg(F.sum("l_extendedprice").alias("score"))


@query()
def o177_balanced_pairs(t: Tables) -> DataFrame:
    """Sixty part-supplier pairs by price with at most two for each end."""
    return decide.balanced_pairs(_pairs(t), 60, 2)


@query(f"SELECT a, b, round(score, 2) AS score FROM ({_PAIRS}) ORDER BY score DESC, a, b LIMIT 50")
def o177_top_pairs(t: Tables) -> DataFrame:
    return _pairs(t).orderBy(F.desc("score"), "a", "b").limit(50).withColumn("score", r("score", 2))


@query("SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', o_custkey, o_orderkey, o_orderpriority, o_orderstatus)), 1, 13) AS BIGINT)) AS VARCHAR) AS hash FROM orders")
def o181_fingerprint_rows(t: Tables) -> DataFrame:
    """The fingerprint of the orders, the same in another order and partitioning."""
    x = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    other = x.repartition(5, "o_orderpriority").orderBy(F.desc("o_orderkey"))
    return tables.portable_fingerprint(x).join(tables.portable_fingerprint(other), ["rows", "hash"])


@query("""SELECT metric, registered, measured, coalesce(round(registered, 4) = round(measured, 4), false) AS holds FROM (VALUES ('orders', 15000::DOUBLE), ('mean_discount', 0.05::DOUBLE), ('lost', 1::DOUBLE)) g(metric, registered)
LEFT JOIN (SELECT 'orders' AS metric, CAST(count(*) AS DOUBLE) AS measured FROM orders UNION ALL SELECT 'mean_discount', round(avg(l_discount), 6) FROM lineitem) USING (metric)""")
def o182_drift(t: Tables) -> DataFrame:
    """Registered metrics against recomputed ones; one isn't computed any more."""
    registry = t._spark.createDataFrame([("orders", 15000.0), ("mean_discount", 0.05), ("lost", 1.0)], "metric string, registered double")
    metrics = t.orders.agg(F.count("*").cast("double").alias("measured")).select(F.lit("orders").alias("metric"), "measured").unionByName(t.lineitem.agg(r(F.avg("l_discount")).alias("measured")).select(F.lit("mean_discount").alias("metric"), "measured"))
    return decide.drift(registry, metrics, 4)


@query("""WITH x AS (SELECT p_partkey, [CASE WHEN p_size > 45 THEN 'large' END, CASE WHEN p_retailprice > 1050 THEN 'dear' END, CASE WHEN p_type = 'PROMO' THEN 'promo' END] AS o, p_retailprice > 950 AS eligible FROM part)
SELECT p_partkey, array_to_string(list_filter(o, lambda v: v IS NOT NULL), ',') AS observations, eligible FROM x""")
def o176_observations(t: Tables) -> DataFrame:
    """Rule-based observations of each part, and whether the price rules apply to it."""
    rules = F.array_compact(F.array(F.when(F.col("p_size") > 45, "large"), F.when(F.col("p_retailprice") > 1050, "dear"), F.when(F.col("p_type") == "PROMO", "promo")))
    return t.part.select("p_partkey", F.array_join(rules, ",").alias("observations"), (F.col("p_retailprice") > 950).alias("eligible"))
