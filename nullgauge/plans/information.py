"""Information, lattice and feature-space measures on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import features, tables
from .base import Tables, query, r

_MI = """
WITH x AS (SELECT p_partkey, {f} AS a, s_nationkey AS b FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
), u AS (SELECT a, b, 1.0 / count(*) OVER (PARTITION BY p_partkey) AS w FROM (SELECT DISTINCT * FROM x)
), c AS (SELECT a, b, sum(w) AS w FROM u GROUP BY 1, 2), m AS (SELECT w / sum(w) OVER () AS p, sum(w) OVER (PARTITION BY a) / sum(w) OVER () AS pa, sum(w) OVER (PARTITION BY b) / sum(w) OVER () AS pb FROM c)
SELECT '{n}' AS scale, round(sum(-p * log2(pa)), 6) AS h_a, round(sum(-p * log2(pb)), 6) AS h_b, round(sum(p * log2(p / (pa * pb))), 6) AS mi FROM m"""


@query(" UNION ALL ".join(f"SELECT * FROM ({_MI.format(f=f, n=n)})" for n, f in (("brand", "p_brand"), ("type", "p_type"))))
def o077_mutual_information(t: Tables) -> DataFrame:
    """Information between a part's brand or type and its suppliers' nations, each part weighing 1 in all."""
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    scales = F.explode(F.array(*[F.struct(F.lit(n).alias("scale"), F.col(c).alias("a")) for n, c in (("brand", "p_brand"), ("type", "p_type"))])).alias("s")
    long = x.select("p_partkey", F.col("s_nationkey").alias("b"), scales).select("p_partkey", "s.scale", "s.a", "b").distinct()
    weighted = long.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("scale", "p_partkey")))
    mi = tables.mutual_information(weighted, "a", "b", "w", "scale")
    return mi.select("scale", r("h_a").alias("h_a"), r("h_b").alias("h_b"), r("mi").alias("mi"))


@query("""WITH x AS (SELECT p_partkey, least(p_size // 10, 4) AS b1, least(CAST(floor((p_retailprice - 900) / 50) AS INT), 3) AS b2, CAST(p_partkey % 3 AS INT) AS b3 FROM part)
SELECT b1, b2, b3, count(*) AS n FROM x GROUP BY GROUPING SETS ((b1, b2, b3), (b1, b2), (b2, b3))""")
def o075_lattice(t: Tables) -> DataFrame:
    """Occupied cells of a lattice and of two of its faces."""
    x = t.part.select(F.least(F.floor(F.col("p_size") / 10), F.lit(4)).cast("int").alias("b1"), F.least(F.floor((F.col("p_retailprice") - 900) / 50), F.lit(3)).cast("int").alias("b2"), (F.col("p_partkey") % 3).cast("int").alias("b3"))
    b1, b2, b3 = F.col("b1"), F.col("b2"), F.col("b3")
    return x.groupingSets([[b1, b2, b3], [b1, b2], [b2, b3]], b1, b2, b3).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT p_size AS a, CAST(replace(p_brand, 'Brand#', '') AS INT) AS b FROM part), n AS (SELECT count(*) AS n FROM x), pa AS (SELECT a, count(*) AS ca FROM x GROUP BY 1), pb AS (SELECT b, count(*) AS cb FROM x GROUP BY 1)
SELECT a, b, round(ca * cb / CAST(n AS DOUBLE), 6) AS expected FROM pa, pb, n WHERE ca * cb / CAST(n AS DOUBLE) >= 1.5 AND NOT EXISTS (SELECT 1 FROM x WHERE x.a = pa.a AND x.b = pb.b)""")
def o076_anti_forms(t: Tables) -> DataFrame:
    """Empty cells of size and brand whose independent expectation is at least 1.5; axes are value lists."""
    x = t.part.select(F.col("p_size").alias("a"), F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("b"))
    a, b = x.groupBy("a").agg(F.count("*").alias("ca")), x.groupBy("b").agg(F.count("*").alias("cb"))
    cells = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(x.agg(F.count("*").alias("n"))))
    expected = F.col("ca") * F.col("cb") / F.col("n")
    return cells.join(x, ["a", "b"], "left_anti").filter(expected >= 1.5).select("a", "b", r(expected).alias("expected"))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1), p AS (SELECT *, CAST(c + v + e AS DOUBLE) AS t FROM c)
SELECT user_id, round(1 + (CASE WHEN c > 0 THEN c / t * ln(c / t) ELSE 0 END + CASE WHEN v > 0 THEN v / t * ln(v / t) ELSE 0 END + CASE WHEN e > 0 THEN e / t * ln(e / t) ELSE 0 END) / ln(3), 6) AS anisotropy FROM p WHERE t > 0""")
def o081_anisotropy(t: Tables) -> DataFrame:
    """How unevenly a user's events spread over three kinds."""
    c = t.events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "view", "error")])
    return c.select("user_id", r(tables.anisotropy([F.col("click"), F.col("view"), F.col("error")])).alias("anisotropy")).filter("anisotropy IS NOT NULL")


@query("""SELECT least(CAST(floor(o_totalprice / 25000) AS INT), 19) AS bin, least(CAST(month(o_orderdate) - 1 AS INT), 11) AS m, count(*) AS n, round(avg(o_totalprice), 3) AS mean FROM orders GROUP BY 1, 2""")
def o082_grid_means(t: Tables) -> DataFrame:
    """A histogram in two directions with cell means."""
    b = F.least(F.floor(F.col("o_totalprice") / 25000), F.lit(19)).cast("int")
    return t.orders.groupBy(b.alias("bin"), (F.month("o_orderdate") - 1).alias("m")).agg(F.count("*").alias("n"), r(F.avg("o_totalprice"), 3).alias("mean"))


@query("""WITH m AS (SELECT label, i, avg(embedding[i]) AS v FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), k AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY v DESC, i) AS r FROM m)
SELECT label, round(avg(v), 6) AS score FROM k WHERE r <= 3 GROUP BY 1""")
def o055_top_feature_means(t: Tables) -> DataFrame:
    """Mean of a label's three largest component means."""
    m = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    k = m.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("v"), "i")))
    return k.filter("r <= 3").groupBy("label").agg(r(F.avg("v")).alias("score"))


@query("""WITH m AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS mu, stddev_samp(CAST(embedding[i] AS DOUBLE)) AS sd FROM embeddings, range(1, 65) t(i) GROUP BY 1)
SELECT vec_id, round(sum(pow((CAST(embedding[i] AS DOUBLE) - mu) / sd, 2)), 4) AS norm2 FROM embeddings, m GROUP BY 1""")
def o165_standardised(t: Tables) -> DataFrame:
    """Squared length of each vector in standardised components."""
    z = features.standardised(t.embeddings, "vec_id", "embedding")
    return z.groupBy("vec_id").agg(r(F.sum(F.col("z") ** 2), 4).alias("norm2"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, 65), lambda i: pow(CAST(q.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE), 2))) AS d FROM q JOIN embeddings e ON q.vec_id <> e.vec_id
), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS r FROM d) SELECT query_id, vec_id, CAST(r AS INT) AS rank FROM k WHERE r <= 5""")
def o166_exact_neighbours(t: Tables) -> DataFrame:
    """Five nearest vectors of a stated query set, in blocks."""
    return features.exact_neighbours(t.embeddings.select("vec_id", "embedding"), t.embeddings.filter("vec_id % 50 = 0").select("vec_id", "embedding"), 5)
