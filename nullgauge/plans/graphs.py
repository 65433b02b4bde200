"""Graph reports on co-occurrence graphs of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.draws import saved, u32
from .base import Tables, query, r

# parts that share orders; edges are pairs with at least one
_EDGES = """
WITH RECURSIVE m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem
), e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS w FROM m a JOIN m b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey GROUP BY 1, 2
), u AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e), d AS (SELECT src AS node, count(*) AS degree, sum(w) AS strength FROM u GROUP BY 1)
"""


def _edges(t: Tables) -> DataFrame:
    return saved(graph.co_occurrence(t.lineitem, "l_orderkey", "l_partkey"))


@query(_EDGES + "SELECT src, dst, w FROM e")
def o042_co_occurrence(t: Tables) -> DataFrame:
    return _edges(t)


@query(_EDGES + "SELECT count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(avg(degree), 6) AS mean_degree, quantile_cont(degree, 0.5) AS median_degree, max(degree) AS max_degree, round(sum(degree) / CAST(count(*) * (count(*) - 1) AS DOUBLE), 9) AS density FROM d")
def o145_graph_summary(t: Tables) -> DataFrame:
    s = graph.summary(_edges(t))
    return s.withColumns({"mean_degree": r("mean_degree"), "density": r("density", 9)})


@query()
def o146_components(t: Tables) -> DataFrame:
    return graph.component_labels(_edges(t)).groupBy("component").agg(F.count("*").alias("n"))


@query(_EDGES + """, tr AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst), n AS (SELECT node, count(*) AS t FROM (SELECT unnest([x, y, z]) AS node FROM tr) GROUP BY 1)
SELECT node, degree, coalesce(t, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM d LEFT JOIN n USING (node)""")
def o147_clustering(t: Tables) -> DataFrame:
    return graph.triangles(_edges(t)).withColumn("clustering", r("clustering"))


@query(_EDGES + """, l AS (SELECT node, node % 10 AS label FROM d), q AS (SELECT CAST(sum(w) AS DOUBLE) AS m, sum(w) FILTER (a.label = b.label) AS own FROM e JOIN l a ON a.node = src JOIN l b ON b.node = dst), k AS (SELECT sum(pow(k, 2)) AS kk FROM (SELECT label, CAST(sum(strength) AS DOUBLE) AS k FROM d JOIN l USING (node) GROUP BY 1))
SELECT round(coalesce(own, 0) / m - kk / (4 * m * m), 8) AS modularity FROM q, k""")
def o148_modularity(t: Tables) -> DataFrame:
    e = _edges(t)
    labels = graph.degrees(e).select("node", (F.col("node") % 10).alias("label"))
    return graph.modularity(e, labels).select(r("modularity", 8).alias("modularity"))


@query()
def o149_label_propagation(t: Tables) -> DataFrame:
    """Communities of the part graph: nodes, their label and the label's size."""
    labels = graph.label_propagation(_edges(t))
    return labels.withColumn("size", F.count("*").over(Window.partitionBy("label")))


@query("""WITH x AS (SELECT p_partkey AS node, p_size // 10 AS la, p_type AS lb FROM part), c AS (SELECT la, lb, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY 1, 2), s AS (SELECT sum(c * (c - 1) / 2) AS s, sum(c) AS n FROM c
), a AS (SELECT sum(c * (c - 1) / 2) AS ra FROM (SELECT la, sum(c) AS c FROM c GROUP BY 1)), b AS (SELECT sum(c * (c - 1) / 2) AS rb FROM (SELECT lb, sum(c) AS c FROM c GROUP BY 1))
SELECT round((s - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)), 8) AS ari FROM s, a, b""")
def o150_adjusted_rand(t: Tables) -> DataFrame:
    a = t.part.select(F.col("p_partkey").alias("node"), F.floor(F.col("p_size") / 10).alias("label"))
    b = t.part.select(F.col("p_partkey").alias("node"), F.col("p_type").alias("label"))
    return graph.adjusted_rand(a, b).select(r("ari", 8).alias("ari"))


@query("""WITH x AS (SELECT p_size // 10 AS la, p_type AS lb, count(*) AS c FROM part GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY la ORDER BY c DESC, lb) AS r FROM x WHERE c >= 20)
SELECT la, lb, c, r = 1 AS matched FROM k""")
def o154_partition_flow(t: Tables) -> DataFrame:
    """Flows between two partitions above a floor, and each group's largest one."""
    x = t.part.groupBy(F.floor(F.col("p_size") / 10).alias("la"), F.col("p_type").alias("lb")).agg(F.count("*").alias("c")).filter("c >= 20")
    place = F.row_number().over(Window.partitionBy("la").orderBy(F.desc("c"), "lb"))
    return x.select("la", "lb", "c", (place == 1).alias("matched"))


@query()
def o156_random_walk(t: Tables) -> DataFrame:
    """Walks with restart, sixty steps, from the smallest parts of three types at once."""
    e = _edges(t)
    seeds = t.part.filter("p_size <= 3 AND p_type IN ('ECONOMY', 'PROMO', 'STANDARD')").select(F.col("p_type").alias("seed_set"), F.col("p_partkey").alias("node"))
    return graph.random_walk(e, seeds.join(graph.degrees(e).select("node"), "node", "left_semi"), restart=0.3, steps=60).withColumn("score", r("score", 9))


@query(_EDGES + """, n AS (SELECT l_partkey AS node, count(*) AS own FROM m GROUP BY 1)
SELECT src, dst, round(u.w / CAST(n.own AS DOUBLE), 6) AS affinity, round((u.w / CAST(n.own AS DOUBLE) + u.w / CAST(o.own AS DOUBLE)) / 2, 6) AS symmetric FROM u JOIN n ON n.node = src JOIN n o ON o.node = dst""")
def o158_asymmetric_affinity(t: Tables) -> DataFrame:
    """Shared orders over an end's own orders, and the mean of both directions."""
    own = t.lineitem.select("l_orderkey", "l_partkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("own"))
    u = graph.both_ways(_edges(t)).join(own.select(F.col("l_partkey").alias("src"), F.col("own").alias("os")), "src").join(own.select(F.col("l_partkey").alias("dst"), F.col("own").alias("od")), "dst")
    a, b = F.col("w") / F.col("os"), F.col("w") / F.col("od")
    return u.select("src", "dst", r(a).alias("affinity"), r((a + b) / 2).alias("symmetric"))


@query("""WITH x AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS s, bool_or(l_returnflag = 'R') AS hit FROM lineitem GROUP BY 1, 2), k AS (
  SELECT *, row_number() OVER w AS place, sum(hit::INT) OVER (PARTITION BY l_suppkey ORDER BY s DESC, l_partkey ROWS UNBOUNDED PRECEDING) AS hits FROM x WINDOW w AS (PARTITION BY l_suppkey ORDER BY s DESC, l_partkey))
SELECT l_suppkey, count(*) AS hits, round(avg(hits / CAST(place AS DOUBLE)), 6) AS ap FROM k WHERE hit GROUP BY 1""")
def o160_average_precision(t: Tables) -> DataFrame:
    """Average precision of returned parts by quantity, in each supplier."""
    x = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("s"), F.bool_or(F.col("l_returnflag") == "R").alias("hit"))
    return graph.average_precision(x, "l_suppkey", "s", "hit", "l_partkey").withColumn("ap", r("ap"))


@query(_EDGES + """, st AS (SELECT node, unnest(range(1, degree + 1)) AS stub FROM d), k AS (SELECT node, row_number() OVER (ORDER BY md5('cfg:' || node || ':' || stub), node, stub) - 1 AS pos FROM st
), x AS (SELECT min(node) AS src, max(node) AS dst FROM k GROUP BY pos // 2 HAVING count(*) = 2)
SELECT (SELECT count(*) FROM x) AS drawn, count(*) AS kept, (SELECT count(*) FROM x) - count(*) AS lost FROM (SELECT DISTINCT src, dst FROM x WHERE src <> dst)""")
def o118_rewired(t: Tables) -> DataFrame:
    """A configuration-model graph of the same degrees, and the edges it loses."""
    return graph.rewired(_edges(t), "cfg")[1]


_TREE = """SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region"""


def _tree(t: Tables) -> DataFrame:
    def name(letter: str, c: str):
        return F.concat(F.lit(letter), F.col(c).cast("string"))

    return (
        t.customer.select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"))
        .unionByName(t.nation.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")))
        .unionByName(t.region.select(name("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")))
    )


@query(f"""WITH RECURSIVE t AS ({_TREE}), a(child, ancestor, depth) AS (SELECT child, parent, 1 FROM t UNION ALL SELECT a.child, t.parent, depth + 1 FROM a JOIN t ON t.child = a.ancestor) SELECT * FROM a""")
def o049_closure(t: Tables) -> DataFrame:
    """Every ancestor of customers, nations and regions with its distance."""
    return graph.closure(_tree(t), "child", "parent").withColumn("depth", F.col("depth").cast("int"))


@query("SELECT 'c' || c_custkey AS child, 'r' || n_regionkey AS root FROM customer JOIN nation ON c_nationkey = n_nationkey")
def o050_roots(t: Tables) -> DataFrame:
    """The top-level region of each customer, by closure and prefix."""
    a = graph.closure(_tree(t), "child", "parent")
    return a.filter(F.col("child").startswith("c") & F.col("ancestor").startswith("r")).select("child", F.col("ancestor").alias("root"))


@query(_EDGES + """, b0 AS (SELECT p_partkey AS node FROM part JOIN d ON node = p_partkey WHERE p_size <= 3 AND p_brand = 'Brand#7'), b1 AS (SELECT DISTINCT dst AS node FROM u WHERE src IN (SELECT node FROM b0)), b2 AS (SELECT DISTINCT dst AS node FROM u WHERE src IN (SELECT node FROM b1)), b3 AS (SELECT DISTINCT dst AS node FROM u WHERE src IN (SELECT node FROM b2))
SELECT node, min(hop) AS hop FROM (SELECT node, 0 AS hop FROM b0 UNION ALL SELECT node, 1 FROM b1 UNION ALL SELECT node, 2 FROM b2 UNION ALL SELECT node, 3 FROM b3) GROUP BY 1""")
def o163_reach(t: Tables) -> DataFrame:
    """Hops from the smallest parts of one brand, at most three."""
    e = _edges(t)
    start = t.part.filter("p_size <= 3 AND p_brand = 'Brand#7'").select(F.col("p_partkey").alias("node")).join(graph.degrees(e).select("node"), "node", "left_semi")
    return graph.hops(e, start, 3)


@query(f"""WITH x AS (SELECT p_partkey, CAST('0x' || substr(md5('fold:' || p_partkey), 1, 8) AS BIGINT) % 5 AS fold FROM part) SELECT fold, count(*) AS n FROM x GROUP BY 1""")
def deterministic_folds(t: Tables) -> DataFrame:
    """Folds by hash, the same on any partitioning."""
    return t.part.groupBy((u32("fold", F.col("p_partkey")) % 5).alias("fold")).agg(F.count("*").alias("n"))
