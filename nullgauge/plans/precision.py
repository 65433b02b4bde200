"""Nulls of many draws, rewired graphs, long paths and neighbourhoods kept by a smaller space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import features, graph, nulls
from ..operators.draws import key, saved
from .base import Tables, query, r
from .calibration import _CONTROL, _SCREEN, _U32
from .graphs import _EDGES, _edges

_TOP = _SCREEN + f""", ts AS (SELECT n, draw, slot, sum(ln(({_U32.format("'top:' || n || ':' || draw || ':' || slot")} + 0.5) / 4294967296.0) / (n - slot + 1)) OVER (PARTITION BY n, draw ORDER BY slot) AS u FROM g, range(4000) d(draw), range(1, 4) s(slot) WHERE slot <= n
), tp AS (SELECT n, draw, avg(v) AS stat FROM ts JOIN pool ON pos = least(CAST(floor(exp(u) * (SELECT count(*) FROM pool)) AS BIGINT), (SELECT count(*) FROM pool) - 1) GROUP BY 1, 2
), tn AS (SELECT n, avg(stat) AS m, stddev_samp(stat) AS sd, quantile_cont(stat, 0.95) AS p95, quantile_cont(stat, 0.99) AS p99 FROM tp GROUP BY 1
), tv AS (SELECT n AS n0, m AS m0, sd AS s0, lead(n) OVER w AS n1, lead(m) OVER w AS m1, lead(sd) OVER w AS s1 FROM tn WINDOW w AS (ORDER BY n)
), tz AS (SELECT entity, n, score, m0 + (ln(n) - ln(n0)) / (ln(n1) - ln(n0)) * (m1 - m0) AS null_mean, s0 + (ln(n) - ln(n0)) / (ln(n1) - ln(n0)) * (s1 - s0) AS null_sd
  FROM s JOIN tv ON n1 IS NOT NULL AND n >= n0 AND (n < n1 OR n = n1 AND n1 = (SELECT hi FROM e)))"""


def _top_null(t: Tables, scored: DataFrame) -> DataFrame:
    return nulls.fit_top_null(t.orders.filter(_CONTROL), "o_totalprice", ("o_orderkey",), nulls.default_grid(scored))


@query(_TOP + " SELECT n, round(m, 4) AS null_mean, round(sd, 4) AS null_sd, round(p95, 4) AS p95, round(p99, 4) AS p99 FROM tn")
def o102_top_null(t: Tables) -> DataFrame:
    """The null of the best three order prices with four thousand draws at each count, by order statistics."""
    scored = nulls.scores(t.orders, "o_custkey", "o_totalprice", "top_3_mean")
    return _top_null(t, scored).select("n", *[r(c, 4).alias(c) for c in ("null_mean", "null_sd", "p95", "p99")])


@query(_TOP + " SELECT entity, n, round(score, 4) AS score, round(null_mean, 4) AS null_mean, round(null_sd, 4) AS null_sd, round((score - null_mean) / null_sd, 6) AS z FROM tz")
def r01_precise_screen(t: Tables) -> DataFrame:
    """Customers' best three order prices, calibrated by a null of four thousand draws."""
    scored = saved(nulls.scores(t.orders, "o_custkey", "o_totalprice", "top_3_mean"))
    z = nulls.calibrate(scored, saved(_top_null(t, scored)))
    return z.select("entity", "n", r("score", 4).alias("score"), r("null_mean", 4).alias("null_mean"), r("null_sd", 4).alias("null_sd"), r("z").alias("z"))


@query(_EDGES + f""", st AS (SELECT node, row_number() OVER (ORDER BY node, stub) - 1 AS pos FROM (SELECT node, unnest(range(1, degree + 1)) AS stub FROM d)
), ex AS (SELECT a.node AS src, b.node AS dst FROM (SELECT {_U32.format("'exp:a:' || i")} % (2 * n) AS a, {_U32.format("'exp:b:' || i")} % (2 * n) AS b FROM (SELECT unnest(range(count(*))) AS i, count(*) AS n FROM e)) x JOIN st a ON a.pos = x.a JOIN st b ON b.pos = x.b
), n1 AS (SELECT src, row_number() OVER (ORDER BY src, dst) AS pos FROM e), n2 AS (SELECT dst, row_number() OVER (ORDER BY md5('end:' || src || ':' || dst), src, dst) AS pos FROM e
), al AS (SELECT 'expected degree' AS variant, least(src, dst) AS src, greatest(src, dst) AS dst FROM ex UNION ALL SELECT 'permuted ends', least(src, dst), greatest(src, dst) FROM n1 JOIN n2 USING (pos)
), ct AS (SELECT variant, count(*) AS drawn, count(*) FILTER (src = dst) AS loops FROM al GROUP BY 1), kp AS (SELECT variant, count(*) AS kept FROM (SELECT DISTINCT variant, src, dst FROM al WHERE src <> dst) GROUP BY 1)
SELECT variant, drawn, loops, drawn - loops - kept AS doubles, kept FROM ct JOIN kp USING (variant)""")
def o118_rewirings(t: Tables) -> DataFrame:
    """Two more null graphs of the parts: by expected degree and by permuted far ends, with what they lose."""
    e = _edges(t)
    made = {"expected degree": graph.expected_degrees(e, "exp")[1], "permuted ends": graph.permuted_ends(e, "end")[1]}
    a, b = [x.select(F.lit(n).alias("variant"), "drawn", "loops", "doubles", "kept") for n, x in made.items()]
    return a.unionByName(b)


_PARTNERS = _EDGES + """, pt AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, md5('top:' || src || ':' || dst), dst) AS k FROM u) WHERE k = 1), pe AS (SELECT src, dst FROM pt UNION SELECT dst, src FROM pt
), tg AS (SELECT p_partkey AS node FROM part WHERE p_size <= 3 AND p_type = 'PROMO')"""


def _partner_edges(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), F.md5(key("top", F.col("src"), F.col("dst")).cast("binary")), "dst"))
    one = graph.both_ways(_edges(t)).withColumn("k", place).filter("k = 1").select("src", "dst")
    return saved(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())


def _six_hops(t: Tables) -> tuple[DataFrame, DataFrame]:
    targets = t.part.filter("p_size <= 3 AND p_type = 'PROMO'").select(F.col("p_partkey").alias("node"))
    return graph.meeting_paths(_partner_edges(t), t.part.select(F.col("p_partkey").alias("node")), targets)


@query(_PARTNERS + """, w AS (SELECT src AS source, [src, dst] AS path, dst AS here, 1 AS len FROM pe UNION ALL SELECT source, list_append(path, dst), dst, len + 1 FROM w JOIN pe ON pe.src = w.here WHERE len < 6 AND NOT list_contains(path, dst) AND w.here NOT IN (SELECT node FROM tg))
SELECT source, min(len) AS hops, count(*) AS paths, round(sum(pow(0.45, len)), 6) AS score FROM w WHERE here IN (SELECT node FROM tg) GROUP BY 1""")
def o162_six_hops(t: Tables) -> DataFrame:
    """Simple paths of up to six hops from every part to the small promotional ones, along each part's heaviest tie."""
    found, _ = _six_hops(t)
    return found.select("source", "hops", "paths", r("score").alias("score"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), d AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, 65), lambda i: pow(q.a[i] - e.a[i], 2))) AS da, list_sum(list_transform(range(1, 17), lambda i: pow(q.a[i] - e.a[i], 2))) AS db FROM v q JOIN v e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0
), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(da, 9), vec_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY round(db, 9), vec_id) AS rb FROM d)
SELECT query_id, count(*) FILTER (ra <= 10) AS shared, CAST(sum(greatest(ra - 10, 0)) AS BIGINT) AS penalty, round(1 - 2.0 * sum(greatest(ra - 10, 0)) / (10 * (2 * (SELECT count(*) FROM v) - 31)), 8) AS trust FROM k WHERE rb <= 10 GROUP BY 1""")
def o166_trustworthiness(t: Tables) -> DataFrame:
    """How far ten neighbours by the first sixteen components can be trusted to be near by all of them."""
    full = saved(t.embeddings.select("vec_id", "embedding"))
    x = features.trustworthiness(full, full.select("vec_id", F.slice("embedding", 1, 16).alias("embedding")), full.filter("vec_id % 50 = 0"), 10)
    return x.select("query_id", "shared", "penalty", r("trust", 8).alias("trust"))
