"""Composed reports on the test tables: several operators behind one result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import normal_sf, normal_sf_sql
from ..operators import decide, features, nulls, significance, tables
from ..operators.draws import numbered, saved
from ..operators.ranks import equal_count_bands, spearman
from .base import Tables, query, r
from .calibration import _U32, _ZP, _screen
from .decisions import _EVIDENCE, _assessed
from .effects import _REMOVED


@query("""WITH x AS (SELECT p_partkey, p_brand, p_type, quantile_cont(l_discount, 0.5) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), o AS (SELECT b AS p_brand, max(s) AS observed, sum(n) AS n FROM (SELECT p_brand AS b, p_type, avg(m) AS s, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1
), k AS (SELECT p_partkey, p_type, m, row_number() OVER (ORDER BY p_partkey) AS a FROM x), q AS (SELECT rep, p_brand, row_number() OVER (PARTITION BY rep ORDER BY md5('drug:' || rep || ':' || p_partkey), p_partkey) AS a FROM x, range(8) t(rep)
), g AS (SELECT rep, p_brand, max(s) AS s FROM (SELECT rep, q.p_brand, p_type, avg(m) AS s FROM q JOIN k USING (a) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT p_brand, CAST(n AS BIGINT) AS n, round(observed, 6) AS observed, round(avg(s), 6) AS null_mean, round(stddev_samp(s), 6) AS null_sd, round((1 + count(*) FILTER (s >= observed - 1e-12)) / 9.0, 6) AS p FROM o JOIN g USING (p_brand) GROUP BY 1, 2, o.observed""")
def r03_max_over_types(t: Tables) -> DataFrame:
    """Best type of a brand by its parts' median discounts, against brands permuted over parts."""
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey", "p_brand", "p_type").agg(F.percentile("l_discount", 0.5).alias("m"))
    x = saved(x)
    seen = x.groupBy("p_brand", "p_type").agg(F.avg("m").alias("s"), F.count("*").alias("n")).groupBy("p_brand").agg(F.max("s").alias("observed"), F.sum("n").alias("n"))
    many = nulls.label_permutations(x, ("p_partkey",), "p_brand", 8, "drug", keep=("p_type", "m"))
    each = many.groupBy("rep", "p_brand", "p_type").agg(F.avg("m").alias("s")).groupBy("rep", "p_brand").agg(F.max("s").alias("s"))
    out = seen.join(each, "p_brand").groupBy("p_brand", "n", "observed").agg(F.avg("s").alias("null_mean"), F.stddev_samp("s").alias("null_sd"), ((1 + F.count_if(F.col("s") >= F.col("observed") - 1e-12)) / 9.0).alias("p"))
    return out.select("p_brand", "n", *[r(c).alias(c) for c in ("observed", "null_mean", "null_sd", "p")])


@query(_REMOVED + f""", z AS (SELECT p_brand, sum(w * d) / sum(w) / sqrt(1 / sum(w)) AS z FROM w GROUP BY 1), v AS (SELECT *, 2 * {normal_sf_sql("abs(z)")} AS p FROM z JOIN r USING (p_brand)
), k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, p_brand) AS raw FROM v), q AS (SELECT *, least(min(raw) OVER (ORDER BY p DESC, p_brand DESC ROWS UNBOUNDED PRECEDING), 1) AS q FROM k)
SELECT p_brand, round(d_stratified, 6) AS d, round(p, 6) AS p, round(q, 6) AS q, q <= 0.5 AND abs(d_stratified) >= 0.01 AND removed < 0.5 AS shortlisted FROM q""")
def r07_stratified_effects(t: Tables) -> DataFrame:
    """Returned-price effects of brands pooled over nations, corrected over brands, and gated on what strata leave."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("p_brand", F.col("s_nationkey").alias("nation"), (F.col("l_returnflag") == "R").alias("arm"), F.col("l_extendedprice").alias("v"))
    naive = significance.two_group_effects(rows, ["p_brand"], "arm", "v")
    pooled = saved(significance.pooled_effects(significance.two_group_effects(rows, ["p_brand", "nation"], "arm", "v"), ["p_brand"]))
    c = significance.confound_measures(naive, pooled, ["p_brand"]).select("p_brand", "removed")
    x = pooled.join(c, "p_brand").withColumn("p", 2 * normal_sf(F.abs("z")))
    q = significance.benjamini_hochberg(x, "p", ident="p_brand")
    return q.select("p_brand", r("d").alias("d"), r("p").alias("p"), r("q").alias("q"), ((F.col("q") <= 0.5) & (F.abs("d") >= 0.01) & (F.col("removed") < 0.5)).alias("shortlisted"))


@query("""WITH x AS (SELECT lang, source, (quality IS NOT NULL)::INT + (n_chars >= 200)::INT + (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT AS grade FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, source, count(*) AS n, round(avg(grade), 6) AS mean_grade, count(*) FILTER (grade = 4) AS complete FROM x GROUP BY GROUPING SETS ((lang), (lang, source))""")
def r10_evidence_profile(t: Tables) -> DataFrame:
    """Documents graded by how many of four layers they have, by language and by language and source."""
    x = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    parts = [F.col("quality").isNotNull(), F.col("n_chars") >= 200, F.col("lang").isNotNull(), F.col("source").isNotNull()]
    x = x.withColumn("grade", sum((p.cast("int") for p in parts[1:]), parts[0].cast("int")))
    lang, source = F.col("lang"), F.col("source")
    return x.groupingSets([[lang], [lang, source]], lang, source).agg(F.count("*").alias("n"), r(F.avg("grade")).alias("mean_grade"), F.count_if(F.col("grade") == 4).alias("complete"))


@query("""WITH x AS (SELECT n_regionkey AS region, l_partkey, l_linestatus || ':' || s_nationkey AS ctx, l_returnflag AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), i AS (SELECT region, l_partkey, ctx, count(DISTINCT v) AS k, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1, 2, 3
), p AS (SELECT region, l_partkey, max(k) AS k, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY 1, 2) SELECT region, count(*) AS items, round(avg((k > 1)::INT), 6) AS within_context, round(avg((k = 1 AND lo <> hi)::INT), 6) AS across_only FROM p GROUP BY 1""")
def r12_conflicts_by_region(t: Tables) -> DataFrame:
    """How parts' verdicts conflict inside a context and only across contexts, in each region."""
    x = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("ctx", F.concat_ws(":", "l_linestatus", F.col("s_nationkey").cast("string")))
    i = x.groupBy(F.col("n_regionkey").alias("region"), "l_partkey", "ctx").agg(F.count_distinct("l_returnflag").alias("k"), F.min("l_returnflag").alias("lo"), F.max("l_returnflag").alias("hi"))
    p = i.groupBy("region", "l_partkey").agg(F.max("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return p.groupBy("region").agg(F.count("*").alias("items"), r(F.avg((F.col("k") > 1).cast("int"))).alias("within_context"), r(F.avg(((F.col("k") == 1) & (F.col("lo") != F.col("hi"))).cast("int"))).alias("across_only"))


@query("""WITH x AS (SELECT source, quality = 0 AS exposed, toxic = 1 AS hit FROM documents JOIN labels USING (doc_id)), t AS (SELECT source, count(*) FILTER (exposed AND hit) AS a, count(*) FILTER (exposed AND NOT hit) AS b, count(*) FILTER (NOT exposed AND hit) AS c, count(*) FILTER (NOT exposed AND NOT hit) AS d FROM x GROUP BY 1
), l AS (SELECT *, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) AS y FROM t), p AS (SELECT source, a, y, -(lgamma(y + 1.0) + lgamma(a + b - y + 1.0) + lgamma(a + c - y + 1.0) + lgamma(d - a + y + 1.0)) AS lp FROM l
), w AS (SELECT *, max(lp) OVER (PARTITION BY source) AS top, max(CASE WHEN y = a THEN lp END) OVER (PARTITION BY source) AS own FROM p), f AS (SELECT source, sum(CASE WHEN lp <= own + 1e-7 THEN exp(lp - top) ELSE 0 END) / sum(exp(lp - top)) AS p FROM w GROUP BY 1
), k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, source) AS raw FROM f) SELECT source, a, b, c, d, round(p, 7) AS p, round(least(min(raw) OVER (ORDER BY p DESC, source DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS q FROM k JOIN t USING (source)""")
def r14_toxic_by_quality(t: Tables) -> DataFrame:
    """Bad quality by toxicity in each source: exact tests, corrected over sources."""
    x = t.documents.select("doc_id", "source").join(t.labels, "doc_id")
    two = saved(significance.two_by_two(x, ["source"], F.col("quality") == 0, F.col("toxic") == 1, F.lit(True)))
    f = significance.fisher_exact(two, ["source"]).withColumn("p", F.round("p", 12))
    q = significance.benjamini_hochberg(f, "p", ident="source")
    return q.select("source", "a", "b", "c", "d", r("p", 7).alias("p"), r("q").alias("q"))


_INFO = """WITH x AS (SELECT p_partkey AS e, p_brand, p_type, p_size // 10 AS cat FROM part), l AS (SELECT 'brand' AS scale, e, p_brand AS f FROM x UNION ALL SELECT 'type', e, p_type FROM x), k AS (SELECT e, cat, row_number() OVER (ORDER BY e) AS a FROM x
), s AS (SELECT rep, e, row_number() OVER (PARTITION BY rep ORDER BY md5('info:' || rep || ':' || e), e) AS a FROM x, range(6) t(rep)), y AS (SELECT -1 AS rep, e, cat FROM x UNION ALL SELECT s.rep, k.e, x.cat FROM s JOIN k USING (a) JOIN x ON x.e = s.e
), c AS (SELECT rep, scale, f, cat, count(*) AS c FROM l JOIN y USING (e) GROUP BY 1, 2, 3, 4), p AS (SELECT rep, scale, c / CAST(sum(c) OVER w AS DOUBLE) AS p, sum(c) OVER (PARTITION BY rep, scale, f) / CAST(sum(c) OVER w AS DOUBLE) AS pa, sum(c) OVER (PARTITION BY rep, scale, cat) / CAST(sum(c) OVER w AS DOUBLE) AS pb FROM c WINDOW w AS (PARTITION BY rep, scale)
), m AS (SELECT rep, scale, sum(p * log2(p / (pa * pb))) AS mi FROM p GROUP BY 1, 2)"""


@query(_INFO + " SELECT scale, round(max(mi) FILTER (rep = -1), 6) AS mi, round(avg(mi) FILTER (rep >= 0), 6) AS null_mean, round(max(mi) FILTER (rep = -1) - avg(mi) FILTER (rep >= 0), 6) AS excess, round((max(mi) FILTER (rep = -1) - avg(mi) FILTER (rep >= 0)) / stddev_samp(mi) FILTER (rep >= 0), 4) AS z FROM m GROUP BY 1")
def r15_excess_information(t: Tables) -> DataFrame:
    """Information between brands or types and size classes, over what permuted sizes give."""
    x = saved(t.part.select("p_partkey", "p_brand", "p_type", F.floor(F.col("p_size") / 10).alias("cat")))
    many = nulls.label_permutations(x, ("p_partkey",), "cat", 6, "info", keep=("p_brand", "p_type"))
    cats = many.select("rep", "p_brand", "p_type", "cat").unionByName(x.select(F.lit(-1).alias("rep"), "p_brand", "p_type", "cat"))
    scales = F.explode(F.array(*[F.struct(F.lit(n).alias("scale"), F.col(c).alias("f")) for n, c in (("brand", "p_brand"), ("type", "p_type"))])).alias("s")
    counted = cats.groupBy("rep", "p_brand", "p_type", "cat").agg(F.count("*").cast("double").alias("w")).select("rep", "cat", "w", scales).select("rep", "cat", "w", "s.scale", "s.f")
    m = tables.mutual_information(counted, "f", "cat", "w", "rep", "scale")
    real, null = F.max(F.when(F.col("rep") == -1, F.col("mi"))), F.when(F.col("rep") >= 0, F.col("mi"))
    out = m.groupBy("scale").agg(real.alias("mi"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("sd"))
    return out.select("scale", r("mi").alias("mi"), r("null_mean").alias("null_mean"), r(F.col("mi") - F.col("null_mean")).alias("excess"), r((F.col("mi") - F.col("null_mean")) / F.col("sd"), 4).alias("z"))


@query("""WITH x AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) / CAST(count(*) OVER () AS DOUBLE) AS a, row_number() OVER (ORDER BY p_retailprice, p_partkey) / CAST(count(*) OVER () AS DOUBLE) AS b FROM part), c AS (SELECT least(CAST(floor(a * 8) AS INT), 7) AS i, least(CAST(floor(b * 8) AS INT), 7) AS j, count(*) AS n FROM x GROUP BY 1, 2)
SELECT count(*) AS occupied, 64 - count(*) AS empty, max(n) AS fullest, round((SELECT corr(a, b) FROM x), 6) AS corr FROM c""")
def r16_knowledge_lattice(t: Tables) -> DataFrame:
    """Occupied cells of parts by the fractional ranks of size and price."""
    a = numbered(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_partkey", name="i")
    b = numbered(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", name="j").select("p_partkey", "j")
    n = b.count()
    x = saved(a.join(b, "p_partkey").select(((F.col("i") + 1) / n).alias("a"), ((F.col("j") + 1) / n).alias("b")))
    cells = x.groupBy(tables.bins(F.col("a"), 8).alias("i"), tables.bins(F.col("b"), 8).alias("j")).agg(F.count("*").alias("n"))
    return cells.agg(F.count("*").alias("occupied"), (64 - F.count("*")).alias("empty"), F.max("n").alias("fullest")).crossJoin(x.agg(r(F.corr("a", "b")).alias("corr")))


@query("""WITH c AS (SELECT s_suppkey, s_acctbal AS balance, count(*) AS lines FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2), k AS (SELECT *, rank() OVER (ORDER BY lines) + (count(*) OVER (PARTITION BY lines) - 1) / 2.0 AS a, rank() OVER (ORDER BY balance) + (count(*) OVER (PARTITION BY balance) - 1) / 2.0 AS b, row_number() OVER (ORDER BY lines, s_suppkey) - 1 AS pos, count(*) OVER () AS n FROM c
), t AS (SELECT *, least(pos // greatest(n // 3, 1), 2) AS tercile FROM k) SELECT CAST(tercile AS INT) AS tercile, count(*) AS suppliers, round(quantile_cont(balance, 0.5), 4) AS median_balance, round((SELECT corr(a, b) FROM k), 6) AS rho FROM t GROUP BY 1""")
def r18_attention(t: Tables) -> DataFrame:
    """Suppliers' balances by terciles of their lines, and the rank correlation of both."""
    c = saved(t.supplier.join(t.lineitem, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_suppkey", F.col("s_acctbal").alias("balance")).agg(F.count("*").alias("lines")))
    rho = spearman(c, "lines", "balance").select(r("rho").alias("rho"))
    bands = equal_count_bands(c, "lines", "s_suppkey", 3)
    return bands.groupBy(F.col("band").alias("tercile")).agg(F.count("*").alias("suppliers"), r(F.percentile("balance", 0.5), 4).alias("median_balance")).crossJoin(rho)


@query(f"""WITH m AS (SELECT o_custkey AS u, c_mktsegment AS seg, o_orderpriority AS cat, max(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3), w AS (SELECT seg, u, cat, v / sum(v) OVER (PARTITION BY u) AS w FROM m
), s AS (SELECT seg, cat, sum(w) AS weight FROM w GROUP BY 1, 2), k AS (SELECT *, weight / sum(weight) OVER (PARTITION BY seg) AS share, row_number() OVER (PARTITION BY seg ORDER BY weight DESC, cat) AS place FROM s)
SELECT seg AS segment, cat AS category, round(weight, 4) AS weight, round(share, 6) AS share, place = 1 AS leading FROM k""")
def r20_composition(t: Tables) -> DataFrame:
    """Unit-weight composition of segments by order priority, each customer weighing 1."""
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    m = x.groupBy(F.col("o_custkey").alias("u"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("category")).agg(F.max("o_totalprice").alias("v"))
    w = m.withColumn("w", F.col("v") / F.sum("v").over(Window.partitionBy("u"))).groupBy("segment", "category").agg(F.sum("w").alias("weight"))
    by = Window.partitionBy("segment")
    return w.select("segment", "category", r("weight", 4).alias("weight"), r(F.col("weight") / F.sum("weight").over(by)).alias("share"), (F.row_number().over(by.orderBy(F.desc("weight"), "category")) == 1).alias("leading"))


@query(_ZP + """, t AS (SELECT edge, count(*) FILTER (z > edge) AS beyond, count(*) AS n FROM p, (VALUES (1.0), (1.5), (2.0), (2.5), (3.0)) e(edge) GROUP BY 1)
SELECT CAST(edge AS DOUBLE) AS edge, beyond, round(beyond / CAST(n AS DOUBLE), 8) AS share, round(beyond / CAST(n AS DOUBLE) / (""" + normal_sf_sql("CAST(edge AS DOUBLE)") + """), 4) AS ratio, round((SELECT quantile_cont(z * z, 0.5) FROM p) / 0.454936423, 5) AS lambda FROM t""")
def r22_tail_calibration(t: Tables) -> DataFrame:
    """Shares of z beyond five edges against the normal tail, and the inflation of the median square."""
    z, _ = _screen(t)
    x = saved(z.select("z"))
    edges = F.explode(F.array(*map(F.lit, (1.0, 1.5, 2.0, 2.5, 3.0)))).alias("edge")
    inflation = x.agg((F.percentile(F.col("z") ** 2, 0.5) / 0.454936423).alias("l"))
    s = x.select("z", edges).groupBy("edge").agg(F.count_if(F.col("z") > F.col("edge")).alias("beyond"), F.count("*").alias("n")).crossJoin(inflation)
    share = F.col("beyond") / F.col("n")
    return s.select("edge", "beyond", r(share, 8).alias("share"), r(share / normal_sf(F.col("edge")), 4).alias("ratio"), r("l", 5).alias("lambda"))


_NEAR = """{n} AS (SELECT query_id, vec_id FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(range(1, {d}), lambda i: pow(CAST(q.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE), 2))), 9), e.vec_id) AS k FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) WHERE k <= 10)"""


@query("WITH " + _NEAR.format(n="a", d=33) + ", " + _NEAR.format(n="b", d=65) + " SELECT a.query_id, count(*) FILTER (b.vec_id IS NOT NULL) AS common, round(count(*) FILTER (b.vec_id IS NOT NULL) / 10.0, 6) AS share FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.vec_id = b.vec_id GROUP BY 1")
def r25_shared_neighbours(t: Tables) -> DataFrame:
    """Neighbours that the first half of the components and all of them share, of the stated query set."""
    half = t.embeddings.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    full = t.embeddings.select("vec_id", "embedding")
    a = features.exact_neighbours(half, half.filter("vec_id % 50 = 0"), 10)
    b = features.exact_neighbours(full, full.filter("vec_id % 50 = 0"), 10)
    x = a.select("query_id", "vec_id").join(b.select("query_id", "vec_id", F.lit(True).alias("both")), ["query_id", "vec_id"], "left")
    return x.groupBy("query_id").agg(F.count("both").alias("common")).withColumn("share", r(F.col("common") / 10))


@query(f"""WITH e AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE)) AS v, row_number() OVER (ORDER BY md5('pick:' || vec_id), vec_id) AS k FROM embeddings), b AS (SELECT i, min(v[i]) AS lo, max(v[i]) AS hi FROM e, range(1, 65) t(i) GROUP BY 1
), s AS (SELECT slot, list({_U32.format("'hop:' || slot || ':' || i")} / 4294967296.0 * (hi - lo) + lo ORDER BY i) AS v FROM b, range(40) t(slot) GROUP BY 1), u AS (SELECT slot, min(list_sum(list_transform(range(1, 65), lambda i: pow(s.v[i] - e.v[i], 2)))) AS d FROM s, e GROUP BY 1
), w AS (SELECT q.vec_id, min(list_sum(list_transform(range(1, 65), lambda i: pow(q.v[i] - e.v[i], 2)))) AS d FROM e q, e WHERE q.k <= 40 AND q.vec_id <> e.vec_id GROUP BY 1)
SELECT round(sum(a) / (sum(a) + sum(b)), 6) AS hopkins FROM (SELECT (SELECT sum(sqrt(d)) FROM u) AS a, (SELECT sum(sqrt(d)) FROM w) AS b)""")
def o167_hopkins(t: Tables) -> DataFrame:
    """Hopkins statistic: nearest rows of forty evenly drawn points against those of forty drawn rows."""
    return features.hopkins(t.embeddings.select("vec_id", "embedding"), 64, 40, "hop", "pick").withColumn("hopkins", r("hopkins"))


@query("""WITH o AS (SELECT o_custkey AS c, count(*) AS orders, min(year(o_orderdate)) AS first_year, arg_max(o_orderpriority, (o_totalprice, o_orderkey)) AS top_priority, quantile_cont(o_totalprice, 0.5) AS median_price FROM orders GROUP BY 1), l AS (SELECT o_custkey AS c, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, c_mktsegment, n_name AS nation, orders, CAST(first_year AS INT) AS first_year, top_priority, round(median_price, 3) AS median_price, lines, suppliers FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o.c = c_custkey LEFT JOIN l ON l.c = c_custkey""")
def r27_customer_dossiers(t: Tables) -> DataFrame:
    """One wide record for each customer."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.min(F.year("o_orderdate")).alias("first_year"), F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("top_priority"), r(F.percentile("o_totalprice", 0.5), 3).alias("median_price"))
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"))
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", F.col("n_name").alias("nation"))
    return x.join(o, "c_custkey", "left").join(lines, "c_custkey", "left")


@query(_EVIDENCE + "SELECT p_type, count(*) AS parts, count(*) FILTER (s1 OR s2 OR s3 OR s4 OR s5) AS admitted, count(*) FILTER (g1 AND g2 AND g3) AS gated, count(*) FILTER ((s1 OR s2 OR s3 OR s4 OR s5) AND g1 AND g2 AND g3) AS both FROM a GROUP BY 1")
def r30_assessment_report(t: Tables) -> DataFrame:
    """Assessed parts of each type: admitted by a strategy, past all gates, and both."""
    a = _assessed(t)
    ok, past = F.exists("strategies", lambda s: s["admitted"]), F.forall("gates", lambda g: g["passed"])
    return a.groupBy("p_type").agg(F.count("*").alias("parts"), F.count_if(ok).alias("admitted"), F.count_if(past).alias("gated"), F.count_if(ok & past).alias("both"))


@query(_EVIDENCE + "SELECT p_partkey, s1::INT + s2::INT + s3::INT + s4::INT + s5::INT AS admitted, CAST((recurrent IS NULL)::INT + (lof IS NULL)::INT + (essential IS NULL)::INT + (dependent IS NULL)::INT + (unclear IS NULL)::INT AS INT) AS unknown FROM a ORDER BY coalesce(recurrent, -1) DESC, p_partkey LIMIT 25")
def o174_batch_assessment(t: Tables) -> DataFrame:
    """The twenty-five parts of most recurrent evidence with their assessment and unknown axes."""
    a = _assessed(t).orderBy(F.desc(F.coalesce("recurrent", F.lit(-1))), "p_partkey").limit(25)
    unknown = sum((F.col(c).isNull().cast("int") for c in ("lof", "essential", "dependent", "unclear")), F.col("recurrent").isNull().cast("int"))
    return a.select("p_partkey", F.size(F.filter("strategies", lambda s: s["admitted"])).alias("admitted"), unknown.alias("unknown"))


_PAIR_ROWS = "SELECT l_partkey AS a, l_suppkey + 1000000 AS b, sum(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2"


@query(f"""WITH p AS ({_PAIR_ROWS}), k AS (SELECT a, b, score, row_number() OVER (ORDER BY score DESC, a, b) AS place FROM p ORDER BY score DESC, a, b LIMIT 40) SELECT a, b, CAST({_U32.format("'split:' || a || ':' || b")} % 2 AS INT) AS half, CAST(place AS INT) AS place FROM k""")
def o179_split_budget(t: Tables) -> DataFrame:
    """The forty best pairs in two disjoint halves by hash."""
    p = t.lineitem.groupBy(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).agg(F.sum("l_extendedprice").alias("score"))
    return decide.split_budget(p, 40, "split").select("a", "b", "half", "place")


@query(f"""WITH p AS ({_PAIR_ROWS}), e AS (SELECT node, sum(score) AS s FROM (SELECT a AS node, score FROM p UNION ALL SELECT b, score FROM p) GROUP BY 1), f AS (SELECT node FROM e WHERE node < 1000000 ORDER BY round(s, 2) DESC, node LIMIT 6), g AS (SELECT node FROM e WHERE node >= 1000000 ORDER BY round(s, 2) DESC, node LIMIT 6)
SELECT a, b, round(score, 2) AS score FROM p WHERE a IN (SELECT node FROM f) AND b IN (SELECT node FROM g)""")
def o179_focused_pairs(t: Tables) -> DataFrame:
    """All pairs among the six strongest parts and the six strongest suppliers."""
    p = saved(t.lineitem.groupBy(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).agg(F.sum("l_extendedprice").alias("score")))
    return decide.focused_pairs(p, 6).withColumn("score", r("score", 2))
