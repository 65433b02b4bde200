"""Pools, subgroup contrasts, exact tests, gates and calibration reports on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import normal_sf, normal_sf_sql
from ..operators import nulls, significance
from ..operators.draws import numbered, replicates, saved, u32
from ..operators.ranks import tie_ranks
from .base import Tables, query, r
from .calibration import _SCREEN, _U32, _ZP, _effects, _screen

_VECTORS = """WITH f AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)
), pool AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings WHERE label IN (0, 1, 2, 3)
), sc AS (SELECT entity, list_sum(list_reverse_sort(list(m))[1:3]) / 3 AS score, max(n) AS n FROM (SELECT label AS entity, i, avg(x) AS m, count(*) AS n FROM f WHERE label > 3 GROUP BY 1, 2) GROUP BY 1
)"""


def _mean_null(t: Tables, grid: list[int], draws: int, seed: str) -> DataFrame:
    scored = nulls.top_feature_scores(t.embeddings.filter("label > 3"), "label", "embedding", 64)
    return nulls.fit_mean_null(t.embeddings.filter("label <= 3"), "vec_id", "embedding", scored.filter(F.col("n") >= 1).select(F.lit(grid[0]).alias("n")), draws=draws, seed=seed, grid=grid)


@query(_VECTORS + f""", d AS (SELECT n, draw, {_U32.format("'mean:' || n || ':' || draw || ':' || slot")} % (SELECT count(*) FROM pool) AS pos FROM (SELECT n, draw, unnest(range(n)) AS slot FROM (VALUES (1), (4), (16)) g(n), range(60) t(draw))
), m AS (SELECT n, draw, i, avg(x) AS m FROM d JOIN pool USING (pos) JOIN f USING (vec_id) GROUP BY 1, 2, 3), st AS (SELECT n, draw, list_sum(list_reverse_sort(list(m))[1:3]) / 3 AS s FROM m GROUP BY 1, 2)
SELECT CAST(n AS BIGINT) AS n, round(avg(s), 6) AS null_mean, round(stddev_samp(s), 6) AS null_sd, round(quantile_cont(s, 0.95), 6) AS p95 FROM st GROUP BY 1""")
def o102_mean_null(t: Tables) -> DataFrame:
    """Best three feature means of n vectors drawn from control labels."""
    null = _mean_null(t, [1, 4, 16], 60, "mean")
    return null.select("n", *[r(c).alias(c) for c in ("null_mean", "null_sd", "p95")])


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd FROM events WHERE event_type = 'error'")
def o108_baseline_pool(t: Tables) -> DataFrame:
    return nulls.baseline_pool(t.events, "event_type", "error", "value").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean_value"), r(F.stddev_samp("value")).alias("sd"))


@query("SELECT 'pooled over all variants: good ones are part of this null' AS caveat, count(*) AS n, count(DISTINCT event_type) AS variants, round(quantile_cont(value, 0.5), 6) AS median_value FROM events")
def o109_permutation_pool(t: Tables) -> DataFrame:
    pool = nulls.permutation_pool(t.events, "value")
    return pool.groupBy("caveat").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("variants"), r(F.percentile("value", 0.5)).alias("median_value"))


@query(f"""WITH s AS (SELECT user_id AS entity, count(*) AS n, max(value) AS score FROM events GROUP BY 1), e AS (SELECT greatest(min(n), 1) AS lo, greatest(max(n), greatest(min(n), 1) + 1) AS hi FROM s
), g AS (SELECT CAST(round(lo * pow(hi / lo, i / 13.0)) AS BIGINT) AS n FROM e, range(14) t(i) UNION SELECT lo FROM e UNION SELECT hi FROM e
), pool AS (SELECT value AS v, row_number() OVER (ORDER BY value, event_id) - 1 AS pos FROM events WHERE event_type = 'error'
), d AS (SELECT n, draw, {_U32.format("'board:' || n || ':' || draw || ':' || slot")} % (SELECT count(*) FROM pool) AS pos FROM (SELECT n, draw, unnest(range(n)) AS slot FROM g, range(100) t(draw))
), nul AS (SELECT n, avg(stat) AS m, stddev_samp(stat) AS sd FROM (SELECT n, draw, max(v) AS stat FROM d JOIN pool USING (pos) GROUP BY 1, 2) GROUP BY 1
), iv AS (SELECT n AS n0, m AS m0, sd AS s0, lead(n) OVER w AS n1, lead(m) OVER w AS m1, lead(sd) OVER w AS s1 FROM nul WINDOW w AS (ORDER BY n)
), z AS (SELECT entity, n, score, m0 + (ln(n) - ln(n0)) / (ln(n1) - ln(n0)) * (m1 - m0) AS mu, s0 + (ln(n) - ln(n0)) / (ln(n1) - ln(n0)) * (s1 - s0) AS sd FROM s JOIN iv ON n1 IS NOT NULL AND n >= n0 AND (n < n1 OR n = n1 AND n1 = (SELECT hi FROM e)))
SELECT entity, n, round(score, 6) AS score, round(CASE WHEN sd > 0 THEN (score - mu) / sd END, 5) AS z FROM z""")
def r05_leaderboard(t: Tables) -> DataFrame:
    """Best value of each user over all events, calibrated by the error events at the user's own number of events."""
    scored = nulls.scores(t.events, "user_id", "value", "best_of_n")
    pool = nulls.baseline_pool(t.events, "event_type", "error", "value")
    null = saved(nulls.fit_null(pool, "value", ("value", "event_id"), nulls.default_grid(scored), "best_of_n", draws=100, seed="board"))
    return nulls.calibrate(scored, null).select("entity", "n", r("score").alias("score"), r("z", 5).alias("z"))


@query(_VECTORS + f""", d AS (SELECT n, draw, {_U32.format("'cells:' || n || ':' || draw || ':' || slot")} % (SELECT count(*) FROM pool) AS pos FROM (SELECT n, draw, unnest(range(n)) AS slot FROM (VALUES (1), (8), (512)) g(n), range(20) t(draw))
), m AS (SELECT n, draw, i, avg(x) AS m FROM d JOIN pool USING (pos) JOIN f USING (vec_id) GROUP BY 1, 2, 3), st AS (SELECT n, draw, list_sum(list_reverse_sort(list(m))[1:3]) / 3 AS s FROM m GROUP BY 1, 2
), nul AS (SELECT n, avg(s) AS m, stddev_samp(s) AS sd FROM st GROUP BY 1), iv AS (SELECT n AS n0, m AS m0, sd AS s0, lead(n) OVER w AS n1, lead(m) OVER w AS m1, lead(sd) OVER w AS s1 FROM nul WINDOW w AS (ORDER BY n)
)
SELECT CAST(entity AS INT) AS entity, n, round(score, 6) AS score, round((score - (m0 + (ln(n) - ln(n0)) / (ln(n1) - ln(n0)) * (m1 - m0))) / (s0 + (ln(n) - ln(n0)) / (ln(n1) - ln(n0)) * (s1 - s0)), 4) AS z FROM sc JOIN iv ON n1 IS NOT NULL AND n >= n0 AND n < n1""")
def r04_cell_screen(t: Tables) -> DataFrame:
    """Labels by their best three feature means, calibrated at their number of vectors by control labels."""
    scored = nulls.top_feature_scores(t.embeddings.filter("label > 3"), "label", "embedding", 64)
    null = nulls.fit_mean_null(t.embeddings.filter("label <= 3"), "vec_id", "embedding", scored.select("n"), draws=20, seed="cells", grid=nulls.spanning_grid([1, 8, 512], scored.select("n")))
    z = nulls.calibrate(scored, saved(null))
    return z.select("entity", "n", r("score").alias("score"), r("z", 4).alias("z"))


_PARTS_OF = "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem"


@query(f"""WITH m AS ({_PARTS_OF}), k AS (SELECT p_partkey, p_retailprice AS v, row_number() OVER (ORDER BY p_partkey) AS a FROM part
), x AS (SELECT rep, p_retailprice AS v, row_number() OVER (PARTITION BY rep ORDER BY md5('equal:' || rep || ':' || p_partkey), p_partkey) AS a FROM part, range(5) t(rep)
), q AS (SELECT rep, k.p_partkey AS p, x.v FROM x JOIN k USING (a)), g AS (SELECT rep, s, avg(v) AS score, count(*) AS n FROM m JOIN q USING (p) GROUP BY 1, 2)
SELECT n, count(*) AS draws, round(avg(score), 4) AS null_mean, round(stddev_samp(score), 4) AS null_sd FROM g GROUP BY 1 HAVING count(*) >= 20""")
def o110_equal_count_null(t: Tables) -> DataFrame:
    """Mean price of a supplier's parts with prices permuted over parts, pooled by the number of parts."""
    members = t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p_partkey"))
    null = nulls.equal_count_null(members, "p_partkey", "s", t.part.select("p_partkey", "p_retailprice"), "p_retailprice", 5, "equal")
    return null.select("n", "draws", r("null_mean", 4).alias("null_mean"), r("null_sd", 4).alias("null_sd"))


@query(f"""WITH n AS (SELECT DISTINCT count(*) AS n FROM orders GROUP BY o_custkey), d AS (SELECT n, draw, {_U32.format("'scatter:' || n || ':' || draw || ':' || slot")} % 20 AS bin FROM (SELECT n, draw, unnest(range(n)) AS slot FROM n, range(30) t(draw))
), c AS (SELECT n, draw, bin, count(*) AS c FROM d GROUP BY 1, 2, 3), a AS (SELECT n, draw, b.bin, coalesce(c, 0) AS c FROM (SELECT n, draw, bin FROM n, range(30) t(draw), range(20) u(bin)) b LEFT JOIN c USING (n, draw, bin)
), w AS (SELECT n, draw, bin, sum(c) OVER (PARTITION BY n, draw ORDER BY bin ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS run FROM a), m AS (SELECT n, draw, max(run) FILTER (bin <= 18) / CAST(n AS DOUBLE) / 0.1 AS ratio FROM w GROUP BY 1, 2)
SELECT n, round(avg(ratio), 6) AS null_mean, round(stddev_samp(ratio), 6) AS null_sd FROM m GROUP BY 1""")
def o115_scatter_null(t: Tables) -> DataFrame:
    """Clustering of as many evenly thrown points as customers have orders."""
    counts = t.orders.groupBy("o_custkey").count().select(F.col("count").alias("n")).distinct()
    null = nulls.scatter_null(counts, 20, 2, 30, "scatter")
    return null.select("n", r("null_mean").alias("null_mean"), r("null_sd").alias("null_sd"))


_FLOWS = "SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"


def _flows(t: Tables) -> DataFrame:
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("w"))


@query(f"""WITH e AS ({_FLOWS}), b AS (SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, coalesce(a.w, 0) AS w, coalesce(b.w, 0) AS v FROM e a FULL JOIN e b ON a.src = b.dst AND a.dst = b.src
), f AS (SELECT rep, src, dst, (w + v) / 2 + CASE WHEN {_U32.format("'turn:' || rep || ':' || least(src, dst) || ':' || greatest(src, dst)")} % 2 = 0 THEN 1 ELSE -1 END * (w - v) / 2 AS w FROM b, range(10) t(rep)
), o AS (SELECT rep, src, sum(w) AS w FROM f GROUP BY 1, 2), x AS (SELECT src, sum(w) AS w FROM e GROUP BY 1)
SELECT src, round(max(x.w), 4) AS observed, round(avg(o.w), 4) AS null_mean, round(stddev_samp(o.w), 4) AS null_sd FROM o JOIN x USING (src) GROUP BY 1""")
def o117_direction_flip(t: Tables) -> DataFrame:
    """What customers of a nation take, against flows whose directions are turned by hash."""
    e = saved(_flows(t))
    null = nulls.flipped_directions(e, "turn", 10).groupBy("rep", "src").agg(F.sum("w").alias("w"))
    out = null.join(e.groupBy("src").agg(F.sum("w").alias("observed")), "src")
    return out.groupBy("src").agg(r(F.max("observed"), 4).alias("observed"), r(F.avg("w"), 4).alias("null_mean"), r(F.stddev_samp("w"), 4).alias("null_sd"))


@query(_SCREEN + """, k AS (SELECT *, row_number() OVER (ORDER BY n, entity) - 1 AS pos, greatest((SELECT count(*) FROM z) // 10, 1) AS size FROM z), b AS (SELECT *, least(pos // size, 9) AS band FROM k), t AS (SELECT band, exp(avg(ln(null_sd))) AS trend FROM b GROUP BY 1)
SELECT entity, CAST(band AS INT) AS band, round(trend, 4) AS trend, round((score - null_mean) / exp(n / (n + 20.0) * ln(null_sd) + (1 - n / (n + 20.0)) * ln(trend)), 5) AS z_moderated FROM b JOIN t USING (band)""")
def o120_moderated(t: Tables) -> DataFrame:
    """z with each sd drawn towards the trend of its band of counts."""
    z, _ = _screen(t)
    m = nulls.moderated_z(saved(z.select("entity", "n", "score", "null_mean", "null_sd")), 20.0)
    return m.select("entity", "band", r("trend", 4).alias("trend"), r("z_moderated", 5).alias("z_moderated"))


@query("""WITH s AS (SELECT l_partkey AS entity, max(l_discount) AS score, count(*) AS n, min(l_discount) AS low FROM lineitem GROUP BY 1), c AS (SELECT max(l_discount) AS ceiling FROM lineitem)
SELECT entity, round(score, 6) AS score, score >= ceiling AS at_ceiling, low = score AS no_spread, score >= ceiling AND low = score AS censored FROM s, c""")
def o121_censoring(t: Tables) -> DataFrame:
    """Parts whose best discount is the largest one that occurs, and those without any spread below it."""
    s = t.lineitem.groupBy(F.col("l_partkey").alias("entity")).agg(F.max("l_discount").alias("score"), F.min("l_discount").alias("low"))
    x = s.crossJoin(F.broadcast(t.lineitem.agg(F.max("l_discount").alias("ceiling"))))
    top, flat = F.col("score") >= F.col("ceiling"), F.col("low") == F.col("score")
    return x.select("entity", r("score").alias("score"), top.alias("at_ceiling"), flat.alias("no_spread"), (top & flat).alias("censored"))


_SEGMENT_Z = _ZP.replace("SELECT entity, (score", "SELECT entity, c_mktsegment AS class, (score").replace(" AS p FROM z)", " AS p FROM z JOIN customer ON c_custkey = entity)")


@query(_SEGMENT_Z + """, k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, entity) AS raw FROM p), q AS (SELECT *, least(min(raw) OVER (ORDER BY p DESC, entity DESC ROWS UNBOUNDED PRECEDING), 1) AS q FROM k)
SELECT class, count(*) AS n, count(*) FILTER (q <= 0.01) AS at_1, count(*) FILTER (q <= 0.05) AS at_5, count(*) FILTER (p <= 0.05) AS nominal FROM q GROUP BY 1""")
def o125_counts_by_class(t: Tables) -> DataFrame:
    """Entities below each false discovery rate, by market segment."""
    z, _ = _screen(t)
    q = significance.benjamini_hochberg(z.select("entity", normal_sf(F.col("z")).alias("p")), "p")
    x = q.join(t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("class")), "entity")
    return x.groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("q") <= 0.01).alias("at_1"), F.count_if(F.col("q") <= 0.05).alias("at_5"), F.count_if(F.col("p") <= 0.05).alias("nominal"))


@query(_SCREEN + """, v AS (SELECT (score - null_mean) / null_sd AS x FROM z), m AS (SELECT count(*) AS n, avg(x) AS mu, stddev_pop(x) AS sd, quantile_cont(x, 0.5) AS med FROM v), b AS (SELECT avg(abs(x - med)) AS b, max(n) AS n FROM v, m)
SELECT model, round(aic, 4) AS aic, aic = min(aic) OVER () AS best FROM (SELECT 'normal' AS model, 4 + m.n * (ln(2 * pi() * sd * sd) + 1) AS aic FROM m UNION ALL SELECT 'laplace', 4 + 2 * n * (ln(2 * b) + 1) FROM b)""")
def o128_tail_models(t: Tables) -> DataFrame:
    """Normal and double-exponential fits of z by likelihood, with closed forms, and the better one."""
    z, _ = _screen(t)
    x = saved(z.select(F.col("z").alias("x")))
    m = x.agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sd"), F.percentile("x", 0.5).alias("med"))
    b = x.crossJoin(F.broadcast(m)).groupBy("n", "sd").agg(F.avg(F.abs(F.col("x") - F.col("med"))).alias("b"))
    n = F.col("n")
    fits = F.array(F.struct(F.lit("normal").alias("model"), (4 + n * (F.ln(2 * F.pi() * F.col("sd") ** 2) + 1)).alias("aic")), F.struct(F.lit("laplace").alias("model"), (4 + 2 * n * (F.ln(2 * F.col("b")) + 1)).alias("aic")))
    least = F.array_min(F.transform(fits, lambda f: f["aic"]))
    return b.select(F.explode(fits).alias("f"), least.alias("least")).select("f.model", r("f.aic", 4).alias("aic"), (F.col("f.aic") == F.col("least")).alias("best"))


@query("""WITH x AS (SELECT p_brand AS col, l_suppkey AS s, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT s_suppkey AS s, 'nation ' || s_nationkey AS grp FROM supplier UNION ALL SELECT s_suppkey, 'region ' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT grp, col, count(*) AS n, round(avg(v) / 1000, 3) AS mean, round(var_samp(v) / 1e6, 3) AS var FROM x JOIN m USING (s) GROUP BY 1, 2""")
def o057_group_moments(t: Tables) -> DataFrame:
    """Moments of every brand's prices in nations and in regions, which overlap."""
    values = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("col"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("v"))
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    members = s.select(F.col("s_suppkey").alias("s"), F.explode(F.array(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))).alias("grp"))
    m = significance.column_moments(values, members, "s", "grp", "col", "v")
    return m.select("grp", "col", "n", r(F.col("mean") / 1000, 3).alias("mean"), r(F.col("var") / 1e6, 3).alias("var"))


@query("""WITH x AS (SELECT source, lang = 'en' AS exposed, toxic = 1 AS hit FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)
SELECT source, count(*) FILTER (exposed AND hit) AS a, count(*) FILTER (exposed AND NOT hit) AS b, count(*) FILTER (NOT exposed AND hit) AS c, count(*) FILTER (NOT exposed AND NOT hit) AS d FROM x GROUP BY 1""")
def o058_two_by_two(t: Tables) -> DataFrame:
    """English by toxic in each source, over labelled documents only."""
    return _toxic_tables(t)


def _toxic_tables(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left")
    return significance.two_by_two(x, ["source"], F.col("lang") == "en", F.col("toxic") == 1, F.col("toxic").isNotNull())


@query("""WITH x AS (SELECT source, lang = 'en' AS exposed, toxic = 1 AS hit FROM documents JOIN labels USING (doc_id)), t AS (SELECT source, count(*) FILTER (exposed AND hit) AS a, count(*) FILTER (exposed AND NOT hit) AS b, count(*) FILTER (NOT exposed AND hit) AS c, count(*) FILTER (NOT exposed AND NOT hit) AS d FROM x GROUP BY 1
), l AS (SELECT *, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) AS y FROM t), p AS (SELECT source, a, y, -(lgamma(y + 1.0) + lgamma(a + b - y + 1.0) + lgamma(a + c - y + 1.0) + lgamma(d - a + y + 1.0)) AS lp FROM l
), w AS (SELECT *, max(lp) OVER (PARTITION BY source) AS top, max(CASE WHEN y = a THEN lp END) OVER (PARTITION BY source) AS own FROM p), f AS (SELECT source, sum(CASE WHEN lp <= own + 1e-7 THEN exp(lp - top) ELSE 0 END) / sum(exp(lp - top)) AS p FROM w GROUP BY 1)
SELECT source, round(a * d / CAST(nullif(b * c, 0) AS DOUBLE), 6) AS odds_ratio, round(p, 8) AS p FROM t JOIN f USING (source)""")
def o133_fisher(t: Tables) -> DataFrame:
    """Exact two-sided tests of those tables."""
    f = significance.fisher_exact(saved(_toxic_tables(t)), ["source"])
    return f.select("source", r(significance.odds_ratio()).alias("odds_ratio"), r("p", 8).alias("p"))


_ARMS = """WITH x AS (SELECT p_brand, s_nationkey AS nation, l_returnflag = 'R' AS arm, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), {m}"""
_M = "{name} AS (SELECT {by}, count(*) FILTER (arm) AS n1, count(*) FILTER (NOT arm) AS n0, avg(v) FILTER (arm) AS m1, avg(v) FILTER (NOT arm) AS m0, var_samp(v) FILTER (arm) AS v1, var_samp(v) FILTER (NOT arm) AS v0 FROM x GROUP BY {by})"
_REMOVED = _ARMS.format(m=_M.format(name="n", by="p_brand") + ", " + _M.format(name="s", by="p_brand, nation")) + """, d AS (SELECT p_brand, n1, n0, (m1 - m0) / sqrt((v1 + v0) / 2) AS d FROM s WHERE n1 >= 3 AND n0 >= 3), w AS (SELECT *, 1.0 / (CAST(n1 + n0 AS DOUBLE) / (n1 * n0) + d * d / (2.0 * (n1 + n0))) AS w FROM d
), p AS (SELECT p_brand, sum(w * d) / sum(w) AS d_stratified FROM w GROUP BY 1), r AS (SELECT p_brand, (m1 - m0) / sqrt((v1 + v0) / 2) AS d_naive, d_stratified, 1 - d_stratified / ((m1 - m0) / sqrt((v1 + v0) / 2)) AS removed FROM n JOIN p USING (p_brand))"""


@query(_REMOVED + " SELECT p_brand, round(d_naive, 6) AS d_naive, round(d_stratified, 6) AS d_stratified, round(removed, 3) AS removed, removed >= 0.5 AS proxy FROM r")
def o131_confounding(t: Tables) -> DataFrame:
    """Share of a brand's returned-price effect that nations explain."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("p_brand", F.col("s_nationkey").alias("nation"), (F.col("l_returnflag") == "R").alias("arm"), F.col("l_extendedprice").alias("v"))
    naive = significance.two_group_effects(rows, ["p_brand"], "arm", "v")
    pooled = significance.pooled_effects(significance.two_group_effects(rows, ["p_brand", "nation"], "arm", "v"), ["p_brand"])
    c = significance.confound_measures(naive, pooled, ["p_brand"])
    return c.select("p_brand", r("d_naive").alias("d_naive"), r("d_stratified").alias("d_stratified"), r("removed", 3).alias("removed"), "proxy")


@query(f"""WITH m AS ({_PARTS_OF}), n AS (SELECT s, count(*) AS n FROM m GROUP BY 1), t AS (SELECT s, n FROM n ORDER BY n DESC, s LIMIT 20), a AS (SELECT m.* FROM m JOIN t USING (s))
, c AS (SELECT a.s AS x, b.s AS y, count(*) AS c FROM a JOIN a b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2)
SELECT x, y, c AS common, round(c / CAST(tx.n + ty.n - c AS DOUBLE), 6) AS jaccard FROM c JOIN t tx ON tx.s = x JOIN t ty ON ty.s = y""")
def o132_overlaps(t: Tables) -> DataFrame:
    """Jaccard overlaps of the part sets of the twenty suppliers with the most parts."""
    m = t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    top = m.groupBy("s").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").limit(20)
    a = saved(m.join(F.broadcast(top), "s"))
    pairs = a.alias("a").join(a.alias("b"), (F.col("a.p") == F.col("b.p")) & (F.col("a.s") < F.col("b.s"))).groupBy(F.col("a.s").alias("x"), F.col("b.s").alias("y"), F.col("a.n").alias("nx"), F.col("b.n").alias("ny")).agg(F.count("*").alias("common"))
    return pairs.select("x", "y", "common", r(F.col("common") / (F.col("nx") + F.col("ny") - F.col("common"))).alias("jaccard"))


_Q = """, pv AS (SELECT p_brand, nation, d, 2 * {sf} AS p FROM e), k AS (SELECT *, p * count(*) OVER (PARTITION BY nation) / row_number() OVER (PARTITION BY nation ORDER BY p, p_brand) AS raw FROM pv
), q AS (SELECT *, least(min(raw) OVER (PARTITION BY nation ORDER BY p DESC, p_brand DESC ROWS UNBOUNDED PRECEDING), 1) AS q FROM k)""".replace("{sf}", normal_sf_sql("abs(t)"))


def _corrected(t: Tables) -> DataFrame:
    e = _effects(t).withColumn("p", 2 * normal_sf(F.abs("t")))
    return significance.benjamini_hochberg(e, "p", "nation", ident="p_brand")


def _effects_sql() -> str:
    from .calibration import _EFFECTS

    return _EFFECTS


@query(_effects_sql() + _Q + """, pool AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY abs(d) DESC, p_brand) AS place FROM q WHERE q <= 0.9 AND abs(d) >= 0.05)
SELECT nation, p_brand, q <= 0.5 AND abs(d) >= 0.1 AS hit, CAST(place AS INT) AS place FROM pool WHERE place <= 10 OR q <= 0.5 AND abs(d) >= 0.1""")
def o134_gated_shortlist(t: Tables) -> DataFrame:
    """Each nation's hits, and a wider candidate pool of ten that holds every hit."""
    q = _corrected(t).withColumn("hit", (F.col("q") <= 0.5) & (F.abs("d") >= 0.1))
    pool = q.filter((F.col("q") <= 0.9) & (F.abs("d") >= 0.05))
    place = F.row_number().over(Window.partitionBy("nation").orderBy(F.desc(F.abs("d")), "p_brand"))
    return pool.withColumn("place", place.cast("int")).filter("place <= 10 OR hit").select("nation", "p_brand", "hit", "place")


@query(_effects_sql() + _Q + """, g AS (SELECT * FROM (VALUES (0.1), (0.5), (0.9)) a(q_most), (VALUES (0.05), (0.1), (0.2)) b(d_least))
SELECT CAST(q_most AS DOUBLE) AS q_most, CAST(d_least AS DOUBLE) AS d_least, count(*) FILTER (q <= q_most AND d >= d_least) AS passed, count(*) FILTER (NOT q <= q_most AND d >= d_least) AS only_q, count(*) FILTER (q <= q_most AND NOT d >= d_least) AS only_d FROM q, g GROUP BY 1, 2""")
def o135_regated(t: Tables) -> DataFrame:
    """The pool at nine pairs of thresholds, with what each gate alone keeps out."""
    gates = t._spark.createDataFrame([(q, d) for q in (0.1, 0.5, 0.9) for d in (0.05, 0.1, 0.2)], "q_most double, d_least double")
    return significance.regated(saved(_corrected(t).select("q", "d")), gates)


@query(_SCREEN + """, k AS (SELECT entity, rank() OVER (ORDER BY (score - null_mean) / null_sd DESC) AS place FROM z), c AS (SELECT c_custkey AS entity FROM customer WHERE c_acctbal > 9500)
SELECT (SELECT count(*) FROM c) AS controls, count(*) FILTER (place <= 0.25 * (SELECT count(*) FROM k)) AS recovered, quantile_cont(place, 0.5) AS median_place, CAST((SELECT count(*) FROM k) AS INT) AS entities, coalesce(quantile_cont(place, 0.5) < 0.25 * (SELECT count(*) FROM k), false) AS passed FROM c LEFT JOIN k USING (entity)""")
def o136_control_recovery(t: Tables) -> DataFrame:
    """Ranks of customers with the largest balances among calibrated scores."""
    z, _ = _screen(t)
    ranked = saved(tie_ranks(saved(z.select("entity", "z")), "z", "place", descending=True).select("entity", F.col("place_min").alias("place")))
    controls = t.customer.filter("c_acctbal > 9500").select(F.col("c_custkey").alias("entity"))
    return significance.control_recovery(ranked, controls, "entity", "place")


@query("""WITH x AS (SELECT p_brand, s_nationkey AS nation, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), k AS (SELECT p_brand, nation, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, nation) AS place FROM x GROUP BY 1, 2
), f AS (SELECT p_brand, list_sum(list_reverse_sort(list(v))[1:20]) / 20 AS score FROM x GROUP BY 1), l AS (SELECT p_brand, list_sum(list_reverse_sort(list(v))[1:20]) / 20 AS score, max(k.nation) AS dropped FROM x JOIN k USING (p_brand) WHERE place = 1 AND x.nation <> k.nation GROUP BY 1)
SELECT p_brand, dropped, round(f.score, 4) AS score, round(l.score, 4) AS score_left, l.score >= 0.95 * f.score AS survives FROM f JOIN l USING (p_brand)""")
def o137_dropped_stratum(t: Tables) -> DataFrame:
    """Best twenty prices of a brand, and again without its most frequent nation."""
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("p_brand", F.col("s_nationkey").alias("nation"), F.col("l_extendedprice").alias("v"))
    mode = x.groupBy("p_brand", "nation").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.max_by("nation", F.struct(F.col("n"), -F.col("nation"))).alias("dropped"))
    full = x.groupBy("p_brand").agg(nulls.top_k_mean("v", 20).alias("score"))
    left = x.join(mode, "p_brand").filter("nation != dropped").groupBy("p_brand", "dropped").agg(nulls.top_k_mean("v", 20).alias("score_left"))
    return full.join(left, "p_brand").select("p_brand", "dropped", r("score", 4).alias("score"), r("score_left", 4).alias("score_left"), (F.col("score_left") >= 0.95 * F.col("score")).alias("survives"))


@query("""WITH s AS (SELECT l_suppkey AS entity, s_nationkey AS nation, list_sum(list_reverse_sort(list(l_extendedprice))[1:20]) / least(count(*), 20) AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), a AS (SELECT p.p_type AS t, l_suppkey AS entity, avg(l_extendedprice) AS m FROM lineitem JOIN part p ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'ECONOMY') GROUP BY 1, 2)
SELECT a.entity, round(a.m - b.m, 4) AS contrast, round(score, 4) AS score FROM a JOIN a b USING (entity) JOIN s USING (entity) WHERE a.t = 'PROMO' AND b.t = 'ECONOMY'""")
def o036_contrast(t: Tables) -> DataFrame:
    """Difference of two part types' mean prices at suppliers that sell both, beside their score."""
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))

    def side(kind: str, name: str) -> DataFrame:
        return x.filter(F.col("p_type") == kind).groupBy(F.col("l_suppkey").alias("entity")).agg(F.avg("l_extendedprice").alias(name))

    s = nulls.scores(t.lineitem, "l_suppkey", "l_extendedprice", "top_20_mean")
    return side("PROMO", "a").join(side("ECONOMY", "b"), "entity").join(s, "entity").select("entity", r(F.col("a") - F.col("b"), 4).alias("contrast"), r("score", 4).alias("score"))


@query(_SCREEN + """, c AS (SELECT z.*, (score - null_mean) / null_sd AS zz, c_mktsegment FROM z JOIN customer ON c_custkey = entity), m AS (SELECT quantile_cont(score, 0.5) AS med FROM c)
SELECT entity, round(zz * greatest(0, score - med), 2) AS selective FROM c, m WHERE c_mktsegment <> 'MACHINERY' AND zz > 0 ORDER BY zz * greatest(0, score - med) DESC, entity LIMIT 20""")
def o175_selective_shortlist(t: Tables) -> DataFrame:
    """Twenty customers outside a control segment by z times the score's lead over the median."""
    z, _ = _screen(t)
    x = saved(z.join(t.customer.select(F.col("c_custkey").alias("entity"), "c_mktsegment"), "entity").select("entity", "z", "score", "c_mktsegment"))
    s = x.crossJoin(F.broadcast(x.agg(F.percentile("score", 0.5).alias("med")))).filter("c_mktsegment <> 'MACHINERY' AND z > 0").withColumn("selective", F.col("z") * F.greatest(F.lit(0.0), F.col("score") - F.col("med")))
    return s.orderBy(F.desc("selective"), "entity").limit(20).select("entity", r("selective", 2).alias("selective"))


@query(f"""WITH x AS (SELECT o_custkey AS c, o_totalprice AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY c_mktsegment) AS n, c_mktsegment AS g, c_acctbal AS y FROM orders JOIN customer ON o_custkey = c_custkey
), d AS (SELECT g, rep, {_U32.format("'corr:' || g || ':' || rep || ':' || pos")} % n AS pos FROM x, range(20) t(rep)), m AS (SELECT g, rep, corr(v, y) AS c FROM d JOIN x USING (g, pos) GROUP BY 1, 2)
SELECT g AS segment, round(corr, 6) AS corr, round(quantile_cont(c, 0.025), 6) AS p_lo, round(quantile_cont(c, 0.975), 6) AS p_hi FROM m JOIN (SELECT g, corr(v, y) AS corr FROM x GROUP BY 1) USING (g) GROUP BY 1, 2""")
def o099_bootstrap_correlation(t: Tables) -> DataFrame:
    """Percentile interval of the correlation of order price and balance in each segment."""
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), "o_orderkey", F.col("o_totalprice").alias("v"), F.col("c_acctbal").alias("y"))
    at = numbered(x, "segment", "o_orderkey", name="at")
    ends = at.groupBy("segment").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    at = saved(at.join(F.broadcast(ends), "segment").withColumn("pos", F.col("at") - F.col("first")))
    drawn = replicates(at.select("segment", F.col("pos").alias("slot"), "n"), 20).withColumn("pos", u32("corr", F.col("segment"), F.col("rep"), F.col("slot")) % F.col("n")).select("segment", "rep", "pos")
    each = drawn.join(at.select("segment", "pos", "v", "y"), ["segment", "pos"]).groupBy("segment", "rep").agg(F.corr("v", "y").alias("c"))
    spread = each.groupBy("segment").agg(r(F.percentile("c", 0.025)).alias("p_lo"), r(F.percentile("c", 0.975)).alias("p_hi"))
    return at.groupBy("segment").agg(r(F.corr("v", "y")).alias("corr")).join(spread, "segment")


