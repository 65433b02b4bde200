"""Catalogue measures: shares, flags, presence, retention, gaps, bias, audits and registries on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import catalogue, tables
from ..operators.draws import dealt, saved
from ..operators.ranks import spearman
from .base import Tables, query, r
from .calibration import _SCREEN, _U32, _screen


@query("""WITH d AS (SELECT o_custkey AS entity, count(*) AS n, avg(o_totalprice) AS score FROM orders GROUP BY 1) SELECT 'entities' AS field, CAST(count(*) AS DOUBLE) AS value FROM d UNION ALL SELECT 'repeated', CAST(count(*) - count(DISTINCT entity) AS DOUBLE) FROM d
UNION ALL SELECT 'without score', CAST(count(*) FILTER (score IS NULL) AS DOUBLE) FROM d UNION ALL SELECT 'count under 1', CAST(count(*) FILTER (n < 1) AS DOUBLE) FROM d UNION ALL SELECT 'largest count', CAST(max(n) AS DOUBLE) FROM d""")
def o020_entity_contract(t: Tables) -> DataFrame:
    """The standard contract of an entity-scores table, checked in one pass."""
    s = t.orders.groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("score"))
    return catalogue.entity_contract(s)


_NOTATION = """WITH x AS (SELECT l_orderkey, l_linenumber, 'c.' || CAST(l_quantity AS INT) || CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 'del' WHEN 1 THEN 'A>G' WHEN 2 THEN '+1G>A' WHEN 3 THEN 'dup' WHEN 4 THEN '_9delinsAT' WHEN 5 THEN '_8insT' ELSE 'C>T' END AS coding,
  CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN 'p.(=)' WHEN 1 THEN 'p.Arg' || CAST(l_quantity AS INT) || 'Ter' WHEN 2 THEN 'p.Gly7fs' WHEN 3 THEN 'p.(Ala5Val)' WHEN 4 THEN 'p.Lys3*' END AS protein FROM lineitem)"""


@query(_NOTATION + r""", y AS (SELECT *, coalesce(protein, '') AS p FROM x)
SELECT CASE WHEN p LIKE '%fs%' THEN 'frameshift' WHEN p LIKE '%Ter%' OR p LIKE '%*' THEN 'nonsense' WHEN regexp_matches(coding, 'c\.[0-9]+[+-][0-9]') THEN 'splice region' WHEN coding LIKE '%delins%' THEN 'indel' WHEN coding LIKE '%dup%' THEN 'duplication' WHEN coding LIKE '%del%' THEN 'deletion'
  WHEN coding LIKE '%ins%' THEN 'insertion' WHEN p LIKE 'p.(Ala5Val)' THEN 'missense' WHEN p LIKE '%(=)%' THEN 'synonymous' ELSE 'unclassified' END AS consequence, count(*) AS n, CAST(min(CAST(regexp_extract(coding, '^c\.([0-9]+)', 1) AS INT)) AS INT) AS first_position FROM y GROUP BY 1""".replace("\\\\", "\\"))
def o028_consequences(t: Tables) -> DataFrame:
    """Consequences of variants from a coding and a protein notation, made from lines."""
    q = F.col("l_quantity").cast("int")

    def one_of(number, *texts):
        return F.get(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in texts]), number.cast("int"))

    coding = F.concat(F.lit("c."), q.cast("string"), one_of((F.col("l_orderkey") + F.col("l_linenumber")) % 7, "del", "A>G", "+1G>A", "dup", "_9delinsAT", "_8insT", "C>T"))
    protein = one_of(q % 6, "p.(=)", F.concat(F.lit("p.Arg"), q.cast("string"), F.lit("Ter")), "p.Gly7fs", "p.(Ala5Val)", "p.Lys3*")
    x = t.lineitem.select(coding.alias("coding"), protein.alias("protein"))
    return x.groupBy(catalogue.consequence(F.col("coding"), F.col("protein")).alias("consequence")).agg(F.count("*").alias("n"), F.min(catalogue.coding_position(F.col("coding"))).alias("first_position"))


@query(f"""WITH x AS (SELECT c_mktsegment AS g, o_totalprice AS w, o_orderpriority = '1-URGENT' AS hit, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM orders JOIN customer ON o_custkey = c_custkey
), d AS (SELECT g, rep, {_U32.format("'share:' || g || ':' || rep || ':' || pos")} % n AS pos FROM x, range(20) t(rep)), m AS (SELECT g, rep, sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w) AS s FROM d JOIN x USING (g, pos) GROUP BY 1, 2), o AS (SELECT g, sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w) AS share FROM x GROUP BY 1)
SELECT g AS segment, round(share, 6) AS share, round(stddev_samp(s), 6) AS se, round(share - 1.96 * stddev_samp(s), 6) AS lo, round(share + 1.96 * stddev_samp(s), 6) AS hi FROM o JOIN m USING (g) GROUP BY 1, 2, o.share""")
def o065_weighted_share(t: Tables) -> DataFrame:
    """Share of order value that is urgent in each segment, with its bootstrap interval."""
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), "o_orderkey", F.col("o_totalprice").alias("w"), (F.col("o_orderpriority") == "1-URGENT").alias("hit"))
    s = catalogue.weighted_share(x, "segment", "o_orderkey", "hit", "w", 20, "share")
    return s.select("segment", *[r(c).alias(c) for c in ("share", "se", "lo", "hi")])


@query("""WITH x AS (SELECT l_partkey AS entity, l_returnflag AS kind, avg(l_extendedprice / l_quantity) AS v FROM lineitem GROUP BY 1, 2), p AS (SELECT entity, max(v) FILTER (kind = 'A') AS a, max(v) FILTER (kind = 'R') AS b, count(DISTINCT kind) AS kinds FROM x GROUP BY 1)
SELECT entity, kinds > 1 AS mixed, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) / nullif(least(a, b), 0) END, 4) AS fold, coalesce(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) / nullif(least(a, b), 0) END >= 2, false) AS apart FROM p""")
def o069_fold_flags(t: Tables) -> DataFrame:
    """Parts whose unit price in returned and accepted lines differs twofold, and parts of several kinds."""
    x = t.lineitem.groupBy(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("kind")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    return catalogue.fold_flags(x, "entity", "kind", "v", "A", "R", 2.0).withColumn("fold", r("fold", 4))


@query("""WITH k AS (SELECT 'supplied' AS layer, l_partkey AS k FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07 UNION SELECT 'large', p_partkey FROM part WHERE p_size > 30 UNION SELECT 'promo', p_partkey FROM part WHERE p_type = 'PROMO'), n AS (SELECT k, count(*) AS layers FROM k GROUP BY 1)
SELECT layer, count(*) AS n, count(*) FILTER (layers = 1) AS only_here, round(count(*) / CAST((SELECT count(*) FROM n) AS DOUBLE), 6) AS coverage FROM k JOIN n USING (k) GROUP BY 1""")
def o071_presence(t: Tables) -> DataFrame:
    """Three layers of parts: what each covers and holds alone."""
    layers = {"supplied": t.lineitem.filter("l_discount > 0.09 AND l_tax > 0.07").select(F.col("l_partkey").alias("k")), "large": t.part.filter("p_size > 30").select(F.col("p_partkey").alias("k")), "promo": t.part.filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("k"))}
    return catalogue.presence(layers, "k").withColumn("coverage", r("coverage"))


_SCALES = """WITH x AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS item, p_brand, p_type, o_orderpriority AS cat FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey), l AS (SELECT DISTINCT 'part' AS scale, e, CAST(item AS VARCHAR) AS f, cat FROM x UNION SELECT 'brand', e, p_brand, cat FROM x UNION SELECT 'type', e, p_type, cat FROM x
), w AS (SELECT scale, f, cat, 1.0 / count(*) OVER (PARTITION BY scale, e) AS w FROM l), c AS (SELECT scale, f, cat, sum(w) AS w FROM w GROUP BY 1, 2, 3), p AS (SELECT scale, f, w / sum(w) OVER (PARTITION BY scale) AS p, sum(w) OVER (PARTITION BY scale, f) / sum(w) OVER (PARTITION BY scale) AS pa, sum(w) OVER (PARTITION BY scale, cat) / sum(w) OVER (PARTITION BY scale) AS pb FROM c
), m AS (SELECT scale, count(DISTINCT f) AS alphabet, sum(p * log2(p / (pa * pb))) AS mi FROM p GROUP BY 1)"""


@query(_SCALES + " SELECT scale, alphabet, round(mi, 6) AS mi, round((SELECT max(alphabet) FILTER (scale = 'part') FROM m) / CAST(alphabet AS DOUBLE), 6) AS compression, round(mi / (SELECT max(mi) FILTER (scale = 'part') FROM m), 6) AS retained FROM m")
def o078_coarse_graining(t: Tables) -> DataFrame:
    """Information about an order's priority in its parts, brands and types; what coarser scales keep."""
    x = _scale_rows(t, part="l_partkey", brand="p_brand", type="p_type")
    c = catalogue.coarse_graining(x, "e", "f", "cat", "scale", "part")
    return c.select("scale", "alphabet", *[r(k).alias(k) for k in ("mi", "compression", "retained")])


_BITS = """WITH x AS (SELECT DISTINCT l_orderkey AS e, p_brand AS f, p_type AS g, o_orderpriority AS cat FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey), l AS (SELECT DISTINCT 'brand' AS scale, e, f, cat FROM x UNION SELECT 'type', e, g, cat FROM x
), k AS (SELECT DISTINCT o_orderpriority AS one FROM orders), b AS (SELECT scale, one, f, (cat = one) AS yes, count(*) AS c FROM l, k GROUP BY 1, 2, 3, 4), p AS (SELECT scale, one, c / CAST(sum(c) OVER w AS DOUBLE) AS p, sum(c) OVER (PARTITION BY scale, one, f) / CAST(sum(c) OVER w AS DOUBLE) AS pa, sum(c) OVER (PARTITION BY scale, one, yes) / CAST(sum(c) OVER w AS DOUBLE) AS pb FROM b WINDOW w AS (PARTITION BY scale, one)
), m AS (SELECT scale, one, sum(p * log2(p / (pa * pb))) AS mi FROM p GROUP BY 1, 2)"""


@query(_BITS + " SELECT one AS category, round(max(mi) FILTER (scale = 'brand') * 1000, 6) AS fine, round(max(mi) FILTER (scale = 'type') * 1000, 6) AS coarse, round(max(mi) FILTER (scale = 'type') / max(mi) FILTER (scale = 'brand'), 5) AS retained FROM m GROUP BY 1")
def o079_retention_by_category(t: Tables) -> DataFrame:
    """For each priority alone: thousandths of a bit in brands and in types, and the share that types keep."""
    m = saved(catalogue.binary_information(_scale_rows(t, brand="p_brand", type="p_type"), "scale", "f", "cat"))
    p = m.groupBy(F.col("one").alias("category")).pivot("scale", ["brand", "type"]).agg(F.max("mi"))
    return p.select("category", r(F.col("brand") * 1000).alias("fine"), r(F.col("type") * 1000).alias("coarse"), r(F.col("type") / F.col("brand"), 5).alias("retained"))


def _scale_rows(t: Tables, **scales: str) -> DataFrame:
    """(e, cat, scale, f): distinct features of an order at each scale, an order's rows all in one task."""
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    x = dealt(x.select(F.col("l_orderkey").alias("e"), F.col("o_orderpriority").alias("cat"), *scales.values()), t.lineitem.count(), "e")
    return x.select("e", "cat", F.explode(F.array(*[F.struct(F.lit(n).alias("scale"), F.col(c).cast("string").alias("f")) for n, c in scales.items()])).alias("s")).select("e", "cat", "s.scale", "s.f").distinct()


@query(_BITS + ", s AS (SELECT scale, avg(mi) * 1000 AS m, stddev_samp(mi) * 1000 / sqrt(count(*)) AS se FROM m GROUP BY 1) SELECT round(a.m, 6) AS brand_mean, round(b.m, 6) AS type_mean, round((a.m - b.m) / (a.m + b.m), 6) AS contrast, round(sqrt(a.se * a.se + b.se * b.se), 6) AS se FROM s a, s b WHERE a.scale = 'brand' AND b.scale = 'type'")
def o080_family_contrast(t: Tables) -> DataFrame:
    """Mean single-category information of the two scales, their normalised contrast and its pooled error."""
    m = catalogue.binary_information(_scale_rows(t, brand="p_brand", type="p_type"), "scale", "f", "cat")
    s = m.agg(*[f(F.when(F.col("scale") == k, F.col("mi") * 1000)).alias(f"{k}_{n}") for k in ("brand", "type") for n, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))])
    a, b = F.col("brand_m"), F.col("type_m")
    return s.select(r(a).alias("brand_mean"), r(b).alias("type_mean"), r((a - b) / (a + b)).alias("contrast"), r(F.sqrt(F.col("brand_s") ** 2 / F.col("brand_n") + F.col("type_s") ** 2 / F.col("type_n"))).alias("se"))


@query("""WITH x AS (SELECT l_suppkey, p_type, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS seen FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT l_suppkey, p_type, sum(seen) AS k, count(seen) AS n FROM x GROUP BY 1, 2 HAVING count(seen) >= 2), c AS (SELECT p_type, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_returnflag = 'A' THEN 0 END) AS curated FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT CASE WHEN abs(k / CAST(n AS DOUBLE) - curated) < 0.1 THEN 'near' WHEN abs(k / CAST(n AS DOUBLE) - curated) < 0.3 THEN 'apart' ELSE 'far' END AS gap, count(*) AS n, round(avg(k / CAST(n AS DOUBLE)), 6) AS mean_frequency FROM f JOIN c USING (p_type) GROUP BY 1""")
def o085_frequency_gaps(t: Tables) -> DataFrame:
    """Frequencies of returns among assessed lines of suppliers, against each type's overall one."""
    seen = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_type", seen.alias("seen"))
    f = catalogue.assessed_frequency(x, ["l_suppkey", "p_type"], "seen")
    c = x.groupBy("p_type").agg(F.avg("seen").alias("curated"))
    return catalogue.frequency_gaps(f.join(F.broadcast(c), "p_type"), "curated").withColumn("mean_frequency", r("mean_frequency"))


@query("""WITH x AS (SELECT DISTINCT o_custkey AS plan, l_partkey AS need FROM orders JOIN lineitem ON o_orderkey = l_orderkey), c AS (SELECT plan, count(*) AS items, sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS cost, max(p_size) AS slowest FROM x JOIN part ON p_partkey = need GROUP BY 1
), u AS (SELECT sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS once FROM part WHERE p_partkey IN (SELECT need FROM x)), k AS (SELECT *, rank() OVER (ORDER BY cost DESC) AS by_cost, rank() OVER (ORDER BY items DESC) AS by_items FROM c)
SELECT plan, items, CAST(cost AS BIGINT) AS cents, CAST(slowest AS INT) AS slowest, by_cost, by_items, by_items - by_cost AS moved, CAST((SELECT sum(cost) FROM c) - once AS BIGINT) AS saved FROM k, u""")
def o086_shared_resources(t: Tables) -> DataFrame:
    """Customers' parts as needs: costs one by one, what sharing saves, and rank moves between two orders."""
    x = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("plan"), F.col("l_partkey").alias("need")).distinct()
    needs = x.join(t.part.select(F.col("p_partkey").alias("need"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"), F.col("p_size").alias("wait")), "need")
    c = catalogue.shared_resources(saved(needs), "plan", "need", "price", "wait")
    return c.select("plan", "items", F.col("cost").alias("cents"), "slowest", "by_cost", "by_items", "moved", "saved")


@query("""WITH u AS (SELECT p_partkey AS k, p_size % 4 > 0 AS in_hub, p_type AS kind FROM part), h AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.09), f AS (SELECT u.*, h.k IS NOT NULL AS has, bool_or(h.k IS NOT NULL) OVER (PARTITION BY kind) AS twin FROM u LEFT JOIN h USING (k))
SELECT CASE WHEN has THEN 'present' WHEN in_hub AND twin THEN 'interoperability' WHEN twin THEN 'accessibility' ELSE 'epistemic' END AS gap, count(*) AS n FROM f GROUP BY 1""")
def o088_gap_types(t: Tables) -> DataFrame:
    """Why a part lacks a field: a counterpart holds it and a hub links them, no hub does, or nobody has it."""
    universe = t.part.select(F.col("p_partkey").alias("k"), (F.col("p_size") % 4 > 0).alias("in_hub"), F.col("p_type").alias("kind"))
    return catalogue.gap_types(universe, t.lineitem.filter("l_discount > 0.09").select(F.col("l_partkey").alias("k")), "k", "kind", "in_hub")


@query("""WITH c AS (SELECT o_custkey AS e, count(*) AS n, avg(o_totalprice) AS m, max(o_totalprice) AS best FROM orders GROUP BY 1), k AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS a, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS b, rank() OVER (ORDER BY best) + (count(*) OVER (PARTITION BY best) - 1) / 2.0 AS c FROM c
), d AS (SELECT avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END) FILTER (lang = 'en') - avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END) FILTER (lang <> 'en') AS v FROM documents LEFT JOIN labels USING (doc_id)), x AS (SELECT 'mean by count' AS bias, corr(a, b) AS v FROM k UNION ALL SELECT 'best by count', corr(a, c) FROM k UNION ALL SELECT 'labels by language', v FROM d)
SELECT bias, round(v, 6) AS measure, CASE WHEN abs(v) < 0.1 THEN 'weak' WHEN abs(v) < 0.3 THEN 'some' ELSE 'strong' END AS verdict FROM x""")
def o089_bias_battery(t: Tables) -> DataFrame:
    """Varying counts and missing labels: three measures, each with a band."""
    c = saved(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"), F.max("o_totalprice").alias("best")))
    gone = F.when(F.col("quality").isNull(), 1.0).otherwise(0.0)
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    missing = d.agg((F.avg(F.when(F.col("lang") == "en", gone)) - F.avg(F.when(F.col("lang") != "en", gone))).alias("v"))
    x = spearman(c, "n", "m").select(F.lit("mean by count").alias("bias"), F.col("rho").alias("v")).unionByName(spearman(c, "n", "best").select(F.lit("best by count").alias("bias"), F.col("rho").alias("v"))).unionByName(missing.select(F.lit("labels by language").alias("bias"), "v"))
    return x.select("bias", r("v").alias("measure"), catalogue.bias_band(F.col("v")).alias("verdict"))


@query("""WITH x AS (SELECT o_custkey AS trial, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2) SELECT status, count(*) AS trials, quantile_cont(n, 0.5) AS median_n, count(*) FILTER (n >= 4) AS assessable, round(quantile_cont(CASE WHEN n >= 4 THEN 2.801585218111 * sqrt(4.0 / n) END, 0.5), 6) AS median_floor FROM x GROUP BY 1""")
def o142_trial_power(t: Tables) -> DataFrame:
    """Customers and statuses as trials: enrolment and the effect that half of them could show."""
    from ..operators.significance import min_detectable_effect

    x = t.orders.groupBy("o_custkey", F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return x.groupBy("status").agg(F.count("*").alias("trials"), F.percentile("n", 0.5).alias("median_n"), F.count_if(F.col("n") >= 4).alias("assessable"), r(F.percentile(min_detectable_effect(F.col("n")), 0.5)).alias("median_floor"))


@query(_SCREEN + """, v AS (SELECT (score - null_mean) / null_sd AS zz, null_sd / null_mean AS cv FROM z) SELECT count(*) AS n, round(max(abs(zz)), 5) AS largest, count(*) FILTER (abs(zz) > 2.5758293) AS beyond_draws, count(*) FILTER (cv < 0.01) AS narrow, count(*) FILTER (abs(zz) > 10) AS loud FROM v""")
def o143_z_audit(t: Tables) -> DataFrame:
    """Reported z values against what two hundred draws can resolve, narrow nulls, and loud ones."""
    z, _ = _screen(t)
    return catalogue.z_audit(z, draws=200).withColumn("largest", r("largest", 5))


@query("""WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'Customer#x' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_custkey END AS ref FROM customer)
SELECT CASE WHEN c_custkey IS NULL THEN 'unresolved' WHEN c_name <> name THEN 'name differs' ELSE 'verified' END AS verdict, count(*) AS n FROM a LEFT JOIN customer ON c_custkey = ref GROUP BY 1""")
def o144_verification(t: Tables) -> DataFrame:
    """Authored references, some wrong, against the catalogue of customers."""
    authored = t.customer.select(F.when(F.col("c_custkey") % 7 == 0, -1).otherwise(F.col("c_custkey")).alias("ref"), F.when(F.col("c_custkey") % 10 == 0, "Customer#x").otherwise(F.col("c_name")).alias("name"))
    return catalogue.verified(authored, t.customer.select(F.col("c_custkey").alias("ref"), F.col("c_name").alias("catalogue_name")))


@query("""WITH m AS (SELECT i, quantile_cont(CAST(embedding[i] AS DOUBLE), 0.5) AS med FROM embeddings, range(1, 65) t(i) GROUP BY 1), k AS (SELECT i, row_number() OVER (ORDER BY med, i) - 1 AS pos FROM m), f AS (SELECT label, pos // 8 AS bin, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, k)
SELECT label, CAST(bin AS INT) AS bin, round(least(greatest(quantile_cont(x, 0.5), -0.1), 0.1), 6) AS shade FROM f GROUP BY 1, 2""")
def o170_binned_matrix(t: Tables) -> DataFrame:
    """Labels by eight groups of neighbouring components: medians on a clipped scale."""
    from ..operators.features import binned_matrix

    long = t.embeddings.select("label", F.posexplode("embedding").alias("column", "x"))
    return binned_matrix(long, "label", "column", "x", 8, 0.1).withColumn("shade", r("shade"))


@query("""WITH v AS (SELECT l_partkey AS k, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, avg(l_discount) AS discount FROM lineitem GROUP BY 1), o AS (SELECT l_partkey AS k, count(DISTINCT o_custkey) AS buyers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT p_partkey, p_brand, lines, suppliers, round(discount, 6) AS discount, buyers, (lines IS NOT NULL)::INT + (buyers IS NOT NULL)::INT AS layers FROM part LEFT JOIN v ON v.k = p_partkey LEFT JOIN o ON o.k = p_partkey""")
def r26_part_records(t: Tables) -> DataFrame:
    """One wide record for each part from all layers."""
    v = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"), r(F.avg("l_discount")).alias("discount"))
    o = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("o_custkey").alias("buyers"))
    x = t.part.select("p_partkey", "p_brand").join(v, "p_partkey", "left").join(o, "p_partkey", "left")
    return x.withColumn("layers", F.col("lines").isNotNull().cast("int") + F.col("buyers").isNotNull().cast("int"))


@query("""WITH x AS (SELECT c_nationkey AS n, sum(o_totalprice) AS v, count(*) AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1), c AS (SELECT c_nationkey AS n, count(*) AS people FROM customer GROUP BY 1)
SELECT n_name AS nation, k AS records, round(100.0 * k / people, 4) AS per_100, round(v / (SELECT sum(v) FROM x), 6) AS share, round((k / CAST((SELECT sum(k) FROM x) AS DOUBLE)) / (people / CAST((SELECT sum(people) FROM c) AS DOUBLE)), 6) AS ratio FROM x JOIN c USING (n) JOIN nation ON n_nationkey = n""")
def r11_geography(t: Tables) -> DataFrame:
    """Orders per hundred customers of a nation and how far it is represented."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("n")).agg(F.count("*").alias("people"))
    x = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("records"))
    both = saved(x.join(c, "n"))
    total = both.agg(F.sum("v").alias("all_v"), F.sum("records").alias("all_k")).crossJoin(c.agg(F.sum("people").alias("all_people")))
    y = both.join(t.nation, F.col("n") == F.col("n_nationkey")).crossJoin(F.broadcast(total))
    return y.select(F.col("n_name").alias("nation"), "records", r(100 * F.col("records") / F.col("people"), 4).alias("per_100"), r(F.col("v") / F.col("all_v")).alias("share"), r((F.col("records") / F.col("all_k")) / (F.col("people") / F.col("all_people"))).alias("ratio"))


@query("""WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS lines FROM lineitem GROUP BY 1) SELECT 'order total' AS claim, count(*) FILTER (abs(lines - o_totalprice) > 0.01 * o_totalprice) AS contradictions, count(*) AS checked FROM orders JOIN s ON l_orderkey = o_orderkey
UNION ALL SELECT 'nation', count(*) FILTER (c_nationkey <> s_nationkey), count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""")
def r28_contradictions(t: Tables) -> DataFrame:
    """Order totals against their lines, and nations of buyers against those of suppliers."""
    s = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("lines"))
    a = t.orders.join(s, F.col("o_orderkey") == F.col("l_orderkey")).agg(F.count_if(F.abs(F.col("lines") - F.col("o_totalprice")) > 0.01 * F.col("o_totalprice")).alias("contradictions"), F.count("*").alias("checked"))
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    b = x.agg(F.count_if(F.col("c_nationkey") != F.col("s_nationkey")).alias("contradictions"), F.count("*").alias("checked"))
    return a.withColumn("claim", F.lit("order total")).unionByName(b.withColumn("claim", F.lit("nation")))


@query("""WITH k AS (SELECT p_partkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS n, count(DISTINCT l_suppkey) AS s, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS rs FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
SELECT CASE WHEN r = 0 THEN 'never returned' WHEN r * 2 > n THEN 'mostly returned' WHEN rs = 1 THEN 'one supplier' ELSE 'mixed' END AS bucket, count(*) AS parts, round(avg(r / CAST(n AS DOUBLE)), 6) AS mean_share FROM k GROUP BY 1""")
def r13_verdict_profile(t: Tables) -> DataFrame:
    """Parts by the profile of their returns."""
    back = F.col("l_returnflag") == "R"
    k = t.part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_partkey").agg(F.count_if(back).alias("r"), F.count("*").alias("n"), F.count_distinct(F.when(back, F.col("l_suppkey"))).alias("rs"))
    bucket = F.when(F.col("r") == 0, "never returned").when(F.col("r") * 2 > F.col("n"), "mostly returned").when(F.col("rs") == 1, "one supplier").otherwise("mixed")
    return k.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("parts"), r(F.avg(F.col("r") / F.col("n"))).alias("mean_share"))


@query("""WITH x AS (SELECT l_orderkey IS NOT NULL AS lined, p_partkey IS NOT NULL AS parted, s_suppkey IS NOT NULL AS supplied FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, min(l_partkey) OVER (PARTITION BY l_orderkey) AS p, min(l_suppkey) OVER (PARTITION BY l_orderkey) AS s FROM lineitem) ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = p LEFT JOIN supplier ON s_suppkey = s)
SELECT count(*) AS orders, round(avg(lined::INT), 6) AS lined, round(avg(parted::INT), 6) AS parted, round(avg(supplied::INT), 6) AS supplied FROM x""")
def r08_coverage(t: Tables) -> DataFrame:
    """Share of orders that lines, parts and suppliers reach."""
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    x = t.orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t.part, F.col("p") == F.col("p_partkey"), "left").join(t.supplier, F.col("s") == F.col("s_suppkey"), "left")
    return x.agg(F.count("*").alias("orders"), *[r(F.avg(F.col(c).isNotNull().cast("int"))).alias(n) for c, n in (("l_orderkey", "lined"), ("p_partkey", "parted"), ("s_suppkey", "supplied"))])


@query("""WITH x AS (SELECT lang, source, CAST(n_chars AS DOUBLE) AS mass, quality IS NOT NULL AS covered FROM documents LEFT JOIN labels USING (doc_id)), s AS (SELECT lang, source, sum(CASE WHEN covered THEN mass ELSE 0 END) / sum(mass) AS share FROM x GROUP BY 1, 2), k AS (SELECT lang, arg_max(source, (share, source)) AS best, arg_min(source, (share, source)) AS worst, max(share) - min(share) AS spread FROM s GROUP BY 1)
SELECT lang, best, worst, round(spread, 6) AS spread, round(sum(CASE WHEN covered THEN mass ELSE 0 END) / sum(mass), 6) AS by_mass, round(avg(covered::INT), 6) AS by_document FROM k JOIN x USING (lang) GROUP BY 1, 2, 3, 4""")
def r17_language_coverage(t: Tables) -> DataFrame:
    """Share of each language's documents and text that labels cover, with its best and worst source."""
    x = t.documents.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("mass")).join(t.labels.select("doc_id", "quality"), "doc_id", "left").withColumn("covered", F.col("quality").isNotNull())
    share = F.sum(F.when(F.col("covered"), F.col("mass")).otherwise(0.0)) / F.sum("mass")
    s = x.groupBy("lang", "source").agg(share.alias("share"))
    k = s.groupBy("lang").agg(F.max_by("source", F.struct("share", "source")).alias("best"), F.min_by("source", F.struct("share", "source")).alias("worst"), r(F.max("share") - F.min("share")).alias("spread"))
    return k.join(x.groupBy("lang").agg(r(share).alias("by_mass"), r(F.avg(F.col("covered").cast("int"))).alias("by_document")), "lang")


@query("""WITH x AS (SELECT o_orderkey, c_mktsegment AS seg, year(o_orderdate) AS y, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT seg, sum(v) AS v FROM x GROUP BY 1), k AS (SELECT seg, v, row_number() OVER (ORDER BY v DESC, seg) AS place, sum(v) OVER (ORDER BY v DESC, seg ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS upto FROM s)
SELECT x.seg AS segment, CAST(place AS INT) AS place, round(upto, 6) AS upto, CAST((SELECT min(place) FROM k WHERE upto >= 0.5) AS INT) AS half_at, count(DISTINCT y) AS years FROM k JOIN x USING (seg) GROUP BY 1, 2, 3, 4""")
def r21_half_of_revenue(t: Tables) -> DataFrame:
    """Segments by revenue and how many of them make half of it."""
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("o_totalprice").alias("v"), F.count_distinct(F.year("o_orderdate")).alias("years"))
    w = Window.orderBy(F.desc("v"), "segment")  # one row for each segment
    k = saved(x.withColumns({"place": F.row_number().over(w), "upto": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("v").over(Window.partitionBy())}))
    half = k.filter("upto >= 0.5").agg(F.min("place").alias("half_at"))
    return k.crossJoin(half).select("segment", "place", r("upto").alias("upto"), "half_at", "years")


def _merged(t: Tables) -> DataFrame:
    return tables.missing_pattern(t.documents.join(t.labels, "doc_id", "left"), ["quality", "toxic"])


@query("""WITH x AS (SELECT quality, toxic, lang, text FROM documents LEFT JOIN labels USING (doc_id)) SELECT CASE WHEN quality IS NULL AND toxic IS NULL THEN 'quality+toxic' WHEN quality IS NULL THEN 'quality' WHEN toxic IS NULL THEN 'toxic' ELSE 'complete' END AS pattern, CAST((quality IS NULL)::INT + (toxic IS NULL)::INT AS INT) AS gaps, count(*) AS n FROM x GROUP BY 1, 2""")
def r19_gap_patterns(t: Tables) -> DataFrame:
    """Which fields of a document's labels are missing together."""
    return _merged(t)
