"""Scalar functions on text columns of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .base import Tables, query, r


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '/' || p_brand), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS spaced, trim(regexp_replace(regexp_replace(lower(p_name || '/' || p_brand), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS joined FROM part""")
def o021_normal_text(t: Tables) -> DataFrame:
    c = F.concat_ws("/", "p_name", "p_brand")
    return t.part.select("p_partkey", scalars.normal_text(c).alias("spaced"), scalars.normal_text(c, drop=True).alias("joined"))


@query("SELECT DISTINCT trim(regexp_replace(split_part(p_brand || ';' || p_type, ';', 1), '[ _#-]*[0-9]+$', '')) AS label, p_type FROM part")
def o022_base_label(t: Tables) -> DataFrame:
    return t.part.select(scalars.base_label(F.concat_ws(";", "p_brand", "p_type")).alias("label"), "p_type").distinct()


@query("""WITH x AS (SELECT p_partkey, unnest(regexp_split_to_array(p_name || ' - ' || CASE WHEN p_size % 3 = 0 THEN 'NR' ELSE p_type END || ',' || p_brand, ' - |,')) AS s FROM part)
SELECT trim(s) AS symbol, count(*) AS n FROM x WHERE trim(s) NOT IN ('-', 'NR', '') GROUP BY 1""")
def o023_split_symbols(t: Tables) -> DataFrame:
    field = F.concat(F.col("p_name"), F.lit(" - "), F.when(F.col("p_size") % 3 == 0, "NR").otherwise(F.col("p_type")), F.lit(","), F.col("p_brand"))
    return t.part.select(F.explode(scalars.split_symbols(field)).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'SUP' ELSE 'VENDOR' END || ':' || s_nationkey AS id FROM supplier")
def o024_namespace(t: Tables) -> DataFrame:
    raw = F.concat_ws(":", F.when(F.col("s_suppkey") % 2 == 0, "supplier").otherwise("vendor"), F.col("s_nationkey").cast("string"))
    return t.supplier.select("s_suppkey", scalars.namespaced(raw, {"supplier": "SUP"}).alias("id"))


@query("""SELECT CASE WHEN o_orderpriority LIKE '%NOT SPEC%' THEN 'excluded' WHEN regexp_matches(o_orderpriority, 'URGENT|HIGH') THEN 'fast' WHEN regexp_matches(o_orderpriority, 'MEDIUM') THEN 'normal' ELSE 'slow' END AS speed, count(*) AS n FROM orders GROUP BY 1""")
def o025_first_rule(t: Tables) -> DataFrame:
    """Ordered text rules with an exclusion list first; excluded rows are counted."""
    label = scalars.first_rule(F.col("o_orderpriority"), [("URGENT|HIGH", "fast"), ("MEDIUM", "normal")], "slow", excluded="NOT SPEC")
    return t.orders.groupBy(label.alias("speed")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS stars, count(*) AS n FROM orders GROUP BY 1, 2")
def o027_lookup(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", scalars.lookup(F.col("o_orderstatus"), {"F": 2, "O": 1}, 0).alias("stars")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 10 = 0 THEN 'unlabelled' ELSE l_returnflag || '|' || l_suppkey END AS id FROM lineitem""")
def o029_composite_id(t: Tables) -> DataFrame:
    """A composite id; placeholders become null, then a label."""
    part = F.nullif(F.when(F.col("l_suppkey") % 10 == 0, "-").otherwise(F.concat_ws("|", "l_returnflag", F.col("l_suppkey").cast("string"))), F.lit("-"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(part, F.lit("unlabelled")).alias("id"))


_FREQUENCY = "CASE p_size % 4 WHEN 0 THEN (p_partkey % 5) || '/' || (p_partkey % 7 + 1) WHEN 1 THEN (p_size * 1.5) || '%' WHEN 2 THEN 'frequent' ELSE '' END"


@query(f"""WITH x AS (SELECT p_partkey, {_FREQUENCY} AS f, p_size % 4 AS m FROM part)
SELECT p_partkey, CASE m WHEN 0 THEN 'fraction' WHEN 1 THEN 'percent' WHEN 2 THEN 'class' ELSE 'none' END AS kind,
  round(CASE m WHEN 0 THEN (p_partkey % 5) / CAST(p_partkey % 7 + 1 AS DOUBLE) WHEN 1 THEN CAST(replace(f, '%', '') AS DOUBLE) / 100 END, 6) AS share,
  CASE m WHEN 0 THEN CASE WHEN p_partkey % 7 = 0 THEN 'single case' ELSE 'quantified' END WHEN 1 THEN 'quantified' WHEN 2 THEN 'class' ELSE 'none' END AS grade FROM x""")
def o030_frequency(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", scalars.frequency(F.expr(_FREQUENCY)).alias("f"))
    return x.select("p_partkey", "f.kind", r("f.share").alias("share"), "f.grade")


_RATE = "CASE p_size % 3 WHEN 0 THEN (p_size + 1) || '-' || (p_size + 9) || ' / 10 000' WHEN 1 THEN '<' || p_size || ' / 1 000 000' ELSE '>' || p_size || ' / 1000' END"


@query("""SELECT p_partkey, round(CASE p_size % 3 WHEN 0 THEN (p_size + 1) / 10000.0 WHEN 1 THEN 0 ELSE p_size / 1000.0 END, 9) AS lo, round(CASE p_size % 3 WHEN 0 THEN (p_size + 9) / 10000.0 WHEN 1 THEN p_size / 1000000.0 ELSE p_size / 100.0 END, 9) AS hi FROM part""")
def o031_rate_interval(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", scalars.rate_interval(F.expr(_RATE)).alias("i"))
    return x.select("p_partkey", r("i.lo", 9).alias("lo"), r("i.hi", 9).alias("hi"))


@query("SELECT CASE WHEN p_retailprice < 950 THEN 'low' WHEN p_retailprice < 1000 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM part GROUP BY 1")
def o032_bands(t: Tables) -> DataFrame:
    return t.part.groupBy(scalars.band(F.col("p_retailprice"), [(950, "low"), (1000, "middle")], "high").alias("band")).agg(F.count("*").alias("n"))


@query("SELECT least(greatest(CAST(floor(l_discount / 0.1 * 5) AS INT), 0), 4) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def o033_equal_width(t: Tables) -> DataFrame:
    from ..operators.tables import bins

    return t.lineitem.groupBy(bins(F.col("l_discount") / 0.1, 5).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT o_custkey, CAST(left(o_orderpriority, 1) AS INT) AS rank FROM orders) SELECT o_custkey, min(rank) AS rarest, max(rank) - min(rank) + 1 AS span FROM k GROUP BY 1""")
def o034_ordinal_span(t: Tables) -> DataFrame:
    """The best priority class of a customer and the span in classes."""
    rank = scalars.lookup(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}, 9)
    return t.orders.withColumn("rank", rank).groupBy("o_custkey").agg(F.min("rank").alias("rarest"), (F.max("rank") - F.min("rank") + 1).alias("span"))


@query("SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def o007_json_fields(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.from_json("props", "k int").alias("p")).groupBy("user_id").agg(F.sum("p.k").alias("k"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:License|Lizenz|version) [0-9A-Z.]+')) AS feature FROM documents) SELECT feature, count(*) AS n, count(DISTINCT doc_id) AS docs FROM m GROUP BY 1""")
def o013_text_features(t: Tables) -> DataFrame:
    """Typed features cut out of free text."""
    m = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?:License|Lizenz|version) [0-9A-Z.]+"), F.lit(0))).alias("feature"))
    return m.groupBy("feature").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))
