"""Rank, band and window operators; each takes a total order, so results don't depend on the input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import saved


def average_rank(value: str, *within: str) -> Column:
    """Rank with ties averaged inside groups, by windows."""
    order = Window.partitionBy(*within).orderBy(value)
    ties = Window.partitionBy(*within, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def tie_ranks(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """Adds {name}_min and {name}_avg, ranks over the whole table; null values get null.

    Distinct values are counted, running sums are made in value ranges, and only a number for each range crosses tasks.
    """
    order = F.desc(value) if descending else F.asc(value)
    ranged = saved(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c")).repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").agg(F.sum("_c").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    running = F.sum("_c").over(Window.partitionBy("_range").orderBy(order))
    first = F.col("_before") + F.col("_run") - F.col("_c") + 1
    ranks = ranged.withColumn("_run", running).join(F.broadcast(before), "_range").select(value, first.alias(f"{name}_min"), (first + (F.col("_c") - 1) / 2).alias(f"{name}_avg"))
    return df.join(ranks, value, "left")


def spearman(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(by..., n, rho): rank correlation with average ties; null under 3 pairs. Groups are ranked by windows, a whole
    table by ranges."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    if by:
        ranked = pairs.withColumn("_a_avg", average_rank(a, *by)).withColumn("_b_avg", average_rank(b, *by))
    else:
        ranked = tie_ranks(tie_ranks(saved(pairs.select(a, b)), a, "_a"), b, "_b")
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_a_avg", "_b_avg").alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))


def equal_count_bands(df: DataFrame, value: str, ident: str, bands: int = 10) -> DataFrame:
    """Adds band 0 .. bands - 1 of n div bands rows each, the rest in the last one."""
    from .draws import numbered

    total = df.count()
    size = max(total // bands, 1)
    return numbered(df, value, ident, name="_pos").withColumn("band", F.least(F.floor(F.col("_pos") / size), F.lit(bands - 1)).cast("int")).drop("_pos")


def first_by(df: DataFrame, by: tuple[str, ...], *order: Column) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def top_k(df: DataFrame, by: tuple[str, ...], k: int, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def fractional_rank(value: str, ident: str, *within: str) -> Column:
    """Ordinal rank / n, ties by key; 0 where the value is 0."""
    w = Window.partitionBy(*within)
    return F.when(F.col(value) == 0, 0.0).otherwise(F.row_number().over(w.orderBy(value, ident)) / F.count("*").over(w))


def densest_window(binned: DataFrame, by: str, width: int, bins: int) -> DataFrame:
    """(by, total, most, ratio) of dense counts (by, bin, n): the fullest run of `width` bins against an even spread."""
    run = F.sum("n").over(Window.partitionBy(by).orderBy("bin").rowsBetween(0, width - 1))
    out = binned.withColumn("run", F.when(F.col("bin") <= bins - width, run)).groupBy(by).agg(F.sum("n").alias("total"), F.max("run").alias("most"))
    return out.withColumn("ratio", (F.col("most") / F.col("total")) / (width / bins))
