"""Intervals: closed forms over (k, n), bootstraps on replicate tables, jackknife."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import dealt, numbered, ranged_draws, saved, spread, u32, written

Z95 = 1.959964
#: Draws of a bootstrap that are shuffled at once, and the least replicates, since the rows are shuffled with each time.
DRAWS, LEAST_REPS = 50_000_000, 4


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wilson(k, n, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the score interval of k successes in n; null for n = 0."""
    k, n = _col(k).cast("double"), F.nullif(_col(n).cast("double"), F.lit(0.0))
    p, zz = k / n, z * z
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))


def rule_of_three(n) -> Column:
    """Upper 95 % bound of a rate with no event seen in n."""
    return F.least(3 / F.nullif(_col(n).cast("double"), F.lit(0.0)), F.lit(1.0))


def bootstrap_means(df: DataFrame, by: str, ident: str, value: str, reps: int, seed: str, least: int = 8) -> DataFrame:
    """(by, n, point, se, lo, hi, p_lo, p_hi): resampled means of each group with at least `least` rows.

    lo and hi are point -+ 1.96 SE, p_lo and p_hi the 2.5 and 97.5 percentiles.
    """
    rows = saved(numbered(df.filter(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, ident, value), by, ident).select("pos", by, value))
    groups = saved(rows.groupBy(by).agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).filter(F.col("_n") >= least))
    total = groups.agg(F.sum("_n")).first()[0] or 0
    # slots come in chunks that are dealt before they are exploded, and meet the rows by number in tasks of so many rows
    chunk = F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(50_000)))
    chunks = spread(groups.select(by, "_first", "_n", chunk.alias("_at")), total * reps)
    slots = chunks.withColumn("slot", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + 49_999, F.col("_n") - 1))))
    there, each = dealt(rows, total, "pos").hint("shuffle_hash"), None
    # some replicates at a time, whose shuffle goes before the next, so that disks never hold the draws of all
    at_once = max(LEAST_REPS, min(reps, DRAWS // max(total, 1)))
    for low in range(0, reps, at_once):
        some = slots.withColumn("rep", F.explode(F.sequence(F.lit(low), F.lit(min(low + at_once, reps) - 1))))
        drawn = some.select((F.col("_first") + u32(seed, F.col(by), F.col("rep"), F.col("slot")) % F.col("_n")).alias("pos"), F.col("rep").cast("int").alias("rep"))
        means = written(dealt(drawn, total, "pos").join(there, "pos").groupBy(by, "rep").agg(F.avg(value).alias("m")))
        each = means if each is None else each.unionByName(means)
    ends = each.groupBy(by).agg(F.stddev_samp("m").alias("se"), F.percentile("m", 0.025).alias("p_lo"), F.percentile("m", 0.975).alias("p_hi"))
    point = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("point")).filter(F.col("n") >= least)
    return point.join(ends, by).withColumns({"lo": F.col("point") - 1.96 * F.col("se"), "hi": F.col("point") + 1.96 * F.col("se")})


def cluster_bootstrap_mean(df: DataFrame, cluster: str, value: str, reps: int, seed: str) -> DataFrame:
    """(clusters, point, se, p_lo, p_hi): whole clusters are drawn; only their sums and counts meet the draws.

    Draws are rows of a range and are shuffled to the clusters: exploded replicates of a small table look small to the
    planner, which would send them through the driver, and stay in the small table's few tasks.
    """
    sums = numbered(df.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("c")), cluster)
    size = sums.count()
    drawn = ranged_draws(df.sparkSession, reps, size).withColumn("pos", u32(seed, F.col("rep"), F.col("slot")) % max(size, 1)).select("rep", "pos")
    each = drawn.hint("merge").join(sums.select("pos", "s", "c"), "pos").groupBy("rep").agg((F.sum("s") / F.sum("c")).alias("m"))
    spread = each.agg(F.stddev_samp("m").alias("se"), F.percentile("m", 0.025).alias("p_lo"), F.percentile("m", 0.975).alias("p_hi"))
    return sums.agg(F.count("*").alias("clusters"), (F.sum("s") / F.sum("c")).alias("point")).crossJoin(spread)


def jackknife_mean(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, k, point, se) leaving one row out, from totals minus one row; needs 3 rows."""
    w = Window.partitionBy(by)
    left = df.filter(F.col(value).isNotNull()).withColumns({"_n": F.count("*").over(w), "_s": F.sum(value).over(w)}).filter("_n >= 3")
    left = left.withColumn("_m", (F.col("_s") - F.col(value)) / (F.col("_n") - 1))
    out = left.groupBy(by).agg(F.count("*").alias("k"), F.avg(value).alias("point"), F.var_pop("_m").alias("_v"))
    return out.withColumn("se", F.sqrt((F.col("k") - 1) * F.col("_v"))).drop("_v")
