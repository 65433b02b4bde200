"""k-means over several k and several shuffled tables at once, with simplified silhouettes against the shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .draws import key, numbered, saved


def column_shuffles(rows: DataFrame, ident: str, vector: str, reps: int, seed: str) -> DataFrame:
    """(rep, ident, vector): rep 0 is the table itself; in the others each component is permuted on its own.

    Both orders of a component and replicate are blocks of one size in one numbering, so equal positions are a
    permutation; no task sorts a whole component.
    """
    real = rows.select(F.lit(0).alias("rep"), ident, F.col(vector).cast("array<double>").alias(vector))
    if not reps:
        return real
    long = rows.select(ident, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    long = saved(long.withColumn("h", F.md5(key(seed, F.col("rep"), F.col("i"), F.col(ident)).cast("binary"))))
    values = numbered(long.select("rep", "i", "h", "x", ident), "rep", "i", "h", ident).select("pos", "x")
    places = numbered(long.select("rep", "i", ident), "rep", "i", ident).select("pos", "rep", "i", ident)
    mixed = places.join(values, "pos").groupBy("rep", ident).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return real.unionByName(mixed.select("rep", ident, F.transform("v", lambda e: e["x"]).alias(vector)))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def k_means(tables: DataFrame, ident: str, vector: str, ks: list[int], rounds: int, seed: str) -> DataFrame:
    """(rep, k, ident, cluster, own, next): after so many rounds each row's cluster, and the distances to its centre and
    to the nearest other one. tables: (rep, ident, vector) of one length.

    Starts are the rows of the k smallest hashes. All centres of all k and replicates are one table, of sum(ks) entries for
    each replicate, that is sent to the rows; a round is a scan with grouped means of components, and no vector is shuffled.
    """
    tables = saved(tables)
    length = tables.agg(F.max(F.size(vector))).first()[0] or 0
    starts = None
    for k in ks:
        chosen = tables.filter("rep = 0").select(ident).orderBy(F.md5(key(seed, k, F.col(ident)).cast("binary")), ident).limit(k).collect()
        part = tables.sparkSession.createDataFrame([(k, c, x[0]) for c, x in enumerate(chosen)], f"k int, cluster int, {ident} {dict(tables.dtypes)[ident]}")
        starts = part if starts is None else starts.unionByName(part)
    centres = saved(tables.join(F.broadcast(starts), ident).select("rep", "k", "cluster", F.col(vector).alias("centre")))  # sum(ks) rows a replicate

    def assigned() -> DataFrame:
        groups = centres.groupBy("rep", "k").agg(F.collect_list(F.struct("cluster", "centre")).alias("c")).groupBy("rep").agg(F.collect_list(F.struct("k", "c")).alias("all"))
        there = lambda c: F.struct(F.round(F.sqrt(squared_distance(F.col(vector), c["centre"])), 9).alias("d"), c["cluster"].alias("cluster"))
        each = F.transform("all", lambda g: F.struct(g["k"].alias("k"), F.slice(F.sort_array(F.transform(g["c"], there)), 1, 2).alias("near")))
        return tables.join(F.broadcast(groups), "rep").select("rep", ident, vector, F.explode(each).alias("_x")).select("rep", "_x.k", ident, "_x.near", vector)

    for _ in range(rounds):
        means = F.array(*[F.avg(F.col(vector)[i]) for i in range(length)])
        centres = saved(assigned().groupBy("rep", "k", F.col("near")[0]["cluster"].alias("cluster")).agg(means.alias("centre")))
    return assigned().select("rep", "k", ident, F.col("near")[0]["cluster"].alias("cluster"), F.col("near")[0]["d"].alias("own"), F.get("near", F.lit(1))["d"].alias("next"))


def silhouettes(assigned: DataFrame) -> DataFrame:
    """(rep, k, silhouette): the mean of (next - own) / max(next, own), centres standing for clusters; 0 for a row on
    two centres and null where a single cluster is left."""
    most = F.greatest("own", "next")
    return assigned.groupBy("rep", "k").agg(F.avg(F.when(most > 0, (F.col("next") - F.col("own")) / most).when(F.col("next").isNotNull(), 0.0)).alias("silhouette"))


def against_shuffles(scored: DataFrame) -> DataFrame:
    """(k, silhouette, null_mean, null_sd, z, best): each k's silhouette against its shuffles, and whether it is the best."""
    null = scored.filter("rep > 0").groupBy("k").agg(F.avg("silhouette").alias("null_mean"), F.stddev_samp("silhouette").alias("null_sd"))
    real = scored.filter("rep = 0").select("k", "silhouette")
    top = real.agg(F.max_by("k", F.struct(F.round("silhouette", 9), -F.col("k"))).alias("_top"))
    x = real.join(null, "k", "left").crossJoin(F.broadcast(top))  # one row
    return x.select("k", "silhouette", "null_mean", "null_sd", ((F.col("silhouette") - F.col("null_mean")) / F.nullif(F.col("null_sd"), F.lit(0.0))).alias("z"), (F.col("k") == F.col("_top")).alias("best"))
