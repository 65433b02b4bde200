"""Feature-space operators on tables of (id, array) or long (id, feature, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standardised(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """(ident, feature, z): components minus their mean over their sd; constant components are left out."""
    long = df.select(ident, F.posexplode(vector).alias("feature", "x")).withColumn("x", F.col("x").cast("double"))
    m = long.groupBy("feature").agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd")).filter("sd > 0")
    return long.join(F.broadcast(m), "feature").select(ident, "feature", ((F.col("x") - F.col("mu")) / F.col("sd")).alias("z"))


def exact_neighbours(rows: DataFrame, queries: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """(query_id, vec_id, rank) of a stated query set against all rows: blocks of queries meet blocks of rows.

    A block pair gives each query's k nearest of its rows; a window then merges them. Distances are compared to nine
    places, ties go to the smaller id.
    """
    n_rows, n_queries = rows.count(), queries.count()
    rb, qb = max(1, -(-n_rows // block)), max(1, -(-n_queries // block))
    left = rows.select(F.col("vec_id"), F.col("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(rb)).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"))
    right = queries.select(F.col("vec_id"), F.col("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(qb)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rb - 1).cast("long"))).alias("r"))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64")})
        x, y = np.stack(a.embedding.to_numpy()).astype(float), np.stack(b.embedding.to_numpy()).astype(float)
        ids, out = a.vec_id.to_numpy(), []
        for name, v in zip(b.vec_id, y, strict=True):
            d = np.round(((x - v) ** 2).sum(1), 9)
            best = np.lexsort((ids, d))
            best = best[ids[best] != name][:k]
            out.append(pd.DataFrame({"query_id": name, "vec_id": ids[best], "d": d[best]}))
        return pd.concat(out)

    found = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInPandas(near, "query_id long, vec_id long, d double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank")


def trustworthiness(full: DataFrame, reduced: DataFrame, queries: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """(query_id, shared, penalty, trust) of a stated query set (vec_id): how many of the k nearest rows of the reduced
    space are among those of the full one, by how many ranks the others are further off there, and 1 - the penalty as a
    share of the largest one. full, reduced: (vec_id, embedding) of the same ids.

    Blocks of rows count, for each neighbour to be ranked, the rows that are nearer in the full space; only counts leave
    a block. Distances are compared to nine places, ties go to the smaller id. With fewer than 3 * k + 2 rows trust is
    null.
    """
    from .draws import saved

    n_rows, ids = full.count(), saved(queries.select("vec_id").distinct())
    found = exact_neighbours(reduced.select("vec_id", "embedding"), reduced.join(ids, "vec_id", "left_semi").select(*[F.col(c).alias(c) for c in ("vec_id", "embedding")]), k, block)
    named = found.join(full.select("vec_id", F.col("embedding").alias("there")), "vec_id").groupBy(F.col("query_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "there"))).alias("near"))
    asked = saved(named.join(full.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id"))
    rb, qb = max(1, -(-n_rows // block)), max(1, -(-asked.count() // block))
    left = full.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(rb)).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rb - 1).cast("long")))
    near, there = F.transform("near", lambda x: x["vec_id"]), F.flatten(F.transform("near", lambda x: x["there"]))
    right = asked.select("query_id", F.col("embedding").alias("embedding"), near.alias("near"), there.alias("there"), F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("q"), spread.alias("r"))

    def nearer(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "place": pd.Series(dtype="int32"), "closer": pd.Series(dtype="int64")})
        x, ids = np.stack(a.embedding.to_numpy()).astype(float), a.vec_id.to_numpy()
        out = []
        for row in b.itertuples():
            v = np.asarray(row.embedding, dtype=float)
            d = np.round(((x - v) ** 2).sum(1), 9)
            at = np.round(((np.asarray(row.there, dtype=float).reshape(len(row.near), -1) - v) ** 2).sum(1), 9)
            other = ids != row.query_id
            closer = [int((other & ((d < far) | ((d == far) & (ids < name)))).sum()) for far, name in zip(at, row.near, strict=True)]
            out.append(pd.DataFrame({"query_id": row.query_id, "place": np.arange(len(closer), dtype="int32"), "closer": closer}))
        return pd.concat(out)

    counts = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInPandas(nearer, "query_id long, place int, closer long")
    ranks = counts.groupBy("query_id", "place").agg((F.sum("closer") + 1).alias("rank"))
    each = ranks.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("shared"), F.sum(F.greatest(F.col("rank") - k, F.lit(0))).alias("penalty"))
    most = k * (2 * n_rows - 3 * k - 1)
    return each.withColumn("trust", 1 - 2 * F.col("penalty") / F.lit(float(most)) if n_rows >= 3 * k + 2 else F.lit(None).cast("double"))


def binned_matrix(long: DataFrame, row: str, column: str, value: str, width: int, most: float) -> DataFrame:
    """(row, bin, shade): columns in order of their medians, `width` of them a bin, and medians clipped to +-most."""
    from .draws import numbered

    medians = long.groupBy(column).agg(F.percentile(F.col(value).cast("double"), 0.5).alias("_m"))
    placed = numbered(medians, "_m", column, name="_pos").select(column, F.floor(F.col("_pos") / width).cast("int").alias("bin"))
    x = long.join(F.broadcast(placed), column).groupBy(row, "bin").agg(F.percentile(F.col(value).cast("double"), 0.5).alias("m"))
    return x.select(row, "bin", F.least(F.greatest("m", F.lit(-most)), F.lit(most)).alias("shade"))


def hopkins(rows: DataFrame, length: int, points: int, seed: str, pick: str) -> DataFrame:
    """One row (hopkins): distances from evenly drawn points to their nearest rows, over those plus the distances from
    drawn rows to theirs; 0.5 for an even spread, towards 1 for clusters. rows: (vec_id, embedding)."""
    from .draws import key, saved, u32

    box = rows.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
    slots = box.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", u32(seed, F.col("slot"), F.col("i") + 1) / F.lit(2.0**32) * (F.col("hi") - F.col("lo")) + F.col("lo"))
    even = slots.groupBy("slot").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("embedding")).select((-1 - F.col("slot")).cast("long").alias("vec_id"), "embedding")
    wide = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    drawn = wide.orderBy(F.md5(key(pick, F.col("vec_id")).cast("binary")), "vec_id").limit(points)
    asked = saved(even.unionByName(drawn))
    near = exact_neighbours(wide, asked, 1).join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(wide, "vec_id")
    d = F.sqrt(F.aggregate(F.zip_with("q", "embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    s = near.agg(F.sum(F.when(F.col("query_id") < 0, d)).alias("u"), F.sum(F.when(F.col("query_id") >= 0, d)).alias("w"))
    return s.select((F.col("u") / (F.col("u") + F.col("w"))).alias("hopkins"))
