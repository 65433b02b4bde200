"""Null distributions of a statistic as a function of the observation count, and scores calibrated by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import key, numbered, replicates, saved, spread, u32


def top_k_mean(value: str, k: int) -> Column:
    """Mean of the k largest values; of all where there are fewer."""
    top = F.slice(F.sort_array(F.collect_list(value), asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.least(F.count(value), F.lit(k))


#: Named statistics that scores and nulls share.
STATISTICS = {
    "best_of_n": lambda v: F.max(v),
    "pass_rate": lambda v: F.avg(v),
    "median": lambda v: F.percentile(v, 0.5),
    "top_3_mean": lambda v: top_k_mean(v, 3),
    "top_20_mean": lambda v: top_k_mean(v, 20),
}


def scores(df: DataFrame, entity: str, value: str, statistic: str, least: int = 1) -> DataFrame:
    """(entity, score, n) of each entity with at least `least` observations."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(STATISTICS[statistic](value).alias("score"), F.count("*").alias("n")).filter(F.col("n") >= least)


def default_grid(scored: DataFrame, points: int = 14) -> DataFrame:
    """At most `points` log-spaced counts (n) from the smallest to the largest observed one, both kept."""
    ends = scored.agg(F.greatest(F.min("n"), F.lit(1)).alias("lo"), F.max("n").alias("hi")).withColumn("hi", F.greatest("hi", F.col("lo") + 1))
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    spaced = ends.withColumn("i", step).select(F.round(F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.col("i") / (points - 1))).cast("long").alias("n"))
    return spaced.union(ends.select("lo")).union(ends.select("hi")).distinct()


def spanning_grid(grid: list[int], counts: DataFrame) -> list[int]:
    """The grid, with the largest observed count (n) at its end where it stops short of it."""
    most = counts.agg(F.max("n")).first()[0] or 0
    return [*grid, int(most)] if most > max(grid) else list(grid)


def fit_null(control: DataFrame, value: str, order: tuple[str, ...], grid: DataFrame, statistic: str, draws: int = 200, seed: str = "null", blocks: str | None = None, least_rows: int = 50, least_blocks: int = 20) -> DataFrame:
    """(n, null_mean, null_sd, p95, p99): n values drawn with replacement from the control pool, `draws` times for each n.

    With blocks, a draw picks a block first and its values inside it, so that the spread between entities is part of
    the null. Draw indices are made first and meet the numbered pool in an equality join; the exploded draws are
    aggregated at once and never stored. Refuses pools under `least_rows` rows or `least_blocks` blocks.
    """
    pool = control.filter(F.col(value).isNotNull())
    slots = replicates(grid.select("n"), draws, "draw").withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    if blocks is None:
        pool = numbered(pool.select(F.col(value).alias("_value"), *order), *order).select("pos", F.col("_value").alias("value"))
        size = pool.agg(F.count("*").alias("pool")).first()["pool"]
        if size < least_rows:
            raise ValueError(f"{size} control rows are too few for a null; at least {least_rows} are needed")
        drawn = slots.withColumn("pos", u32(seed, F.col("n"), F.col("draw"), F.col("slot")) % size).join(pool.select("pos", "value"), "pos")
    else:
        inside = F.row_number().over(Window.partitionBy(blocks).orderBy(*order)) - 1
        pool = pool.select(F.col(blocks).alias("block"), F.col(value).alias("value"), inside.alias("pos"))
        named = numbered(pool.groupBy("block").agg(F.count("*").alias("size")), "block", name="block_pos")
        n_blocks = named.count()
        if n_blocks < least_blocks:
            raise ValueError(f"{n_blocks} blocks are too few to see the spread between blocks; at least {least_blocks} are needed")
        chosen = slots.withColumn("block_pos", u32(seed, "block", F.col("n"), F.col("draw")) % n_blocks).join(named, "block_pos")
        drawn = chosen.withColumn("pos", u32(seed, F.col("n"), F.col("draw"), F.col("slot")) % F.col("size")).join(pool, ["block", "pos"])
    each = drawn.groupBy("n", "draw").agg(STATISTICS[statistic]("value").alias("stat"))
    return each.groupBy("n").agg(F.avg("stat").alias("null_mean"), F.stddev_samp("stat").alias("null_sd"), F.percentile("stat", 0.95).alias("p95"), F.percentile("stat", 0.99).alias("p99"))


def fit_top_null(control: DataFrame, value: str, order: tuple[str, ...], grid: DataFrame, top: int = 3, draws: int = 4000, seed: str = "top", least_rows: int = 50) -> DataFrame:
    """(n, null_mean, null_sd, p95, p99) of the mean of the `top` largest of n values drawn with replacement.

    The largest of n uniform draws is distributed as V ** (1 / n), the next one as that times V ** (1 / (n - 1)), and so
    on; so a draw looks up `top` places of the sorted pool instead of n, and thousands of draws cost the same at any n.
    Nulls of the value are left out; with n under `top` all n values are averaged. Refuses pools under `least_rows`.
    """
    pool = numbered(control.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_value"), *order), "_value", *order)
    size = pool.agg(F.count("*").alias("pool")).first()["pool"]
    if size < least_rows:
        raise ValueError(f"{size} control rows are too few for a null; at least {least_rows} are needed")
    steps = F.explode(F.sequence(F.lit(1), F.least(F.lit(top), F.col("n")).cast("int")))
    slots = replicates(grid.select("n").filter("n >= 1"), draws, "draw").withColumn("slot", steps)
    share = F.ln((u32(seed, F.col("n"), F.col("draw"), F.col("slot")) + 0.5) / F.lit(2.0**32)) / (F.col("n") - F.col("slot") + 1)
    place = F.exp(F.sum(share).over(Window.partitionBy("n", "draw").orderBy("slot")))
    placed = slots.withColumn("pos", F.least(F.floor(place * size), F.lit(size - 1)))
    each = placed.join(pool.select("pos", "_value"), "pos").groupBy("n", "draw").agg(F.avg("_value").alias("stat"))
    return each.groupBy("n").agg(F.avg("stat").alias("null_mean"), F.stddev_samp("stat").alias("null_sd"), F.percentile("stat", 0.95).alias("p95"), F.percentile("stat", 0.99).alias("p99"))


def calibrate(scored: DataFrame, null: DataFrame) -> DataFrame:
    """Adds null_mean, null_sd, clamped and z, interpolated in log n between the grid rows around n; z is null for sd 0."""
    ahead = Window.orderBy("n")  # the grid has a few rows
    steps = null.select(F.col("n").alias("n0"), F.col("null_mean").alias("m0"), F.col("null_sd").alias("s0"), *[F.lead(c).over(ahead).alias(a) for c, a in (("n", "n1"), ("null_mean", "m1"), ("null_sd", "s1"))])
    edges = steps.agg(F.min("n0").alias("lo"), F.max("n0").alias("hi"))
    steps = steps.filter("n1 IS NOT NULL")
    placed = scored.crossJoin(F.broadcast(edges)).withColumn("at", F.least(F.greatest("n", "lo"), "hi"))
    last = F.col("at") == F.col("hi")
    inside = (F.col("at") >= F.col("n0")) & ((F.col("at") < F.col("n1")) | last & (F.col("n1") == F.col("hi")))
    joined = placed.join(F.broadcast(steps), inside)
    w = (F.ln("at") - F.ln("n0")) / (F.ln("n1") - F.ln("n0"))
    mean, sd = F.col("m0") + w * (F.col("m1") - F.col("m0")), F.col("s0") + w * (F.col("s1") - F.col("s0"))
    out = joined.withColumns({"null_mean": mean, "null_sd": sd, "clamped": F.col("at") != F.col("n")})
    return out.withColumn("z", F.when(F.col("null_sd") > 0, (F.col("score") - F.col("null_mean")) / F.col("null_sd"))).drop("lo", "hi", "at", "n0", "n1", "m0", "m1", "s0", "s1")


def label_permutations(df: DataFrame, ids: tuple[str, ...], label: str, reps: int, seed: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """rep, the id columns, the columns to keep with them, and a label permuted over the rows of each replicate.

    Rows are numbered once by their ids and once for all replicates by hash, both by ranges, and meet on the number. The
    planner takes the exploded replicates for a small table; the hint keeps both sides off the driver.
    """
    rows = df.select(*ids, label, *keep)
    targets = numbered(rows.select(*ids, *keep), *ids, name="_r")
    n = targets.count()
    hashed = replicates(spread(rows.select(*ids, label), n * reps), reps).withColumn("_h", F.md5(key(seed, F.col("rep"), *map(F.col, ids)).cast("binary")))
    sources = numbered(hashed, "rep", "_h", *ids, name="_p").select("rep", label, (F.col("_p") - F.col("rep") * n).alias("_r"))
    return sources.hint("merge").join(targets, "_r").drop("_r")


def random_subsets(df: DataFrame, ident: str, k: int, reps: int, seed: str) -> DataFrame:
    """Rows with rep: the k rows of the smallest hashes in each replicate, all where there are fewer.

    Only rows under a bound on the hash, 10 k of them expected in each replicate, are ranked; where some replicate has
    fewer than k under it, all are. Sorting all replicates of all rows takes each task's memory.
    """
    n = df.count()
    many = replicates(spread(df, n * reps), reps).withColumn("_h", F.md5(key(seed, F.col("rep"), F.col(ident)).cast("binary")))
    if n > 10 * k:
        under = saved(many.filter(F.col("_h") < F.lit(f"{10 * k * 16**12 // n:012x}")))
        full = under.groupBy("rep").count().filter(F.col("count") >= k).count()
        many = under if full == reps else many
    place = F.row_number().over(Window.partitionBy("rep").orderBy("_h", ident))
    return many.withColumn("_k", place).filter(F.col("_k") <= k).drop("_k", "_h")


def fit_mean_null(control: DataFrame, ident: str, vector: str, counts: DataFrame, top: int = 3, draws: int = 200, seed: str = "mean", blocks: str | None = None, grid: list[int] | None = None, least_rows: int = 50, least_blocks: int = 20) -> DataFrame:
    """(n, null_mean, null_sd, p95, p99): n control rows are drawn and averaged feature by feature; the statistic is the
    mean of the `top` largest feature means. counts (n): the observed counts, which the grid has to span.

    With blocks, a draw takes one block and then rows inside it. Refuses small pools, few blocks, rows without a block,
    vectors of unequal length, and a grid that stops short of the counts.
    """
    pool = control.filter(F.col(vector).isNotNull())
    facts = pool.agg(F.count("*").alias("rows"), F.count_if(F.col(blocks).isNull()).alias("unnamed") if blocks else F.lit(0).alias("unnamed"), F.min(F.size(vector)).alias("short"), F.max(F.size(vector)).alias("long")).first()
    ends = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    if facts["rows"] < least_rows:
        raise ValueError(f"{facts['rows']} control rows are too few for a null; at least {least_rows} are needed")
    if facts["unnamed"]:
        raise ValueError(f"{facts['unnamed']} control rows have no block")
    if facts["short"] != facts["long"]:
        raise ValueError("control vectors have unequal lengths")
    if ends["lo"] is None:
        raise ValueError("there are no observed counts")
    if grid is not None and (min(grid) > ends["lo"] or max(grid) < ends["hi"]):
        raise ValueError(f"the grid {min(grid)}..{max(grid)} doesn't span the observed counts {ends['lo']}..{ends['hi']}")
    spark = control.sparkSession
    steps = spark.createDataFrame([(int(n),) for n in sorted(set(grid))], "n long") if grid is not None else default_grid(counts)
    slots = replicates(steps, draws, "draw").withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    if blocks is None:
        numbers = numbered(pool.select(ident, vector), ident)
        drawn = slots.withColumn("pos", u32(seed, F.col("n"), F.col("draw"), F.col("slot")) % facts["rows"]).hint("merge").join(numbers, "pos")
    else:
        inside = F.row_number().over(Window.partitionBy(blocks).orderBy(ident)) - 1
        numbers = pool.select(F.col(blocks).alias("block"), vector, inside.alias("pos"))
        named = numbered(pool.groupBy(F.col(blocks).alias("block")).agg(F.count("*").alias("size")), "block", name="block_pos")
        n_blocks = named.count()
        if n_blocks < least_blocks:
            raise ValueError(f"{n_blocks} blocks are too few to see the spread between blocks; at least {least_blocks} are needed")
        chosen = slots.withColumn("block_pos", u32(seed, "block", F.col("n"), F.col("draw")) % n_blocks).join(named, "block_pos")
        drawn = chosen.withColumn("pos", u32(seed, F.col("n"), F.col("draw"), F.col("slot")) % F.col("size")).join(numbers, ["block", "pos"])
    means = F.array(*[F.avg(F.col(vector)[k].cast("double")) for k in range(facts["long"])])
    each = drawn.groupBy("n", "draw").agg(means.alias("m")).withColumn("best", F.slice(F.sort_array("m", asc=False), 1, top))
    stat = each.withColumn("stat", F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.size("best"))
    return stat.groupBy("n").agg(F.avg("stat").alias("null_mean"), F.stddev_samp("stat").alias("null_sd"), F.percentile("stat", 0.95).alias("p95"), F.percentile("stat", 0.99).alias("p99"))


def top_feature_scores(df: DataFrame, entity: str, vector: str, length: int, top: int = 3) -> DataFrame:
    """(entity, score, n): mean of the `top` largest feature means of each entity's rows."""
    means = F.array(*[F.avg(F.col(vector)[k].cast("double")) for k in range(length)])
    x = df.filter(F.col(vector).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(means.alias("m"), F.count("*").alias("n")).withColumn("best", F.slice(F.sort_array("m", asc=False), 1, top))
    return x.select("entity", (F.aggregate("best", F.lit(0.0), lambda a, v: a + v) / F.size("best")).alias("score"), "n")


def baseline_pool(log: DataFrame, variant: str, name: str, outcome: str) -> DataFrame:
    """The finite outcomes of one variant; an unknown one is refused with up to eight that exist."""
    pool = log.filter(F.col(variant) == name)
    if pool.isEmpty():
        known = [str(x[0]) for x in log.select(variant).distinct().orderBy(variant).limit(8).collect()]
        raise ValueError(f"no outcomes of {name}; there are {', '.join(known)}")
    return pool.filter(F.col(outcome).isNotNull() & ~F.isnan(F.col(outcome).cast("double")) & (F.abs(outcome) < float("inf")))


def permutation_pool(log: DataFrame, outcome: str) -> DataFrame:
    """All finite outcomes of all variants, with the caveat that belongs to them."""
    ok = F.col(outcome).isNotNull() & ~F.isnan(F.col(outcome).cast("double")) & (F.abs(outcome) < float("inf"))
    return log.filter(ok).withColumn("caveat", F.lit("pooled over all variants: good ones are part of this null"))


def equal_count_null(members: DataFrame, entity: str, group: str, values: DataFrame, value: str, reps: int, seed: str, least: int = 20) -> DataFrame:
    """(n, draws, null_mean, null_sd): entities' values are permuted and groups scored again by their mean; scores are
    pooled over groups of the same number of members. Pools under `least` scores are left out."""
    many = label_permutations(values, (entity,), value, reps, seed)
    scored = members.select(group, entity).distinct().hint("merge").join(many, entity).groupBy("rep", group).agg(F.avg(value).alias("score"), F.count("*").alias("n"))
    return scored.groupBy("n").agg(F.count("*").alias("draws"), F.avg("score").alias("null_mean"), F.stddev_samp("score").alias("null_sd")).filter(F.col("draws") >= least)


def flipped_directions(edges: DataFrame, seed: str, reps: int) -> DataFrame:
    """(rep, src, dst, w): directed edges with the antisymmetric part of each pair's weights turned or not by hash.

    w = s + a; both directions of a pair get the same turn, a missing direction counts as 0.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w_back"))
    both = replicates(edges.join(back, ["src", "dst"], "full").fillna(0.0, ["w", "w_back"]), reps)
    turn = F.when(u32(seed, F.col("rep"), F.least("src", "dst"), F.greatest("src", "dst")) % 2 == 0, 1).otherwise(-1)
    return both.select("rep", "src", "dst", ((F.col("w") + F.col("w_back")) / 2 + turn * (F.col("w") - F.col("w_back")) / 2).alias("w"))


def scatter_null(counts: DataFrame, bins: int, width: int, draws: int, seed: str) -> DataFrame:
    """(n, null_mean, null_sd) of the densest window's clustering ratio for n points thrown evenly into bins."""
    from .ranks import densest_window

    thrown = replicates(counts.select("n"), draws, "draw").withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    hits = thrown.groupBy("n", "draw", (u32(seed, F.col("n"), F.col("draw"), F.col("slot")) % bins).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    dense = replicates(counts.select("n"), draws, "draw").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(hits, ["n", "draw", "bin"], "left")
    each = densest_window(dense.select(F.struct("n", "draw").alias("by"), "bin", F.coalesce("c", F.lit(0)).alias("n")), "by", width, bins)
    return each.groupBy(F.col("by.n").alias("n")).agg(F.avg("ratio").alias("null_mean"), F.stddev_samp("ratio").alias("null_sd"))


def moderated_z(scored: DataFrame, prior: float, bands: int = 10) -> DataFrame:
    """Adds trend and z_moderated: each null_sd is blended, in logs, with the mean log sd of its band of counts, with
    weight n / (n + prior) of its own. scored: (entity, n, score, null_mean, null_sd)."""
    from .ranks import equal_count_bands

    known = scored.filter("null_sd > 0")
    banded = equal_count_bands(known, "n", "entity", bands)
    trend = banded.groupBy("band").agg(F.exp(F.avg(F.ln("null_sd"))).alias("trend"))
    own = F.col("n") / (F.col("n") + prior)
    sd = F.exp(own * F.ln("null_sd") + (1 - own) * F.ln("trend"))
    return banded.join(F.broadcast(trend), "band").withColumn("z_moderated", (F.col("score") - F.col("null_mean")) / sd)
