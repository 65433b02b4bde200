"""Experiment designs on pair tables (a, b): A-optimal picks and the power that a design buys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import replicates, saved, u32

RIDGE = 1e-3


def a_optimal_pairs(candidates: DataFrame, budget: int, score_weight: float = 0.0) -> DataFrame:
    """(step, a, b, gain): greedy picks of candidates (a, b, score), each the one that lowers the trace of the inverse
    information matrix most (plus score_weight times its score, scaled to 0..1); ties go to the smaller pair.

    With y = effect of a + effect of b, a pick adds a rank-1 term, so the inverse is I / RIDGE less one outer product for
    each pick. It is kept as a table of entities with one number for each pick. What a candidate's gain needs, |inv u|^2
    and u.inv u, changes by the entries of that pick at its two ends only: a pick costs two joins of the candidates with
    the entities, and the driver sees numbers of picks, never an entity table.
    """
    spark = candidates.sparkSession
    low, high = candidates.agg(F.min("score").cast("double"), F.max("score").cast("double")).first()
    if low is None:
        return spark.createDataFrame([], "step int, a long, b long, gain double")
    own = F.col("a") == F.col("b")
    scaled = (F.col("score") - low) / ((high - low) or 1.0) * score_weight
    state = candidates.select("a", "b", scaled.alias("bonus"), F.when(own, 4.0).otherwise(2.0).alias("e")).dropDuplicates(["a", "b"])
    state = saved(state.select("a", "b", "bonus", (F.col("e") / RIDGE**2).alias("q"), (F.col("e") / RIDGE).alias("e")))
    entities = saved(state.select(F.explode(F.array("a", "b")).alias("entity")).distinct().withColumn("vs", F.expr("CAST(array() AS array<double>)")))
    steps: list[tuple[int, object, object, float]] = []
    scales: list[float] = []
    for step in range(budget):
        gain = F.round(F.col("q") / (1 + F.col("e")) + F.col("bonus"), 6)
        best = state.orderBy(F.desc(gain), "a", "b").select("a", "b", "e", gain.alias("gain")).first()
        if best is None:
            break
        steps.append((step, best.a, best.b, best.gain))
        ends = {x.entity: x.vs for x in entities.filter(F.col("entity").isin([best.a, best.b])).collect()}
        both = [x + y for x, y in zip(ends[best.a], ends[best.b], strict=True)]
        times = (F.col("entity") == F.lit(best.a)).cast("double") + (F.col("entity") == F.lit(best.b)).cast("double")

        def less(weights: list[float], scales: list[float] = scales) -> Column:
            """The part of inv x that earlier picks take away, with x's products with their vectors."""
            out = F.lit(0.0)
            for k, (w, d) in enumerate(zip(weights, scales, strict=True)):
                out = out + F.col("vs")[k] * (w / d)
            return out

        entities = saved(entities.withColumn("v", times / RIDGE - less(both)))
        products = entities.agg(F.sum(F.col("v") * F.col("v")), *[F.sum(F.col("vs")[k] * F.col("v")) for k in range(step)]).first()
        z = entities.select("entity", "v", (F.col("v") / RIDGE - less(list(products[1:]))).alias("z"))
        d, square = 1 + best.e, products[0]
        state = state.join(z.select(F.col("entity").alias("a"), F.col("v").alias("va"), F.col("z").alias("za")), "a").join(z.select(F.col("entity").alias("b"), F.col("v").alias("vb"), F.col("z").alias("zb")), "b")
        hit = F.col("va") + F.col("vb")
        q = F.col("q") - 2 * hit / d * (F.col("za") + F.col("zb")) + hit * hit * square / d**2
        state = saved(state.filter((F.col("a") != F.lit(best.a)) | (F.col("b") != F.lit(best.b))).select("a", "b", "bonus", q.alias("q"), (F.col("e") - hit * hit / d).alias("e")))
        entities, scales = saved(entities.select("entity", F.concat("vs", F.array("v")).alias("vs"))), [*scales, d]
    kind = dict(candidates.dtypes)
    return spark.createDataFrame(steps, f"step int, a {kind['a']}, b {kind['b']}, gain double")


def suggested_entities(budget: int, appearances: int = 8) -> int:
    """Entities that a budget of pairs can measure so many times each, four at least."""
    return max(4, round(2 * budget / max(1, appearances)))


def normal_draw(*parts) -> Column:
    """A standard normal number from two hash draws."""
    u, v = ((u32(*parts, k) + 0.5) / F.lit(2.0**32) for k in ("u", "v"))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def appearances(designs: DataFrame) -> DataFrame:
    """(design, entity, n): measurements of a design that an entity takes part in."""
    return designs.select("design", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("entity")).groupBy("design", "entity").agg(F.count("*").alias("n"))


def design_measures(designs: DataFrame, least: int = 3) -> DataFrame:
    """(design, measurements, entities, max_share, min_appearances, estimable) of designs (design, a, b)."""
    n = designs.groupBy("design").agg(F.count("*").alias("measurements"))
    seen = appearances(designs).groupBy("design").agg(F.count("*").alias("entities"), F.max("n").alias("most"), F.min("n").alias("min_appearances"), F.count_if(F.col("n") >= least).alias("estimable"))
    return n.join(seen, "design").select("design", "measurements", "entities", (F.col("most") / F.col("measurements")).alias("max_share"), "min_appearances", "estimable")


def power_of_designs(designs: DataFrame, effect_sd: float, noise_sd: float, sims: int, perms: int, alpha: float = 0.05, least: int = 3, seed: str = "power") -> DataFrame:
    """(design, power): the share of simulations in which the variance of entity means beats its permutation null, for all
    designs (design, a, b) at once; 0 where fewer than four entities are measured `least` times.

    One table of (design, simulation, permutation, measurement); permutation 0 is the simulated order itself.
    """
    sim, perm = F.col("sim"), F.col("perm")
    placed = saved(designs.withColumn("pos", F.row_number().over(Window.partitionBy("design").orderBy("a", "b"))))  # a design's budgeted rows
    drawn = replicates(placed, sims, "sim")
    effects = normal_draw(seed, sim, F.col("a")) + normal_draw(seed, sim, F.col("b"))
    values = saved(drawn.select("design", "sim", "pos", (effect_sd * effects + noise_sd * normal_draw(seed, sim, F.col("a"), F.col("b"))).alias("y")))
    order = F.row_number().over(Window.partitionBy("design", "sim", "perm").orderBy(F.when(perm == 0, F.lit("")).otherwise(F.md5(F.concat_ws(":", F.lit(seed), sim, perm, F.col("pos")).cast("binary"))), "pos"))
    shuffled = replicates(values.select("design", "sim", "pos"), perms + 1, "perm").select("design", "sim", "perm", "pos", order.alias("from"))
    moved = shuffled.join(values.withColumnRenamed("pos", "from"), ["design", "sim", "from"])
    seen = appearances(placed).filter(F.col("n") >= least)
    fit = saved(seen.groupBy("design").agg(F.count("*").alias("eligible")).filter("eligible >= 4"))
    members = placed.select("design", "pos", F.explode(F.array_distinct(F.array("a", "b"))).alias("entity")).join(seen, ["design", "entity"], "left_semi").join(fit, "design", "left_semi")
    means = moved.join(saved(members), ["design", "pos"]).groupBy("design", "sim", "perm", "entity").agg(F.avg("y").alias("m"))
    spread = means.groupBy("design", "sim", "perm").agg(F.round(F.var_pop("m"), 9).alias("v"))
    stat = F.max(F.when(perm == 0, F.col("v")))
    tested = spread.groupBy("design", "sim").agg(stat.alias("stat"), F.collect_list(F.when(perm > 0, F.col("v"))).alias("null"))
    p = F.size(F.filter("null", lambda x: x >= F.col("stat"))) / perms
    power = tested.groupBy("design").agg((F.count_if(p < alpha) / sims).alias("power"))
    return designs.select("design").distinct().join(power, "design", "left").withColumn("power", F.coalesce("power", F.lit(0.0)))
