"""Decision operators: gated assessment, shortlists, designs, registries. Null means not measured and never passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import saved

#: Pairs for each one of the budget that are decided at first.
FIRST_PAIRS = 16


def assessment(recurrent: Column, indel_share: Column, truncating_share: Column, private: Column, essential: Column, dependent: Column, endpoints: Column, unclear: Column, recurrence: int = 10, private_floor: float = 0.8, unclear_most: float = 0.6, essential_share: float = 0.9) -> tuple[Column, Column]:
    """Arrays of strategies (name, admitted, because) and gates (number, name, passed) of a candidate.

    A strategy whose evidence wasn't measured isn't admitted and says so; a gate without evidence fails.
    """

    def strategy(name: str, admitted: Column, measured: Column, no: str) -> Column:
        ok = F.coalesce(admitted, F.lit(False))
        return F.struct(F.lit(name).alias("name"), ok.alias("admitted"), F.when(~measured, "not measured").when(ok, "admitted").otherwise(no).alias("because"))

    measured = truncating_share.isNotNull()
    knock = F.when(essential.isNotNull() & essential, False).when(dependent.isNotNull(), dependent < essential_share).when(essential.isNotNull(), True)
    strategies = F.array(
        strategy("allele-specific", recurrent >= recurrence, recurrent.isNotNull(), "too few carriers of one allele"),
        strategy("base editing", indel_share <= 0.5, indel_share.isNotNull(), "indels dominate"),
        strategy("skipping", truncating_share >= 0.3, measured, "few truncating"),
        strategy("replacement", private.isNotNull() & (truncating_share >= 0.3), private.isNotNull(), "not loss of function"),
        strategy("knockdown", knock, knock.isNotNull(), "essential everywhere"),
    )
    safe = F.when(essential.isNotNull(), ~essential).otherwise(dependent < essential_share)
    gates = F.array(*[F.struct(F.lit(k).alias("number"), F.lit(n).alias("name"), F.coalesce(ok, F.lit(False)).alias("passed")) for k, n, ok in ((2, "power", endpoints > 0), (3, "confound", safe), (6, "prior", unclear < unclear_most))])
    return strategies, gates


def shortlist(assessed: DataFrame, order: list[Column], slots: int, module: str) -> DataFrame:
    """The first `slots` candidates, in a stated order, with an admitted strategy and no failed gate; adds the size of
    their module in the list and whether the list is spread (largest module at most max(2, slots // 3))."""
    good = F.exists("strategies", lambda s: s["admitted"]) & F.forall("gates", lambda g: g["passed"])
    chosen = assessed.filter(good).orderBy(*order).limit(slots)
    inside = F.count("*").over(Window.partitionBy(module))
    return chosen.withColumn("in_module", inside).withColumn("spread", F.max("in_module").over(Window.partitionBy()) <= max(2, slots // 3))  # at most `slots` rows


def balanced_pairs(candidates: DataFrame, budget: int, cap: int) -> DataFrame:
    """(a, b, score) taken in falling score order while both ends have fewer than `cap` taken pairs, then cut to budget.

    Equal to the sequential scan, which decides a pair by those above it: so the pairs above a score are decided alone,
    and a lower score is tried until they fill the budget or all pairs are in.
    """
    every = saved(candidates.select("a", "b", "score", F.struct(-F.col("score"), F.col("a"), F.col("b")).alias("order")))
    n, most = every.count(), FIRST_PAIRS * max(budget, 1)
    while True:
        above = every
        if most < n:
            # by the negated score, as the order has it: nulls come first, NaN last
            bound = every.agg(F.percentile_approx(-F.col("score"), most / n, 1_000_000)).first()[0]
            if bound is not None:
                above = every.filter(F.col("score").isNull() | (-F.col("score") <= F.lit(bound)))
        taken = saved(_scanned(above, cap))
        if most >= n or taken.count() >= budget:
            return taken.orderBy("order").limit(budget).select("a", "b", "score")
        most *= 16


def _scanned(pairs: DataFrame, cap: int) -> DataFrame:
    """The taken ones of pairs (a, b, score, order): a pair is taken once all pairs that could fill its ends' places above
    it are decided; rounds end when none is undecided."""
    state = saved(pairs.withColumn("state", F.lit(0)))
    while state.filter("state = 0").limit(1).count():
        ends = state.select("a", "b", "order", "state", F.explode(F.array("a", "b")).alias("end"))
        above = Window.partitionBy("end").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
        seen = ends.withColumns({"taken": F.coalesce(F.sum(F.when(F.col("state") == 1, 1).otherwise(0)).over(above), F.lit(0)), "open": F.coalesce(F.sum(F.when(F.col("state") == 0, 1).otherwise(0)).over(above), F.lit(0))})
        verdict = seen.groupBy("a", "b").agg(F.max(F.col("taken") >= cap).alias("full"), F.min(F.col("taken") + F.col("open") < cap).alias("free"))
        state = saved(state.join(verdict, ["a", "b"]).withColumn("state", F.when(F.col("state") != 0, F.col("state")).when(F.col("full"), -1).when(F.col("free"), 1).otherwise(0)).drop("full", "free"))
    return state.filter("state = 1")


def split_budget(candidates: DataFrame, budget: int, seed: str) -> DataFrame:
    """(a, b, score, place, half): the best `budget` pairs in two disjoint halves, dealt by hash."""
    from .draws import u32

    best = candidates.orderBy(F.desc("score"), "a", "b").limit(budget)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "a", "b"))  # at most `budget` rows
    return best.withColumns({"place": place.cast("int"), "half": (u32(seed, F.col("a"), F.col("b")) % 2).cast("int")})


def focused_pairs(candidates: DataFrame, ends: int) -> DataFrame:
    """All candidate pairs among the `ends` strongest left ends and the `ends` strongest right ones, by summed score."""

    def strongest(side: str) -> DataFrame:
        return candidates.groupBy(side).agg(F.round(F.sum("score"), 2).alias("s")).orderBy(F.desc("s"), side).limit(ends).select(side)

    return candidates.join(F.broadcast(strongest("a")), "a", "left_semi").join(F.broadcast(strongest("b")), "b", "left_semi").select("a", "b", "score")


def drift(registry: DataFrame, metrics: DataFrame, places: int = 6) -> DataFrame:
    """(metric, registered, measured, holds): registered values against recomputed ones, equal to so many places."""
    x = registry.join(metrics, "metric", "left")
    return x.withColumn("holds", F.coalesce(F.round("registered", places) == F.round("measured", places), F.lit(False)))
