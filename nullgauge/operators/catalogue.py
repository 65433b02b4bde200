"""Catalogue measures over generic tables: contracts, classifiers, shares, flags, information kept, gaps, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import numbered, replicates, saved, u32
from .ranks import tie_ranks


def entity_contract(scores: DataFrame) -> DataFrame:
    """(field, value): what the standard contract of a table (entity, score, n) asks about, in one pass."""
    row = scores.agg(F.count("*").alias("entities"), (F.count("*") - F.count_distinct("entity")).alias("repeated"), F.count_if(F.col("score").isNull() | F.isnan(F.col("score").cast("double"))).alias("without score"), F.count_if(F.col("n").isNull() | (F.col("n") < 1)).alias("count under 1"), F.max("n").alias("largest count"))
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("double").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


# Classes of variant notations, the notation that tells each, and its pattern; the first that holds counts.
CONSEQUENCES = [
    ("frameshift", "protein", "fs"),
    ("nonsense", "protein", r"Ter|\*$|p\.[^*]{0,11}\*"),
    ("splice region", "coding", r"(?i:splice)|c\.[-0-9_+*]+[+-][0-9]"),
    ("indel", "coding", "del.*ins|ins.*del"),
    ("duplication", "coding", "dup"),
    ("deletion", "coding", "del"),
    ("insertion", "coding", "ins"),
    ("missense", "protein", r"p\.\(?[A-Z][a-z]{2}[0-9]+[A-Z][a-z]{2}\)?"),
    ("synonymous", "protein", r"p\.\(=\)|p\.="),
]


def consequence(coding: Column, protein: Column) -> Column:
    """Class of a variant by the rule table; a missing notation meets no rule of its own."""
    notation = {"coding": coding, "protein": protein}
    met = F.array(*[F.when(notation[side].rlike(pattern), F.lit(name)) for name, side, pattern in CONSEQUENCES])
    return F.coalesce(F.get(F.array_compact(met), F.lit(0)), F.lit("unclassified"))


def coding_position(coding: Column) -> Column:
    return F.nullif(F.regexp_extract(coding, r"^c\.([0-9]+)", 1), F.lit("")).cast("int")


def weighted_share(df: DataFrame, by: str, ident: str, hit: str, weight: str, reps: int, seed: str) -> DataFrame:
    """(by, share, se, lo, hi): weight of hits over all weight, and its bootstrap interval."""
    at = numbered(df.select(by, ident, hit, weight), by, ident, name="_at")
    ends = at.groupBy(by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    at = saved(at.join(F.broadcast(ends), by).withColumn("_pos", F.col("_at") - F.col("_first")))
    share = F.sum(F.when(F.col(hit), F.col(weight)).otherwise(0.0)) / F.sum(weight)
    drawn = replicates(at.select(by, F.col("_pos").alias("_slot"), "_n"), reps).withColumn("_pos", u32(seed, F.col(by), F.col("rep"), F.col("_slot")) % F.col("_n")).select(by, "rep", "_pos")
    each = drawn.join(at.select(by, "_pos", hit, weight), [by, "_pos"]).groupBy(by, "rep").agg(share.alias("s")).groupBy(by).agg(F.stddev_samp("s").alias("se"))
    return at.groupBy(by).agg(share.alias("share")).join(each, by).withColumns({"lo": F.col("share") - 1.96 * F.col("se"), "hi": F.col("share") + 1.96 * F.col("se")})


def fold_flags(df: DataFrame, entity: str, kind: str, value: str, one: str, two: str, fold: float) -> DataFrame:
    """(entity, mixed, fold, apart): entities with several kinds, and two kinds' values that differ so many times."""
    x = df.groupBy(entity).agg(F.max(F.when(F.col(kind) == one, F.col(value))).alias("a"), F.max(F.when(F.col(kind) == two, F.col(value))).alias("b"), F.count_distinct(kind).alias("kinds"))
    ratio = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest("a", "b") / F.nullif(F.least("a", "b"), F.lit(0.0)))
    return x.select(entity, (F.col("kinds") > 1).alias("mixed"), ratio.alias("fold"), F.coalesce(ratio >= fold, F.lit(False)).alias("apart"))


def presence(layers: dict[str, DataFrame], key: str) -> DataFrame:
    """(layer, n, only_here, coverage): keys of each layer, those of no other one, and its share of all keys."""
    rows = saved(reduce(lambda a, b: a.unionByName(b), [df.select(F.col(key).alias("_k")).distinct().withColumn("layer", F.lit(n)) for n, df in layers.items()]))
    keys = rows.groupBy("_k").agg(F.count("*").alias("_layers"))
    total = keys.count()
    return rows.join(keys, "_k").groupBy("layer").agg(F.count("*").alias("n"), F.count_if(F.col("_layers") == 1).alias("only_here")).withColumn("coverage", F.col("n") / max(total, 1))


def coarse_graining(rows: DataFrame, entity: str, feature: str, category: str, scale: str, finest: str) -> DataFrame:
    """(scale, alphabet, mi, compression, retained): information of each scale's features about the category, every
    entity weighing 1, against the finest scale."""
    from .tables import mutual_information

    weighted = rows.withColumn("_w", 1.0 / F.count("*").over(Window.partitionBy(scale, entity)))
    mi = mutual_information(weighted, feature, category, "_w", scale).select(scale, "mi")
    sizes = rows.groupBy(scale).agg(F.count_distinct(feature).alias("alphabet"))
    both = saved(sizes.join(mi, scale))
    fine = both.filter(F.col(scale) == finest).select(F.col("alphabet").alias("_a"), F.col("mi").alias("_m"))
    return both.crossJoin(F.broadcast(fine)).select(scale, "alphabet", "mi", (F.col("_a") / F.col("alphabet")).alias("compression"), (F.col("mi") / F.nullif(F.col("_m"), F.lit(0.0))).alias("retained"))


def binary_information(rows: DataFrame, scale: str, feature: str, category: str) -> DataFrame:
    """(scale, one, mi): information of features about each category alone against all others.

    Cells of a category follow from its counts and the features' totals; nothing is repeated for each category but the
    table of cells.
    """
    cells = rows.groupBy(scale, feature, F.col(category).alias("one")).agg(F.count("*").alias("_c"))
    features = cells.groupBy(scale, feature).agg(F.sum("_c").alias("_f"))
    ones = cells.groupBy(scale, "one").agg(F.sum("_c").alias("_o"))
    totals = ones.groupBy(scale).agg(F.sum("_o").alias("_n"))
    grid = features.join(ones, scale).join(totals, scale).join(cells, [scale, feature, "one"], "left").withColumn("_c", F.coalesce("_c", F.lit(0)))

    def part(count: Column, margin: Column) -> Column:
        p = count / F.col("_n")
        return F.when(count > 0, p * F.log2(p / (F.col("_f") / F.col("_n") * margin / F.col("_n")))).otherwise(0.0)

    return grid.groupBy(scale, "one").agg(F.sum(part(F.col("_c"), F.col("_o")) + part(F.col("_f") - F.col("_c"), F.col("_n") - F.col("_o"))).alias("mi"))


def assessed_frequency(df: DataFrame, by: list[str], seen: str, least: int = 2) -> DataFrame:
    """(by..., k, n, frequency) of 1 / 0 / null (not assessed) observations with at least `least` assessed."""
    return df.groupBy(*by).agg(F.sum(seen).alias("k"), F.count(seen).alias("n")).filter(F.col("n") >= least).withColumn("frequency", F.col("k") / F.col("n"))


def frequency_gaps(df: DataFrame, curated: str) -> DataFrame:
    """(gap, n, mean_frequency): absolute differences to a curated frequency in three classes."""
    gap = F.abs(F.col("frequency") - F.col(curated))
    return df.groupBy(F.when(gap < 0.1, "near").when(gap < 0.3, "apart").otherwise("far").alias("gap")).agg(F.count("*").alias("n"), F.avg("frequency").alias("mean_frequency"))


def shared_resources(needs: DataFrame, plan: str, need: str, cost: str, wait: str) -> DataFrame:
    """(plan, items, cost, slowest, by_cost, by_items, moved, saved): plans' needs bought one by one, their ranks in two
    orders, and what buying every need once saves in all."""
    plans = saved(needs.groupBy(plan).agg(F.count("*").alias("items"), F.sum(cost).alias("cost"), F.max(wait).alias("slowest")))
    once = needs.groupBy(need).agg(F.max(cost).alias("c")).agg(F.sum("c").alias("once")).crossJoin(plans.agg(F.sum("cost").alias("all")))
    ranked = tie_ranks(tie_ranks(plans, "cost", "c", descending=True), "items", "i", descending=True)
    x = ranked.crossJoin(F.broadcast(once.select((F.col("all") - F.col("once")).alias("saved"))))
    return x.select(plan, "items", "cost", "slowest", F.col("c_min").alias("by_cost"), F.col("i_min").alias("by_items"), (F.col("i_min") - F.col("c_min")).alias("moved"), "saved")


def gap_types(universe: DataFrame, holders: DataFrame, key: str, kind: str, hub: str) -> DataFrame:
    """(gap, n): why keys lack a field: a counterpart of their kind has it and a hub links them, no hub does, or none has it."""
    x = universe.join(holders.select(key).distinct().withColumn("_has", F.lit(True)), key, "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    kinds = x.groupBy(kind).agg(F.max("_has").alias("_twin"))
    x = x.join(F.broadcast(kinds), kind)
    gap = F.when(F.col("_has"), "present").when(F.col(hub) & F.col("_twin"), "interoperability").when(F.col("_twin"), "accessibility").otherwise("epistemic")
    return x.groupBy(gap.alias("gap")).agg(F.count("*").alias("n"))


def bias_band(measure: Column) -> Column:
    return F.when(F.abs(measure) < 0.1, "weak").when(F.abs(measure) < 0.3, "some").otherwise("strong")


def z_audit(reported: DataFrame, draws: int) -> DataFrame:
    """One row about reported z (z, null_mean, null_sd): the largest, those beyond what the draws resolve at 1 in
    `draws`, nulls narrower than 1 %, and loud ones above 10."""
    from statistics import NormalDist

    edge = NormalDist().inv_cdf(1 - 1 / draws)
    z = F.abs("z")
    return reported.agg(F.count("*").alias("n"), F.max(z).alias("largest"), F.count_if(z > edge).alias("beyond_draws"), F.count_if(F.col("null_sd") / F.col("null_mean") < 0.01).alias("narrow"), F.count_if(z > 10).alias("loud"))


def verified(authored: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(verdict, n) of authored (ref, name) against a catalogue (ref, catalogue_name)."""
    x = authored.join(catalogue, "ref", "left")
    verdict = F.when(F.col("catalogue_name").isNull(), "unresolved").when(F.col("catalogue_name") != F.col("name"), "name differs").otherwise("verified")
    return x.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def threshold_check(registry: DataFrame, used: DataFrame) -> DataFrame:
    """(id, declared, used, holds, broken): declared thresholds against used ones; pre-registered ones may not have met the data."""
    x = registry.join(used, "id", "left")
    return x.select("id", "declared", "used", F.coalesce(F.col("declared") == F.col("used"), F.lit(False)).alias("holds"), (F.col("pre_registered") & F.col("contact")).alias("broken"))
