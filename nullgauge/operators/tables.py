"""Evidence-table operators: coverage, composition, conflict, missingness, joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contract_problems(df: DataFrame, columns: dict[str, dict]) -> DataFrame:
    """(column, problem) for every broken rule of a contract, all in one pass over the data.

    A rule may hold: type, required, unique, allow_null, min, max. Missing columns and types are read from the schema.
    """
    spark, found, checks = df.sparkSession, [], {}
    types = dict(df.dtypes)
    for name, rule in columns.items():
        if name not in types:
            if rule.get("required", True):
                found.append((name, "missing"))
            continue
        if "type" in rule and types[name] != rule["type"]:
            found.append((name, f"type {types[name]}, expected {rule['type']}"))
        c = F.col(name)
        if not rule.get("allow_null", False):
            checks[name, "null"] = F.count_if(c.isNull()) > 0
        if rule.get("unique"):
            checks[name, "not unique"] = F.count_distinct(c) < F.count(c)
        if "min" in rule:
            checks[name, "under minimum"] = F.coalesce(F.min(c) < rule["min"], F.lit(False))
        if "max" in rule:
            checks[name, "over maximum"] = F.coalesce(F.max(c) > rule["max"], F.lit(False))
    if checks:
        row = df.agg(*[x.alias(f"c{k}") for k, x in enumerate(checks.values())]).first()
        found += [name for name, broken in zip(checks, row, strict=True) if broken]
    return spark.createDataFrame(found, "column string, problem string")


def merged_layers(key: str, *layers: tuple[str, DataFrame]) -> DataFrame:
    """One wide record per key from keyed layers with disjoint columns, and n_layers, the number that hold the key."""
    marked = [df.withColumn(f"in_{name}", F.lit(True)) for name, df in layers]
    out = reduce(lambda a, b: a.join(b, key, "full"), marked)
    flags = [F.coalesce(f"in_{name}", F.lit(False)) for name, _ in layers]
    return out.withColumn("n_layers", sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))).drop(*[f"in_{name}" for name, _ in layers])


def missing_pattern(df: DataFrame, fields: list[str]) -> DataFrame:
    """(pattern, n, gaps): names of the missing fields of each row, counted; complete rows are 'complete'."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fields]))
    shown = df.select(F.when(F.size(names) == 0, "complete").otherwise(F.array_join(names, "+")).alias("pattern"), F.size(names).alias("gaps"))
    return shown.groupBy("pattern", "gaps").agg(F.count("*").alias("n"))


def conflict_levels(df: DataFrame, item: str, context: str, verdict: str) -> DataFrame:
    """(level, n): items whose verdicts agree, conflict inside a context, or only across contexts."""
    inside = df.groupBy(item, context).agg(F.count_distinct(verdict).alias("k"), F.min(verdict).alias("lo"), F.max(verdict).alias("hi"))
    items = inside.groupBy(item).agg(F.max("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    level = F.when(F.col("k") > 1, "within context").when(F.col("lo") != F.col("hi"), "across contexts").otherwise("agree")
    return items.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def unit_weight_composition(df: DataFrame, unit: str, category: str, size: str) -> DataFrame:
    """(category, weight, share): each unit weighs 1, split over its categories by their largest size."""
    most = df.groupBy(unit, category).agg(F.max(size).alias("m"))
    shares = most.withColumn("w", F.col("m") / F.sum("m").over(Window.partitionBy(unit)))
    out = shares.groupBy(category).agg(F.sum("w").alias("weight"))
    return out.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy()))  # one row per category


def bins(value: Column, n: int) -> Column:
    """Equal-width bin of a share in [0, 1], clamped to 0 .. n - 1."""
    return F.least(F.greatest(F.floor(value * n), F.lit(0)), F.lit(n - 1)).cast("int")


def range_join(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Points inside closed intervals: both sides are dealt to buckets of the width, so the join is one of equality."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    i = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(i, "_b").filter(F.col(at).between(F.col(low), F.col(high))).drop("_b")


def range_totals(points: DataFrame, at: str, value: str, intervals: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """(low, high, n, total) of the points inside each distinct closed interval, for those that hold any.

    Points are summed by place and equal intervals are taken once before they meet, so no pair of a point and an interval
    is a row; the join grows with places and intervals, not with their rows.
    """
    places = points.groupBy(at).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    met = range_join(places, at, intervals.select(low, high).distinct(), low, high, width)
    return met.groupBy(low, high).agg(F.sum("_n").alias("n"), F.sum("_s").alias("total"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, carry: list[str]) -> DataFrame:
    """left with the latest earlier or equal row of right in the same group: a union and one window, no range join."""
    rows = left.select(by, at, F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*carry).alias("s")).schema["s"].dataType).alias("_right"), F.lit(1).alias("_side"))
    rows = rows.unionByName(right.select(by, at, F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), F.struct(*carry).alias("_right"), F.lit(0).alias("_side")))
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1").select("_left.*", *[F.col("_right")[c].alias(c) for c in carry])


def set_index(df: DataFrame, facet: str, member: str, least: int = 8, most: int = 300) -> DataFrame:
    """(facet, n, members, below_floor): sorted members of each value with at least `least`, the list cut at `most`."""
    sizes = df.select(facet, member).distinct()
    listed = sizes.withColumn("_r", F.row_number().over(Window.partitionBy(facet).orderBy(member)))
    out = listed.groupBy(facet).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_r") <= most, F.col(member)))).alias("members"))
    return out.withColumn("below_floor", F.col("n") < least).withColumn("members", F.when(~F.col("below_floor"), F.col("members")))


def mutual_information(weights: DataFrame, a: str, b: str, w: str, *by: str) -> DataFrame:
    """(by..., h_a, h_b, mi): entropies and mutual information in bits of a weighted table of pairs."""
    # margins are joined: as a window, all cells of one `by` or one value would be sorted in a task
    cells = weights.groupBy(*by, a, b).agg(F.sum(w).alias("w"))
    sums = {c: cells.groupBy(*by, c).agg(F.sum("w").alias(name)) for c, name in ((a, "_a"), (b, "_b"))}
    total = sums[b].groupBy(*by).agg(F.sum("_b").alias("_t"))
    for margin, keys in ((sums[a], [*by, a]), (sums[b], [*by, b]), (total, [*by])):
        side = margin.withColumnsRenamed({k: f"_on_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
        cells = cells.join(side, same).drop(*[f"_on_{k}" for k in keys]) if keys else cells.crossJoin(side)  # one row
    p, pa, pb = F.col("w") / F.col("_t"), F.col("_a") / F.col("_t"), F.col("_b") / F.col("_t")
    return cells.groupBy(*by).agg(F.sum(-p * F.log2(pa)).alias("h_a"), F.sum(-p * F.log2(pb)).alias("h_b"), F.sum(p * F.log2(p / (pa * pb))).alias("mi"))


def anisotropy(shares: list[Column]) -> Column:
    """1 - H / ln k of k non-negative parts: 0 for an even spread, 1 for a single part; null for none."""
    parts = F.array(*[s.cast("double") for s in shares])
    total = F.aggregate(parts, F.lit(0.0), lambda x, y: x + y)
    h = F.aggregate(parts, F.lit(0.0), lambda x, y: x - F.when(y > 0, y / total * F.ln(y / total)).otherwise(0.0))
    return F.when(total > 0, 1 - h / F.ln(F.lit(float(len(shares)))))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, hash): the same for any order and partitioning of equal rows."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string").alias("hash"))


def portable_fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, hash) as `fingerprint`, of md5 sums that plain SQL gives too; columns by name, nulls left out."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(df.columns)]).cast("binary")), 1, 13), 16, 10)
    return df.agg(F.count("*").alias("rows"), F.sum(part.cast("decimal(20,0)")).cast("string").alias("hash"))
