"""Laws fitted to scores by likelihood, and what their tails change for what passes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.normal import erfc_step, log_gamma, log_normal_cdf, normal_sf, skew_normal_sf, student_sf
from .draws import numbered, saved

# Fixed value: the median of the chi-square distribution with one degree of freedom.
CHI_MEDIAN = 0.4549364231195724

#: First grids of (shape, centre, spread) and their steps. Shapes: the logarithm of Student's degrees of freedom, the
#: inverse hyperbolic sine of the skew. Centre: in deviations from the mean. Spread: log2 of the ratio to the deviation.
GRIDS = {
    "student": ((range(11), range(-3, 4), range(-8, 2)), (0.5, 0.1, 0.5)),
    "skewed": ((range(-6, 7), range(-2, 3), range(-2, 3)), (0.5, 0.1, 0.125)),
}
#: Bounds of Student's shape: degrees of freedom from about 0.5 to 200.
SHAPES = (-0.7, 5.3)
FITS = "model string, shape double, loc double, scale double, parameters int, loglik double, aic double, best boolean"


def middle(df: DataFrame, value: str) -> float | None:
    """The exact median of a column without nulls, found by ranges; None of no rows."""
    n = df.count()
    if not n:
        return None
    return numbered(df.select(value), value).filter(F.col("pos").isin((n - 1) // 2, n // 2)).agg(F.avg(value)).first()[0]


def _laws(points: DataFrame, mean: float, sd: float) -> DataFrame:
    """Adds shape, loc, scale and the constant of one row's log-likelihood to grid points (model, u, c, e)."""
    student = F.col("model") == "student"
    alpha = (F.exp("u") - F.exp(-F.col("u"))) / 2
    delta = alpha / F.sqrt(1 + alpha * alpha)
    spread = F.lit(sd) * F.pow(F.lit(2.0), F.col("e"))
    scale = F.when(student, spread).otherwise(spread / F.sqrt(1 - 2 * delta * delta / F.pi()))
    out = points.withColumns({"shape": F.when(student, F.exp("u")).otherwise(alpha), "scale": scale})
    out = out.withColumn("loc", mean + F.lit(sd) * F.col("c") - F.when(student, 0.0).otherwise(F.col("scale") * delta * F.sqrt(2 / F.pi())))
    free = F.col("shape")
    constant = F.when(student, log_gamma((free + 1) / 2) - log_gamma(free / 2) - F.ln(free * F.pi()) / 2).otherwise(F.ln(2 / F.pi()) / 2)
    return out.withColumn("constant", constant - F.ln("scale"))


def _best(x: DataFrame, points: list[tuple], n: int, mean: float, sd: float) -> list[Row]:
    """The likeliest point of each law in one pass over the values; every task sums all points before the shuffle.

    What the likelihood uses often are columns, since as one expression its code is too long to be compiled.
    """
    names = [(k, *p) for k, p in enumerate(sorted(set(points)))]
    grid = _laws(x.sparkSession.createDataFrame(names, "point int, model string, u double, c double, e double"), mean, sd)
    student = F.col("model") == "student"
    held = x.crossJoin(F.broadcast(grid.select("point", "model", "shape", "loc", "scale")))  # the points of GRIDS, a fixed number
    held = held.select("point", "model", "shape", ((F.col("x") - F.col("loc")) / F.col("scale")).alias("z"))
    held = held.withColumn("turned", F.col("shape") * F.col("z")).withColumn("step", erfc_step(F.col("turned")))
    row = F.when(student, -(F.col("shape") + 1) / 2 * F.ln(1 + F.col("z") * F.col("z") / F.col("shape"))).otherwise(-F.col("z") * F.col("z") / 2 + log_normal_cdf(F.col("turned"), F.col("step")))
    sums = held.groupBy("point").agg(F.sum(row).alias("rows")).join(F.broadcast(grid), "point")
    ranked = sums.withColumn("loglik", n * F.col("constant") + F.col("rows"))
    return ranked.groupBy("model").agg(F.max(F.struct("loglik", "u", "c", "e", "shape", "loc", "scale")).alias("top")).select("model", "top.*").collect()


def fit_laws(df: DataFrame, value: str, rounds: int = 6) -> DataFrame:
    """(model, shape, loc, scale, parameters, loglik, aic, best): four laws fitted to a column by likelihood.

    The normal and the double-exponential law have closed forms. Student's and the skew-normal law are looked for on a
    grid, then in `rounds` passes on grids of five points a parameter around the best one, each of half the step; all
    points of a pass are summed at once, and only each law's best point comes back. Null and non-finite values are left
    out; with fewer than four values, or all of them equal, no law is fitted and no row returned. `best` is the least
    AIC; laws of equal AIC are all best.
    """
    spark = df.sparkSession
    wide = F.col(value).cast("double")
    x = saved(df.select(wide.alias("x")).filter(wide.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < float("inf"))))
    n, mean, sd = x.agg(F.count("*"), F.avg("x"), F.stddev_pop("x")).first()
    if n < 4 or not sd > 0:
        return spark.createDataFrame([], FITS)
    centre = middle(x, "x")
    spread = x.agg(F.avg(F.abs(F.col("x") - centre))).first()[0]
    top = _best(x, [(law, *[k * s for k, s in zip(at, steps)]) for law, (axes, steps) in GRIDS.items() for at in product(*axes)], n, mean, sd)
    for k in range(1, rounds + 1):
        points = []
        for b in top:
            steps = [s / 2**k for s in GRIDS[b.model][1]]
            for at in product(range(-2, 3), repeat=3):
                u, c, e = (v + d * s for v, d, s in zip((b.u, b.c, b.e), at, steps))
                points.append((b.model, min(max(u, SHAPES[0]), SHAPES[1]) if b.model == "student" else u, c, e))
        top = _best(x, points, n, mean, sd)
    closed = spark.createDataFrame([("normal", None, mean, sd, 2), ("laplace", None, centre, spread, 2)], "model string, shape double, loc double, scale double, parameters int")
    closed = closed.withColumn("loglik", -n * F.when(F.col("model") == "normal", (F.ln(2 * F.pi() * F.col("scale") ** 2) + 1) / 2).otherwise(F.ln(2 * F.col("scale")) + 1))
    searched = spark.createDataFrame([(b.model, b.shape, b.loc, b.scale, 3, b.loglik) for b in top], closed.schema)
    fits = [tuple(f) for f in closed.unionByName(searched).withColumn("aic", 2 * F.col("parameters") - 2 * F.col("loglik")).collect()]
    least = min(f[-1] for f in fits)
    return spark.createDataFrame([(*f, f[-1] == least) for f in fits], FITS)


def upper_tails(fits: list[Row], value: Column) -> dict[str, Column]:
    """The upper tail of a value under each fitted law, by name; a normal law without a fit is named `standard`."""
    out = {"standard": normal_sf(value)}
    for f in fits:
        z = (value - F.lit(f.loc)) / F.lit(f.scale)
        if f.model == "normal":
            out[f.model] = normal_sf(z)
        elif f.model == "laplace":
            out[f.model] = F.when(z >= 0, F.exp(-z) / 2).otherwise(1 - F.exp(z) / 2)
        else:
            out[f.model] = (student_sf if f.model == "student" else skew_normal_sf)(z, F.lit(f.shape))
    return out


def changed_status(df: DataFrame, value: str, fits: DataFrame, alpha: float = 0.05, strict: float = 0.01) -> DataFrame:
    """(law, best, inflation, passed, passed_strict, corrected, moved): how many values pass under each law.

    `passed` are Benjamini-Hochberg rejections at `alpha` and `passed_strict` at `strict`, `corrected` those under
    alpha / n, and `moved` those whose corrected verdict differs from the standard normal one's. `inflation` also gives
    the law `inflated`: the standard normal tail of |value| over the root of the inflation, median(value**2) over its
    expected value. Tails fall with their value, so two rankings by ranges serve all laws and no window is needed.
    """
    wide = F.col(value).cast("double")
    x = df.select(wide.alias("x")).filter(wide.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < float("inf")))
    x = numbered(x.withColumns({"_down": -F.col("x"), "_size": -F.abs("x")}), "_down", name="_place")
    x = saved(numbered(x, "_size", "_down", name="_far"))
    n = max(x.count(), 1)
    centre = x.filter(F.col("_far").isin((n - 1) // 2, n // 2)).agg(F.avg(F.col("x") * F.col("x"))).first()[0]
    inflation = None if centre is None else centre / CHI_MEDIAN
    rows = fits.collect()
    tails = upper_tails(rows, F.col("x"))
    if inflation:
        tails["inflated"] = normal_sf(F.abs("x") / F.lit(inflation**0.5))
    best = {f.model for f in rows if f.best}
    p = x.withColumns({f"p_{k}": c for k, c in tails.items()})
    counts = []
    for k in tails:
        at, place = F.col(f"p_{k}"), F.col("_far" if k == "inflated" else "_place") + 1
        passed = [F.coalesce(F.max(F.when(at <= a * place / n, place)), F.lit(0)).alias(name) for a, name in ((alpha, "passed"), (strict, "passed_strict"))]
        under = at < F.lit(alpha) / n
        counts.append(F.struct(F.lit(k).alias("law"), F.lit(k in best).alias("best"), F.lit(inflation).cast("double").alias("inflation"), *passed, F.count_if(under).alias("corrected"), F.count_if(under != (F.col("p_standard") < F.lit(alpha) / n)).alias("moved")))
    return p.agg(F.array(*counts).alias("laws")).select(F.inline("laws"))
