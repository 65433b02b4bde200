"""Tail expressions, fitted laws and changed verdicts against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nullgauge.functions import normal
from nullgauge.operators import tails


def only(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_log_gamma_and_far_tails(spark):
    for x in (0.25, 0.5, 1.0, 3.7, 80.0):
        assert only(spark, normal.log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-12)
    for z in (-30.0, -3.0, 0.0, 2.0):
        exact = math.log(math.erfc(-z / math.sqrt(2)) / 2) if z > -30 else -30**2 / 2 - math.log(30 * math.sqrt(2 * math.pi)) + math.log(1 - 1 / 900 + 3 / 30**4)
        assert only(spark, normal.log_normal_cdf(F.lit(z))) == pytest.approx(exact, rel=1e-6)


def test_student_and_skewed_tails(spark):
    for t in (-6.0, -0.4, 0.0, 0.3, 2.5, 40.0):
        assert only(spark, normal.student_sf(F.lit(t), F.lit(1.0))) == pytest.approx(0.5 - math.atan(t) / math.pi, rel=1e-9)
        assert only(spark, normal.student_sf(F.lit(t), F.lit(2.0))) == pytest.approx(0.5 - t / (2 * math.sqrt(2 + t * t)), rel=1e-6)
    at = np.linspace(0, 60, 2_000_001)
    for t, df in ((1.7, 7.3), (0.2, 55.5), (3.0, 200.0)):
        area = np.trapezoid(np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - math.log(df * math.pi) / 2 - (df + 1) / 2 * np.log1p((t + at) ** 2 / df)), at)
        assert only(spark, normal.student_sf(F.lit(t), F.lit(df))) == pytest.approx(area, rel=1e-6)
    cdf = np.vectorize(lambda x: math.erfc(-x / math.sqrt(2)) / 2)
    at = np.linspace(0, 12, 40_001)
    for z, shape in ((-1.2, 3.0), (0.0, -2.0), (0.7, -4.0), (2.5, 0.0), (3.1, 6.0)):
        area = np.trapezoid(np.sqrt(2 / np.pi) * np.exp(-((z + at) ** 2) / 2) * cdf(shape * (z + at)), at)
        assert only(spark, normal.skew_normal_sf(F.lit(z), F.lit(shape))) == pytest.approx(area, rel=1e-5, abs=1e-9)


def student_loglik(x, df, loc, scale):
    return np.sum(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - math.log(df * math.pi) / 2 - math.log(scale) - (df + 1) / 2 * np.log1p(((x - loc) / scale) ** 2 / df))


def skewed_loglik(x, shape, loc, scale):
    z = (x - loc) / scale
    cdf = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in shape * z])
    return np.sum(math.log(2 / scale) - math.log(2 * math.pi) / 2 - z * z / 2 + np.log(cdf))


def test_planted_laws_are_found_and_no_neighbour_is_likelier(spark):
    rng = np.random.default_rng(5)
    u, v = rng.standard_normal((2, 800))
    samples = {"student": 1 + 2 * rng.standard_t(3, 800), "skewed": 0.97 * np.abs(u) + 0.24 * v, "laplace": rng.laplace(2, 1, 800)}
    for law, x in samples.items():
        fits = {f.model: f for f in tails.fit_laws(spark.createDataFrame([(float(a),) for a in x] + [(None,), (float("nan"),)], "z double"), "z", rounds=4).collect()}
        assert len(fits) == 4 and fits[law].best and sum(f.best for f in fits.values()) == 1
        for name, loglik in (("student", student_loglik), ("skewed", skewed_loglik)):
            f = fits[name]
            assert loglik(x, f.shape, f.loc, f.scale) == pytest.approx(f.loglik, abs=1e-3)
            if name == law:
                tried = [loglik(x, f.shape * (1 + a), f.loc + b * f.scale, f.scale * (1 + c)) for a, b, c in rng.normal(0, 0.05, (200, 3))]
                assert max(tried) <= f.loglik + 0.1


def test_changed_status_equals_plain_counts(spark):
    rng = np.random.default_rng(9)
    z = np.round(np.concatenate([rng.standard_t(4, 500), rng.normal(5, 1, 40)]), 2)
    df = spark.createDataFrame([(float(a),) for a in z], "z double")
    fits = tails.fit_laws(df, "z", rounds=3)
    columns = tails.upper_tails(fits.collect(), F.col("z"))
    p = {k: np.array([x[0] for x in df.select(c).collect()]) for k, c in columns.items()}
    inflation = np.median(z * z) / tails.CHI_MEDIAN
    p["inflated"] = np.array([math.erfc(abs(a) / math.sqrt(2 * inflation)) / 2 for a in z])
    got = {x.law: x for x in tails.changed_status(df, "z", fits).collect()}
    assert set(got) == set(p) and got["inflated"].inflation == pytest.approx(inflation)
    for law, values in p.items():
        for alpha, found in ((0.05, got[law].passed), (0.01, got[law].passed_strict)):
            ranked = np.sort(values)
            assert found == max((k + 1 for k in range(len(z)) if ranked[k] <= alpha * (k + 1) / len(z)), default=0)
        under = values < 0.05 / len(z)
        assert got[law].corrected == under.sum() and got[law].moved == (under != (p["standard"] < 0.05 / len(z))).sum()


def test_nothing_to_fit(spark):
    for rows in ([], [(None,)] * 3, [(1.0,)] * 9):
        df = spark.createDataFrame(rows, "z double")
        fits = tails.fit_laws(df, "z")
        assert fits.count() == 0
        assert {x.law for x in tails.changed_status(df, "z", fits).collect()} <= {"standard", "inflated"}


def test_sql_of_changed_status_takes_equal_values_once(spark):
    import duckdb

    from nullgauge.plans import tails as plan

    values = [round(-2.5 + 0.37 * k, 2) for k in range(20)] * 3
    fits = [("normal", None, 0.4, 1.5, 3.0, False), ("laplace", None, 0.3, 1.2, 2.0, False), ("student", 4.0, 0.3, 1.1, 1.0, True), ("skewed", 1.5, -0.5, 1.8, 4.0, False)]
    con = duckdb.connect()
    con.execute("CREATE TABLE f (model VARCHAR, shape DOUBLE, loc DOUBLE, scale DOUBLE, aic DOUBLE, best BOOLEAN)")
    con.executemany("INSERT INTO f VALUES (?, ?, ?, ?, ?, ?)", fits)
    con.execute("CREATE TABLE w (x DOUBLE)")
    con.executemany("INSERT INTO w VALUES (?)", [(x,) for x in values])
    sql = con.execute("WITH v AS (SELECT x FROM w), m AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v)" + plan._TAILS).fetchall()
    laws = spark.createDataFrame(fits, "model string, shape double, loc double, scale double, aic double, best boolean")
    got = tails.changed_status(spark.createDataFrame([(x,) for x in values], "x double"), "x", laws).collect()
    assert len(got) == 6 and sorted((x.law, x.best, round(x.inflation, 6), x.passed, x.passed_strict, x.corrected, x.moved) for x in got) == sorted(sql)
