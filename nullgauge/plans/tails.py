"""Laws fitted to calibrated scores, and how many customers change their verdict under each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.normal import log_normal_cdf_sql, normal_sf_sql
from ..operators import tails
from ..operators.draws import saved
from .base import Tables, query, r
from .calibration import _SCREEN, _screen

ROUNDS = 6


def _fits_sql() -> str:
    """CTEs v (x), m (moments) and f (the four fits) after _SCREEN."""
    row = f"sum(CASE WHEN model = 'student' THEN -(shape + 1) / 2 * ln(1 + pow((x - loc) / scale, 2) / shape) ELSE -pow((x - loc) / scale, 2) / 2 + {log_normal_cdf_sql('(shape * ((x - loc) / scale))')} END)"
    constant = "CASE WHEN model = 'student' THEN lgamma((shape + 1) / 2) - lgamma(shape / 2) - ln(shape * pi()) / 2 ELSE ln(2 / pi()) / 2 END - ln(scale)"
    out = """, v AS MATERIALIZED (SELECT (score - null_mean) / null_sd AS x, entity FROM z WHERE null_sd <> 0), m AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x) AS mu, stddev_pop(x) AS sd, quantile_cont(x, 0.5) AS med FROM v)
, g0 AS (SELECT 'student' AS model, i * 0.5::DOUBLE AS u, j * 0.1::DOUBLE AS c, k * 0.5::DOUBLE AS e FROM range(11) a(i), range(-3, 4) b(j), range(-8, 2) d(k) UNION ALL SELECT 'skewed', i * 0.5::DOUBLE, j * 0.1::DOUBLE, k * 0.125::DOUBLE FROM range(-6, 7) a(i), range(-2, 3) b(j), range(-2, 3) d(k))"""
    for k in range(ROUNDS + 1):
        if k:
            out += f""", g{k} AS (SELECT DISTINCT model, CASE WHEN model = 'student' THEN least(greatest(u + i * (0.5::DOUBLE / {2**k}), -0.7), 5.3) ELSE u + i * (0.5::DOUBLE / {2**k}) END AS u, c + j * (0.1::DOUBLE / {2**k}) AS c, e + l * (CASE WHEN model = 'student' THEN 0.5::DOUBLE ELSE 0.125::DOUBLE END / {2**k}) AS e
FROM b{k - 1}, range(-2, 3) x(i), range(-2, 3) y(j), range(-2, 3) w(l))"""
        out += f""", p{k} AS (SELECT g.*, CASE WHEN model = 'student' THEN exp(u) ELSE (exp(u) - exp(-u)) / 2 END AS shape, sd * pow(2, e) AS spread, mu, sd FROM g{k} g, m), q{k} AS (SELECT *, CASE WHEN model = 'student' THEN 0 ELSE shape / sqrt(1 + shape * shape) END AS delta FROM p{k}), s{k} AS (SELECT *, spread / sqrt(1 - 2 * delta * delta / pi()) AS scale FROM q{k}), t{k} AS MATERIALIZED (SELECT model, u, c, e, shape, scale, mu + sd * c - scale * delta * sqrt(2 / pi()) AS loc FROM s{k})
, l{k} AS (SELECT model, u, c, e, shape, loc, scale, count(*) * ({constant}) + {row} AS loglik FROM t{k}, v GROUP BY model, u, c, e, shape, loc, scale), b{k} AS MATERIALIZED (SELECT * FROM l{k} QUALIFY row_number() OVER (PARTITION BY model ORDER BY loglik DESC, u DESC, c DESC, e DESC) = 1)"""
    return out + f""", a AS (SELECT avg(abs(x - med)) AS b FROM v, m), f AS MATERIALIZED (SELECT *, 2 * parameters - 2 * loglik AS aic FROM (SELECT model, shape, loc, scale, 3 AS parameters, loglik FROM b{ROUNDS}
UNION ALL SELECT 'normal', NULL, mu, sd, 2, -n * (ln(2 * pi() * sd * sd) + 1) / 2 FROM m UNION ALL SELECT 'laplace', NULL, med, b, 2, -n * (ln(2 * b) + 1) FROM m, a))"""


_Z = "((x - loc) / scale)"
# Student's series by closed terms, the skew-normal integral by the same panels; once for each value, however many rows have it
_TAILS = f""", y AS (SELECT model, x, shape, {_Z} AS s, CASE WHEN shape / (shape + pow({_Z}, 2)) <= 0.9 THEN shape / 2 ELSE 0.5 END AS a, CASE WHEN shape / (shape + pow({_Z}, 2)) <= 0.9 THEN 0.5 ELSE shape / 2 END AS b, shape / (shape + pow({_Z}, 2)) AS near FROM (SELECT DISTINCT x FROM v), f WHERE model = 'student'
), ts AS (SELECT model, x, s, near, exp(shape / 2 * ln(near) - lgamma(shape / 2) - lgamma(0.5) + lgamma(shape / 2 + 0.5)) * sqrt(1 - near) / a * sum(exp(lgamma(a + b + k) - lgamma(a + b) + lgamma(a + 1) - lgamma(a + 1 + k) + k * ln(greatest(CASE WHEN near <= 0.9 THEN near ELSE 1 - near END, 1e-300)))) AS part FROM y, range(401) t(k) GROUP BY model, x, s, near, shape, a, b
), sk AS (SELECT model, x, {_Z} AS s, CASE WHEN x >= loc THEN -atan(shape) ELSE atan(shape) END AS low FROM (SELECT DISTINCT x FROM v), f WHERE model = 'skewed'
), si AS (SELECT model, x, s, sum(CASE WHEN k IN (0, 200) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-s * s / (2 * greatest(pow(cos(low + k * ((pi() / 2 - low) / 200)), 2), 1e-30)))) * (pi() / 2 - low) / 600 / pi() AS area FROM sk, range(201) t(k) GROUP BY model, x, s, low
), st1 AS (SELECT DISTINCT *, CASE WHEN near <= 0.9 THEN part ELSE 1 - part END / 2 AS half FROM ts), si1 AS (SELECT DISTINCT * FROM si
), lam AS (SELECT quantile_cont(x * x, 0.5) / {tails.CHI_MEDIAN} AS inflation FROM v
), p AS MATERIALIZED (SELECT 'standard' AS law, x AS o, {normal_sf_sql('x')} AS p, x FROM v UNION ALL SELECT 'inflated', abs(x), {normal_sf_sql('(abs(x) / sqrt(inflation))')}, x FROM v, lam
UNION ALL SELECT model, x, {normal_sf_sql(_Z)}, x FROM v, f WHERE model = 'normal' UNION ALL SELECT model, x, CASE WHEN x >= loc THEN exp(-{_Z}) / 2 ELSE 1 - exp({_Z}) / 2 END, x FROM v, f WHERE model = 'laplace'
UNION ALL SELECT model, x, CASE WHEN s >= 0 THEN half ELSE 1 - half END, x FROM v JOIN st1 USING (x) UNION ALL SELECT model, x, CASE WHEN s >= 0 THEN area ELSE 1 - area END, x FROM v JOIN si1 USING (x)
), c AS (SELECT law, p, n, row_number() OVER (PARTITION BY law ORDER BY o DESC) AS place, {normal_sf_sql('x')} < 0.05 / n AS usual FROM p, m)
SELECT law, coalesce(law IN (SELECT model FROM f WHERE aic = (SELECT min(aic) FROM f)), false) AS best, round((SELECT inflation FROM lam), 6) AS inflation, coalesce(max(place) FILTER (p <= 0.05 * place / n), 0) AS passed, coalesce(max(place) FILTER (p <= 0.01 * place / n), 0) AS passed_strict, count(*) FILTER (p < 0.05 / n) AS corrected, count(*) FILTER ((p < 0.05 / n) <> usual) AS moved FROM c GROUP BY 1"""


@query(_SCREEN + _fits_sql() + "SELECT model, parameters, round(shape, 6) AS shape, round(loc, 6) AS loc, round(scale, 6) AS scale, round(aic, 3) AS aic, aic = min(aic) OVER () AS best FROM f")
def o128_four_laws(t: Tables) -> DataFrame:
    """Normal, double-exponential, Student and skew-normal fits of customers' calibrated scores, and the best one."""
    z, _ = _screen(t)
    fits = tails.fit_laws(z, "z", ROUNDS)
    return fits.select("model", "parameters", r("shape").alias("shape"), r("loc").alias("loc"), r("scale").alias("scale"), r("aic", 3).alias("aic"), "best")


@query(_SCREEN + _fits_sql() + _TAILS)
def o128_changed_status(t: Tables) -> DataFrame:
    """How many customers pass under the standard normal tail, the inflated one and each fitted law."""
    z = saved(_screen(t)[0].select("z"))
    return tails.changed_status(z, "z", tails.fit_laws(z, "z", ROUNDS)).withColumn("inflation", r("inflation"))
