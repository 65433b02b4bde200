"""Scalar functions of evidence tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_text(c: Column, drop: bool = False) -> Column:
    """Lower case, letters and digits only, others to one space (or removed), trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "" if drop else " "), " +", " "))


def base_label(c: Column) -> Column:
    """A label without what follows a semicolon and without a trailing ordinal."""
    return F.trim(F.regexp_replace(F.split_part(c, F.lit(";"), F.lit(1)), "[ _#-]*[0-9]+$", ""))


def split_symbols(c: Column, blanks: tuple[str, ...] = ("-", "NR", "")) -> Column:
    """Symbols of a field split on ' - ' and commas, without placeholders."""
    return F.filter(F.transform(F.split(c, " - |,"), lambda x: F.trim(x)), lambda x: ~x.isin(*blanks))


def first_rule(c: Column, rules: list[tuple[str, str]], default: str, excluded: str | None = None, excluded_label: str = "excluded") -> Column:
    """Label of the first pattern that matches; an exclusion pattern goes before all."""
    out = F.when(c.rlike(excluded), excluded_label) if excluded else None
    for pattern, label in rules:
        out = (F if out is None else out).when(c.rlike(pattern), label)
    return out.otherwise(default)


def lookup(c: Column, table: dict[str, object], default) -> Column:
    """A value by exact match, or the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[c], F.lit(default))


def band(c: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """Label of the first edge above the value; null stays null."""
    out = F.when(c.isNull(), F.lit(None))
    for edge, label in edges:
        out = out.when(c < edge, label)
    return out.otherwise(last)


def namespaced(c: Column, names: dict[str, str]) -> Column:
    """An identifier with its namespace in the preferred spelling."""
    head = F.split_part(c, F.lit(":"), F.lit(1))
    return F.concat_ws(":", F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[head], F.upper(head)), F.split_part(c, F.lit(":"), F.lit(2)))


def frequency(c: Column) -> Column:
    """A frequency text as a struct: kind (fraction, percent, class or none), k, n, share, and a grade."""
    k, n = F.regexp_extract(c, r"^(\d+)/(\d+)$", 1), F.regexp_extract(c, r"^(\d+)/(\d+)$", 2)
    percent = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)%$", 1)
    fraction, is_percent = k != "", percent != ""
    share = F.when(fraction, F.try_divide(k.cast("double"), F.when(fraction, n).cast("double"))).when(is_percent, F.when(is_percent, percent).cast("double") / 100)
    kind = F.when(fraction, "fraction").when(is_percent, "percent").when(c.isNotNull() & (c != ""), "class").otherwise("none")
    grade = F.when(fraction & (F.when(fraction, n).cast("long") > 1), "quantified").when(fraction, "single case").when(is_percent, "quantified").when(kind == "class", "class").otherwise("none")
    return F.struct(kind.alias("kind"), F.when(fraction, k).cast("long").alias("k"), F.when(fraction, n).cast("long").alias("n"), share.alias("share"), grade.alias("grade"))


def rate_interval(c: Column) -> Column:
    """Bounds of 'a-b / d', '<a / d' and '>a / d' (there the upper one is ten times the lower)."""
    text = F.regexp_replace(c, " ", "")
    shape = r"^([<>]?)(\d+)(?:-(\d+))?/(\d+)$"
    sign, a, b, d = (F.regexp_extract(text, shape, k) for k in (1, 2, 3, 4))
    ok = d != ""
    low, high, per = (F.when(ok & (x != ""), x).cast("double") for x in (a, b, d))
    return F.when(ok, F.struct(F.when(sign == "<", 0.0).otherwise(low / per).alias("lo"), F.when(sign == ">", 10 * low / per).when(sign == "<", low / per).otherwise(F.coalesce(high, low) / per).alias("hi")))
