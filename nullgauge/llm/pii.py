"""Personal data spans by weak supervision, with DataFrame functions only.

Base spans come from four patterns with checks (email, ip, card, phone) and always stay. Other identifier-like runs
are candidates for the kind `identifier` (credentials and account
numbers). Four labelers vote on each candidate, for,
against or not at all: a shape pattern, a gazetteer of names and prefixes, the words before it, and its make-up.
Expectation-maximisation over the table of vote patterns (at most 81 rows, whatever the corpus) estimates each
labeler's reliability and each pattern's probability; runs that a base span covers anchor the positive class. With
these probabilities as soft labels a naive Bayes span classifier is trained on features that no labeler sees (length,
digit and capital shares, neighbours, case), again from a bounded table of sums; candidates that it accepts are added.

Positions count code points, ends are exclusive. Patterns are possessive, and start only at the edge of a run or of
the previous match, so that long runs cost linear time and no deep recursion; they match what the plain forms match.
Running sums and lookups go by blocks of about the root of their number, so that a very long text with n matches takes
steps in proportion to n**1.5 at most.

Defined results: null text counts as empty; repeated rows give equal rows; a corpus without candidates adds nothing;
an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved, unpacked, whole_row

KINDS = ("email", "ip", "card", "phone", "identifier")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
RUN = r"(?<![A-Za-z0-9_=@:/+.-])[A-Za-z_=@:/+-]*+[0-9][A-Za-z0-9_=@:/+.-]{5,}+"

# What the labelers look for.
SHAPE = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|(?:[A-Za-z_]+[=:])?(?=[0-9]*[a-f])[0-9a-f]{16,}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$"
GAZETTEER = r"(?i)^(?:akia|asia|ghp_|gho_|sk-|xox[abp]-)|(?:password|passwd|passwort|pwd|token|secret|apikey|api_key|access_key|iban|ssn|passport)[=:]"
CUES = r"(?i)(?:password|passwort|contraseña|mot de passe|token|secret|key|iban|account|konto|compte|cuenta|passport|ssn|phone|tel|card)\W{0,5}$"
DENIALS = r"(?i)(?:version|license|licence|cc by\S*|chapter|page|©|copyright)\W{0,3}$"
CONTEXT = 24


def _let(value: Column, use) -> Column:
    """use(value) with the value made once, where lambdas would make it again for each element."""
    return F.transform(F.array(value), use)[0]


def _blocks(values: Column) -> Column:
    """An array in blocks of about the root of its size."""

    def cut(v: Column) -> Column:
        each = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), each)).otherwise(F.expr("CAST(array() AS array<int>)"))
        return F.transform(starts, lambda i: F.slice(v, i, each))

    return _let(values, cut)


def _running(values: Column, op) -> Column:
    """Running results of a sum or maximum over an int array: arrays only grow inside a block or by one for each block."""

    def grow(items: Column, of) -> Column:
        start = F.struct(F.lit(0).alias("last"), F.expr("CAST(array() AS array<int>)").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            new = op(acc["last"], of(x))
            return F.struct(new.alias("last"), F.concat(acc["out"], F.array(new)).alias("out"))

        return F.aggregate(items, start, step, lambda acc: acc["out"])

    def joined(inside: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(0)), grow(inside, lambda run: F.element_at(run, -1))), F.lit(1), F.size(inside))
        return F.flatten(F.transform(F.arrays_zip(inside.alias("run"), before.alias("before")), lambda z: F.transform(z["run"], lambda x: op(z["before"], x))))

    return _let(F.transform(_blocks(values), lambda block: grow(block, lambda x: x)), joined)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, t, before, after>> of a pattern's matches: what lies between them gives the positions.

    before is at most CONTEXT characters, back to the start of the previous match; after is one character.
    """

    def found(parts: Column) -> Column:
        gaps, hits = parts["gaps"], parts["hits"]
        ends = _running(F.transform(hits, lambda t, k: F.length(gaps[k]) + F.length(t)), _add)

        def one(z: Column, k: Column) -> Column:
            t, end = z["hit"], z["end"]
            around = F.concat(F.when(k > 0, hits[F.greatest(k - 1, F.lit(0))]).otherwise(""), gaps[k])
            before = F.substring(around, F.greatest(F.length(around) - CONTEXT, F.lit(0)) + 1, F.lit(CONTEXT))
            return F.struct((end - F.length(t)).alias("s"), end.alias("e"), t.alias("t"), before.alias("before"), F.substring(gaps[k + 1], F.lit(1), F.lit(1)).alias("after"))

        return F.transform(F.arrays_zip(hits.alias("hit"), ends.alias("end")), one)

    return _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), found)


def _found(text: Column, may: Column, pattern: str, good=None) -> Column:
    spans = F.when(may, _matches(text, pattern)).otherwise(F.expr("CAST(array() AS array<struct<s: int, e: int, t: string, before: string, after: string>>)"))
    return F.filter(spans, good) if good else spans


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    back = F.reverse(_digits(text))
    each = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _octets(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(text, r"\."), lambda p: F.substring(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")), 1, 4).cast("int") <= 255)


def _of_kind(matches: Column, k: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e")))


def _number(k: int) -> Column:
    return F.size(F.filter("pii_spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k - 1]}")


def with_base(documents: DataFrame) -> DataFrame:
    """Adds pii_spans, array<struct<s, k, e>> of base spans by start and kind, and pii_runs, the candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = text.rlike("[0-9]")
    found = documents.withColumns(
        {
            "pii_1": _found(text, text.contains("@"), EMAIL),
            "pii_2": _found(text, digit & text.contains("."), IP, lambda m: _octets(m["t"])),
            "pii_3": _found(text, digit, CARD, lambda m: F.length(_digits(m["t"])).between(14, 19) & _luhn(m["t"])),
            "pii_4": _found(text, digit & text.contains("+"), PHONE, lambda m: F.length(_digits(m["t"])).between(10, 15)),
            "pii_runs": _found(text, digit, RUN, lambda m: F.length(_digits(m["t"])) >= 3),
        }
    )
    spans = F.array_sort(F.concat(*[_of_kind(F.col(f"pii_{k}"), k) for k in (1, 2, 3, 4)]))
    found = found.withColumn("pii_spans", spans).drop("pii_1", "pii_2", "pii_3", "pii_4")

    def marked(blocks: Column) -> Column:
        def run(m: Column) -> Column:
            covered = F.exists(blocks, lambda b: (b["low"] < m["e"]) & (b["high"] > m["s"]) & F.exists(b["spans"], lambda x: (x["s"] < m["e"]) & (x["e"] > m["s"])))
            return F.struct(m["s"].alias("s"), m["e"].alias("e"), m["t"].alias("t"), m["before"].alias("before"), m["after"].alias("after"), covered.alias("covered"))

        return F.transform("pii_runs", run)

    # spans are in order, so those that may cover a run lie in a few blocks
    blocks = F.transform(_blocks(F.col("pii_spans")), lambda x: F.struct(F.array_min(F.transform(x, lambda y: y["s"])).alias("low"), F.array_max(F.transform(x, lambda y: y["e"])).alias("high"), x.alias("spans")))
    return found.withColumn("pii_runs", F.when(F.size("pii_runs") > 0, _let(blocks, marked)).otherwise(F.expr("CAST(array() AS array<struct<s: int, e: int, t: string, before: string, after: string, covered: boolean>>)")))


def votes(run: Column) -> Column:
    """The four labelers' votes, each -1, 0 or 1."""
    text, n = run["t"], F.length(run["t"])
    share = F.length(_digits(text)) / n
    return F.array(
        F.when(text.rlike(SHAPE), 1).otherwise(0),
        F.when(text.rlike(GAZETTEER), 1).otherwise(0),
        F.when(run["before"].rlike(CUES), 1).when(run["before"].rlike(DENIALS), -1).otherwise(0),
        # digits alone that no base pattern took have failed its check
        F.when((n < 10) | text.rlike(r"^[0-9.,:/+-]+$"), -1).when((n >= 16) & (share > 0.1), 1).otherwise(0),
    )


def features(run: Column) -> Column:
    """Bounded features of a run that no labeler looks at in this form."""
    text, n = run["t"], F.length(run["t"])

    def share(pattern: str) -> Column:
        return F.floor(4 * F.length(F.regexp_replace(text, pattern, "")) / n).cast("int")

    last = F.substring(run["before"], -1, 1)
    return F.array(
        F.concat(F.lit("length "), F.floor(F.log2(n)).cast("string")),
        F.concat(F.lit("digits "), share("[^0-9]").cast("string")),
        F.concat(F.lit("capitals "), share("[^A-Z]").cast("string")),
        F.concat(F.lit("left "), F.when(last == "", "none").when(last.rlike(r"\s"), "blank").when(last.rlike("[\"'`]"), "quote").otherwise("other")),
        F.concat(F.lit("right "), F.when(run["after"] == "", "none").when(run["after"].rlike(r"\s"), "blank").when(run["after"].rlike("[\"'`]"), "quote").otherwise("other")),
        F.when(text.contains("="), "equals yes").otherwise("equals no"),
        F.when(text.rlike("[g-zG-Z]"), "hex no").otherwise("hex yes"),
        F.when(text.rlike("[A-Za-z]"), "letters some").otherwise("letters none"),
    )


def reliabilities(patterns: list[tuple[tuple[int, ...], bool, int]], rounds: int = 50) -> tuple[float, list[list[dict[int, float]]]]:
    """Prior and, by class and labeler, vote probabilities: EM over (votes, is known positive, count) rows."""

    def start(v: tuple[int, ...], known: bool) -> float:
        return 1.0 if known else 1 / (1 + math.exp(-1.5 * sum(v)))

    p = [start(v, known) for v, known, _ in patterns]
    prior, tables = 0.5, []
    for _ in range(rounds):
        mass = [sum(n * w for (_, _, n), w in zip(patterns, side, strict=True)) for side in ([1 - x for x in p], p)]
        # known positives anchor the vote tables, not the share of positives among candidates
        free = sum(n for _, known, n in patterns if not known)
        prior = (1 + sum(n * x for (_, known, n), x in zip(patterns, p, strict=True) if not known)) / (2 + free)
        tables = [[{v: (1 + sum(n * w for (votes_, _, n), w in zip(patterns, side, strict=True) if votes_[k] == v)) / (3 + mass[c]) for v in (-1, 0, 1)} for k in range(4)] for c, side in enumerate(([1 - x for x in p], p))]
        p = [1.0 if known else posterior(prior, tables, v) for v, known, _ in patterns]
    return prior, tables


def posterior(prior: float, tables: list, v: tuple[int, ...]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(tables[1][k][x] / tables[0][k][x]) for k, x in enumerate(v))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def train(found: DataFrame) -> tuple[float, dict[str, float]]:
    """The span classifier (log odds of the prior, of each feature) from all candidates of a table of with_base."""
    runs = found.select(F.explode("pii_runs").alias("run")).select(votes(F.col("run")).alias("votes"), F.col("run")["covered"].alias("known"), features(F.col("run")).alias("features"))
    table = saved(runs.groupBy("votes", "known", "features").agg(F.count("*").alias("n")))
    rows = [(tuple(r.votes), r.known, r.n) for r in table.groupBy("votes", "known").agg(F.sum("n").alias("n")).orderBy("votes", "known").collect()]
    if not any(not known for _, known, _ in rows):
        return -60.0, {}
    prior, tables = reliabilities(rows)
    soft = F.lit(0.0)
    for v in sorted({v for v, _, _ in rows}):
        soft = F.when(F.col("votes") == F.array(*map(F.lit, v)), posterior(prior, tables, v)).otherwise(soft)
    sums = table.filter("NOT known").withColumn("p", soft).select("p", "n", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum(F.col("p") * F.col("n")).alias("yes"), F.sum((1 - F.col("p")) * F.col("n")).alias("no"))
    seen = {r.feature: (r.yes, r.no) for r in sums.collect()}
    groups: dict[str, list[float]] = {}
    for f, (yes, no) in seen.items():
        g = groups.setdefault(f.split(" ")[0], [0.0, 0.0, 0.0])
        g[0], g[1], g[2] = g[0] + yes, g[1] + no, g[2] + 1
    total = next(iter(groups.values()))
    weights = {f: math.log((yes + 1) / (groups[f.split(" ")[0]][0] + groups[f.split(" ")[0]][2])) - math.log((no + 1) / (groups[f.split(" ")[0]][1] + groups[f.split(" ")[0]][2])) for f, (yes, no) in sorted(seen.items())}
    return math.log((total[0] + 1) / (total[1] + 1)), weights


def with_spans(found: DataFrame, model: tuple[float, dict[str, float]], least: float = 0.9) -> DataFrame:
    """Adds pii_all: base spans and accepted runs, by start and kind."""
    prior, weights = model
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.expr("CAST(map() AS map<string, double>)")

    def accepted(run: Column) -> Column:
        odds = F.aggregate(features(run), F.lit(prior), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
        return ~run["covered"] & (odds >= math.log(least / (1 - least)))

    return found.withColumn("pii_all", F.array_sort(F.concat("pii_spans", _of_kind(F.filter("pii_runs", accepted), 5))))


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"] - 1], x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of documents (doc_id, text)."""
    found = saved(with_base(documents.select("doc_id", "text")).drop("text"))
    out = with_spans(found, train(found))
    return out.select("doc_id", *map(_number, (1, 2, 3, 4)), F.sha2(_written("pii_spans").cast("binary"), 256).alias("base_sha256"), _written("pii_all").alias("spans"))


#: Characters of a block from which redaction cuts.
BLOCK = 256


def redacted(documents: DataFrame) -> DataFrame:
    """documents with each span of personal data replaced by its kind in angle brackets; null texts stay null.

    A span that begins inside the one before is part of its replacement. n_chars, where there is one, follows the text.
    """
    model = train(saved(with_base(documents.select("text")).select("pii_runs")))
    out = with_spans(with_base(documents.select(whole_row(documents), "text")), model)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def cleaned(of: Column) -> Column:
        blocks, spans, ends = of["blocks"], of["spans"], of["ends"]

        def piece(low: Column, high: Column) -> Column:
            first = F.floor(low / BLOCK).cast("int")
            last = F.floor((high - 1) / BLOCK).cast("int")
            return F.when(high > low, F.substring(F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), ""), (low - first * BLOCK + 1).cast("int"), (high - low).cast("int"))).otherwise("")

        def part(x: Column, k: Column) -> Column:
            at = F.when(k > 0, ends[F.greatest(k - 1, F.lit(0))]).otherwise(0)
            return F.when(x["s"] >= at, F.concat(piece(at, x["s"]), names[x["k"] - 1])).otherwise("")

        return F.concat(F.array_join(F.transform(spans, part), ""), piece(F.element_at(ends, -1), of["n"]))

    # positions are looked up in short blocks, since finding a character takes time in proportion to its place
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ends = _running(F.transform("pii_all", lambda x: x["e"]), F.greatest)
    clean = _let(F.struct(blocks.alias("blocks"), F.col("pii_all").alias("spans"), ends.alias("ends"), F.length("text").alias("n")), cleaned)
    out = out.withColumn("clean", F.when(F.size("pii_all") > 0, clean).otherwise(F.col("text")))
    changed = {"text": F.col("clean")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.size("pii_all") > 0, F.length("clean").cast(dict(documents.dtypes)["n_chars"])).otherwise(F.col("row")["n_chars"])
    return unpacked(out, documents.columns, changed)
