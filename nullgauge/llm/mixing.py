"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Targets: each source gets its weight's share of all words; a source stops at `epochs` times its own words, and what it
can't take is shared again by weight until no source is above its limit. Rounds repeat on the table of sources; the
driver sees two sums a round.

Repetitions: a source's rounded target is so many whole repetitions of its documents and a rest. Documents are put in
a seeded order (md5 of seed and id); those before the edge, where their running total reaches the rest, are repeated
once more, the one at the edge for the missing words only (a fractional repetition), so that a source's words equal
its rounded target. Only the edge of each source is looked up: the running totals are made in hash ranges of bounded
size, so that a source may hold any share of the rows, and texts are never shuffled.

Defined results: null text has size 0; the null source is the last one; rows of equal id and size that meet the edge
share it equally (rounded down); a table without words has targets of 0; an empty table gives an empty result; a very
long text is one row like any other, and only the part of it that is taken is rebuilt; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, small_or_shuffled, unpacked, whole_row

WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of one source whose running total a single task makes.
RANGE_ROWS = 10_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _turn(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """(source, source_size, target, whole, rest) of a table (source, size); one row per source.

    Numbering the sources sorts the table of sources in one task: it holds one short row for each distinct source.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    table = saved(table.withColumn("weight", F.array(*map(F.lit, weights))[turn].cast("long")))
    total, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    share, limit = (total or 0), F.col("source_size") * epochs

    def capped() -> Column:
        return F.col("weight").cast("decimal(38,0)") * F.lit(share).cast("decimal(20,0)") > F.col("source_size").cast("decimal(20,0)") * F.lit(epochs * (weight or 0)).cast("decimal(18,0)")

    n = 0
    while True:
        row = table.agg(F.count_if(capped()), F.sum(F.when(capped(), limit)), F.sum(F.when(~capped(), F.col("weight")))).first()
        at_limit = capped()
        if row[0] == n or not weight:
            break
        n, share, weight = row[0], (total or 0) - (row[1] or 0), row[2] or 0
        if not weight:
            at_limit = F.lit(True)
            break
    target = F.when(at_limit, limit.cast("double")).otherwise((F.col("weight") * F.lit(share)).cast("double") / F.lit(float(weight or 1)))
    words = F.round("target").cast("long")
    size = F.greatest("source_size", F.lit(1))
    return table.withColumn("target", target).withColumn("whole", F.floor(words / size)).withColumn("rest", words - F.col("whole") * F.col("source_size"))


def decisions(sizes: DataFrame, seed: str, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """One row per source: its targets and the edge (turn, size, words for each row there) of its last repetition."""
    sources = saved(targets(sizes, weights, epochs))
    most = sources.agg(F.sum("rows")).first()[0] or 0
    ranges = max(1, -(-most // RANGE_ROWS))
    drawn = sizes.groupBy("source", _turn(seed).alias("turn"), "size").agg(F.count("*").alias("ties"))
    place = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * ranges / 2**32)
    drawn = drawn.filter("size > 0").withColumn("range", place).withColumn("words", F.col("size") * F.col("ties"))
    sums = drawn.groupBy("source", "range").agg(F.sum("words").alias("in_range"))
    before = sums.withColumn("before", F.coalesce(F.sum("in_range").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the edge lies in one range of each source: only that one is ordered
    rest = sources.select(F.col("source").alias("s"), "rest")
    edge_range = before.join(small_or_shuffled(rest, rest.count()), F.col("source").eqNullSafe(F.col("s"))).filter("rest > 0 AND before < rest AND rest <= before + in_range").select(F.col("source").alias("s"), F.col("range").alias("r"), "before", "rest")
    edge_range = saved(edge_range)
    inside = drawn.join(small_or_shuffled(edge_range, edge_range.count()), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    running = F.sum("words").over(Window.partitionBy("s", "r").orderBy("turn", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge = inside.withColumn("end", F.col("before") + running).filter("end - words < rest AND rest <= end")
    edge = edge.select(F.col("s").alias("edge_source"), F.col("turn").alias("edge_turn"), F.col("size").alias("edge_size"), F.floor((F.col("rest") - F.col("end") + F.col("words")) / F.col("ties")).alias("edge_words"))
    return sources.join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left").select(F.col("source").alias("mix_source"), "source_size", "target", "whole", "edge_turn", "edge_size", "edge_words")


def with_taken(documents: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """(row, doc_id, size, source_size, target, whole, taken): each row of documents (doc_id, text, source, ...) as a
    struct, and the words that the mix takes of it."""
    sizes = saved(documents.select("doc_id", "source", n_words("text").alias("size")))
    table = saved(decisions(sizes, seed, weights, epochs))
    here = F.struct(_turn(seed).alias("a"), F.col("size").alias("b"))
    edge = F.struct(F.col("edge_turn").alias("a"), F.col("edge_size").alias("b"))
    more = F.when(F.col("edge_turn").isNull(), 0).when(here < edge, F.col("size")).when(here == edge, F.col("edge_words")).otherwise(0)
    rows = documents.select(whole_row(documents), "doc_id", F.col("source").alias("of_source"), n_words("text").alias("size"))
    joined = rows.join(small_or_shuffled(table, table.count()), F.col("of_source").eqNullSafe(F.col("mix_source")))
    return joined.select("row", "doc_id", "size", "source_size", "target", "whole", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"))


def mix(documents: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of documents."""
    return with_taken(documents.select("doc_id", "text", "source"), **how).select("doc_id", "size", "source_size", "target", "taken")


def repeated(documents: DataFrame, **how) -> DataFrame:
    """The mixed corpus, with the columns of documents: whole repetitions as rows, then the part of one that is left.

    A part keeps the words in order, single spaces between them; n_chars, where there is one, follows its text.
    """
    taken = with_taken(documents, **how).filter("taken > 0 AND size > 0")
    rows = taken.withColumn("turns", F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))).withColumn("repeat", F.explode("turns"))
    left = F.col("taken") - F.col("repeat") * F.col("size")
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("row")["text"], F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    rows = rows.withColumn("cut", left < F.col("size")).withColumn("text", F.when(F.col("cut"), part).otherwise(F.col("row")["text"]))
    changed = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.col("cut"), F.length("text").cast(dict(documents.dtypes)["n_chars"])).otherwise(F.col("row")["n_chars"])
    return unpacked(rows, documents.columns, changed)
