"""Approximate nearest neighbours by cross-polytope hashing.

In each of TABLES tables, pseudo-rotations (three rounds of random signs and a fast Hadamard transform) send a vector,
scaled to a unit vector by its own norm so that no other row's norm counts, to its nearest signed axis. One polytope
has two cells for each component; further polytopes, the last one over fewer axes, cut these cells until they hold
about CELL_ROWS rows, so that the share of the rows that a query meets falls as the table grows. A query probes cells
in order of the squared distances that its nearest axes lead by. Probed cells are compared block by block, exactly and
in double precision; blocks hold at most BLOCK rows of either side, so a cell of any size is split, and every row of a
cell is compared.

How many cells a query probes follows from what it finds. A pilot of PILOT queries, compared with every row, tells at
which cosines neighbours lie, and so the first number of probes. `Recall` is simulated: a row at a cosine c is met with
a probability that depends on c and the number of probes alone. A query whose k-th score could be beaten by a row at a
smaller cosine than the one from which at least RECALL of the rows are met goes on, with FURTHER times as many probes,
and after MOST of them is compared with every row that could enter its list: rows are dealt into ranges of norms, RATIO
wide each, since a long vector is among the nearest at a small cosine, too. So only a table with too few candidates
gives a shorter list.

A query meets its own cells before all others. What they give is a floor for its list: further blocks return the rows
that reach it and none below, which could not enter. So the rows that blocks return follow the queries, and not the
number of cells that a query probes.

Rows of equal vectors are one candidate with its k + 1 smallest ids, which is all that a list of k can show.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold a null or non-finite
component take no part, nor do rows with a null vec_id; rows of equal vec_id are one id, and none of them is a
candidate of their own query, which asks with each of its vectors; vectors of any length are compared whole; other
columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, small_or_shuffled

TABLES, CELL_ROWS, BLOCK = 8, 100, 4096
RECALL, RATIO = 0.9, 1.25
#: Queries that are compared with every row first, and the share of them that the first probes should settle.
PILOT, SETTLED = 48, 0.95
FURTHER, MOST = 3, 512


def rotated(x: np.ndarray, table: int, size: int) -> np.ndarray:
    """A fast Hadamard pseudo-rotation of the rows of x, padded to `size` components."""
    draw = np.random.default_rng([20240301, table])
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for _ in range(3):
        y *= draw.choice(np.array([-1.0, 1.0]), size)
        half = 1
        while half < size:
            y = y.reshape(len(x), -1, 2, half)
            y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), size)
            half *= 2
        y /= np.sqrt(size)
    return y


def polytopes(size: int, rows: int) -> list[int]:
    """Axes of each polytope of a table: the first has all, others follow until cells hold at most half as
    many rows again as CELL_ROWS on average."""
    axes, cells = [size], 2 * size
    while 1.5 * cells * CELL_ROWS < rows:
        more = min(size, 1 << max(0, round(np.log2(rows / (CELL_ROWS * cells * 2)))))
        axes.append(more)
        cells *= 2 * more
    return axes


def _gaps(x: np.ndarray, table: int, level: int, size: int, axes: int) -> np.ndarray:
    """Squared distances by which each row's nearest signed axis leads the others: k is axis k, axes + k its opposite."""
    y = rotated(x, table + 1000 * level, size)[:, :axes]
    both = np.concatenate((y, -y), 1)
    return (both.max(1)[:, None] - both) ** 2


def cells_of(x: np.ndarray, table: int, size: int, axes: list[int]) -> np.ndarray:
    """Each row's own cell."""
    cell = np.zeros(len(x), np.int64)
    for level, n in enumerate(axes):
        cell = cell * 2 * n + _gaps(x, table, level, size, n).argmin(1)
    return cell


def probed(x: np.ndarray, table: int, size: int, axes: list[int], n: int) -> np.ndarray:
    """The n nearest cells of each row, nearest first (fewer if there are fewer)."""
    out = []
    for low in range(0, len(x), 64):
        part = x[low : low + 64]
        cell, gap = np.zeros((len(part), 1), np.int64), np.zeros((len(part), 1))
        for level, m in enumerate(axes):
            more = _gaps(part, table, level, size, m)
            gap = (gap[:, :, None] + more[:, None, :]).reshape(len(part), -1)
            cell = (cell[:, :, None] * 2 * m + np.arange(2 * m)).reshape(len(part), -1)
            if gap.shape[1] > n:
                some = np.argpartition(gap, n - 1, axis=1)[:, :n]
                gap, cell = np.take_along_axis(gap, some, 1), np.take_along_axis(cell, some, 1)
        out.append(np.take_along_axis(cell, np.argsort(gap, axis=1, kind="stable"), 1))
    return np.concatenate(out)


@lru_cache(8)
def _met(size: int, axes: tuple[int, ...], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines, falling, and for each the sorted numbers of probes that meet simulated rows at that cosine."""
    draw, n = np.random.default_rng([20240302, size, *axes]), 400
    q, x = (y / np.sqrt((y * y).sum(1))[:, None] for y in (draw.normal(size=(n, size)) for _ in range(2)))
    x -= (x * q).sum(1)[:, None] * q
    x /= np.sqrt((x * x).sum(1))[:, None]
    order, cosines = [probed(q, t, size, list(axes), most) for t in (0, 1)], np.arange(0.98, -0.005, -0.02)
    needed = np.empty((len(cosines), 2 * n))
    for k, c in enumerate(cosines):
        y = c * q + np.sqrt(max(0.0, 1 - c * c)) * x
        for t in (0, 1):
            hit = order[t] == cells_of(y, t, size, list(axes))[:, None]
            needed[k, t * n : (t + 1) * n] = np.where(hit.any(1), hit.argmax(1) + 1, np.inf)
    return cosines, np.sort(needed, axis=1)


def sure_cosine(size: int, axes: list[int], probes: int, most: int = MOST) -> float:
    """The cosine from which a row is in a probed cell with a probability of RECALL at least, by simulation."""
    cosines, needed = _met(size, tuple(axes), most)
    met = np.array([np.searchsorted(row, probes, "right") for row in needed]) / needed.shape[1]
    fine = 1 - (1 - met) ** TABLES >= RECALL
    return float(cosines[: int(np.argmin(fine)) if not fine.all() else len(fine)].min(initial=1.0))


def first_probes(size: int, axes: list[int], cosines: np.ndarray, most: int) -> int:
    """The fewest probes that settle the share SETTLED of queries whose k-th neighbours lie at these cosines."""
    aim = float(np.quantile(cosines, 1 - SETTLED)) if len(cosines) else 1.0
    n = 4
    while n < most and sure_cosine(size, axes, n) > aim:
        n = min(most, n + max(2, n // 4))
    return n


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(1)[:, None]
    return unit / np.sqrt((unit * unit).sum(1))[:, None]


def _hasher(size: int, axes: list[int], probes: tuple[int, int] | None):
    """Adds the buckets (cells of all tables) of rows: their own, or those that queries probe from one place to another."""
    cells = int(np.prod([2.0 * n for n in axes]))

    def run(batches):
        for batch in batches:
            x = _rows(batch.column("vector"))
            if not len(x):
                continue
            unit = _unit(x)
            each = [probed(unit, t, size, axes, probes[1])[:, probes[0] :] if probes else cells_of(unit, t, size, axes)[:, None] for t in range(TABLES)]
            buckets = (np.stack(each, 1) + (np.arange(TABLES) * cells)[None, :, None]).reshape(len(x), -1)
            edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * buckets.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(edges, pa.array(buckets.ravel()))], ["id", "buckets"])

    return run


def _pilot(queries: np.ndarray, k: int):
    """For each query the k + 1 largest products with the rows of a batch, and the rows' norms."""

    def run(batches):
        for batch in batches:
            x = _rows(batch.column("vector"))
            if not len(x):
                continue
            product, n = queries @ x.T, min(k + 1, len(x))
            best = np.argpartition(-product, n - 1, axis=1)[:, :n]
            score, norm = np.take_along_axis(product, best, 1), np.sqrt((x * x).sum(1))[best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(queries)), n), pa.int32()), pa.array(score.ravel()), pa.array(norm.ravel())], ["query", "score", "norm"])

    return run


def _compare(keep: int):
    """The `keep` nearest rows of a block for each query of a block, ties to the smaller `first`; none below the query's floor."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = _rows(index.column("vector")), _rows(queries.column("vector"))
        ids, firsts, names = index.column("id").to_numpy(), index.column("first").to_numpy(), queries.column("id").to_numpy()
        floors = queries.column("floor").to_numpy()
        n = min(len(x), keep)
        # the rough product and the sum in component order are both within half of this, a length's product, of the true one
        bound = 2 * np.finfo(float).eps * (x.shape[1] + 4) * np.sqrt((x * x).sum(1).max())
        out = []
        for low in range(0, len(q), 256):
            part = q[low : low + 256]
            rough, floor = part @ x.T, floors[low : low + 256]
            # the rough product chooses all that may be among the n first, the sum in component order decides
            least = np.maximum(np.partition(rough, len(x) - n, axis=1)[:, len(x) - n], floor) - 2 * bound * np.sqrt((part * part).sum(1))
            of, near = np.nonzero(~(rough < least[:, None]))
            score = np.zeros(len(of))
            for k in range(x.shape[1]):
                score += part[of, k] * x[near, k]
            enters = ~(score < floor[of])
            of, near, score = of[enters], near[enters], score[enters]
            order = np.lexsort((ids[near], firsts[near], -score, of))
            place = np.arange(len(of)) - np.searchsorted(of, of)
            order = order[place < n]
            best = near[order]
            out.append(pa.Table.from_arrays([pa.array(names[low + of[order]]), pa.array(ids[best]), pa.array(firsts[best]), pa.array(score[order])], schema=schema))
        return pa.concat_tables(out)

    return run


def _usable(column: str) -> Column:
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _norm(scaled: bool = True) -> Column:
    """The norm of `vector`, or its logarithm, which is finite for every usable vector."""
    wide = F.col("vector").cast("array<double>")
    most = F.array_max(F.transform(wide, F.abs))
    rest = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    return most * rest if scaled else F.log(most) + F.log(rest)


def _compared(index: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """(query, id, first, score): the `keep` nearest rows of each block for each query of the same bucket that reach its floor."""
    blocks = index.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of_rows")).join(queries.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of_queries")), "bucket")
    blocks = saved(blocks)
    blocks = small_or_shuffled(blocks, blocks.count())
    left = index.join(blocks, "bucket").withColumn("r", F.pmod(F.xxhash64("id"), F.col("of_rows")).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("of_queries") - 1)))
    right = queries.join(blocks, "bucket").withColumn("c", F.pmod(F.xxhash64("id"), F.col("of_queries")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("of_rows") - 1)))
    return left.select("bucket", "r", "c", "id", "first", "vector").groupBy("bucket", "r", "c").cogroup(right.select("bucket", "r", "c", "id", "vector", "floor").groupBy("bucket", "r", "c")).applyInArrow(_compare(keep), "query long, id long, first long, score double")


def _kth_cosines(classes: DataFrame, asked: DataFrame, k: int) -> np.ndarray:
    """The cosines of the k-th neighbours of a pilot of queries, against every row (one pass, k + 1 rows a batch)."""
    pilot = asked.orderBy(F.xxhash64("id"), "id").limit(PILOT).select("vector").collect()
    q = _unit(np.array([r.vector for r in pilot], np.float64))
    found = classes.select("vector").mapInArrow(_pilot(q, k), "query int, score double, norm double")
    # a query's own row is among the first, so the k-th other one is at place k + 1
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "norm"))
    last = found.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("query").agg(F.max_by(F.col("score") / F.col("norm"), "place").alias("cosine"))
    return np.array([r.cosine for r in last.collect()])


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by `every`.

    probes: cells that each query probes first in each table; chosen by a pilot if not given.
    """
    spark = vectors.sparkSession
    # single precision is kept as it is stored; every product is made in double precision
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.filter(F.col("vec_id").isNotNull() & _usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    length = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    size = 1 << (int(length.n) - 1).bit_length()
    rows = rows.filter(F.size("vector") == length.n).distinct()

    # equal vectors: one candidate, named by its smallest id
    first = Window.partitionBy("vector").orderBy("vec_id")
    classes = saved(rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("first", F.element_at("ids", 1)).withColumn("id", F.xxhash64("vector", "first")))
    # rows of equal vec_id may share their first id; so many candidates hold k + 1 different ones
    shared = classes.groupBy("first").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    keep = (k + 1) * shared[0]
    asked = saved(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "vector").agg(F.lit(1).alias("one")).select(F.col("vec_id").alias("id"), F.col("vector").alias("vector")))
    if asked.isEmpty():
        return spark.createDataFrame([], schema)
    axes = polytopes(size, shared[1])
    most = min(MOST, int(np.prod([2.0 * n for n in axes])) // 2)
    probes = min(most, probes or first_probes(size, axes, _kth_cosines(classes, asked, k), most))

    hashed = "id long, buckets array<long>"

    def placed(table: DataFrame, probes: tuple[int, int] | None) -> DataFrame:
        """(id, bucket, and the other columns) of a table (id, vector, ...); only ids and buckets are stored."""
        buckets = saved(table.select("id", "vector").mapInArrow(_hasher(size, axes, probes), hashed).select("id", F.explode("buckets").alias("bucket")))
        return buckets.join(small_or_shuffled(table, shared[1] * int(length.n)), "id")

    index = placed(classes.select("id", "first", "vector"), None)
    dealt = classes.select("id", "first", "vector", F.floor(_norm(False) / float(np.log(RATIO))).cast("long").alias("bucket"), _norm().alias("norm"))
    # 64-bit floats span fewer than 7,000 ranges
    ranges = F.broadcast(saved(dealt.groupBy("bucket").agg(F.max("norm").alias("longest"))))

    def some(pairs: DataFrame) -> DataFrame:
        best = pairs.groupBy("query", "id", "first").agg(F.max("score").alias("score"))
        return saved(best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first", "id"))).filter(F.col("place") <= keep).drop("place"))

    def floored(queries: DataFrame, best: DataFrame | None) -> DataFrame:
        """Queries with their floor: the last score of a full list; none (minus infinity) of a shorter one."""
        none = F.lit(float("-inf"))
        if best is None:
            return queries.withColumn("floor", none)
        last = best.groupBy(F.col("query").alias("id")).agg(F.when(F.count("*") >= keep, F.min("score")).alias("floor"))
        return queries.join(last, "id", "left").withColumn("floor", F.coalesce("floor", none))

    def ranked(best: DataFrame) -> DataFrame:
        found = best.join(classes.select("id", "ids"), "id").select(F.col("query").alias("query_id"), F.explode("ids").alias("vec_id"), "score").filter("vec_id != query_id")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def unsure(best: DataFrame, probes: int) -> DataFrame:
        """(id, vector, bucket): ranges of norms that a query may have missed rows of."""
        least = ranked(best).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        reach = asked.join(least, "id", "left").withColumn("norm", _norm()).crossJoin(ranges)
        reach = reach.filter(F.col("least").isNull() | (F.col("least") < F.col("norm") * F.col("longest") * sure_cosine(size, axes, probes)))
        return saved(reach.select(*[F.col(c).alias(c) for c in ("id", "vector", "bucket")]))

    best, before, upto, going = None, 0, 1, asked
    while True:
        pairs = _compared(index, placed(floored(going.select("id", "vector").distinct(), best), (before, upto)), keep)
        best = some(pairs if best is None else best.unionByName(pairs))
        if upto < probes:  # own cells came first
            before, upto = upto, probes
            continue
        missed = unsure(best, upto)
        if missed.isEmpty():
            return ranked(best)
        if upto >= most:
            break
        going, before, upto = missed, upto, min(most, FURTHER * upto)
    return ranked(some(best.unionByName(_compared(dealt.drop("norm"), floored(missed, best), keep))))
