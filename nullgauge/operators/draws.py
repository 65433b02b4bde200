"""Deterministic draws: hash expressions that give the same numbers on any partitioning and in plain SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names; without one only a local session gets a temporary folder."""
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context.getCheckpointDir() is None:
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        context.setCheckpointDir(folder)
    return (folder or context.getCheckpointDir()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is made and run in here go when it ends; else they stay on the disks until the
    driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table that this library wrote to the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    with freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """A table in the session's shared folder, for loops: it carries nothing of the plan on (with checkpoints, rounds of
    community moves were measured to take twice as long each time)."""
    path = scratch(df.sparkSession, "round")
    with freeing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Latest:
    """The last table of a loop: when a round is written, the one before is removed, so that disks hold two rounds at
    most, however many there are."""

    def __init__(self, spark: SparkSession):
        self._spark, self._path = spark, None

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch(self._spark, "round")
        with freeing(self._spark):
            df.write.parquet(path)
        self.close()
        self._path = path
        return self._spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        if self._path:
            removed(self._spark, self._path)
        self._path = None


def key(*parts) -> Column:
    """Parts joined by colons; plain values are literals."""
    return F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def u32(*parts) -> Column:
    """A 32-bit unsigned integer from the first half of an md5; its use modulo a pool size is biased by size / 2**32."""
    return F.conv(F.substring(F.md5(key(*parts).cast("binary")), 1, 8), 16, 10).cast("long")


def hash_rank(*parts) -> Column:
    """The first 60 bits of an md5 as an integer: in the order of the md5 itself, but for equal beginnings."""
    return F.conv(F.substring(F.md5(key(*parts).cast("binary")), 1, 15), 16, 10).cast("long")


def uniform(*parts) -> Column:
    return u32(*parts) / F.lit(2.0**32)


def numbered(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Numbers rows from 0 in a total order without one task for all: ranges, their offsets, ranks inside.

    The range table is saved first, since its bounds come from a sample and must not be drawn twice.
    """
    ranged = saved(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def in_hash_order(df: DataFrame, hashed: Column, rows: int, node: str, *order: str) -> DataFrame:
    """Adds pos, from 0, and after, the next row's `node` (null in the last row), in the order of an md5 and then of `order`.

    An md5 is even, so ranges of its values need no sample, and the table is shuffled once: a first pass counts the
    ranges, which are about 31,000 rows each and are dealt to tasks of 500,000.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 500_000))
    first = F.conv(F.substring("_h", 1, 15), 16, 10).cast("long")
    ranged = df.withColumn("_h", hashed).withColumn("_first", first).withColumn("_range", F.shiftright(F.shiftright("_first", 36) * F.lit(16 * tasks), 24))
    by = Window.orderBy("_range")  # a short row for each range
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.min_by(node, "_first").alias("_node"))
    sizes = saved(sizes.select("_range", F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_node").over(by).alias("_next")))
    inside = Window.partitionBy("_range").orderBy("_h", *order)
    placed = ranged.drop("_first").withColumn("_h", F.unhex("_h")).repartition(tasks, "_range").withColumns({"_inside": F.row_number().over(inside) - 1, "after": F.lead(node).over(inside)})
    placed = placed.join(F.broadcast(sizes), "_range").withColumns({"pos": F.col("_before") + F.col("_inside"), "after": F.coalesce("after", "_next")})
    return placed.drop("_h", "_range", "_inside", "_before", "_next")


def intervals_of(df: DataFrame, ident: str, size: str) -> tuple[DataFrame, int, int]:
    """(first, last, node, block) of rows of so many places each, in the order of `ident`, once for each block of places
    that they reach into; the number of places and the places of a block (about as many as a row has)."""
    named = saved(df.select(F.col(ident).alias("node"), F.col(size).alias("_size")))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-named.count() // 500_000))
    ranged = saved(named.repartitionByRange(tasks, "node").withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum("_size").alias("_n"), F.count("*").alias("_rows"))
    total = sums.agg(F.sum("_n"), F.sum("_rows")).first()
    places, width = total[0] or 0, max(1, (total[0] or 0) // (total[1] or 1))
    before = sums.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    last = F.sum("_size").over(Window.partitionBy("_range").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)) - 1
    at = ranged.repartition(tasks, "_range").withColumn("last", last).join(F.broadcast(before), "_range").select((F.col("last") + F.col("_before") - F.col("_size") + 1).alias("first"), (F.col("last") + F.col("_before")).alias("last"), "node")
    blocks = F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))
    return at.filter(F.col("last") >= F.col("first")).withColumn("block", F.explode(blocks)), places, width


def at_places(df: DataFrame, place: str, rows: int, intervals: DataFrame, width: int, name: str) -> DataFrame:
    """Adds the row of `intervals_of` that a place lies in, as `name`, and drops the place."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 1_000_000))
    there = intervals.select("first", "last", F.col("node").alias(name), "block").repartition(tasks, "block").hint("shuffle_hash")
    inside = (F.col(place) >= F.col("first")) & (F.col(place) <= F.col("last"))
    placed = df.withColumn("_block", F.floor(F.col(place) / width)).repartition(tasks, "_block")
    return placed.join(there, (F.col("_block") == F.col("block")) & inside).drop("_block", "block", "first", "last", place)


def replicates(df: DataFrame, n: int, name: str = "rep") -> DataFrame:
    """Each row n times, numbered 0 .. n - 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def spread(df: DataFrame, rows: int, each: int = 1_000_000) -> DataFrame:
    """A small table dealt over tasks before it is exploded into so many rows, about `each` to a task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def dealt(df: DataFrame, rows: int, *by: str, each: int = 500_000) -> DataFrame:
    """Rows dealt by keys to tasks of about `each`, however many there are: the planner's own number of tasks follows
    bytes or a setting, and each task grows with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *by)


def ranged_draws(spark: SparkSession, reps: int, size: int, rows: int = 1_000_000) -> DataFrame:
    """(rep, slot): `size` slots of each replicate, in tasks of about so many rows."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-reps * size // rows))
    at = spark.range(0, reps * size, 1, tasks)
    return at.select(F.floor(F.col("id") / F.lit(max(size, 1))).alias("rep"), (F.col("id") % F.lit(max(size, 1))).alias("slot"))
