"""Connected components of a link table, by alternating large and small stars until nothing changes.

Each step is a grouped minimum and an equality join, so no neighbour list is gathered and no link reaches the driver;
the driver sees one number a round. Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TASK_ROWS, gathered, saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node that has a link, with the smallest node that it reaches.

    Rows with a null end and links of a node to itself are left out; an empty table gives an empty result.
    """
    links = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = gathered(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        # a step only moves or drops links, so its tables need no more tasks than the one before
        tasks = -(-state[0] // TASK_ROWS)
        large = saved(_large_star(edges).coalesce(tasks))
        edges = saved(_small_star(large).coalesce(tasks).distinct().coalesce(tasks))
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
