"""Scores of an execution log that arrives as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.draws import scratch
from ..operators.nulls import calibrate

#: Statistics that hold bounded state for each variant and window.
RUNNING = {"best_of_n": F.max, "pass_rate": F.avg}


def windowed_scores(log: DataFrame, variant: str, outcome: str, at: str, width: str, late: str, statistic: str = "best_of_n") -> DataFrame:
    """(window_start, entity, score, n) of each variant in tumbling windows; rows later than `late` are left out.

    State is one row for each variant and open window, and goes when the watermark has passed the window's end.
    """
    known = log.filter(F.col(outcome).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    out = known.groupBy(F.window(at, width).alias("w"), F.col(variant).alias("entity")).agg(RUNNING[statistic](outcome).alias("score"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "entity", "score", "n")


def calibrated_batches(scores: DataFrame, null: DataFrame, name: str) -> DataFrame:
    """Runs the stream over what has arrived, calibrates every micro-batch's whole table by a null (n, null_mean,
    null_sd), and returns the last table; each batch is written to its own folder, so a repeated batch replaces itself."""
    spark, folder = scores.sparkSession, scratch(scores.sparkSession, name)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        calibrate(batch, null).write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        last.append(number)

    query = scores.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(write).start()
    query.awaitTermination()
    if not last:
        return calibrate(spark.createDataFrame([], scores.schema), null)
    return spark.read.parquet(f"{folder}/batch-{max(last)}")
