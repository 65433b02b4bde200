"""Streamed scores against the same rows read at once."""

from pyspark.sql import functions as F

from nullgauge.streaming.scores import calibrated_batches, windowed_scores


def test_streamed_scores_equal_batch_scores(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 7).alias("v"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.lit(1_700_000_000) + F.col("id") * 1000).cast("timestamp").alias("at"))
    rows.repartition(5).write.parquet(str(tmp_path / "log"))
    null = spark.createDataFrame([(1, 0.0, 1.0), (100, 50.0, 2.0)], "n long, null_mean double, null_sd double")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "log"))
    got = calibrated_batches(windowed_scores(stream, "v", "x", "at", "1 day", "30 days"), null, "test")
    want = rows.groupBy(F.window("at", "1 day").alias("w"), "v").agg(F.max("x").alias("score"), F.count("*").alias("n"))
    assert sorted((r.window_start, r.entity, r.score, r.n) for r in got.collect()) == sorted((r.w.start, r.v, r.score, r.n) for r in want.collect())
    assert got.filter("z IS NULL").count() == 0
