"""The execution log of the test tables read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nulls
from ..operators.draws import saved
from ..streaming.scores import calibrated_batches, windowed_scores
from .base import Tables, query, r
from .calibration import _U32


@query(f"""WITH pool AS (SELECT value AS v, row_number() OVER (ORDER BY value, event_id) - 1 AS pos FROM events WHERE event_type = 'error'), d AS (SELECT n, draw, {_U32.format("'live:' || n || ':' || draw || ':' || slot")} % (SELECT count(*) FROM pool) AS pos FROM (SELECT n, draw, unnest(range(n)) AS slot FROM (VALUES (1), (4), (16), (64)) g(n), range(100) t(draw))
), nul AS (SELECT CAST(n AS BIGINT) AS n, avg(stat) AS m, stddev_samp(stat) AS sd FROM (SELECT n, draw, max(v) AS stat FROM d JOIN pool USING (pos) GROUP BY 1, 2) GROUP BY 1), iv AS (SELECT n AS n0, m AS m0, sd AS s0, lead(n) OVER w AS n1, lead(m) OVER w AS m1, lead(sd) OVER w AS s1 FROM nul WINDOW w AS (ORDER BY n)
), s AS (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, user_id AS entity, count(*) AS n, max(value) AS score FROM events GROUP BY 1, 2), c AS (SELECT *, least(greatest(n, 1), 64) AS nn FROM s)
SELECT window_start, entity, n, round(score, 6) AS score, round((score - (m0 + (ln(nn) - ln(n0)) / (ln(n1) - ln(n0)) * (m1 - m0))) / (s0 + (ln(nn) - ln(n0)) / (ln(n1) - ln(n0)) * (s1 - s0)), 5) AS z FROM c JOIN iv ON n1 IS NOT NULL AND nn >= n0 AND (nn < n1 OR nn = 64 AND n1 = 64)""")
def streamed_leaderboard(t: Tables) -> DataFrame:
    """Best value of each user in weekly windows of the streamed events, calibrated by the error events."""
    grid = t._spark.createDataFrame([(1,), (4,), (16,), (64,)], "n long")
    null = saved(nulls.fit_null(t.events.filter("event_type = 'error'"), "value", ("value", "event_id"), grid, "best_of_n", draws=100, seed="live"))
    stream = t._spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t._dir)
    # times without a zone count as UTC, whatever the session's zone is
    stream = stream.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp"))
    z = calibrated_batches(windowed_scores(stream, "user_id", "value", "ts", "7 days", "1 day"), null, "streamed")
    start = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("window_start").cast("timestamp_ntz"))
    return z.select(start.alias("window_start"), "entity", "n", r("score").alias("score"), r(F.col("z"), 5).alias("z"))
