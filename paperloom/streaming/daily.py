"""Study time per learner and day over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_study(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``learner_id, day, seconds, sessions`` of days that are over, ``delay`` after the last time seen.
    ``stream``: learner_id, ts, seconds. Rows that come later than that are left out, and Spark's
    progress counts them (``numRowsDroppedByWatermark``)."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    days = timed.groupBy("learner_id", F.window("ts", "1 day").alias("w")).agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("sessions"))
    return days.select("learner_id", F.col("w.start").cast("date").alias("day"), "seconds", "sessions")
