"""The daily aggregate over a stream of readings, with late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S


def daily_stream(readings: DataFrame, late: str = "1 day", min_hours: int = 24) -> DataFrame:
    """Days of a stream of (city, ts, t_c, rh): readings, hours seen and the highest heat index, emitted once the watermark has passed the day. The hours are counted as a set of 24 bits, so state is a few numbers a day."""
    rows = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    seen = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.hour("ts"))))
    own = rows.groupBy("city", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), seen.alias("n_hours"), F.max(S.heat_index(F.col("t_c"), F.col("rh"))).alias("_hi"))
    return own.select("city", F.to_date("w.start").alias("day"), "n", "n_hours", F.when(F.col("n_hours") >= min_hours, S.half_even(F.col("_hi"))).alias("hi"))
