"""Calendar-aware panel operators. A panel has an entity column `city` and a date column `day`, one row for each pair.

Frames are ranges over the day number, so a gap never pairs a row with the wrong day, and one sort by entity serves all frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S

def by_day():
    """Rows of an entity along the day number."""
    return W.partitionBy("city").orderBy(S.day_number(F.col("day")))


def at(x: Column, days: int) -> Column:
    """x of the same entity exactly `days` days later (earlier if negative); null if that day is missing."""
    return F.max(x).over(by_day().rangeBetween(days, days))


def hours_seen(where: Column) -> Column:
    """How many different hours of the day rows that meet `where` have: a set of 24 bits, so the aggregate needs no pass over distinct values."""
    bit = F.call_function("shiftleft", F.lit(1), F.col("hour"))
    return F.coalesce(F.bit_count(F.bit_or(F.when(where, bit))), F.lit(0)).cast("long")


def gated(value: Column, of: Column, min_hours: int) -> Column:
    """value if `of` is there in at least `min_hours` different hours, else null."""
    return F.when(hours_seen(of.isNotNull()) >= min_hours, value)


def daily(hourly: DataFrame, min_hours: int = 24, rain_from: float = 0.1) -> DataFrame:
    """Days of hourly readings (city, day, hour, t_c, rh, value): extremes, means, totals and the highest heat index, each null unless its own source is complete, with level and next-day targets."""
    rows = hourly.withColumn("_hi", S.heat_index(F.col("t_c"), F.col("rh")))
    t, rh, rain, hi = (F.col(c) for c in ("t_c", "rh", "value", "_hi"))
    of = lambda f, c, name: gated(S.half_even(f(c)), c, min_hours).alias(name)
    own = rows.groupBy("city", "day").agg(
        of(F.min, t, "t_min"), of(F.avg, t, "t_mean"), of(F.max, t, "t_max"), of(F.min, rh, "rh_min"), of(F.avg, rh, "rh_mean"), of(F.max, rh, "rh_max"),
        of(F.sum, rain, "rain_total"), gated(hours_seen(rain >= rain_from), rain, min_hours).alias("rain_hours"),
        of(F.max, hi, "hi"), hours_seen(F.col("hour").isNotNull()).alias("n_hours"),
    )
    return with_targets(own, "hi")


def with_targets(panel: DataFrame, value: str) -> DataFrame:
    """level of `value`, and hi_next and level_next: the value and level of the next calendar day."""
    out = panel.withColumn("level", S.heat_level(F.col(value))).withColumn("hi_next", at(F.col(value), 1))
    return out.withColumn("level_next", S.heat_level(F.col("hi_next")))


def drop_last_day(panel: DataFrame) -> DataFrame:
    """Without each entity's last day, whose next day cannot be known; days before inner gaps stay, with null targets."""
    last = F.max("day").over(W.partitionBy("city"))
    return panel.withColumn("_last", last).where(F.col("day") < F.col("_last")).drop("_last")


def lag_names(columns: Sequence[str], lags: Sequence[int] = (1, 2, 3), means: Sequence[int] = (3,), deltas: Sequence[str] = ()) -> list[str]:
    return [f"{c}_lag{k}" for c in columns for k in lags] + [f"{c}_mean{w}d" for c in columns for w in means] + [f"{c}_change1d" for c in deltas]


def with_lags(panel: DataFrame, columns: Sequence[str], lags: Sequence[int] = (1, 2, 3), means: Sequence[int] = (3,), deltas: Sequence[str] = ()) -> DataFrame:
    """Past-only features: values of exactly k days ago, means of the last w days with today (null unless all are there), and today less yesterday."""
    out = {f"{c}_lag{k}": at(F.col(c), -k) for c in columns for k in lags}
    for c in columns:
        for w in means:
            frame = by_day().rangeBetween(1 - w, 0)
            total = F.col(c)
            for k in range(1, w):
                total = total + at(F.col(c), -k)
            out[f"{c}_mean{w}d"] = F.when(F.count(c).over(frame) == w, total / w)
    out |= {f"{c}_change1d": F.col(c) - at(F.col(c), -1) for c in deltas}
    return panel.withColumns(out)


def require_unique(panel: DataFrame, keys: Sequence[str] = ("city", "day")) -> None:
    """Raise if a key stands more than once; lags would be ambiguous."""
    if panel.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"duplicate {'/'.join(keys)} rows")


def steps(panel: DataFrame) -> DataFrame:
    """Days since the entity's previous row."""
    return panel.withColumn("step", F.datediff("day", F.lag("day").over(W.partitionBy("city").orderBy("day"))))


def runs(days: DataFrame, by: Sequence[str]) -> DataFrame:
    """Maximal runs of consecutive days in distinct (by, day): first_day and length of each."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy("day"))
    return days.select(*by, "day").distinct().withColumn("_start", F.expr("day") - nth).groupBy(*by, "_start").agg(F.min("day").alias("first_day"), F.count("*").alias("length")).drop("_start")


def complete_days(panel: DataFrame) -> DataFrame:
    """Every entity with every day from its first to its last that the panel lacks."""
    span = panel.groupBy("city").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = span.select("city", F.explode(F.sequence("a", "b")).alias("day"))
    return every.join(panel.select("city", "day"), ["city", "day"], "left_anti")


def without_following(panel: DataFrame) -> DataFrame:
    """city and n: its rows that no row of the next day follows."""
    after = panel.select("city", F.date_sub("day", 1).alias("day"), F.lit(1).alias("_next")).distinct()
    return panel.select("city", "day").join(after, ["city", "day"], "left").groupBy("city").agg(F.count_if(F.col("_next").isNull()).alias("n"))


def constant_of(panel: DataFrame, value: str) -> DataFrame:
    """For each city of a value that should not change: its median, how many values it takes, and the first by day."""
    return panel.groupBy("city").agg(F.median(value).alias("median"), F.count_distinct(value).alias("n_values"), F.min_by(value, "day").alias("first"))
