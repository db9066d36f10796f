"""Date-based splits, folds and leakage measures. A date is never on two sides."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nth_day(panel: DataFrame, share: float, rounded: bool = False) -> dt.date:
    """The distinct day at `share` of the way (the index rounded half to even, or cut)."""
    days = panel.select("day").distinct()
    n = days.count()
    k = min(round(n * share) if rounded else int(n * share), n - 1)
    return days.withColumn("k", F.row_number().over(W.orderBy("day"))).where(F.col("k") == k + 1).first()["day"]


def side(test_start: Column, embargo: int = 1) -> Column:
    """'test' from test_start on, 'train' before it less the embargo, null between."""
    return F.when(F.col("day") >= test_start, "test").when(F.col("day") < F.date_sub(test_start, embargo), "train")


def chronological(panel: DataFrame, test_start: dt.date, embargo: int = 1) -> DataFrame:
    return panel.withColumn("split", side(F.lit(test_start), embargo))


def require_sides(rows: DataFrame) -> DataFrame:
    """The rows; raises if either side of their split is empty."""
    there = {r["split"] for r in rows.select("split").distinct().collect()}
    if missing := {"train", "test"} - there:
        raise ValueError(f"no {' and no '.join(sorted(missing))} rows in the split")
    return rows


def default_start(panel: DataFrame, fixed: dt.date, share: float = 0.75, before: int = 730, after: int = 90) -> dt.date:
    """The day on which testing starts: `fixed` if at least so many days lie before and after it, else the distinct day at `share`."""
    ends = panel.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if ends["a"] is not None and ends["a"] + dt.timedelta(days=before) <= fixed <= ends["b"] - dt.timedelta(days=after):
        return fixed
    return nth_day(panel, share)


@dataclass(frozen=True)
class Fold:
    number: int
    train_before: dt.date
    test_from: dt.date
    test_to: dt.date


def expanding(panel: DataFrame, splits: int = 5, gap: int = 1, min_train: int = 730) -> list[Fold]:
    """Folds of equal blocks of the latest distinct days, each trained on all days before its block less the gap. Only days come to the driver, one for each date."""
    days = [r["day"] for r in panel.select("day").distinct().orderBy("day").collect()]
    block = (len(days) - min_train - gap) // splits
    if block < 1:
        raise ValueError(f"{len(days)} days are too few for {splits} folds after {min_train}")
    out = []
    for k in range(splits):
        lo = len(days) - (splits - k) * block
        hi = lo + block if k < splits - 1 else len(days)
        out.append(Fold(k + 1, days[lo] - dt.timedelta(days=gap), days[lo], days[hi - 1]))
    return out


def fold_rows(panel: DataFrame, folds: list[Fold]) -> DataFrame:
    """The panel's rows once for each fold and side they are on."""
    bounds = panel.sparkSession.createDataFrame([(f.number, f.train_before, f.test_from, f.test_to) for f in folds], "fold int, train_before date, test_from date, test_to date")
    side = F.when(F.col("day") < F.col("train_before"), "train").when(F.col("day").between(F.col("test_from"), F.col("test_to")), "test")
    return panel.crossJoin(F.broadcast(bounds)).withColumn("side", side).where("side is not null").drop("train_before", "test_from", "test_to")  # a handful of folds


def hash_side(keys: list[str], share: int = 80) -> Column:
    """A row-wise split by an arithmetic hash of integer keys: 'train' for `share` of 100, else 'test'."""
    total = F.lit(0).cast("long")
    for k in keys:
        total = (total * 31 + F.col(k) * 7919) % 1_000_003
    return F.when(total % 100 < share, "train").otherwise("test")


def sibling_share(rows: DataFrame) -> DataFrame:
    """Of the test rows, the share with a train row of the same day, and of the same cell and day (columns split, day, cell)."""
    train = rows.where("split = 'train'")
    days = train.select("day").distinct().withColumn("_d", F.lit(1))
    cells = train.select("cell", "day").distinct().withColumn("_c", F.lit(1))
    both = rows.where("split = 'test'").join(days, "day", "left").join(cells, ["cell", "day"], "left")
    return both.agg(F.avg(F.col("_d").isNotNull().cast("double")).alias("same_day"), F.avg(F.col("_c").isNotNull().cast("double")).alias("same_cell_day"), F.count("*").alias("n_test"))
