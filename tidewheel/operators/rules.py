"""Data-quality rules as data, counted in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """bad: a condition that marks a row as wrong; null counts as wrong if null_is_bad."""

    name: str
    bad: Column
    severity: str = "error"
    null_is_bad: bool = False

    def count(self) -> Column:
        return F.coalesce(F.sum(F.when(F.coalesce(self.bad, F.lit(self.null_is_bad)), 1).otherwise(0)), F.lit(0)).cast("long").alias(self.name)


def in_range(column: str, low: float, high: float, severity: str = "error", null_is_bad: bool = False) -> Rule:
    return Rule(f"{column}_range_{severity}", ~F.col(column).between(low, high), severity, null_is_bad)


def unusual(column: str, low: float, high: float, possible_low: float, possible_high: float) -> Rule:
    """A warning for values that are possible but not plausible; impossible ones are another rule's errors."""
    x = F.col(column)
    return Rule(f"{column}_range_warning", ~x.between(low, high) & x.between(possible_low, possible_high), "warning")


def ordered(left: str, right: str, slack: float = 0.0, severity: str = "error", null_is_bad: bool = False) -> Rule:
    return Rule(f"{left}_le_{right}", F.col(left) > F.col(right) + slack, severity, null_is_bad)


def present(column: str, severity: str = "error") -> Rule:
    return Rule(f"{column}_missing", F.col(column).isNull(), severity)


def check(panel: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, severity and the number of wrong rows, from a single aggregate over the panel."""
    counts = panel.agg(*(r.count() for r in rules))
    pairs = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(r.name).alias("n_bad")) for r in rules))
    return counts.select(F.inline(pairs))


def duplicates(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extra copies (all but the first) by key and by whole row, and rows that share their key with another."""
    by_key = panel.groupBy(*keys).count()
    by_row = panel.groupBy(*panel.columns).count()
    of = lambda df, name: df.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias(name))
    shared = by_key.agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("rows_sharing_key"))
    return of(by_key, "extra_keys").crossJoin(of(by_row, "extra_rows")).crossJoin(shared)  # one row each


def columns_as_expected(columns: Sequence[str], expected: Sequence[str]) -> list[str]:
    """What is wrong with a column list: names out of place, and names of the future that are not expected."""
    out = [] if list(columns) == list(expected) else ["columns differ"]
    return out + [f"unexpected next-day column {c}" for c in columns if "tomorrow" in c.lower() and c not in expected]


def guard_features(columns: Sequence[str], targets: Sequence[str] = ()) -> None:
    """Raise if a feature is a target or is named like the future."""
    bad = [c for c in columns if c in targets or any(x in c.lower() for x in ("tomorrow", "_lead", "_next", "future"))]
    if bad:
        raise ValueError(f"features from the future: {bad}")


def gap(df: DataFrame, a: str, b: str, most: float) -> DataFrame:
    """max_gap, the largest difference of two columns, and n_over, the rows where it is over `most`."""
    d = F.abs(F.col(a) - F.col(b))
    return df.agg(F.max(d).alias("max_gap"), F.count_if(d > most).alias("n_over"))


def unsorted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_unsorted: rows of a table that is read from files whose keys are below those of the row before. Order is that of files and rows in them; partitions are compared by their ends, so no task holds more than its own."""
    own = df.select(F.struct(*keys).alias("_k"), F.monotonically_increasing_id().alias("_at")).withColumn("_part", F.shiftright("_at", 33))
    inside = own.withColumn("_before", F.lag("_k").over(W.partitionBy("_part").orderBy("_at")))
    parts = inside.groupBy("_part").agg(F.count_if(F.col("_k") < F.col("_before")).alias("n"), F.min_by("_k", "_at").alias("a"), F.max_by("_k", "_at").alias("b"))
    ends = parts.withColumn("_last", F.lag("b").over(W.orderBy("_part")))  # a row for each partition
    return ends.agg(F.coalesce(F.sum(F.col("n") + (F.coalesce(F.col("a") < F.col("_last"), F.lit(False))).cast("long")), F.lit(0)).cast("long").alias("n_unsorted"))
