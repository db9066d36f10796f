"""Scores of classifiers from counts of (truth, prediction) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str, guess: str, labels: Sequence[int]) -> DataFrame:
    """truth, guess, n over the whole grid of labels, zeros included, and share: n among the truth's rows."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(t, p) for t in labels for p in labels], "truth int, guess int")
    counts = rows.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(F.col(truth).cast("int").alias("truth"), F.col(guess).cast("int").alias("guess")).agg(F.count("*").alias("n"))
    own = grid.join(counts, ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = F.sum("n").over(W.partitionBy("truth"))
    return own.withColumn("share", F.when(total > 0, F.col("n") / total))


def per_class(cells: DataFrame) -> DataFrame:
    """label, precision, recall, f1 (0 where undefined), support and predicted of each label of a confusion()."""
    rows = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("hit"))
    cols = cells.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("predicted"))
    p = F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    both = rows.join(cols, "label").select("label", p.alias("precision"), r.alias("recall"), "support", "predicted", "hit")
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def scores(cells: DataFrame, focus: int, present: str = "truth") -> DataFrame:
    """One row of scores. Averages run over labels that occur in the truth, or (present='either') in truth or prediction."""
    own = per_class(cells)
    in_truth = F.col("support") > 0
    there = in_truth if present == "truth" else in_truth | (F.col("predicted") > 0)
    mean = lambda c, where=there: F.avg(F.when(where, F.col(c)))
    total = F.sum("support")
    at = lambda c: F.max(F.when(F.col("label") == focus, F.col(c)))
    alarms = F.try_divide(at("predicted") - at("hit"), total - at("support"))
    return own.agg(
        mean("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"), F.try_divide(F.sum("hit"), total).alias("accuracy"),
        mean("recall", in_truth).alias("balanced_accuracy"), mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"),
        at("precision").alias("focus_precision"), at("recall").alias("focus_recall"), at("f1").alias("focus_f1"), alarms.alias("focus_false_alarm"),
    )


def quadratic_kappa(cells: DataFrame) -> DataFrame:
    """Cohen's kappa with squared weights between the places of labels among those that occur."""
    used = cells.where("n > 0")
    labels = used.select(F.col("truth").alias("label")).union(used.select("guess")).distinct()
    place = labels.withColumn("k", F.row_number().over(W.orderBy("label")))  # as many rows as labels
    rows = used.groupBy("truth").agg(F.sum("n").alias("rn"))
    cols = used.groupBy("guess").agg(F.sum("n").alias("cn"))
    grid = rows.crossJoin(cols)  # labels by labels
    full = grid.join(used.select("truth", "guess", "n"), ["truth", "guess"], "left").join(place.select(F.col("label").alias("truth"), F.col("k").alias("i")), "truth").join(place.select(F.col("label").alias("guess"), F.col("k").alias("j")), "guess")
    w = F.pow(F.col("i") - F.col("j"), 2)
    observed, expected = F.sum(w * F.coalesce("n", F.lit(0))), F.sum(w * F.col("rn") * F.col("cn"))
    return full.agg((1 - F.try_divide(observed * F.sum("n"), expected)).alias("kappa"))


def auc(rows: DataFrame, truth: Column, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve of `score` for the boolean `truth`, by Mann-Whitney with mid-ranks over distinct scores; null without both kinds. Rows are first counted by score."""
    pos = truth.cast("long")
    counts = rows.groupBy(*by, score).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    below = F.sum("n").over(W.partitionBy(*by).orderBy(score)) - F.col("n")
    return counts.withColumn("below", below).groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def over_folds(per_fold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, mean and sample standard deviation over folds."""
    long = per_fold.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))))
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def class_weights(rows: DataFrame, label: str, power: float = 1.0, cap: float | None = None) -> DataFrame:
    """label, n and its balanced weight (rows / (labels * n)) ** power, at most `cap`."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    w = F.pow(F.col("total") / (F.col("k") * F.col("n")), power)
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.least(w, F.lit(cap)) if cap else w).alias("weight"))  # one row
