"""Preprocessing fitted on training rows only, and multinomial logistic regression over given folds."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.operators import evaluate, stats
from tidewheel.operators.rules import guard_features
from tidewheel.operators.splits import Fold

#: Policies from level to code.
POLICIES = {"five_class": (0, 1, 2, 3, 4), "three_class": (0, 0, 1, 2, 2)}


def encode(level: Column, policy: str = "five_class") -> Column:
    """The code of a level under a policy; raises on a level that is not null and unknown."""
    code = F.get(F.array(*map(F.lit, POLICIES[policy])), S.level_code(level))
    return F.when(level.isNotNull() & code.isNull(), F.raise_error(F.concat(F.lit("unknown level "), level)).cast("int")).otherwise(code)


@dataclass
class Preparer:
    """Median, then standard score with the population deviation (1 if zero), logs before it for `logs`; one-hot for `entity` (unknown: all zeros)."""

    numeric: Sequence[str]
    logs: Sequence[str] = ()
    entity: str | None = None
    medians: dict[str, float] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)

    def _filled(self, c: str) -> Column:
        x = F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]))
        return S.log1p_of(x) if c in self.logs else x

    def fit(self, train: DataFrame) -> Preparer:
        guard_features([*self.numeric])
        self.medians = {c: float(own[0] or 0.0) for c, own in stats.quantiles(train, self.numeric, [0.5]).items()}
        cells = [x for c in self.numeric for x in (F.avg(self._filled(c)).alias(f"m_{c}"), F.stddev_pop(self._filled(c)).alias(f"s_{c}"))]
        row = train.agg(*cells).first()
        self.scales = {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0) or 1.0) for c in self.numeric}
        if self.entity:
            self.names = sorted(r[0] for r in train.select(self.entity).where(F.col(self.entity).isNotNull()).distinct().collect())
        return self

    def outputs(self) -> list[str]:
        return [f"z_{c}" for c in self.numeric] + [f"is_{n}" for n in self.names]

    def transform(self, rows: DataFrame) -> DataFrame:
        out = {f"z_{c}": (self._filled(c) - self.scales[c][0]) / self.scales[c][1] for c in self.numeric}
        out |= {f"is_{n}": (F.coalesce(F.col(self.entity), F.lit("")) == n).cast("double") for n in self.names}
        return rows.withColumns(out)


def logistic(train: DataFrame, features: Sequence[str], label: str, c: float = 1.0, power: float = 0.0, iterations: int = 100):
    """Multinomial logistic regression with squared penalty of inverse strength c and class weights to `power`. Labels absent from training are left out: a function from rows to rows with `guess` and `probability` by label."""
    weights = evaluate.class_weights(train, label, power).orderBy("label").collect()
    codes = {r["label"]: i for i, r in enumerate(weights)}
    pick = lambda values: F.element_at(F.create_map(*(F.lit(x) for r, v in zip(weights, values, strict=True) for x in (r["label"], v))), F.col(label))
    rows = train.withColumn("_y", pick([float(i) for i in range(len(weights))])).withColumn("_w", pick([float(r["weight"]) for r in weights]))
    total = sum(r["n"] * r["weight"] for r in weights)
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-6)
    model = fit.fit(assembler.transform(rows))
    back = F.create_map(*(F.lit(x) for v, i in codes.items() for x in (float(i), int(v))))

    def predict(df: DataFrame) -> DataFrame:
        p = vector_to_array("probability")
        by = F.map_from_arrays(F.array(*(F.lit(int(v)) for v in codes)), p)
        out = model.transform(assembler.transform(df))
        return out.withColumn("guess", F.element_at(back, F.col("prediction"))).withColumn("probabilities", by).drop("_x", "rawPrediction", "probability", "prediction")

    return predict, model


def cross_validate(panel: DataFrame, folds: Sequence[Fold], preparer, label: str, c: float = 1.0, power: float = 0.0, labels: Sequence[int] = range(5), focus: int = 3) -> DataFrame:
    """A row of scores for each fold; preparer() gives a fresh Preparer, fitted to the fold's training rows."""
    out = None
    for f in folds:
        train = panel.where(F.col("day") < F.lit(f.train_before)).persist()
        test = panel.where(F.col("day").between(F.lit(f.test_from), F.lit(f.test_to)))
        prep = preparer().fit(train)
        predict, _ = logistic(prep.transform(train), prep.outputs(), label, c, power)
        train.unpersist()  # scores read the test rows and the fitted model only
        cells = evaluate.confusion(predict(prep.transform(test)), label, "guess", labels)
        one = evaluate.scores(cells, focus).crossJoin(evaluate.quadratic_kappa(cells)).withColumn("fold", F.lit(f.number))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def out_of_fold(panel: DataFrame, folds: Sequence[Fold], preparer, label: str, c: float = 1.0, power: float = 0.0) -> DataFrame:
    """Each fold's test rows with `guess`, `probabilities` and `fold`, predicted by a model of that fold's training rows."""
    out = None
    for f in folds:
        train = panel.where(F.col("day") < F.lit(f.train_before)).persist()
        prep = preparer().fit(train)
        predict, _ = logistic(prep.transform(train), prep.outputs(), label, c, power)
        train.unpersist()
        one = predict(prep.transform(panel.where(F.col("day").between(F.lit(f.test_from), F.lit(f.test_to))))).withColumn("fold", F.lit(f.number))
        out = one if out is None else out.unionByName(one)
    return out


def search(run, first: Sequence[dict], second) -> list[dict]:
    """Grid search in two stages: run(configuration) gives a dict of scores with macro_f1; second(best of the first stage) gives the configurations of the next. No configuration runs twice. The best first."""
    done: dict[str, dict] = {}

    def each(grid: Sequence[dict]) -> list[dict]:
        for own in grid:
            key = repr(sorted(own.items()))
            if key not in done:
                done[key] = own | run(own)
        return sorted(done.values(), key=lambda g: -g["macro_f1"])

    return each(second(each(first)[0]))


def grid(**choices: Sequence) -> list[dict]:
    """Every combination of the choices."""
    return [dict(zip(choices, own, strict=True)) for own in product(*choices.values())]


def save(model, config: dict, path: str, spark) -> None:
    """A fitted model and, beside it, what it was fitted with."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def choose(grid: Sequence[dict], least_recall: float) -> dict:
    """Of configurations (dicts with macro_f1, sd, focus_recall, uses_entity) the best macro-F1 among those with enough recall; one without the entity if that is within one standard deviation."""
    fit = [g for g in grid if g["focus_recall"] >= least_recall] or list(grid)
    best = max(fit, key=lambda g: g["macro_f1"])
    plain = [g for g in fit if not g["uses_entity"] and g["macro_f1"] >= best["macro_f1"] - best["sd"]]
    return max(plain, key=lambda g: g["macro_f1"]) if best["uses_entity"] and plain else best


def coefficients(model, features: Sequence[str], labels: Sequence[int]) -> list[tuple[int, str, float]]:
    """(label, feature, coefficient), the largest first within a label."""
    matrix = model.coefficientMatrix.toArray()
    return sorted(((int(v), f, float(matrix[i, j])) for i, v in enumerate(labels) for j, f in enumerate(features)), key=lambda x: (x[0], -abs(x[2])))
