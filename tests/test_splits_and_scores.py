import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import calendar, evaluate, prepare, splits, stats


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def planted(spark):
    """Two cells with a lapse of -0.65 degrees for 100 m between their members and an autoregressive (0.6, 0.25) common series."""
    rng = np.random.default_rng(7)
    n, rows = 1500, []
    for cell, members in ((0, (0, 40, 90)), (1, (10, 60))):
        x = np.zeros(n)
        for t in range(2, n):
            x[t] = 0.6 * x[t - 1] + 0.25 * x[t - 2] + rng.normal()
        for m in members:
            rows += [(f"c{cell}m{m}", day(t), float(30 + x[t] - 0.0065 * m), float(m), cell) for t in range(n)]
    return spark.createDataFrame(rows, "city string, day date, hi double, elevation double, cell int").withColumn("level", F.when(F.col("hi") < 29, "low").otherwise("high")).cache()


def test_splits_are_whole_days_and_lose_no_row(spark, planted):
    own = splits.chronological(planted, splits.nth_day(planted, 0.75), embargo=4)
    n = {r.split: r["count"] for r in own.groupBy("split").count().collect()}
    assert sum(n.values()) == planted.count() and n[None] == 4 * 5
    assert own.where("split is not null").groupBy("day").agg(F.count_distinct("split").alias("s")).where("s > 1").count() == 0


def test_folds_expand_in_time_order(planted):
    folds = splits.expanding(planted, splits=5, gap=4, min_train=730)
    assert len(folds) == 5 and folds[-1].test_to == day(1499)
    for a, b in zip(folds, folds[1:], strict=False):
        assert a.train_before < a.test_from <= a.test_to < b.test_from and b.train_before > a.train_before
        assert (a.test_from - a.train_before).days == 4
    with pytest.raises(ValueError, match="too few"):
        splits.expanding(planted, splits=5, min_train=1499)
    rows = splits.fold_rows(planted, folds).groupBy("fold", "side").count().collect()
    assert len(rows) == 10 and all(r["count"] for r in rows)


def test_planted_structure_comes_back(spark, planted):
    pairs = stats.pairs(planted, "hi", "level")
    same = [r for r in pairs.collect() if r.city_a[:2] == r.city_b[:2]]
    assert len(same) == 4 and all(r.corr > 0.999 for r in same)
    for r in same:
        rise = float(r.city_b[3:]) - float(r.city_a[3:])
        assert 100 * r.mean_d / rise == pytest.approx(-0.65, abs=1e-6)
    got = stats.effective_series(pairs.select("city_a", "city_b", "corr"), 5).first()
    assert 1.8 < got.effective_series < 2.2
    share, n = stats.spectrum(pairs)
    assert 0.5 < share < 0.75 and n == 2
    edges = pairs.where("corr > 0.99").select(F.col("city_a").alias("a"), F.col("city_b").alias("b"))
    roots = {r.node: r.root for r in stats.groups(edges, planted.select(F.col("city").alias("node")).distinct()).collect()}
    assert roots == {"c0m0": "c0m0", "c0m40": "c0m0", "c0m90": "c0m0", "c1m10": "c1m10", "c1m60": "c1m10"}


def test_autoregression_is_found(spark, planted):
    one = planted.where("city = 'c0m0'").select("city", "day", "hi")
    lagged = calendar.with_lags(one, ["hi"], lags=(1, 2, 3, 4), means=())
    got = stats.pacf(lagged, "hi", [f"hi_lag{k}" for k in (1, 2, 3, 4)])
    assert got[0] == pytest.approx(0.8, abs=0.06) and got[1] == pytest.approx(0.25, abs=0.06) and abs(got[2]) < 0.08 and abs(got[3]) < 0.08
    part = stats.partial_correlation(lagged, "hi", "hi_lag2", ["hi_lag1"])
    x = np.array([[r.hi, r.hi_lag1, r.hi_lag2] for r in lagged.dropna().orderBy("day").collect()])
    z = np.column_stack([np.ones(len(x)), x[:, 1]])
    a, b = (x[:, k] - z @ np.linalg.lstsq(z, x[:, k], rcond=None)[0] for k in (0, 2))
    assert part == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=2e-3)
    found = stats.screening(lagged, ["hi_lag1", "hi_lag2"], "hi", ["hi_lag3"])
    assert [f[0] for f in found] == ["hi_lag1", "hi_lag2"] and all(f[4] for f in found)


def scored(spark, pairs, **how):
    rows = spark.createDataFrame(pairs, "y int, p int")
    return evaluate.scores(evaluate.confusion(rows, "y", "p", range(5)), 3, **how).first()


def test_scores_by_hand(spark):
    got = scored(spark, [(0, 0), (0, 0), (0, 1), (1, 1), (1, 2), (3, 3), (3, 3), (3, 3), (3, 0)])
    assert got.accuracy == pytest.approx(6 / 9) and got.focus_recall == 0.75 and got.focus_precision == 1 and got.focus_false_alarm == 0
    f = [2 * 2 / 3 * 2 / 3 / (4 / 3), 0.5, 2 * 0.75 / 1.75]
    assert got.macro_f1 == pytest.approx(sum(f) / 3)
    either = scored(spark, [(0, 0), (0, 0), (0, 1), (1, 1), (1, 2), (3, 3), (3, 3), (3, 3), (3, 0)], present="either")
    assert either.macro_f1 == pytest.approx(sum(f) / 4)
    assert scored(spark, [(0, 0), (2, 2)]).macro_f1 == 1


def test_kappa_and_auc(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1), (4, 4), (4, 1), (0, 1)], "y int, p int")
    got = evaluate.quadratic_kappa(evaluate.confusion(rows, "y", "p", range(5))).first()["kappa"]
    y, p = np.array([0, 1, 2, 2, 0]), np.array([0, 1, 2, 1, 1])  # places in the union of labels 0, 1, 4
    o, w = np.zeros((3, 3)), (np.arange(3)[:, None] - np.arange(3)) ** 2
    np.add.at(o, (y, p), 1)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    assert got == pytest.approx(1 - (w * o).sum() / (w * e).sum())
    s = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1)], "t int, s double")
    assert evaluate.auc(s, F.col("t") == 1, "s").first()["auc"] == pytest.approx((2 + 1.5 + 0.5) / 6)
    assert evaluate.auc(s.where("t = 1"), F.col("t") == 1, "s").first()["auc"] is None


def test_weights(spark):
    got = {r.label: (r.n, r.weight) for r in evaluate.class_weights(spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "y string"), "y").collect()}
    assert got == {"a": (6, pytest.approx(8 / 12)), "b": (2, 2.0)}


def test_preparation_fits_on_training_rows_only(spark):
    train = spark.createDataFrame([("a", 1.0, 0.0), ("b", 3.0, 7.0), ("a", None, 7.0)], "city string, x double, r double")
    prep = prepare.Preparer(["x", "r"], logs=["r"], entity="city").fit(train)
    got = prep.transform(spark.createDataFrame([("a", 2.0, -1.0), ("z", None, 7.0)], "city string, x double, r double")).collect()
    assert prep.medians == {"x": 2.0, "r": 7.0} and got[0].z_x == 0 and got[1].z_x == 0
    assert (got[0].is_a, got[0].is_b) == (1, 0) and (got[1].is_a, got[1].is_b) == (0, 0)
    assert prep.scales["x"] == (2.0, pytest.approx(np.std([1, 3, 2])))
    constant = prepare.Preparer(["x"]).fit(spark.createDataFrame([(5.0,), (5.0,)], "x double"))
    assert constant.scales["x"] == (5.0, 1.0)
    with pytest.raises(ValueError, match="future"):
        prepare.Preparer(["x_next"]).fit(train)


def test_encoding(spark):
    df = spark.createDataFrame([("Danger",), ("Caution",), (None,)], "l string")
    assert [tuple(r) for r in df.select(prepare.encode(F.col("l")), prepare.encode(F.col("l"), "three_class")).collect()] == [(3, 2), (1, 0), (None, None)]
    with pytest.raises(Exception, match="unknown level"):
        spark.createDataFrame([("Balmy",)], "l string").select(prepare.encode(F.col("l"))).collect()


def test_logistic_learns_and_skips_absent_labels(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(rng.normal()), int(0 if x < -0.5 else 3 if x > 0.5 else 1)) for x in rng.normal(size=400)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    predict, model = prepare.logistic(df, ["a", "b"], "y", c=10.0, power=0.25)
    out = predict(df)
    assert out.where("guess = y").count() > 360 and set(r.guess for r in out.select("guess").distinct().collect()) == {0, 1, 3}
    top = prepare.coefficients(model, ["a", "b"], [0, 1, 3])
    assert [t for t in top if t[0] == 3][0][1] == "a"


def test_selection():
    grid = [{"macro_f1": 0.62, "sd": 0.05, "focus_recall": 0.6, "uses_entity": True}, {"macro_f1": 0.6, "sd": 0.05, "focus_recall": 0.61, "uses_entity": False}, {"macro_f1": 0.7, "sd": 0.05, "focus_recall": 0.4, "uses_entity": True}]
    assert prepare.choose(grid, 0.58) is grid[1] and prepare.choose(grid[:1], 0.58) is grid[0]


def test_skewness_is_bias_adjusted(spark):
    x = np.array([1.0, 2, 2, 3, 9])
    n, d = len(x), x - x.mean()
    want = np.sqrt(n * (n - 1)) / (n - 2) * (d**3).mean() / (d**2).mean() ** 1.5
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x double")
    got = stats.outliers(df, ["x"]).first()
    assert got.skewness == pytest.approx(want) and got.median == 2 and got.n_far == 1


def test_elevation_verdicts(spark):
    def verdict(*rows):
        return stats.elevation_verdict(spark.createDataFrame([(float(d), float(x), float(r)) for d, x, r in rows], "mean_abs_d double, level_differs double, rise double")).first().verdict

    assert [verdict(), verdict((9, 1, 0)), verdict((0.6, 0, 5)), verdict((0.1, 0.03, 5)), verdict((0.3, 0, 5)), verdict((0.1, 0.01, 5)), verdict((0.1, 0, 5), (0.1, 0, 0))] == [
        "no shared cell", "no rise", "material", "material", "modest", "modest", "negligible"]


def test_groups_of_long_paths(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [*range(1, 61), 100, 101, 200]], "node long")
    got = {r.node: r.root for r in stats.groups(edges, nodes).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100, 200: 200}


def test_grid_search_runs_nothing_twice():
    ran = []

    def run(own):
        ran.append(own)
        return {"macro_f1": own["c"] + own.get("power", 0.0)}

    best = prepare.search(run, prepare.grid(fs=["a", "b"], c=[0.1, 1.0]), lambda g: [{"fs": g["fs"], "c": g["c"]}, *prepare.grid(fs=[g["fs"]], c=[0.1, 1.0], power=[0.5])])
    assert len(ran) == 6 and best[0] == {"fs": "a", "c": 1.0, "power": 0.5, "macro_f1": 1.5}


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_are_those_of_percentile(spark, parts):
    rng = random.Random(3)
    rows = [(rng.choice([None, -1.0, 0.0, rng.random()]), rng.randrange(5), None, rng.gauss(0, 1) if i % 3 else 2.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, `b c` int, d double, v double").repartition(parts)
    at = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    shares = ", ".join(map(str, at))
    want = df.agg(*(F.expr(f"percentile(`{c}`, array({shares}))").alias(c) for c in df.columns)).first()
    got = stats.quantiles(df, df.columns, at)
    for c in df.columns:
        assert got[c] == ([None] * len(at) if want[c] is None else pytest.approx(want[c], abs=1e-12)), c
    assert stats.quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]} and stats.quantiles(df, [], [0.5]) == {}
    assert stats.outliers(df.limit(0), ["a"]).first()["median"] is None
