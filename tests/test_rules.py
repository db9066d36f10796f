import datetime as dt

import pytest

from tidewheel.operators import rules

CLEAN = [("a", dt.date(2024, 1, d), 20.0 + d, 25.0 + d, 50.0) for d in range(1, 11)]
SCHEMA = "city string, day date, low double, high double, rh double"

def rule_set():
    return [rules.in_range("rh", 0, 100), rules.in_range("rh", 20, 80, "warning", True), rules.ordered("low", "high"), rules.present("rh")]


def broken(k, **change):
    names = ("city", "day", "low", "high", "rh")
    rows = [dict(zip(names, r, strict=True)) for r in CLEAN]
    rows[k] |= change
    return [tuple(r[n] for n in names) for r in rows]


def counts(spark, rows, own=None):
    return {(r.rule, r.severity): r.n_bad for r in rules.check(spark.createDataFrame(rows, SCHEMA), own or rule_set()).collect()}


def test_clean_data_pass(spark):
    assert set(counts(spark, CLEAN).values()) == {0} and set(counts(spark, []).values()) == {0}


@pytest.mark.parametrize(("change", "rule"), [({"rh": 130.0}, "rh_range_error"), ({"rh": 90.0}, "rh_range_warning"), ({"low": 99.0}, "low_le_high"), ({"rh": None}, "rh_missing")])
def test_mutations_are_caught(spark, change, rule):
    got = counts(spark, broken(3, **change))
    assert {n for (n, _), c in got.items() if c} >= {rule}


def test_null_policy(spark):
    got = counts(spark, broken(3, rh=None, low=None), rule_set()[:3])
    assert got["rh_range_error", "error"] == 0 and got["rh_range_warning", "warning"] == 1 and got["low_le_high", "error"] == 0
    assert counts(spark, broken(3, low=None), [rules.ordered("low", "high", null_is_bad=True)])["low_le_high", "error"] == 1


def test_duplicates(spark):
    df = spark.createDataFrame([*CLEAN, CLEAN[0], ("a", CLEAN[1][1], 0.0, 0.0, 0.0)], SCHEMA)
    assert tuple(rules.duplicates(df, ["city", "day"]).first()) == (2, 1, 4)
    assert tuple(rules.duplicates(df.limit(0), ["city", "day"]).first()) == (0, 0, 0)


def test_one_pass(spark):
    plan = rules.check(spark.createDataFrame(CLEAN, SCHEMA), rule_set())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_names(spark):
    rules.guard_features(["Temp_Max", "x_lag1"])
    for bad in ("HeatTomorrow", "x_next", "a_lead", "futureX", "y"):
        with pytest.raises(ValueError, match="future"):
            rules.guard_features(["ok", bad], targets=["y"])
    assert rules.columns_as_expected(["a", "b"], ["a", "b"]) == []
    assert len(rules.columns_as_expected(["b", "a", "ZTomorrow"], ["a", "b"])) == 2
