import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import calendar


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def panel(spark, rows):
    return spark.createDataFrame([(c, day(k), v) for c, k, v in rows], "city string, day date, x double")


def readings(spark, change=None):
    rows = []
    for d, temp in ((0, lambda h: 20.0 + h), (1, lambda h: 30.0)):
        for h in range(24):
            row = {"city": "a", "day": day(d), "hour": h, "t_c": temp(h), "rh": 60.0, "value": {0: 0.05, 1: 0.1, 2: 0.5, 3: 2.0}.get(h, 0.0) if not d else 0.0}
            rows.append({**row, **(change or {}).get((d, h), {})})
    return spark.createDataFrame(rows, "city string, day date, hour int, t_c double, rh double, value double")


def test_hand_day(spark):
    first, second = calendar.daily(readings(spark)).orderBy("day").collect()
    assert (first.t_min, first.t_max, first.t_mean, first.rain_hours, first.rain_total) == (20, 43, 31.5, 3, 2.65)
    assert second.t_min == second.t_max == 30 and first.hi_next == second.hi and second.hi_next is None and first.level_next == second.level


def test_a_missing_hour_touches_its_variable_only(spark):
    own = calendar.daily(readings(spark, {(0, 3): {"value": None}, (1, 6): {"rh": None}})).orderBy("day").collect()
    assert own[0].rain_total is None and own[0].rain_hours is None and own[0].t_max == 43 and own[0].hi is not None
    assert own[1].rh_mean is None and own[1].hi is None and own[1].t_mean == 30 and own[1].rain_total == 0
    assert calendar.daily(readings(spark, {(1, 6): {"rh": None}}), min_hours=23).orderBy("day").collect()[1].rh_mean == 60


def test_gaps_never_pair_the_wrong_day(spark):
    own = calendar.with_lags(panel(spark, [("a", 0, 1.0), ("a", 1, 2.0), ("a", 3, 4.0), ("a", 4, 8.0), ("a", 5, 16.0), ("b", 2, 7.0)]), ["x"], deltas=["x"])
    got = {(r.city, (r.day - day(0)).days): r for r in own.withColumn("next", calendar.at(F.col("x"), 1)).collect()}
    assert got["a", 1].x_lag1 == 1 and got["a", 3].x_lag1 is None and got["a", 3].x_lag2 == 2 and got["a", 3].x_lag3 == 1
    assert got["a", 5].x_mean3d == pytest.approx(28 / 3) and got["a", 4].x_mean3d is None and got["a", 4].x_change1d == 4
    assert got["a", 1].next is None and got["a", 3].next == 8 and got["b", 2].x_lag1 is None


def test_last_days_go_and_inner_gaps_stay(spark):
    own = calendar.drop_last_day(panel(spark, [("a", 0, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 5, 1.0)]))
    assert sorted((r.city, (r.day - day(0)).days) for r in own.collect()) == [("a", 0), ("a", 2)]


def test_the_future_does_not_change_the_past(spark):
    rng = random.Random(2)
    rows = [(c, k, rng.random()) for c in "ab" for k in range(30) if rng.random() < 0.9]
    cut = 18
    other = [(c, k, v if k <= cut else v * 100 + 1) for c, k, v in rows]
    of = lambda rs: sorted(map(str, calendar.with_lags(panel(spark, rs), ["x"], deltas=["x"]).where(F.col("day") <= F.lit(day(cut))).collect()))
    assert of(rows) == of(other) == of([r for r in rows if r[1] <= cut])


def test_duplicates_are_refused(spark):
    calendar.require_unique(panel(spark, [("a", 0, 1.0), ("a", 1, 1.0)]))
    with pytest.raises(ValueError, match="duplicate"):
        calendar.require_unique(panel(spark, [("a", 0, 1.0), ("a", 0, 2.0)]))


def test_runs_and_missing_days(spark):
    own = panel(spark, [("a", k, 1.0) for k in (0, 1, 2, 5, 8, 9)])
    assert sorted(r.length for r in calendar.runs(own, ["city"]).collect()) == [1, 2, 3]
    assert sorted((r.day - day(0)).days for r in calendar.complete_days(own).collect()) == [3, 4, 6, 7]
    assert calendar.runs(own.limit(0), ["city"]).collect() == []
