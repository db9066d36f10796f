"""From raw hourly payloads to the published daily panel, its checks, and the modelling tables."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.operators import calendar, rules, splits
from tidewheel.sources import archive

#: The panel's columns in order, with role, unit and origin.
DICTIONARY = (
    ("Date", "identifier", "day", "local calendar day"), ("City", "identifier", "", "cleaned name"), ("Latitude", "static", "degrees", "weighted centre"), ("Longitude", "static", "degrees", "weighted centre"),
    ("Elevation", "static", "m", "of the request's answer"), ("Month", "calendar", "1-12", "of Date"), ("DayOfYear", "calendar", "1-366", "of Date"),
    ("Temp_Min", "feature", "deg C", "min temperature_2m"), ("Temp_Mean", "feature", "deg C", "mean temperature_2m"), ("Temp_Max", "feature", "deg C", "max temperature_2m"),
    ("Humidity_Min", "feature", "%", "min relative_humidity_2m"), ("Humidity_Mean", "feature", "%", "mean relative_humidity_2m"), ("Humidity_Max", "feature", "%", "max relative_humidity_2m"),
    ("DewPoint_Mean", "feature", "deg C", "mean dew_point_2m"), ("Pressure_Mean", "feature", "hPa", "mean pressure_msl"), ("CloudCover_Mean", "feature", "%", "mean cloud_cover"),
    ("WindSpeed_Mean", "feature", "km/h", "mean wind_speed_10m"), ("WindSpeed_Max", "feature", "km/h", "max wind_speed_10m"), ("WindGust_Max", "feature", "km/h", "max wind_gusts_10m"),
    ("Rainfall_Total", "feature", "mm", "sum rain"), ("RainHours", "feature", "h", "hours with rain >= 0.1"), ("SolarRadiation_Total", "feature", "Wh/m2", "sum shortwave_radiation"),
    ("HeatIndex_Max_Today", "feature", "deg C", "max hourly heat index"), ("HeatLevelToday", "feature", "level", "of HeatIndex_Max_Today"),
    ("HeatIndex_Max_Tomorrow", "target", "deg C", "HeatIndex_Max_Today of the next day"), ("HeatLevelTomorrow", "target", "level", "of HeatIndex_Max_Tomorrow"),
)
COLUMNS = tuple(c for c, *_ in DICTIONARY)
AGGREGATES = tuple((c, *origin.split(" ", 1)) for c, _, _, origin in DICTIONARY if origin.split(" ", 1)[-1] in archive.VARIABLES)
#: Possible and plausible ranges.
POSSIBLE = {
    "Latitude": (4, 22), "Longitude": (116, 128), "Elevation": (-100, 3500), "Month": (1, 12), "DayOfYear": (1, 366), "Temp_Min": (0, 50), "Temp_Mean": (0, 50), "Temp_Max": (0, 50),
    "Humidity_Min": (0, 100), "Humidity_Mean": (0, 100), "Humidity_Max": (0, 100), "DewPoint_Mean": (-5, 40), "Pressure_Mean": (870, 1090), "CloudCover_Mean": (0, 100), "WindSpeed_Mean": (0, 400),
    "WindSpeed_Max": (0, 400), "WindGust_Max": (0, 500), "Rainfall_Total": (0, 1200), "RainHours": (0, 24), "SolarRadiation_Total": (0, 12000), "HeatIndex_Max_Today": (10, 80), "HeatIndex_Max_Tomorrow": (10, 80),
}
USUAL = {"Temp_Max": (15, 42.5), "Pressure_Mean": (950, 1040), "Rainfall_Total": (0, 500), "HeatIndex_Max_Today": (15, 65), "HeatIndex_Max_Tomorrow": (15, 65), "Elevation": (0, 3000), "SolarRadiation_Total": (0, 10000)}
#: Ranges and orders that modelling data must keep, null failing too.
PREPARED = {
    "Temp_Min": (10, 45), "Temp_Mean": (10, 45), "Temp_Max": (10, 45), "Humidity_Min": (0, 100), "Humidity_Mean": (0, 100), "Humidity_Max": (0, 100), "DewPoint_Mean": (0, 40), "Pressure_Mean": (950, 1050), "CloudCover_Mean": (0, 100),
    "WindSpeed_Mean": (0, 200), "WindSpeed_Max": (0, 200), "WindGust_Max": (0, 300), "Rainfall_Total": (0, 1000), "RainHours": (0, 24), "SolarRadiation_Total": (0, 12000), "HeatIndex_Max_Today": (10, 70), "HeatIndex_Max_Tomorrow": (10, 70),
}
ORDERS = (("Temp_Min", "Temp_Mean"), ("Temp_Mean", "Temp_Max"), ("Humidity_Min", "Humidity_Mean"), ("Humidity_Mean", "Humidity_Max"), ("WindSpeed_Mean", "WindSpeed_Max"), ("WindSpeed_Max", "WindGust_Max"), ("DewPoint_Mean", "Temp_Max"))


def daily(hours: DataFrame, need: int = 24, rain_from: float = 0.1) -> DataFrame:
    """Days of archive.hours() rows: each aggregate null unless `need` hours of its own variable are there, each once, rounded before anything is derived; helper columns start with _."""
    rows = hours.withColumn("_hi", S.heat_index(F.col("temperature_2m"), F.col("relative_humidity_2m")))
    by = {"min": F.min, "mean": F.avg, "max": F.max, "sum": F.sum}
    seen = lambda of: F.bit_count(F.bit_or(F.when(F.col(of).isNotNull(), F.expr("shiftleft(1, hour)"))))
    # an hour that comes twice makes the day incomplete: its sums would count it twice
    gate = lambda v, of: F.when((seen(of) >= need) & (F.count(of) == seen(of)), v)
    cells = [gate(S.half_even(by[f](v), 1 if c == "SolarRadiation_Total" else 2), v).alias(c) for c, f, v in AGGREGATES]
    return rows.groupBy("city", "day").agg(
        *cells, gate(F.count_if(F.col("rain") >= rain_from), "rain").alias("RainHours"), gate(S.half_even(F.max("_hi")), "_hi").alias("HeatIndex_Max_Today"),
        F.least(*(F.coalesce(seen(v), F.lit(0)) for v in archive.VARIABLES)).alias("_HoursMin"), gate(S.half_even(F.sum("precipitation")), "precipitation").alias("_PrecipTotal"),
    )


def panel(days: DataFrame, cities: DataFrame, most_missing: float = 0.005) -> DataFrame:
    """The panel: complete days with places (city, latitude, longitude, elevation), calendar and next-day targets, without each city's last day. Raises if more than `most_missing` of the days are incomplete."""
    features = [c for c, role, *_ in DICTIONARY if role == "feature" and c != "HeatLevelToday"]
    whole = F.lit(True)
    for c in features:
        whole = whole & F.col(c).isNotNull()
    got = days.agg(F.count("*").alias("n"), F.count_if(~whole).alias("bad")).first()
    if got["n"] and got["bad"] / got["n"] > most_missing:
        raise ValueError(f"{got['bad']} of {got['n']} days are incomplete")
    own = calendar.with_targets(days.where(whole), "HeatIndex_Max_Today")
    own = calendar.drop_last_day(own).join(cities.select("city", "latitude", "longitude", "elevation"), "city")
    names = {"day": "Date", "city": "City", "latitude": "Latitude", "longitude": "Longitude", "elevation": "Elevation", "level": "HeatLevelToday", "hi_next": "HeatIndex_Max_Tomorrow", "level_next": "HeatLevelTomorrow"}
    own = own.withColumnsRenamed(names).withColumns({"Month": F.month("Date"), "DayOfYear": F.dayofyear("Date")})
    return own.select(*COLUMNS).orderBy("City", "Date")


def rain_gap(days: DataFrame, most: float = 0.5) -> DataFrame:
    """How far daily() days' precipitation is from their rain: the largest difference, and days over `most`."""
    return rules.gap(days, "_PrecipTotal", "Rainfall_Total", most)


def rule_set() -> list[rules.Rule]:
    """The published panel's rules: ranges, orders and calendar, each with its severity and what null means to it."""
    slack = lambda a, b, by, **how: rules.ordered(a, b, by, **how)
    out = [rules.present(c) for c in COLUMNS]
    out += [rules.in_range(c, lo, hi) for c, (lo, hi) in POSSIBLE.items()] + [rules.unusual(c, *USUAL[c], *POSSIBLE[c]) for c in USUAL]
    out += [rules.ordered(a, b, null_is_bad=True) for a, b in ORDERS[:4]]
    out += [rules.ordered("WindSpeed_Mean", "WindSpeed_Max"), slack("DewPoint_Mean", "Temp_Mean", 0.1), rules.ordered("WindSpeed_Max", "WindGust_Max", 0.01, "warning")]
    out += [rules.Rule("Month_of_Date", F.col("Month") != F.month("Date")), rules.Rule("DayOfYear_of_Date", F.col("DayOfYear") != F.dayofyear("Date"))]
    out += [rules.Rule("RainHours_whole", F.col("RainHours") != F.rint(F.col("RainHours").cast("double"))), rules.Rule("rain_hours_need_rain", (F.col("RainHours") > 0) & (F.col("Rainfall_Total") < 0.1 - 1e-9))]
    for level, value in (("HeatLevelToday", "HeatIndex_Max_Today"), ("HeatLevelTomorrow", "HeatIndex_Max_Tomorrow")):
        out += [rules.Rule(f"{level}_derived", ~S.heat_level(F.col(value)).eqNullSafe(F.col(level))), rules.Rule(f"{level}_known", ~F.col(level).isin(*S.LEVELS))]
    return out


def prepared_rules() -> list[rules.Rule]:
    """What modelling data must keep; null in a ranged column is a fault."""
    return [rules.in_range(c, lo, hi, null_is_bad=True) for c, (lo, hi) in PREPARED.items()] + [rules.ordered(a, b, 1e-9) for a, b in ORDERS]


def validated(own: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """rule, severity, n_bad of every check of a panel whose days should run from `first` to `last`: the row rules in one pass, then keys, extent, gaps, and targets by window and by join."""
    rows = own.withColumnsRenamed({"City": "city", "Date": "day"})
    after = rows.select("city", F.date_sub("day", 1).alias("day"), F.col("HeatIndex_Max_Today").alias("_joined"))
    linked = calendar.steps(rows).withColumn("_window", calendar.at(F.col("HeatIndex_Max_Today"), 1)).join(after, ["city", "day"], "left")
    target = F.col("HeatIndex_Max_Tomorrow")
    one = lambda name, bad, severity="error": F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.count_if(bad).alias("n_bad"))
    pairs = linked.agg(F.array(one("steps_of_one_day", F.col("step") != 1), one("target_by_window", F.col("_window").isNotNull() & (F.col("_window") != target)), one("target_by_join", F.col("_joined").isNotNull() & (F.col("_joined") != target))).alias("x")).select(F.inline("x"))
    span = (last - first).days + 1
    extent = rows.groupBy("city").agg(F.count("*").alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    ends = extent.agg(F.array(one("rows_by_city", F.col("n") != span), one("first_day", F.col("a") != F.lit(first)), one("last_day", F.col("b") != F.lit(last))).alias("x")).select(F.inline("x"))
    # each city's last day is the one row that no row follows
    alone = calendar.without_following(rows).agg(F.array(one("rows_without_following", F.col("n") != 1, "warning")).alias("x")).select(F.inline("x"))
    order = rules.unsorted(own, ["City", "Date"]).select(F.lit("unsorted").alias("rule"), F.lit("error").alias("severity"), F.col("n_unsorted").alias("n_bad"))
    copies = rules.duplicates(own, ["City", "Date"])
    keys = copies.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit("error").alias("severity"), F.col(c).cast("long").alias("n_bad")) for n, c in (("duplicate_keys", "extra_keys"), ("duplicate_rows", "extra_rows"))))))
    return rules.check(own, rule_set()).unionByName(pairs).unionByName(ends).unionByName(keys).unionByName(alone).unionByName(order)


def faults(own: DataFrame, first: dt.date, last: dt.date) -> list[str]:
    """What a panel has against it, as archive.publish() wants it."""
    out = rules.columns_as_expected(own.columns, COLUMNS)
    return out or [f"{r['rule']}: {r['n_bad']}" for r in validated(own, first, last).where("severity = 'error' AND n_bad > 0").collect()]


def split_definition(own: DataFrame, test_from: dt.date, gap: int, folds: list[splits.Fold]) -> str:
    """The split as JSON: bounds, gap, rows and folds."""
    rows = own.groupBy(splits.side(F.lit(test_from), gap).alias("side")).count().collect()
    counts = {r["side"] or "gap": r["count"] for r in rows}
    return json.dumps({"test_from": test_from.isoformat(), "gap_days": gap, "rows": counts, "folds": [{"fold": f.number, "train_before": f.train_before.isoformat(), "test_from": f.test_from.isoformat(), "test_to": f.test_to.isoformat()} for f in folds]}, indent=2, sort_keys=True)


def prepared(own: DataFrame, lags: tuple[str, ...], deltas: tuple[str, ...] = (), share: float = 0.8, gap: int = 4, min_train: int = 730) -> tuple[DataFrame, dt.date, list[splits.Fold]]:
    """Modelling rows: lags added, rows without history gone, `split` set by the day at `share` of all days, folds over the training days. Raises where prepared_rules() fail."""
    calendar.require_unique(own, ("City", "Date"))
    bad = rules.check(own, prepared_rules()).where("n_bad > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['n_bad']}" for r in bad))
    rows = own.withColumnsRenamed({"City": "city", "Date": "day"})
    start = splits.nth_day(rows, share, rounded=True)
    names = calendar.lag_names(lags, deltas=deltas)
    ready = splits.require_sides(splits.chronological(calendar.with_lags(rows, lags, deltas=deltas).dropna(subset=names), start, gap))
    return ready, start, splits.expanding(ready.where("split = 'train'"), gap=gap, min_train=min_train)


#: The weather columns that stay when collinear ones go.
PRUNED = ("HeatIndex_Max_Today", "Temp_Min", "SolarRadiation_Total", "WindSpeed_Mean", "Pressure_Mean", "CloudCover_Mean", "Rainfall_Total")
WEATHER = {"full": tuple(c for c, role, *_ in DICTIONARY if role == "feature" and c != "HeatLevelToday"), "lr_pruned": PRUNED}
STATIC = {"city": ("City",), "coords": ("Latitude", "Longitude", "Elevation"), "none": ()}


def feature_columns(feature_set: str = "today", static: str = "city", weather: str = "full", level_today: bool = False, lags: tuple[str, ...] = ()) -> list[str]:
    """Columns that a model reads: a named weather set; no lags (`today`), those of the heat index (`hi_lags`) or all of `lags` whose source is in the set (`all_lags`); today's level as a code; the season; and how a place is told (`city`, `coords` or `none`). Raises on an unknown name."""
    sets = {"today": (), "hi_lags": tuple(f"HeatIndex_Max_Today_lag{k}" for k in (1, 2, 3)), "all_lags": lags}
    for name, given, known in (("feature set", feature_set, sets), ("static option", static, STATIC), ("weather set", weather, WEATHER)):
        if given not in known:
            raise ValueError(f"unknown {name} {given!r}: one of {sorted(known)}")
    own = WEATHER[weather]
    history = [c for c in sets[feature_set] if any(c.startswith(f"{w}_") for w in own)]
    out = [*own, *history, *(["HeatLevelToday_Code"] if level_today else []), "DayOfYear", *STATIC[static]]
    rules.guard_features(out)
    return out


def prepared_facts(before: DataFrame, ready: DataFrame, level: str = "Not Hazardous") -> DataFrame:
    """One row about prepared(): rows in, dropped for want of history, in the gap, training and test rows; days before a day of `level`, and the last such day (the day after its row)."""
    side = lambda s: F.count_if(F.col("split").eqNullSafe(s))
    hit = F.col("HeatLevelTomorrow") == level
    own = ready.agg(F.count("*").alias("n"), side(None).alias("gap_rows"), side("train").alias("train"), side("test").alias("test"), F.count_distinct(F.when(hit, F.col("day"))).alias("level_days"), F.date_add(F.max(F.when(hit, F.col("day"))), 1).alias("last_level_day"))
    return before.agg(F.count("*").alias("rows_in")).crossJoin(own).select("rows_in", (F.col("rows_in") - F.col("n")).alias("dropped"), "gap_rows", "train", "test", "level_days", "last_level_day")  # one row each


def documentation(own: DataFrame, first: dt.date, last: dt.date) -> str:
    """The published panel in Markdown: its size and span, the columns with role, unit, origin and allowed values, levels, and every check with its result."""
    from tidewheel.operators import report

    allowed = lambda c: f"{POSSIBLE[c][0]} to {POSSIBLE[c][1]}" if c in POSSIBLE else ", ".join(S.LEVELS) if c.startswith("HeatLevel") else ""
    size = own.agg(F.count("*").alias("rows"), F.count_distinct("City").alias("cities"), F.min("Date").alias("first"), F.max("Date").alias("last"))
    return report.sections("Panel", {
        "Size": size,
        "Columns": report.table([(*d, allowed(d[0])) for d in DICTIONARY], ["column", "role", "unit", "origin", "allowed"]),
        "Levels": own.groupBy(F.col("HeatLevelTomorrow").alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows")),
        "Checks": validated(own, first, last).orderBy("severity", "rule"),
    })


def preparation_report(before: DataFrame, ready: DataFrame, start: dt.date, gap: int, folds: list[splits.Fold]) -> str:
    """prepared() in Markdown: facts, split, folds and the levels of each side."""
    from tidewheel.operators import report

    return report.sections("Preparation", {
        "Facts": prepared_facts(before, ready),
        "Split": f"Test from {start}, {gap} days before it on neither side.",
        "Folds": report.table([(f.number, f.train_before, f.test_from, f.test_to) for f in folds], ["fold", "train before", "test from", "test to"]),
        "Levels": ready.where("split is not null").groupBy("split", "HeatLevelTomorrow").count().orderBy("split", "HeatLevelTomorrow"),
    })
