import datetime as dt
import hashlib
import io
import json
import math
import urllib.error
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewheel import __main__ as cli
from tidewheel.operators import report, splits
from tidewheel.plans import build
from tidewheel.sources import archive, reference

FIRST, DAYS = dt.date(2024, 1, 1), 40


def payload(lat, lon, warm):
    times, cols = [], {v: [] for v in archive.VARIABLES}
    for h in range(24 * DAYS):
        t = 26 + warm + 5 * math.sin(2 * math.pi * ((h % 24) - 8) / 24) + math.sin(h / 100)
        times.append((dt.datetime.combine(FIRST, dt.time()) + dt.timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M"))
        rain = 0.4 if h % 24 in (3, 4) and h // 24 % 3 == 0 else 0.0
        for v, x in zip(archive.VARIABLES, (t, 70 + 5 * math.cos(h / 50), t - 5, 1010.0, 40.0, rain, rain, max(0.0, 400 * math.sin(2 * math.pi * ((h % 24) - 6) / 24)), 10 + h % 5, 20.0 + h % 5), strict=True):
            cols[v].append(round(x, 1))
    return {"latitude": lat, "longitude": lon, "elevation": 5.0, "timezone": "Asia/Manila", "utc_offset_seconds": 28800, "hourly": {"time": times} | cols}


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("raw")
    (path / "raw").mkdir()
    for city, x in (("North", (14.5, 121.0, 0)), ("South", (10.0, 124.0, 3))):
        archive.keep_raw(spark, archive.piece_path(f"file://{path}/raw", "k1", city, FIRST, FIRST + dt.timedelta(days=DAYS - 1)), payload(*x))
    (path / "cities.csv").write_text("city,latitude,longitude,elevation\nNorth,14.52,121.01,20\nSouth,10.1,124.0,5\n")
    return path


@pytest.fixture(scope="module")
def own(spark, inputs):
    args = ["build", "--raw", str(inputs / "raw"), "--cities", str(inputs / "cities.csv"), "--panel", str(inputs / "panel"), "--first", "2024-01-01", "--last", "2024-02-08"]
    assert cli.main(args) == 0
    return spark.read.parquet(str(inputs / "panel")).cache()


def test_panel(own):
    assert tuple(own.columns) == build.COLUMNS and own.count() == 2 * (DAYS - 1)
    r = own.where("City = 'North'").orderBy("Date").first()
    p = payload(14.5, 121.0, 0)["hourly"]
    day = p["temperature_2m"][:24]
    assert (r.Temp_Min, r.Temp_Max) == (min(day), max(day)) and r.Temp_Mean == pytest.approx(sum(day) / 24, abs=0.006)
    assert r.RainHours == 2 and r.Rainfall_Total == 0.8 and r.Elevation == 20 and (r.Month, r.DayOfYear) == (1, 1)
    second = own.where("City = 'North'").orderBy("Date").collect()[1]
    assert r.HeatIndex_Max_Tomorrow == second.HeatIndex_Max_Today and r.HeatLevelTomorrow == second.HeatLevelToday


def faults(df):
    return {x.split(":")[0] for x in build.faults(df, FIRST, dt.date(2024, 2, 8))}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        (lambda d, one: d.withColumn("Temp_Max", F.when(~one, F.col("Temp_Max"))), {"Temp_Max_missing"}),
        (lambda d, one: d.unionByName(d.where(one)), {"duplicate_keys", "duplicate_rows", "rows_by_city"}),
        (lambda d, one: d.where(~one), {"rows_by_city", "steps_of_one_day"}),
        (lambda d, one: d.withColumn("Humidity_Max", F.when(one, 130.0).otherwise(F.col("Humidity_Max"))), {"Humidity_Max_range_error"}),
        (lambda d, one: d.withColumn("Rainfall_Total", F.when(one, -1.0).otherwise(F.col("Rainfall_Total"))), {"Rainfall_Total_range_error"}),
        (lambda d, one: d.withColumn("Temp_Min", F.when(one, 49.0).otherwise(F.col("Temp_Min"))), {"Temp_Min_le_Temp_Mean"}),
        (lambda d, one: d.withColumn("HeatIndex_Max_Tomorrow", F.when(one, F.col("HeatIndex_Max_Tomorrow") + 0.01).otherwise(F.col("HeatIndex_Max_Tomorrow"))), {"target_by_window", "target_by_join"}),
        (lambda d, one: d.withColumn("HeatLevelToday", F.when(one, "Balmy").otherwise(F.col("HeatLevelToday"))), {"HeatLevelToday_derived", "HeatLevelToday_known"}),
        (lambda d, one: d.withColumn("Month", F.when(one, 7).otherwise(F.col("Month"))), {"Month_of_Date"}),
    ],
)
def test_mutations_are_caught(own, change, want):
    assert faults(own) == set()
    one = (F.col("City") == "South") & (F.col("Date") == F.lit(dt.date(2024, 1, 15)))
    assert want <= faults(change(own, one))


def test_columns_are_checked(own):
    assert faults(own.withColumn("x_tomorrow", F.lit(1))) and faults(own.drop("Month"))


def test_incomplete_days_stop_the_build(spark, own):
    hours = spark.createDataFrame([("a", FIRST, h, *[20.0] * 10) for h in range(23)], "city string, day date, hour int, " + ", ".join(f"{v} double" for v in archive.VARIABLES))
    days = build.daily(hours)
    assert days.first().Temp_Max is None and days.first()._HoursMin == 23
    with pytest.raises(ValueError, match="incomplete"):
        build.panel(days, spark.createDataFrame([("a", 14.0, 121.0, 1.0)], "city string, latitude double, longitude double, elevation double"))


def test_commands(spark, inputs, own, tmp_path):
    panel = str(inputs / "panel")
    assert cli.main(["validate", "--panel", panel, "--first", "2024-01-01", "--last", "2024-02-08"]) == 0
    assert cli.main(["validate", "--panel", panel, "--first", "2024-01-02", "--last", "2024-02-08"]) == 1
    assert cli.main(["validate", "--panel", str(tmp_path / "none"), "--first", "2024-01-02", "--last", "2024-02-08"]) == 2
    assert cli.main(["analyse", "--panel", panel, "--out", str(tmp_path / "report.md")]) == 0
    text = (tmp_path / "report.md").read_text()
    assert "## Pairs" in text and "| North | South |" in text and "Split by date" not in text
    assert cli.main(["prepare", "--panel", panel, "--out", str(tmp_path / "ready"), "--min-train", "10"]) == 0
    spec = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "ready/split")).collect()))
    assert spec["gap_days"] == 4 and len(spec["folds"]) == 5 and spec["rows"]["train"] + spec["rows"]["test"] + spec["rows"]["gap"] == 2 * (DAYS - 1 - 3)


def test_preparation_refuses_bad_data(own):
    with pytest.raises(ValueError, match="Temp_Max"):
        build.prepared(own.withColumn("Temp_Max", F.lit(None).cast("double")), ("Temp_Max",))
    with pytest.raises(ValueError, match="duplicate"):
        build.prepared(own.unionByName(own), ("Temp_Max",))
    ready, start, folds = build.prepared(own, ("Temp_Max",), min_train=10)
    assert set(r.split for r in ready.select("split").distinct().collect()) == {"train", "test", None}
    assert all(f.test_to < start for f in folds) and isinstance(folds[0], splits.Fold)


def test_pinned_archives(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("cities.json", json.dumps([
            {"code": "0102800000", "name": "City of Davao", "level": "City", "province": "P", "latitude": 7.0, "longitude": 125.0}, {"code": "0102899999", "name": "Sub", "level": "SubMun", "province": "P", "latitude": 0, "longitude": 0},
            {"code": "0500000000", "name": "Naga City", "level": "City", "province": "Q", "latitude": 13.0, "longitude": 123.0}, {"code": "0600000000", "name": "City of Naga", "level": "City", "province": "R", "latitude": 10.0, "longitude": 123.0},
        ]))
        z.writestr("parts.json", json.dumps([
            {"city_code": "0102800000", "population": 100, "latitude": 7.0, "longitude": 125.0, "source": "ok"}, {"city_code": "0102899999", "population": 300, "latitude": 8.0, "longitude": 126.0, "source": "ok"},
            {"city_code": "0102800000", "population": 500, "latitude": 0.0, "longitude": 0.0, "source": "fallback_unverified"}, {"city_code": "0500000000", "population": 0, "latitude": 1.0, "longitude": 1.0, "source": "ok"},
        ]))
    content = reference.pinned(buffer.getvalue(), hashlib.sha256(buffer.getvalue()).hexdigest())
    with pytest.raises(archive.Fatal):
        reference.pinned(content, "0" * 64)
    got = reference.members(spark, content, {"cities.json": "code string, name string, level string, province string, latitude double, longitude double", "parts.json": "city_code string, population long, latitude double, longitude double, source string"})
    rows = {r.code: r for r in reference.city_centres(got["cities.json"], got["parts.json"]).collect()}
    assert (rows["0102800000"].city, rows["0102800000"].latitude, rows["0102800000"].longitude, rows["0102800000"].n_parts, rows["0102800000"].n_used) == ("Davao", 7.75, 125.75, 3, 2)
    assert rows["0500000000"].city == "Naga (Q)" and rows["0600000000"].city == "Naga (R)" and rows["0500000000"].latitude == 13 and rows["0500000000"].shift_km == 0
    regions = spark.createDataFrame([("a", "National Capital Region"), ("b", "Ilocos (Region 1)")], "city string, region string")
    assert [r.city for r in reference.in_regions(regions, "metro manila", {"metro manila": "National Capital Region"}).collect()] == ["a"]
    assert reference.in_regions(regions, "capital, (region 1)").count() == 2
    with pytest.raises(ValueError, match="Ilocos"):
        reference.in_regions(regions, "nowhere")


def test_preflight():
    good = payload(14.5, 121.0, 0)
    reference.preflight(good, 14.6, 121.2)
    with pytest.raises(archive.Fatal, match="half a degree"):
        reference.preflight(good, 15.6, 121.2)
    with pytest.raises(archive.Fatal, match="rain"):
        reference.preflight(good | {"hourly": good["hourly"] | {"rain": [None] * 5}}, 14.5, 121.0)


def test_report():
    assert report.table([("a|b", 1.234, None)], ["x", "y", "z"]) == "| x | y | z |\n| --- | --- | --- |\n| a\\|b | 1.23 | - |"
    assert len(report.recommendations({"random_siblings": 0.9, "effective_series": 1.1, "entities": 16, "rare_levels": 2, "persistence_macro_f1": 0.5, "useful_lags": 0, "slope_per_100": -0.65})) == 6
    assert report.recommendations({}) == []


def test_neighbours_keep_their_own_payloads(spark, tmp_path):
    """Two cities in one grid cell: each has the weather its own file tells, and a payload that is broken or no one's stops the build."""
    last = FIRST + dt.timedelta(days=DAYS - 1)
    put = lambda city, x: archive.keep_raw(spark, archive.piece_path(f"file://{tmp_path}/raw", "k1", city, FIRST, last), x)
    cool, warm = payload(14.5, 121.0, 0), payload(14.5, 121.0, 4)
    put("San Juan", cool)
    put("Pasig", warm)
    (tmp_path / "cities.csv").write_text("city,latitude,longitude,elevation\nSan Juan,14.50,121.00,20\nPasig,14.60,121.10,5\n")
    args = ["--log", str(tmp_path / "log"), "build", "--raw", str(tmp_path / "raw"), "--cities", str(tmp_path / "cities.csv"), "--panel", str(tmp_path / "panel"), "--first", "2024-01-01", "--last", "2024-02-08", "--document", str(tmp_path / "about.md")]
    assert cli.main(args) == 0
    rows = {r.City: r for r in spark.read.parquet(str(tmp_path / "panel")).where("Date = '2024-01-01'").collect()}
    for city, p in (("San Juan", cool), ("Pasig", warm)):
        day = p["hourly"]["temperature_2m"][:24]
        assert (rows[city].Temp_Min, rows[city].Temp_Max, rows[city].RainHours, rows[city].Rainfall_Total) == (min(day), max(day), 2, 0.8)
    text = (tmp_path / "about.md").read_text()
    assert "| Temp_Max | feature | deg C |" in text and "0 to 50" in text
    put("Nowhere", cool)
    assert cli.main(args) == 1
    put("Nowhere", {**cool, "timezone": "UTC"})
    assert cli.main(args) == 1 and "timezone" in (tmp_path / "log").read_text()


def test_hours_that_come_twice_make_a_day_incomplete(spark):
    cols = "city string, day date, hour int, " + ", ".join(f"{v} double" for v in archive.VARIABLES)
    rows = [("a", FIRST, h, *[20.0] * 10) for h in range(24)]
    assert build.daily(spark.createDataFrame(rows, cols)).first().Temp_Max == 20.0
    assert build.daily(spark.createDataFrame([*rows, rows[3]], cols)).first().Temp_Max is None
    assert build.daily(spark.createDataFrame([*rows[1:], rows[3]], cols)).first().Temp_Max is None


def test_named_features():
    lags = ("HeatIndex_Max_Today_lag1", "DewPoint_Mean_lag1", "Temp_Min_mean3")
    assert build.feature_columns(static="none", weather="lr_pruned") == [*build.PRUNED, "DayOfYear"]
    assert build.feature_columns("all_lags", "coords", "lr_pruned", True, lags)[7:] == ["HeatIndex_Max_Today_lag1", "Temp_Min_mean3", "HeatLevelToday_Code", "DayOfYear", "Latitude", "Longitude", "Elevation"]
    for how in ({"feature_set": "x"}, {"static": "x"}, {"weather": "x"}):
        with pytest.raises(ValueError, match="unknown"):
            build.feature_columns(**how)


def test_warnings_leave_impossible_values_to_errors(own):
    def got(x):
        return {r.rule: r.n_bad for r in build.validated(own.withColumn("Temp_Max", F.when((F.col("City") == "South") & (F.col("Date") == F.lit(FIRST)), x).otherwise(F.col("Temp_Max"))), FIRST, dt.date(2024, 2, 8)).collect()}

    assert (got(45.0)["Temp_Max_range_warning"], got(45.0)["Temp_Max_range_error"]) == (1, 0)
    assert (got(60.0)["Temp_Max_range_warning"], got(60.0)["Temp_Max_range_error"]) == (0, 1)
    assert got(45.0)["rows_without_following"] == 0 and got(45.0)["unsorted"] == 0


def test_prepared_facts(own):
    ready, start, folds = build.prepared(own, ("HeatIndex_Max_Today",), share=0.8, gap=2, min_train=10)
    facts = build.prepared_facts(own, ready).first()
    assert facts.rows_in == own.count() and facts.train + facts.test + facts.gap_rows + facts.dropped == facts.rows_in and facts.gap_rows == 4
    assert "| fold |" in build.preparation_report(own, ready, start, 2, folds)
    with pytest.raises(ValueError, match="no test"):
        splits.require_sides(ready.where("split = 'train'"))
    assert splits.default_start(ready, dt.date(2024, 1, 20), before=10, after=5) == dt.date(2024, 1, 20)
    assert splits.default_start(ready, dt.date(2024, 1, 20)) == splits.nth_day(ready, 0.75)


def test_requests_and_raw_files(spark, tmp_path):
    q = archive.parameters(14.5, 121, FIRST, FIRST, key="k")
    assert (q["latitude"], q["start_date"], q["timezone"], q["apikey"]) == ("14.5000", "2024-01-01", "Asia/Manila", "k") and q["hourly"].startswith("temperature_2m,")

    class Answer(io.BytesIO):
        status = 200

    assert archive.http("http://x", q, opened=lambda url, timeout: Answer(b'{"a": 1}')) == (200, "", {"a": 1})
    with pytest.raises(archive.Retryable):
        archive.http("http://x", q, opened=lambda url, timeout: Answer(b"<html>"))

    def refused(url, timeout):
        raise urllib.error.HTTPError(url, 429, "no", {}, io.BytesIO(b'{"error": true, "reason": "Hourly limit"}'))

    assert archive.http("http://x", q, opened=refused)[:2] == (429, "Hourly limit")
    raw = tmp_path / "raw" / "k"
    raw.mkdir(parents=True)
    (raw / "A_2024-01-01_2024-01-02.json.gz").write_bytes(b"no gzip")
    archive.keep_raw(spark, f"file://{raw}/B c_2024-01-01_2024-01-02.json.gz", payload(1, 2, 0))
    assert [x.rsplit("/", 1)[1] for x in archive.unreadable(spark, f"file://{tmp_path}/raw")] == ["A_2024-01-01_2024-01-02.json.gz"]
    (r,) = archive.pieces(spark, f"file://{tmp_path}/raw").collect()
    assert (r.city, str(r["first"]), str(r["last"])) == ("B c", "2024-01-01", "2024-01-02")
    states = list(archive.collect([1, 2, 3], lambda p: p == 1, lambda p: {}, lambda p, x: None, rebuild=lambda p: p == 2))
    assert [s for _, s in states] == ["cached", "rebuilt", "fetched"]
    assert archive.first_cities(spark.createDataFrame([("b",), ("a",), ("c",)], "city string"), 2).count() == 2
    assert (report.duration(3725), report.duration(65.9), report.duration(-1)) == ("1h02m", "1m05s", "0m00s")
