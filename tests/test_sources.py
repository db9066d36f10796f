import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidewheel.sources import archive
from tidewheel.streaming import daily


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def sleep(self, s):
        self.slept.append(s)
        self.now += s

    def budget(self, **limits):
        return archive.Budget({60: 10.0, 3600: 100.0, 86400: 200.0} | limits, clock=lambda: self.now, sleep=self.sleep)


def test_plan(spark):
    cities = spark.createDataFrame([("a",), ("b",)], "city string")
    own = archive.plan(cities, dt.date(2015, 1, 1), dt.date(2025, 12, 29)).where("city = 'a'").orderBy("first").collect()
    assert len(own) == 11 and sum((r.last - r.first).days + 1 for r in own) == 4016 and own[-1].last == dt.date(2025, 12, 29)
    done = spark.createDataFrame([("a", own[0].first, own[0].last)], "city string, first date, last date")
    assert archive.pending(archive.plan(cities, dt.date(2015, 1, 1), dt.date(2025, 12, 29)), done).count() == 21


def test_keys():
    assert archive.spec_key({"a": 1, "b": 2}) == archive.spec_key({"b": 2, "a": 1}) != archive.spec_key({"a": 1})
    assert len(archive.spec_key({})) == 10


def test_budget_waits_for_the_window():
    c = Clock()
    b = c.budget()
    for _ in range(3):
        b.acquire(5)
        b.record(5)
    assert c.slept and c.now == pytest.approx(60) and b.spent(60) <= 10
    other = c.budget()
    other.restore(b.to_json())
    assert other.spent(3600) == 15


def test_budget_stops_for_the_day():
    c = Clock()
    b = c.budget()
    b.limits = {86400: 20.0}
    b.record(18)
    with pytest.raises(archive.DailyLimit):
        b.acquire(5)
    b.acquire(2)


def test_fetch_retries_and_gives_up():
    c, seen = Clock(), []
    answers = iter([(500, "oops", {}), (429, "minutely limit", {}), (200, "", {"ok": 1})])
    assert archive.fetch(lambda: next(answers), 1.0, c.budget(), pause=seen.append) == {"ok": 1} and len(seen) == 2 and seen[1] >= 60
    with pytest.raises(archive.Fatal):
        archive.fetch(lambda: (403, "proxy", {}), 1.0, c.budget(), pause=seen.append)
    with pytest.raises(archive.DailyLimit):
        archive.fetch(lambda: (429, "Daily API request limit", {}), 1.0, c.budget(), pause=seen.append)
    with pytest.raises(archive.Retryable):
        archive.fetch(lambda: (503, "", {}), 0.1, c.budget(), retries=1, pause=seen.append)
    assert archive.backoff(3, jitter=lambda: 1.0) == 40 and archive.backoff(20, jitter=lambda: 0.0) == 150 and archive.backoff(0, floor=60) == 60


def test_collect_resumes():
    kept = {}

    def get(p):
        if p == 3:
            raise archive.Fatal("no")
        if p == 5:
            raise archive.DailyLimit("enough")
        return p * 10

    got = dict(archive.collect(range(1, 8), lambda p: p == 1, get, kept.__setitem__))
    assert got == {1: "cached", 2: "fetched", 3: "failed", 4: "fetched", 5: "stopped", 6: "stopped", 7: "stopped"} and kept == {2: 20, 4: 40}


def payload(days=2, start="2024-01-01", **change):
    t0 = dt.datetime.fromisoformat(start)
    times = [(t0 + dt.timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M") for h in range(24 * days)]
    hourly = {"time": times} | {v: [float(h) for h in range(24 * days)] for v in archive.VARIABLES}
    return {"latitude": 14.5, "longitude": 121.0, "elevation": 5.0, "timezone": "Asia/Manila", "utc_offset_seconds": 28800, "hourly": hourly} | change


def test_payloads(spark, tmp_path):
    good, shifted, short = payload(), payload(start="2024-01-02"), payload()
    short["hourly"]["rain"] = short["hourly"]["rain"][:-1]
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write("\n".join([json.dumps(good), json.dumps(shifted), json.dumps(short), json.dumps(payload(timezone="UTC")), "{broken"]))
    raw = archive.read_raw(spark, str(tmp_path)).withColumn("first", F.lit(dt.date(2024, 1, 1))).withColumn("last", F.lit(dt.date(2024, 1, 2))).withColumn("city", F.lit("a")).cache()
    faults = [r.faults for r in archive.payload_faults(raw, "first", "last").where("_corrupt is null").collect()]
    assert [] in faults and ["start", "end"] in faults and ["rain"] in faults and ["timezone"] in faults
    assert raw.where("_corrupt is not null").count() == 1
    rows = archive.hours(archive.payload_faults(raw, "first", "last").where("size(faults) = 0 and _corrupt is null"))
    assert rows.count() == 48 and rows.agg(F.min("day"), F.max("hour")).first()[1] == 23 and dict(rows.dtypes)["ts"] == "timestamp_ntz"


def days(spark, rows):
    return spark.createDataFrame([(c, dt.date(y, 1, d), v) for c, y, d, v in rows], "city string, day date, x double")


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "daily")
    archive.write_daily(days(spark, [("a", 2023, 1, 1.0), ("a", 2024, 1, 2.0), ("b", 2024, 1, 3.0)]), path)
    archive.write_daily(days(spark, [("a", 2024, 1, 9.0)]), path)
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1.0, 3.0, 9.0]
    assert archive.completeness(spark.read.parquet(path)).count() == 3


def test_publish_and_csv(spark, tmp_path):
    df = days(spark, [("a", 2024, 1, 1.23456789)])
    ok, bad = str(tmp_path / "ok"), str(tmp_path / "bad")
    assert archive.publish(df, ok, lambda d: []) == [] and spark.read.parquet(ok).count() == 1
    assert archive.publish(df, bad, lambda d: ["wrong"]) == ["wrong"] and spark.read.parquet(f"{bad}.FAILED").count() == 1 and not (tmp_path / "bad").exists()
    archive.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first()["x"] == "1.2346"


def test_stream_gives_what_the_batch_gives(spark, sf, tmp_path):
    from tidewheel.operators import calendar
    from tidewheel.plans import panels

    own = panels.hourly(spark, sf).select("city", "ts", "t_c", "rh")
    own.write.parquet(str(tmp_path / "in"))
    stream = daily.daily_stream(spark.readStream.schema(own.schema).parquet(str(tmp_path / "in")), min_hours=1)
    q = stream.writeStream.outputMode("append").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.city, r.day): (r.n_hours, r.hi) for r in spark.sql("select * from days").collect()}
    want = {(r.city, r.day): (r.n_hours, r.hi) for r in calendar.daily(panels.hourly(spark, sf), 1).collect()}
    assert len(got) > 50 and all(want[k] == v for k, v in got.items())
