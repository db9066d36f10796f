"""python -m tidewheel build|validate|analyse|prepare. Exit code 0: done; 1: faults found; 2: input missing."""

from __future__ import annotations

import argparse
import datetime as dt
import logging
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewheel.operators import evaluate, report, splits, stats
from tidewheel.plans import build
from tidewheel.sources import archive

log = logging.getLogger("tidewheel")


def options(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidewheel", description=__doc__)
    p.add_argument("--log", help="a file to which log lines are added")
    sub = p.add_subparsers(dest="command", required=True)
    day = dt.date.fromisoformat
    b = sub.add_parser("build", help="raw payloads to a checked panel")
    b.add_argument("--raw", required=True)
    b.add_argument("--cities", required=True, help="CSV with city, latitude, longitude, elevation")
    b.add_argument("--hours", type=int, default=24)
    b.add_argument("--most-missing", type=float, default=0.005)
    b.add_argument("--max-cities", type=int, default=0, help="the first so many by name")
    b.add_argument("--document", help="a Markdown file about the panel")
    for name in ("build", "validate"):
        q = b if name == "build" else sub.add_parser(name, help="checks of a panel")
        q.add_argument("--panel", required=True)
        q.add_argument("--first", type=day, required=True)
        q.add_argument("--last", type=day, required=True)
    for name, text in (("analyse", "statistics of a panel as Markdown"), ("prepare", "modelling rows and split")):
        q = sub.add_parser(name, help=text)
        q.add_argument("--panel", required=True)
        q.add_argument("--out", required=True)
        q.add_argument("--min-train", type=int, default=730)
    return p.parse_args(argv)


def analysis(own) -> str:
    rows = own.withColumnsRenamed({"City": "city", "Date": "day", "HeatIndex_Max_Today": "hi", "HeatLevelToday": "level", "HeatIndex_Max_Tomorrow": "hi_next", "HeatLevelTomorrow": "level_next"})
    split = splits.chronological(rows.withColumn("cell", F.col("city")), splits.nth_day(rows, 0.75))
    pairs = stats.pairs(rows, "hi", "level")
    cells = evaluate.confusion(split.where("split = 'test'").select(F.array_position(F.array(*map(F.lit, build.S.LEVELS)), F.col("level_next")).alias("y"), F.array_position(F.array(*map(F.lit, build.S.LEVELS)), F.col("level")).alias("p")), "y", "p", range(1, 6))
    score = evaluate.scores(cells, 4)
    facts = {"persistence_macro_f1": score.first()["macro_f1"], "entities": rows.select("city").distinct().count()}
    parts = {
        "Levels": rows.groupBy("level_next").agg(F.count("*").alias("rows"), F.count_distinct("day").alias("days")).orderBy(F.desc("rows")),
        "Pairs": pairs.orderBy("city_a", "city_b"),
        "Variance shares": stats.variance_shares(rows, "hi_next", {"day": ["day"], "city": ["city"]}),
        "Siblings in a split by date": splits.sibling_share(split),
        "Persistence": score,
        "Outliers": stats.outliers(rows, [c for c, role, *_ in build.DICTIONARY if role == "feature" and c in rows.columns and c != "level"]),
        "Advice": "\n".join(f"- {x}" for x in report.recommendations(facts)),
    }
    return report.sections("Panel analysis", parts)


def main(argv: list[str] | None = None) -> int:
    o = options(argv)
    if o.log:
        to = logging.FileHandler(o.log)
        to.setFormatter(logging.Formatter("%(asctime)sZ %(message)s"))
        to.formatter.converter = time.gmtime
        log.addHandler(to)
        log.setLevel(logging.INFO)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if o.command == "build":
            cities = spark.read.option("header", "true").schema("city string, latitude double, longitude double, elevation double").csv(o.cities)
            if o.max_cities:
                cities = archive.first_cities(cities, o.max_cities)
            # a payload belongs to the city its file is named after; neighbours share grid cells, so its coordinates do not tell
            raw = archive.pieces(spark, o.raw).where("_corrupt is null")
            known = raw.join(cities.select("city", F.lit(True).alias("_known")), "city", "left")
            tested = archive.payload_faults(known, F.col("first"), F.col("last"))
            bad = tested.where((F.size("faults") > 0) | F.col("city").isNull() | (F.col("_known").isNull() & F.lit(not o.max_cities)))
            wrong = [f"cannot be read: {f}" for f in archive.unreadable(spark, o.raw)]
            wrong += [f"{r['file']}: {', '.join(r['faults']) or 'no city of the list'}" for r in bad.select("file", "faults").limit(50).collect()]
            if not wrong:
                days = build.daily(archive.hours(known.where("_known")), o.hours)
                rain = build.rain_gap(days).first()
                if rain["n_over"]:
                    log.warning("%d days have over 0.5 mm between precipitation and rain (at most %.3f)", rain["n_over"], rain["max_gap"])
                wrong = archive.publish(build.panel(days, cities, o.most_missing), o.panel, lambda df: build.faults(df, o.first, o.last))
                if not wrong and o.document:
                    with open(o.document, "w") as f:
                        f.write(build.documentation(spark.read.parquet(o.panel), o.first, o.last))
        else:
            own = spark.read.parquet(o.panel)
            wrong = []
            if o.command == "validate":
                wrong = build.faults(own, o.first, o.last)
            elif o.command == "analyse":
                with open(o.out, "w") as f:
                    f.write(analysis(own))
            else:
                ready, start, folds = build.prepared(own, ("HeatIndex_Max_Today", "Temp_Max"), ("Temp_Max",), min_train=o.min_train)
                archive.write_csv(ready, f"{o.out}/rows")
                text = build.split_definition(ready, start, 4, folds)
                about = build.preparation_report(own, ready, start, 4, folds)
                for name, value in (("split", text), ("report", about)):
                    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{o.out}/{name}")
    except (AnalysisException, FileNotFoundError) as e:
        log.error("%s", str(e)[:300])
        return 2
    except ValueError as e:
        wrong = [str(e)]
    for w in wrong:
        log.error("%s", w)
    return int(bool(wrong))


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    sys.exit(main())

