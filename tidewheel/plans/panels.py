"""Daily panels (entity x calendar day) drawn from the test tables, and the same in SQL for the oracles.

hourly: events as hourly readings. daily: those by day, gated by hours present. series: line items by return flag and ship day, almost
gap-free. orders: orders by priority and order day, with real gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.operators import calendar


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.lit(18.0) + 1.2 * (F.dayofmonth("ts") % 15) + F.col("value") % 4
    rh = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", F.col("event_type").alias("city"), "ts", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), t.alias("t_c"), rh.alias("rh"), "value")


def daily(spark: SparkSession, sf_dir: str, min_hours: int = 1) -> DataFrame:
    return calendar.daily(hourly(spark, sf_dir), min_hours)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    own = li.groupBy(F.col("l_returnflag").alias("city"), F.to_date("l_shipdate").alias("day")).agg(
        S.half_even(F.avg("l_quantity") + 20.0, 2).alias("hi"), S.half_even(F.avg("l_extendedprice"), 2).alias("price"),
        S.half_even(F.avg("l_discount") * 100.0, 2).alias("disc"), S.half_even(F.avg("l_tax") * 100.0, 2).alias("tax"), F.count("*").alias("n"),
    )
    return calendar.with_targets(own, "hi")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("city"), F.to_date("o_orderdate").alias("day")).agg(S.half_even(F.avg("o_totalprice") / 1000.0, 2).alias("total"), F.count("*").alias("n"))


def sql_heat_index(t_c: str, rh: str) -> str:
    t = f"({t_c} * 9.0::DOUBLE / 5.0 + 32.0)"
    simple = f"(({t} + 61.0 + ({t} - 68.0) * 1.2 + {rh} * 0.094) * 0.5)"
    full = " + ".join("(" + " * ".join([f"{c!r}::DOUBLE", *[t] * i, *[rh] * j]) + ")" for c, (i, j) in S.REGRESSION.items())
    dry = f"CASE WHEN {rh} < 13 AND {t} BETWEEN 80 AND 112 THEN -((13.0 - {rh}) / 4.0) * sqrt(greatest((17.0 - abs({t} - 95.0)) / 17.0, 0)) ELSE 0 END"
    humid = f"CASE WHEN {rh} > 85 AND {t} BETWEEN 80 AND 87 THEN (({rh} - 85.0) / 10.0) * ((87.0 - {t}) / 5.0) ELSE 0 END"
    return f"(CASE WHEN {t_c} BETWEEN -90 AND 60 AND {rh} BETWEEN 0 AND 100 THEN ((CASE WHEN ({simple} + {t}) / 2.0 >= 80 THEN {full} + {dry} + {humid} ELSE {simple} END) - 32.0) * 5.0 / 9.0 END)"


def sql_round(x: str, places: int = 2) -> str:
    return f"(round_even(({x}) * 1e{places}::DOUBLE, 0) / 1e{places}::DOUBLE)"


def sql_level(x: str) -> str:
    return f"(CASE WHEN {x} < 27 THEN 'Not Hazardous' WHEN {x} < 33 THEN 'Caution' WHEN {x} < 42 THEN 'Extreme Caution' WHEN {x} < 52 THEN 'Danger' WHEN {x} >= 52 THEN 'Extreme Danger' END)"


NEXT = "OVER (PARTITION BY city ORDER BY day RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 1 DAY FOLLOWING)"


def sql_hourly() -> str:
    return """hr AS (SELECT event_id, event_type AS city, ts, CAST(ts AS DATE) AS day, hour(ts) AS hour,
  18.0::DOUBLE + 1.2::DOUBLE * (day(ts) % 15) + value % 4 AS t_c, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS rh, value FROM events)"""


def sql_daily(min_hours: int = 1) -> str:
    gate = lambda x, c: f"CASE WHEN count(DISTINCT CASE WHEN {c} IS NOT NULL THEN hour END) >= {min_hours} THEN {sql_round(x)} END"
    return f"""{sql_hourly()}, hh AS (SELECT *, {sql_heat_index("t_c", "rh")} AS hi_h FROM hr),
d0 AS (SELECT city, day, {gate("min(t_c)", "t_c")} AS t_min, {gate("avg(t_c)", "t_c")} AS t_mean, {gate("max(t_c)", "t_c")} AS t_max,
  {gate("min(rh)", "rh")} AS rh_min, {gate("avg(rh)", "rh")} AS rh_mean, {gate("max(rh)", "rh")} AS rh_max, {gate("sum(value)", "value")} AS rain_total,
  CASE WHEN count(DISTINCT CASE WHEN value IS NOT NULL THEN hour END) >= {min_hours} THEN count(DISTINCT CASE WHEN value >= 0.1 THEN hour END) END AS rain_hours,
  {gate("max(hi_h)", "hi_h")} AS hi, count(DISTINCT hour) AS n_hours FROM hh GROUP BY ALL),
dy AS (SELECT *, {sql_level("hi")} AS level, max(hi) {NEXT} AS hi_next, {sql_level(f"max(hi) {NEXT}")} AS level_next FROM d0)"""


SQL_SERIES = f"""s0 AS (SELECT l_returnflag AS city, CAST(l_shipdate AS DATE) AS day, {sql_round("avg(l_quantity) + 20.0")} AS hi, {sql_round("avg(l_extendedprice)")} AS price,
  {sql_round("avg(l_discount) * 100.0")} AS disc, {sql_round("avg(l_tax) * 100.0")} AS tax, count(*) AS n FROM lineitem GROUP BY ALL),
se AS (SELECT *, {sql_level("hi")} AS level, max(hi) {NEXT} AS hi_next, {sql_level(f"max(hi) {NEXT}")} AS level_next FROM s0)"""

SQL_ORDERS = f"od AS (SELECT o_orderpriority AS city, CAST(o_orderdate AS DATE) AS day, {sql_round('avg(o_totalprice) / 1000.0')} AS total, count(*) AS n FROM orders GROUP BY ALL)"
