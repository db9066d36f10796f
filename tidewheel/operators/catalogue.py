"""Queries of the panel operators over the test tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.operators import calendar, evaluate, prepare, rules, splits, stats
from tidewheel.plans import panels as P
from tidewheel.plans.panels import NEXT, SQL_ORDERS, SQL_SERIES, sql_heat_index, sql_level, sql_round
from tidewheel.sources import archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EVT, EVT_GATED, HOURLY, SER, ORD = f"WITH {P.sql_daily(1)}", f"WITH {P.sql_daily(22)}", f"WITH {P.sql_hourly()}", f"WITH {SQL_SERIES}", f"WITH {SQL_ORDERS}"
LEVELS_SQL = "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(S.LEVELS)) + ") AS lv(code, level)"


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: S.half_even(F.col(c).cast("double"), 6) for c in cols})


def q6(x: str, name: str) -> str:
    return f"{sql_round(x, 6)} AS {name}"


def level_counts(panel: DataFrame, level: str) -> DataFrame:
    """Every level with its rows and percentage, zeros included."""
    spark = panel.sparkSession
    every = spark.createDataFrame(list(enumerate(S.LEVELS)), "code int, level string")
    counts = panel.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("level")).agg(F.count("*").alias("c"))
    n = F.coalesce("c", F.lit(0)).cast("long")
    return every.join(counts, "level", "left").select("code", "level", n.alias("n"), F.round(F.try_divide(100.0 * n, F.sum(n).over(W.partitionBy())), 2).alias("percent"))


# ---- hourly and daily


@query(f"{EVT} SELECT code, lv.level, count(d.level_next)::BIGINT AS n, round(100.0::DOUBLE * count(d.level_next) / nullif(sum(count(d.level_next)) OVER (), 0), 2) AS percent FROM {LEVELS_SQL} LEFT JOIN dy d ON d.level_next = lv.level GROUP BY ALL")
def flagship_class_distribution(spark, sf):
    """Hourly readings to next-day levels, and how often each level comes."""
    return level_counts(P.daily(spark, sf), "level_next")


@query(f"{HOURLY} SELECT event_id, {q6(sql_heat_index('t_c', 'rh'), 'hi')}, {sql_level(sql_round(sql_heat_index('t_c', 'rh')))} AS level FROM hr")
def heat_index_hourly(spark, sf):
    hi = S.heat_index(F.col("t_c"), F.col("rh"))
    return r6(P.hourly(spark, sf).select("event_id", hi.alias("hi"), S.heat_level(S.half_even(hi)).alias("level")), "hi")


@query(f"{EVT} SELECT city, day, t_min, t_mean, t_max, rh_min, rh_mean, rh_max, rain_total, hi, n_hours FROM dy")
def daily_aggregate(spark, sf):
    return P.daily(spark, sf).select("city", "day", "t_min", "t_mean", "t_max", "rh_min", "rh_mean", "rh_max", "rain_total", "hi", "n_hours")


@query(f"{EVT_GATED} SELECT city, day, n_hours, t_max, hi, level FROM dy")
def completeness_gate(spark, sf):
    return P.daily(spark, sf, 22).select("city", "day", "n_hours", "t_max", "hi", "level")


@query(f"{EVT} SELECT city, day, rain_hours, rain_total FROM dy")
def rain_hours(spark, sf):
    return P.daily(spark, sf).select("city", "day", "rain_hours", "rain_total")


@query(f"{EVT} SELECT city, day, hi, level, hi_next, level_next FROM dy")
def next_day_target(spark, sf):
    return P.daily(spark, sf).select("city", "day", "hi", "level", "hi_next", "level_next")


@query(f"{ORD} SELECT a.city, a.day, a.total, b.total AS total_next FROM od a LEFT JOIN od b ON a.city = b.city AND b.day = a.day + 1")
def target_via_join(spark, sf):
    own = P.orders(spark, sf)
    after = own.select("city", F.date_sub("day", 1).alias("day"), F.col("total").alias("total_next"))
    return own.join(after, ["city", "day"], "left").select("city", "day", "total", "total_next")


@query(f"{ORD} SELECT city, day FROM (SELECT city, day, max(day) OVER (PARTITION BY city) AS last FROM od) WHERE day < last")
def drop_last_day(spark, sf):
    return calendar.drop_last_day(P.orders(spark, sf)).select("city", "day")


@query(f"SELECT l_orderkey, l_linenumber, {sql_round('l_extendedprice * 0.005')} AS even2, {sql_round('l_extendedprice * 0.05', 1)} AS even1 FROM lineitem")
def half_even_rounding(spark, sf):
    p = F.col("l_extendedprice")
    return P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.half_even(p * 0.005).alias("even2"), S.half_even(p * 0.05, 1).alias("even1"))


@query(f"{HOURLY} SELECT city, day, hour, CAST(round(avg(rh), 6) AS DOUBLE) AS rh FROM hr GROUP BY ALL")
def payload_unnest(spark, sf):
    """Readings packed to parallel arrays by day, as payloads come, and unpacked again."""
    by_hour = P.hourly(spark, sf).groupBy("city", "day", "hour").agg(F.round(F.avg("rh"), 6).alias("rh"))
    packed = by_hour.groupBy("city", "day").agg(F.array_sort(F.collect_list(F.struct("hour", "rh"))).alias("h"))  # 24 at most
    payload = packed.select("city", "day", F.col("h.hour").alias("hour"), F.col("h.rh").alias("rh"))
    return payload.select("city", "day", F.inline(F.arrays_zip("hour", "rh")))


# ---- calendar windows


@query(
    f"""{ORD} SELECT city, day, {", ".join(f"max(total) OVER (PARTITION BY city ORDER BY day RANGE BETWEEN INTERVAL {k} DAY PRECEDING AND INTERVAL {k} DAY PRECEDING) AS total_lag{k}" for k in (1, 2, 3))} FROM od"""
)
def lag_features(spark, sf):
    return calendar.with_lags(P.orders(spark, sf), ["total"], means=()).select("city", "day", "total_lag1", "total_lag2", "total_lag3")


@query(f"{ORD}, k AS (SELECT a.city, a.day, a.total + b.total + c.total AS s, a.total - b.total AS d FROM od a LEFT JOIN od b ON a.city = b.city AND b.day = a.day - 1 LEFT JOIN od c ON a.city = c.city AND c.day = a.day - 2) SELECT city, day, {q6('s / 3', 'total_mean3d')}, {q6('d', 'total_change1d')} FROM k")
def rolling_mean_and_change(spark, sf):
    own = calendar.with_lags(P.orders(spark, sf), ["total"], lags=(), deltas=["total"])
    return r6(own.select("city", "day", "total_mean3d", "total_change1d"), "total_mean3d", "total_change1d")


@query(f"{ORD}, s AS (SELECT city, day - lag(day) OVER (PARTITION BY city ORDER BY day) AS step FROM od) SELECT city, count(*)::BIGINT AS n_days, count(CASE WHEN step <> 1 THEN 1 END)::BIGINT AS n_breaks, max(step)::BIGINT AS longest_step FROM s GROUP BY city")
def date_gaps(spark, sf):
    own = calendar.steps(P.orders(spark, sf))
    return own.groupBy("city").agg(F.count("*").alias("n_days"), F.count(F.when(F.col("step") != 1, 1)).alias("n_breaks"), F.max("step").cast("long").alias("longest_step"))


@query(f"{ORD}, x AS (SELECT city, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM od GROUP BY city) SELECT city, day FROM x ANTI JOIN od USING (city, day)")
def missing_days(spark, sf):
    return calendar.complete_days(P.orders(spark, sf))


@query(f"{ORD}, i AS (SELECT city, day, day - row_number() OVER (PARTITION BY city ORDER BY day)::INT AS g FROM od) SELECT city, min(day) AS first_day, count(*)::BIGINT AS length FROM i GROUP BY city, g")
def consecutive_runs(spark, sf):
    return calendar.runs(P.orders(spark, sf), ["city"])


# ---- classes

EVENTS = "ev AS (SELECT *, day + 1 AS event_day FROM se WHERE level_next IS NOT NULL)"
ISLANDS = "dd AS (SELECT DISTINCT level_next AS level, event_day FROM ev), gg AS (SELECT level, count(*) AS len, min(event_day) AS a FROM (SELECT level, event_day, event_day - row_number() OVER (PARTITION BY level ORDER BY event_day)::INT AS g FROM dd) GROUP BY level, g), ep AS (SELECT level, count(*) AS episodes, max(len) AS longest FROM gg GROUP BY level)"
PROFILE = f"pr AS (SELECT lv.code, lv.level, count(e.level_next)::BIGINT AS n_rows, round(100.0::DOUBLE * count(e.level_next) / (SELECT count(*) FROM se), 6) AS percent, count(DISTINCT e.event_day)::BIGINT AS n_days, count(DISTINCT year(e.event_day))::BIGINT AS n_years, coalesce(max(ep.episodes), 0)::BIGINT AS episodes, coalesce(max(ep.longest), 0)::BIGINT AS longest FROM {LEVELS_SQL} LEFT JOIN ev e ON e.level_next = lv.level LEFT JOIN ep ON ep.level = lv.level GROUP BY ALL)"


def profile(panel: DataFrame) -> DataFrame:
    """Of every level: rows, share, distinct event days, years, and runs of event days."""
    spark = panel.sparkSession
    events = panel.where("level_next is not null").select(F.col("level_next").alias("level"), F.date_add("day", 1).alias("event_day"))
    counts = events.groupBy("level").agg(F.count("*").alias("r"), F.count_distinct("event_day").alias("d"), F.count_distinct(F.year("event_day")).alias("y"))
    runs = calendar.runs(events.withColumnRenamed("event_day", "day"), ["level"]).groupBy("level").agg(F.count("*").alias("e"), F.max("length").alias("l"))
    every = spark.createDataFrame(list(enumerate(S.LEVELS)), "code int, level string")
    total = panel.agg(F.count("*").alias("t"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    own = every.join(counts, "level", "left").join(runs, "level", "left").crossJoin(total)  # five rows
    return own.select("code", "level", zero("r", "n_rows"), F.round(100.0 * F.coalesce("r", F.lit(0)) / F.col("t"), 6).alias("percent"), zero("d", "n_days"), zero("y", "n_years"), zero("e", "episodes"), zero("l", "longest"))


@query(f"{SER}, {EVENTS}, {ISLANDS}, {PROFILE} SELECT * FROM pr")
def class_profile(spark, sf):
    return profile(P.series(spark, sf))


FLAG = "CASE WHEN n_rows = 0 THEN 'ABSENT' WHEN n_days < 30 OR episodes < 5 THEN 'VERY FEW' WHEN n_days < 100 OR episodes < 10 THEN 'FEW' ELSE 'ok' END"


@query(f"{SER}, {EVENTS}, {ISLANDS}, {PROFILE} SELECT code, level, {FLAG} AS status, coalesce(nullif(concat_ws('; ', CASE WHEN n_rows = 0 THEN 'no observations' END, CASE WHEN n_rows > 0 AND n_days < 100 THEN n_days || ' distinct days (< 100)' END, CASE WHEN n_rows > 0 AND episodes < 10 THEN episodes || ' episodes (< 10)' END), ''), '-') AS reasons FROM pr")
def sufficiency_flags(spark, sf):
    own = profile(P.series(spark, sf))
    rows, days, runs = F.col("n_rows"), F.col("n_days"), F.col("episodes")
    status = F.when(rows == 0, "ABSENT").when((days < 30) | (runs < 5), "VERY FEW").when((days < 100) | (runs < 10), "FEW").otherwise("ok")
    why = F.concat_ws("; ", F.when(rows == 0, "no observations"), F.when((rows > 0) & (days < 100), F.concat(days.cast("string"), F.lit(" distinct days (< 100)"))), F.when((rows > 0) & (runs < 10), F.concat(runs.cast("string"), F.lit(" episodes (< 10)"))))
    return own.select("code", "level", status.alias("status"), F.when(why == "", "-").otherwise(why).alias("reasons"))


def crosstab(panel: DataFrame, key, name: str) -> DataFrame:
    own = panel.where("level_next is not null").groupBy(key.alias(name)).pivot("level_next", list(S.LEVELS)).count().fillna(0)
    return own.select(F.col(name).cast("long").alias(name), *(F.col(x).alias(x.lower().replace(" ", "_")) for x in S.LEVELS))


CROSS = ", ".join(f"count(CASE WHEN level_next = '{x}' THEN 1 END)::BIGINT AS {x.lower().replace(' ', '_')}" for x in S.LEVELS)


@query(f"{SER} SELECT year(day)::BIGINT AS year, {CROSS} FROM se WHERE level_next IS NOT NULL GROUP BY 1")
def class_by_year(spark, sf):
    return crosstab(P.series(spark, sf), F.year("day"), "year")


@query(f"{SER} SELECT month(day + 1)::BIGINT AS month, {CROSS} FROM se WHERE level_next IS NOT NULL GROUP BY 1")
def class_by_event_month(spark, sf):
    return crosstab(P.series(spark, sf), F.month(F.date_add("day", 1)), "month")


@query(f"{SER}, p AS (SELECT level_next AS level, day, count(DISTINCT city) AS c FROM se WHERE level_next IN ('Danger', 'Extreme Danger') GROUP BY ALL) SELECT level, sum(c)::BIGINT AS n_rows, count(*)::BIGINT AS n_days, {q6('avg(c)', 'mean_cities')}, {q6('avg((c = (SELECT count(DISTINCT city) FROM se))::INT)', 'share_all')}, {q6('avg((c = 1)::INT)', 'share_single')} FROM p GROUP BY level")
def danger_detail(spark, sf):
    own = P.series(spark, sf)
    days = own.where(F.col("level_next").isin("Danger", "Extreme Danger")).groupBy(F.col("level_next").alias("level"), "day").agg(F.count_distinct("city").alias("c"))
    both = days.crossJoin(F.broadcast(own.agg(F.count_distinct("city").alias("all"))))  # one row
    share = lambda cond: F.avg(cond.cast("double"))
    out = both.groupBy("level").agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_days"), F.avg("c").alias("mean_cities"), share(F.col("c") == F.col("all")).alias("share_all"), share(F.col("c") == 1).alias("share_single"))
    return r6(out, "mean_cities", "share_all", "share_single")


# ---- quality rules

def panel_rules() -> list[rules.Rule]:
    return [
        rules.in_range("hi", 25, 70), rules.in_range("price", 1000, 100_000), rules.in_range("disc", 0, 10), rules.in_range("tax", 0, 8), rules.in_range("hi", 30, 60, "warning"),
        rules.in_range("hi_next", 25, 70, "error", True), rules.ordered("tax", "disc"), rules.ordered("disc", "hi", 0.01, "warning"), rules.present("hi_next", "warning"),
    ]


def sql_rules(cases: dict[tuple[str, str], str], table: str = "se") -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, '{s}' AS severity, coalesce(sum(CASE WHEN {bad} THEN 1 ELSE 0 END), 0)::BIGINT AS n_bad FROM {table}" for (n, s), bad in cases.items())


@query(
    f"{SER} "
    + sql_rules({
        ("hi_range_error", "error"): "NOT hi BETWEEN 25 AND 70", ("price_range_error", "error"): "NOT price BETWEEN 1000 AND 100000", ("disc_range_error", "error"): "NOT disc BETWEEN 0 AND 10",
        ("tax_range_error", "error"): "NOT tax BETWEEN 0 AND 8", ("hi_range_warning", "warning"): "NOT hi BETWEEN 30 AND 60", ("hi_next_range_error", "error"): "NOT coalesce(hi_next BETWEEN 25 AND 70, false)",
        ("tax_le_disc", "error"): "tax > disc", ("disc_le_hi", "warning"): "disc > hi + 0.01", ("hi_next_missing", "warning"): "hi_next IS NULL",
    })
)
def range_and_order_checks(spark, sf):
    return rules.check(P.series(spark, sf), panel_rules())


@query(f"{SER}, b AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber), r AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) SELECT (SELECT sum(c - 1) FROM b)::BIGINT AS extra_keys, (SELECT sum(c - 1) FROM r)::BIGINT AS extra_rows, (SELECT coalesce(sum(c), 0) FROM b WHERE c > 1)::BIGINT AS rows_sharing_key")
def duplicate_checks(spark, sf):
    return rules.duplicates(P.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"{EVT_GATED} SELECT count(*)::BIGINT AS n_rows, " + ", ".join(f"count(CASE WHEN {c} IS NULL THEN 1 END)::BIGINT AS {c}" for c in ("t_max", "rh_max", "rain_hours", "hi", "level", "hi_next", "level_next")) + " FROM dy")
def missing_counts(spark, sf):
    cols = ("t_max", "rh_max", "rain_hours", "hi", "level", "hi_next", "level_next")
    return P.daily(spark, sf, 22).agg(F.count("*").alias("n_rows"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols))


@query(f"{EVT_GATED}, j AS (SELECT a.*, b.hi AS joined FROM dy a LEFT JOIN dy b ON a.city = b.city AND b.day = a.day + 1), n AS (SELECT *, lead(hi) OVER (PARTITION BY city ORDER BY day) AS w, lead(day) OVER (PARTITION BY city ORDER BY day) AS wd FROM j) SELECT count(CASE WHEN {sql_level('hi')} IS DISTINCT FROM level THEN 1 END)::BIGINT AS label_mismatches, count(CASE WHEN wd = day + 1 AND w IS DISTINCT FROM hi_next THEN 1 END)::BIGINT AS window_mismatches, count(CASE WHEN joined IS NOT NULL AND joined <> hi_next THEN 1 END)::BIGINT AS join_mismatches, count(CASE WHEN joined IS NULL THEN 1 END)::BIGINT AS without_next, 0::BIGINT AS unknown_labels FROM n")
def label_integrity(spark, sf):
    own = P.daily(spark, sf, 22)
    after = own.select("city", F.date_sub("day", 1).alias("day"), F.col("hi").alias("joined"))
    w = W.partitionBy("city").orderBy("day")
    rows = own.join(after, ["city", "day"], "left").withColumn("w", F.lead("hi").over(w)).withColumn("wd", F.lead("day").over(w))
    count = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return rows.agg(
        count(~S.heat_level(F.col("hi")).eqNullSafe(F.col("level")), "label_mismatches"), count((F.col("wd") == F.date_add("day", 1)) & ~F.col("w").eqNullSafe(F.col("hi_next")), "window_mismatches"),
        count(F.col("joined").isNotNull() & (F.col("joined") != F.col("hi_next")), "join_mismatches"), count(F.col("joined").isNull(), "without_next"),
        count(F.col("level").isNotNull() & ~F.col("level").isin(*S.LEVELS), "unknown_labels"),
    )


@query(f"{ORD} SELECT city, count(*)::BIGINT AS n_days, min(day) AS first_day, max(day) AS last_day, (max(day) - min(day) + 1 - count(*))::BIGINT AS n_missing, (count(*) <> (SELECT max(day) - min(day) + 1 FROM od)) AS wrong_count FROM od GROUP BY city")
def series_extent(spark, sf):
    own = P.orders(spark, sf)
    span = own.agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("span"))
    by = own.groupBy("city").agg(F.count("*").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    missing = (F.datediff("last_day", "first_day") + 1 - F.col("n_days")).cast("long")
    return by.crossJoin(F.broadcast(span)).select("city", "n_days", "first_day", "last_day", missing.alias("n_missing"), (F.col("n_days") != F.col("span")).alias("wrong_count"))  # one row


# ---- places

PLACES = "pl AS (SELECT n_nationkey, n_name, r_name, s_acctbal AS w, 10 + 0.37::DOUBLE * n_nationkey + 0.001 * (s_suppkey % 97) AS lat, 120 + 0.21::DOUBLE * n_nationkey + 0.002 * (s_suppkey % 89) AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as settlements of nations, with positions made from their keys and balances as weights."""
    s, n, r = (P.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    own = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 25 and 5 rows
    k = F.col("n_nationkey")
    return own.select(k, "n_name", "r_name", F.col("s_acctbal").alias("w"), (10 + 0.37 * k + 0.001 * (F.col("s_suppkey") % 97)).alias("lat"), (120 + 0.21 * k + 0.002 * (F.col("s_suppkey") % 89)).alias("lon"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(r_name), 'asia') OR contains(lower(r_name), 'eur')")
def region_filter(spark, sf):
    n, r = P.table(spark, sf, "nation"), P.table(spark, sf, "region")
    wanted = [x.strip().lower() for x in "Asia, EUR".split(",")]
    cond = F.lit(False)
    for x in wanted:
        cond = cond | F.contains(F.lower("r_name"), F.lit(x))
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).where(cond).select("n_nationkey", "n_name", "r_name")


RAW_NAME = "CASE p_partkey % 4 WHEN 0 THEN 'City of ' || p_name WHEN 1 THEN p_name || ' City' WHEN 2 THEN 'Island Garden City of ' || p_name ELSE 'San Jose Del Monte' END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'San Jose del Monte' ELSE trim(regexp_replace(regexp_replace({RAW_NAME}, '^.*?\\bCity of\\s+', ''), '\\s+City$', '')) END AS city FROM part")
def name_cleanup(spark, sf):
    return P.table(spark, sf, "part").select("p_partkey", S.city_name(F.expr(RAW_NAME)).alias("city"))


@query("WITH d AS (SELECT c_custkey, c_mktsegment AS base, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || ' (' || n_name || ')' ELSE base END AS name FROM d")
def name_disambiguation(spark, sf):
    c, n = P.table(spark, sf, "customer"), P.table(spark, sf, "nation")
    shared = c.groupBy("c_mktsegment").count().where("count > 1").select("c_mktsegment", F.lit(True).alias("shared"))
    own = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(shared, "c_mktsegment", "left")
    return own.select("c_custkey", F.when(F.col("shared"), F.concat("c_mktsegment", F.lit(" ("), "n_name", F.lit(")"))).otherwise(F.col("c_mktsegment")).alias("name"))


CENTRE = f"ce AS (SELECT n_nationkey, n_name, r_name, count(*)::BIGINT AS n_places, count(CASE WHEN w > 0 THEN 1 END)::BIGINT AS n_used, coalesce(sum(CASE WHEN w > 0 THEN w * lat END) / sum(CASE WHEN w > 0 THEN w END), avg(lat)) AS lat, coalesce(sum(CASE WHEN w > 0 THEN w * lon END) / sum(CASE WHEN w > 0 THEN w END), avg(lon)) AS lon, avg(lat) AS area_lat, avg(lon) AS area_lon FROM pl GROUP BY ALL)"


def centres(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted centres of nations; the plain mean where no weight is positive."""
    w = F.when(F.col("w") > 0, F.col("w"))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(w * F.col(c)), F.sum(w)), F.avg(c))
    return places(spark, sf).groupBy("n_nationkey", "n_name", "r_name").agg(F.count("*").alias("n_places"), F.count(w).alias("n_used"), mean("lat").alias("lat"), mean("lon").alias("lon"), F.avg("lat").alias("area_lat"), F.avg("lon").alias("area_lon"))


@query(f"WITH {PLACES}, {CENTRE} SELECT n_nationkey, n_places, n_used, {sql_round('lat', 5)} AS lat, {sql_round('lon', 5)} AS lon FROM ce")
def weighted_centroid(spark, sf):
    return centres(spark, sf).select("n_nationkey", "n_places", "n_used", S.half_even(F.col("lat"), 5).alias("lat"), S.half_even(F.col("lon"), 5).alias("lon"))


@query(f"WITH {PLACES}, {CENTRE} SELECT n_nationkey, {q6('2 * 6371.0088 * asin(sqrt(pow(sin(radians(area_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(area_lat)) * pow(sin(radians(area_lon - lon) / 2), 2)))', 'km')} FROM ce")
def haversine(spark, sf):
    return r6(centres(spark, sf).select("n_nationkey", S.haversine_km(F.col("lat"), F.col("lon"), F.col("area_lat"), F.col("area_lon")).alias("km")), "km")


@query(f"WITH {PLACES}, {CENTRE}, g AS (SELECT printf('%.2fN/%.2fE', round(area_lat / 2, 0) * 2, round(area_lon / 2, 0) * 2) AS cell, n_name, n_nationkey * 10.0::DOUBLE AS elevation FROM ce) SELECT cell, count(*)::BIGINT AS n_cities, string_agg(n_name, ', ' ORDER BY n_name) AS cities, min(elevation) AS lowest, max(elevation) AS highest, max(elevation) - min(elevation) AS spread FROM g GROUP BY cell")
def cell_summary(spark, sf):
    grid = lambda c: F.round(F.col(c) / 2, 0) * 2
    own = centres(spark, sf).select(S.cell_label(grid("area_lat"), grid("area_lon")).alias("cell"), "n_name", (F.col("n_nationkey") * 10.0).alias("e"))
    return own.groupBy("cell").agg(F.count("*").alias("n_cities"), F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("cities"), F.min("e").alias("lowest"), F.max("e").alias("highest"), (F.max("e") - F.min("e")).alias("spread"))


# ---- shared series

PAIRS = "pa AS (SELECT a.city AS city_a, b.city AS city_b, b.hi - a.hi AS d, a.hi AS va, b.hi AS vb, a.level AS la, b.level AS lb, a.day FROM se a JOIN se b ON a.day = b.day AND a.city < b.city)"
ELEVATION = "el AS (SELECT city, row_number() OVER (ORDER BY city) * 40.0::DOUBLE AS e FROM (SELECT DISTINCT city FROM se))"


@query(f"{SER}, {PAIRS} SELECT city_a, city_b, count(*)::BIGINT AS n_days, {q6('avg(d)', 'mean_d')}, {q6('avg(abs(d))', 'mean_abs_d')}, {q6('quantile_cont(abs(d), 0.95)', 'p95_abs_d')}, {q6('max(abs(d))', 'max_abs_d')}, {q6('avg((abs(d) >= 0.5)::INT)', 'share_ge_half')}, {q6('avg((abs(d) >= 1)::INT)', 'share_ge_one')}, {q6('avg((abs(d) <= 1e-9)::INT)', 'identical')}, {q6('avg((la <> lb)::INT)', 'level_differs')}, {q6('corr(va, vb)', 'corr')} FROM pa GROUP BY ALL")
def pair_differences(spark, sf):
    own = stats.pairs(P.series(spark, sf), "hi", "level")
    return r6(own, *[c for c in own.columns if c not in ("city_a", "city_b", "n_days")])


@query(f"{SER}, {PAIRS} SELECT city_a, city_b, {q6('avg((abs(a.disc - b.disc) <= 1e-9)::INT)', 'disc')}, {q6('avg((abs(a.tax - b.tax) <= 1e-9)::INT)', 'tax')}, {q6('avg((abs(a.tax - b.tax) <= 1e-9 AND abs(a.disc - b.disc) <= 1e-9)::INT)', 'both_columns')} FROM pa JOIN se a ON a.city = city_a AND a.day = pa.day JOIN se b ON b.city = city_b AND b.day = pa.day GROUP BY ALL")
def identical_share(spark, sf):
    own = P.series(spark, sf)
    a, b = (own.select("day", F.col("city").alias(f"city_{x}"), F.col("disc").alias(f"disc_{x}"), F.col("tax").alias(f"tax_{x}")) for x in "ab")
    same = {c: F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= 1e-9 for c in ("disc", "tax")}
    share = lambda cond: F.avg(cond.cast("double"))
    out = a.join(b, "day").where("city_a < city_b").groupBy("city_a", "city_b").agg(share(same["disc"]).alias("disc"), share(same["tax"]).alias("tax"), share(same["disc"] & same["tax"]).alias("both_columns"))
    return r6(out, "disc", "tax", "both_columns")


@query(f"{SER}, {PAIRS}, {ELEVATION}, m AS (SELECT city_a, city_b, avg(d) AS d FROM pa GROUP BY ALL) SELECT {q6('100 * sum(m.d * (b.e - a.e)) / sum((b.e - a.e) * (b.e - a.e))', 'slope_per_100')}, CASE WHEN avg(abs(m.d)) >= 0.5 THEN 'material' WHEN avg(abs(m.d)) >= 0.2 THEN 'modest' ELSE 'negligible' END AS verdict FROM m JOIN el a ON a.city = city_a JOIN el b ON b.city = city_b")
def lapse_slope(spark, sf):
    own = P.series(spark, sf)
    heights = own.select("city").distinct().withColumn("e", F.row_number().over(W.orderBy("city")) * 40.0)  # as many rows as entities
    pairs = stats.pairs(own, "hi", "level").select("city_a", "city_b", "mean_d")
    of = lambda x: heights.select(F.col("city").alias(f"city_{x}"), F.col("e").alias(f"e{x}"))
    rise = F.col("eb") - F.col("ea")
    size = F.avg(F.abs("mean_d"))
    out = pairs.join(of("a"), "city_a").join(of("b"), "city_b").agg((100 * F.sum(F.col("mean_d") * rise) / F.sum(rise * rise)).alias("slope_per_100"), F.when(size >= 0.5, "material").when(size >= 0.2, "modest").otherwise("negligible").alias("verdict"))
    return r6(out, "slope_per_100")


@query(f"{SER}, an AS (SELECT city, day, hi - avg(hi) OVER (PARTITION BY city, month(day)) AS x FROM se), co AS (SELECT a.city AS ca, b.city AS cb, corr(a.x, b.x) AS r FROM an a JOIN an b ON a.day = b.day AND a.city < b.city GROUP BY ALL), k AS (SELECT count(DISTINCT city)::DOUBLE AS n FROM se) SELECT {q6('max(n) * max(n) / (max(n) + 2 * sum(r * r))', 'effective_series')}, {q6('avg(r)', 'mean_corr')}, {q6('min(r)', 'min_corr')} FROM co, k")
def participation_ratio(spark, sf):
    own = P.series(spark, sf)
    anom = own.withColumn("x", F.col("hi") - F.avg("hi").over(W.partitionBy("city", F.month("day"))))
    a, b = (anom.select("day", F.col("city").alias(f"city_{k}"), F.col("x").alias(f"x{k}")) for k in "ab")
    corr = a.join(b, "day").where("city_a < city_b").groupBy("city_a", "city_b").agg(F.corr("xa", "xb").alias("corr"))
    return r6(stats.effective_series(corr, own.select("city").distinct().count()), "effective_series", "mean_corr", "min_corr")


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 500 AS a, (o_custkey % 500 + 10) % 500 AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT a AS node FROM u UNION SELECT b FROM u), r(node, x) AS (SELECT node, node FROM n UNION SELECT u.b, r.x FROM r JOIN u ON u.a = r.node) SELECT node, min(x) AS root FROM r GROUP BY node")
def components(spark, sf):
    """Customers of all orders in chains of every tenth."""
    k = F.col("o_custkey") % 500
    edges = P.table(spark, sf, "orders").select(k.alias("a"), ((k + 10) % 500).alias("b")).distinct()
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return stats.groups(edges, nodes)


SPECTRUM = "an AS (SELECT city, day, hi - avg(hi) OVER (PARTITION BY city, month(day)) AS x FROM se), co AS (SELECT corr(a.x, b.x) AS r FROM an a JOIN an b ON a.day = b.day AND a.city < b.city GROUP BY a.city, b.city), pq AS (SELECT sqrt(sum(r * r) / 3.0::DOUBLE) AS p, product(r) AS q FROM co), ev AS (SELECT 1 + 2 * p * cos((acos(greatest(-1.0, least(1.0, q / (p * p * p)))) - 2 * pi() * k.range) / 3) AS l FROM pq, range(3) k), sh AS (SELECT l / sum(l) OVER () AS s, sum(l) OVER (ORDER BY l DESC) / sum(l) OVER () AS c FROM ev)"


@query(f"{SER}, {SPECTRUM} SELECT {q6('max(s)', 'first_share')}, (count(*) FILTER (c < 0.95) + 1)::BIGINT AS n_for_95 FROM sh")
def spectrum(spark, sf):
    """First component of the three entities' correlations, and how many explain 95 %; in SQL by the formula for three."""
    anom = P.series(spark, sf).withColumn("x", F.col("hi") - F.avg("hi").over(W.partitionBy("city", F.month("day"))))
    a, b = (anom.select("day", F.col("city").alias(f"city_{k}"), F.col("x").alias(f"x{k}")) for k in "ab")
    share, n = stats.spectrum(a.join(b, "day").where("city_a < city_b").groupBy("city_a", "city_b").agg(F.corr("xa", "xb").alias("corr")))
    return r6(spark.createDataFrame([(share, n)], "first_share double, n_for_95 long"), "first_share")


@query(f"{SER}, pr AS (SELECT avg(abs(b.hi - a.hi)) AS d, avg((a.level <> b.level)::INT) AS l FROM se a JOIN se b ON a.day = b.day AND a.city < b.city GROUP BY a.city, b.city), v AS (SELECT avg(d) AS d, avg(l) AS l FROM pr) SELECT CASE WHEN d >= 0.5 OR l >= 0.02 THEN 'material' WHEN d >= 0.2 OR l >= 0.005 THEN 'modest' ELSE 'negligible' END AS verdict, {q6('d', 'mean_abs_d')}, {q6('l', 'level_differs')} FROM v")
def elevation_verdict(spark, sf):
    """All entities as one cell, each a step higher than the last."""
    pairs = stats.pairs(P.series(spark, sf), "hi", "level").withColumn("rise", F.ascii("city_b") - F.ascii("city_a"))
    return r6(stats.elevation_verdict(pairs), "mean_abs_d", "level_differs")


# ---- leakage

CELL = "CASE WHEN city IN ('A', 'N') THEN 'left' ELSE 'right' END"


def celled(spark: SparkSession, sf: str) -> DataFrame:
    return P.series(spark, sf).withColumn("cell", F.expr(CELL))


@query(f"{SER} SELECT {q6('avg((c > 1)::INT)', 'duplicate_share')}, {q6('avg((cn > 1)::INT)', 'mate_share')} FROM (SELECT count(*) OVER (PARTITION BY day, round(disc, 0), round(tax, 0)) AS c, cn FROM se JOIN (SELECT {CELL} AS cell, count(DISTINCT city) AS cn FROM se GROUP BY 1) z ON z.cell = {CELL})")
def same_day_duplicates(spark, sf):
    """Rows that share their day's rounded vector with another, and rows whose cell has another entity."""
    own = celled(spark, sf)
    by = ["day", F.round("disc", 0), F.round("tax", 0)]
    mates = own.groupBy("cell").agg(F.count_distinct("city").alias("cn"))
    rows = own.withColumn("c", F.count("*").over(W.partitionBy(*by))).join(F.broadcast(mates), "cell")
    return r6(rows.agg(F.avg((F.col("c") > 1).cast("double")).alias("duplicate_share"), F.avg((F.col("cn") > 1).cast("double")).alias("mate_share")), "duplicate_share", "mate_share")


@query(f"{SER}, v AS (SELECT day, count(DISTINCT (round(disc, 0), round(tax, 0))) AS c FROM se GROUP BY day) SELECT {q6('avg(c)', 'mean_vectors')}, max(c)::BIGINT AS max_vectors, count(*)::BIGINT AS n_days FROM v")
def vectors_per_day(spark, sf):
    by = P.series(spark, sf).groupBy("day").agg(F.count_distinct(F.struct(F.round("disc", 0), F.round("tax", 0))).alias("c"))
    return r6(by.agg(F.avg("c").alias("mean_vectors"), F.max("c").alias("max_vectors"), F.count("*").alias("n_days")), "mean_vectors")


@query(f"{SER}, t AS (SELECT avg(hi_next) AS m, var_pop(hi_next) * count(hi_next) AS ss FROM se), y AS (SELECT *, {CELL} AS cell FROM se WHERE hi_next IS NOT NULL), g AS (SELECT 'day' AS grouping, avg(hi_next) AS g, count(*) AS c FROM y GROUP BY day UNION ALL SELECT 'cell_day', avg(hi_next), count(*) FROM y GROUP BY cell, day UNION ALL SELECT 'city', avg(hi_next), count(*) FROM y GROUP BY city) SELECT grouping, {q6('sum(c * (g - m) * (g - m)) / max(ss)', 'share')} FROM g, t GROUP BY grouping")
def variance_shares(spark, sf):
    return r6(stats.variance_shares(celled(spark, sf), "hi_next", {"day": ["day"], "cell_day": ["cell", "day"], "city": ["city"]}), "share")


DAYS = "dn AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM se))"
START = "ts AS (SELECT min(day) FILTER (k = floor(n * 0.75)::BIGINT + 1) AS t0 FROM dn)"
SPLIT = f"sp AS (SELECT *, {CELL} AS cell, CASE WHEN day >= t0 THEN 'test' WHEN day < t0 - 1 THEN 'train' END AS split FROM se, ts)"


def split_series(spark: SparkSession, sf: str) -> DataFrame:
    own = celled(spark, sf)
    return splits.chronological(own, splits.nth_day(own, 0.75))


@query(f"{SER}, {DAYS}, {START}, {SPLIT} SELECT coalesce(split, 'gap') AS split, count(*)::BIGINT AS n, count(DISTINCT day)::BIGINT AS n_days, min(day) AS first_day, max(day) AS last_day FROM sp GROUP BY 1")
def chronological_split(spark, sf):
    own = split_series(spark, sf)
    return own.groupBy(F.coalesce("split", F.lit("gap")).alias("split")).agg(F.count("*").alias("n"), F.count_distinct("day").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


SIBLINGS = f"(SELECT {q6('avg((day IN (SELECT day FROM sp WHERE split = $$train$$))::INT)', 'same_day')}, {q6('avg(((cell, day) IN (SELECT (cell, day) FROM sp WHERE split = $$train$$))::INT)', 'same_cell_day')}, count(*)::BIGINT AS n_test FROM sp WHERE split = $$test$$)".replace("$$", "'")
HASHED = f"sp AS (SELECT *, {CELL} AS cell, CASE WHEN ((((day - DATE '1970-01-01') * 7919) % 1000003 * 31 + n * 7919) % 1000003) % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM se)"


@query(f"{SER}, {DAYS}, {START}, {SPLIT} SELECT * FROM {SIBLINGS}")
def sibling_share(spark, sf):
    return r6(splits.sibling_share(split_series(spark, sf)), "same_day", "same_cell_day")


@query(f"{SER}, {HASHED} SELECT * FROM {SIBLINGS}")
def random_split_siblings(spark, sf):
    own = celled(spark, sf).withColumn("d", S.day_number(F.col("day")).cast("long"))
    return r6(splits.sibling_share(own.withColumn("split", splits.hash_side(["d", "n"]))), "same_day", "same_cell_day")


@query(f"{SER}, {DAYS}, {START}, {SPLIT}, v AS (SELECT split, round(disc, 1) AS a, round(tax, 1) AS b, n FROM sp) SELECT count(*)::BIGINT AS n_shared FROM v JOIN (SELECT DISTINCT a, b, n FROM v WHERE split = 'train') t USING (a, b, n) WHERE v.split = 'test'")
def cross_split_duplicates(spark, sf):
    """Test rows whose vector stands in training: keys scaled to whole numbers before joining."""
    key = lambda c: F.rint(F.round(c, 1) * 10).cast("long").alias(c)
    own = split_series(spark, sf).select("split", key("disc"), key("tax"), "n")
    train = own.where("split = 'train'").select("disc", "tax", "n").distinct()
    return own.where("split = 'test'").join(train, ["disc", "tax", "n"]).agg(F.count("*").alias("n_shared"))


@query(f"{SER}, o AS (SELECT *, row_number() OVER (ORDER BY city, day) AS k, count(*) OVER () AS t FROM se), s AS (SELECT *, CASE WHEN k <= floor(t * 0.8) THEN 'train' ELSE 'test' END AS part FROM o) SELECT part, count(*)::BIGINT AS n, count(DISTINCT city)::BIGINT AS n_cities, min(day) AS first_day, max(day) AS last_day FROM s GROUP BY part")
def naive_row_split(spark, sf):
    """What a split by row order does: it splits by entity. Ranks come from counts of earlier entities, so no task sorts all rows."""
    own = P.series(spark, sf)
    sizes = own.groupBy("city").agg(F.count("*").alias("c"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.city") < F.col("a.city"), "left").groupBy(F.col("a.city").alias("city")).agg(F.coalesce(F.sum("b.c"), F.lit(0)).alias("before"))
    total = own.agg(F.count("*").alias("t"))
    k = F.col("before") + F.row_number().over(W.partitionBy("city").orderBy("day"))
    rows = own.join(F.broadcast(before), "city").crossJoin(F.broadcast(total)).withColumn("part", F.when(k <= F.floor(F.col("t") * 0.8), "train").otherwise("test"))  # one row
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("city").alias("n_cities"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(f"{SER}, {DAYS}, {START}, {SPLIT}, c AS (SELECT split, level_next AS level, count(*) AS c FROM sp WHERE split IS NOT NULL AND level_next IS NOT NULL GROUP BY ALL), p AS (SELECT split, level, 100.0::DOUBLE * c / sum(c) OVER (PARTITION BY split) AS p FROM c) SELECT lv.level, {q6('coalesce(max(p) FILTER (split = $$test$$), 0) - coalesce(max(p) FILTER (split = $$train$$), 0)', 'shift_pp')} FROM {LEVELS_SQL} LEFT JOIN p ON p.level = lv.level GROUP BY lv.level".replace("$$", "'"))
def prevalence_shift(spark, sf):
    own = split_series(spark, sf).where("split is not null and level_next is not null").groupBy("split", F.col("level_next").alias("level")).count()
    share = own.withColumn("p", 100.0 * F.col("count") / F.sum("count").over(W.partitionBy("split")))
    every = spark.createDataFrame([(x,) for x in S.LEVELS], "level string")
    at = lambda s: F.coalesce(F.max(F.when(F.col("split") == s, F.col("p"))), F.lit(0.0))
    return r6(every.join(share, "level", "left").groupBy("level").agg((at("test") - at("train")).alias("shift_pp")), "shift_pp")


@query(f"{SER}, {DAYS} SELECT min(day) FILTER (k = round_even(n * 0.8, 0)::BIGINT + 1) AS split_day, max(n)::BIGINT AS n_days FROM dn")
def split_day(spark, sf):
    own = P.series(spark, sf)
    return spark.createDataFrame([(splits.nth_day(own, 0.8, rounded=True), own.select("day").distinct().count())], "split_day date, n_days long")


FOLDS = "fo AS (SELECT f, n - (5 - f) * ((n - 730 - 1) // 5) + 1 AS lo, CASE WHEN f < 4 THEN n - (5 - f) * ((n - 730 - 1) // 5) + (n - 730 - 1) // 5 ELSE n END AS hi FROM (SELECT max(n) AS n FROM dn), range(5) t(f)), fb AS (SELECT f + 1 AS fold, a.day - 1 AS train_before, a.day AS test_from, b.day AS test_to FROM fo JOIN dn a ON a.k = lo JOIN dn b ON b.k = hi)"
SIDES = "fr AS (SELECT fold, CASE WHEN day < train_before THEN 'train' ELSE 'test' END AS side, se.* FROM se JOIN fb ON day < train_before OR day BETWEEN test_from AND test_to)"


def in_folds(spark: SparkSession, sf: str) -> DataFrame:
    own = P.series(spark, sf)
    return splits.fold_rows(own, splits.expanding(own))


@query(f"{SER}, {DAYS}, {FOLDS}, {SIDES} SELECT fold::BIGINT AS fold, side, count(*)::BIGINT AS n, min(day) AS first_day, max(day) AS last_day FROM fr GROUP BY ALL")
def expanding_folds(spark, sf):
    return in_folds(spark, sf).groupBy(F.col("fold").cast("long").alias("fold"), "side").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(f"{SER}, {DAYS}, {FOLDS}, {SIDES} SELECT fold::BIGINT AS fold, side, {CROSS} FROM fr GROUP BY ALL")
def fold_class_counts(spark, sf):
    own = in_folds(spark, sf).groupBy(F.col("fold").cast("long").alias("fold"), "side").pivot("level_next", list(S.LEVELS)).count().fillna(0)
    return own.select("fold", "side", *(F.col(x).alias(x.lower().replace(" ", "_")) for x in S.LEVELS))


@query(f"{SER}, c AS (SELECT level_next AS label, count(*) AS n FROM se WHERE level_next IS NOT NULL GROUP BY 1) SELECT label, n::BIGINT AS n, {q6('(SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n)', 'weight')}, {q6('least(20, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n))', 'capped')}, {q6('pow((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 0.25)', 'quarter')} FROM c")
def class_weights(spark, sf):
    own = P.series(spark, sf).where("level_next is not null")
    full = evaluate.class_weights(own, "level_next")
    return r6(full.select("label", "n", "weight", F.least("weight", F.lit(20.0)).alias("capped"), F.pow("weight", 0.25).alias("quarter")), "weight", "capped", "quarter")


# ---- statistics

MEASURES = ("hi", "price", "disc", "tax")


@query(f"{SER}, q AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS x FROM se" for c in MEASURES) + f"), f AS (SELECT \"column\", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM q GROUP BY 1) SELECT q.\"column\", min(x) AS min, {q6('quantile_cont(x, 0.5)', 'median')}, {q6('quantile_cont(x, 0.99)', 'p99')}, max(x) AS max, {q6('skewness(x)', 'skewness')}, count(CASE WHEN x < 4 * q1 - 3 * q3 OR x > 4 * q3 - 3 * q1 THEN 1 END)::BIGINT AS n_far FROM q JOIN f USING (\"column\") GROUP BY 1")
def outlier_table(spark, sf):
    return r6(stats.outliers(P.series(spark, sf), MEASURES), "median", "p99", "skewness")


@query(f"{SER}, q AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS x FROM se" for c in MEASURES) + f") SELECT \"column\", count(x)::BIGINT AS n, {q6('avg(x)', 'mean')}, {q6('stddev_samp(x)', 'sd')}, min(x) AS min, {q6('quantile_cont(x, 0.25)', 'q1')}, {q6('quantile_cont(x, 0.5)', 'median')}, {q6('quantile_cont(x, 0.75)', 'q3')}, max(x) AS max FROM q GROUP BY 1")
def describe_panel(spark, sf):
    return r6(stats.describe(P.series(spark, sf), MEASURES), "mean", "sd", "q1", "median", "q3")


TOP = "dm AS (SELECT day, max(total) AS m FROM od GROUP BY day), tp AS (SELECT day, m FROM dm ORDER BY m DESC, day LIMIT 20)"


def top_days(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    by = P.orders(spark, sf).groupBy("day").agg(F.max("total").alias("m"))
    return by, by.orderBy(F.desc("m"), "day").limit(20)


@query(f"{ORD}, {TOP} SELECT day, m FROM tp")
def top_k_days(spark, sf):
    return top_days(spark, sf)[1]


@query(f"{ORD}, {TOP} SELECT tp.day, tp.m, greatest(coalesce(a.m, 0), coalesce(b.m, 0)) AS near, (greatest(coalesce(a.m, 0), coalesce(b.m, 0)) >= 400) AS spell FROM tp LEFT JOIN dm a ON a.day = tp.day - 1 LEFT JOIN dm b ON b.day = tp.day + 1")
def storm_neighbours(spark, sf):
    by, top = top_days(spark, sf)
    near = lambda k, name: by.select(F.date_add("day", k).alias("day"), F.col("m").alias(name))
    out = top.join(near(1, "before"), "day", "left").join(near(-1, "after"), "day", "left")
    near_m = F.greatest(F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0)))
    return out.select("day", "m", near_m.alias("near"), (near_m >= 400).alias("spell"))


@query(f"{SER} " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {q6(f'corr({a}, {b})', 'r')}, (abs(corr({a}, {b})) >= 0.05) AS strong FROM se" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]))
def correlation_pairs(spark, sf):
    pairs = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]
    own = P.series(spark, sf).agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    out = own.select(F.inline(F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))
    return r6(out.withColumn("strong", F.abs("r") >= 0.05), "r")


ANOM = "ds AS (SELECT day, avg(hi) AS v FROM se GROUP BY day), an AS (SELECT day, v, v - avg(v) OVER (PARTITION BY month(day)) AS x FROM ds), lg AS (SELECT a.day, a.x, a.v, b.x AS x1, b.v AS v1, c.x AS x2 FROM an a LEFT JOIN an b ON b.day = a.day - 1 LEFT JOIN an c ON c.day = a.day - 2)"


def mean_series(spark: SparkSession, sf: str, lags: int = 3) -> DataFrame:
    """The entities' mean by day with its anomaly, and both some days before."""
    own = stats.anomalies(P.series(spark, sf).groupBy("day").agg(F.avg("hi").alias("v")), "v")
    out = own
    for k in range(1, lags + 1):
        out = out.join(own.select(F.date_add("day", k).alias("day"), F.col("anom").alias(f"x{k}"), F.col("v").alias(f"v{k}")), "day", "left")
    return out


@query(f"{SER}, {ANOM} SELECT {q6('corr(v, v1)', 'raw')}, {q6('corr(x, x1)', 'adjusted')} FROM lg")
def autocorrelation(spark, sf):
    return r6(mean_series(spark, sf).agg(F.corr("v", "v1").alias("raw"), F.corr("anom", "x1").alias("adjusted")), "raw", "adjusted")


def sql_partial(x: str, y: str, controls: list[str], rows: str) -> str:
    """SQL for r (partial correlation), b (the coefficient of y in x on y and the controls) and n, controls taken out one at a time."""
    v = [x, y, *controls]
    k = len(v)
    cells = [f"corr({v[i]}, {v[j]}) AS r{i}_{j}" for i in range(k) for j in range(i + 1, k)] + [f"stddev_pop({v[i]}) AS s{i}" for i in range(2)] + ["count(*)::BIGINT AS n"]
    out = f"SELECT {', '.join(cells)} FROM {rows} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in v)}"
    for z in range(k - 1, 1, -1):
        cells = [f"(r{i}_{j} - r{i}_{z} * r{j}_{z}) / sqrt((1 - r{i}_{z} * r{i}_{z}) * (1 - r{j}_{z} * r{j}_{z})) AS r{i}_{j}" for i in range(z) for j in range(i + 1, z)]
        out = f"SELECT {', '.join(cells + [f's{i} * sqrt(1 - r{i}_{z} * r{i}_{z}) AS s{i}' for i in range(2)])}, n FROM ({out})"
    return f"SELECT r0_1 AS r, r0_1 * s0 / s1 AS b, n FROM ({out})"


LAGGED = "lg AS (SELECT a.day, a.x, a.v, b1.v AS v1, " + ", ".join(f"b{k}.x AS x{k}" for k in range(1, 8)) + " FROM an a " + " ".join(f"LEFT JOIN an b{k} ON b{k}.day = a.day - {k}" for k in range(1, 8)) + ")"
ANOM7 = ANOM[: ANOM.index(", lg AS")] + f", {LAGGED}"


@query(f"{SER}, {ANOM7} SELECT {q6('r', 'r')} FROM ({sql_partial('x', 'x4', ['x1', 'x2', 'x3'], 'lg')})")
def partial_correlation(spark, sf):
    """Of a day and the fourth before it, the three between held."""
    return r6(spark.createDataFrame([(stats.partial_correlation(mean_series(spark, sf, 4), "anom", "x4", ["x1", "x2", "x3"]),)], "r double"), "r")


@query(f"{SER}, {ANOM7} " + " UNION ALL ".join(f"SELECT {p}::BIGINT AS lag, {q6('b', 'pacf')} FROM ({sql_partial('x', f'x{p}', [f'x{k}' for k in range(1, p)], 'lg')})" for p in range(1, 8)))
def pacf(spark, sf):
    got = stats.pacf(mean_series(spark, sf, 7), "anom", [f"x{k}" for k in range(1, 8)])
    return r6(spark.createDataFrame([(k + 1, v) for k, v in enumerate(got)], "lag long, pacf double"), "pacf")


def sql_screening() -> str:
    at = lambda c, k: f"max({c}) OVER (PARTITION BY city ORDER BY day RANGE BETWEEN INTERVAL {k} DAY PRECEDING AND INTERVAL {k} DAY PRECEDING)"
    names, cells = calendar.lag_names(["hi", "price"], deltas=["price"]), []
    for name in names:
        c, how = name.rsplit("_", 1)
        if how.startswith("lag"):
            cells.append(f"{at(c, how[3:])} AS {name}")
        elif how.startswith("mean"):
            n = int(how[4:-1])
            three = [c, *(at(c, k) for k in range(1, n))]
            cells.append(f"({' + '.join(three)}) / {n}.0::DOUBLE AS {name}")
        else:
            cells.append(f"{c} - {at(c, 1)} AS {name}")
    rows = f"{SER}, ft AS (SELECT *, sin(2 * pi() * dayofyear(day) / 365.25) AS s, cos(2 * pi() * dayofyear(day) / 365.25) AS c, {', '.join(cells)} FROM se)"
    each = [f"SELECT '{f}' AS feature, n, (SELECT {q6(f'corr({f}, hi_next)', 'corr')} FROM ft WHERE hi IS NOT NULL AND {f} IS NOT NULL) AS corr, {q6('r', 'partial')}, abs(r) >= 0.05 AS useful FROM ({sql_partial(f, 'hi_next', ['hi', 's', 'c'], 'ft')})" for f in names]
    return f"{rows} " + " UNION ALL ".join(each)


@query(sql_screening())
def lag_screening(spark, sf):
    """Lag features by their partial correlation with the next day, today and season held."""
    own = calendar.with_lags(P.series(spark, sf), ["hi", "price"], deltas=["price"])
    s, c = S.season(F.col("day"))
    rows = own.withColumn("s", s).withColumn("c", c).cache()
    got = stats.screening(rows, calendar.lag_names(["hi", "price"], deltas=["price"]), "hi_next", ["hi", "s", "c"])
    rows.unpersist()
    return r6(spark.createDataFrame(got, "feature string, n long, corr double, partial double, useful boolean"), "corr", "partial")


# ---- evaluation

CODED = "cd AS (SELECT city, day, CASE level_next " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(S.LEVELS)) + " END AS y, CASE level " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(S.LEVELS)) + " END AS p, hi FROM sp WHERE split = 'test' AND level_next IS NOT NULL)"
GRID = "gr AS (SELECT t.range::INT AS truth, g.range::INT AS guess, count(y)::BIGINT AS n FROM range(5) t CROSS JOIN range(5) g LEFT JOIN cd ON y = t.range AND p = g.range GROUP BY ALL)"
CLASSES = "ra AS (SELECT truth AS label, sum(n) AS support, sum(CASE WHEN truth = guess THEN n ELSE 0 END) AS hit FROM gr GROUP BY 1), ca AS (SELECT guess AS label, sum(n) AS predicted FROM gr GROUP BY 1), pc AS (SELECT *, coalesce(hit / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall FROM ra JOIN ca USING (label)), pf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pc)"
BASE = f"{SER}, {DAYS}, {START}, {SPLIT}, {CODED}"


def tested(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows with the code of tomorrow's level (y) and, as persistence has it, of today's (p)."""
    own = split_series(spark, sf).where("split = 'test' and level_next is not null")
    return own.withColumn("y", S.level_code(F.col("level_next"))).withColumn("p", S.level_code(F.col("level")))


@query(f"{BASE}, {GRID} SELECT truth, guess, n, CASE WHEN sum(n) OVER (PARTITION BY truth) > 0 THEN {sql_round('n / (sum(n) OVER (PARTITION BY truth))::DOUBLE', 6)} END AS share FROM gr")
def confusion_matrix(spark, sf):
    return r6(evaluate.confusion(tested(spark, sf), "y", "p", range(5)), "share")


@query(f"{BASE}, {GRID}, {CLASSES} SELECT label, {q6('precision', 'precision')}, {q6('recall', 'recall')}, {q6('f1', 'f1')}, support::BIGINT AS support FROM pf")
def per_class_metrics(spark, sf):
    own = evaluate.per_class(evaluate.confusion(tested(spark, sf), "y", "p", range(5)))
    return r6(own.select("label", "precision", "recall", "f1", "support"), "precision", "recall", "f1")


SCORES = f"{q6('avg(f1) FILTER (support > 0)', 'macro_f1')}, {q6('sum(f1 * support) / sum(support)', 'weighted_f1')}, {q6('sum(hit) / sum(support)::DOUBLE', 'accuracy')}, {q6('avg(recall) FILTER (support > 0)', 'balanced_accuracy')}, {q6('avg(precision) FILTER (support > 0)', 'macro_precision')}, {q6('avg(recall) FILTER (support > 0)', 'macro_recall')}, {q6('max(precision) FILTER (label = 3)', 'focus_precision')}, {q6('max(recall) FILTER (label = 3)', 'focus_recall')}, {q6('max(f1) FILTER (label = 3)', 'focus_f1')}, {q6('(max(predicted) FILTER (label = 3) - max(hit) FILTER (label = 3)) / (sum(support) - max(support) FILTER (label = 3))::DOUBLE', 'focus_false_alarm')}"


def scored(rows: DataFrame, guess: str = "p", present: str = "truth") -> DataFrame:
    own = evaluate.scores(evaluate.confusion(rows, "y", guess, range(5)), 3, present)
    return r6(own, *own.columns)


@query(f"{BASE}, {GRID}, {CLASSES} SELECT {SCORES} FROM pf")
def score_block(spark, sf):
    return scored(tested(spark, sf))


@query(f"{BASE}, {GRID}, u AS (SELECT truth AS l FROM gr WHERE n > 0 UNION SELECT guess FROM gr WHERE n > 0), k AS (SELECT l, row_number() OVER (ORDER BY l) AS i FROM u), r AS (SELECT truth, sum(n) AS rn FROM gr GROUP BY 1 HAVING sum(n) > 0), c AS (SELECT guess, sum(n) AS cn FROM gr GROUP BY 1 HAVING sum(n) > 0) SELECT {q6('1 - sum((a.i - b.i) * (a.i - b.i) * n) * sum(n) / sum((a.i - b.i) * (a.i - b.i) * rn * cn)::DOUBLE', 'kappa')} FROM gr JOIN r USING (truth) JOIN c USING (guess) JOIN k a ON a.l = truth JOIN k b ON b.l = guess")
def quadratic_kappa(spark, sf):
    return r6(evaluate.quadratic_kappa(evaluate.confusion(tested(spark, sf), "y", "p", range(5))), "kappa")


@query(f"{BASE}, x AS (SELECT c.range AS c, (y = c.range)::INT AS t, CASE WHEN c.range <= 2 THEN -hi ELSE hi END AS s FROM cd, range(5) c), k AS (SELECT c, t, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0::DOUBLE AS r FROM x), a AS (SELECT c, (sum(r) FILTER (t = 1) - sum(t) * (sum(t) + 1) / 2.0::DOUBLE) / nullif(sum(t) * sum(1 - t), 0) AS auc FROM k GROUP BY c) SELECT {q6('avg(auc)', 'auc')}, count(auc)::BIGINT AS n_classes FROM a")
def auc_one_vs_rest(spark, sf):
    """Ranking by today's heat index, downwards for the milder levels."""
    rows = tested(spark, sf).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("s", F.when(F.col("c") <= 2, -F.col("hi")).otherwise(F.col("hi")))
    return r6(evaluate.auc(rows, F.col("y") == F.col("c"), "s", ["c"]).agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_classes")), "auc")


MAJORITY = "mj AS (SELECT arg_min(code, (-c, code)) AS p0 FROM (SELECT code, count(*) AS c FROM sp JOIN (SELECT * FROM " + LEVELS_SQL + ") l ON l.level = level_next WHERE split = 'train' GROUP BY code))"


def trained_codes(spark: SparkSession, sf: str) -> DataFrame:
    return split_series(spark, sf).where("split = 'train' and level_next is not null").withColumn("y", S.level_code(F.col("level_next"))).withColumn("m", F.month(F.date_add("day", 1)))


def majority(codes: DataFrame, *by: str) -> DataFrame:
    """The most frequent code (the mildest of several) of each group."""
    counts = codes.groupBy(*by, "y").count()
    return counts.groupBy(*by).agg(F.min_by("y", F.struct(-F.col("count"), F.col("y"))).alias("major"))


@query(f"{BASE}, {MAJORITY}, ce2 AS (SELECT * FROM cd), cdm AS (SELECT y, p0 AS p FROM ce2, mj), {GRID.replace('LEFT JOIN cd', 'LEFT JOIN cdm')}, {CLASSES} SELECT {SCORES.replace('support > 0', 'support > 0 OR predicted > 0', 1)} FROM pf")
def baseline_majority(spark, sf):
    """Training's majority class for every test row; macro-F1 over classes in truth or prediction."""
    rows = tested(spark, sf).crossJoin(F.broadcast(majority(trained_codes(spark, sf))))  # one row
    own = evaluate.confusion(rows, "y", "major", range(5))
    either, truth = evaluate.scores(own, 3, "either"), evaluate.scores(own, 3)
    out = truth.drop("macro_f1").crossJoin(either.select("macro_f1"))  # one row each
    return r6(out, *out.columns)


MONTHS = f"mm AS (SELECT month(day + 1) AS m, code, count(*) AS c FROM sp JOIN (SELECT * FROM {LEVELS_SQL}) l ON l.level = level_next WHERE split = 'train' GROUP BY ALL), mo AS (SELECT m, arg_min(code, (-c, code)) AS p1 FROM mm GROUP BY m)"


@query(f"{BASE}, {MAJORITY}, {MONTHS}, cdm AS (SELECT y, coalesce(p1, p0) AS p FROM cd CROSS JOIN mj LEFT JOIN mo ON mo.m = month(day + 1)), {GRID.replace('LEFT JOIN cd', 'LEFT JOIN cdm')}, {CLASSES} SELECT {SCORES} FROM pf")
def baseline_climatology(spark, sf):
    train = trained_codes(spark, sf)
    by_month = majority(train, "m").withColumnRenamed("major", "by_month")
    rows = tested(spark, sf).withColumn("m", F.month(F.date_add("day", 1))).join(F.broadcast(by_month), "m", "left").crossJoin(F.broadcast(majority(train)))  # 12 rows and one
    return scored(rows.withColumn("g", F.coalesce("by_month", "major")), "g")


@query(f"{SER}, {DAYS}, {FOLDS}, {SIDES}, a AS (SELECT fold, avg((level = level_next)::INT) AS acc FROM fr WHERE side = 'test' AND level_next IS NOT NULL GROUP BY fold) SELECT 'accuracy' AS metric, {q6('avg(acc)', 'mean')}, {q6('stddev_samp(acc)', 'sd')} FROM a")
def persistence_over_folds(spark, sf):
    by = in_folds(spark, sf).where("side = 'test' and level_next is not null").groupBy("fold").agg(F.avg((F.col("level") == F.col("level_next")).cast("double")).alias("accuracy"))
    return r6(evaluate.over_folds(by, ["accuracy"]), "mean", "sd")


# ---- preparation and models


@query(f"{SER}, {DAYS}, {START}, {SPLIT}, m AS (SELECT avg(price) AS a, stddev_pop(price) AS s, median(disc) AS d FROM sp WHERE split = 'train'), z AS (SELECT avg(ln(1 + greatest(coalesce(nullif(n, 3), nn)::DOUBLE, 0))) AS a, stddev_pop(ln(1 + greatest(coalesce(nullif(n, 3), nn)::DOUBLE, 0))) AS s FROM sp, (SELECT median(nullif(n, 3)) AS nn FROM sp WHERE split = 'train') WHERE split = 'train'), nm AS (SELECT median(nullif(n, 3)) AS nn FROM sp WHERE split = 'train') SELECT city, day, {q6('(price - m.a) / m.s', 'z_price')}, {q6('(ln(1 + greatest(coalesce(nullif(n, 3), nn)::DOUBLE, 0)) - z.a) / z.s', 'z_n')} FROM sp, m, z, nm WHERE split = 'test'")
def scaled_features(spark, sf):
    """Median fill, logs and standard scores fitted on training rows; n is made null where it is 3."""
    own = split_series(spark, sf).withColumn("n", F.nullif(F.col("n"), F.lit(3)))
    prep = prepare.Preparer(["price", "n"], logs=["n"]).fit(own.where("split = 'train'"))
    return r6(prep.transform(own.where("split = 'test'")).select("city", "day", "z_price", "z_n"), "z_price", "z_n")


@query(f"{ORD} SELECT max(abs(total - n)) AS max_gap, count(*) FILTER (abs(total - n) > 100)::BIGINT AS n_over FROM od".replace("max(abs(total - n))", "round(max(abs(total - n)), 6)"))
def column_gap(spark, sf):
    """The check of precipitation against rain, on two columns of orders."""
    return r6(rules.gap(P.orders(spark, sf), "total", "n", 100), "max_gap")


@query(f"{ORD} SELECT city, count(*)::BIGINT AS n FROM od a WHERE NOT EXISTS (SELECT 1 FROM od b WHERE b.city = a.city AND b.day = a.day + 1) GROUP BY city")
def without_following(spark, sf):
    return calendar.without_following(P.orders(spark, sf))


@query("SELECT count(*) FILTER (o_orderdate < before)::BIGINT AS n_unsorted FROM (SELECT o_orderdate, lag(o_orderdate) OVER () AS before FROM orders)")
def unsorted_rows(spark, sf):
    return rules.unsorted(P.table(spark, sf, "orders"), ["o_orderdate"])


@query(f"{ORD} SELECT city, {q6('median(n)', 'median')}, count(DISTINCT n)::BIGINT AS n_values, arg_min(n, day)::BIGINT AS first FROM od GROUP BY city")
def constant_per_city(spark, sf):
    return r6(calendar.constant_of(P.orders(spark, sf), "n"), "median")


@query(f"{SER} SELECT city, day, {q6('sin(2 * pi() * dayofyear(day) / 365.25)', 'season_sin')}, {q6('cos(2 * pi() * dayofyear(day) / 365.25)', 'season_cos')}, month(day)::INT AS month, dayofyear(day)::INT AS doy FROM se")
def cyclic_season(spark, sf):
    s, c = S.season(F.col("day"))
    return r6(P.series(spark, sf).select("city", "day", s.alias("season_sin"), c.alias("season_cos"), F.month("day").alias("month"), F.dayofyear("day").alias("doy")), "season_sin", "season_cos")


@query(f"{SER} SELECT city, day, (city = 'A')::INT::DOUBLE AS \"is_A\", (city = 'R')::INT::DOUBLE AS \"is_R\" FROM se")
def one_hot(spark, sf):
    own = P.series(spark, sf)
    prep = prepare.Preparer([], entity="city")
    prep.names = sorted(r[0] for r in own.where("city <> 'N'").select("city").distinct().collect())  # N was not in training: all zeros
    return prep.transform(own).select("city", "day", "is_A", "is_R")


@query(f"{SER} SELECT city, day, {'CASE level ' + ' '.join(f'WHEN $${x}$$ THEN {i}' for i, x in enumerate(S.LEVELS)) + ' END'} AS five, {'CASE level ' + ' '.join(f'WHEN $${x}$$ THEN {i}' for x, i in zip(S.LEVELS, (0, 0, 1, 2, 2), strict=True)) + ' END'} AS three FROM se".replace("$$", "'"))
def target_encode(spark, sf):
    return P.series(spark, sf).select("city", "day", prepare.encode(F.col("level")).alias("five"), prepare.encode(F.col("level"), "three_class").alias("three"))


@query()
def model_cross_validation(spark, sf):
    """Multinomial logistic regression over five expanding folds, lags and season as inputs."""
    own = calendar.with_lags(P.series(spark, sf), ["hi"], means=())
    s, c = S.season(F.col("day"))
    rows = own.withColumn("s", s).withColumn("c", c).where("level_next is not null").withColumn("y", S.level_code(F.col("level_next")))
    folds = splits.expanding(rows)
    out = prepare.cross_validate(rows, folds, lambda: prepare.Preparer(["hi", "hi_lag1", "hi_lag2", "hi_lag3", "s", "c"], entity="city"), "y", c=0.1, power=0.25)
    return out.select("fold", "macro_f1", "accuracy", "focus_recall", "kappa")


# ---- sources

PLAN = "pl AS (SELECT city, y AS year, greatest(make_date(y, 1, 1), DATE '2015-03-10') AS first, least(make_date(y, 12, 31), DATE '2018-12-29') AS last FROM (SELECT DISTINCT o_orderpriority AS city FROM orders), range(2015, 2019) t(y))"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    import datetime as dt

    cities = P.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("city")).distinct()
    return archive.plan(cities, dt.date(2015, 3, 10), dt.date(2018, 12, 29))


@query(f"WITH {PLAN} SELECT city, year::INT AS year, first, last, (last - first + 1)::BIGINT AS n_days, {q6('greatest(1.0::DOUBLE, 1.0, (last - first + 1) / 14.0::DOUBLE * 1.0)', 'weight')} FROM pl")
def chunk_plan(spark, sf):
    days = F.datediff("last", "first") + 1
    return r6(chunks(spark, sf).select("city", "year", "first", "last", days.cast("long").alias("n_days"), S.call_weight(days, F.lit(len(archive.VARIABLES))).alias("weight")), "weight")


@query(f"WITH {PLAN} SELECT city, year::INT AS year, first, last FROM pl WHERE NOT (year % 2 = 0 AND city < '3')")
def pending_chunks(spark, sf):
    own = chunks(spark, sf)
    return archive.pending(own, own.where("year % 2 = 0 and city < '3'").select("city", "first", "last")).select("city", "year", "first", "last")


@query(f"SELECT event_id, {q6('sum(value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)', 'spent')} FROM events WHERE event_type = 'click'")
def budget_window(spark, sf):
    """Weights spent in the hour up to each call: a range frame by user day would split it, so calls are dealt by day with the hour before repeated."""
    own = P.table(spark, sf, "events").where("event_type = 'click'").select("event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("t"), "value")
    day = 86_400_000_000
    dealt = own.withColumn("d", F.explode(F.array_distinct(F.array(F.floor(F.col("t") / day), F.floor((F.col("t") + 3_600_000_000) / day)))))
    spent = F.sum("value").over(W.partitionBy("d").orderBy("t").rangeBetween(-3_600_000_000, 0))
    return r6(dealt.withColumn("spent", spent).where(F.col("d") == F.floor(F.col("t") / day)).select("event_id", "spent"), "spent")


@query(f"{ORD} SELECT city, year(day)::INT AS year, count(*)::BIGINT AS n, min(day) AS first, max(day) AS last FROM od GROUP BY ALL")
def completeness_probe(spark, sf):
    return archive.completeness(P.orders(spark, sf))


@query(f"{ORD}, u AS (SELECT city, day, total FROM od UNION ALL SELECT city, day, total FROM od WHERE total > 300) SELECT coalesce(city, 'ALL') AS city, count(*)::BIGINT AS n, count(DISTINCT day)::BIGINT AS n_days FROM u GROUP BY ROLLUP (city)")
def union_and_totals(spark, sf):
    own = P.orders(spark, sf).select("city", "day", "total")
    both = own.unionByName(own.where("total > 300"))
    return both.rollup("city").agg(F.count("*").alias("n"), F.count_distinct("day").alias("n_days")).select(F.coalesce("city", F.lit("ALL")).alias("city"), "n", "n_days")


@query(f"{ORD} SELECT city, count(*) FILTER (seen)::BIGINT AS n_both, count(*) FILTER (NOT seen)::BIGINT AS n_only FROM (SELECT city, day IN (SELECT day FROM s0) AS seen FROM od, (SELECT 1)) GROUP BY city".replace(ORD, f"{ORD}, s0 AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag = 'A')"))
def day_sets(spark, sf):
    """Days in common with another series, and days of one only, by semi and anti joins."""
    own = P.orders(spark, sf)
    other = P.table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.to_date("l_shipdate").alias("day")).distinct()
    both = own.join(other, "day", "left_semi").groupBy("city").agg(F.count("*").alias("n_both"))
    only = own.join(other, "day", "left_anti").groupBy("city").agg(F.count("*").alias("n_only"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.join(only, "city", "full_outer").select("city", zero("n_both"), zero("n_only"))
