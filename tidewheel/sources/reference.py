"""Pinned reference archives: JSON members of a zip whose digest must match, read on the driver once and handed on as DataFrames; and a preflight for the hourly archive."""

from __future__ import annotations

import hashlib
import json
import zipfile
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.sources.archive import VARIABLES, Fatal


def pinned(content: bytes, sha256: str) -> bytes:
    """content, if it has the digest."""
    if (got := hashlib.sha256(content).hexdigest()) != sha256:
        raise Fatal(f"digest {got}, expected {sha256}")
    return content


def members(spark: SparkSession, content: bytes, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """For each member of a zip its JSON array as a DataFrame of the schema given."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        rows = {n: json.loads(z.read(n)) for n in schemas}
    return {n: spark.createDataFrame([json.dumps(r) for r in rows[n]], "string").select(F.from_json("value", s).alias("r")).select("r.*") for n, s in schemas.items()}


def city_centres(cities: DataFrame, parts: DataFrame) -> DataFrame:
    """Cities (code, name, level, province, latitude, longitude) with the population-weighted centre of their parts (city_code, population, latitude, longitude, source), those of sub-municipalities with the same first five digits included; a city without usable parts keeps its own centre. Names that two cities share get the province."""
    own = cities.where("level = 'City'")
    lower = cities.where("level = 'SubMun'").select(F.substring("code", 1, 5).alias("head"), F.col("code").alias("of"))
    codes = own.select("code", F.col("code").alias("of")).union(own.select("code", F.substring("code", 1, 5).alias("head")).join(lower, "head").select("code", "of")).distinct()
    used = (F.col("source") != "fallback_unverified") & (F.col("population") > 0)
    w = F.when(used, F.col("population").cast("double"))
    mean = lambda c: F.try_divide(F.sum(w * F.col(c)), F.sum(w))
    centre = codes.join(parts.withColumnRenamed("city_code", "of"), "of").groupBy("code").agg(F.count("*").alias("n_parts"), F.count(w).alias("n_used"), mean("latitude").alias("lat"), mean("longitude").alias("lon"))
    name = S.city_name(F.col("name"))
    shared = own.groupBy(name.alias("short")).count().where("count > 1").select("short", F.lit(True).alias("shared"))
    rows = own.withColumn("short", name).join(centre, "code", "left").join(shared, "short", "left")
    both = rows.withColumn("lat", F.coalesce("lat", "latitude")).withColumn("lon", F.coalesce("lon", "longitude"))
    city = F.when(F.col("shared"), F.concat("short", F.lit(" ("), "province", F.lit(")"))).otherwise(F.col("short"))
    shift = S.half_even(S.haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude")))
    return both.select("code", city.alias("city"), S.half_even(F.col("lat"), 5).alias("latitude"), S.half_even(F.col("lon"), 5).alias("longitude"), F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.coalesce("n_used", F.lit(0)).alias("n_used"), shift.alias("shift_km"))


def in_regions(cities: DataFrame, wanted: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Cities whose region has one of the comma-separated names in it, whatever the case; raises with the choices if none does."""
    names = [(aliases or {}).get(x.strip().lower(), x.strip()).lower() for x in wanted.split(",") if x.strip()]
    cond = F.lit(False)
    for n in names:
        cond = cond | F.contains(F.lower("region"), F.lit(n))
    out = cities.where(cond)
    if not out.limit(1).count():
        raise ValueError("no such region; there are: " + "; ".join(sorted(r[0] for r in cities.select("region").distinct().collect())))
    return out


def preflight(payload: dict, latitude: float, longitude: float) -> None:
    """Raise if a short test payload has a variable without any value, or lies over half a degree off."""
    empty = [v for v in VARIABLES if all(x is None for x in payload["hourly"].get(v) or [None])]
    if empty:
        raise Fatal(f"no values of {', '.join(empty)}")
    if abs(payload["latitude"] - latitude) > 0.5 or abs(payload["longitude"] - longitude) > 0.5:
        raise Fatal("the grid point is over half a degree off")
