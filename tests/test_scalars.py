import math

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("f", "rh", "want"), [(90, 70, 105.922), (100, 40, 109.2556), (96, 60, 116.1312), (86, 80, 99.8007), (95, 90, 146.6031), (110, 10, 104.389), (84, 95, 100.8817), (104, 50, 130.5823)])
def test_published_heat_indices(spark, f, rh, want):
    got = one(spark, S.heat_index(F.lit((f - 32) * 5 / 9), F.lit(float(rh))))
    assert got * 9 / 5 + 32 == pytest.approx(want, abs=1e-3)


def test_invalid_inputs_are_null(spark):
    rows = [(None, 50.0), (30.0, None), (30.0, 101.0), (61.0, 50.0), (-91.0, 50.0), (float("nan"), 50.0), (30.0, -1.0)]
    df = spark.createDataFrame(rows, "t double, r double").select(S.heat_index(S.clean(F.col("t")), F.col("r")).alias("x"))
    assert all(r.x is None for r in df.collect())


def test_levels_include_their_lower_bound(spark):
    rows = [(26.99, 0), (27.0, 1), (32.99, 1), (33.0, 2), (41.99, 2), (42.0, 3), (51.99, 3), (52.0, 4), (-5.0, 0), (None, None)]
    df = spark.createDataFrame(rows, "x double, want int").withColumn("level", S.heat_level(F.col("x")))
    assert all(r.want == r.got and (r.got is None or r.level == S.LEVELS[r.got]) for r in df.withColumn("got", S.level_code(F.col("level"))).collect())
    assert one(spark, S.level_code(F.lit("Balmy"))) is None


def test_half_even(spark):
    for x, want in ((0.285, 0.28), (0.125, 0.12), (0.375, 0.38), (2.5, 2.5), (-0.125, -0.12)):
        assert one(spark, S.half_even(F.lit(x))) == want
    assert one(spark, S.half_even(F.lit(None).cast("double"))) is None


def test_city_names(spark):
    names = {"City of Davao": "Davao", "Quezon City": "Quezon", "Island Garden City of Samal": "Samal", "City of Sto. Tomas": "Santo Tomas", "Cagayan De Oro City": "Cagayan de Oro", "Cityville": "Cityville"}
    assert {r.raw: r.x for r in spark.createDataFrame([(n,) for n in names], "raw string").withColumn("x", S.city_name(F.col("raw"))).collect()} == names


def test_small_functions(spark):
    assert one(spark, S.haversine_km(F.lit(14.5), F.lit(121.0), F.lit(14.5), F.lit(121.0))) == 0
    assert one(spark, S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371.0088)
    assert one(spark, S.cell_label(F.lit(14.5), F.lit(121.0))) == "14.50N/121.00E"
    assert one(spark, S.log1p_of(F.lit(-3.0))) == 0
    for days, n, want in ((365, 10, 365 / 14), (3, 10, 1.0), (28, 10, 2.0), (14, 15, 1.5)):
        assert one(spark, S.call_weight(F.lit(days), F.lit(n))) == pytest.approx(want)
