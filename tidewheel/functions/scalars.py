"""Column functions: heat index, levels, rounding, calendar, geography, names."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels from mild to severe, and the lower bound of each but the first.
LEVELS = ("Not Hazardous", "Caution", "Extreme Caution", "Danger", "Extreme Danger")
BOUNDS = (27.0, 33.0, 42.0, 52.0)
#: Published regression of the heat index, coefficient -> powers of temperature (degrees Fahrenheit) and humidity (%).
REGRESSION = {
    -42.379: (0, 0), 2.04901523: (1, 0), 10.14333127: (0, 1), -0.22475541: (1, 1), -0.00683783: (2, 0),
    -0.05481717: (0, 2), 0.00122874: (2, 1), 0.00085282: (1, 2), -0.00000199: (2, 2),
}


def half_even(x: Column, places: int = 2) -> Column:
    """Rounded to `places` decimals, ties to even after scaling."""
    scale = float(10**places)
    return F.rint(x * scale) / scale


def clean(x: Column) -> Column:
    """NaN to null; the panel knows null only."""
    return F.when(~F.isnan(x), x)


def heat_index(celsius: Column, humidity: Column) -> Column:
    """Heat index in degrees Celsius; null unless -90 <= celsius <= 60 and 0 <= humidity <= 100."""
    t, r = celsius * 9.0 / 5.0 + 32.0, humidity
    simple = (t + 61.0 + (t - 68.0) * 1.2 + r * 0.094) * 0.5
    terms = [reduce(lambda a, b: a * b, [F.lit(c)] + [t] * i + [r] * j) for c, (i, j) in REGRESSION.items()]
    full = reduce(lambda a, b: a + b, terms)
    dry = F.when((r < 13) & t.between(80, 112), -((13.0 - r) / 4.0) * F.sqrt(F.greatest((17.0 - F.abs(t - 95.0)) / 17.0, F.lit(0.0)))).otherwise(0.0)
    humid = F.when((r > 85) & t.between(80, 87), ((r - 85.0) / 10.0) * ((87.0 - t) / 5.0)).otherwise(0.0)
    fahrenheit = F.when((simple + t) / 2.0 >= 80, full + dry + humid).otherwise(simple)
    return F.when(celsius.between(-90, 60) & humidity.between(0, 100), (fahrenheit - 32.0) * 5.0 / 9.0)


def heat_level(index: Column) -> Column:
    """The level of a heat index, lower bounds inclusive; null stays null."""
    out = F.when(index < BOUNDS[0], LEVELS[0])
    for bound, level in zip(BOUNDS[1:], LEVELS[1:], strict=False):
        out = out.when(index < bound, level)
    return out.when(index >= BOUNDS[-1], LEVELS[-1])


def level_code(level: Column) -> Column:
    """0 for the mildest level to 4; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)) - 1


def day_number(day: Column) -> Column:
    """Days since 1970, on which calendar frames are ranges."""
    return F.unix_date(day)


def season(day: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year."""
    angle = F.dayofyear(day) * (2 * math.pi) / 365.25
    return F.sin(angle), F.cos(angle)


def log1p_of(x: Column) -> Column:
    """log(1 + x), negative x as zero."""
    return F.log1p(F.greatest(x, F.lit(0.0)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371.0088 km."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.asin(F.sqrt(a)) * (2 * 6371.0088)


def city_name(raw: Column) -> Column:
    """A name without 'City of' before it or 'City' after it."""
    short = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^.*?\bCity of\s+", ""), r"\s+City$", ""))
    #: Spellings.
    for old, new in {"Cagayan De Oro": "Cagayan de Oro", "San Jose Del Monte": "San Jose del Monte", "Sto. Tomas": "Santo Tomas"}.items():
        short = F.when(short == old, new).otherwise(short)
    return short


def cell_label(lat: Column, lon: Column) -> Column:
    return F.format_string("%.2fN/%.2fE", lat, lon)


def call_weight(days: Column, variables: Column, models: int = 1) -> Column:
    """Weighted calls of a request, one at least."""
    per_fortnight = variables * max(models, 1) / 10.0
    return F.greatest(F.lit(1.0), per_fortnight, days / 14.0 * per_fortnight)
