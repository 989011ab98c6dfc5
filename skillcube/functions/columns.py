"""Column expressions shared by the operators."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillcube.config import PRECIPITATION


def nan_to_null(value: Column) -> Column:
    """Missing values are null from the source on; NaN never enters an aggregate."""
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    """Whether a value is there: not null, NaN or infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def filled(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def log1p_precipitation(variable: Column, value: Column) -> Column:
    return F.when(variable == PRECIPITATION, F.log1p(value)).otherwise(value)


def expm1_precipitation(variable: Column, value: Column) -> Column:
    return F.when(variable.startswith("total_precipitation"), F.expm1(value)).otherwise(value)


def season(day: Column) -> Column:
    """Cosine of the day of the year, as a 32-bit float."""
    return F.cos(F.lit(2 * pi) * F.dayofyear(day) / F.lit(365.25)).cast("float")


def week_distance(a: Column, b: Column) -> Column:
    """Distance of two ISO weeks on a ring of 52 (53 coincides with 1)."""
    d = F.abs(a - b)
    return F.least(d, F.lit(52) - d)


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def lat_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def in_box(lat: Column, lon: Column, box) -> Column:
    return lat.between(min(box.lat_min, box.lat_max), max(box.lat_min, box.lat_max)) & lon.between(box.lon_min, box.lon_max)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle angle in radians between points in degrees."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def unit_vector(lat: Column, lon: Column) -> Column:
    la, lo = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))


def gaussian(seed: Column, *key: Column) -> Column:
    """A standard normal draw fixed by its key, whatever the partitioning (Box-Muller of two hashes)."""
    u1 = (F.shiftrightunsigned(F.xxhash64(seed, F.lit(1), *key), 11) + 1) / F.lit(float(2**53 + 1))
    u2 = F.shiftrightunsigned(F.xxhash64(seed, F.lit(2), *key), 11) / F.lit(float(2**53))
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * pi * u2)
