"""Distances and the arithmetic of measured sections, as JVM-side column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius in miles; fixed so that distances agree with stored results.
EARTH_MILES = 3958.8


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle miles; null if any coordinate is null."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / F.lit(2.0)), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / F.lit(2.0)), F.lit(2.0))
    # rounding can push antipodes a little above 1, where asin is NaN
    return F.lit(2.0 * EARTH_MILES) * F.asin(F.sqrt(F.when(a > 1.0, F.lit(1.0)).otherwise(a)))


def segment_miles(s: str = "") -> Column:
    """Miles of a section: by its mile markers if it has both, else between its ends."""
    c = lambda n: F.col(f"{s}{n}")
    by_marker = F.abs(c("end_mile") - c("start_mile"))
    return F.coalesce(by_marker, haversine(c("start_lat"), c("start_lng"), c("end_lat"), c("end_lng")))


def round_half_up(x: Column) -> Column:
    """Nearest integer with halves towards positive infinity (round(-2.5) is -2)."""
    return F.floor(x + F.lit(0.5))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def truthy(c: Column, kind: str) -> Column:
    """True for values that count as present: not null, and neither '' nor 0."""
    return c.isNotNull() & (c != (F.lit("") if kind == "string" else F.lit(0)))


def percent(miles: Column, total: Column) -> Column:
    share = miles / F.nullif(total, F.lit(0.0)) * F.lit(100.0)
    return F.when(share > 100.0, F.lit(100.0)).otherwise(share)
