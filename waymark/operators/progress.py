"""Progress of users along trails: one aggregation per trail, joined to the catalog."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import percent, segment_miles


def trail_totals(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Miles, sessions, trail days, first and last date per key.

    Overlapping sections count twice. A day is a distinct ``date_begun``; the last date is
    null unless there are two distinct ones. Sums are map-side combined, so only one row for
    each key and task is shuffled.
    """
    days = F.count_distinct("date_begun")
    return (
        segments.withColumn("_miles", segment_miles())
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("_miles"), F.lit(0.0)).alias("miles"),
            F.count(F.lit(1)).alias("sessions"),
            days.alias("trail_days"),
            F.min("date_begun").alias("first_date"),
            F.when(days > 1, F.max("date_begun")).alias("last_date"),
        )
    )


def dashboard(segments: DataFrame, trails: DataFrame) -> DataFrame:
    """Every trail of the catalog with its totals; trails without sections show zero."""
    totals = trail_totals(segments, ["trail_id"])
    return (
        trails.join(totals, trails["id"] == totals["trail_id"], "left")
        .select(
            trails["id"].alias("trail_id"),
            F.coalesce("miles", F.lit(0.0)).alias("miles"),
            F.coalesce("sessions", F.lit(0)).cast("long").alias("sessions"),
            F.coalesce("trail_days", F.lit(0)).cast("long").alias("trail_days"),
            "first_date",
            "last_date",
            trails["total_miles"].alias("total_miles"),
        )
        .withColumn("pct", percent(F.col("miles"), F.col("total_miles")))
    )


def state_mile_ranges(points: DataFrame) -> DataFrame:
    """Lowest and highest mile per state with the rank of its first appearance by mile."""
    return (
        points.where(F.col("state").isNotNull() & (F.col("state") != ""))
        .groupBy("state")
        .agg(
            F.min("mile").alias("min_mile"),
            F.max("mile").alias("max_mile"),
            F.min(F.struct(F.coalesce("mile", F.lit(0.0)).alias("m"), F.col("ord").alias("o"))).alias("first"),
        )
    )


def points_per_state(points: DataFrame) -> DataFrame:
    """Points per state with the first ordinal, by which either listing order is had."""
    return points.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def most_points_first(points: DataFrame) -> DataFrame:
    """Points per state, the state with most points first and the earlier one on ties."""
    return points_per_state(points).orderBy(F.col("n").desc(), "first_ord")


def path_length(raw: DataFrame) -> DataFrame:
    """Total surveyed miles, a missing length counting as none."""
    return raw.agg(F.sum(F.coalesce("length_mi", F.lit(0.0))).alias("total_miles"))


def run_totals(runs: DataFrame) -> DataFrame:
    """Number of runs and of coordinates over all of them."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.sum(F.size("coords")).alias("coords"))
