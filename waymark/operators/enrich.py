"""Elevation of points from a keyed table, and the counters that go with it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import round_half_up, truthy


def with_elevation(points: DataFrame, known: DataFrame) -> DataFrame:
    """Fills a null elev_ft from (mile_tenths, elev_ft). Whole tenths are the key, as texts of
    the same mile differ between writers."""
    key = round_half_up(F.col("mile") * 10).cast("long")
    return (
        points.withColumn("_k", key)
        .join(known.groupBy(F.col("mile_tenths").cast("long").alias("_k")).agg(F.min("elev_ft").alias("_e")), "_k", "left")
        .withColumns({"cache_hit": F.col("_e").isNotNull(), "elev_ft": F.coalesce("elev_ft", "_e")})
        .drop("_k", "_e")
    )


def pending(points: DataFrame) -> DataFrame:
    """Points still to be looked up."""
    return points.where(F.col("elev_ft").isNull())


def elevation_range(points: DataFrame) -> DataFrame:
    """Lowest and highest elevation; 0 stands for unknown and is left out."""
    return points.where(truthy(F.col("elev_ft"), "int")).agg(F.min("elev_ft").alias("min_ft"), F.max("elev_ft").alias("max_ft"), F.count(F.lit(1)).alias("n"))


def cache_counts(enriched: DataFrame) -> DataFrame:
    return enriched.agg(F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"))


def far_anchors(anchors: DataFrame, limit_miles: float, examples: int = 5) -> DataFrame:
    """One row: how many anchors lie farther from the path than a limit, and the first few of them."""
    far = anchors.where(F.col("vertex_miles") > limit_miles)
    few = far.orderBy("ord").limit(examples).agg(F.array_sort(F.collect_list("ord")).alias("examples"))
    return far.agg(F.count(F.lit(1)).alias("far")).join(F.broadcast(few))
