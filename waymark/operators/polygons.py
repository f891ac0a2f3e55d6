"""Classification of points by polygons: edges, bounding boxes, containment.

Edges are rows (feature_idx, state, poly_idx, ring_idx, xi, yi, xj, yj); ring 0 of a polygon is
the outer one, others are holes. No ring is ever gathered: a polygon of any size is dealt by
bands of latitude.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.labels import merge_border_state

#: Degrees of the grid by which points meet the boxes of polygons, and of the bands of edges.
CELL, BAND = 1.0, 0.25


def bounding_boxes(edges: DataFrame) -> DataFrame:
    """(feature_idx, state, min_lon, max_lon, min_lat, max_lat) of each feature."""
    return edges.groupBy("feature_idx", "state").agg(F.min("xi").alias("min_lon"), F.max("xi").alias("max_lon"), F.min("yi").alias("min_lat"), F.max("yi").alias("max_lat"))


def crosses(lon: Column, lat: Column) -> Column:
    """Whether the ray from a point crosses an edge, half open in y. CASE keeps the division from level edges."""
    xi, yi, xj, yj = (F.col(c) for c in ("xi", "yi", "xj", "yj"))
    level = F.when((yi > lat) == (yj > lat), F.lit(False))
    return F.coalesce(level.otherwise(lon < (xj - xi) * (lat - yi) / F.nullif(yj - yi, F.lit(0.0)) + xi), F.lit(False))


def containing_feature(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, found): the first feature, in file order, that contains each (ord, lat, lon).

    Points meet features by grid cells of the feature's box, which is a row without its edges,
    then by the box. Each such pair meets the feature's edges in the point's band of latitude. A
    point is inside a ring that it crosses an odd number of times, and inside a feature if it is
    in the outer ring of some polygon and in none of that polygon's holes.
    """
    span = lambda lo, hi, d: F.explode(F.sequence(F.floor(lo / d), F.floor(hi / d)))
    cells = bounding_boxes(edges).withColumn("_cx", span(F.col("min_lon"), F.col("max_lon"), CELL)).withColumn("_cy", span(F.col("min_lat"), F.col("max_lat"), CELL))
    spots = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("ord", "lat", "lon", F.floor(F.col("lon") / CELL).alias("_cx"), F.floor(F.col("lat") / CELL).alias("_cy"))
    boxed = F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
    pairs = spots.join(cells, ["_cx", "_cy"]).where(boxed).select("ord", "lat", "lon", "feature_idx", F.floor(F.col("lat") / BAND).alias("_band"))
    bands = edges.where("yi <> yj").withColumn("_band", span(F.least("yi", "yj"), F.greatest("yi", "yj"), BAND))
    met = pairs.join(bands, ["feature_idx", "_band"]).where(crosses(F.col("lon"), F.col("lat")))
    rings = met.groupBy("ord", "feature_idx", "state", "poly_idx", "ring_idx").agg((F.count(F.lit(1)) % 2 == 1).alias("hit"))
    polys = rings.groupBy("ord", "feature_idx", "state", "poly_idx").agg(F.bool_or(F.col("hit") & (F.col("ring_idx") == 0)).alias("outer"), F.bool_or(F.col("hit") & (F.col("ring_idx") > 0)).alias("hole"))
    return polys.where("outer and not hole").groupBy("ord").agg(F.min_by("state", "feature_idx").alias("found"))


def reclassify(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Points with the state of their first containing feature; others keep what they had.

    A place is looked up once, however many points stand on it, so points need no key of their own.
    """
    place = F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon"))
    spots = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(place.alias("ord"), "lat", "lon").distinct()
    found = containing_feature(spots, edges).withColumnRenamed("ord", "_place")
    new = merge_border_state(F.col("found"))
    return points.withColumn("_place", place).join(found, "_place", "left").drop("_place").withColumns({
        "matched": F.col("found").isNotNull(),
        "changed": F.col("found").isNotNull() & ~new.eqNullSafe(F.col("state")),
        "state": F.coalesce(new, F.col("state")),
    }).drop("found")


def reclassify_summary(done: DataFrame, examples: int = 5) -> DataFrame:
    """One row: points changed, not matched and in all, and the first few that matched nothing."""
    few = done.where(~F.col("matched")).orderBy("ord").limit(examples).agg(F.array_sort(F.collect_list("ord")).alias("examples"))
    return done.agg(F.count_if("changed").alias("changed"), F.count_if(~F.col("matched")).alias("unmatched"), F.count(F.lit(1)).alias("points")).join(F.broadcast(few))
