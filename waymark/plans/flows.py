"""The three flows of the application as plans over DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import schema
from waymark.functions.geo import segment_miles
from waymark.functions.labels import parse_number
from waymark.operators import enrich, paths, polygons, progress, snapping, stitch
from waymark.operators.store import Secured, newest_first
from waymark.session import written


def user_dashboard(segments: DataFrame, trails: DataFrame, user) -> DataFrame:
    """Dashboard of one user: the owner filter reaches the scan, then one aggregation."""
    return progress.dashboard(Secured(segments, "segments", user).select(*schema.SEGMENT_SCAN), trails)


def trail_panel(segments: DataFrame, trail: str) -> DataFrame:
    """Totals of one trail and the miles of each of its sections, newest first."""
    own = segments.where(F.col("trail_id") == trail).withColumn("miles", segment_miles())
    return newest_first(own)


def save_requests(requests: DataFrame, points: DataFrame, require_distinct: bool = True, require_date: bool = False) -> tuple[DataFrame, DataFrame]:
    """Typed requests (req_id, start_state, start_text, end_state, end_text, and date_begun if a
    date is required) as accepted and refused rows.

    Both ends are snapped in one pass; accepted rows carry the snapped miles and the states
    crossed, refused ones the first rule that they fail. A null state text asks in no state.
    """
    typed = requests.withColumns({"start_mile": parse_number(F.col("start_text")), "end_mile": parse_number(F.col("end_text"))})
    ends = F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"{e}_mile").alias("qmile"), F.coalesce(f"{e}_state", F.lit("")).alias("qstate")) for e in ("start", "end")])
    asked = typed.select("req_id", F.explode(ends).alias("e")).select(F.struct("req_id", "e.end").alias("qid"), "e.qmile", "e.qstate")
    snapped = snapping.snap_miles(asked, points)
    of = lambda e, c: F.max(F.when(F.col("qid.end") == e, F.col(c)))
    both = snapped.groupBy("qid.req_id").agg(*[of(e, c).alias(n) for e in ("start", "end") for c, n in (("ord", f"{e}_ord"), ("mile", f"{e}_snap_mile"))])
    checked = written(snapping.validate_requests(typed.join(both, "req_id", "left"), require_distinct, require_date))
    good = checked.where(F.col("error").isNull()).select("req_id", F.col("start_snap_mile").alias("start_mile"), F.col("end_snap_mile").alias("end_mile"))
    crossed = snapping.states_for_range(good.select(F.col("req_id").alias("id"), "start_mile", "end_mile"), points)
    return good.join(crossed.withColumnRenamed("id", "req_id"), "req_id", "left"), checked.where(F.col("error").isNotNull()).select("req_id", "error")


def build_points(lines: DataFrame, anchors: DataFrame, terminus: tuple[float, float], known: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Survey lines to classified points: stitch, sample, add elevations, classify.

    lines: (trail_id, ord, coords); anchors: (path_id, ord, mile, lat, lon, state).
    """
    runs = stitch.stitch(lines, terminus).withColumnRenamed("trail_id", "path_id")
    path = paths.global_index(runs).select("path_id", "idx", "run_idx", "lat", "lon")
    points = paths.sample_path(anchors, path).withColumn("elev_ft", F.lit(None).cast("int"))
    points = enrich.with_elevation(points, known)
    return points if edges is None else polygons.reclassify(points, edges)
