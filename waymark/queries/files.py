"""Queries that write the trail files and read them back: an exact round trip of the fixtures."""

from pyspark.sql import functions as F

from waymark import schema
from waymark.operators import progress
from waymark.queries.registry import query, table
from waymark.session import scratch
from waymark.sources import readers, writers
from waymark.sources.fixtures import ctes, view


def _put(df, key: str) -> str:
    """Writes (key, value) rows as one text file each; returns the pattern of the files."""
    path = scratch(df.sparkSession)
    df.select(key, "value").write.partitionBy(key).text(path)
    return f"{path}/*/*.txt"


@query(ctes("fx_points") + "select row_number() over (partition by ord // 500 order by ord) - 1 as ord, mile, lat, lon, state, elev_ft from fx_points")
def points_files(spark, d):
    rows = view(spark, d, "fx_points").withColumn("file", F.floor(F.col("ord") / 500.0))
    return readers.require_rows(readers.read_points(spark, _put(writers.points_json(rows), "file")).select("ord", "mile", "lat", "lon", "state", "elev_ft"), 1)


@query(ctes("fx_points") + "select ord, mile, state from fx_points")
def versioned_points(spark, d):
    rows = view(spark, d, "fx_points").withColumn("mile", F.col("mile"))
    path = writers.write_versioned(rows.select("ord", "mile", "state"), scratch(spark), "1")
    return readers.read_table(spark, path, "ord long, mile double, state string")


_VERTICES = "select cast(p_partkey // 200 as varchar) as trail_id, cast(p_partkey % 200 // 50 as int) as run_idx, cast(p_partkey % 50 as int) as vertex_idx, cast(p_partkey as double) * 0.01::double as lon, cast(p_size as double) as lat from part"


def _vertices(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / 200.0).cast("string").alias("trail_id"), F.floor(k % 200 / 50.0).cast("int").alias("run_idx"), (k % 50).cast("int").alias("vertex_idx"), (k * 0.01).alias("lon"), F.col("p_size").cast("double").alias("lat"))


@query(f"with v as ({_VERTICES}), n as (select *, count(*) over (partition by trail_id, run_idx) as n, row_number() over (partition by trail_id, run_idx order by vertex_idx) - 1 as i, dense_rank() over (partition by trail_id order by run_idx) - 1 as r from v) select cast(r as int) as run_idx, cast(i as int) as vertex_idx, lon, lat from n where n >= 2")
def geometry_files(spark, d):
    return readers.read_geometry(spark, _put(writers.multiline_geojson(_vertices(spark, d)), "trail_id")).select("run_idx", "vertex_idx", "lon", "lat")


@query(f"with v as ({_VERTICES}), n as (select *, row_number() over (partition by trail_id, run_idx order by vertex_idx) - 1 as i, dense_rank() over (partition by trail_id order by run_idx) as r, count(*) over (partition by trail_id, run_idx) as n from v) select cast(i as int) as vertex_idx, lon, lat from n where r = 1 and n >= 2")
def main_runs(spark, d):
    return readers.main_run(readers.read_geometry(spark, _put(writers.multiline_geojson(_vertices(spark, d)), "trail_id"))).select("vertex_idx", "lon", "lat")


@query(f"with v as ({_VERTICES}) select count(distinct (trail_id, run_idx)) as runs, count(*) as coords from v")
def run_totals(spark, d):
    runs = _vertices(spark, d).groupBy("trail_id", "run_idx").agg(F.collect_list("vertex_idx").alias("coords"))
    return progress.run_totals(runs)


@query("select round(sum(case when s_suppkey % 5 = 0 then 0 else s_acctbal end), 2) as total_miles, count(*) as lines from supplier where s_suppkey % 4 <> 0")
def survey_lines(spark, d):
    """Lines without a length count as none, and lines of one point are left out."""
    k = F.col("s_suppkey").cast("double")
    line = F.when(F.col("s_suppkey") % 4 == 0, F.array(F.array(k, k))).otherwise(F.array(F.array(k, k), F.array(k + 1, k)))
    props = F.struct(F.col("s_suppkey").alias("OBJECTID"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("LENGTH_MI"))
    feature = F.struct(props.alias("properties"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"))
    files = table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 100.0).alias("file")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))
    lines = readers.read_lines(spark, _put(files, "file"))
    return progress.path_length(lines).select(F.round("total_miles", 2).alias("total_miles")).join(F.broadcast(lines.agg(F.count(F.lit(1)).alias("lines"))))


@query(ctes("fx_edges") + "select upper(left(state, 2)) as state, ring_idx, least(xi,xj) as x0, greatest(xi,xj) as x1, least(yi,yj) as y0, greatest(yi,yj) as y1 from fx_edges where feature_idx % 5 <> 0")
def boundary_files(spark, d):
    """Polygons whose name stands under one of three keys, read as edges; unknown names are left out."""
    b = view(spark, d, "fx_boxes")
    at = lambda dx, dy: F.array(F.col("x0") + dx, F.col("y0") + dy)
    ring = F.array(at(0, 0), at(0.5, 0), at(0.5, 2.0), at(0, 2.0), at(0, 0))
    key = F.get(F.array(F.lit("name"), F.lit("NAME"), F.lit("NAME_1")), (F.col("feature_idx") % 3).cast("int"))
    feature = F.struct(F.create_map(key, F.col("state")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    files = b.groupBy(F.lit(0).alias("file")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))
    known = b.where(F.col("feature_idx") % 5 != 0).select(F.col("state").alias("name"), F.upper(F.left("state", F.lit(2))).alias("code"))
    e = readers.read_boundaries(spark, _put(files, "file"), known).where("xi <> xj or yi <> yj")
    return e.select("state", "ring_idx", F.least("xi", "xj").alias("x0"), F.greatest("xi", "xj").alias("x1"), F.least("yi", "yj").alias("y0"), F.greatest("yi", "yj").alias("y1"))


@query(ctes("fx_points") + "select ord, cast(null as int) as elev_ft, id is null as no_id from (select ord, null as id from fx_points)")
def blank_elevations(spark, d):
    """Points read by the fixed schema, with columns that the file lacks as nulls."""
    path = writers.write_versioned(view(spark, d, "fx_points").select("ord", "mile"), scratch(spark), "1")
    return readers.read_table(spark, path, f"ord long, {schema.POINT['elev_ft'].name} int, id string").select("ord", "elev_ft", F.col("id").isNull().alias("no_id"))
