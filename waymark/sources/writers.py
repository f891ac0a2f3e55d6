"""Sinks. Each write goes to a new path, so what was there before stays as it is."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_versioned(df: DataFrame, base: str, version: str, partition_by: list[str] | None = None) -> str:
    """Parquet under base/version=...; an existing version is an error."""
    path = f"{base.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path, partitionBy=partition_by)
    return path


def points_json(points: DataFrame) -> DataFrame:
    """One row per file: its points as a compact JSON array in order of ord."""
    body = [c for c in points.columns if c not in ("file", "ord")]
    return points.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*body).alias("p")))).alias("a")).select("file", F.to_json(F.transform("a", lambda x: x["p"])).alias("value"))


def multiline_geojson(vertices: DataFrame) -> DataFrame:
    """One row per trail: its runs as a feature collection with one MultiLineString."""
    runs = vertices.groupBy("trail_id", "run_idx").agg(F.array_sort(F.collect_list(F.struct("vertex_idx", F.array("lon", "lat").alias("c")))).alias("v"))
    one = runs.groupBy("trail_id").agg(F.array_sort(F.collect_list(F.struct("run_idx", F.transform("v", lambda x: x["c"]).alias("l")))).alias("r"))
    geom = F.struct(F.lit("MultiLineString").alias("type"), F.transform("r", lambda x: x["l"]).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("trail_id").alias("id")).alias("properties"), geom.alias("geometry"))
    return one.select("trail_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("value"))
