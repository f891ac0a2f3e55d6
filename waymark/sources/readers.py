"""Readers of the trail files. Order in a file is data, so each row carries its position."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import schema

_LINE = T.ArrayType(T.ArrayType(T.DoubleType()))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a JSON array with ord and the file's name; each file is read whole by one task."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    rows = text.select("file", F.posexplode(F.from_json("value", T.ArrayType(schema.POINT))).alias("ord", "p"))
    return rows.select("file", F.col("ord").cast("long").alias("ord"), "p.*")


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of a GeoJSON feature collection of (multi) lines, [lon, lat] order in the file.
    Lines of fewer than two points are left out."""
    head = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])))])
    feats = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.from_json("value", head)["features"]).alias("feature_idx", "f"))
    lines = F.when(F.col("f.geometry.type") == "MultiLineString", F.from_json("f.geometry.coordinates", T.ArrayType(_LINE))).when(F.col("f.geometry.type") == "LineString", F.array(F.from_json("f.geometry.coordinates", _LINE)))
    runs = feats.select("file", "feature_idx", F.posexplode(F.filter(lines, lambda x: F.size(x) >= 2)).alias("run_idx", "coords"))
    return runs.select("file", "feature_idx", "run_idx", F.posexplode("coords").alias("vertex_idx", "c")).select("file", "feature_idx", "run_idx", "vertex_idx", F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"))


def main_run(vertices: DataFrame) -> DataFrame:
    """The sliceable path: the first run of the first feature."""
    return vertices.where("feature_idx = 0 and run_idx = 0")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Survey lines (ord, object_id, length_mi, coords), members of a multi-line one by one,
    in order of the object's number."""
    props = T.StructType([T.StructField("OBJECTID", T.LongType()), T.StructField("LENGTH_MI", T.DoubleType())])
    geom = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    head = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", props), T.StructField("geometry", geom)])))])
    f = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", head)["features"]).alias("f"))
    lines = F.when(F.col("f.geometry.type") == "MultiLineString", F.from_json("f.geometry.coordinates", T.ArrayType(_LINE))).otherwise(F.array(F.from_json("f.geometry.coordinates", _LINE)))
    rows = f.select(F.col("f.properties.OBJECTID").alias("object_id"), F.col("f.properties.LENGTH_MI").alias("length_mi"), F.posexplode(lines).alias("part", "coords"))
    return rows.where(F.size("coords") >= 2).withColumn("ord", F.col("object_id") * 10_000 + F.col("part"))


def read_boundaries(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Edges of (multi) polygons. A feature's name is the first non-empty of three keys and is
    mapped to a code by known (name, code); features of other names are left out."""
    names = ("name", "NAME", "NAME_1")
    props = T.MapType(T.StringType(), T.StringType())  # two of the names differ in case alone
    geom = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    head = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", props), T.StructField("geometry", geom)])))])
    poly = T.ArrayType(_LINE)
    f = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", head)["features"]).alias("feature_idx", "f"))
    shape = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", T.ArrayType(poly))).when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", poly)))
    f = f.select("feature_idx", F.coalesce(*[F.nullif(F.col("f.properties")[n], F.lit("")) for n in names]).alias("state"), shape.alias("polys"))
    if known is not None:
        f = f.join(known.select(F.col("name").alias("state"), "code"), "state").drop("state").withColumnRenamed("code", "state")
    r = f.select("feature_idx", "state", F.posexplode("polys").alias("poly_idx", "rings")).select("feature_idx", "state", "poly_idx", F.posexplode("rings").alias("ring_idx", "ring"))
    e = r.withColumn("edge_idx", F.explode(F.sequence(F.lit(0), F.size("ring") - 1)))
    at, before = F.get("ring", F.col("edge_idx")), F.get("ring", F.pmod(F.col("edge_idx") - 1 + F.size("ring"), F.size("ring")))
    return e.select("feature_idx", "state", "poly_idx", "ring_idx", "edge_idx", at[0].alias("xi"), at[1].alias("yi"), before[0].alias("xj"), before[1].alias("yj"))


def read_table(spark: SparkSession, path: str, struct: T.StructType) -> DataFrame:
    """Parquet table with a fixed schema; columns that the files lack are null."""
    return spark.read.schema(struct).parquet(path)


def require_rows(df: DataFrame, at_least: int = 0, at_most: int | None = None) -> DataFrame:
    """df, or an error if its row count is outside the bounds (a guard against the wrong file)."""
    n = df.count() if at_most is None else df.limit(at_most + 1).count()
    if n < at_least or at_most is not None and n > at_most:
        raise ValueError(f"unexpected number of rows: {n}")
    return df
