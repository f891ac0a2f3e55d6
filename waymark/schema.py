"""Fixed schemas of the relations that the engine reads and writes.

``ord`` is the position of a row in its source file: ties are broken by it, so it is
always materialised rather than left to partition order.
"""

from pyspark.sql import types as T

POINT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("mile", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("state", T.StringType()),
    T.StructField("spur", T.BooleanType()),
    T.StructField("spur_mile", T.DoubleType()),
    T.StructField("gap", T.BooleanType()),
    T.StructField("alt_terminus", T.BooleanType()),
    T.StructField("elev_ft", T.IntegerType()),
])

SEGMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("trail_id", T.StringType()),
    T.StructField("start_lat", T.DoubleType()),
    T.StructField("start_lng", T.DoubleType()),
    T.StructField("end_lat", T.DoubleType()),
    T.StructField("end_lng", T.DoubleType()),
    T.StructField("start_mile", T.DoubleType()),
    T.StructField("end_mile", T.DoubleType()),
    T.StructField("date_begun", T.DateType()),
    T.StructField("date_completed", T.DateType()),
    T.StructField("duration_minutes", T.IntegerType()),
    T.StructField("temp_f", T.IntegerType()),
    T.StructField("notes", T.StringType()),
    T.StructField("flora_fauna", T.StringType()),
    T.StructField("states", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

PROFILE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

BADGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("badge_key", T.StringType()),
    T.StructField("earned_at", T.TimestampType()),
])

USER = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("raw_user_meta_data", T.StringType()),
])

TRAIL = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("total_miles", T.DoubleType()),
    T.StructField("states", T.ArrayType(T.StringType())),
    T.StructField("termini", T.ArrayType(T.StringType())),
    T.StructField("has_geometry", T.BooleanType()),
    T.StructField("geometry_file", T.StringType()),
])

VERTEX = T.StructType([
    T.StructField("feature_idx", T.IntegerType()),
    T.StructField("run_idx", T.IntegerType()),
    T.StructField("vertex_idx", T.IntegerType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])

#: Columns that a segment scan returns to the client.
SEGMENT_SCAN = ("id", "trail_id", "start_lat", "start_lng", "end_lat", "end_lng", "start_mile", "end_mile", "date_begun", "states")
