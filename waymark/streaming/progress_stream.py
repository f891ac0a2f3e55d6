"""Progress kept up to date from a stream of sections (an extension: the batch form recomputes)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.geo import segment_miles
from waymark.session import names


def running_totals(segments: DataFrame) -> DataFrame:
    """Miles and sessions per user and trail; state is one row for each pair."""
    return segments.withColumn("_m", segment_miles()).groupBy("user_id", "trail_id").agg(F.sum("_m").alias("miles"), F.count(F.lit(1)).alias("sessions"))


def windowed_events(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window and kind; rows later than the watermark are left out of closed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).options(**options).parquet(path)


def run_once(df: DataFrame, path: str) -> DataFrame:
    """Processes what is there and ends; the checkpoint under path carries state to the next call.

    Each batch writes the totals as they then are to a table of its own, so a batch that is run
    again writes the same; the result is the newest table, also if nothing was new, or no rows if
    there never was a batch. It suits few groups; ``ledger`` keeps many, and takes deletions.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    numbers = [int(n.split("=")[1]) for n in names(spark, path) if n.startswith("batch=")]
    return spark.read.schema(df.schema).parquet(f"{path}/batch={max(numbers)}") if numbers else spark.createDataFrame([], df.schema)
