"""Sessions of an event stream that comes late, twice, or not at all.

Events of a key that follow each other within a gap are one session. An event that comes again is
known by its id for as long as the watermark waits, and an event behind the watermark is dropped and
counted. A session is given out once, when the watermark has passed its end; what is still open
stays in the state for the next run. State holds open sessions and the ids within the wait.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import exists


class Followed(NamedTuple):
    """All rows given out so far, and how many late rows this run has dropped."""

    rows: DataFrame
    late: int


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", wait: str = "2 hours", at: str = "ts", unique: str = "event_id") -> DataFrame:
    """(keys, start, end, events, total) of the sessions of (keys, at, unique, value); end is the gap
    behind the last event. A null time belongs to no session."""
    once = events.where(F.col(at).isNotNull()).withWatermark(at, wait).dropDuplicatesWithinWatermark([unique])
    out = once.groupBy(F.session_window(at, gap).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events", "total")


def follow(df: DataFrame, path: str) -> Followed:
    """Takes in what is new of a stream in append mode and ends. Rows lie under path in files that a
    log names, so a batch that is run again leaves no row twice."""
    spark = df.sparkSession
    run = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    late = sum(o["numRowsDroppedByWatermark"] for p in run.recentProgress for o in p["stateOperators"])
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows") if exists(spark, f"{path}/rows") else spark.createDataFrame([], df.schema)
    return Followed(rows, late)
