"""A long stage that goes on where it was stopped.

The rows are dealt to parts by their key, and parts are worked on a few at a time. What a run has
finished is put down in a manifest: for each part the number of rows that went in and a digest of
their keys. The next run takes the parts that the manifest lacks, or for which number or digest are
others by now, and leaves the rest alone. A run that is killed loses only the parts it was at.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from waymark.session import exists, remove

PARTS, AT_ONCE = 32, 8
_MANIFEST = "part int, rows long, digest decimal(38,0), folder string"


class Told(NamedTuple):
    """How far a run is: input rows done in this run and to be done in it, rows made, rows a second,
    and the seconds that the rest takes at that rate."""

    done: int
    total: int
    made: int
    rate: float
    left: float


def _state(df: DataFrame, key: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """df with its parts, and one row (part, rows, digest) for each."""
    keyed = df.withColumn("_part", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(parts)).cast("int"))
    digest = F.sum(F.xxhash64(F.col(f"`{key}`"), F.lit(1)).cast("decimal(38,0)")).cast("decimal(38,0)")
    return keyed, keyed.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest"))


def finished(df: DataFrame, key: str, path: str, parts: int = PARTS) -> DataFrame:
    """(part, rows, digest, folder) of the parts of df that path holds as they now are."""
    spark = df.sparkSession
    now = _state(df, key, parts)[1]
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    put = spark.read.schema(_MANIFEST).json(f"{path}/manifest").where(F.col("folder").startswith(f"parts={parts}/"))
    # of a part that two runs have made either will do
    return put.join(now, ["part", "rows", "digest"], "left_semi").groupBy("part", "rows", "digest").agg(F.min("folder").alias("folder"))


def resumed(df: DataFrame, key: str, path: str, build: Callable[[DataFrame], DataFrame], parts: int = PARTS, at_once: int = AT_ONCE, tell: Callable[[Told], None] | None = None) -> DataFrame:
    """build(df), put together from parts under path.

    build gets rows of some parts at a time and must keep the key, by which it may be called for any
    of them apart from the others. key must not be null; rows with one key lie in one part. A part
    counts as it was put down as long as df has the same number of rows and the same keys in it.
    tell is called after each few parts; the rows made are counted as they are written.
    """
    spark = df.sparkSession
    keyed, now = _state(df, key, parts)
    sizes = {r["part"]: r["rows"] for r in now.join(finished(df, key, path, parts), ["part"], "left_anti").collect()}  # at most as many as there are parts
    left, start, done, made = sorted(sizes), time.monotonic(), 0, 0
    schema = build(df.limit(0)).schema
    for at in range(0, len(left), at_once):
        mine = left[at : at + at_once]
        folder = f"parts={parts}/{uuid.uuid4().hex}"
        seen = Observation()
        out = build(keyed.where(F.col("_part").isin(mine)).drop("_part")).observe(seen, F.count(F.lit(1)).alias("rows"))
        out.withColumn("_part", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(parts)).cast("int")).write.partitionBy("_part").parquet(f"{path}/{folder}")
        now.where(F.col("part").isin(mine)).withColumn("folder", F.lit(folder)).select("part", "rows", "digest", "folder").coalesce(1).write.mode("append").json(f"{path}/manifest")
        done, made = done + sum(sizes[p] for p in mine), made + seen.get["rows"]
        if tell:
            rate, total = done / (time.monotonic() - start), sum(sizes.values())
            tell(Told(done, total, made, rate, (total - done) / rate if rate else float("inf")))
    held = [f"{path}/{r['folder']}/_part={r['part']}" for r in finished(df, key, path, parts).collect()]
    held = [h for h in held if exists(spark, h)]  # a part of which build keeps no row has no folder
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def forget(df: DataFrame, path: str) -> None:
    """Deletes what runs have put down, once the result is stored elsewhere."""
    remove(df.sparkSession, path)
