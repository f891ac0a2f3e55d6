"""Totals kept up to date as sections are saved and deleted.

A change is (seq, op, id, user_id, ...): op "save" puts a section down, in the place of an earlier one
of its user with that id, and "delete" takes it away; deleting what is not there is no error. Each
batch of changes becomes signed differences: minus what the touched sections were, plus what they
are now, summed by user, trail and day. Only buckets with a touched section, user or trail are
rewritten, and both tables change in one version of the store. The version bears the batch's number,
so a batch that is run again after a failure does nothing if it had been taken in.

Sections are bucketed by user and id, so a user with very many is spread over all buckets. Totals
have a row for each user, trail and day, from which miles, sessions, trail days and dates of any
coarser key follow. Miles are whole numbers of 10**-9 miles: adding and taking away leaves no dust,
and the totals equal those of a recomputation at any time.

Defined cases: changes with a null seq come before all others of their batch, and of changes with
equal seq a delete counts; a null id, user, trail or day is one of its own; an op that is neither is
left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.geo import segment_miles
from waymark.operators.blocks import join_same
from waymark.operators.buckets import Store
from waymark.session import written

UNITS = 10**9
_KEY = ["user_id", "id"]
_DAY = ["user_id", "trail_id", "date_begun"]
_PLACE = ("start_lat", "start_lng", "end_lat", "end_lng", "start_mile", "end_mile")


def units(miles: Column) -> Column:
    """Miles as a whole number of units; a null length is none."""
    return F.coalesce(F.round(miles * F.lit(float(UNITS))).cast("long"), F.lit(0).cast("long"))


def open_ledger(spark: SparkSession, path: str, schema: T.StructType, buckets: int = 64) -> Store:
    """The store at path, with empty tables if it is new. schema has at least user_id, id, trail_id
    and date_begun, whose types the tables take over."""
    store = Store(spark, path)
    tables = store.manifest()["tables"]
    of = lambda *names: T.StructType([schema[n] for n in names])
    if "sections" not in tables:
        empty = spark.createDataFrame([], T.StructType([*of(*_KEY, "trail_id", "date_begun").fields, T.StructField("units", T.LongType())]))
        store.create("sections", empty, _KEY, buckets)
    if "days" not in tables:
        empty = spark.createDataFrame([], T.StructType([*of(*_DAY).fields, T.StructField("sessions", T.LongType()), T.StructField("units", T.LongType())]))
        store.create("days", empty, ["user_id", "trail_id"], buckets)
    return store


def take_in(store: Store, changes: DataFrame, batch: int | None = None) -> bool:
    """Applies a batch of changes; false if the store has it already."""
    before = store.manifest()
    if batch is not None and before["note"] is not None and before["note"] >= batch:
        return False
    rank = F.struct(F.col("seq").isNotNull(), F.col("seq"), F.col("op") == "delete")
    row = F.struct("op", "trail_id", "date_begun", units(segment_miles()).alias("units"))
    last = changes.where(F.col("op").isin("save", "delete")).groupBy(*_KEY).agg(F.max_by(row, F.struct(rank, row)).alias("_c")).select(*_KEY, "_c.*")
    last = written(last)
    sections, days = before["tables"]["sections"], before["tables"]["days"]
    hit = store.buckets_of(sections, last)
    if not hit:
        store.change({}, batch if batch is not None else before["note"])
        return True
    old = store._read(sections, hit)
    touched = last.select(*_KEY).withColumn("_hit", F.lit(True))
    marked = join_same(old, touched, _KEY, "left")
    new = last.where("op = 'save'").select(*old.columns)
    signed = lambda rows, sign: rows.select(*_DAY, F.lit(sign).cast("long").alias("sessions"), (F.col("units") * sign).alias("units"))
    deltas = signed(marked.where("_hit"), -1).unionByName(signed(new, 1))
    deltas = written(deltas.groupBy(*_DAY).agg(F.sum("sessions").alias("sessions"), F.sum("units").alias("units")).where("sessions <> 0 or units <> 0"))
    moved = store.buckets_of(days, deltas)
    sums = store._read(days, moved).unionByName(deltas).groupBy(*_DAY).agg(F.sum("sessions").alias("sessions"), F.sum("units").alias("units")).where("sessions <> 0")
    store.change(
        {
            "sections": lambda t: store.rewrite(t, hit, marked.where(F.col("_hit").isNull()).select(*old.columns).unionByName(new)),
            "days": lambda t: store.rewrite(t, moved, sums) if moved else None,
        },
        batch if batch is not None else before["note"],
    )
    return True


def totals(store: Store, keys: tuple[str, ...] = ("user_id", "trail_id")) -> DataFrame:
    """Miles, sessions, trail days, first and last date by key, as they now are; the last date is
    null unless there are two distinct ones."""
    n = F.count_distinct("date_begun")
    return store.read("days").groupBy(*keys).agg(
        (F.sum("units") / F.lit(float(UNITS))).alias("miles"), F.sum("sessions").alias("sessions"), n.alias("trail_days"),
        F.min("date_begun").alias("first_date"), F.when(n > 1, F.max("date_begun")).alias("last_date"),
    )


def follow(changes: DataFrame, path: str, buckets: int = 64, after: Callable[[int], None] | None = None) -> Store:
    """Takes in what a stream of changes has that is new, and ends; the store has the totals, also if
    nothing was new. Progress of the stream lies beside the store, under path."""
    store = open_ledger(changes.sparkSession, f"{path}/ledger", changes.schema, buckets)

    def step(batch: DataFrame, number: int) -> None:
        take_in(Store(batch.sparkSession, store.path), batch, number)  # a batch has a session of its own
        if after:
            after(number)

    changes.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return store
