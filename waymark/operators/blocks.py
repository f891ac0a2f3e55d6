"""Ordered work in two levels, so that no task holds a whole key.

Rows are cut into blocks along a key's order. A block is worked on by itself; a small table with
one row per block carries what a block needs from those before or behind it. Only that table is
gone through key by key, and it has a row for thousands of the input.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of an order that make a block.
BLOCK_ROWS = 1 << 13
#: Asked rows of one block that are worked on together; more are dealt to several parts.
PART_ROWS = 1 << 16


def block_of(x: Column, width: float) -> Column:
    """Number of the block that x lies in, kept within what a whole number can hold."""
    return F.floor(F.greatest(F.lit(-(2.0**52)), F.least(F.lit(2.0**52), x / F.lit(float(width)))))


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where nulls are equal too; the keys are there once."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def ranked(df: DataFrame, keys: list[str], order: list[str], block: Column, out: str) -> DataFrame:
    """Adds the position from 0 of each row in its key's order. block must rise with the order."""
    within, by = [*keys, "_block"], Window.partitionBy(*keys).orderBy("_block")
    cut = df.withColumn("_block", block)
    sizes = cut.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = join_same(cut, starts, within)
    return placed.withColumn(out, (F.col("_start") + F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1).cast("long")).drop("_block", "_start")


def asof(asked: DataFrame, known: DataFrame, keys: list[str], at: str, width: float, sides: tuple[str, ...] = ("before", "after"), part_rows: int = PART_ROWS) -> DataFrame:
    """Adds to each asked row the nearest known row of its key at or before, and at or after, it.

    known has the keys, at, tie and value (a struct); what is added is a struct of these three, or
    null. Among known rows at one place that with the least tie counts. A block is as wide as
    told; a block that many rows ask in is dealt to parts, each with all that is known there.
    What a block needs from others comes as rows beside its own, so no table of blocks is joined:
    where blocks hold few rows that table is as long as the input.
    """
    where = [*keys, "_block"]
    cut = lambda df: df.withColumn("_block", block_of(F.col(at), width))
    asked, known = cut(asked), cut(known).select(*where, F.struct(at, "tie", "value").alias("_p"))
    place, back = F.struct(f"_p.{at}", "_p.tie"), F.struct(-F.col(f"_p.{at}"), F.col("_p.tie"))
    none = F.lit(None).cast(known.schema["_p"].dataType)
    ends = known.groupBy(*where).agg(F.min_by("_p", place).alias("_first"), F.min_by("_p", back).alias("_last"), F.lit(0).cast("long").alias("_n"))
    calls = asked.groupBy(*where).agg(F.count(F.lit(1)).alias("_n"))
    table = ends.unionByName(calls.select(*where, none.alias("_first"), none.alias("_last"), "_n")).groupBy(*where).agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_n").alias("_n"))
    carry = {"before": (F.col("_block").asc(), "_last"), "after": (F.col("_block").desc(), "_first")}
    for s in sides:
        w = Window.partitionBy(*keys).orderBy(carry[s][0]).rowsBetween(Window.unboundedPreceding, -1)
        table = table.withColumn(f"_c_{s}", F.last(carry[s][1], True).over(w))
    # an end that lies outside of a block comes first in the order of its side
    carried = table.where("_n > 0").select(*where, F.explode(F.array_compact(F.array(*[f"_c_{s}" for s in sides]))).alias("_p"))
    # at most one row for each part_rows asked rows
    hot = F.broadcast(calls.where(F.col("_n") > part_rows).withColumn("_parts", F.ceil(F.col("_n") / F.lit(float(part_rows))).cast("int")).drop("_n"))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    own = asked.select(*where, F.struct(*[c for c in asked.columns if c != "_block"]).alias("_q"))
    own = join_same(own, hot, where, "left").withColumn("_part", F.pmod(F.xxhash64("_q"), parts).cast("int")).drop("_parts")
    theirs = join_same(known.unionByName(carried), hot, where, "left")
    theirs = theirs.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    rows = own.unionByName(theirs, allowMissingColumns=True).withColumn("_at", F.coalesce(f"_p.{at}", f"_q.{at}"))
    found = {}
    for s in sides:
        # at one place the asked rows come last, right behind the known row with the least tie
        order = [F.col("_at").asc() if s == "before" else F.col("_at").desc(), F.col("_q").isNotNull(), F.col("_p.tie").desc()]
        w = Window.partitionBy(*where, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found[s] = F.last("_p", True).over(w)
    return rows.withColumns(found).where(F.col("_q").isNotNull()).select("_q.*", *sides)
