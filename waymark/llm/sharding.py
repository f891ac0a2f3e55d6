"""Sharding by jump consistent hashing: a row's shard depends on its key and the number of
shards alone, and one more shard takes its share of rows without moving others.

All steps are column expressions. Spark raises on 64-bit overflow, so the generator's
multiplication modulo 2**64 is carried out on 32-bit halves.

Defined cases: a null key is hashed as 0 and is one key; a null text has size 16 and the
checksum of no bytes; repeated rows are numbered one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import shuffle_partitions

#: Fixed values of the published algorithm: its multiplier in halves, and the low half's halves.
MULTIPLIER = 2862933555777941757
_HI, _LO = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LO1, _LO0 = _LO >> 16, _LO & 0xFFFF
_HI1, _HI0 = _HI >> 16, _HI & 0xFFFF
_MASK = 0xFFFFFFFF
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def _low32(x: Column, k1: int, k0: int) -> Column:
    """x * (k1 * 2**16 + k0) modulo 2**32 for x below 2**32."""
    return (x * k0 + F.shiftleft((x * k1).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The next state of the generator, as halves."""
    p1 = lo * _LO1
    low = lo * _LO0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    high = F.shiftright(low, 32) + F.shiftright(p1, 16) + _low32(hi, _LO1, _LO0) + _low32(lo, _HI1, _HI0)
    return high.bitwiseAND(F.lit(_MASK)), low.bitwiseAND(F.lit(_MASK))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard from 0 to shards - 1 of a 64-bit key.

    About ln(shards) jumps are needed. A run of 8 ln(shards) + 64 steps nearly always ends;
    where it does not, the steps go on to the number of shards, which always suffices.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_MASK)).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        # the upper 31 bits of the state
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(hi, 1) + 1).cast("double")))
        return F.when(s["j"] < shards, F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), to.alias("j"))).otherwise(s)

    run = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), zero, jump)
    short = min(shards, 64 + 8 * shards.bit_length())
    # Two aggregates of the same input would both run, so the short one hands its end to a lambda.
    done = F.transform(F.array(run(short)), lambda s: F.when(s["j"] >= shards, s["b"]).otherwise(run(shards)["b"]))
    return done[0].cast("int")


def assign_shards(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """df with its shard by a column of whole numbers, or by the 64-bit hash of any other."""
    c = F.col(f"`{key}`")
    whole = df.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    return df.withColumn(out, jump_hash(c if whole else F.xxhash64(c), shards))


def with_slots(df: DataFrame, shard: str, order: list[str], out: str = "slot", parts: int | None = None) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps.

    A shard is cut by hash into parts that are numbered apart, each from where the part before
    it ends, so a shard of any size is many tasks. The table of part sizes has shards x parts rows.
    """
    parts = parts or max(4, shuffle_partitions(df.sparkSession) // 4)
    cut = df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(parts)).cast("int"))
    sizes = cut.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_start"))
    within = Window.partitionBy(shard, "_part").orderBy(*order)
    numbered = cut.withColumn("_rank", F.row_number().over(within) - 1)
    # shards x parts rows whatever the input
    return numbered.join(F.broadcast(starts), [shard, "_part"]).withColumn(out, F.col("_start") + F.col("_rank")).drop("_part", "_start", "_rank")


def shard_table(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard among one more.

    Only these narrow columns are shuffled, never the texts. Equal texts keep the same checksum
    and are neighbours within a shard.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id"), (F.octet_length(data).cast("long") + ROW_BYTES).alias("size"), F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign_shards(assign_shards(rows, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    out = with_slots(rows, "shard", ["text_crc32", "size", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 40, key: str = "doc_id") -> None:
    """Writes docs into folders shard=k. Each shard is written by as many tasks as its rows fill."""
    out = assign_shards(docs, key, shards, "shard")
    out.withColumn("_salt", F.pmod(F.xxhash64(*docs.columns), F.lit(16))).repartition(F.col("shard"), F.col("_salt")).drop("_salt").write.partitionBy("shard").parquet(path)
