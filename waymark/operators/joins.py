"""Joins that broadcast one side only after its size has been checked."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side counts as small.
SMALL_ROWS = 100_000
#: Rows of one key from which it is dealt to parts.
HOT_ROWS = 2_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether df has at most this many rows; looks at no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hash join if small has few rows, else a shuffled join that AQE can split."""
    return big.join(F.broadcast(small) if is_small(small, rows) else small, on, how)


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join with small, which has one row for each key and in n how many rows big has of it.

    Rows of a key with very many are dealt to parts, and the key's row goes to each part. The
    table of such keys is sent to all tasks: there is at most one for each hot_rows rows of big.
    """
    parts = F.ceil(F.col(n) / F.lit(float(hot_rows))).cast("int")
    hot = small.where(F.col(n) > hot_rows).select(*keys, parts.alias("_parts"))
    found = hot.limit(SMALL_ROWS + 1).count()
    if not found:
        return big.join(small, keys)
    dealt = big.join(F.broadcast(hot) if found <= SMALL_ROWS else hot, keys, "left")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(copies, [*keys, "_part"]).drop("_part")
