"""Where queries and their SQL counterparts are put down."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Decimals that are compared.
D = 4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_order(df: DataFrame) -> DataFrame:
    """df with the place, from 0, that each row has in the order in which df gives them."""
    placed = df.rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    return df.sparkSession.createDataFrame(placed, T.StructType([*df.schema.fields, T.StructField("place", T.LongType())]))


def hav(a: str, b: str, c: str, d: str) -> str:
    """SQL of the great-circle miles from (a, b) to (c, d)."""
    h = f"pow(sin(radians({c}-{a})/2.0),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2.0),2)"
    return f"2*cast(3958.8 as double)*asin(sqrt(case when {h} > 1 then 1 else {h} end))"


def fixed(x: str, places: int) -> str:
    """SQL of the text of x with fixed decimals, from its exact binary value."""
    one = "cast(1099511627776 as double)"
    f = f"(abs({x})-floor(abs({x})))"
    bits = f"(cast(floor({f}*{one}) as hugeint)*1099511627776 + cast(floor(({f}*{one}-floor({f}*{one}))*{one}) as hugeint))"
    units = f"(({bits}*{2 * 10**places}+{2**80})//{2**81})"
    return f"((case when {x} < 0 then '-' else '' end) || cast(cast(floor(abs({x})) as hugeint)+{units}//{10**places} as varchar) || '.' || lpad(cast({units}%{10**places} as varchar),{places},'0'))"
