"""Dashboard figures from small summaries that can be put together.

For each trail and day a row holds the number of sections, a HyperLogLog sketch of who logged them and
a KLL sketch of their miles. A refresh adds rows for new sections alone; rows of one day or of many
are merged when they are read, so no section is looked at twice. Sketches have a bounded size, and so
have rows, whatever the sections; folding merges the rows of a day that several refreshes have left.

The number of hikers has a standard error of 1.04 / sqrt(2**LG_K), a quantile a rank error of about
2.3 / K ** 0.9. Null hikers and lengths are not counted; a trail without lengths has null quantiles.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import segment_miles
from waymark.operators.buckets import Store

LG_K, K = 12, 400
_DAY = ("trail_id", "date_begun")


def day_sketches(segments: DataFrame) -> DataFrame:
    """(trail_id, date_begun, sessions, hikers, miles) with sketches of hikers and miles."""
    return segments.withColumn("_m", segment_miles()).groupBy(*_DAY).agg(
        F.count(F.lit(1)).alias("sessions"), F.hll_sketch_agg("user_id", F.lit(LG_K)).alias("hikers"), F.kll_sketch_agg_double("_m", F.lit(K)).alias("miles")
    )


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser keys, or of all rows."""
    return sketches.groupBy(*keys).agg(F.sum("sessions").alias("sessions"), F.hll_union_agg("hikers").alias("hikers"), F.kll_merge_agg_double("miles").alias("miles"))


def figures(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, sessions, hikers, median_miles, long_miles): estimates; long is the ninth decile."""
    at = lambda q: F.when(F.kll_sketch_get_n_double("miles") > 0, F.kll_sketch_get_quantile_double("miles", F.lit(q)))
    return merged(sketches, *keys).select(*keys, "sessions", F.hll_sketch_estimate("hikers").alias("hikers"), at(0.5).alias("median_miles"), at(0.9).alias("long_miles"))


def refresh(store: Store, new: DataFrame, name: str = "sketches", buckets: int = 16) -> None:
    """Adds the sketches of new sections to the store; nothing that is there is read or written."""
    made = day_sketches(new)
    if name in store.manifest()["tables"]:
        store.add(name, made)
    else:
        store.create(name, made, ["trail_id"], buckets)


def fold(store: Store, name: str = "sketches") -> int:
    """Merges the rows of each day in buckets that several refreshes have added to; returns how many."""
    table = store.manifest()["tables"][name]
    many = [int(b) for b, folders in table["folders"].items() if len(folders) > 1]
    if many:
        store.change({name: lambda t: store.rewrite(t, many, merged(store._read(t, many), *_DAY))})
    return len(many)


def is_quantile(values: Column, x: Column, q: float, error: float) -> Column:
    """Whether x is a quantile of a group's values within a rank error; equal values share their ranks."""
    share = lambda test: F.avg(F.when(values.isNotNull(), test.cast("double")))
    return (share(values < x) <= q + error) & (share(values <= x) >= q - error)
