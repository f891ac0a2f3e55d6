"""Snapping of coordinates and mile markers to trail points, and states of a mile range."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.labels import SEPARATOR
from waymark.operators.blocks import asof, join_same
from waymark.operators.nearest import nearest

#: Miles by which a range reaches beyond its ends when states are looked up.
TOLERANCE = 0.05
#: Miles of a block when miles are snapped.
BLOCK_MILES = 1.0


def snap_coordinates(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Nearest point for each (qid, qlat, qlng); the lowest ordinal wins ties.

    Queries pass through with null mile and state if there are no points or a coordinate is
    null. A qid may be there more than once.
    """
    points = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("ord", "lat", "lon", F.struct("lat", "lon", "mile", "state").alias("value"))
    asked = queries.select("qid", "qlat", "qlng").where(F.col("qlat").isNotNull() & F.col("qlng").isNotNull())
    found = nearest(asked, points)
    return join_same(queries, found, ["qid", "qlat", "qlng"], "left").select("qid", F.coalesce("value.lat", "qlat").alias("lat"), F.coalesce("value.lon", "qlng").alias("lng"), "value.mile", "value.state", "ord", "dist")


def snap_miles(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Nearest point by mile for each (qid, qmile, qstate); a null state asks all points.

    A point without a mile counts as mile 0 and the lowest ordinal wins ties. An unknown
    state or a null mile gives nulls.
    """
    base = points.select(F.coalesce("mile", F.lit(0.0)).alias("_m"), F.col("ord").alias("tie"), F.struct("ord", "mile", "state", "lat", "lon").alias("value"))
    keyed = base.withColumn("_k", F.explode(F.array_compact(F.array(F.struct(F.lit(None).cast("string").alias("s")), F.when(F.col("value.state").isNotNull(), F.struct(F.col("value.state").alias("s"))))))).withColumn("_k", F.col("_k.s"))
    # one point for each key and mile: the first
    first = keyed.groupBy("_k", "_m").agg(F.min_by(F.struct("tie", "value"), "tie").alias("p")).select("_k", "_m", "p.tie", "p.value")
    asked = queries.where(F.col("qmile").isNotNull()).select("qid", F.col("qstate").alias("_k"), F.col("qmile").cast("double").alias("_m"))
    sides = asof(asked, first, ["_k"], "_m", BLOCK_MILES)
    pick = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}._m") - F.col("_m")).alias("d"), F.col(f"{side}.tie").alias("o"), F.col(f"{side}.value").alias("p")))
    best = sides.select("qid", F.least(pick("before"), pick("after")).alias("b")).select("qid", "b.p.mile", "b.p.state", "b.p.ord", F.col("b.d").alias("dist"))
    return best.unionByName(queries.where(F.col("qmile").isNull()).select("qid"), allowMissingColumns=True)


def states_for_range(segments: DataFrame, points: DataFrame) -> DataFrame:
    """States that each (id, start_mile, end_mile) crosses, in file order, as one text.

    Null if a mile is missing or no point lies in the range. A state's least ordinal is kept for
    each whole mile and for runs of 2, 4, 8, ... miles. A range is cut into the few such runs that
    fill it and its two outer miles, where the points themselves are looked at: what a range
    meets grows with the logarithm of its length.
    """
    lo, hi = F.least("start_mile", "end_mile") - F.lit(TOLERANCE), F.greatest("start_mile", "end_mile") + F.lit(TOLERANCE)
    asked = segments.where(F.col("start_mile").isNotNull() & F.col("end_mile").isNotNull()).select("id", lo.alias("_lo"), hi.alias("_hi"))
    asked = asked.withColumns({"_a": F.floor("_lo"), "_b": F.floor("_hi")})
    marked = points.where(F.col("mile").isNotNull() & F.col("state").isNotNull() & (F.col("state") != "")).select("mile", "state", "ord", F.floor("mile").alias("_m"))
    edges = asked.withColumn("_m", F.explode(F.array_distinct(F.array("_a", "_b"))))
    outer = edges.join(marked, "_m").where(F.col("mile").between(F.col("_lo"), F.col("_hi"))).select("id", "state", "ord")
    runs = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    least = marked.groupBy("state", "_m").agg(F.min("ord").alias("ord")).withColumn("_level", F.explode(runs)).groupBy("state", "_level", F.call_function("shiftright", F.col("_m"), F.col("_level")).alias("_run")).agg(F.min("ord").alias("ord"))
    cover = asked.where(F.col("_b") - F.col("_a") > 1).select("id", F.explode(covering(F.col("_a") + 1, F.col("_b"))).alias("r"))
    inner = cover.select("id", F.col("r.level").alias("_level"), F.col("r.run").alias("_run")).join(least, ["_level", "_run"]).select("id", "state", "ord")
    firsts = outer.unionByName(inner).groupBy("id", "state").agg(F.min("ord").alias("first_ord"))
    listed = firsts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first_ord", "state"))).alias("s"))
    listed = listed.select("id", F.array_join(F.transform("s", lambda x: x["state"]), SEPARATOR).alias("states"))
    return segments.select("id").join(listed, "id", "left")


#: Runs of 1, 2, 4, ... miles; more than the longest are taken one by one.
LEVELS = 16


def covering(start, end):
    """Runs (level, run) that together fill the whole miles from start up to, not with, end."""
    zero = F.struct(start.alias("a"), end.alias("b"), F.array().cast("array<struct<level:int,run:bigint>>").alias("out"))
    run = lambda level, n: F.array(F.struct(level.cast("int").alias("level"), n.cast("bigint").alias("run")))
    none = F.array().cast("array<struct<level:int,run:bigint>>")

    def up(s, level):
        """Numbers on this level; an odd start and an odd end leave a run, the rest goes one level up."""
        left = F.when((s["a"] < s["b"]) & (s["a"] % 2 != 0), run(level, s["a"])).otherwise(none)
        a = s["a"] + F.size(left)
        right = F.when((a < s["b"]) & (s["b"] % 2 != 0), run(level, s["b"] - 1)).otherwise(none)
        b = s["b"] - F.size(right)
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), F.concat(s["out"], left, right).alias("out"))

    top = F.lit(LEVELS - 1)
    rest = lambda s: F.when(s["a"] < s["b"], F.transform(F.sequence(s["a"] * 2, s["b"] * 2 - 1), lambda n: F.struct(top.cast("int").alias("level"), n.cast("bigint").alias("run")))).otherwise(none)
    # after as many levels as the length has digits in base two nothing is left
    needed = F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(0), F.least(top, needed)), zero, up, lambda s: F.concat(s["out"], rest(s)))


def validate_requests(requests: DataFrame, require_distinct: bool = True, require_date: bool = False) -> DataFrame:
    """First failed rule of each form request, or null.

    Columns: start_state, end_state, start_text, end_text, start_mile, end_mile (typed),
    start_ord, end_ord, start_snap_mile, end_snap_mile, and date_begun if a date is required. Two
    snaps whose miles are both null count as the same point.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rule = (
        F.when(blank("start_state") | blank("end_state"), F.lit("state_missing"))
        .when(blank("start_text") | blank("end_text"), F.lit("mile_missing"))
        .when(~finite("start_mile") | ~finite("end_mile"), F.lit("mile_not_a_number"))
        .when(F.col("start_ord").isNull() | F.col("end_ord").isNull(), F.lit("point_not_found"))
    )
    if require_distinct:
        rule = rule.when(F.col("start_snap_mile").eqNullSafe(F.col("end_snap_mile")), F.lit("same_point"))
    if require_date:
        rule = rule.when(F.col("date_begun").isNull(), F.lit("date_missing"))
    return requests.withColumn("error", rule)
