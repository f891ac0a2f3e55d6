"""Queries over stores that change: buckets, ledger, resumed stages, pages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions.geo import segment_miles
from waymark.operators.buckets import Owned, Store
from waymark.operators.lookup import looked_up
from waymark.operators.resume import resumed
from waymark.operators.store import profiles_of
from waymark.queries.registry import D, hav, query, table
from waymark.session import scratch
from waymark.sources.fixtures import ctes, view

_USERNAMES = ctes("fx_users") + ", p as (select id, nullif(trim(json_extract_string(raw_user_meta_data,'$.username')),'') as username from fx_users)"


@query(ctes("fx_segments") + "select id, user_id, trail_id from fx_segments where not (user_id = 7 and coalesce(start_mile > 20, false))")
def bucket_delete(spark, d):
    """One user's longer sections are deleted; buckets of other users are not rewritten."""
    store = Store(spark, scratch(spark))
    store.create("segments", view(spark, d, "fx_segments"), ["user_id"])
    mine = Owned(store, "segments", 7)
    mine.delete([r["id"] for r in mine.select("id", "start_mile").where("start_mile > 20").collect()])  # ids that a user picked
    return store.read("segments").select("id", "user_id", "trail_id")


@query(_USERNAMES + " select id, case when id = 5 then 'trail_name' else username end as username from p")
def bucket_update(spark, d):
    """A username changes in its bucket; another's does not."""
    store = Store(spark, scratch(spark))
    store.create("profiles", profiles_of(view(spark, d, "fx_users")), ["id"])
    Owned(store, "profiles", 5).update(5, username="trail_name")
    Owned(store, "profiles", 5).update(6, username="not mine")
    return store.read("profiles")


#: Sections are saved, some again with other ends, and short ones deleted by their users; others try and fail.
_SAVED = """
select event_id as id, user_id, event_type as trail_id, cast(ts as date) as date_begun, cast(0 as double) as start_lat, cast(0 as double) as start_lng,
  cast(0 as double) as end_lat, cast(1 as double) as end_lng, case when value > 100 then null else value end as start_mile, value + cast(event_id % 13 as double) as end_mile from events"""


def _changes(spark, d):
    """Two rounds of (seq, op, section): saves, then corrections and deletions."""
    saved = spark.sql(_SAVED.replace("from events", "from {events}"), events=table(spark, d, "events"))
    again = saved.where("end_mile > 60").withColumn("end_mile", F.col("end_mile") + 5)
    gone = saved.where("end_mile < 30")
    theirs = saved.where("end_mile between 40 and 45").withColumn("user_id", F.col("user_id") + 100_000)
    as_change = lambda rows, seq, op: rows.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), "*")
    return as_change(saved, 1, "save"), as_change(again, 2, "save").unionByName(as_change(gone, 3, "delete")).unionByName(as_change(theirs, 4, "delete"))


@query(f"""
with s as ({_SAVED}), n as (select user_id, trail_id, date_begun, round(coalesce(abs(end_mile + case when end_mile > 60 then 5 else 0 end - start_mile), {hav('0.0', '0.0', '0.0', '1.0')}), 9) as m from s where end_mile >= 30)
select user_id, trail_id, round(sum(m), {D}) as miles, count(*) as sessions, count(distinct date_begun) as trail_days, min(date_begun) as first_date,
  case when count(distinct date_begun) > 1 then max(date_begun) end as last_date from n group by 1, 2""")
def retracted_progress(spark, d):
    """Totals that a stream keeps as sections are saved, changed and deleted."""
    from waymark.streaming import ledger

    path = scratch(spark)
    for changes in _changes(spark, d):
        changes.write.mode("append").parquet(f"{path}/changes")
        stream = spark.readStream.schema(changes.schema).parquet(f"{path}/changes")
        store = ledger.follow(stream, path)
    return ledger.totals(store).withColumn("miles", F.round("miles", D))


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as paid from lineitem")
def resumed_parts(spark, d):
    """A stage that stops halfway; the next run makes the remaining parts alone."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    path, calls = scratch(spark), []

    def paid(rows):
        calls.append(len(calls))
        if calls[-1] == 3:
            raise InterruptedError("stopped")
        return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("paid"))

    try:
        resumed(lines, "l_orderkey", path, paid)
    except InterruptedError:
        pass
    return resumed(lines, "l_orderkey", path, paid)


@query(ctes("fx_points") + "select ord, coalesce(elev_ft, cast(floor(lat * 10 + lon + cast(0.5 as double)) as int)) as elev_ft from fx_points")
def live_elevations(spark, d):
    """Missing elevations from a lookup that fails at first, in parts that a restart would keep."""
    tries: dict = {}

    def look(lat, lon):
        import math

        tries[lat, lon] = tries.get((lat, lon), 0) + 1
        if tries[lat, lon] <= int(lat * 200) % 3:
            raise OSError("busy")
        return math.floor(lat * 10 + lon + 0.5)

    points = view(spark, d, "fx_points").select("ord", "lat", "lon", "elev_ft")
    return resumed(points, "ord", scratch(spark), lambda rows: looked_up(rows, look, ["lat", "lon"], "elev_ft", wait=0.001).select("ord", "elev_ft"), parts=4, at_once=2)


@query("select count(*) as rows, count(*) as made, count(*) as told from lineitem")
def told_progress(spark, d):
    """What a stage in parts tells of itself as it runs, beside the rows of its result."""
    lines, told = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), []
    out = resumed(lines, "l_orderkey", scratch(spark), lambda rows: rows, tell=told.append)
    return out.agg(F.count(F.lit(1)).alias("rows")).withColumns({"made": F.lit(told[-1].made).cast("long"), "told": F.lit(told[-1].done).cast("long")})


@query("select s_suppkey as object_id, case when s_suppkey % 5 <> 0 then s_acctbal end as length_mi, cast(s_suppkey as double) as x from supplier")
def paged_features(spark, d):
    """Survey lines in pages of forty, written by Spark and read back page by page."""
    from waymark.sources.paged import read_pages

    k = F.col("s_suppkey").cast("double")
    props = F.struct(F.col("s_suppkey").alias("OBJECTID"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("LENGTH_MI"))
    shape = F.struct(F.lit("LineString").alias("type"), F.array(F.array(k, k), F.array(k + 1, k)).alias("coordinates"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.struct(props.alias("properties"), shape.alias("geometry")).alias("f"))
    numbered = rows.withColumn("n", F.row_number().over(Window.orderBy("s_suppkey")) - 1)  # a server's own order; its pages are this query's input
    pages = numbered.groupBy((F.floor(F.col("n") / 40) * 40).alias("offset")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n", "f"))), lambda x: x["f"]).alias("features"))).alias("value"))
    return read_pages(spark, _page_files(pages), 40).select("object_id", "length_mi", F.col("coords")[0][0].alias("x"))


def _page_files(pages):
    """Writes (offset, value) as the files of a server's pages; returns their folder."""
    import os

    spark = pages.sparkSession
    path = scratch(spark)
    folder = path.removeprefix("file://")

    def put(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(f"{folder}/page-{r['offset']}.json", "w", encoding="utf-8") as f:
                f.write(r["value"])

    pages.foreachPartition(put)
    return path


@query("""
with e as (select distinct event_id, user_id, ts, value from events), limits as (select max(ts) - interval 1 day as mark from e),
marked as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as fresh from e),
numbered as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from marked)
select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) + 21600000000 as end_us, count(*) as events, round(sum(value), 2) as total, 0 as late_rows
from numbered group by user_id, k having max(ts) + interval 6 hour <= (select mark from limits)""")
def stream_sessions(spark, d):
    """Closed sessions of the event stream, whose file comes twice; a third file is behind the watermark."""
    from waymark.streaming.progress_stream import read_stream
    from waymark.streaming.sessions import follow, sessions

    path, events = scratch(spark), table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    for _ in range(2):
        events.write.mode("append").parquet(f"{path}/in")
    stream = lambda: sessions(read_stream(spark, f"{path}/in", events.schema, files_per_trigger=1000), ["user_id"], "6 hours", "1 day")
    first = follow(stream(), path)
    old = events.withColumns({"ts": F.col("ts") - F.expr("interval 90 days"), "event_id": -F.col("event_id") - 1})
    old.write.mode("append").parquet(f"{path}/in")
    last = follow(stream(), path)
    missed = last.late - old.count() + first.late  # each late row is dropped and counted
    us = lambda c: F.unix_micros(F.col(c))
    return last.rows.select("user_id", us("start").alias("start_us"), us("end").alias("end_us"), "events", F.round("total", 2).alias("total"), F.lit(missed).cast("int").alias("late_rows"))


@query()
def built_points(spark, d):
    """The whole chain: lines are stitched, sampled between anchors, given elevations and classified."""
    from waymark.plans.flows import build_points

    at = lambda k: F.array(F.lit(-84.0) + (F.col("s_suppkey") + k) * 0.01, F.lit(34.9) + (F.col("s_suppkey") + k) * 0.012)
    trail = F.concat(F.lit("t"), F.floor(F.col("s_suppkey") / 50.0).cast("string"))
    rows = table(spark, d, "supplier")
    lines = rows.select(trail.alias("trail_id"), F.pmod(F.col("s_suppkey") * 37, F.lit(101)).alias("ord"), F.when(F.col("s_suppkey") % 3 == 0, F.array(at(1), at(0))).otherwise(F.array(at(0), at(1))).alias("coords"))
    anchors = rows.select(trail.alias("path_id"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("double").alias("mile"), at(0)[1].alias("lat"), at(0)[0].alias("lon"), F.lit("GA").alias("state"))
    known = rows.select((F.col("s_suppkey") * 10).alias("mile_tenths"), (F.col("s_suppkey") + 100).cast("int").alias("elev_ft"))
    return build_points(lines, anchors, (-84.0, 34.9), known, view(spark, d, "fx_edges"))


@query(ctes("fx_segments") + "select trail_id, count(*) as sessions, count(distinct user_id) as hikers, true as hikers_near, true as median_near, true as long_near from fx_segments group by 1")
def sketched_dashboard(spark, d):
    """Figures from sketches of two refreshes, folded, beside the exact ones and their bounds."""
    from waymark.operators import sketches

    store, rows = Store(spark, scratch(spark)), view(spark, d, "fx_segments")
    sketches.refresh(store, rows.where("start_lat < 38"))
    sketches.refresh(store, rows.where("start_lat >= 38"))
    sketches.fold(store)
    told = sketches.figures(store.read("sketches"), "trail_id").withColumnRenamed("hikers", "about")
    both = rows.withColumn("m", segment_miles()).join(F.broadcast(told.drop("sessions")), "trail_id")
    near = lambda c, q: sketches.is_quantile(F.col("m"), F.col(c), q, 0.03)
    n = F.count_distinct("user_id")
    exact = both.groupBy("trail_id").agg(n.alias("hikers"), (F.abs(F.max("about") - n) <= 0.05 * n + 1).alias("hikers_near"), near("median_miles", 0.5).alias("median_near"), near("long_miles", 0.9).alias("long_near"))
    return told.select("trail_id", "sessions").join(exact, "trail_id")
