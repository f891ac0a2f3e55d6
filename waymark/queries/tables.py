"""Queries over stored tables: owners, changes, constraints, requests, streams."""

from pyspark.sql import functions as F

from waymark.operators import store
from waymark.queries.registry import D, hav, in_order, query, table
from waymark.session import scratch, stage
from waymark.sources import readers
from waymark.sources.fixtures import ctes, view


@query(ctes("fx_segments") + """
select id, trail_id, start_lat, start_lng, end_lat, end_lng, start_mile, end_mile, date_begun from fx_segments where user_id = 7""")
def secured_segments(spark, d):
    return store.Secured(view(spark, d, "fx_segments"), "segments", 7).select("id", "trail_id", "start_lat", "start_lng", "end_lat", "end_lng", "start_mile", "end_mile", "date_begun")


@query(ctes("fx_users") + "select id, nullif(trim(json_extract_string(raw_user_meta_data,'$.username')),'') as username from fx_users")
def profiles_of_users(spark, d):
    return store.profiles_of(view(spark, d, "fx_users"))


@query(ctes("fx_users") + """
, p as (select id, nullif(trim(json_extract_string(raw_user_meta_data,'$.username')),'') as username from fx_users)
select c_custkey, not exists (select 1 from p where lower(p.username) = lower(trim(case when c_custkey % 2 = 0 then upper(c_name) else c_name || 'x' end))) as available from customer""")
def username_available(spark, d):
    names = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.concat("c_name", F.lit("x")))
    asked = table(spark, d, "customer").select("c_custkey", names.alias("candidate"))
    return store.username_available(asked, store.profiles_of(view(spark, d, "fx_users"))).select("c_custkey", "available")


@query(ctes("fx_segments") + "select id, user_id from fx_segments where not (user_id = 7 and id in (1,2,3,4,5,6,7,8,9,10))")
def delete_segments(spark, d):
    return store.Secured(view(spark, d, "fx_segments"), "segments", 7).delete(list(range(1, 11))).select("id", "user_id")


@query(ctes("fx_segments") + "select id, user_id, trail_id, start_mile from fx_segments union all select cast(-1 as bigint), cast(7 as bigint), 'new', cast(1.5 as double)")
def insert_segment(spark, d):
    row = spark.createDataFrame([(-1, 7, "new", 1.5)], "id long, user_id long, trail_id string, start_mile double")
    return store.Secured(view(spark, d, "fx_segments"), "segments", 7).insert(row)[0].select("id", "user_id", "trail_id", "start_mile")


@query("""
select 'unique(o_custkey,o_orderdate)' as rule, count(*) as n from (select 1 from orders group by o_custkey, o_orderdate having count(*) > 1)
union all select 'not_null(o_totalprice)', count(*) from orders where o_totalprice is null
union all select 'references(o_custkey)', count(*) from orders o where o_custkey is not null and not exists (select 1 from customer c where c.c_custkey = o.o_custkey)""")
def constraint_violations(spark, d):
    t = lambda n: table(spark, d, n)
    return store.violations(t("orders"), [["o_custkey", "o_orderdate"]], ["o_totalprice"], {"o_custkey": (t("customer"), "c_custkey")})


_PROFILES = ctes("fx_users") + ", p as (select id, nullif(trim(json_extract_string(raw_user_meta_data,'$.username')),'') as username from fx_users)"


@query(ctes("fx_segments") + "select id, date_begun, row_number() over (order by date_begun desc nulls first, id) - 1 as place from fx_segments where user_id = 7")
def newest_segments(spark, d):
    return in_order(store.newest_first(store.Secured(view(spark, d, "fx_segments"), "segments", 7).select("id", "date_begun")))


@query(ctes("fx_segments") + "select id, (row_number() over (order by id) - 1) // 5 as response from fx_segments where user_id = 7")
def capped_segments(spark, d):
    """All own rows: the cap bounds what one response brings."""
    return store.Secured(view(spark, d, "fx_segments"), "segments", 7).responses("id", 5, "id")


@query("select 'at least' as guard, count(*) as rows, true as raised from orders union all select 'at most', count(*), true from orders union all select 'between', count(*), false from orders")
def guarded_rows(spark, d):
    """A table that is too short or too long for its guard is refused, another passes."""
    orders = table(spark, d, "orders").select("o_orderkey")
    n, out = orders.count(), []
    for guard, bounds in (("at least", {"at_least": n + 1}), ("at most", {"at_most": n - 1}), ("between", {"at_least": n, "at_most": n})):
        try:
            out.append((guard, readers.require_rows(orders, **bounds).count(), False))
        except ValueError:
            out.append((guard, n, True))
    return spark.createDataFrame(out, "guard string, rows long, raised boolean")


@query(ctes("fx_segments") + "select id, start_mile from fx_segments order by id limit 50 offset 150")
def page_of_segments(spark, d):
    return store.page(view(spark, d, "fx_segments").select("id", "start_mile"), ["id"], 3, 50)


@query(_PROFILES + " select id, username from p where id = 5")
def own_profile(spark, d):
    return store.single(store.Secured(store.profiles_of(view(spark, d, "fx_users")), "profiles", 5).select())


@query(_PROFILES + " select id, case when id = 5 then 'trail_name' else username end as username from p")
def updated_username(spark, d):
    return store.Secured(store.profiles_of(view(spark, d, "fx_users")), "profiles", 5).update(5, username="trail_name")


@query("select o_orderkey as id, cast(o_orderdate as date) as date_begun, cast(null as date) as date_completed, cast(null as int) as duration_minutes, cast(null as varchar) as states from orders")
def migrated_dates(spark, d):
    return store.migrate_dates(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("hiked_date")))


@query(ctes("fx_trails") + "select id, total_miles from fx_trails where id = 'ASIA'")
def trail_by_id(spark, d):
    return store.single(view(spark, d, "fx_trails").where("id = 'ASIA'"))


#: Requests of every kind: blank states and texts, texts that are no number, unknown states, equal ends, no date.
_REQUESTS = """
select s_suppkey as req_id, case when s_suppkey % 9 = 0 then ' ' when s_suppkey % 10 = 0 then 'XX' else 'SMALL' end as start_state, 'SMALL' as end_state,
  case when s_suppkey % 7 = 0 then '' when s_suppkey % 8 = 0 then 'ten' else cast(s_suppkey as string) end as start_text,
  case when s_suppkey % 6 = 0 then cast(s_suppkey as string) else cast(s_suppkey + 9 as string) end as end_text,
  case when s_suppkey % 13 <> 0 then date '2026-06-05' end as date_begun
from supplier"""
_CHECKED = ctes("fx_points") + f""", req as ({_REQUESTS.replace('as string', 'as varchar')}), pts as (select ord, mile, case when ord % 100 <> 99 then 'SMALL' end as state from fx_points),
n as (select *, try_cast(start_text as double) as a, try_cast(end_text as double) as b from req),
snap as (select req_id, side, ord, mile from (select req_id, side, ord, mile, row_number() over (partition by req_id, side order by abs(coalesce(mile,0)-m), ord) as rn
  from (select req_id, 'a' as side, start_state as st, a as m from n union all select req_id, 'b', end_state, b from n) q join pts on pts.state = st where m is not null) where rn = 1),
c as (select n.req_id, x.mile as start_mile, y.mile as end_mile, case when trim(start_state) = '' or trim(end_state) = '' then 'state_missing' when trim(start_text) = '' or trim(end_text) = '' then 'mile_missing'
  when a is null or b is null then 'mile_not_a_number' when x.ord is null or y.ord is null then 'point_not_found' when x.mile is not distinct from y.mile then 'same_point' when date_begun is null then 'date_missing' end as error
  from n left join snap x on x.req_id = n.req_id and x.side = 'a' left join snap y on y.req_id = n.req_id and y.side = 'b')"""


def _requests(spark, d):
    from waymark.plans.flows import save_requests

    points = view(spark, d, "fx_points").withColumn("state", F.when(F.col("ord") % 100 != 99, F.lit("SMALL")))
    return save_requests(spark.sql(_REQUESTS.replace("from supplier", "from {supplier}"), supplier=table(spark, d, "supplier")), points, require_date=True)


@query(_CHECKED + """ select req_id, start_mile, end_mile, (select string_agg(distinct state, ' · ') from pts where state is not null and mile between least(start_mile,end_mile)-cast(0.05 as double) and greatest(start_mile,end_mile)+cast(0.05 as double)) as states
from c where error is null""")
def saved_requests(spark, d):
    return _requests(spark, d)[0]


@query(_CHECKED + " select req_id, error from c where error is not null")
def refused_requests(spark, d):
    return _requests(spark, d)[1]


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by event_type")
def streamed_events(spark, d):
    """Totals of the event stream, read as a stream that ends with the files there are."""
    from waymark.streaming import progress_stream as stream

    events = stream.read_stream(spark, d, table(spark, d, "events").schema, pathGlobFilter="events.parquet")
    totals = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return stream.run_once(totals, scratch(spark)).withColumn("total", F.round("total", 2))


@query(f"""
select user_id, event_type as trail_id, count(*) as sessions, round(sum(coalesce(abs(e - value), {hav('0.0', '0.0', '0.0', '1.0')})),4) as miles
from (select *, case when event_id % 7 <> 0 then value + event_id % 13 end as e from events) group by 1, 2""")
def streamed_progress(spark, d):
    from waymark.streaming import progress_stream as stream

    events = stream.read_stream(spark, d, table(spark, d, "events").schema, pathGlobFilter="events.parquet")
    sections = events.select(
        "user_id", F.col("event_type").alias("trail_id"), F.col("value").alias("start_mile"), F.when(F.col("event_id") % 7 != 0, F.col("value") + F.col("event_id") % 13).alias("end_mile"),
        *[F.lit(v).alias(n) for n, v in (("start_lat", 0.0), ("start_lng", 0.0), ("end_lat", 0.0), ("end_lng", 1.0))],
    )
    return stream.run_once(stream.running_totals(sections), scratch(spark)).withColumn("miles", F.round("miles", D))


@query("select cast(ts as date) as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def windowed_events(spark, d):
    from waymark.streaming.progress_stream import windowed_events as windowed

    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(events).select(F.to_date("window.start").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("select user_id, count(*) as n from events group by user_id")
def resumed_stage(spark, d):
    """The second call finds the finished table and does not build it again."""
    path = scratch(spark)
    stage(spark, path, lambda: table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
    return stage(spark, path, lambda: spark.range(0))
