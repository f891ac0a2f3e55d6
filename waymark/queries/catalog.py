"""Queries in plain SQL over a principal's session."""

from functools import partial

from pyspark.sql import functions as F

from waymark.operators.store import profiles_of
from waymark.plans.catalog import become, session_of
from waymark.queries.registry import D, ORACLES, hav, query, table
from waymark.sources.fixtures import ctes, view


def _load(d, session, name):
    if name == "profiles":
        return profiles_of(view(session, d, "fx_users"))
    return view(session, d, "fx_segments") if name == "segments" else None


@query(ORACLES["username_available"])
def sql_username_available(spark, d):
    own = session_of(spark, 7, partial(_load, d))
    table(own, d, "customer").createOrReplaceTempView("customer")
    return own.sql("select c_custkey, username_available(case when c_custkey % 2 = 0 then upper(c_name) else concat(c_name, 'x') end) as available from customer")


@query(ctes("fx_segments") + f"""
select user_id, trail_id, round(sum(coalesce(abs(end_mile - start_mile), {hav('start_lat', 'start_lng', 'end_lat', 'end_lng')})), {D}) as miles, count(*) as sessions
from fx_segments where user_id in (7, 8) group by 1, 2""")
def principal_totals(spark, d):
    """What two principals see of one table, by a table function over their views."""
    own = session_of(spark, 7, partial(_load, d))
    mine = own.sql(f"select 7L as user_id, trail_id, round(miles, {D}) as miles, sessions from own_totals(null)")
    become(own, 8)
    return mine.unionByName(own.sql(f"select 8L as user_id, trail_id, round(miles, {D}) as miles, sessions from own_totals(null)"))


@query(ctes("fx_users") + """
select id, case when id % 5 <> 0 then nullif(trim(json_extract_string(raw_user_meta_data, '$.username')), '') end as username from fx_users""")
def variant_profiles(spark, d):
    """Usernames from documents read as VARIANT, some of them cut off and so no JSON."""
    own = session_of(spark, 7, partial(_load, d))
    cut = F.when(F.col("id") % 5 == 0, F.concat(F.lit('{"username": '), F.col("raw_user_meta_data"))).otherwise(F.col("raw_user_meta_data"))
    view(own, d, "fx_users").select("id", cut.alias("meta")).createOrReplaceTempView("users")
    return own.sql("select id, username_of(meta) as username from users")
