"""The application's tables as SQL names: views of one principal, and functions in plain SQL.

Each principal has a session. Its tables are views whose row filter compares the owner with the
session's variable, so the filter stands in the catalog, not in the caller's query, and reaches the
scan as a constant. Functions are SQL functions, which Catalyst takes apart like any query: a filter
by ``username_available`` is an anti join. Metadata documents are read as VARIANT; one that is no JSON
gives nulls. Views order what a caller reads; who may open a session is for the platform to say.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.operators.store import POLICIES

#: Trimmed username of a metadata document; blank, missing or malformed is null.
_USERNAME = "nullif(trim(try_variant_get(try_parse_json(meta), '$.username', 'string')), '')"
_ARC = "pow(sin(radians(lat_b - lat_a) / 2), 2) + cos(radians(lat_a)) * cos(radians(lat_b)) * pow(sin(radians(lng_b - lng_a) / 2), 2)"
FUNCTIONS = (
    f"username_of(meta string) returns string return {_USERNAME}",
    # null is available, as nothing equals it
    "username_available(candidate string) returns boolean return not exists (select 1 from taken_usernames where name = lower(trim(candidate)))",
    f"great_circle_miles(lat_a double, lng_a double, lat_b double, lng_b double) returns double return 2 * 3958.8D * asin(sqrt(least(1D, {_ARC})))",
    """own_totals(trail string) returns table (trail_id string, miles double, sessions bigint) return
    select trail_id, sum(coalesce(abs(end_mile - start_mile), great_circle_miles(start_lat, start_lng, end_lat, end_lng))), count(*) from segments
    where trail is null or trail_id = trail group by trail_id""",
)


def session_of(spark: SparkSession, principal, load: Callable[[SparkSession, str], DataFrame], kind: str = "bigint") -> SparkSession:
    """A session of its own with the views profiles, segments and badges of one principal, and the
    functions. load gives a table by name in the session it is handed, or None where there is none."""
    own = spark.newSession()
    own.sql(f"declare or replace variable principal {kind}")
    own.sql(f"set variable principal = cast(:who as {kind})", args={"who": principal})
    for name, (owner, verbs) in POLICIES.items():
        if (stored := load(own, name)) is not None and "select" in verbs:
            stored.createOrReplaceTempView(f"stored_{name}")
            own.sql(f"create or replace temporary view {name} as select * from stored_{name} where {owner} = principal")
    if own.catalog.tableExists("stored_profiles"):
        # the one thing that a principal learns of others: whether a name is taken
        own.sql("create or replace temporary view taken_usernames as select distinct lower(username) as name from stored_profiles where username is not null")
    else:
        own.sql("create or replace temporary view taken_usernames as select cast(null as string) as name where false")
    for f in FUNCTIONS:
        if "from segments" not in f or own.catalog.tableExists("segments"):
            own.sql(f"create or replace temporary function {f}")
    return own


def become(session: SparkSession, principal) -> None:
    """From now on the session's views are another principal's."""
    session.sql("set variable principal = :who", args={"who": principal})
