"""Queries that make labels and read typed texts."""

from pyspark.sql import functions as F

from waymark.functions import geo, labels
from waymark.queries.registry import fixed, hav, query, table
from waymark.sources.fixtures import ctes, view

_MILES = f"coalesce(abs(end_mile-start_mile), {hav('start_lat', 'start_lng', 'end_lat', 'end_lng')})"
_LO, _HI = "least(start_mile,end_mile)", "greatest(start_mile,end_mile)"


@query("select event_id, strftime(ts, '%b %-d, %Y') as label from events")
def date_labels(spark, d):
    return table(spark, d, "events").select("event_id", labels.date_label(F.col("ts")).alias("label"))


@query("""
select event_id, cast(floor(event_id % 50 * case event_id % 3 when 0 then 1.0 when 1 then 60.0 else 1440.0 end + 0.5) as int) as minutes from events""")
def durations(spark, d):
    unit = F.when(F.col("event_id") % 3 == 0, F.lit("minutes")).when(F.col("event_id") % 3 == 1, F.lit("hours")).otherwise(F.lit("days"))
    return table(spark, d, "events").select("event_id", labels.duration_minutes((F.col("event_id") % 50).cast("string"), unit).alias("minutes"))


@query("select event_id, " + fixed("value", 1) + " as one, " + fixed("(value*cast(0.001 as double)-cast(0.05 as double))", 3) + " as three, " + fixed("(value/cast(7 as double))", 6) + " as six from events")
def fixed_decimals(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", labels.to_fixed(v, 1).alias("one"), labels.to_fixed(v * 0.001 - 0.05, 3).alias("three"), labels.to_fixed(v / 7.0, 6).alias("six"))


@query(ctes("fx_segments") + f"""
select id, case when start_mile is not null and end_mile is not null then {fixed('abs(end_mile-start_mile)', 1)} || ' mi · Mile ' || {fixed(_LO, 1)} || ' → ' || {fixed(_HI, 1)} || ' · CT'
  else '~' || {fixed('m', 1)} || ' mi · CT' end as summary from (select *, round({_MILES},3) as m from fx_segments)""")
def segment_summaries(spark, d):
    s = view(spark, d, "fx_segments").withColumn("m", F.when(F.col("start_mile").isNull(), F.round(geo.segment_miles(), 3)).otherwise(geo.segment_miles()))
    return s.select("id", labels.segment_summary(F.col("m"), F.col("start_mile"), F.col("end_mile"), F.lit("CT")).alias("summary"))


@query(ctes("fx_segments") + f"""
select id, case when start_mile is not null then 'Mile ' || {fixed(_LO, 1)} || ' → ' || {fixed(_HI, 1)} || ' (' || {fixed('abs(end_mile-start_mile)', 1)} || ' mi)' || chr(10) else '' end || 'CT' || chr(10) || strftime(date_begun, '%Y-%m-%d') as popup from fx_segments""")
def popups(spark, d):
    return view(spark, d, "fx_segments").select("id", labels.popup(F.col("start_mile"), F.col("end_mile"), F.lit("CT"), F.col("date_begun")).alias("popup"))


_PCT = "(case when o_orderkey % 5 = 0 then cast(0 as double) else o_totalprice/cast(1000000 as double) end)"


@query(f"""
select o_orderkey, case when p > 0 then {fixed('p', 1)} || ' of ' || format('{{:,}}', o_orderkey) || ' mi — ' || case when p < 0.1 then '<0.1' else {fixed('p', 1)} end || '%' else '0 of ' || format('{{:,}}', o_orderkey) || ' mi' end as card,
  case when p > 0 then case when p < 0.1 then '<0.1' else {fixed('p', 1)} end || '%' else '—' end as panel from (select o_orderkey, {_PCT} as p from orders)""")
def percent_labels(spark, d):
    p = F.when(F.col("o_orderkey") % 5 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / 1000000.0)
    return table(spark, d, "orders").select("o_orderkey", labels.card_text(p, F.col("o_orderkey").cast("double"), p).alias("card"), labels.panel_percent(p).alias("panel"))


@query("""
select c_custkey, format('{:,}', c_custkey * 977) || case c_custkey % 4 when 1 then '.25' when 2 then '.5' when 3 then '.75' else '' end as label from customer""")
def thousands_labels(spark, d):
    return table(spark, d, "customer").select("c_custkey", labels.thousands(F.col("c_custkey") * 977 + (F.col("c_custkey") % 4) * 0.25).alias("label"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'CT' when c_custkey % 3 = 1 then '2 (CT · MA)' else '3 (CT · MA · VT)' end as label from customer")
def states_labels(spark, d):
    n = (F.col("c_custkey") % 3 + 1).cast("int")
    return table(spark, d, "customer").select("c_custkey", labels.states_label(F.slice(F.array(F.lit("CT"), F.lit("MA"), F.lit("VT")), F.lit(1), n)).alias("label"))


_CODES = ("CT", "NC-TN", "WV", "ZZ")


@query("""
select p_partkey, case p_partkey % 4 when 0 then 'Connecticut' when 1 then 'NC-TN' when 2 then 'West Virginia' else 'ZZ' end || case when p_partkey % 5 = 0 then '' else
  ' (Miles ' || cast(cast(floor(p_retailprice+0.5) as bigint) as varchar) || '–' || cast(cast(floor(p_retailprice*2+0.5) as bigint) as varchar) || ')' end as label from part""")
def state_options(spark, d):
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), (F.col("p_partkey") % 4).cast("int"))
    mile = F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", labels.state_option(labels.state_name(code), mile, mile * 2).alias("label"))


@query("""
select event_id, case event_id % 5 when 0 then 'Incorrect email or password.' when 1 then 'Please confirm your email before signing in.' when 2 then 'x email not confirmed'
  when 3 then 'Password must be at least 8 characters.' else 'other' end as shown from events""")
def friendly_errors(spark, d):
    said = ("AuthApiError: Invalid login credentials", "Email not confirmed!", "x email not confirmed", "Password should be longer", "other")
    return table(spark, d, "events").select("event_id", labels.friendly_error(F.get(F.array(*[F.lit(s) for s in said]), (F.col("event_id") % 5).cast("int"))).alias("shown"))


@query("select c_custkey, regexp_full_match(name, '[a-zA-Z0-9_-]{3,30}') as valid from (select c_custkey, case c_custkey % 4 when 0 then replace(c_name, '#', '_') when 1 then c_name when 2 then left(c_name, 2) else c_name || c_name || c_name end as name from customer)")
def valid_usernames(spark, d):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.replace("c_name", F.lit("#"), F.lit("_"))).when(k == 1, F.col("c_name")).when(k == 2, F.left("c_name", F.lit(2))).otherwise(F.concat("c_name", "c_name", "c_name"))
    return table(spark, d, "customer").select("c_custkey", labels.valid_username(name).alias("valid"))


@query("select event_id, case event_id % 4 when 0 then null when 1 then value when 2 then -event_id else event_id * 1000.0::double end as number from (select event_id, round(value, 2) as value from events)")
def parsed_numbers(spark, d):
    k, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit("x"), n)).when(k == 1, F.concat(F.lit(" "), F.round("value", 2).cast("string"), F.lit(" mi"))).when(k == 2, F.concat(F.lit("-"), n, F.lit("abc"))).otherwise(F.concat(n, F.lit("e3")))
    return table(spark, d, "events").select("event_id", labels.parse_number(text).alias("number"))
