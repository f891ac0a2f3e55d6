"""Queries over trails: progress, snapping, paths, polygons, elevations."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import enrich, paths, polygons, progress, snapping, stitch
from waymark.operators.nearest import nearest
from waymark.queries.registry import ORACLES, D, fixed, hav, in_order, query, table
from waymark.sources.fixtures import VIEWS, ctes, view

_MILES = f"coalesce(abs(end_mile-start_mile), {hav('start_lat', 'start_lng', 'end_lat', 'end_lng')})"
_CROSS = "case when (yi > lat) = (yj > lat) then 0 when lon < (xj-xi)*(lat-yi)/nullif(yj-yi,0)+xi then 1 else 0 end"


@query(ctes("fx_segments", "fx_trails") + f"""
select t.id as trail_id, round(coalesce(sum({_MILES}),0),4) as miles, count(s.id) as sessions, count(distinct date_begun) as trail_days,
  min(date_begun) as first_date, case when count(distinct date_begun) > 1 then max(date_begun) end as last_date,
  round(least(100.0, coalesce(sum({_MILES}),0)/total_miles*100.0),4) as pct
from fx_trails t left join fx_segments s on s.trail_id = t.id group by t.id, total_miles""")
def dashboard(spark, d):
    out = progress.dashboard(view(spark, d, "fx_segments"), view(spark, d, "fx_trails"))
    return out.select("trail_id", F.round("miles", D).alias("miles"), "sessions", "trail_days", "first_date", "last_date", F.round("pct", D).alias("pct"))


@query(ctes("fx_segments") + f"""
select user_id, trail_id, round(sum({_MILES}),4) as miles, count(*) as sessions, count(distinct date_begun) as trail_days,
  min(date_begun) as first_date, case when count(distinct date_begun) > 1 then max(date_begun) end as last_date
from fx_segments group by user_id, trail_id""")
def user_trail_totals(spark, d):
    return progress.trail_totals(view(spark, d, "fx_segments"), ["user_id", "trail_id"]).withColumn("miles", F.round("miles", D))


@query(ctes("fx_segments") + f"select id, round({_MILES},4) as miles, start_mile is null as by_distance from fx_segments")
def segment_miles(spark, d):
    return view(spark, d, "fx_segments").select("id", F.round(geo.segment_miles(), D).alias("miles"), F.col("start_mile").isNull().alias("by_distance"))


@query(ctes("fx_points") + """
select state, min(mile) as min_mile, max(mile) as max_mile,
  row_number() over (order by min({'m': coalesce(mile,0), 'o': ord})) as place from fx_points where state <> '' group by state""")
def state_mile_ranges(spark, d):
    # one row per state is left here, so the global rank is over a handful of rows
    return progress.state_mile_ranges(view(spark, d, "fx_points")).select("state", "min_mile", "max_mile", F.row_number().over(Window.orderBy("first")).cast("long").alias("place"))


@query(ctes("fx_points") + "select state, count(*) as n, min(ord) as first_ord from fx_points group by state")
def points_per_state(spark, d):
    return progress.points_per_state(view(spark, d, "fx_points"))


@query(ctes("fx_points") + "select min(elev_ft) as min_ft, max(elev_ft) as max_ft, count(*) as n from fx_points where elev_ft is not null and elev_ft <> 0")
def elevation_range(spark, d):
    return enrich.elevation_range(view(spark, d, "fx_points"))


@query(ctes("fx_points", "fx_targets") + f"""
select qid, p.ord, mile, state, round(dist,4) as dist from (
  select qid, ord, mile, state, {hav('qlat', 'qlng', 'lat', 'lon')} as dist,
    row_number() over (partition by qid order by {hav('qlat', 'qlng', 'lat', 'lon')}, ord) as rn from fx_targets, fx_points) p where rn = 1""")
def snap_coordinates(spark, d):
    out = snapping.snap_coordinates(view(spark, d, "fx_targets"), view(spark, d, "fx_points"))
    return out.select("qid", "ord", "mile", "state", F.round("dist", D).alias("dist"))


@query(ORACLES["snap_coordinates"])
def snap_coordinates_grid(spark, d):
    """As by ``snap_coordinates``, with all points under one key and all of another's left alone."""
    points = view(spark, d, "fx_points").withColumn("side", F.lit("here"))
    points = points.unionByName(points.withColumns({"side": F.lit("there"), "lat": F.col("lat") + 0.01})).select("ord", "lat", "lon", "side", F.struct("mile", "state").alias("value"))
    out = nearest(view(spark, d, "fx_targets").withColumn("side", F.lit("here")), points, ["side"])
    return out.select("qid", "ord", "value.mile", "value.state", F.round("dist", D).alias("dist"))


@query(ctes("fx_points", "fx_targets") + """
select qid, p.ord, mile, state, round(dist,4) as dist from (
  select qid, ord, mile, state, abs(coalesce(mile,0)-qmile) as dist,
    row_number() over (partition by qid order by abs(coalesce(mile,0)-qmile), ord) as rn from fx_targets, fx_points) p where rn = 1""")
def snap_miles(spark, d):
    q = view(spark, d, "fx_targets").withColumn("qstate", F.lit(None).cast("string"))
    return snapping.snap_miles(q, view(spark, d, "fx_points")).select("qid", "ord", "mile", "state", F.round("dist", D).alias("dist"))


@query(ctes("fx_points", "fx_targets") + """
, q as (select qid, qmile, (select p_type from part where p_partkey = qid % 150) as qstate from fx_targets),
b as (select qid, ord, mile, row_number() over (partition by qid order by abs(coalesce(mile,0)-qmile), ord) as rn from q join fx_points on state = qstate)
select q.qid, qstate, ord, mile from q left join b on q.qid = b.qid and rn = 1""")
def snap_miles_in_state(spark, d):
    # both sides of these joins grow with the tables, so neither is sent to all tasks
    kinds = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("qstate")).hint("merge")
    q = view(spark, d, "fx_targets").withColumn("k", F.col("qid") % 150).join(kinds, F.col("k") == F.col("p_partkey"), "left").select("qid", "qmile", "qstate")
    asked = q.withColumn("qstate", F.coalesce("qstate", F.lit("")))
    return q.select("qid", "qstate").join(snapping.snap_miles(asked, view(spark, d, "fx_points")).select("qid", "ord", "mile").hint("merge"), "qid")


@query(ctes("fx_points", "fx_segments") + """
, r as (select s.id, state, min(ord) as fo from fx_segments s join fx_points p
  on mile between least(start_mile,end_mile)-cast(0.05 as double) and greatest(start_mile,end_mile)+cast(0.05 as double) where state <> '' group by s.id, state)
select s.id, x.states from fx_segments s left join (select id, string_agg(state, ' · ' order by fo) as states from r group by id) x on x.id = s.id""")
def states_for_range(spark, d):
    return snapping.states_for_range(view(spark, d, "fx_segments"), view(spark, d, "fx_points"))


@query(ctes("fx_points", "fx_edges") + f"""
, f as (select feature_idx, min(xi) as a, max(xi) as b, min(yi) as c, max(yi) as e from fx_edges group by feature_idx),
h as (select ord, x.feature_idx, state_e as state from (select p.ord, g.feature_idx, g.state as state_e, sum({_CROSS}) as n
  from fx_points p join f on lon between a and b and lat between c and e join fx_edges g on g.feature_idx = f.feature_idx group by p.ord, g.feature_idx, g.state) x where n % 2 = 1),
m as (select ord, min(feature_idx) as k from h group by ord)
select p.ord, coalesce(case when h.state in ('NC','TN') then 'NC-TN' else h.state end, p.state) as state, h.state is not null as matched
from fx_points p left join m on m.ord = p.ord left join h on h.ord = m.ord and h.feature_idx = m.k""")
def reclassify(spark, d):
    return polygons.reclassify(view(spark, d, "fx_points"), view(spark, d, "fx_edges")).select("ord", "state", "matched")


@query(ctes("fx_edges") + """
select feature_idx, state, min(xi) as min_lon, max(xi) as max_lon, min(yi) as min_lat, max(yi) as max_lat from fx_edges group by feature_idx, state""")
def bounding_boxes(spark, d):
    return polygons.bounding_boxes(view(spark, d, "fx_edges"))


_PATH = ctes("fx_points") + """, path as (select ord as idx, ord % 7 = 6 as gap, cast(floor(cast(ord as double)/cast(700 as double)) as int) as run_idx, lat, lon from fx_points)"""


def _path(spark, d) -> DataFrame:
    return view(spark, d, "fx_points").select(F.lit("p").alias("path_id"), F.col("ord").alias("idx"), F.floor(F.col("ord") / F.lit(700.0)).cast("int").alias("run_idx"), "lat", "lon")


_CUM = f""", st as (select *, case when lag(run_idx) over (order by idx) = run_idx then {hav('lag(lat) over (order by idx)', 'lag(lon) over (order by idx)', 'lat', 'lon')} else 0 end as step from path),
cum as (select idx, run_idx, lat, lon, sum(step) over (order by idx rows between unbounded preceding and current row) as cum from st)"""


@query(_PATH + _CUM + " select idx, round(cum, 4) as cum from cum")
def cumulative_miles(spark, d):
    return paths.cumulative_miles(_path(spark, d)).select("idx", F.round("cum", D).alias("cum"))


@query(ctes("fx_points", "fx_targets") + f"""
, n as (select count(*) as n from fx_points), v as (select row_number() over (order by ord) - 1 as i, lat, lon from fx_points),
q as (select qid, qlat, qlng, n, floor(greatest(0,least(1,qmile/cast(2190 as double)))*(n-1)+0.5) as c, floor(cast(0.10 as double)*n+0.5) as r from fx_targets, n)
select qid, i as vertex from (select qid, i, row_number() over (partition by qid order by {hav('qlat', 'qlng', 'lat', 'lon')}, i) as rn from q join v on i between c - r and c + r) where rn = 1""")
def nearest_vertices(spark, d):
    q = view(spark, d, "fx_targets").select("qid", F.lit("p").alias("path_id"), F.col("qlat").alias("lat"), F.col("qlng").alias("lng"), F.col("qmile").alias("mile"))
    return paths.nearest_vertices(q, _path(spark, d))


@query(_PATH + f", fx_targets as ({VIEWS['fx_targets']})" + _CUM + """
, seg as (select idx, cum as c1, lat as lat1, lon as lon1, lag(cum) over w as c0, lag(lat) over w as lat0, lag(lon) over w as lon0, lag(run_idx) over w as r0, run_idx from cum window w as (order by idx)),
t as (select qid, qmile as t from fx_targets), hit as (select qid, t, lat0 + (lat1-lat0)*f as lat, lon0+(lon1-lon0)*f as lon, row_number() over (partition by qid order by idx) as rn from
  (select *, case when c1 > c0 then (t-c0)/(c1-c0) else 0 end as f from t join seg on r0 = run_idx and c1 >= t - 1e-9)),
l as (select lat, lon from cum order by idx desc limit 1)
select t.qid, round(coalesce(h.lat, l.lat), 6) as lat, round(coalesce(h.lon, l.lon), 6) as lon from t left join hit h on h.qid = t.qid and rn = 1, l""")
def interpolate(spark, d):
    t = view(spark, d, "fx_targets").select("qid", F.lit("p").alias("path_id"), F.col("qmile").alias("t"))
    return paths.interpolate(t, _path(spark, d)).select("qid", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(ctes("fx_points") + """
, k as (select l_linenumber * 10 + l_quantity as mile_tenths, l_suppkey as e from lineitem), m as (select cast(mile_tenths as bigint) as t, min(cast(e as int)) as e from k group by 1)
select ord, coalesce(elev_ft, m.e) as elev_ft, m.t is not null as cache_hit from fx_points left join m on cast(floor(mile*10+0.5) as bigint) = m.t""")
def with_elevation(spark, d):
    known = table(spark, d, "lineitem").select((F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("mile_tenths"), F.col("l_suppkey").cast("int").alias("elev_ft"))
    return enrich.with_elevation(view(spark, d, "fx_points"), known).select("ord", "elev_ft", "cache_hit")


_ANCHORS = f"""
, fx_targets as ({VIEWS['fx_targets']}), near as (select qid, state from (select qid, state, row_number() over (partition by qid order by abs(coalesce(mile,0)-qmile), ord) as rn from fx_targets, fx_points) where rn = 1),
hit as (select qid, idx as vertex, dist from (select qid, idx, {hav('qlat', 'qlng', 'lat', 'lon')} as dist, row_number() over (partition by qid order by {hav('qlat', 'qlng', 'lat', 'lon')}, idx) as rn from fx_targets, path) where rn = 1),
an as (select t.qid as ord, qmile as mile, qlat as lat, qlng as lon, near.state, vertex, dist from fx_targets t join near on near.qid = t.qid join hit on hit.qid = t.qid)"""


def _anchors(spark, d) -> DataFrame:
    targets = view(spark, d, "fx_targets")
    near = snapping.snap_miles(targets.select("qid", "qmile", F.lit(None).cast("string").alias("qstate")), view(spark, d, "fx_points")).select("qid", "state")
    return targets.join(near, "qid").select(F.lit("p").alias("path_id"), F.col("qid").alias("ord"), F.col("qmile").alias("mile"), F.col("qlat").alias("lat"), F.col("qlng").alias("lon"), "state")


@query(_PATH + _ANCHORS + " select ord, vertex, round(dist, 4) as dist from an")
def anchor_vertices(spark, d):
    return paths.anchor_vertices(_anchors(spark, d), _path(spark, d)).select("ord", "vertex", F.round("vertex_miles", D).alias("dist"))


@query(_PATH + _ANCHORS + " select count(*) as far, (select string_agg(cast(ord as varchar), ',' order by ord) from (select ord from an where dist > 1 order by ord limit 5)) as examples from an where dist > 1")
def far_anchors(spark, d):
    far = enrich.far_anchors(paths.anchor_vertices(_anchors(spark, d), _path(spark, d)), 1.0)
    return far.select("far", F.nullif(F.array_join("examples", ","), F.lit("")).alias("examples"))


_FIRST = "cast(floor(cast(" + fixed("(mile+cast(0.1 as double))", 1) + " as double)*10+0.5) as bigint)"


@query(_PATH + _CUM + _ANCHORS + f"""
, pa as (select an.*, c.cum as c0 from an join cum c on c.idx = an.vertex),
pr as (select *, lead(mile) over w as mile_b, lead(lat) over w as lat_b, lead(lon) over w as lon_b, lead(vertex) over w as vertex_b, lead(c0) over w as c1 from pa window w as (order by ord)),
wa as (select *, (cast(tenth as double)/cast(10 as double) - mile)/(mile_b-mile) as f from (select *, unnest(generate_series({_FIRST}, cast(ceil(mile_b*10-1e-8) as bigint)-1)) as tenth from pr where mile_b is not null)),
seg as (select idx, cum as e1, lat as lat1, lon as lon1, lag(cum) over w as e0, lag(lat) over w as lat0, lag(lon) over w as lon0, lag(run_idx) over w as r0, run_idx from cum window w as (order by idx)),
pt as (select ord, tenth, state, c0+(c1-c0)*f as t from wa where vertex_b > vertex),
pl as (select ord, tenth, state, lat0+(lat1-lat0)*g as lat, lon0+(lon1-lon0)*g as lon, row_number() over (partition by ord, tenth order by idx) as rn from
  (select *, case when e1 > e0 then (t-e0)/(e1-e0) else 0 end as g from pt join seg on r0 = run_idx and e1 >= t - 1e-9)),
l as (select lat, lon from cum order by idx desc limit 1)
select cast(tenth as double)/cast(10 as double) as mile, round(lat+(lat_b-lat)*f,6) as lat, round(lon+(lon_b-lon)*f,6) as lon, state, false as is_anchor from wa where vertex_b <= vertex
union all select cast(pt.tenth as double)/cast(10 as double), round(coalesce(pl.lat, l.lat),6), round(coalesce(pl.lon, l.lon),6), pt.state, false from pt left join pl on pl.ord = pt.ord and pl.tenth = pt.tenth and rn = 1, l
union all select mile, round(lat,6), round(lon,6), state, true from an""")
def sample_path(spark, d):
    return paths.sample_path(_anchors(spark, d), _path(spark, d)).drop("path_id").withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query()
def match_in_order(spark, d):
    """A path for each thousand points: the ordered search is sequential along a path."""
    of = F.floor(F.col("ord") / F.lit(1000.0)).alias("path_id")
    p = view(spark, d, "fx_points")
    return paths.match_in_order(p.select(of, "ord", (F.col("lat") + 0.001).alias("lat"), "lon"), p.select(of, F.col("ord").alias("idx"), "lat", "lon"))


@query(ctes("fx_points", "fx_targets") + """
, v as (select row_number() over (order by ord) - 1 as i, lat, lon from fx_points), e as (select qid, least(qid*3, qid*2+20) as lo, greatest(qid*3, qid*2+20) as hi, qlat, qlng from fx_targets),
s as (select qid, i - lo as pos, lon, lat from e join v on i between lo and hi where hi > lo)
select qid, row_number() over (partition by qid order by pos) - 1 as pos, lon, lat from s
union all select qid, 0, qlng, qlat from e where qid not in (select qid from s) union all select qid, 1, qlng, qlat from e where qid not in (select qid from s)""")
def slice_paths(spark, d):
    e = view(spark, d, "fx_targets").select("qid", F.lit("p").alias("path_id"), (F.col("qid") * 3).alias("a"), (F.col("qid") * 2 + 20).alias("b"), *[F.col(x).alias(n) for x, n in (("qlat", "start_lat"), ("qlng", "start_lng"), ("qlat", "end_lat"), ("qlng", "end_lng"))])
    return paths.sliced(e, _path(spark, d))


@query("select p_partkey, cast(row_number() over (order by p_partkey // 700, p_partkey) - 1 + p_partkey // 700 as bigint) as idx from part")
def global_index(spark, d):
    v = table(spark, d, "part").select("p_partkey", F.lit("p").alias("path_id"), F.floor(F.col("p_partkey") / F.lit(700.0)).cast("int").alias("run_idx"), (F.col("p_partkey") % 700).alias("vertex_idx"))
    return paths.global_index(v).select("p_partkey", "idx")


@query()
def stitch_lines(spark, d):
    """A trail for each fifty lines: the greedy order is sequential along a trail."""
    at = lambda k: F.array((F.lit(-84.0) + (F.col("s_suppkey") + k) * F.lit(0.01)), (F.lit(34.0) + (F.col("s_suppkey") + k) * F.lit(0.012)))
    line = F.when(F.col("s_suppkey") % 3 == 0, F.array(at(1), at(0))).otherwise(F.array(at(0), at(1)))
    trail = F.concat(F.lit("t"), F.floor(F.col("s_suppkey") / F.lit(50.0)).cast("string")).alias("trail_id")
    return stitch.stitch(table(spark, d, "supplier").select(trail, F.pmod(F.col("s_suppkey") * 37, F.lit(101)).alias("ord"), line.alias("coords")), (-84.0, 34.0))


@query("""
with v as (select o_custkey, cast(o_orderkey % 5 as int) as seg, row_number() over (partition by o_custkey, o_orderkey % 5 order by o_orderkey) - 1 as vertex, o_totalprice as lon from orders),
k as (select *, case seg when 0 then 1 when 1 then 2 when 4 then 3 end as place from v where seg in (0,1,4))
select 'c' || o_custkey as trail_id, row_number() over (partition by o_custkey order by place, vertex) - 1 as idx, lon from k where vertex > 0 or place = 1""")
def picked_segments(spark, d):
    o = table(spark, d, "orders").withColumn("seg_idx", (F.col("o_orderkey") % 5).cast("int"))
    v = o.withColumn("vertex_idx", F.row_number().over(Window.partitionBy("o_custkey", "seg_idx").orderBy("o_orderkey")) - 1)
    v = v.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("trail_id"), "seg_idx", "vertex_idx", F.col("o_totalprice").alias("lon"), F.lit(0.0).alias("lat"))
    return stitch.concatenate(v, [0, 1, 4]).select("trail_id", "idx", "lon")


_HOLES = ctes("fx_points", "fx_edges") + """, holes as (select feature_idx, state, 0 as poly_idx, ring_idx, xi, yi, xj, yj from fx_edges
union all select feature_idx, state, 0, 1, xi*cast(0.5 as double)+x0*cast(0.5 as double)+cast(0.125 as double), yi*cast(0.5 as double)+y0*cast(0.5 as double)+cast(0.5 as double), xj*cast(0.5 as double)+x0*cast(0.5 as double)+cast(0.125 as double), yj*cast(0.5 as double)+y0*cast(0.5 as double)+cast(0.5 as double)
 from fx_edges join (select feature_idx as k, x0, y0 from fx_boxes) b on b.k = fx_edges.feature_idx)"""


def _holes(spark, d) -> DataFrame:
    e, b = view(spark, d, "fx_edges"), view(spark, d, "fx_boxes").select(F.col("feature_idx").alias("k"), "x0", "y0")
    inner = e.join(b, e["feature_idx"] == b["k"])
    half = lambda c, o, shift: (F.col(c) * 0.5 + F.col(o) * 0.5 + shift).alias(c)
    inner = inner.select("feature_idx", "state", "poly_idx", F.lit(1).alias("ring_idx"), half("xi", "x0", 0.125), half("yi", "y0", 0.5), half("xj", "x0", 0.125), half("yj", "y0", 0.5))
    return e.drop("edge_idx").unionByName(inner)


_FOUND = f"""
, r as (select ord, feature_idx, state_e, ring_idx, sum({_CROSS}) % 2 = 1 as hit from (select ord, lat, lon, feature_idx, h.state as state_e, ring_idx, xi, yi, xj, yj from fx_points, holes h) group by ord, feature_idx, state_e, ring_idx),
f as (select ord, feature_idx, state_e from r group by ord, feature_idx, state_e having bool_or(hit and ring_idx = 0) and not bool_or(hit and ring_idx = 1)),
done as (select p.ord, p.state as old, f.state_e, case when f.state_e in ('NC','TN') then 'NC-TN' else f.state_e end as new from fx_points p left join (select * from f qualify row_number() over (partition by ord order by feature_idx) = 1) f on f.ord = p.ord)"""


@query(_HOLES + _FOUND + " select ord, coalesce(new, old) as state, state_e is not null as matched from done")
def reclassify_holes(spark, d):
    return polygons.reclassify(view(spark, d, "fx_points"), _holes(spark, d)).select("ord", "state", "matched")


@query(_HOLES + _FOUND + """
select cast(sum(case when new is not null and new is distinct from old then 1 else 0 end) as bigint) as changed, count(*) - count(new) as unmatched, count(*) as points,
  (select string_agg(cast(ord as varchar), ',' order by ord) from (select ord from done where new is null order by ord limit 5)) as examples from done""")
def reclassify_summary(spark, d):
    return polygons.reclassify_summary(polygons.reclassify(view(spark, d, "fx_points"), _holes(spark, d))).withColumn("examples", F.array_join("examples", ","))


@query(ctes("fx_points") + "select state, n, first_ord, row_number() over (order by n desc, first_ord) - 1 as place from (select state, count(*) as n, min(ord) as first_ord from fx_points group by state)")
def most_points_first(spark, d):
    return in_order(progress.most_points_first(view(spark, d, "fx_points")))


@query(ctes("fx_points") + "select ord, mile from fx_points where elev_ft is null")
def pending_elevations(spark, d):
    return enrich.pending(view(spark, d, "fx_points")).select("ord", "mile")


@query(ORACLES["with_elevation"].replace("select ord, coalesce(elev_ft, m.e) as elev_ft, m.t is not null as cache_hit", "select count(m.t) as hits, count(*) - count(m.t) as misses"))
def cache_counts(spark, d):
    known = table(spark, d, "lineitem").select((F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("mile_tenths"), F.col("l_suppkey").cast("int").alias("elev_ft"))
    return enrich.cache_counts(enrich.with_elevation(view(spark, d, "fx_points"), known))


@query(ctes("fx_segments") + f"select id, date_begun, round({_MILES},4) as miles from fx_segments where trail_id = 'click'")
def trail_panel(spark, d):
    from waymark.plans.flows import trail_panel as panel

    return panel(view(spark, d, "fx_segments"), "click").select("id", "date_begun", F.round("miles", D).alias("miles"))


@query(ctes("fx_segments", "fx_trails") + f"""
, m as (select t.id, total_miles, coalesce(sum(case when user_id = 7 then {_MILES} end),0) as miles from fx_trails t left join fx_segments s on s.trail_id = t.id group by t.id, total_miles)
select id as trail_id, round(miles,4) as miles, round(least(100.0, miles/total_miles*100.0),4) as pct from m""")
def user_dashboard(spark, d):
    from waymark.plans.flows import user_dashboard as board

    segments = view(spark, d, "fx_segments").withColumn("states", F.lit(None).cast("string"))
    return board(segments, view(spark, d, "fx_trails"), 7).select("trail_id", F.round("miles", D).alias("miles"), F.round("pct", D).alias("pct"))
