"""The driver's tables in the shape of trail data, for queries and their SQL counterparts.

Each view is one SQL text that runs unchanged on Spark and as a common table expression
elsewhere; numbers are cast to double as engines type bare decimals differently.
"""

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_segments": """
select event_id as id, user_id, event_type as trail_id,
  cast(34.0 as double)+cast(event_id % 97 as double)*cast(0.1 as double) as start_lat,
  cast(-84.0 as double)+cast(event_id % 89 as double)*cast(0.1 as double) as start_lng,
  cast(34.05 as double)+cast(event_id % 97 as double)*cast(0.1 as double) as end_lat,
  cast(-83.98 as double)+cast(event_id % 89 as double)*cast(0.1 as double) as end_lng,
  case when event_id % 7 = 0 then null else value end as start_mile,
  case when event_id % 7 = 0 then null else value+cast(event_id % 13 as double)-cast(6 as double) end as end_mile,
  cast(ts as date) as date_begun
from events""",
    "fx_trails": """
select distinct event_type as id, cast(2198 as double) as total_miles from events
union all select r_name as id, cast(800 as double) as total_miles from region""",
    "fx_points": """
select p_partkey as ord,
  case when p_partkey % 50 = 49 then null else cast(p_partkey as double)/cast(10 as double) end as mile,
  cast(34.6 as double)+cast(p_partkey as double)*cast(0.005 as double) as lat,
  cast(-84.2 as double)+cast(p_partkey % 250 as double)*cast(0.01 as double) as lon,
  case when p_partkey % 100 = 99 then null else p_type end as state,
  case when p_partkey % 3 = 0 then null when p_partkey % 20 = 5 then 0 else p_size end as elev_ft
from part""",
    "fx_targets": """
select s_suppkey as qid,
  cast(35.0 as double)+cast(s_suppkey % 50 as double)*cast(0.1 as double) as qlat,
  cast(-83.5 as double)+cast(s_suppkey % 30 as double)*cast(0.05 as double) as qlng,
  cast(s_suppkey as double)*cast(1.3 as double) as qmile
from supplier""",
    "fx_boxes": """
select n_nationkey as feature_idx, n_name as state,
    cast(-84.0 as double)+cast(n_nationkey % 5 as double)*cast(0.5 as double) as x0,
    cast(35.0 as double)+floor(cast(n_nationkey as double)/cast(5 as double))*cast(2 as double) as y0
  from nation""",
    "fx_edges": """
select feature_idx, state, 0 as poly_idx, 0 as ring_idx, 0 as edge_idx, x0 as xi, y0 as yi, x0+cast(0.5 as double) as xj, y0 as yj from fx_boxes
union all select feature_idx, state, 0, 0, 1, x0+cast(0.5 as double), y0, x0+cast(0.5 as double), y0+cast(2 as double) from fx_boxes
union all select feature_idx, state, 0, 0, 2, x0+cast(0.5 as double), y0+cast(2 as double), x0, y0+cast(2 as double) from fx_boxes
union all select feature_idx, state, 0, 0, 3, x0, y0+cast(2 as double), x0, y0 from fx_boxes""",
    "fx_users": """
select c_custkey as id,
  case when c_custkey % 11 = 0 then '{"username":"   "}'
       when c_custkey % 13 = 0 then '{}'
       else concat('{"username":" ', c_name, ' "}') end as raw_user_meta_data
from customer""",
}
_TABLES = {"fx_segments": ["events"], "fx_trails": ["events", "region"], "fx_points": ["part"], "fx_targets": ["supplier"], "fx_boxes": ["nation"], "fx_edges": ["fx_boxes"], "fx_users": ["customer"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in sf_dir, with no effect on the session's catalog."""
    inputs = {t: view(spark, sf_dir, t) if t in VIEWS else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    text = VIEWS[name]
    for t in inputs:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text.replace("'{\"", "'{{\"").replace('"}\'', '"}}\'').replace("'{}'", "'{{}}'"), **inputs)


def ctes(*names: str) -> str:
    """A WITH clause of these views and what they stand on."""
    seen: dict[str, str] = {}

    def add(n: str) -> None:
        for t in _TABLES[n]:
            if t in VIEWS:
                add(t)
        seen.setdefault(n, VIEWS[n])

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in seen.items())
