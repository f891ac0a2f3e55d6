"""Golden rows of the trail operators and properties that hold for any data."""

import json
import math
import random
import time
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, labels
from waymark.operators import enrich, nearest, paths, polygons, progress, snapping, stitch, store
from waymark.queries import ORACLES, QUERIES
from waymark.sources import readers, writers
from waymark.sources.fixtures import view

SF = "/root/testdata/sf0.001"


def test_haversine(spark):
    rows = [(34.62677, -84.19388, 45.9044, -68.9213, 1116.835779), (41.277264, -72.676049, 41.285675, -72.6724, 0.611255), (0.0, 0.0, 1.0, 0.0, 69.094094)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want double")
    for r in df.select("want", geo.haversine(*[F.col(x) for x in "abcd"]).alias("got"), geo.haversine(*[F.col(x) for x in "cdab"]).alias("back")).collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-6) and r["got"] == pytest.approx(r["back"])
    assert df.select(geo.haversine(F.lit(None).cast("double"), F.col("b"), F.col("c"), F.col("d"))).first()[0] is None


def test_fixed_decimals(spark):
    want = {0.05: "0.1", 0.15: "0.1", 0.25: "0.3", 0.35: "0.3", 0.45: "0.5", 1.45: "1.4", 2.5: "2.5", 1.005: "1.0", 6.55: "6.5", 99.95: "100.0"}
    df = spark.createDataFrame([(k,) for k in want], "x double")
    assert [r[0] for r in df.select(labels.to_fixed(F.col("x"), 1)).collect()] == list(want.values())


def test_durations_and_days(spark):
    df = spark.createDataFrame([("3", "hours"), ("1.5", "days"), ("", "hours"), ("0", "hours"), ("x", "days")], "t string, u string")
    assert [r[0] for r in df.select(labels.duration_minutes(F.col("t"), F.col("u"))).collect()] == [180, 2160, None, 0, None]
    seg = spark.sql("select 't' trail_id, 0D start_lat, 0D start_lng, 0D end_lat, 0D end_lng, a start_mile, b end_mile, cast(d as date) date_begun from values (0D, 5D, '2026-06-05'), (3D, 8D, '2026-06-05'), (1D, 1D, '2026-06-07') v(a, b, d)")
    r = progress.trail_totals(seg, ["trail_id"]).first()
    assert (r["miles"], r["sessions"], r["trail_days"], str(r["last_date"])) == (10.0, 3, 2, "2026-06-07")
    assert progress.trail_totals(seg.where("date_begun = '2026-06-05'"), ["trail_id"]).first()["last_date"] is None


def points(spark):
    return spark.createDataFrame([(0, 1.0, 41.0, -72.0, "CT"), (1, 2.0, 41.1, -72.0, "CT"), (2, 3.0, 41.2, -72.0, "MA"), (3, None, 41.3, -72.1, "CT"), (4, None, 41.3, -72.1, None)], "ord long, mile double, lat double, lon double, state string")


def test_snap_miles(spark):
    q = spark.createDataFrame([(1, 0.3, "CT"), (2, 1.5, "CT"), (3, 9.0, "CT"), (4, 5.0, "MA"), (5, 2.6, None), (6, 1.0, "VT"), (7, None, "CT")], "qid long, qmile double, qstate string")
    got = {r["qid"]: (r["ord"], r["mile"]) for r in snapping.snap_miles(q, points(spark)).collect()}
    assert got == {1: (3, None), 2: (0, 1.0), 3: (1, 2.0), 4: (2, 3.0), 5: (2, 3.0), 6: (None, None), 7: (None, None)}


def test_snap_coordinates(spark):
    q = spark.createDataFrame([(1, 41.29, -72.1), (2, -80.0, 179.9), (3, None, 1.0)], "qid long, qlat double, qlng double")
    got = {r["qid"]: r["ord"] for r in snapping.snap_coordinates(q, points(spark)).collect()}
    assert got[1] == 3 and got[2] is not None and got[3] is None
    assert snapping.snap_coordinates(q, points(spark).limit(0)).where("mile is null").count() == 3


def brute_nearest(asked, points):
    """(ord, dist) by comparing with all points."""
    p = np.radians([(b, c) for _, b, c in points])
    out = []
    for y, x in np.radians(asked):
        h = np.sin((p[:, 0] - y) / 2) ** 2 + np.cos(y) * np.cos(p[:, 0]) * np.sin((p[:, 1] - x) / 2) ** 2
        out.append(2 * geo.EARTH_MILES * np.arcsin(np.sqrt(np.minimum(h, 1.0))))
    return out


SPOTS = {
    "trail": lambda r: (35 + (t := r.random()) * 10, -84 + t * 12 + r.random() * 0.01), "world": lambda r: (r.uniform(-90, 90), r.uniform(-180, 180)), "poles": lambda r: (r.choice([-1, 1]) * r.uniform(89.9, 90), r.uniform(-180, 180)),
    "date line": lambda r: (r.uniform(-1, 1), r.choice([-1, 1]) * r.uniform(179.99, 180)), "spot": lambda r: (34.5 + r.random() * 1e-5, -84 + r.random() * 1e-5), "point": lambda r: (10.0, 20.0),
}


@pytest.mark.parametrize("spots", SPOTS)
def test_nearest_by_brute_force(spark, spots):
    """Near and far queries of points of every kind; a qid that is asked for several places."""
    rng = random.Random(spots)
    points_ = [(k, *SPOTS[spots](rng)) for k in range(1500)]
    asked = [SPOTS[spots](rng) for _ in range(60)] + [SPOTS["world"](rng) for _ in range(30)] + [(34.105, -84.0), (10.0, 20.0), (90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (0.0, -180.0)]
    df = spark.createDataFrame([(*p, "v") for p in points_], "ord long, lat double, lon double, value string")
    q = spark.createDataFrame([(k % 5, *a) for k, a in enumerate(asked)], "qid long, qlat double, qlng double")
    got = {(r["qid"], r["qlat"], r["qlng"]): (r["ord"], r["dist"]) for r in nearest.nearest(q, df).collect()}
    assert len(got) == len(set((k % 5, *a) for k, a in enumerate(asked)))
    for k, (a, d) in enumerate(zip(asked, brute_nearest(asked, points_))):
        place, dist = got[k % 5, *a]
        assert dist == pytest.approx(d.min(), abs=1e-6) and d[place] == pytest.approx(d.min(), abs=1e-6)


def test_nearest_of_its_key(spark):
    """Null keys are equal, a key without points has no row, the least ord wins ties."""
    p = spark.createDataFrame([(5, 1.0, 1.0, "a", 0), (3, 1.0, 1.0, "a", 0), (1, 50.0, 50.0, "b", 0), (2, 1.0, 1.0, None, 0)], "ord long, lat double, lon double, k string, value int")
    q = spark.createDataFrame([(1, 1.5, 1.0, "a"), (1, 1.5, 1.0, "b"), (1, 1.5, 1.0, None), (1, 1.5, 1.0, "c"), (1, 1.5, 1.0, "a")], "qid long, qlat double, qlng double, k string")
    assert {(r["k"], r["ord"]) for r in nearest.nearest(q, p, ["k"]).collect()} == {("a", 3), ("b", 1), (None, 2)} and nearest.nearest(q, p, ["k"]).count() == 3
    assert nearest.nearest(q, p.limit(0), ["k"]).count() == 0 and nearest.nearest(q.limit(0), p, ["k"]).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_many_nearest_in_one_spot(spark, monkeypatch, small):
    """20,000 queries on 60,000 points within a small part of what was one cell; also by shuffled joins."""
    if not small:
        monkeypatch.setattr(nearest, "SMALL_ROWS", 0)
    n = 1 if small else 10
    p = spark.range(60_000 // n).selectExpr("id as ord", "34.5 + pmod(xxhash64(id), 1000003) * 1e-9 as lat", "-84 + pmod(xxhash64(id, 1), 1000003) * 1e-9 as lon", "1 as value")
    q = spark.range(20_000 // n).selectExpr("id as qid", "34.5 + pmod(xxhash64(id, 2), 1000003) * 1e-9 as qlat", "-84 + pmod(xxhash64(id, 3), 1000003) * 1e-9 as qlng")
    start = time.monotonic()
    got = {r["qid"]: r for r in nearest.nearest(q, p).collect()}
    assert len(got) == 20_000 // n and time.monotonic() - start < 60
    some, rows = [got[k] for k in range(0, 20_000 // n, 997 // n)], p.select("ord", "lat", "lon").collect()
    for r, d in zip(some, brute_nearest([(r["qlat"], r["qlng"]) for r in some], rows)):
        assert r["dist"] == pytest.approx(d.min(), abs=1e-7)


def test_states_for_range(spark):
    s = spark.createDataFrame([(1, 3.0, 1.0), (2, 1.96, 1.97), (3, 1.2, 1.3), (4, None, 2.0)], "id long, start_mile double, end_mile double")
    assert {r["id"]: r["states"] for r in snapping.states_for_range(s, points(spark)).collect()} == {1: "CT · MA", 2: "CT", 3: None, 4: None}


def square(x0, y0, x1, y1, ring):
    p = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return [(0, "S", 0, ring, *map(float, p[i] + p[i - 1])) for i in range(4)]


def test_containment(spark):
    edges = spark.createDataFrame(square(0, 0, 4, 4, 0) + square(1, 1, 3, 3, 1), "feature_idx int, state string, poly_idx int, ring_idx int, xi double, yi double, xj double, yj double")
    inside, outside = [(0.5, 0.5), (0, 0), (0, 2), (2, 0), (3, 2), (2, 3)], [(2, 2), (4, 4), (4, 2), (2, 4), (1, 2), (2, 1), (9, 9)]
    p = spark.createDataFrame([(i, float(y), float(x), "old") for i, (x, y) in enumerate(inside + outside)], "ord long, lat double, lon double, state string")
    done = polygons.reclassify(p, edges)
    assert {r["ord"] for r in done.where("state = 'S'").collect()} == set(range(len(inside)))
    assert tuple(polygons.reclassify_summary(done).first()) == (6, 7, 13, [6, 7, 8, 9, 10])


def gap_path(spark):
    return spark.createDataFrame([("p", 0, 0, 0.0, 0.0), ("p", 1, 0, 0.0, 0.01), ("p", 3, 1, 0.0, 0.03), ("p", 4, 1, 0.0, 0.05)], "path_id string, idx long, run_idx int, lat double, lon double")


def test_samples_jump_gaps(spark):
    cum = [r["cum"] for r in paths.cumulative_miles(gap_path(spark)).orderBy("idx").collect()]
    assert cum == pytest.approx([0, 0.690941, 0.690941, 2.072823], abs=1e-6)
    anchors = spark.createDataFrame([("p", 0, 0.0, 0.0, 0.0, "A"), ("p", 1, 1.0, 0.0, 0.05, "B")], "path_id string, ord long, mile double, lat double, lon double, state string")
    rows = paths.sample_path(anchors, gap_path(spark)).where("not is_anchor").orderBy("mile").collect()
    assert [r["lon"] for r in rows] == [0.003, 0.006, 0.009, 0.032, 0.035, 0.038, 0.041, 0.044, 0.047]
    t = spark.createDataFrame([(1, "p", 99.0), (2, "p", 0.0)], "qid long, path_id string, t double")
    assert {r["qid"]: r["lon"] for r in paths.interpolate(t, gap_path(spark)).collect()} == {1: 0.05, 2: 0.0}
    g = paths.global_index(gap_path(spark).withColumnRenamed("idx", "vertex_idx"))
    assert sorted(r["idx"] for r in g.collect()) == [0, 1, 3, 4]


def test_stitch():
    a, b, c, d, e = [(-84.19, 34.63), (-84.18, 34.64)], [(-84.16, 34.66), (-84.18, 34.64)], [(-83.00, 35.50), (-83.01, 35.49)], [(-84.16, 34.66), (-84.15, 34.67)], [(-84.0, 34.0)]
    assert stitch.order_lines([c, b, d, a, e], (-84.19388, 34.62677)) == [[(-84.19, 34.63), (-84.18, 34.64), (-84.16, 34.66), (-84.15, 34.67)], [(-83.01, 35.49), (-83.0, 35.5)]]


def test_points_are_built_from_lines(spark):
    """Three lines out of order, four anchors, two of one mile, a square and its border."""
    from waymark.plans.flows import build_points

    lines = spark.createDataFrame([("t", 2, [[0.2, 0.0], [0.1, 0.0]]), ("t", 1, [[0.0, 0.0], [0.1, 0.0]]), ("t", 3, [[0.2, 0.0], [0.3, 0.0]])], "trail_id string, ord long, coords array<array<double>>")
    anchors = spark.createDataFrame([("t", 0, 0.0, 0.0, 0.0, "GA"), ("t", 1, 0.5, 0.0, 0.1, "GA"), ("t", 2, 0.5, 0.0, 0.1, "GA"), ("t", 3, 1.0, 0.0, 0.3, "GA")], "path_id string, ord long, mile double, lat double, lon double, state string")
    known = spark.createDataFrame([(k, 100 + k) for k in (0, 3, 7)], "mile_tenths int, elev_ft int")
    edges = spark.createDataFrame(square(0.1, -1.0, 0.2, 1.0, 0), "feature_idx int, state string, poly_idx int, ring_idx int, xi double, yi double, xj double, yj double")
    rows = sorted((r["mile"], r["is_anchor"], round(r["lon"], 6), r["state"], r["elev_ft"]) for r in build_points(lines, anchors, (0.0, 0.0), known, edges).collect())
    want = []
    for k in range(11):
        lon = round(0.02 * k if k <= 5 else 0.1 + 0.04 * (k - 5), 6)
        row = (k / 10, k in (0, 5, 10), lon, "S" if 0.1 <= lon < 0.2 else "GA", 100 + k if k in (0, 3, 7) else None)
        want += [row] * (2 if k == 5 else 1)
    assert rows == sorted(want, key=lambda r: r[:3])


def test_store(spark):
    df = spark.createDataFrame([("1", "u", "t"), ("2", "v", "t")], "id string, user_id string, trail_id string")
    own = store.Secured(df, "segments", "u")
    assert [r["id"] for r in own.select().collect()] == ["1"] and own.delete(["1", "2", "9"]).count() == 1
    both, new = own.insert(spark.createDataFrame([("u", "x")], "user_id string, trail_id string"))
    assert both.count() == 3 and new.first()["id"]
    with pytest.raises(store.Refused):
        own.insert(spark.createDataFrame([("v", "x")], "user_id string, trail_id string"))
    with pytest.raises(store.Refused):
        store.Secured(df, "badges", "u").delete(["1"])
    with pytest.raises(store.Refused):
        store.single(df)
    p = spark.createDataFrame([("1", "Bob"), ("2", None)], "id string, username string")
    asked = spark.createDataFrame([(" bob ",), ("al",), (None,)], "candidate string")
    assert {r["candidate"]: r["available"] for r in store.username_available(asked, p).collect()} == {" bob ": False, "al": True, None: True}


def test_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"id": "a", "mile": 1, "lat": 1.5, "lon": 2.5, "state": "CT"}, {"id": "b", "lat": 2, "lon": 3, "spur": True}]))
    p = readers.read_points(spark, f"{tmp_path}/p.json")
    assert [(r["ord"], r["mile"], r["spur"]) for r in p.orderBy("ord").collect()] == [(0, 1.0, None), (1, None, True)]
    assert json.loads(writers.points_json(p.select("file", "ord", "id")).first()["value"]) == [{"id": "a"}, {"id": "b"}]
    geo_json = {"features": [{"geometry": {"type": "MultiLineString", "coordinates": [[[0, 1], [2, 3]], [[4, 5]], [[6, 7], [8, 9]]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(geo_json))
    v = readers.read_geometry(spark, f"{tmp_path}/g.json")
    assert v.count() == 4 and readers.main_run(v).count() == 2
    poly = {"features": [{"properties": {"name": "", "NAME": "One"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}
    (tmp_path / "s.json").write_text(json.dumps(poly))
    known = spark.createDataFrame([("One", "ON")], "name string, code string")
    assert {(r["state"], r["edge_idx"]) for r in readers.read_boundaries(spark, f"{tmp_path}/s.json", known).collect()} == {("ON", i) for i in range(4)}


def test_elevation(spark):
    p = spark.createDataFrame([(5.0, None), (5.1, 7), (None, None)], "mile double, elev_ft int")
    known = spark.createDataFrame([(50, 100), (51, 200)], "mile_tenths int, elev_ft int")
    out = enrich.with_elevation(p, known)
    assert {(r["mile"], r["elev_ft"]) for r in out.collect()} == {(5.0, 100), (5.1, 7), (None, None)}
    assert tuple(enrich.cache_counts(out).first()) == (2, 1) and enrich.pending(out).count() == 1


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "trail_id" in out.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sql, name):
    """Each core query equals its SQL on the smallest tables."""
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = sql.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(k) for k in cols]
    text = lambda r: tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in r)
    assert sorted(text(r) for r in df.select(*cols).collect()) == sorted(text(r[i] for i in at) for r in want.fetchall())


@pytest.fixture(scope="module")
def sql():
    import duckdb

    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_path_queries_take_whole_tables(spark):
    points, targets = view(spark, SF, "fx_points").count(), view(spark, SF, "fx_targets").count()
    assert QUERIES["match_in_order"](spark, SF).select("ord").distinct().count() == points
    rows = QUERIES["sample_path"](spark, SF).collect()
    assert sum(r["is_anchor"] for r in rows) == targets and len(rows) > targets
    assert all(r["state"] is not None for r in rows if r["is_anchor"])


def miles(a, b):
    y0, x0, y1, x1 = (math.radians(v) for v in (*a, *b))
    h = math.sin((y1 - y0) / 2) ** 2 + math.cos(y0) * math.cos(y1) * math.sin((x1 - x0) / 2) ** 2
    return 2 * geo.EARTH_MILES * math.asin(math.sqrt(min(h, 1.0)))


@pytest.mark.parametrize("window", [3, 64, 4096])
def test_ordered_match_stops_early(window):
    """Against the plain scan, on a path that comes back near its start."""
    rng = random.Random(4096)
    path = [(35 + 0.3 * math.sin(k / 40), -83 + 0.001 * (k % 150) + rng.random() / 2000) for k in range(500)]
    anchors = [(a + rng.choice([0, 1e-4, 0.02]), b) for a, b in (path[min(499, k + rng.randrange(-5, 6))] for k in range(10, 480, 9))]
    want, at, stopped = [], 0, 0
    for a in anchors:
        best, place = math.inf, at
        for i in range(at, len(path)):
            d = miles(a, path[i])
            if d < best:
                best, place = d, i
            elif d > best * 3 and best < 0.1:
                stopped += 1
                break
        want.append(at := place)
    assert stopped and paths.scan(np.array(anchors), np.array(path), window) == want


def test_matches_go_forward(spark):
    rows = QUERIES["match_in_order"](spark, SF).orderBy("path_id", "ord").collect()
    assert all(b["vertex"] >= a["vertex"] for a, b in zip(rows, rows[1:]) if a["path_id"] == b["path_id"])


def test_samples_before_an_odd_mile(spark):
    anchors = spark.createDataFrame([("p", 0, 0.0, 0.0, 0.0, "A"), ("p", 1, 0.53, 0.0, 0.05, "B"), ("p", 2, 0.6, 0.0, 0.05, "B"), ("p", 3, 1.0, 0.0, 0.05, "B")], "path_id string, ord long, mile double, lat double, lon double, state string")
    got = [r["mile"] for r in paths.sample_path(anchors, gap_path(spark)).where("not is_anchor").orderBy("mile").collect()]
    assert got == [0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.8, 0.9]


def test_fixed_decimals_are_exact(spark):
    rng = random.Random(1)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(400)] + [k / 8 for k in range(-40, 40)] + [0.0, -0.0, 1e-300, 5e-7, 4.9999999e-7, 0.9999995, 9.95, 2.0**52 + 0.5]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(1)
    for places in (1, 3, 6):
        for r in df.select("x", labels.to_fixed(F.col("x"), places).alias("t")).collect():
            want = str(Decimal(abs(r["x"])).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
            assert r["t"] == ("-" if r["x"] < 0 else "") + want
    assert spark.range(1).select(labels.to_fixed(F.lit(float("nan")), 1)).first()[0] is None


def test_blocks_split_and_hot_keys(spark):
    """Blocks of two and parts of three rows give what one window would."""
    from waymark.operators import blocks

    rng = random.Random(4)
    known = [(k, rng.choice([None, "a", "b"]), float(rng.randrange(40)) / 4) for k in range(80)]
    asked = [(k, rng.choice([None, "a", "b", "c"]), rng.choice([5.0, rng.uniform(-5, 15)])) for k in range(200)]
    kd = spark.createDataFrame(known, "tie long, k string, at double").withColumn("value", F.struct("tie"))
    ad = spark.createDataFrame(asked, "q long, k string, at double")
    for r in blocks.asof(ad, kd, ["k"], "at", 2.0, part_rows=3).collect():
        mine = [(t, a) for t, k, a in known if k == r["k"]]
        before = min(((-a, t) for t, a in mine if a <= r["at"]), default=None)
        after = min(((a, t) for t, a in mine if a >= r["at"]), default=None)
        assert (r["before"] and (-r["before"]["at"], r["before"]["tie"])) == before and (r["after"] and (r["after"]["at"], r["after"]["tie"])) == after


def test_update_keeps_the_owner(spark):
    df = spark.createDataFrame([("1", "u", "t"), ("2", "v", "t")], "id string, user_id string, trail_id string")
    own = store.Secured(df, "segments", "u")
    assert {tuple(r) for r in own.update("1", trail_id="n").collect()} == {("1", "u", "n"), ("2", "v", "t")}
    assert own.update("2", trail_id="n").where("trail_id = 'n'").count() == 0
    with pytest.raises(store.Refused):
        own.update("1", user_id="v")


def test_intermediate_tables_can_be_discarded(spark):
    from waymark import session

    path = session.scratch(spark)
    spark.range(3).write.parquet(path)
    session.discard(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_states_of_long_ranges(spark):
    """Ranges of any length, also below zero and beyond the longest run, against a plain scan."""
    rng = random.Random(8)
    pts = [(k, rng.uniform(-50, 300_000) if k % 3 else rng.uniform(-5, 60), rng.choice(["A", "B", "C", "D", "", None])) for k in range(300)]
    segs = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60) if i % 2 else rng.uniform(-60, 300_000)) for i in range(150)]
    p = spark.createDataFrame(pts, "ord long, mile double, state string")
    s = spark.createDataFrame(segs, "id long, start_mile double, end_mile double")
    for r in snapping.states_for_range(s, p).collect():
        _, a, b = segs[r["id"]]
        first = {}
        for o, m, t in pts:
            if t and min(a, b) - 0.05 <= m <= max(a, b) + 0.05:
                first.setdefault(t, o)
        assert r["states"] == (" · ".join(sorted(first, key=first.get)) or None)


@pytest.mark.parametrize("name", ["snap_miles", "snap_miles_in_state"])
def test_lookups_by_mile_send_no_table_to_all_tasks(spark, name):
    """Only the list of blocks in which more than PART_ROWS ask is sent, to asked and known rows."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert len(sent) == 2 and all("LeftOuter" in line for line in sent), sent


def shuffled(spark, run):
    """What run() gives, and how many records and bytes its stages write for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    each = lambda s: [s.apply(k) for k in range(s.size())]
    last = max((s.stageId() for s in each(stages())), default=-1)
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    new = [s for s in each(stages()) if s.stageId() > last]
    return out, sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new)


def long_path(spark, n):
    at = F.col("id").cast("double")
    return spark.range(n).select(F.lit("p").alias("path_id"), F.col("id").alias("idx"), F.lit(0).alias("run_idx"), (F.lit(30.0) + at * 2e-4).alias("lat"), (F.lit(-80.0) + F.pmod(at, F.lit(250.0)) * 0.01).alias("lon"))


def test_vertex_lookups_meet_few_stretches(spark):
    """A tenth of a path on either side is 188 stretches; a question meets far fewer."""
    at = F.col("id").cast("double")
    q = spark.range(1000).select(F.col("id").alias("qid"), F.lit("p").alias("path_id"), (F.lit(30.0) + at * 0.012).alias("lat"), (F.lit(-80.0) + at * 0.001).alias("lng"), (at * 2.19).alias("mile"))
    rows, sent, _ = shuffled(spark, lambda: paths.nearest_vertices(q, long_path(spark, 60_000)).collect())
    assert len(rows) == 1000 and all(r["vertex"] is not None for r in rows) and sent < 188 * 1000


@pytest.mark.parametrize("shape", [(8, 2, 3), (64, 16, 256)])
def test_vertex_lookup_by_brute_force(spark, monkeypatch, shape):
    """Trees of many levels and of one; unknown and repeated places, unknown paths, vertices without a place."""
    monkeypatch.setattr(paths, "STRETCH", shape[0])
    monkeypatch.setattr(paths, "FAN", shape[1], raising=False)
    monkeypatch.setattr(paths, "BEGIN", shape[2], raising=False)
    rng = random.Random(5)
    v = [("a", k, 0, 35 + rng.gauss(0, 0.01) + (k % 400) * 0.005, -84 + rng.gauss(0, 0.01) + k * 0.002) for k in range(900)] + [("b", k * 2, k, 10.0, 20.0) for k in range(5)]
    v = [(*r[:3], None if r[1] % 50 == 7 else r[3], r[4]) for r in v]
    places = [(35 + rng.random() * 2, -84 + rng.random() * 2) for _ in range(40)] + [(None, -84.0), (10.0, 20.0)]
    asked = [(k, rng.choice(["a", "a", "a", "b", "c"]), *rng.choice(places), rng.choice([None, 0.0, rng.uniform(-10, 2300)])) for k in range(300)]
    got = {r["qid"]: r["vertex"] for r in paths.nearest_vertices(spark.createDataFrame(asked, "qid long, path_id string, lat double, lng double, mile double"), spark.createDataFrame(v, "path_id string, idx long, run_idx int, lat double, lon double")).collect()}
    for qid, path, lat, lng, mile in asked:
        p = [r[3:] for r in v if r[0] == path]
        c, r = math.floor(min(1, max(0, (mile or 0) / 2190)) * (len(p) - 1) + 0.5), math.floor(0.1 * len(p) + 0.5)
        window = range(max(0, c - r), min(len(p) - 1, c + r) + 1) if p else []
        d = {i: miles((lat, lng), p[i]) if lat is not None and p[i][0] is not None else math.inf for i in window}
        least = min(d.values(), default=None)
        # last digits may differ between the two ways
        assert got[qid] is None if not d else d[got[qid]] == least if least == math.inf else d[got[qid]] <= least + 1e-9
        if d and (lat is None or path == "b"):
            assert got[qid] == min(i for i in d if d[i] == least)


def test_slices_do_not_shuffle_their_vertices(spark):
    """A million places leave the tasks that have the stretches."""
    e = spark.range(200).select(F.col("id").alias("qid"), F.lit("p").alias("path_id"), (F.col("id") * 100).alias("a"), (F.col("id") * 100 + 4999).alias("b"), *[F.lit(0.0).alias(f"{x}_{c}") for x in ("start", "end") for c in ("lat", "lng")])
    operator = getattr(paths, "sliced", paths.slice_paths)
    n, _, sent = shuffled(spark, lambda: operator(e, long_path(spark, 60_000)).select(F.sum(F.size("line") if operator is paths.slice_paths else F.lit(1))).first()[0])
    assert n == 1_000_000 and sent < 8_000_000


def test_slices_of_all_kinds(spark, monkeypatch):
    """Ends in either order, equal, unknown, before and beyond the path; as rows and as lines."""
    monkeypatch.setattr(paths, "SLICE_ROWS", 4)
    path = long_path(spark, 21)
    at = [(r["lon"], r["lat"]) for r in path.orderBy("idx").collect()]
    ends = [(1, "p", 3, 9), (2, "p", 9, 3), (3, "p", 5, 5), (4, "p", None, 2), (5, "p", 18, 40), (6, "p", -3, 2), (7, "p", 30, 40), (8, "x", 1, 2), (9, "p", 0, 20), (10, "p", -9, -2)]
    e = spark.createDataFrame([(*r, 1.0, 2.0, 3.0, 4.0) for r in ends], "qid long, path_id string, a long, b long, start_lat double, start_lng double, end_lat double, end_lng double")
    want = {1: at[3:10], 2: at[3:10], 5: at[18:], 6: at[:3], 9: at}
    rows: dict = {}
    for r in sorted(paths.sliced(e, path).collect()):
        assert r["pos"] == len(rows.setdefault(r["qid"], []))
        rows[r["qid"]].append((r["lon"], r["lat"]))
    lines = {r["qid"]: [tuple(p) for p in r["line"]] for r in paths.slice_paths(e, path).collect()}
    assert rows == lines == {k: want.get(k, [(2.0, 1.0), (4.0, 3.0)]) for k in range(1, 11)}


def test_slices_of_bands(spark, monkeypatch):
    """Slices of many lengths on two paths, in bands, tiles and cuts of a few."""
    for name, value in (("SLICE_ROWS", 16), ("TILE_ROWS", 4), ("CUTS", 3), ("TASK_ROWS", (64, 64))):
        monkeypatch.setattr(paths, name, value, raising=False)
    rng = random.Random(4)
    n = {"p": 333, "r": 16}
    path = long_path(spark, n["p"]).unionByName(long_path(spark, n["r"]).withColumn("path_id", F.lit("r")))
    at: dict = {}
    for r in path.orderBy("path_id", "idx").collect():
        at.setdefault(r["path_id"], []).append((r["lon"], r["lat"]))
    # many begin in one place, and some are far longer than others
    ends = [(k, p := rng.choice("ppr"), a := rng.choice([0, 7, rng.randrange(n[p])]), rng.choice([a + 1 + rng.randrange(9), rng.randrange(n[p])])) for k in range(300)]
    e = spark.createDataFrame([(*r, 1.0, 2.0, 3.0, 4.0) for r in ends], "qid long, path_id string, a long, b long, start_lat double, start_lng double, end_lat double, end_lng double")
    want = {k: at[p][min(a, b):max(a, b) + 1] if a != b else [(2.0, 1.0), (4.0, 3.0)] for k, p, a, b in ends}
    rows: dict = {}
    for r in sorted(paths.sliced(e, path).collect()):
        assert r["pos"] == len(rows.setdefault(r["qid"], []))
        rows[r["qid"]].append((r["lon"], r["lat"]))
    assert rows == want == {r["qid"]: [tuple(p) for p in r["line"]] for r in paths.slice_paths(e, path).collect()}


def test_slices_take_little_disk_when_written(spark, tmp_path):
    """Eight million places, written by Spark as they come, in columns that repeat close by."""
    e = spark.range(1000).select(F.col("id").alias("qid"), F.lit("p").alias("path_id"), (F.col("id") * 2).alias("a"), (F.col("id") * 3 + 7499).alias("b"), *[F.lit(0.0).alias(f"{x}_{c}") for x in ("start", "end") for c in ("lat", "lng")])
    _, _, sent = shuffled(spark, lambda: paths.sliced(e, long_path(spark, 16_384)).write.parquet(f"{tmp_path}/rows"))
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 7_999_500
    size = sum(f.stat().st_size for f in tmp_path.glob("rows/*.parquet"))
    assert size < 6_000_000 and sent < 3_000_000


def test_a_capped_response_loses_no_rows(spark):
    """Every own row is there, in responses of five."""
    mine = sorted(r["id"] for r in view(spark, SF, "fx_segments").where("user_id = 7").select("id").collect())
    got = sorted((r["response"], r["id"]) for r in QUERIES["capped_segments"](spark, SF).collect())
    assert got == [(k // 5, x) for k, x in enumerate(mine)] and len(mine) > 5
    assert store.Secured(view(spark, SF, "fx_segments"), "segments", 7).select("id", row_cap=5).count() == 5
