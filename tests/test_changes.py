"""Stores that change, totals kept from a stream, resumed stages and paged reading."""

import datetime
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.operators import lookup, resume, sketches
from waymark.operators.buckets import Overtaken, Owned, Store
from waymark.operators.store import Refused
from waymark.sources import paged
from waymark.streaming import ledger, sessions


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(store, name):
    """Files of each bucket."""
    out = defaultdict(set)
    for f in store.read(name).select(F.input_file_name()).distinct().collect():
        out[int(f[0].split("_bucket=")[1].split("/")[0])].add(f[0])
    return dict(out)


@pytest.fixture
def segments(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.range(400).selectExpr("id", "cast(id % 20 as bigint) as user_id", "concat('t', id % 3) as trail_id", "cast(null as timestamp) as created_at")
    store.create("segments", rows.unionByName(rows.limit(1).withColumn("user_id", F.lit(None).cast("long"))), ["user_id"], 8)
    return store


def test_delete_rewrites_one_bucket(spark, segments):
    before, was = files(segments, "segments"), rows_of(segments.read("segments"))
    mine = Owned(segments, "segments", 7)
    own = segments.buckets_of(segments.manifest()["tables"]["segments"], spark.sql("select 7L as user_id"))[0]
    assert mine.delete([7, 27, 8, 99999]) == 2  # 8 is another's
    after = files(segments, "segments")
    assert {b: f for b, f in after.items() if b != own} == {b: f for b, f in before.items() if b != own}
    assert not after[own] & before[own]
    assert rows_of(segments.read("segments")) == [r for r in was if r[0] not in (7, 27)]
    assert rows_of(segments.read("segments", version=1)) == was  # as it was is still there
    known = segments.versions()
    assert mine.delete([8]) == 0 and segments.versions() == known and files(segments, "segments") == after
    assert segments.read("segments", [own]).select(F.input_file_name()).distinct().count() == len(after[own])


def test_insert_and_update_in_place(spark, segments):
    before, mine = files(segments, "segments"), Owned(segments, "segments", 3)
    stored = mine.insert(spark.sql("select 1000L as id, 3L as user_id, 'new' as trail_id"))
    assert stored.first()["created_at"] is not None and rows_of(stored) == rows_of(mine.select().where("id = 1000"))
    after = files(segments, "segments")
    assert all(before[b] <= after[b] for b in before) and sum(map(len, after.values())) == sum(map(len, before.values())) + 1
    assert mine.update(1000, trail_id="moved") == 1 and mine.update(4, trail_id="theirs") == 0
    assert rows_of(mine.select("id", "trail_id").where("id = 1000")) == [(1000, "moved")] and segments.read("segments").where("trail_id = 'theirs'").count() == 0
    with pytest.raises(Refused):
        mine.insert(spark.sql("select 1001L as id, 4L as user_id"))
    with pytest.raises(Refused):
        mine.update(1000, user_id=4)
    with pytest.raises(Refused):
        Owned(segments, "segments", 3, "badges").delete([1])
    assert Owned(segments, "segments", 12345).select().count() == 0 and Owned(segments, "segments", 12345).delete([1]) == 0


def test_of_two_writers_one_is_overtaken(segments):
    """The second had read the version that the first made another of."""

    def late(table):
        Owned(segments, "segments", 5).delete([5])
        return {"0": []}

    with pytest.raises(Overtaken):
        segments.change({"segments": late})
    assert segments.read("segments").where("id = 5").count() == 0 and segments.read("segments").count() == 400


def test_sweep_keeps_what_is_named(segments):
    for k in (1, 2, 3):
        Owned(segments, "segments", k).delete([k])
    was = rows_of(segments.read("segments"))
    assert segments.sweep(2) > 0 and len(segments.versions()) == 2 and segments.sweep(2) == 0
    assert rows_of(segments.read("segments")) == was and segments.read("segments", version=segments.versions()[0]).count() == 399


def test_store_of_no_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create("profiles", spark.createDataFrame([], "id long, username string"), ["id"])
    assert store.read("profiles").count() == 0 and Owned(store, "profiles", 1).update(1, username="x") == 0
    with pytest.raises(ValueError):
        store.create("profiles", spark.createDataFrame([], "id long"), ["id"])


# ---- ledger

CHANGE = "seq long, op string, id long, user_id long, trail_id string, date_begun date, start_lat double, start_lng double, end_lat double, end_lng double, start_mile double, end_mile double"


def made_changes(rng, n, seq):
    out = []
    for k in range(n):
        a = rng.choice([None, round(rng.random() * 100, 3)])
        out.append((
            seq + k if rng.random() < 0.95 else None, rng.choice(["save", "save", "delete", "other"]), rng.choice([None, *range(40)]), rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, "a", "b"]),
            rng.choice([None, *[datetime.date(2024, 1, d) for d in (1, 2, 3)]]), 34.0, -84.0, 34.5, -84.0, a, None if a is None else a + rng.random() * 10,
        ))
    return out


def recomputed(spark, batches):
    """Totals from all sections that are left, by the batch operators' own lengths."""
    live = {}
    for batch in batches:
        order = sorted(batch, key=lambda c: (c[0] is not None, c[0] or 0, c[1] == "delete"))
        for c in order:
            if c[1] == "save":
                live[c[3], c[2]] = c
            elif c[1] == "delete":
                live.pop((c[3], c[2]), None)
    df = spark.createDataFrame(list(live.values()), CHANGE).withColumn("u", ledger.units(ledger.segment_miles()))
    n = F.count_distinct("date_begun")
    return rows_of(df.groupBy("user_id", "trail_id").agg((F.sum("u") / 1e9).alias("miles"), F.count(F.lit(1)).alias("sessions"), n.alias("d"), F.min("date_begun"), F.when(n > 1, F.max("date_begun"))))


def test_totals_equal_a_recomputation(spark, tmp_path):
    rng, path, batches = random.Random(2), f"file://{tmp_path}", []
    schema = spark.createDataFrame([], CHANGE).schema
    spark.createDataFrame([], CHANGE).write.parquet(f"{path}/in/0")
    for k in range(3):
        # of changes with equal numbers the last is not defined, but for deletes
        batches.append(made_changes(rng, 120, 1000 * k))
        taken = {}
        batches[-1] = [c for c in batches[-1] if taken.setdefault((c[0], c[2], c[3]), c) is c]
        spark.createDataFrame(batches[-1], CHANGE).coalesce(1).write.mode("append").parquet(f"{path}/in/0")
        store = ledger.follow(spark.readStream.schema(schema).parquet(f"{path}/in/0"), path, 8)
        assert rows_of(ledger.totals(store)) == recomputed(spark, batches)
    known = store.versions()
    again = ledger.follow(spark.readStream.schema(schema).parquet(f"{path}/in/0"), path, 8)
    assert rows_of(ledger.totals(again)) == recomputed(spark, batches) and again.versions() == known


def test_changes_touch_few_buckets(spark, tmp_path):
    schema = spark.createDataFrame([], CHANGE).schema
    store = ledger.open_ledger(spark, f"file://{tmp_path}/s", schema, 16)
    section = lambda seq, op, i, user, trail, a, b: (seq, op, i, user, trail, datetime.date(2024, 1, 1), 0.0, 0.0, 0.0, 0.0, a, b)
    ledger.take_in(store, spark.createDataFrame([section(1, "save", i, i % 50, f"t{i % 7}", 0.0, 1.1) for i in range(2000)], CHANGE), 1)
    days, kept = files(store, "days"), files(store, "sections")
    one = spark.createDataFrame([section(1, "delete", 77, 27, None, None, None)], CHANGE)
    assert ledger.take_in(store, one, 2) and not ledger.take_in(store, one, 2)  # a batch that comes again
    changed = lambda was, name: [b for b, f in files(store, name).items() if f != was[b]]
    assert len(changed(days, "days")) == 1 and len(changed(kept, "sections")) == 1
    got = {(r["user_id"], r["trail_id"]): (r["miles"], r["sessions"]) for r in ledger.totals(store).collect()}
    assert got[27, "t0"] == pytest.approx((1.1 * (sum(1 for i in range(2000) if i % 50 == 27 and i % 7 == 0) - 1), sum(1 for i in range(2000) if i % 50 == 27 and i % 7 == 0) - 1))
    nothing = spark.createDataFrame([section(1, "delete", 5, 999, None, None, None), section(2, "delete", None, None, None, None, None)], CHANGE)
    assert ledger.take_in(store, nothing, 3) and sum(n for _, n in got.values()) == 1999 == ledger.totals(store).agg(F.sum("sessions")).first()[0]


def test_a_failed_batch_is_taken_in_once(spark, tmp_path):
    """The run dies after the store has the batch, before the stream knows: the batch comes again."""
    path, schema = f"file://{tmp_path}", spark.createDataFrame([], CHANGE).schema
    spark.createDataFrame(made_changes(random.Random(9), 100, 0), CHANGE).write.parquet(f"{path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{path}/in")

    def die(_):
        raise InterruptedError("lost")

    with pytest.raises(Exception, match="lost"):
        ledger.follow(stream(), path, 8, after=die)
    held = rows_of(ledger.totals(Store(spark, f"{path}/ledger")))
    assert held and rows_of(ledger.totals(ledger.follow(stream(), path, 8))) == held


def test_totals_of_a_stream_stay_when_nothing_is_new(spark, tmp_path):
    from waymark.streaming import progress_stream as stream

    path = f"file://{tmp_path}"
    put = lambda n: spark.range(n).selectExpr("id", "id % 3 as k").coalesce(1).write.mode("append").parquet(f"{path}/in")
    totals = lambda: rows_of(stream.run_once(stream.read_stream(spark, f"{path}/in", spark.range(1).selectExpr("id", "id % 3 as k").schema).groupBy("k").count(), f"{path}/out"))
    spark.range(0).selectExpr("id", "id % 3 as k").write.parquet(f"{path}/in")
    put(9)
    assert totals() == [(0, 3), (1, 3), (2, 3)] == totals()
    put(3)
    assert totals() == [(0, 4), (1, 4), (2, 4)] == totals()


# ---- resumed stages

def test_a_stopped_stage_makes_the_rest_alone(spark, tmp_path):
    df, path, seen = spark.range(1000).withColumn("x", F.col("id") * 2), f"file://{tmp_path}/r", []

    def build(rows):
        if not rows.isEmpty():
            seen.append(rows.count())
            if len(seen) == 3:
                raise InterruptedError
        return rows.select("id", (F.col("x") + 1).alias("y"))

    with pytest.raises(InterruptedError):
        resume.resumed(df, "id", path, build, parts=10, at_once=2)
    done = seen[:2]
    assert resume.finished(df, "id", path, 10).count() == 4
    out = resume.resumed(df, "id", path, build, parts=10, at_once=2)
    assert rows_of(out) == sorted(((i, 2 * i + 1) for i in range(1000)), key=str)
    assert sum(done) + sum(seen[3:]) == 1000 and len(seen) == 6
    assert rows_of(resume.resumed(df, "id", path, build, parts=10, at_once=2)) == rows_of(out) and len(seen) == 6
    # a snapshot of another length counts for none of the parts that differ
    more = df.unionByName(spark.createDataFrame([(5000, 1)], "id long, x long"))
    assert resume.resumed(more, "id", path, build, parts=10, at_once=2).count() == 1001 and len(seen) == 7
    other = df.where("id <> 17").unionByName(spark.createDataFrame([(17_000, 1)], "id long, x long"))
    assert rows_of(resume.resumed(other, "id", path, build, parts=10, at_once=2).select("id")) == sorted(((i,) for i in [*range(17), *range(18, 1000), 17_000]), key=str)
    resume.forget(df, path)
    assert resume.finished(df, "id", path, 10).count() == 0


def test_a_stage_that_keeps_few_rows(spark, tmp_path):
    df = spark.range(50)
    build = lambda rows: rows.where("id < 3")
    for k in range(2):
        assert rows_of(resume.resumed(df, "id", f"file://{tmp_path}/f", build, parts=20, at_once=7)) == [(0,), (1,), (2,)]
    assert resume.resumed(df.limit(0), "id", f"file://{tmp_path}/e", build).count() == 0


# ---- pages

def put_pages(folder, sizes, rows, at=0):
    folder.mkdir()
    for k, n in enumerate(sizes):
        made = []
        for _ in range(n):
            made.append({"properties": {"OBJECTID": at, "LENGTH_MI": at / 2}, "geometry": {"type": "LineString", "coordinates": [[at, 1], [at, 2.5]]}})
            at += 1
        (folder / f"page-{k * rows}.json").write_text(json.dumps({"type": "FeatureCollection", "features": made}))


@pytest.mark.parametrize("sizes,n", [([5, 5, 3], 13), ([5, 5, 5], 15), ([5, 2, 5], 7), ([5, 0, 5], 5), ([0], 0), ([], 0), ([3, 5], 3), ([5, 5, 0], 10)])
def test_pages_end_with_the_first_short_one(spark, tmp_path, sizes, n):
    put_pages(tmp_path / "p", sizes, 5)
    out = paged.read_pages(spark, f"file://{tmp_path}/p", 5)
    assert sorted(r["object_id"] for r in out.collect()) == list(range(n))
    assert all(r["coords"] == [[r["object_id"], 1.0], [r["object_id"], 2.5]] and r["length_mi"] == r["object_id"] / 2 for r in out.collect())


def test_each_page_is_a_partition(spark, tmp_path):
    put_pages(tmp_path / "p", [4] * 6 + [1], 4)
    (tmp_path / "p" / "page-32.json").write_text('{"features": [{"properties": {"OBJECTID": 99}}]}')  # behind a gap
    out = paged.read_pages(spark, f"file://{tmp_path}/p", 4)
    assert out.groupBy(F.spark_partition_id(), "offset").count().count() == 7 and out.count() == 25
    (tmp_path / "p" / "page-0.json").write_text('{"features": [{}, {"properties": null, "geometry": null}, {"geometry": {"type": "Point", "coordinates": [1, 2]}}, {"properties": {"OBJECTID": 7}}]}')
    assert rows_of(paged.read_pages(spark, f"file://{tmp_path}/p", 4).where("offset = 0").select("object_id", "coords")) == [(7, None), (None, None), (None, None), (None, None)]


def test_comparisons_reach_the_pages(spark, tmp_path):
    put_pages(tmp_path / "p", [10, 10, 4], 10)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        out = paged.read_pages(spark, f"file://{tmp_path}/p", 10).where("object_id >= 8 and object_id < 21 and length_mi <> 5")
        assert [r["object_id"] for r in out.orderBy("object_id").collect()] == [8, 9, *range(11, 21)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = paged.ComparingReader({"path": str(tmp_path / "p"), "rows": "10"})
    kept = list(reader.pushFilters([paged.GreaterThan(("object_id",), 20), paged.EqualTo(("length_mi",), 1.0)]))
    assert [type(f) for f in kept] == [paged.EqualTo] and [r[2] for p in reader.partitions() for r in reader.read(p)] == [21, 22, 23]


# ---- lookups from outside, and what a run tells of itself

def test_each_row_is_looked_up_once_and_in_order(spark, tmp_path):
    """Slow answers come back out of order; rows with a value are not asked for."""
    log = tmp_path / "log"

    def look(x):
        import os
        import time as t

        t.sleep(0.003 * (x % 5))
        with open(log, "a") as f:
            os.write(f.fileno(), f"{x}\n".encode())
        return x * 10

    df = spark.range(600, numPartitions=3).selectExpr("id", "cast(if(id % 4 = 0, -1, null) as int) as e", "'k' as e_")
    out = lookup.looked_up(df, look, ["id"], "e", pool=7)
    assert out.columns == df.columns
    rows = out.toLocalIterator()
    assert [(r["id"], r["e"], r["e_"]) for r in rows] == [(i, -1 if i % 4 == 0 else i * 10, "k") for i in range(600)]
    assert sorted(map(int, log.read_text().split())) == [i for i in range(600) if i % 4]
    assert lookup.looked_up(df.limit(0), look, ["id"], "e").count() == 0


def test_a_lookup_waits_longer_each_time_and_gives_up():
    waits, calls = [], []

    def look(x):
        calls.append(x)
        if len(calls) <= fails:
            raise OSError("busy")
        return None if x < 0 else x

    for fails in (0, 3, 5):
        waits.clear()
        calls.clear()
        assert lookup.tried(look, (7,), 5, 2.0, waits.append) == 7 and waits == [2.0 * k for k in range(1, fails + 1)]
    fails = 6
    calls.clear()
    with pytest.raises(lookup.LookupFailed):
        lookup.tried(look, (7,), 5, 2.0, waits.append)
    assert len(calls) == 6
    fails = 0
    with pytest.raises(lookup.LookupFailed):  # no value is a failure
        lookup.tried(look, (-1,), 2, 1.0, waits.append)


def test_a_row_that_always_fails_ends_the_run_and_parts_stay(spark, tmp_path):
    bad = {"on": True}

    def look(x, broken):
        if broken and x == 77:
            raise OSError("gone")
        return x

    df, path = spark.range(100).withColumn("e", F.lit(None).cast("long")), f"file://{tmp_path}/r"
    build = lambda rows: lookup.looked_up(rows.withColumn("b", F.lit(bad["on"])), look, ["id", "b"], "e", retries=1, wait=0.0).drop("b")
    with pytest.raises(Exception, match="failed after 1 retries"):
        resume.resumed(df, "id", path, build, parts=10, at_once=1)
    kept = resume.finished(df, "id", path, 10).count()
    assert kept < 10
    bad["on"], told = False, []
    out = resume.resumed(df, "id", path, build, parts=10, at_once=1, tell=told.append)
    assert rows_of(out) == sorted(((i, i) for i in range(100)), key=str) and len(told) == 10 - kept
    assert [t.done for t in told] == sorted(t.done for t in told) and told[-1].done == told[-1].total == told[-1].made and told[-1].left == 0
    assert all(t.rate > 0 and t.left == pytest.approx((t.total - t.done) / t.rate) for t in told)


# ---- sessions of a stream

EVENT = "event_id long, user string, ts timestamp, value double"


def test_late_and_repeated_events(spark, tmp_path):
    path, at = f"file://{tmp_path}", lambda m: datetime.datetime(2024, 5, 1, 12) + datetime.timedelta(minutes=m)
    put = lambda *rows: spark.createDataFrame([(i, u, None if m is None else at(m), 1.0) for i, u, m in rows], EVENT).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run = lambda: sessions.follow(sessions.sessions(spark.readStream.schema(spark.createDataFrame([], EVENT).schema).parquet(f"{path}/in"), ["user"], "10 minutes", "1 hour"), path)
    minutes = lambda rows: sorted((r["user"], int((r["start"] - at(0)).total_seconds() // 60), int((r["end"] - at(0)).total_seconds() // 60), r["events"]) for r in rows.collect())
    put()
    assert run().rows.count() == 0
    # two sessions of a, one event twice, one without a time; b is still open at the end
    put((1, "a", 0), (2, "a", 5), (2, "a", 5), (3, "a", 30), (4, "b", 200), (5, "a", None), (6, None, 40))
    got = run()
    assert minutes(got.rows.where("user is not null")) == [("a", 0, 15, 2), ("a", 30, 40, 1)] and got.rows.count() == 3 and got.late == 0
    # the watermark is at 140 minutes: two rows are late, one joins b, an old id comes again within the wait
    put((7, "a", 10), (8, "c", 100), (9, "b", 195), (4, "b", 200), (10, "d", 150))
    got = run()
    assert got.late == 2 and minutes(got.rows.where("user is not null")) == [("a", 0, 15, 2), ("a", 30, 40, 1)]
    put((11, "z", 1000))
    got = run()
    assert minutes(got.rows.where("user is not null")) == [("a", 0, 15, 2), ("a", 30, 40, 1), ("b", 195, 210, 2), ("d", 150, 160, 1)] and got.late == 0
    again = run()
    assert again.late == 0 and minutes(again.rows.where("user is not null")) == minutes(got.rows.where("user is not null"))


# ---- sketches

def test_sketches_are_within_their_bounds(spark, tmp_path):
    """Refreshes, folded or not, against exact figures; nulls are not counted."""
    rows = spark.range(40_000).selectExpr(
        "id", "if(id % 50 = 0, null, pmod(xxhash64(id), 9000)) as user_id", "concat('t', id % 3) as trail_id", "date_add(date '2024-01-01', cast(id % 11 as int)) as date_begun",
        "0D as start_mile", "if(id % 20 = 1, null, pmod(xxhash64(id, 1), 100000) / 1000D) as end_mile", "cast(null as double) as start_lat", "0D as start_lng", "0D as end_lat", "0D as end_lng",
    )
    empty = rows.limit(1).selectExpr("id", "cast(null as bigint) as user_id", "'none' as trail_id", "date_begun", "start_mile", "cast(null as double) as end_mile", "start_lat", "start_lng", "end_lat", "end_lng")
    store = Store(spark, f"file://{tmp_path}/s")
    for k in range(4):
        sketches.refresh(store, rows.where(f"id % 4 = {k}"), buckets=4)
    sketches.refresh(store, empty)
    exact = {r[0]: r[1:] for r in rows.groupBy("trail_id").agg(F.count("*"), F.countDistinct("user_id"), F.collect_list("end_mile")).collect()}
    before = store.read("sketches").count()
    for _ in range(2):
        told = {r["trail_id"]: r for r in sketches.figures(store.read("sketches"), "trail_id").collect()}
        assert (told["none"]["sessions"], told["none"]["hikers"], told["none"]["median_miles"]) == (1, 0, None)
        for t, (n, users, miles) in exact.items():
            assert told[t]["sessions"] == n and abs(told[t]["hikers"] - users) <= 4 * 1.04 / 2 ** (sketches.LG_K / 2) * users
            for q, c in ((0.5, "median_miles"), (0.9, "long_miles")):
                assert abs(sum(m <= told[t][c] for m in miles) / len(miles) - q) < 0.03
        assert sketches.fold(store) == (len(files(store, "sketches")) if _ == 0 else 0)
    assert store.read("sketches").count() < before
    assert sketches.figures(store.read("sketches")).first()["sessions"] == 40_001
