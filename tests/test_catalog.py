"""Views and functions of a principal's session."""

import pytest

from waymark.operators.store import profiles_of, username_available
from waymark.plans.catalog import become, session_of


@pytest.fixture
def own(spark, tmp_path):
    spark.range(200).selectExpr("id", "id % 5 as user_id", "concat('t', id % 3) as trail_id", "cast(id as double) as start_mile", "if(id % 7 = 0, null, id + 2.0D) as end_mile", "34D as start_lat", "-84D as start_lng", "34.1D as end_lat", "-84D as end_lng").write.parquet(f"{tmp_path}/segments")
    spark.createDataFrame([(1, "Ann"), (2, None), (3, "böb")], "id long, username string").write.parquet(f"{tmp_path}/profiles")

    def load(session, name):
        return None if name == "badges" else session.read.parquet(f"{tmp_path}/{name}")

    return session_of(spark, 1, load)


def test_principals_see_their_rows(spark, own):
    mine = [tuple(r) for r in own.sql("select id from segments order by id").collect()]
    assert mine == [(i,) for i in range(200) if i % 5 == 1] and own.sql("select username from profiles").collect()[0][0] == "Ann"
    plan = own.sql("select id from segments where id > 9")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,1)" in plan and "GreaterThan(id,9)" in plan
    become(own, 2)
    theirs = [tuple(r) for r in own.sql("select id from segments order by id").collect()]
    assert theirs and not set(mine) & set(theirs)
    become(own, None)
    assert own.sql("select * from segments").count() == 0 and not own.catalog.tableExists("badges")
    assert not spark.catalog.tableExists("stored_segments")  # nothing is left in the caller's session


def test_functions_in_plain_sql(own):
    names = "values ('ANN '), ('bob'), ('BÖB'), (''), (cast(null as string)) t(c)"
    assert [r[0] for r in own.sql(f"select username_available(c) from {names}").collect()] == [False, True, False, True, True]
    free = own.sql(f"select c from {names} where username_available(c)")
    assert sorted(str(r[0]) for r in free.collect()) == ["", "None", "bob"] and "LeftAnti" in free._jdf.queryExecution().executedPlan().toString()
    plain = username_available(own.sql(f"select c as candidate from {names}"), own.table("stored_profiles")).collect()
    assert {(r["candidate"], r["available"]) for r in plain} == {("ANN ", False), ("bob", True), ("BÖB", False), ("", True), (None, True)}
    got = {r["trail_id"]: (r["miles"], r["sessions"]) for r in own.sql("select * from own_totals(null)").collect()}
    assert sum(n for _, n in got.values()) == 40 and [r["trail_id"] for r in own.sql("select * from own_totals('t1')").collect()] == ["t1"]
    assert own.sql("select great_circle_miles(34D, -84D, 34D, -84D)").first()[0] == 0.0


def test_documents_as_variant(own):
    docs = ['{"username": " Ann "}', '{"username": "  "}', "{}", "[1, 2]", '{"username": 12}', '{"username": null}', "{bad", "", None, '{"username": "a", "username": "b"}', '"text"']
    df = own.createDataFrame([(i, t) for i, t in enumerate(docs)], "id long, raw_user_meta_data string")
    df.createOrReplaceTempView("docs")
    got = {r[0]: r[1] for r in own.sql("select id, username_of(raw_user_meta_data) from docs").collect()}
    assert [got[i] for i in range(9)] == ["Ann", None, None, None, "12", None, None, None, None] and got[10] is None
    assert got[9] is None or got[9] in ("a", "b")  # a name given twice
    plain = {r["id"]: r["username"] for r in profiles_of(df).collect()}
    assert all(plain[i] == got[i] for i in range(9))
