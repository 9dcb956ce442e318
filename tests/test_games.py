"""Times around clock changes, game operators, payloads, files and streams."""

import datetime as dt

from pyspark.sql import functions as F

from broadloom.functions import payload as P
from broadloom.functions import times as D
from broadloom.operators import games as G
from broadloom.operators import merge as M
from broadloom.operators import schedule as S
from broadloom.sources import files
from broadloom.streaming import visits as T


def test_repeated_hour_is_the_earlier_instant(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 10, 25, 3, 30),), (dt.datetime(2026, 3, 29, 3, 30),), (dt.datetime(2026, 7, 1, 12, 0),)], "t timestamp_ntz")
    got = [r[0] for r in df.select(D.to_utc(F.col("t"))).collect()]
    assert got == [dt.datetime(2026, 10, 25, 0, 30), dt.datetime(2026, 3, 29, 1, 30), dt.datetime(2026, 7, 1, 9, 0)]


def test_moments(spark):
    values = ["1709294400", "1709294400000", "2024-03-01T12:00:00Z", "2024-03-01T14:00:00+02:00", "soon", None, "12"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(D.moment(F.col("v"))).collect()]
    noon = dt.datetime(2024, 3, 1, 12)
    assert got == [noon] * 4 + [None] * 3


def test_bridge_decisions(spark):
    rows = [(1, 10, True, 45, 0), (2, 10, False, 39, 74), (3, 10, False, 50, 100), (3, 11, False, 90, 75), (4, 10, True, 70, 80), (4, 11, True, 50, 80), (5, 10, False, 80, 80), (5, 11, False, 70, 80), (6, 10, False, 80, 80), (6, 11, False, 65, 80)]
    df = spark.createDataFrame(rows, "g int, cand int, same boolean, score int, side int")
    got = {r.g: (r.cand, r.verdict) for r in G.bridge_pick(df, "g", F.col("same"), F.col("score"), F.col("side"), "cand").collect()}
    assert got == {1: (10, "sure"), 2: (None, "none"), 3: (10, "sure"), 4: (10, "sure"), 5: (None, "none"), 6: (10, "ask")}


def test_trims(spark):
    rows = spark.createDataFrame([(1, "Live Dynamo Kyiv"), (2, "Dynamo Kyiv"), (3, "Ajax"), (4, "a b c d Ajax")], "id int, side string")
    ref = spark.createDataFrame([("Dynamo Kyiv",), ("Kyiv",), ("Ajax",)], "name string")
    got = {r.id: (r.text, r.cut) for r in G.trimmed_by_reference(rows, ref, "id", "side", "name").collect()}
    assert got == {1: ("Dynamo Kyiv", 1)}


def test_display_name_agrees_with_most(spark):
    rows = [(1, "Динамо Киев", 1), (1, "Dynamo Kyiv", 2), (1, "Dynamo Kiev", 3), (1, "דינמו", 0)]
    got = G.display_name(spark.createDataFrame(rows, "g int, name string, o int"), "g", "name", "o").first()
    assert got.name in ("Динамо Киев", "Dynamo Kyiv", "Dynamo Kiev")


def test_settled_moment_ties(spark):
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [(1, a, False), (1, b, True), (2, a, False), (2, b, False), (3, a, False), (3, b, False), (3, b, False)]
    got = {r.k: r.m for r in S.settled_moment(spark.createDataFrame(rows, "k int, m timestamp_ntz, p boolean"), "k", "m", "p").collect()}
    assert got == {1: b, 2: a, 3: b}


def test_payloads(spark):
    assert P.unflatten('[{"a":1,"b":2},[3,3],null,"x"]') == '{"a": ["x", "x"], "b": null}'
    assert P.unflatten('[["Reactive",1],{"k":2},5]') == '{"k": 5}'
    assert P.unflatten('[{"a":0}]') is None and P.unflatten("{") is None and P.unflatten(None) is None
    df = spark.createDataFrame([("F.C. B.", "Football Club Barcelona"), ("fcb", "Football Club Barcelona"), ("Man. Utd", "Manchester Utd"), ("Ajax", "Ajax")], "s string, f string")
    assert [r[0] for r in df.select(P.abbreviates(F.col("s"), F.col("f"))).collect()] == [True, True, True, False]


def test_files_come_back_as_they_were(spark, tmp_path):
    rows = [(1, 'a "b", c\nd', None), (2, "", "x"), (3, "é", "")]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    files.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_json(spark, str(tmp_path / "j"), df.schema).collect())) == rows
    files.write_csv(df.filter("u IS NOT NULL"), str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == rows[1:]


def test_rate_limit_stream_equals_batch(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = T.file_stream(spark, "/root/testdata/sf0.001", "events.parquet", e.schema)
    got = {(r.row_id, r.is_rejected) for r in T.run_to_table(T.rate_limit_stream(stream, "user_id", "event_id", "ts", 2, 360000), "append").collect()}
    want = {(r.event_id, r.is_rejected) for r in M.rate_limited(e.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 2, 360000).collect()}
    assert got == want and len({x for _, x in want}) == 2


def test_rate_limit_stream_whatever_the_frames(spark, tmp_path):
    """A visitor's rows come in several frames, not in order of time."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.select("event_id", "user_id", "ts").orderBy(F.desc("ts")).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = T.file_stream(spark, str(tmp_path / "e"), "*.parquet", e.select("event_id", "user_id", "ts").schema)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = {(r.row_id, r.is_rejected) for r in T.run_to_table(T.rate_limit_stream(stream, "user_id", "event_id", "ts", 2, 360000), "append").collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {(r.event_id, r.is_rejected) for r in M.rate_limited(e.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 2, 360000).collect()}


def test_bridge_pick_sorts_once(spark):
    """One sort serves all windows, and no join brings the games back."""
    df = spark.range(100).selectExpr("id % 7 AS g", "id AS cand", "true AS same", "int(id) AS score", "int(id) AS side")
    plan = G.bridge_pick(df, "g", F.col("same"), F.col("score"), F.col("side"), "cand")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count(" Sort [") == 1, plan
