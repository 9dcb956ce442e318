"""Trims by a book of phrases and over pairs: languages, whole sides, ties, nulls."""

import datetime as dt

from broadloom.operators import trims as T

NOON = dt.datetime(2024, 5, 1, 12)
RULES = [("home", "live", None), ("home", "live from", ["en"]), ("away", "cup final", ["de"]), ("away", "final", None), ("home", "fc", None)]


def test_trim_by_book(spark):
    rows = [
        (1, "LIVE from Ajax", "PSV", ["en"]), (2, "Live from Ajax", "PSV", ["de"]), (3, "Live", "PSV", None), (4, "Live - Ajax", "PSV Cup Final", ["de", "fr"]), (5, "Ajax", "PSV cup final", ["fr"]),
        (6, "Ajax live", "PSV", None), (7, None, "PSV final", None), (8, "live x", "PSV", None), (9, "", "", None),
    ]
    df = spark.createDataFrame(rows, "id int, h string, a string, langs array<string>")
    got = {r.id: (r.home, r.away, r.cut) for r in T.trim_by_book(df, spark.createDataFrame(RULES, "side string, phrase string, langs array<string>"), "id", "h", "a", "langs").collect()}
    assert got == {1: ("Ajax", "PSV", "LIVE from"), 2: ("from Ajax", "PSV", "Live"), 4: ("Ajax", "PSV", "Live … Cup Final"), 5: ("Ajax", "PSV cup", "final")}


def test_book_rules(spark):
    cuts = [("home", " Liga  e Kombeve", None, "A", True), ("home", "heart of", "en", "Heart", False), ("home", "Heart of", "en", "heart U19", False), ("away", "live", "en", "A", False), ("away", "LIVE", "de", "B", False), (None, "x", None, "A", True), ("home", None, None, "A", True)]
    got = {(r.side, r.phrase, tuple(r.langs) if r.langs else None) for r in T.book_rules(spark.createDataFrame(cuts, "side string, phrase string, lang string, team string, by_person boolean")).collect()}
    assert got == {("home", "liga e kombeve", None), ("away", "live", ("de", "en"))}


def test_trim_over_pair(spark):
    rows = [(1, "Live: Ajax", "PSV", NOON), (2, "Ajax", "PSV", NOON), (3, "Cup Ajax", "PSV - live", NOON), (4, "a b c d Ajax", "PSV", NOON), (5, "Big Real", "Porto", NOON), (6, "x Ajax", "PSV", NOON + dt.timedelta(hours=9)), (7, None, "PSV", NOON), (8, "x Ajax", "PSV", None)]
    pairs = [(10, "Ajax", "PSV", NOON), (11, "Real", "Porto", NOON), (12, "Real", "Porto", NOON + dt.timedelta(hours=2)), (13, None, "PSV", NOON)]
    df = spark.createDataFrame(rows, "id int, h string, a string, at timestamp_ntz")
    got = {r.id: (r.ref, r.home, r.away, r.cut) for r in T.trim_over_pair(df, spark.createDataFrame(pairs, "ref int, home string, away string, start timestamp_ntz"), "id", "h", "a", "at").collect()}
    assert got == {1: (10, "Ajax", "PSV", 1), 3: (10, "Ajax", "PSV", 2)}


def test_silent_watchers(spark):
    from pyspark.sql import functions as F

    from broadloom.operators.audit import silent_watchers

    limits = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("d", 10), ("e", 10)], "name string, most int")
    minutes = lambda n: NOON - dt.timedelta(minutes=n)
    beats = spark.createDataFrame([("a", minutes(50)), ("a", minutes(5)), ("b", minutes(30)), ("e", minutes(-9))], "name string, at timestamp_ntz")
    missing = spark.createDataFrame([("c", minutes(11)), ("b", minutes(99))], "name string, first_at timestamp_ntz")
    ask = lambda **k: {r.name: (r.minutes, r.seen, r.silent) for r in silent_watchers(limits, beats, missing, F.lit(NOON), **k).collect()}
    assert ask() == {"a": (5, True, False), "b": (30, True, True), "c": (11, False, True), "d": (0, False, False), "e": (0, True, False)}
    assert ask(uptime=F.lit(8)) == {"a": (5, True, False), "b": (8, True, False), "c": (8, False, False), "d": (0, False, False), "e": (0, True, False)}


def test_title_twins(spark):
    from broadloom.operators.games import title_twins

    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    sessions = make([(1, NOON), (2, NOON), (3, None)], "into int, start timestamp_ntz")
    titles = make([(10, NOON), (11, NOON), (12, NOON + dt.timedelta(minutes=1)), (13, NOON), (14, None), (1, NOON)], "twin int, start timestamp_ntz")
    marks = make([(10, "x"), (10, "y"), (10, "x"), (11, "x"), (11, "z"), (12, "x"), (1, "x")], "twin int, channel string")
    seen = make([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (2, "w")], "into int, channel string")
    assert {(r.twin, r["into"]) for r in title_twins(sessions, titles, marks, seen).collect()} == {(10, 1), (1, 2)}


def test_title_twins_of_one_minute_do_not_all_meet(spark):
    """4,000 titles and as many sessions of one minute, three sets of channels."""
    from pyspark.sql import functions as F

    from broadloom.operators.games import title_twins

    n = 4000
    games = lambda name, first: spark.range(first, first + n).select(F.col("id").alias(name), F.lit(NOON).alias("start"))
    marks = lambda name, first: spark.range(first, first + n).select(F.col("id").alias(name), F.explode(F.slice(F.array(F.lit("x"), F.lit("y"), F.lit("z")), 1, (F.col("id") % 3 + 1).cast("int"))).alias("channel"))
    seen = marks("into", 0).union(spark.createDataFrame([(0, None)], "into long, channel string"))
    out = title_twins(games("into", 0), games("twin", 2000), marks("twin", 2000).union(spark.createDataFrame([(5000, None)], "twin long, channel string")), seen)
    assert {r.twin: r["into"] for r in out.collect()} == {k: k % 3 for k in range(2000, 2000 + n) if k != 5000}
    assert {r.twin: r["into"] for r in title_twins(games("into", 0), games("twin", 0), marks("twin", 0), seen).filter("twin < 6").collect()} == {0: 1, 1: 2, 2: 5, 3: 0, 4: 1, 5: 2}


def test_sides_are_trimmed_once_whatever_their_rows(spark, monkeypatch):
    """2,000 rows of three home sides and two away sides, in two languages and none."""
    from pyspark.sql import functions as F

    asked = []
    trims = T._side_trims
    monkeypatch.setattr(T, "_side_trims", lambda sides, *more: (asked.append(sides.count()), trims(sides, *more))[1])
    k = F.col("id")
    homes = F.array(F.lit("Live from Ajax"), F.lit("Ajax"), F.lit(None))
    rows = spark.range(2000).select("id", F.get(homes, (k % 3).cast("int")).alias("h"), F.when(k % 2 == 0, "PSV Cup Final").otherwise("PSV").alias("a"), F.when(k % 5 == 0, F.array(F.lit("en"))).when(k % 5 == 1, F.array(F.lit("de"))).alias("langs"))
    got = {r.id: (r.home, r.away, r.cut) for r in T.trim_by_book(rows, spark.createDataFrame(RULES, "side string, phrase string, langs array<string>"), "id", "h", "a", "langs").collect()}
    want = {}
    for i in range(2000):
        home = None if i % 3 == 2 else ("Ajax", "") if i % 3 else ("from Ajax", "Live") if i % 5 == 1 else ("Ajax", "Live from")
        away = ("PSV", "") if i % 2 else ("PSV Cup", "Final") if i % 5 == 0 else ("PSV", "Cup Final")
        if home and (home[1] or away[1]):
            want[i] = (home[0], away[0], " … ".join(c for c in (home[1], away[1]) if c))
    assert got == want and asked == [4]


def test_only_cuts_that_leave_known_names_are_tried(spark, monkeypatch):
    """1,000 rows of four words a side: sixteen cuts each, of which one leaves a known pair."""
    met = []
    meet = T.within
    monkeypatch.setattr(T, "within", lambda left, *more: (met.append(left.count()), meet(left, *more))[1])
    rows = spark.createDataFrame([(i, "The big cup Ajax" if i % 2 else "The big cup Nowhere", "PSV live on tv", NOON) for i in range(1000)] + [(1000, "", "PSV", NOON), (1001, None, "PSV", NOON)], "id int, h string, a string, at timestamp_ntz")
    pairs = spark.createDataFrame([(10, "Ajax", "PSV", NOON), (11, None, "Real", NOON)], "ref int, home string, away string, start timestamp_ntz")
    got = {r.id: (r.ref, r.home, r.away, r.cut) for r in T.trim_over_pair(rows, pairs, "id", "h", "a", "at").collect()}
    assert got == {i: (10, "Ajax", "PSV", 6) for i in range(1, 1000, 2)} and met == [500]
    copies = pairs.union(spark.createDataFrame([(12, "Ajax", "PSV", NOON)], pairs.schema))
    assert T.trim_over_pair(rows, copies, "id", "h", "a", "at").count() == 0 and T.trim_over_pair(rows, pairs.union(pairs), "id", "h", "a", "at").count() == 500
