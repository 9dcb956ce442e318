"""Fates of the games of an old build: every rung, nulls, ties and empty tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from broadloom.operators import builds as B

NOON = dt.datetime(2024, 5, 1, 12)
OLD = "old_id long, pair string, start timestamp_ntz, channels array<string>, ref_start timestamp_ntz, league string, price int"
NEW = "new_id long, pair string, start timestamp_ntz, channels array<string>, league string, price int"


def at(minutes):
    return NOON + dt.timedelta(minutes=minutes)


def run(spark, old, new, cases=("x", "y")):
    got = B.fates(spark.createDataFrame(old, OLD), spark.createDataFrame(new, NEW), spark.createDataFrame([(c,) for c in cases], "channel string"), ["league", "price"])
    return {r.old_id: (r.fate, r.new_id, tuple(r.fields), tuple(r.missing)) for r in got.collect()}


def test_every_fate(spark):
    old = [
        (1, "a", at(0), ["c1", "c2"], None, "L", 1), (2, "b", at(0), ["c1"], None, "L", None), (3, "d", at(0), ["c7", "c8", "c9"], None, "L", 1), (4, "e", at(0), ["c4"], None, "L", 1),
        (5, "f", at(0), ["c5"], at(60), "L", 1), (6, "g", at(0), ["c1"], None, "L", 1), (7, "h", at(500), ["x", "y"], None, "L", 1), (8, "i", at(500), ["x", "c3"], None, "L", 1),
        (9, None, at(0), ["x"], None, "L", 1), (10, "k", None, None, None, None, None), (11, "f", at(5), ["c6"], at(-90), "L", 1),
    ]
    new = [
        (101, "a", at(0), ["c1"], "L", 1), (102, "b", at(0), ["c1"], "M", 2), (103, "renamed", at(8), ["c7", "c8"], "L", 1), (104, "e", at(9), ["c4"], "L", 1), (105, "f", at(45), ["c5"], "L", 1),
        (106, "z", at(100), ["c1"], "L", 1), (107, None, None, None, None, None),
    ]
    got = run(spark, old, new)
    assert got == {
        1: ("same", 101, (), ("c2",)), 2: ("changed", 102, ("league", "price"), ()), 3: ("renamed", 103, (), ("c9",)), 4: ("renamed", 104, (), ()), 5: ("retimed", 105, (), ()), 6: ("absorbed", 101, (), ()),
        7: ("explained", None, (), ("x", "y")), 8: ("lost", None, (), ("c3", "x")), 9: ("explained", None, (), ("x",)), 10: ("lost", None, (), ()), 11: ("absorbed", 105, (), ("c6",)),
    }


def test_ties_repeats_and_nothing(spark):
    old = [(1, "a", at(0), ["c"], None, "L", 1), (2, "a", at(0), ["c"], None, "L", 1), (3, "b", at(0), ["q"], None, "L", 1), (4, "b", at(2), ["q"], None, "L", 1)]
    new = [(11, "a", at(0), ["c"], "L", 1), (12, "a", at(0), ["c"], "L", 1), (13, "b", at(1), ["q"], "L", 1)]
    got = run(spark, old, new)
    assert {k: v[:2] for k, v in got.items()} == {1: ("same", 11), 2: ("renamed", 12), 3: ("renamed", 13), 4: ("absorbed", 13)}
    assert {k: v[0] for k, v in run(spark, old, []).items()} == dict.fromkeys((1, 2, 3, 4), "lost")
    assert run(spark, [], new) == {}


def test_games_that_share_channels_need_not_all_meet(spark):
    """A slot of many games: each old one finds its nearest and smallest, and few pairs leave the join."""
    n = 300
    old = spark.createDataFrame([(i, None, at(0), ["c", f"o{i}"], None) for i in range(n)] + [(n, None, at(0), None, None)], "old_id long, pair string, start timestamp_ntz, channels array<string>, ref_start timestamp_ntz")
    new = spark.createDataFrame([(1000 + i, None, at(i % 3), ["c", f"o{i}", None]) for i in range(n)], "new_id long, pair string, start timestamp_ntz, channels array<string>")
    half = B._by_channels(old, new, 10, F.floor(F.col("_n") / 2) + 1)
    assert {(r.old_id, r.new_id) for r in half.collect()} == {(i, 1000 + i) for i in range(n)}
    one = B._by_channels(old, new, 10, F.lit(1))
    assert one.count() < n * n / 10  # 90,000 pairs share a channel
    assert {(r.old_id, r.new_id) for r in B._mutual(one).collect()} == {(0, 1000)}


def test_nearest_by_channels_in_pieces_equal_all_pairs(spark, monkeypatch):
    """Busy minutes cut into pieces of seven games, a hundred channels, ties, nulls; no pair of games is a row of a join."""
    rng = random.Random(4)
    monkeypatch.setattr(B, "PIECE", 7)
    line = [*(f"c{i}" for i in range(6)), *(f"d{i}" for i in range(100)), None]
    held = lambda: rng.choice([None, [], rng.choices(line[:6], k=rng.randrange(1, 6)), rng.choices(line, k=3), line[3:90]])
    when = lambda: rng.choice([None, *[at(rng.choice([0, 0, 3, 10, 21, 180, 200, 400])) + dt.timedelta(microseconds=rng.choice([0, 0, 1])) for _ in range(9)]])
    old = [(i, None, when(), held(), None) for i in range(150)]
    new = [(i, None, when(), held()) for i in rng.sample(range(1000), 130)]
    frames = [spark.createDataFrame(x, f"{c} long, pair string, start timestamp_ntz, channels array<string>" + more) for x, c, more in ((old, "old_id", ", ref_start timestamp_ntz"), (new, "new_id", ""))]
    for minutes in (0, 10, 180):
        for need, least in ((F.floor(F.col("_n") / 2) + 1, lambda n: n // 2 + 1), (F.col("_n"), lambda n: n)):
            pairs = []
            for o, _, t, c, _ in old:
                for n, _, u, d in new:
                    common = {x for x in c or [] if x} & {x for x in d or [] if x}
                    if t and u and abs(t - u) <= dt.timedelta(minutes=minutes) and common and len(common) >= least(len(set(c))):
                        pairs.append((o, n, abs(t - u) // dt.timedelta(microseconds=1)))
            of_old = {min((p for p in pairs if p[0] == o), key=lambda p: (p[2], p[1])) for o in {p[0] for p in pairs}}
            of_new = {min((p for p in pairs if p[1] == n), key=lambda p: (p[2], p[0])) for n in {p[1] for p in pairs}}
            got = {tuple(r) for r in B._by_channels(*frames, minutes, need).collect()}
            assert of_old | of_new <= got <= set(pairs) and of_old
            first = {tuple(r) for r in B._by_channels(*frames, minutes, need, both=False).collect()}
            assert of_old <= first <= set(pairs) and {min((p for p in first if p[0] == o), key=lambda p: (p[2], p[1])) for o in {p[0] for p in first}} == of_old


def test_copies_of_a_game_meet_as_one(spark):
    """300 old and 300 new games of one pair and minute make 90,000 pairs; each finds its nearest in far fewer rows."""
    old = spark.createDataFrame([(i, "a", at(i % 2), None, at(90), "L", 1) for i in range(300)], OLD)
    new = spark.createDataFrame([(1000 + i, "a", at(5 + i % 2), None, "L", 1) for i in range(300)], NEW)
    got = B._by_pair(old, new, 10)
    assert {tuple(r) for r in got.collect()} == {(i, 1000, (5 - i % 2) * 60000000) for i in range(300)} | {(1, 1000 + i, (4 + i % 2) * 60000000) for i in range(300)}
    assert B._closer(old, new, 180).count() == 4
    fate = run(spark, [(i, "a", at(i % 2), None, at(90), "L", 1) for i in range(300)], [(1000 + i, "a", at(25 + i % 2), None, "L", 1) for i in range(300)])
    assert {k: v[:2] for k, v in fate.items()} == {i: ("retimed", 1000) if i == 1 else ("absorbed", 1000) for i in range(300)}


def test_all_fields_of_records(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.5), (3, "z", 2.0)], "id int, name string, price double")
    b = spark.createDataFrame([(1, "x", None), (2, None, 2.5), (4, "w", 0.0)], "id int, name string, price double")
    assert {(r.id, r.state, tuple(r.fields)) for r in B.record_diff(a, b, ["id"]).collect()} == {(1, "same", ()), (2, "changed", ("name", "price")), (3, "gone", ()), (4, "added", ())}
