"""Operators on small tables: edges of intervals, ties, nulls, brute-force versions."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from broadloom.functions import names as N
from broadloom.functions import text as X
from broadloom.operators import classify as C
from broadloom.operators import intervals as I
from broadloom.operators import merge as M
from broadloom.operators import schedule as S
from broadloom.operators import store as ST
from broadloom.operators import visits as V
from broadloom.operators.graph import components
from broadloom.sources import pages as P

T0 = dt.datetime(2024, 3, 1, 12, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_session_splits_only_above_the_gap(spark):
    rows = [(1, at(0), 1), (1, at(1800), 2), (1, at(3601), 3), (2, None, 4), (2, at(0), 5)]
    log = spark.createDataFrame(rows, "u long, ts timestamp_ntz, id long")
    got = {r.id: r.session_no for r in V.sessionize(log, "u", "ts", "id").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}


def test_visit_seconds_are_null_without_beacons(spark):
    log = spark.createDataFrame([(1, at(0), 1, "a"), (1, at(5), 2, "b")], "u long, ts timestamp_ntz, id long, k string")
    s = V.sessionize(log, "u", "ts", "id")
    m = V.visit_measures(s, "u", "ts", "id", F.col("k") == "a", F.col("k") == "b", F.lit(None).cast("long"), F.lit(1), F.when(F.col("k") == "b", "x").otherwise("")).first()
    assert (m.pages, m.actions, m.seconds, m.source, m.hits) == (1, 1, None, "x", 2)


def test_period_uniques_join_sets(spark):
    visits = spark.createDataFrame([(1, "2024-03-01"), (1, "2024-03-02"), (2, "2024-02-20")], "u long, day string").withColumn("g", F.lit("a"))
    out = {(r.period, r.g): (r.visits, r.visitors) for r in V.period_uniques(V.daily_sets(visits, "u", ["g"], "s"), "2024-03-02", ["g"]).collect()}
    assert out[(7, "a")] == (2, 1) and out[(30, None)] == (3, 2) and out[(1, "a")] == (1, 1)


def test_midnight_counter_skips_unknown_times(spark):
    rows = [(1, 0, 1380), (1, 1, None), (1, 2, 30), (1, 3, 20), (1, 4, 300)]
    got = [r.shift for r in S.day_shift(spark.createDataFrame(rows, "p int, pos int, m int"), ["p"], "pos", "m").orderBy("pos").collect()]
    assert got == [0, 0, 1, 1, 1]


def test_full_grid_edges(spark):
    shows = [(1, at(-3 * 3600), "a"), (1, at(0), "b"), (1, at(600), "c"), (2, at(-4 * 3600), "a"), (2, at(-3600), "b"), (2, at(0), "b")]
    df = spark.createDataFrame(shows, "ch int, ts timestamp_ntz, title string")
    moments = spark.createDataFrame([(1, at(0)), (2, at(0)), (3, at(0))], "ch int, at timestamp_ntz")
    got = {r.ch: (r.is_full, r.n_shows) for r in S.full_grid(df, ["ch"], "ts", "title", moments, "at").collect()}
    assert got == {1: (True, 3), 2: (True, 3), 3: (False, 0)}


def test_interval_join_matches_brute_force(spark):
    rng = random.Random(3)
    a = [(i, rng.randrange(3), at(rng.randrange(0, 90000))) for i in range(80)]
    b = [(i, rng.randrange(3), at(rng.randrange(0, 90000))) for i in range(80)]
    left = spark.createDataFrame(a, "a long, k int, a_ts timestamp_ntz")
    right = spark.createDataFrame(b, "b long, k int, b_ts timestamp_ntz")
    got = sorted((r.a, r.b) for r in I.within(left, right, ["k"], "a_ts", "b_ts", -900, 3600).collect())
    assert got == sorted((i, j) for i, k, s in a for j, m, t in b if k == m and -900 <= (t - s).total_seconds() <= 3600)
    kept = {r["_id"] for r in I.within(left.withColumn("_id", F.col("a")), right, ["k"], "a_ts", "b_ts", -900, 3600, "left_anti").collect()}
    assert kept == {i for i, _, _ in a} - {i for i, _ in got}


def test_within_closed_and_open_ends(spark):
    one = spark.createDataFrame([(1, at(0))], "k int, a_ts timestamp_ntz")
    two = spark.createDataFrame([(1, at(-10)), (1, at(10))], "k int, b_ts timestamp_ntz")
    assert I.within(one, two, ["k"], "a_ts", "b_ts", -10, 10).count() == 2
    assert I.within(one, two, ["k"], "a_ts", "b_ts", -10, 10, closed=(False, True)).count() == 1


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(7, 7)]
    root = list(range(1200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {(x, find(x)) for e in edges if e[0] != e[1] for x in e}


def test_bridge_components_over_all_lines_match_brute_force(spark):
    from __spark_entry__ import queries

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_suppkey", "l_orderkey").collect()
    edges = [(2 * r.l_suppkey, 2 * r.l_orderkey + 1) for r in lines]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = [(r.node, r.component) for r in queries()["bridge_components"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted((x, find(x)) for x in root)


def test_latin_names_take_every_word(spark):
    from __spark_entry__ import queries

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = [r.name for r in queries()["latin_names"](spark, "/root/testdata/sf0.001").select("name").collect()]
    assert sorted(got) == sorted({w for t in texts for w in re.findall(r"[^ \t\n\x0b\f\r]+", t or "")})


def test_pointer_chains_and_cycles(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (10, 11), (11, 12), (12, 10)]
    got = {r.node: r.survivor for r in ST.survivors(spark.createDataFrame(rows, "n long, up long"), "n", "up").collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 5)} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 99}
    assert got[10] in (10, 11, 12)


def test_streak_resets_holds_and_grows(spark):
    rows = [(1, 1, True, True), (1, 2, True, True), (1, 3, True, False), (1, 4, True, True), (1, 5, False, True), (1, 6, True, True)]
    got = [r.streak for r in ST.streaks(spark.createDataFrame(rows, "k int, d int, silent boolean, rd boolean"), "k", "d", "silent", "rd").orderBy("d").collect()]
    assert got == [1, 2, 2, 3, 0, 1]


def test_latin_displaces_other_scripts(spark):
    df = spark.createDataFrame([("Dynamo", "Динамо"), ("Динамо", "Dynamo"), ("a", None)], "o string, n string")
    assert [r[0] for r in df.select(ST.latin_wins(F.col("o"), F.col("n"))).collect()] == ["Dynamo", "Dynamo", "a"]


def test_whole_words_in_any_script(spark):
    df = spark.createDataFrame([("Яlive",), ("ПРЯМОЙ ЭФИР",), ("go live!",), ("live music",)], "t string")
    got = [r[0] for r in df.select(X.found_word(F.col("t"), ["live", "прямой эфир"], keep=["live music"])).collect()]
    assert got == [None, "ПРЯМОЙ ЭФИР", "live", None]


def test_pairs(spark):
    cases = {"A - B": ["A", "B"], "Cup: A vs B (live)": ["A", "B"], "A - B - C": None, "A - a": None, "Show": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(X.pair_sides(F.col("t"))).collect()] == list(cases.values())
    guess = df.sparkSession.createDataFrame([("News | A - B | Cup",), ("Lyon-Nice",)], "t string")
    assert [r[0] for r in guess.select(X.pair_guesses(F.col("t"))).collect()] == [[["A", "B"]], [["Lyon", "Nice"]]]


def test_cascade_takes_the_first_rule(spark):
    m = C.Markers(live=["live"], not_live=["repeat"], stop_titles=["news"], stop_genres=["film"], lead_shows=["studio"])
    rows = [("News live", "", "A - B"), ("S5E10 live", "", ""), ("Studio | A - B live", "", ""), ("A - B", "film live", ""), ("A - B", "repeat live", ""), ("A - B", "", ""), ("show", "live", ""), ("A - B", "live", "")]
    df = spark.createDataFrame(rows, "t string, s string, p string")
    reason = C.live_reason(F.col("t"), F.col("s"), F.col("p"), m)
    got = [r[0] for r in df.select(reason).collect()]
    assert got == ["stop title", "stop title", "lead show", "stop genre", "not live", "no live marker", "no pair", "ok"]


def test_similarity():
    assert N.indel_ratio("kitten", "sitting") == 61
    assert N.name_score("Динамо Киев", "FC Dinamo Kiev") >= 85
    assert N.name_score("Real Madrid U19", "Real Madrid") == 100
    assert N.name_score("J. Smith", "John Smith") >= 85
    assert N.name_score("Ajax", "Porto") < 60
    assert N.plain_name("FC 1900") == "fc 1900"
    assert N.to_latin("Ελλάδα") == "Ellada"


def test_merge_bridges_only_one_kind(spark):
    rows = [(1, at(0), "Dynamo Kyiv", "Ajax", "F"), (2, at(600), "Ajax", "Dynamo Kyiv", ""), (3, at(60), "Dynamo Kyiv", "Ajax", "B"), (4, at(20000), "Dynamo Kyiv", "Ajax", "F"), (5, at(30), "Porto", "Lyon", "F")]
    e = spark.createDataFrame(rows, M.ENTRY).withColumn("site", F.lit(1))
    pairs = M.scored_pairs(e, ["site"], clash=101)
    got = {r.entry_id: (r.game_id, r.swapped) for r in M.merged_games(e, pairs).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False), 5: (5, False)}


def test_entries_meet_under_alike_sides_alone(spark):
    alike = spark.createDataFrame([("a", "a", 100), ("a", "A", 90), ("b", "b", 100), ("a", "b", 86), ("b", "a", 86)], "x string, y string, s int")
    games = spark.createDataFrame([("a", "b"), ("a", "c")], "home string, away string")
    got = {tuple(r) for r in M.fitting_sides(games, alike).collect()}
    assert got == {("a", "b", "a", "b", 100, 86), ("a", "b", "b", "a", 86, 100), ("a", "b", "A", "b", 90, 0), ("a", "b", "b", "A", 0, 90), ("a", "b", "a", "a", 86, 86), ("a", "b", "A", "a", 86, 0), ("a", "b", "a", "A", 0, 86), ("a", "b", "b", "b", 86, 86)}


def test_late_repeats_follow_the_kept_list(spark):
    rows = [(1, at(0), 1, False), (1, at(4 * 3600), 2, True), (1, at(31 * 3600), 3, True), (1, at(33 * 3600), 4, False), (1, at(40 * 3600), 5, True)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, id int, g boolean")
    got = {r.id: r.is_repeat for r in M.late_repeats(df, ["k"], "ts", "id", "g").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_rejected_hits_do_not_count(spark):
    df = spark.createDataFrame([(1, at(i * 10), i) for i in range(9)], "v int, ts timestamp_ntz, id int")
    got = [r.is_rejected for r in M.rate_limited(df, "v", "ts", "id", 2, 30).orderBy("id").collect()]
    assert got == [False, False, True, True, False, False, True, True, False]


def test_page_readers(spark):
    html = "<html><script>x('10:00 no')</script><ul><li>09:30 A &amp; B</li><li>25:00 no</li></ul><p>9.45 C<br>later</p></html>"
    pages = spark.createDataFrame([("http://www.x.com/a", html), ("http://y.com/b", "zz")], "url string, html string")
    assert sorted((r.site, r.minute, r.title) for r in P.timed_lines(pages).collect()) == [("x.com", 570, "A & B"), ("x.com", 585, "C")]
    own = {"y.com": lambda url, html: [("ch", html, 5, "00:05")]}
    assert sorted((r.site, r.title) for r in P.read_pages(pages, own).collect()) == [("x.com", "A & B"), ("x.com", "C"), ("y.com", "zz")]


def test_log_lines_of_other_lengths_are_dropped(spark):
    lines = spark.createDataFrame([("\t".join("abcdefgh"),), ("\t".join("abcdefghijkl"),), ("a\tb",), ("",)], "value string")
    assert sorted((r.at, r.lang) for r in P.split_log(lines).collect()) == [("a", ""), ("a", "l")]


def merged_plainly(entries, pairs):
    near = {}
    for a, b, s in pairs:
        near.setdefault(a, {})[b] = s
        near.setdefault(b, {})[a] = s
    games = []
    for e, start, sport in sorted(entries, key=lambda x: (x[1], x[0])):
        hits = [g for g in games if any(x in near.get(e, {}) for x in g["members"])]
        hits = [g for g in hits if not (g["sport"] and sport and g["sport"] != sport)] or hits[:1]
        if not hits:
            games.append({"members": {e: (start, False)}, "sport": sport})
            continue
        turn = lambda g: next(s ^ near[e][x] for x, (_, s) in sorted(g["members"].items(), key=lambda m: (m[1][0], m[0])) if x in near[e])  # noqa: B023, E731
        game, mine = hits[0], turn(hits[0])
        for other in hits[1:]:
            if game["sport"] and other["sport"] and game["sport"] != other["sport"]:
                continue
            flip = turn(other) ^ mine
            game["members"].update({x: (t, s ^ flip) for x, (t, s) in other["members"].items()})
            game["sport"] = game["sport"] or other["sport"]
            games.remove(other)
        game["members"][e] = (start, mine)
        game["sport"] = game["sport"] or sport
    return {e: (min(g["members"]), s) for g in games for e, (_, s) in g["members"].items()}


def test_merge_of_long_chains_matches_brute_force(spark):
    rng = random.Random(11)
    day = dt.datetime(2024, 1, 1)
    entries = [(i, day + dt.timedelta(minutes=rng.randrange(0, 6000)), rng.choice(["", "", "F", "B"])) for i in range(400)]
    pairs = [(a[0], b[0], rng.random() < 0.3) for a in entries for b in entries if a[0] < b[0] and abs((a[1] - b[1]).total_seconds()) <= 9000 and rng.random() < 0.12]
    e = spark.createDataFrame([(i, t, "x", "y", s) for i, t, s in entries], M.ENTRY)
    got = {r.entry_id: (r.game_id, r.swapped) for r in M.merged_games(e, spark.createDataFrame(pairs, "a long, b long, swapped boolean")).collect()}
    assert got == merged_plainly(entries, pairs)


def test_merge_without_pairs_equals_merge_of_pairs(spark):
    """Spellings alike one way only, turned sides, unknown and clashing sports, nulls, edges of reach."""
    rng = random.Random(5)
    names = ["Dynamo Kyiv", "Dinamo Kiev", "Ajax", "Ajaks", "Real Madrid", "Real Reall", "Reall Madrd", "FC Porto", "!!", "a b", "", "Dynamo Kyiv U19"]
    sides = [*[rng.sample(names, 2) for _ in range(14)], ["Ajax", "Ajax"], ["Dynamo Kyiv", "Ajax"], ["Ajaks", "Dinamo Kiev"], ["Real Reall", "Reall Madrd"], ["Reall Madrd", "Real Madrid"]]
    when = lambda: at(rng.choice([rng.randrange(60000), 9000 * rng.randrange(6), 1800 * rng.randrange(9)])) + dt.timedelta(microseconds=rng.choice([0, 0, 1]))
    rows = [(i, when(), *rng.choice(sides), rng.choice(["", "F", "B", None, "F"]), rng.choice([1, 1, 2])) for i in rng.sample(range(5000), 700)]
    rows += [(9001, None, "Ajax", "Porto", "F", 1), (9002, at(0), None, "Ajax", "F", 1), (9003, at(0), "Ajax", "FC Porto", "F", None), (9004, at(99999), "!!", "!!", "F", 1)]
    e = spark.createDataFrame(rows, M.ENTRY + ", site int")
    for clash in (95, 86, 101):
        pairs = M.scored_pairs(e, ["site"], clash=clash)
        want = {tuple(r) for r in M.merged_games(e, pairs).collect()}
        got = [tuple(r) for r in M.merged_entries(e, ["site"], clash=clash).collect()]
        assert len(got) == len(rows) and set(got) == want
        assert 20 < len({g for _, g, _ in want}) < 600 and {s for _, _, s in want} == {False, True}


def test_merged_games_writes_no_pairs_of_entries(spark, monkeypatch):
    """300 entries of one game and hour make 44,850 pairs; what is written grows with the entries."""
    from broadloom.plans import names as Q

    rows = [(i, at(i), "Ajax", "FC Porto", "F") for i in range(300)]
    monkeypatch.setattr(Q, "_entries", lambda s, d: s.createDataFrame(rows, M.ENTRY).withColumn("site", F.lit(1)))
    written, write = [], M.materialize

    def counted(df):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(M, "materialize", counted)
    assert {(r.game_id, r.swapped) for r in Q.merged_games(spark, "").collect()} == {(0, False)}
    assert max(written) <= 301


def test_alike_names_match_brute_force(spark):
    rng = random.Random(12)
    words = ["dynamo", "dinamo", "kyiv", "kiev", "real", "madrid", "madrit", "wisla", "visla", "krakow", "krakov", "j", "jose", "club", "atletico", "atletiko", "moscow", "moskva", "ab", "abc", "abcd"]
    names = sorted({" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(90)} | {"דינמו קייב", "Динамо Киев", "Wisła Kraków", "Спартак Москва", "spartak moscow"})
    want = {(a, b, N.name_score(a, b)) for a in names for b in names if a < b and N.name_score(a, b) >= 85}
    got = {tuple(r) for r in M.alike_names(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")).collect()}
    assert len(want) > 40 and got == want


def test_readings_and_scores():
    assert N.name_score("Спартак Москва", "Spartak Moscow") == 100 and N.name_score("München", "Munich") == 100
    assert N.name_score("J. Smith", "John Smith") == 100 and N.name_score("J. A. Smith", "John Smith") <= 50
    assert N.name_score("Wisla", "Visla") == 100 and N.one_sound("chess") == "ches" and N.one_sound("c11q") == "k11k"
    assert N.name_score("מכבי חיפה", "Maccabi Haifa") >= 85 > N.name_score("Ajax", "Porto")
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
        assert N.indel_ratio(a, b) == 200 * row[-1] // (len(a) + len(b))


def test_components_share_many_links_out_to_more_tasks(spark, monkeypatch):
    """No task holds much more than ``EDGES`` links, however few bytes they take."""
    from broadloom.operators import graph

    monkeypatch.setattr(graph, "EDGES", 64)
    edges = spark.range(2000).selectExpr("id AS a", "id + 1 AS b").repartition(3)
    assert graph._tasks(edges, 2000) == 32
    assert {r.component for r in graph.components(edges).collect()} == {0}
