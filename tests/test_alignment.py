"""Alignment that learns, against a plain version that looks at every pair."""

import datetime as dt
import random

from broadloom.functions.names import name_score
from broadloom.operators import alignment as A

GAMES = "game long, sport string, league string, start timestamp_ntz, home string, away string, match_id long"
MATCHES = "ref long, sport string, league string, start timestamp_ntz, home string, away string"
KNOWN = "sport string, alias string, team string"
DAY = dt.datetime(2024, 5, 1)


def plain(games, reference, known, minutes=180):
    """(facts, rungs) by loops."""
    near = lambda a, b, m: abs((a - b).total_seconds()) <= 60 * m
    words = lambda *names: {w for n in names for w in "".join(c.lower() if c.isalnum() else " " for c in n).split() if len(w) >= 3}
    games = [g for g in games if None not in (g[1], g[3], g[4], g[5])]
    reference = [r for r in reference if None not in (r[1], r[3], r[4], r[5])]
    rows = []
    for g in games:
        for r in reference:
            by_id = g[6] == r[0]
            same = g[2] is not None and g[2] == r[2]
            if by_id or g[1] == r[1] and near(g[3], r[3], minutes) and (same or words(g[4], g[5]) & words(r[4], r[5])):
                gap = abs((g[3] - r[3]).total_seconds())
                rows += [(g[0], r[0], g[1], gap, same, by_id, t, g[4], x, g[5], y) for t, x, y in ((False, r[4], r[5]), (True, r[5], r[4]))]
    score = {(n, t): name_score(n, t) for r in rows for n, t in ((r[7], r[8]), (r[9], r[10]))}
    facts = {(r[2], n, t) for r in rows for n, t in ((r[7], r[8]), (r[9], r[10]))}
    told = {f for f in facts if any(k[0] == f[0] and k[1].lower() == f[1].lower() and k[2] == f[2] for k in known)}
    for pair in {(r[0], r[1]) for r in rows if r[5]}:
        best = max((r for r in rows if (r[0], r[1]) == pair), key=lambda r: ((score[r[7], r[8]] >= 85) + (score[r[9], r[10]] >= 85), not r[6]))
        told |= {(best[2], best[7], best[8]), (best[2], best[9], best[10])}
    seed = told | {f for f in facts if score[f[1:]] >= 85}
    yes, no = set(), set()
    for f in facts:
        seeds, firm = {s[2] for s in seed if s[:2] == f[:2]}, {s[2] for s in told if s[:2] == f[:2]}
        if f in seed and (len(seeds) == 1 or f in told and len(firm) == 1):
            yes.add(f)
        elif len(seeds) == 1 or len(firm) == 1:
            no.add(f)
    crowded = {r[0] for r in reference for q in reference if r is not q and r[0] != q[0] and r[1] == q[1] and near(r[3], q[3], 2 * minutes) and {r[4], r[5]} & {q[4], q[5]}}
    ties = {((r[2], r[7], r[8]), (r[2], r[9], r[10])) for r in rows if r[4] and r[1] not in crowded}
    beside = {f: {b for a, b in ties if a == f} | {a for a, b in ties if b == f} for f in facts}
    open_ = facts - yes - no
    bad, good = {f for f in open_ if beside[f] & no}, {f for f in open_ if beside[f] & yes}

    def reached(free):
        got, todo = set(), [f for f in free if f in good]
        while todo:
            f = todo.pop()
            if f not in got:
                got.add(f)
                todo += [x for x in beside[f] if x in free]
        return got

    first = reached(open_ - bad)
    several = {f for f in first if len({x[2] for x in yes | first if x[:2] == f[:2]}) > 1}
    last = reached(open_ - bad - several)
    how = {f: "known" if f in yes else "denied" if f in no else "quarantine" if f in several or f in good & bad else "refuted" if f in bad else "learnt" if f in last else "open" for f in facts}
    rungs = {}
    for r in rows:
        x, y = (r[2], r[7], r[8]), (r[2], r[9], r[10])
        sx, sy = score[x[1:]], score[y[1:]]
        fine = [how[f] in ("known", "learnt") for f in (x, y)]
        firm = sx >= 95 and how[x] == "known" and how[y] == "open" or sy >= 95 and how[y] == "known" and how[x] == "open"
        tests = [r[5], sx >= 85 and sy >= 85 and not r[6], sx >= 85 and sy >= 85, all(fine), r[4] and firm, r[4] and any(fine)]
        if any(tests):
            rungs.setdefault(r[0], []).append((tests.index(True), r[3], r[1]))
    out = {}
    for g in games:
        found = sorted(rungs.get(g[0], []))
        best = {x[2] for x in found if x[:2] == found[0][:2]}
        out[g[0]] = (None, "missed") if not found else (None, "disputed") if len(best) > 1 else (best.pop(), ("id", "letters", "reversed", "learnt", "firm side", "ask")[found[0][0]])
    return {(*f, score[f[1:]], h) for f, h in how.items()}, out


def season(rng, n):
    own = [f"{a}{b}" for a in ("Brod", "Kuz", "Mirel", "Tovan", "Selig", "Parn") for b in ("ano", "iev", "orth")]
    other = ["".join(rng.choice("абвгдежзик") for _ in range(9)) for _ in own]
    matches, games = [], []
    for k in range(n):
        h, a = rng.sample(range(len(own)), 2)
        at = DAY + dt.timedelta(hours=9 * k // 2 + rng.randrange(3))
        matches.append((k, rng.choice("FB"), rng.choice("LM"), at, own[h], own[a]))
        for _ in range(rng.randrange(1, 3)):
            x, y = ((own, own, other)[i % 3][i] for i in (h, rng.randrange(len(own)) if rng.random() < 0.05 else a))
            x, y = (y, x) if rng.random() < 0.2 else (x, y)
            games.append((len(games), matches[-1][1], matches[-1][2] if rng.random() < 0.9 else None, at + dt.timedelta(minutes=rng.choice([-30, 0, 0, 45])), x, y, k if rng.random() < 0.05 else None))
    return games, matches


def test_learning_equals_looking_at_every_pair(spark):
    games, matches = season(random.Random(2), 60)
    games += [(9000, "F", "L", None, "x", "y", None), (9001, "F", None, DAY, None, "y", 3), (9002, None, None, DAY, "a", "b", None)]
    known = [("F", games[0][4].upper(), matches[0][4])]
    rungs, facts = A.align(spark.createDataFrame(games, GAMES), spark.createDataFrame(matches, MATCHES), spark.createDataFrame(known, KNOWN))
    want_facts, want = plain(games, matches, known)
    got = {tuple(r) for r in facts.collect()}
    assert got == want_facts
    assert {"known", "learnt"} <= {f[4] for f in got}
    assert {r.game: (r.ref, r.rung) for r in rungs.collect()} == want | {g: (None, "missed") for g in (9000, 9001, 9002)}


def test_one_id_teaches_a_chain(spark):
    """a-b has an id; b-c, c-d, ... follow from it, each by the opponent learnt before."""
    n = 9
    at = [DAY + dt.timedelta(days=k) for k in range(n)]
    team = [f"{c * 3}{k}town" for k, c in enumerate("bdfgklmnprt")]
    local = ["".join("абвгдежзиклмн"[(5 * k + 3 * j) % 13] for j in range(8)) for k in range(n + 1)]
    matches = [(k, "F", "L", at[k], team[k], team[k + 1]) for k in range(n)]
    games = [(k, "F", "L", at[k], local[k], local[k + 1], 0 if k == 0 else None) for k in range(n)]
    rungs, facts = A.align(spark.createDataFrame(games, GAMES), spark.createDataFrame(matches, MATCHES), spark.createDataFrame([], KNOWN))
    assert {r.game: (r.ref, r.rung) for r in rungs.collect()} == {k: (k, "id" if k == 0 else "learnt") for k in range(n)}
    assert {(r.name, r.team) for r in facts.filter("how IN ('known', 'learnt')").collect()} == set(zip(local, team, strict=False))


def test_alignment_of_nothing(spark):
    games, matches = season(random.Random(3), 3)
    empty = spark.createDataFrame([], MATCHES)
    rungs, facts = A.align(spark.createDataFrame(games, GAMES), empty, spark.createDataFrame([], KNOWN))
    assert {r.rung for r in rungs.collect()} == {"missed"} and facts.count() == 0
    assert A.align(spark.createDataFrame([], GAMES), empty, spark.createDataFrame([], KNOWN))[0].count() == 0


def test_late_marks(spark):
    hour = lambda h: DAY + dt.timedelta(hours=h)
    rows = [
        (1, "B", hour(1), "Golden State", "Atlanta"), (2, "B", hour(1), "Atlanta", "Golden State"), (3, "F", hour(1), "Golden State", "Atlanta"), (4, "B", hour(9), "Golden State", "Atlanta"),
        (5, "B", hour(1), "Golden State W", "Atlanta"), (6, "B", hour(1), "Brodano", "Kuziev"), (7, "B", hour(1), "Selig", "Parnorth"), (8, None, hour(1), "Golden State", "Atlanta"), (9, "B", None, "Golden State", None),
    ]
    reference = [
        (10, "B", hour(0), "Golden State (W)", "Atlanta (W)"), (11, "B", hour(0), "Brodano U19", "Kuziev U19"), (12, "B", hour(2), "Brodano", "Kuziev"), (13, "B", hour(0), "Selig U19", "Parnorth U19"), (14, "B", hour(2), "Selig (W)", "Parnorth (W)"), (15, "B", hour(0), "Selig (W)", "Other"),
    ]
    got = A.late_marks(spark.createDataFrame(rows, "row long, sport string, start timestamp_ntz, home string, away string"), spark.createDataFrame(reference, "ref long, sport string, start timestamp_ntz, home string, away string"))
    assert {tuple(r) for r in got.select("row", "ref", "marks", "turned").collect()} == {(1, 10, "W", False), (2, 10, "W", True)}


def test_quarantine_and_its_end(spark):
    from broadloom.operators import store as S

    aliases = spark.createDataFrame([("Ajax", "en", "F", "", 1, 1, False), ("AJAX", "en", "F", "", 2, 2, False), ("Real", "en", "F", "", 3, 3, False)], "alias string, lang string, sport string, category string, team long, club long, is_canonical boolean")
    asked = spark.createDataFrame([(1, "ajax", "en", "F", ""), (2, "real", "en", "F", ""), (3, "porto", "en", "F", ""), (4, None, "en", "F", "")], "ask long, alias string, lang string, sport string, category string")
    held = lambda *rows: spark.createDataFrame(rows, "alias string, team long")
    answers = lambda q: {r.ask: (r.team, r.how) for r in S.guarded_ladder(asked, aliases, q, "ask").collect()}
    assert answers(held(("x", 1))) == {1: (None, "disputed"), 2: (3, "found"), 3: (None, "unknown"), 4: (None, "unknown")}
    assert answers(held(("ajax", 2)))[1] == (1, "found")
    assert answers(held(("Ajax", 1), ("ajax", 2), (None, 3)))[1] == (None, "quarantine")
    fates = S.lifted(held(("Ajax", 1), ("ajax", 2), ("b", 1), ("b", 2), ("c", 1), (None, 1)), held(("AJAX", 2), ("b", 1), ("b", 2), ("c", 9)))
    assert {tuple(r) for r in fates.collect()} == {("ajax", 1, "dropped"), ("ajax", 2, "lifted"), ("b", 1, "held"), ("b", 2, "held"), ("c", 1, "held")}


def test_a_spelling_is_answered_once_for_all_who_ask(spark):
    """20,000 askers of one spelling that 20,000 teams bear: no product of both."""
    from pyspark.sql import functions as F

    from broadloom.operators import store as S

    n = 20000
    kind = lambda i: (F.lit("en").alias("lang"), F.when(i % 4 == 0, "F").otherwise("B").alias("sport"), F.lit("").alias("category"))
    i = F.col("id")
    aliases = spark.range(n).select(F.lit("Ajax").alias("alias"), *kind(i), i.alias("team"), F.when(i % 4 == 0, 7).otherwise(i).alias("club"), F.lit(False).alias("is_canonical"))
    asked = spark.range(n).select(i.alias("ask"), F.when(i % 2 == 0, "AJAX").otherwise("ajax").alias("alias"), *kind(i))
    out = S.alias_ladder(asked, aliases, "ask").groupBy("how", "team").count()
    assert {tuple(r) for r in out.collect()} == {("found", n - 4, n // 4), ("disputed", None, n - n // 4)}


def test_pairs_of_a_busy_hour_are_not_written(spark, monkeypatch):
    """40 games and 40 matches of one league and hour make 1,600 pairs; what is written grows
    with games, names and facts."""
    import datetime as dt

    at = dt.datetime(2026, 1, 5, 18)
    names = ["Karlova", "Brodek", "Stanimir", "Ostrava"]
    two = [(names[i % 4], names[(i + 1 + i // 4 % 2) % 4]) for i in range(40)]
    games = [(i, "f", "L", at, *two[i], None) for i in range(40)]
    matches = [(100 + i, "f", "L", at, *two[i]) for i in range(40)]
    written, write = [], A.materialize

    def counted(df):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(A, "materialize", counted)
    g = spark.createDataFrame(games, "game long, sport string, league string, start timestamp_ntz, home string, away string, match_id long")
    r = spark.createDataFrame(matches, "ref long, sport string, league string, start timestamp_ntz, home string, away string")
    rungs, facts = A.align(g, r, spark.createDataFrame([], "sport string, alias string, team string"))
    assert {x.rung for x in rungs.collect()} == {"disputed"} and facts.count() == 16
    assert max(written) < 1600


def test_copies_of_games_and_matches_meet_as_one(spark, monkeypatch):
    """Copies are decided as every pair would be, and no kind of game is met by copies of a match."""
    rng = random.Random(7)
    games, matches = season(rng, 25)
    games = [(1000 * c + g[0], *g[1:6], g[6] if c == 0 else None) for g in games for c in range(3)]
    matches = [(1000 * c + r[0], *r[1:]) for i, r in enumerate(matches) for c in range(1 + 2 * (i % 2))]
    games += [(8000 + i, "F", None, DAY, "Brodano", "Kuziev", None) for i in range(40)]
    matches += [(8000 + i, "F", "L", DAY + dt.timedelta(minutes=180), "Brodano", "Kuziev") for i in range(40)]
    written, write = [], A.materialize

    def counted(df):
        out = write(df)
        if {"low", "n"} <= set(df.columns) or {"ref", "n"} <= set(df.columns):
            written.append(out.count())
        return out

    monkeypatch.setattr(A, "materialize", counted)
    rungs, facts = A.align(spark.createDataFrame(games, GAMES), spark.createDataFrame(matches, MATCHES), spark.createDataFrame([], KNOWN))
    want_facts, want = plain(games, matches, [])
    assert {tuple(r) for r in facts.collect()} == want_facts
    got = [tuple(r) for r in rungs.collect()]
    assert len(got) == len(games) and {g: x for g, *x in got} == {g: list(x) for g, x in want.items()}
    assert {x[1] for x in want.values()} >= {"disputed", "id", "missed"} and max(written) < 400
