"""Merging entries of one game across sites and languages.

An entry can only join a game through an entry that it matches, so games lie within the
connected components of the match graph, whose nodes are the entries or, so that their pairs
need not be formed, spots of entries alike in key, names and time. The graph is built by joins;
the order-dependent rule (an entry may bridge games of one kind and must not bridge others) then
runs exactly over partitions sorted by component and time, holding only the games still open.
"""

from __future__ import annotations

import itertools
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.functions.names import forms as similarity_forms
from broadloom.functions.names import similarity, word_ratio
from broadloom.functions.text import category
from broadloom.operators.graph import components
from broadloom.operators.intervals import seconds, within
from broadloom.sources.shared import materialize

ENTRY = "entry_id long, start timestamp_ntz, home string, away string, sport string"


def _fitting_names(spots: DataFrame, key: list[str], same: int) -> DataFrame:
    """(home, away, _home, _away, score, swapped): the sides under which an entry's sides may be
    met. Names are scored once per distinct pair of names of one key in neighbouring spans.

    spots: ``key``, home, away, _s (number of the span)."""
    spot = spots.select(*key, F.explode(F.array("home", "away")).alias("name"), "_s").distinct()
    beside = spot.select(*key, F.col("name").alias("x"), F.explode(F.array(*(F.col("_s") + i for i in (-1, 0, 1)))).alias("_s"))
    met = beside.join(spot.withColumnRenamed("name", "y"), [*key, "_s"]).select("x", "y").distinct()
    alike = met.filter(category(F.col("x")) == category(F.col("y"))).withColumn("s", similarity(F.col("x"), F.col("y"))).filter(F.col("s") >= same)
    sides = fitting_sides(spots.select("home", "away").distinct(), materialize(alike)).withColumns({"score": F.greatest("direct", "turned"), "swapped": F.col("turned") > F.col("direct")})
    return materialize(sides.filter(F.col("score") >= same).drop("direct", "turned"))


def scored_pairs(entries: DataFrame, key: list[str], minutes: int = 150, same: int = 85, clash: int = 95, clash_minutes: int = 30) -> DataFrame:
    """(a, b, score, swapped): entries of one game. At most ``minutes`` apart, sports equal or
    unknown (or near in time and all but equal in name), categories of the sides equal, and
    the worse side's similarity at least ``same``, in either orientation.

    entries: entry_id, start, home, away, sport ('' unknown), and ``key`` columns that must be
    equal. Entries meet under names that are alike, so pairs of other games of a busy hour are
    never formed; those of one game are, so their number grows with the square of its entries
    (``merged_entries`` needs none)."""
    named = entries.filter("home IS NOT NULL AND away IS NOT NULL AND start IS NOT NULL")
    pairs = _fitting_names(named.select(*key, "home", "away", F.floor(seconds("start") / (60 * minutes)).alias("_s")), key, same)
    side = lambda p: named.select(*key, F.col("entry_id").alias(p), F.col("start").alias(f"{p}_at"), F.col("home"), F.col("away"), F.col("sport").alias(f"{p}_sport"))
    a = side("a").join(pairs, ["home", "away"]).drop("home", "away")
    b = side("b").withColumnsRenamed({"home": "_home", "away": "_away"})
    found = within(a, b, [*key, "_home", "_away"], "a_at", "b_at", -60 * minutes, 60 * minutes, extra=F.col("a") < F.col("b"))
    apart = F.abs(F.unix_seconds(F.col("a_at").cast("timestamp")) - F.unix_seconds(F.col("b_at").cast("timestamp")))
    sport = (F.col("a_sport") == "") | (F.col("b_sport") == "") | (F.col("a_sport") == F.col("b_sport")) | ((F.col("score") >= clash) & (apart <= 60 * clash_minutes))
    return found.filter(sport).select("a", "b", "score", "swapped")


def fitting_sides(games: DataFrame, alike: DataFrame) -> DataFrame:
    """(home, away, _home, _away, direct, turned): the sides under which each pair of sides may
    be met, with the worse side's score as written and turned (0: does not fit).

    games: distinct (home, away); alike: x (a name of these), y, s (its score)."""
    of = lambda p: alike.select(F.col("x").alias(p), F.col("y").alias(f"_{p}"), F.col("s").alias(f"_s_{p}"))
    both = games.join(of("home"), "home").join(of("away"), "away").withColumn("_s", F.least("_s_home", "_s_away"))
    rows = both.select("home", "away", "_home", "_away", F.col("_s").alias("direct"), F.lit(0).alias("turned"))
    rows = rows.union(both.select("home", "away", "_away", "_home", F.lit(0), "_s"))
    return rows.groupBy("home", "away", "_home", "_away").agg(F.max("direct").alias("direct"), F.max("turned").alias("turned"))


def alike_names(names: DataFrame, least: int = 85) -> DataFrame:
    """(a, b, score), a < b: distinct names whose similarity is ``least`` (85 or more) or higher.

    Alike names hold alike words, and two words of indel ratio 0.85 share most of their letter
    pairs: of a word of n pairs fewer than 0.32 n + 1.4 are lost, so they meet under one of
    their so many rarest pairs. Words are compared once per distinct pair of words, and only
    names that hold a pair of alike words are scored. ``names``: one column, ``name``; nulls
    are dropped."""
    held = names.filter("name IS NOT NULL").distinct().select("name", F.explode(similarity_forms(F.col("name"))).alias("w"))
    edged = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    pairs = held.select("w").distinct().withColumn("g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(edged) - 1), lambda i: F.substring(edged, i, F.lit(2))))))
    rarity = pairs.groupBy("g").agg(F.count("*").alias("n"))
    ranked = pairs.join(rarity, "g").groupBy("w").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("gs"))
    keys = ranked.select("w", F.explode(F.slice("gs", 1, F.ceil(0.32 * F.size("gs") + 2.4).cast("int"))).alias("k")).select("w", "k.g")
    near = keys.select(F.col("w").alias("x"), "g").join(keys.select(F.col("w").alias("y"), "g"), "g").filter("x <= y").select("x", "y").distinct()
    # one letter stands for every word that it begins, so a name that holds one is found by its other words
    alike = near.filter(word_ratio(F.col("x"), F.col("y")) >= least)
    alike = alike.union(alike.filter("x <> y").select("y", "x"))
    met = held.select(F.col("name").alias("a"), F.col("w").alias("x")).join(alike, "x").join(held.select(F.col("name").alias("b"), F.col("w").alias("y")), "y")
    found = met.filter("a < b").select("a", "b").distinct()
    return found.withColumn("score", similarity(F.col("a"), F.col("b"))).filter(F.col("score") >= least)


def merged_games(entries: DataFrame, pairs: DataFrame, minutes: int = 150) -> DataFrame:
    """(entry_id, game_id, swapped): entries in order of start, then id. An entry joins the
    first game that it matches; further matching games are absorbed if their sport does not
    conflict. game_id is the game's smallest entry; ``swapped`` says whether the sides are
    turned against the game's first entry. ``minutes``: how far apart the entries of a pair
    are at most; a game none of whose entries is so near is closed and leaves memory."""
    pairs = materialize(pairs.select("a", "b", "swapped"))
    classes = components(pairs.select("a", "b")).select(F.col("node").alias("entry_id"), F.col("component").alias("block"))
    placed = materialize(entries.join(classes, "entry_id").select("block", "entry_id", "start", "sport"))
    links = pairs.select("a", "b", "swapped").union(pairs.select("b", "a", "swapped")).groupBy("a").agg(F.collect_list(F.struct("b", "swapped")).alias("near"))
    rows = placed.join(links, placed["entry_id"] == links["a"]).select("block", _micros("start").alias("at"), "entry_id", "sport", "near")

    def steps(games, rows):
        for at, entry, sport, near in rows:
            yield from games.closed(at)
            yield games.add(entry, at, sport, games.of_pairs({x["b"]: x["swapped"] for x in near}))

    merged = _walked(rows, steps, minutes)
    alone = entries.join(merged, "entry_id", "left_anti").select("entry_id", F.col("entry_id").alias("game_id"), F.lit(False).alias("swapped"))
    return merged.union(alone)


def merged_entries(entries: DataFrame, key: list[str], minutes: int = 150, same: int = 85, clash: int = 95, clash_minutes: int = 30) -> DataFrame:
    """``merged_games`` of ``scored_pairs`` without the pairs: whether two entries match is told
    by key, names, sport and time, so the walk finds a game's earliest matching entry itself, and
    what travels grows with the entries however many of them a game has. Blocks are components
    of spots, which are all entries of one key and name pair in a span of ``minutes``."""
    reach = 60 * minutes
    whole = F.lit(True)
    for c in (*key, "entry_id", "home", "away", "start"):
        whole = whole & F.col(c).isNotNull()
    named = entries.filter(whole).withColumn("_s", F.floor(seconds("start") / reach))
    place = [*key, "home", "away", "_s"]
    spots = named.groupBy(*place).agg(F.min(_micros("start")).alias("low"), F.max(_micros("start")).alias("high"))
    spots = materialize(spots.withColumn("spot", F.monotonically_increasing_id()))
    fits = _fitting_names(spots, key, same)
    a = spots.join(fits, ["home", "away"]).withColumn("_s", F.explode(F.array(*(F.col("_s") + i for i in (-1, 0, 1)))))
    b = spots.select(*key, F.col("home").alias("_home"), F.col("away").alias("_away"), "_s", F.col("spot").alias("_spot"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    met = a.join(b, [*key, "_home", "_away", "_s"]).filter(F.greatest("low", "_low") - F.least("high", "_high") <= reach * 1_000_000)
    met = materialize(met.select("spot", "_spot", "home", "away", "_home", "_away", "score", "swapped"))
    classes = components(met.select("spot", "_spot")).select(F.col("node").alias("spot"), F.col("component"))
    blocks = materialize(spots.join(classes, "spot", "left").select("spot", *place, F.coalesce("component", "spot").alias("block")))
    known = met.join(blocks.select("spot", "block"), "spot").select("block", "home", "away", "_home", "_away", "score", "swapped").distinct()
    # a block's fitting names come before its entries
    rows = named.join(blocks.drop("spot"), place).select("block", _micros("start").alias("at"), "entry_id", "sport", "home", "away", *(F.lit(None).cast(t).alias(n) for n, t in (("_home", "string"), ("_away", "string"), ("score", "int"), ("swapped", "boolean"))))
    rows = rows.unionByName(known.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("at", "long"), ("entry_id", "long"), ("sport", "string")))))

    def steps(games, rows):
        held = OpenNames(clash, clash_minutes)
        for at, entry, sport, home, away, _home, _away, score, swapped in rows:
            if at is None:
                held.fits.setdefault((home, away), {})[_home, _away] = (score, swapped)
                held.fits.setdefault((_home, _away), {}).setdefault((home, away), None)
                continue
            for gone in games.leaving(at):
                held.leave(gone)
            yield from games.closed(at)
            row = games.add(entry, at, sport, held.hits(games.root, (home, away), entry, at, sport))
            held.enter(games.recent[-1], (home, away), sport)
            yield row

    alone = entries.filter(~whole).select("entry_id", F.col("entry_id").alias("game_id"), F.lit(False).alias("swapped"))
    return _walked(rows, steps, minutes).union(alone)


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _walked(rows: DataFrame, steps, minutes: int) -> DataFrame:
    """(entry_id, game_id, swapped). rows: block, at, entry_id and more; ``steps(games, rows)``
    gives the rows of a block, walked in order of time."""
    dealt = rows.repartition("block").sortWithinPartitions("block", "at", "entry_id")
    schema = "block long, number long, entry_id long, game_id long, swapped boolean"
    types = pa.schema([("block", pa.int64()), ("number", pa.int64()), ("entry_id", pa.int64()), ("game_id", pa.int64()), ("swapped", pa.bool_())])

    def walk(batches):
        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

        def told():
            for block, own in itertools.groupby(flat, key=lambda r: r[0]):
                games = OpenGames(block, minutes)
                yield from steps(games, (r[1:] for r in own))
                yield from games.closed(None)

        out = told()
        while part := list(itertools.islice(out, 20000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part, strict=True), types, strict=True)], schema=types)

    # members name the game that they joined, which may be absorbed later; closed games name what became of it
    told = materialize(dealt.mapInArrow(walk, schema))
    members = told.filter("entry_id IS NOT NULL").select("block", "number", "entry_id", "swapped")
    fates = told.filter("entry_id IS NULL").select("block", "number", "game_id", F.col("swapped").alias("turned"))
    return members.join(fates, ["block", "number"]).select("entry_id", "game_id", (F.col("swapped") != F.col("turned")).alias("swapped"))


class OpenGames:
    """The games of one block that later entries may still join. Times are microseconds."""

    def __init__(self, block: int, minutes: int) -> None:
        self.block, self.reach = block, minutes * 60_000_000
        self.next = 0
        self.recent: deque = deque()  # (time, entry, number of the game it joined, turned against it) of entries within reach
        self.where: dict = {}  # entry within reach: the same
        self.root: dict = {}  # number of a game: (number of the game it is now, turned against that)
        self.games: dict = {}  # number: sport, least entry, numbers it took in, entries within reach

    def leaving(self, at: int) -> list[tuple]:
        """Entries that no entry from ``at`` on can meet."""
        return list(itertools.takewhile(lambda x: at - x[0] > self.reach, self.recent))

    def closed(self, at: int | None) -> list[tuple]:
        """Rows of the games that no entry from ``at`` on can join (None: of all)."""
        out = []
        while self.recent and (at is None or at - self.recent[0][0] > self.reach):
            _, entry, number, _ = self.recent.popleft()
            del self.where[entry]
            number = self.root[number][0]
            game = self.games[number]
            game["near"] -= 1
            if not game["near"]:
                out += [(self.block, n, None, game["least"], self.root.pop(n)[1]) for n in game["numbers"]]
                del self.games[number]
        return out

    def of_pairs(self, near: dict) -> dict:
        """Hits of an entry that forms pairs with ``near`` (entry: swapped)."""
        hits: dict = {}
        for at, other, number, own in sorted(self.where[e] for e in near if e in self.where):
            game, flip = self.root[number]
            hits.setdefault(game, bool(own ^ flip ^ near[other]))
        return hits

    def add(self, entry: int, at: int, sport: str | None, hits: dict) -> tuple:
        """``hits``: game: whether the entry is turned against it, by its earliest matching member."""
        ordered = sorted(hits)
        fitting = [g for g in ordered if not (self.games[g]["sport"] and sport and self.games[g]["sport"] != sport)] or ordered[:1]
        if not fitting:
            number, self.next = self.next, self.next + 1
            self.root[number], turned = (number, False), False
            self.games[number] = {"sport": sport, "least": entry, "numbers": [number], "near": 1}
        else:
            number, game = fitting[0], self.games[fitting[0]]
            turned = hits[number]
            for other in fitting[1:]:
                theirs = self.games[other]
                if game["sport"] and theirs["sport"] and game["sport"] != theirs["sport"]:
                    continue
                flip = hits[other] ^ turned
                for n in theirs["numbers"]:
                    self.root[n] = (number, self.root[n][1] ^ flip)
                game["numbers"] += theirs["numbers"]
                game["near"] += theirs["near"]
                game["least"] = min(game["least"], theirs["least"])
                game["sport"] = game["sport"] or theirs["sport"]
                del self.games[other]
            game["sport"] = game["sport"] or sport
            game["least"] = min(game["least"], entry)
            game["near"] += 1
        self.recent.append((at, entry, number, turned))
        self.where[entry] = self.recent[-1]
        return self.block, number, entry, None, turned


class OpenNames:
    """Entries within reach by names, sport and game, each line in order of time: the first that
    matches stands for all of its line, so a step does not grow with a game's entries."""

    def __init__(self, clash: int, clash_minutes: int) -> None:
        self.clash, self.near = clash, clash_minutes * 60
        self.fits: dict = {}  # names: {other names: (score, swapped) if the one of smaller id bears the former, else None}
        self.lines: dict = {}  # names: {(sport, number): (entries, the latest of them)}
        self.line_of: dict = {}  # entry: (names, (sport, number))

    def enter(self, item: tuple, names: tuple, sport: str | None) -> None:
        line = names, (sport, item[2])
        self.line_of[item[1]] = line
        for entries in self.lines.setdefault(names, {}).setdefault(line[1], (deque(), deque())):
            entries.append(item)

    def leave(self, item: tuple) -> None:
        names, kind = self.line_of.pop(item[1])
        entries, late = self.lines[names][kind]
        entries.popleft()
        if late and late[0] is item:
            late.popleft()
        if not entries:
            del self.lines[names][kind]

    def hits(self, root: dict, names: tuple, entry: int, at: int, sport: str | None) -> dict:
        first: dict = {}  # game: (time, entry, turned) of the earliest that matches
        for other, mine in self.fits.get(names, {}).items():
            theirs = self.fits[other].get(names)
            for (kind, number), (entries, late) in self.lines.get(other, {}).items():
                least = 0
                if not (kind == "" or sport == "" or (sport is not None and kind == sport)):
                    # other sports: near in time and all but equal in name; time only goes on
                    entries, least = late, self.clash
                    while late and at // 1_000_000 - late[0][0] // 1_000_000 > self.near:
                        late.popleft()
                for when, member, _, own in entries:
                    fit = mine if entry < member else theirs
                    if fit and fit[0] >= least:
                        game, flip = root[number]
                        found = when, member, bool(own ^ flip ^ fit[1])
                        first[game] = min(first.get(game, found), found)
                        break
        return {game: turned for game, (_, _, turned) in first.items()}


def majority_sport(entries: DataFrame, game: str, sport: str, order: str) -> DataFrame:
    """A game's sport: the most frequent known one, of equals that of the earliest entry."""
    counted = entries.filter(F.col(sport) != "").groupBy(game, sport).agg(F.count("*").alias("n"), F.min(order).alias("first_at"))
    return counted.groupBy(game).agg(F.min_by(sport, F.struct(-F.col("n"), F.col("first_at"))).alias(sport))


def late_repeats(games: DataFrame, key: list[str], at: str, tie: str, guessed: str, low_minutes: int = 150, high_hours: int = 30) -> DataFrame:
    """Adds ``is_repeat``: a guessed game more than ``low_minutes`` and at most ``high_hours``
    after an earlier *kept* game of its key. The kept list grows as the key is walked in
    order, one row at a time and with the last kept rows alone in memory."""
    fields = [*games.schema.fields]
    dealt = games.repartition(*key).sortWithinPartitions(*key, at, tie)

    def walk(frames):
        import pandas as pd

        now, kept = None, []
        for pdf in frames:
            flags = []
            for k, t, g in zip(zip(*(pdf[c] for c in key), strict=True), pd.to_datetime(pdf[at]), pdf[guessed], strict=True):
                if k != now:
                    now, kept = k, []
                kept = [x for x in kept if (t - x).total_seconds() <= high_hours * 3600]
                again = bool(g) and any((t - x).total_seconds() > low_minutes * 60 for x in kept)
                flags.append(again)
                if not again:
                    kept.append(t)
            yield pdf.assign(is_repeat=flags)

    from pyspark.sql.types import BooleanType, StructField, StructType

    return dealt.mapInPandas(walk, StructType([*fields, StructField("is_repeat", BooleanType())]))


def rate_limited(log: DataFrame, visitor: str, at: str, tie: str, limit: int, seconds: int = 60) -> DataFrame:
    """Adds ``is_rejected``: more than ``limit`` accepted hits of the visitor in the trailing
    span; rejected hits do not count. At most ``limit`` instants are kept in memory."""
    from pyspark.sql.types import BooleanType, StructField, StructType

    dealt = log.repartition(visitor).sortWithinPartitions(visitor, at, tie)

    def walk(frames):
        import pandas as pd

        now, kept = None, []
        for pdf in frames:
            flags = []
            for v, t in zip(pdf[visitor], pd.to_datetime(pdf[at]), strict=True):
                if v != now:
                    now, kept = v, []
                kept = [x for x in kept if (t - x).total_seconds() <= seconds]
                flags.append(len(kept) >= limit)
                if not flags[-1]:
                    kept.append(t)
            yield pdf.assign(is_rejected=flags)

    return dealt.mapInPandas(walk, StructType([*log.schema.fields, StructField("is_rejected", BooleanType())]))
