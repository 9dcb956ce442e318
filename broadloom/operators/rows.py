"""Evidence about single grid rows: sport words, own channels, placeholders, stages, sides.

Vocabularies are parameters; the small ones here are defaults of one language.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadloom.functions.text import found_word, has_word, words_pattern
from broadloom.operators.intervals import within

#: What stands for an opponent who is not known yet, and for a show without a name.
NO_OPPONENT = ["tbd", "tba", "to be decided", "to be announced", "qualifier", "bye", "winner", "loser"]
NO_SHOW = ["unknown show", "no programme", "no information", "to be announced"]

#: Stages by the fraction of the draw that is left, and by their words.
STAGES = {
    "Final": (None, ["final", "grand final"]),
    "Semifinals": ("1/2", ["semifinal", "semifinals", "semi-final", "semi-finals"]),
    "Quarterfinals": ("1/4", ["quarterfinal", "quarterfinals", "quarter-final", "quarter-finals"]),
    "Round of 16": ("1/8", ["round of 16", "last 16"]),
    "Round of 32": ("1/16", ["round of 32", "last 32"]),
}


def plain(text: Column) -> Column:
    """Lower case, letters and digits alone, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def without_words(text: Column, words: list[str]) -> Column:
    return F.regexp_replace(text, words_pattern(words), " ") if words else text


def word_hits(text: Column, words: list[str], exclude: list[str] = ()) -> Column:
    """All of the words in a text, in order, lower-cased; phrases of ``exclude`` go first."""
    if not words:
        return F.array().cast("array<string>")
    return F.transform(F.regexp_extract_all(without_words(text, list(exclude)), F.lit(words_pattern(words)), F.lit(0)), F.lower)


def out_of_season(text: Column, month: Column, seasons: dict[str, set[int]], exclude: list[str] = ()) -> Column:
    """The first tournament (in the order given) that the text names outside its months."""
    body = without_words(text, list(exclude))
    late = [F.when(has_word(body, [name]) & ~month.isin(sorted(months)), F.lit(name)) for name, months in seasons.items()]
    return F.coalesce(*late) if late else F.lit(None).cast("string")


def without_pair(text: Column, home: Column, away: Column) -> Column:
    """The text without its pair's names: what speaks for a sport outside the sides."""
    out = F.replace(F.replace(F.lower(text), F.lower(home), F.lit(" ")), F.lower(away), F.lit(" "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def alien_inside(home: Column, away: Column, rest: Column, alien: list[str], own: list[str]) -> Column:
    """Alien sport words stand only in the sides, and a word of the own sport outside."""
    sides = F.concat_ws(" ", home, away)
    return has_word(sides, alien) & ~has_word(rest, alien) & has_word(rest, own)


def team_words(words: DataFrame, word: str, names: DataFrame, name: str) -> DataFrame:
    """(word, n_names): sport words that are also a whole word of a team's name."""
    tokens = names.select(F.explode(F.array_distinct(F.split(plain(F.col(name)), " "))).alias(word), F.col(name).alias("_name"))
    asked = words.select(F.lower(word).alias(word)).distinct()
    return asked.join(tokens, word).groupBy(word).agg(F.countDistinct("_name").alias("n_names"))


def channel_filler(rows: DataFrame, channel: str, home: str, away: str, teams: DataFrame, team: str) -> DataFrame:
    """Adds ``is_filler``: one side is the channel's own name, and the other is no team that is
    known (a club's channel shows its own matches)."""
    own = plain(F.col(channel))
    other = F.when(own == "", None).when(plain(F.col(home)) == own, plain(F.col(away))).when(plain(F.col(away)) == own, plain(F.col(home)))
    known = teams.select(plain(F.col(team)).alias("_team")).distinct().withColumn("_known", F.lit(True))
    judged = rows.withColumn("_other", other).join(known, F.col("_other") == F.col("_team"), "left")
    return judged.withColumn("is_filler", F.col("_other").isNotNull() & F.col("_known").isNull()).drop("_other", "_team", "_known")


def in_window(day: Column, today: Column, days: int = 7) -> Column:
    """Is the day shown: today and the days after it, so many in all."""
    return day.between(today, F.date_add(today, days - 1))


def not_past(day: Column, today: Column) -> Column:
    """Yesterday and later; a row without a day stays."""
    return day.isNull() | (day >= F.date_sub(today, 1))


def is_placeholder(name: Column, words: list[str] = NO_OPPONENT) -> Column:
    """A side whose opponent is not known yet, marks of age and gender aside."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?iu)(?<!\w)(u[- ]?\d{2}|women|\(?w\)?)(?!\w)", " "), r"\s+", " "))
    inner = "|".join(re.escape(w) for w in words)
    return (bare == "") | bare.rlike(rf"(?i)^({inner})\b(\s+(of|from)\b.*|\s*[0-9]*)?$")


def is_empty_show(title: Column, channel: Column, words: list[str] = NO_SHOW) -> Column:
    """A title that names no programme: empty, a filler phrase, or the channel's own name."""
    t, c = plain(title), plain(channel)
    return (t == "") | t.isin([w.lower() for w in words]) | ((c != "") & t.startswith(c))


def stage(text: Column, stages: dict[str, tuple[str | None, list[str]]] = STAGES) -> Column:
    """The stage that a title names: by fraction first, then by word; null if none."""
    fractions = [F.when(text.rlike(rf"(?<![0-9/]){f}(?![0-9/])"), F.lit(name)) for name, (f, _) in stages.items() if f]
    words = [F.when(has_word(text, w), F.lit(name)) for name, (_, w) in reversed(stages.items())]
    return F.coalesce(*fractions, *words)


def is_title_row(sport: Column, home: Column, away: Column, duels: list[str] = ("T",)) -> Column:
    """A row of a duel sport that names a tournament instead of a pair: one side is missing."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return sport.isin(list(duels)) & (blank(away) != blank(home))


def whole_tournaments(rows: DataFrame, row_id: str, title: str, day: str, tournaments: DataFrame, name: str, first: str, last: str) -> DataFrame:
    """(row_id, name): rows that name a tournament which is on that day; of several names the
    longest, and none if two of that length differ. Titles meet names by their first words."""
    word = lambda c: F.split(plain(c), " ")
    keyed = rows.select(row_id, plain(F.col(title)).alias("_title"), F.col(day).alias("_day"), F.explode(F.array_distinct(word(F.col(title)))).alias("_w"))
    named = tournaments.select(F.col(name).alias("_name"), plain(F.col(name)).alias("_plain"), F.get(word(F.col(name)), F.lit(0)).alias("_v"), F.col(first).alias("_first"), F.col(last).alias("_last"))
    on = (F.col("_w") == F.col("_v")) & F.concat(F.lit(" "), "_title", F.lit(" ")).contains(F.concat(F.lit(" "), "_plain", F.lit(" "))) & F.col("_day").between(F.col("_first"), F.col("_last"))
    met = keyed.join(named, on).select(row_id, "_name", F.length("_plain").alias("_n")).distinct()
    longest = met.groupBy(row_id).agg(F.max("_n").alias("_top"))
    return met.join(longest, row_id).filter("_n = _top").groupBy(row_id).agg(F.min("_name").alias(name), F.count("*").alias("_many")).filter("_many = 1").drop("_many")


def tidy_side(side: Column, leagues: list[str], air: list[str] = ("live", "replay")) -> Column:
    """A side without what is glued to it: a league or stage before it, a league in brackets, a
    stage or air mark after it."""
    stages = [w for _, words in STAGES.values() for w in words]
    lead = words_pattern([*leagues, *stages, *air]).removeprefix("(?iuU)")
    out = F.regexp_replace(side, rf"(?iuU)^\s*(?:{lead}\s*[:,–-]?\s*)+(?=\S)", "")
    out = F.regexp_replace(out, rf"(?iuU)\s*[\(\[]\s*{lead}\s*[\)\]]", "")
    out = F.regexp_replace(out, rf"(?iuU)(?:\s*[:,–-]?\s+{lead})+\s*$", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title_over_pair(rows: DataFrame, row_id: str, sides: dict[str, str], reference: DataFrame, name: str) -> DataFrame:
    """(row_id, source, home, away): which reading of a row stands, the title's pair or the
    field's. The one of which the reference knows more sides wins; the field's at a tie.

    sides: columns by role: title_home, title_away, field_home, field_away."""
    known = reference.select(plain(F.col(name)).alias("_name")).distinct()
    long = rows.select(row_id, F.explode(F.array(*(F.struct(F.lit(role).alias("role"), F.col(c).alias("side")) for role, c in sides.items()))).alias("_s")).select(row_id, "_s.role", "_s.side")
    hit = long.join(known, plain(F.col("side")) == F.col("_name"), "left_semi").groupBy(row_id).agg(F.sum(F.col("role").startswith("title").cast("int")).alias("_t"), F.sum(F.col("role").startswith("field").cast("int")).alias("_f"))
    judged = rows.join(hit, row_id, "left").withColumn("_title", F.coalesce("_t", F.lit(0)) > F.coalesce("_f", F.lit(0)))
    pick = lambda side: F.when(F.col("_title"), F.col(sides[f"title_{side}"])).otherwise(F.col(sides[f"field_{side}"]))
    return judged.select(row_id, F.when(F.col("_title"), "title").otherwise("field").alias("source"), pick("home").alias("home"), pick("away").alias("away"))


def tournament_key(text: Column, cities: dict[str, list[str]], events: dict[str, list[str]], tours: dict[str, list[str]]) -> Column:
    """'tour city' of the one tournament that a text names, else null.

    cities: city -> tours that play there; events: word -> [tour, city]; tours: tour -> its
    words. Texts that name two tours name none. Cities in the text, else event words of the
    named tour; with a named tour only those that it visits; the tour is the named one, else
    the only one that visits the city."""
    named = F.array_compact(F.array(*(F.when(has_word(text, words), F.lit(t)) for t, words in tours.items())))
    tour = F.get(named, F.lit(0))
    visits = F.create_map(*(x for c, ts in cities.items() for x in (F.lit(c), F.array(*map(F.lit, ts)))))
    found = F.array_compact(F.array(*(F.when(has_word(text, [c]), F.lit(c)) for c in cities)))
    by_event = F.array_compact(F.array(*(F.when(has_word(text, [w]) & (tour.isNull() | (tour == t)), F.lit(c)) for w, (t, c) in events.items())))
    chosen = F.array_distinct(F.when(F.size(found) > 0, found).otherwise(by_event))
    chosen = F.when(tour.isNull(), chosen).otherwise(F.filter(chosen, lambda c: F.array_contains(visits[c], tour)))
    city = F.get(chosen, F.lit(0))
    owner = F.coalesce(tour, F.when(F.size(visits[city]) == 1, F.get(visits[city], F.lit(0))))
    return F.when((F.size(named) < 2) & (F.size(chosen) == 1) & owner.isNotNull(), F.concat_ws(" ", owner, city))


def honest_live(stated: Column, guesses: Column, confirmed: Column) -> Column:
    """A live flag counts if the site states it itself, or guesses and the reference agrees."""
    return F.coalesce(stated, F.lit(False)) & (~F.coalesce(guesses, F.lit(False)) | F.coalesce(confirmed, F.lit(False)))


def classified(rows: DataFrame, reason: Column, leagues: list[str], sport: Column, teams: DataFrame, team: str, today: Column) -> DataFrame:
    """Rows through the stages of the cascade, with tidied sides and ``verdict``: the first exit
    that a row takes. ``reason``: the live verdict ('ok' passes). Columns: channel, home, away,
    day; ``sport`` may be null."""
    tidied = rows.withColumns({"reason": reason, "home": tidy_side(F.col("home"), leagues), "away": tidy_side(F.col("away"), leagues), "sport": sport})
    marked = channel_filler(tidied, "channel", "home", "away", teams, team)
    verdict = F.when(F.col("reason") != "ok", F.col("reason")).when(is_placeholder(F.col("home")) | is_placeholder(F.col("away")), "no opponent")
    verdict = verdict.when(F.col("is_filler"), "own channel").when(F.col("sport").isNull(), "unknown sport").when(F.col("day").isNull(), "no time").when(~not_past(F.col("day"), today), "past").otherwise("ok")
    return marked.withColumn("verdict", verdict).drop("reason", "is_filler")


def stopped_but_known(rows: DataFrame, reference: DataFrame, keys: list[str], at: str, ref_at: str, site: str, word: str, hours: int = 3) -> DataFrame:
    """(site, word, n): rows that a stop word removed although the reference has their pair
    within so many hours."""
    known = within(rows.withColumn("_id", F.monotonically_increasing_id()), reference.select(*keys, ref_at), keys, at, ref_at, -3600 * hours, 3600 * hours)
    return known.select("_id", site, word).distinct().groupBy(site, word).agg(F.count("*").alias("n"))


def unmarked_women(rows: DataFrame, reference: DataFrame, keys: list[str], at: str, ref_at: str, site: str, league: str, ref_league: str, minutes: int = 30, least: int = 1) -> DataFrame:
    """(site, league, n): leagues whose rows carry no women's mark, while women's matches of the
    same league core stand in the reference at their time."""
    core = lambda c: plain(F.regexp_replace(c, r"(?iu)(?<!\w)(women|w)(?!\w)", " "))
    women = reference.filter(F.col(ref_league).rlike(r"(?iu)(?<!\w)women(?!\w)")).select(*keys, ref_at, core(F.col(ref_league)).alias("_ref_core"))
    own = rows.filter(~F.col(league).rlike(r"(?iu)(?<!\w)(women|w)(?!\w)")).withColumn("_core", core(F.col(league)))
    met = within(own.withColumn("_id", F.monotonically_increasing_id()), women, keys, at, ref_at, -60 * minutes, 60 * minutes, extra=F.col("_core") == F.col("_ref_core"))
    return met.select("_id", site, league).distinct().groupBy(site, league).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def loss_step(rows: DataFrame, key: list[str], steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """Adds ``lost_at``: the first step whose output lacks the row, null if all have it."""
    out = rows
    for i, (_, output) in enumerate(steps):
        out = out.join(output.select(*key).distinct().withColumn(f"_s{i}", F.lit(True)), key, "left")
    lost = F.coalesce(*(F.when(F.col(f"_s{i}").isNull(), F.lit(name)) for i, (name, _) in enumerate(steps)))
    return out.withColumn("lost_at", lost).drop(*(f"_s{i}" for i in range(len(steps))))


def unread_flags(pages: DataFrame, site: str, text: str, signs: dict[str, str], read: DataFrame, read_site: str, least: int = 3) -> DataFrame:
    """(site, sign, n): signs that stand on a site's pages ``least`` times or more while none of
    its parsed rows has a flag."""
    counts = F.array(*(F.struct(F.lit(name).alias("sign"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)).alias("n")) for name, p in signs.items()))
    seen = pages.select(site, F.explode(counts).alias("_c")).groupBy(site, F.col("_c.sign").alias("sign")).agg(F.sum("_c.n").alias("n")).filter(F.col("n") >= least)
    return seen.join(read.select(F.col(read_site).alias(site)).distinct(), site, "left_anti")


def unknown_words(texts: DataFrame, site: str, text: str, vocabulary: DataFrame, word: str, least: int = 3) -> DataFrame:
    """(site, word, n): words of a site's texts that the vocabulary lacks, seen so often."""
    words = texts.select(site, F.explode(F.split(plain(F.col(text)), " ")).alias(word)).filter(F.col(word) != "").groupBy(site, word).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return words.join(vocabulary.select(F.lower(word).alias(word)).distinct(), word, "left_anti").select(site, word, "n")


def first_word(text: Column, words: list[str], exclude: list[str] = ()) -> Column:
    """The first word of the own sport, lower-cased."""
    return F.lower(found_word(text, words, list(exclude) or None))


def latest_answers(questions: DataFrame, key: list[str], answers: DataFrame, at: str, automatic: Column, suppressed: Column) -> DataFrame:
    """The review queue as a view: each question with ``state``. A question that a rule answers
    or suppresses never reaches a person; of several answers the last counts."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc("answer"))
    last = answers.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*key, "answer")
    state = F.when(F.col("answer").isNotNull(), "answered").when(suppressed.isNotNull(), F.concat(F.lit("not asked: "), suppressed)).when(automatic.isNotNull(), F.concat(F.lit("automatic: "), automatic)).otherwise("open")
    return questions.join(last, key, "left").withColumn("state", state)
