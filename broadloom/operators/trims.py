"""Extra words cut from the sides of a pair: by a book of known phrases, or over a pair that the
reference confirms. Phrases and cut pairs are looked up by equi joins, longest or smallest cut
by an aggregate; no side is compared with a whole book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.operators.intervals import within

EDGE = r"^[\s\-–—:|,.]+|[\s\-–—:|,]+$"


def _words(side: Column) -> Column:
    return F.filter(F.split(side, r"\s+", -1), lambda w: w != "")


def _name(words: Column) -> Column:
    return F.regexp_replace(F.array_join(words, " "), EDGE, "")


def _still_name(name: Column) -> Column:
    """A word of two letters or more is left."""
    return name.rlike(r"(?U)\p{L}{2}")


def book_rules(cuts: DataFrame, teams: int = 2) -> DataFrame:
    """(side, phrase, langs) of the phrases that are rules: those that a person wrote, and those
    that the program cut beside ``teams`` different teams or more (beside one alone they are
    likelier a part of its name). cuts: side ('home' or 'away'), phrase, lang (null: any), team,
    by_person. Teams that differ by case or by age, gender and reserve marks are one."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower("team"), r"(?<!\w)(?:u-?\d{2}|w|ii|b)(?!\w)|\((?:w|f)\)", " "), r"\s+", " "))
    found = cuts.filter("side IS NOT NULL AND phrase IS NOT NULL").groupBy("side", F.lower(F.array_join(_words(F.col("phrase")), " ")).alias("phrase")).agg(
        F.max("by_person").alias("_p"), F.countDistinct(bare).alias("_n"), F.max(F.col("lang").isNull()).alias("_any"), F.collect_set("lang").alias("_langs")
    )
    rules = found.filter((F.col("phrase") != "") & (F.coalesce("_p", F.lit(False)) | (F.col("_n") >= teams)))
    return rules.select("side", "phrase", F.when(~F.col("_any"), F.array_sort("_langs")).alias("langs"))


def trim_by_book(rows: DataFrame, rules: DataFrame, row_id: str, home: str, away: str, langs: str, most: int = 3) -> DataFrame:
    """(row_id, home, away, cut) of the rows from which something is cut: the longest known
    phrase at the start of the home side, the longest at the end of the away side, at most
    ``most`` words and never the whole side; nothing if a side would be no name. A phrase holds
    for rows of its languages; rows without languages take any."""
    base = rows.select(F.col(row_id).alias("_id"), F.col(home).alias("_home"), F.col(away).alias("_away"), F.col(langs).alias("_langs")).filter("_id IS NOT NULL AND _home IS NOT NULL AND _away IS NOT NULL")
    both = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"_{s}").alias("text")) for s in ("home", "away")))
    trims = _side_trims(base.select(F.inline(both)).distinct(), rules, most)
    of = lambda s: trims.filter(F.col("side") == s).select(F.col("text").alias(f"_{s}"), F.col("trims").alias(f"_{s}_trims"))
    fits = lambda t: t["own"].isNull() | F.col("_langs").isNull() | (F.size(t["own"]) == 0) | F.arrays_overlap(t["own"], F.col("_langs"))
    longest = lambda s: F.get(F.filter(f"_{s}_trims", fits), F.lit(0)).alias(s)
    out = base.join(of("home"), "_home").join(of("away"), "_away").select("_id", longest("home"), longest("away"))
    out = out.filter("(home.k > 0 OR away.k > 0) AND home.named AND away.named")
    part = lambda s: F.nullif(F.col(f"{s}.cut"), F.lit(""))
    return out.select(F.col("_id").alias(row_id), F.col("home.name").alias("home"), F.col("away.name").alias("away"), F.concat_ws(" … ", part("home"), part("away")).alias("cut"))


def _side_trims(sides: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """(side, text, trims) of distinct sides: what each known phrase of a side would cut and
    leave, the longest first and the side as it stands last. Rows repeat few sides, so phrases
    are looked up and words cut once a side, not once a row."""
    cut = sides.withColumns({"_w": _words(F.col("text")), "_l": _words(F.lower("text"))})
    sizes = F.when(F.size("_l") > 1, F.sequence(F.lit(1), F.least(F.lit(most), F.size("_l") - 1))).otherwise(F.array().cast("array<int>"))
    piece = lambda k: F.array_join(F.when(F.col("side") == "home", F.slice("_l", F.lit(1), k)).otherwise(F.slice("_l", -k, k)), " ")
    tried = cut.select("side", "text", F.inline(F.transform(sizes, lambda k: F.struct(piece(k).alias("phrase"), k.alias("k")))))
    hits = tried.join(rules.withColumnRenamed("langs", "own"), ["side", "phrase"]).groupBy("side", "text").agg(F.sort_array(F.collect_list(F.struct("k", "own")), asc=False).alias("_hits"))
    whole = F.array(F.struct(F.lit(0).alias("k"), F.lit(None).cast("array<string>").alias("own")))
    n = F.size("_w")
    at_home = F.col("side") == "home"
    name = lambda k: _name(F.when(at_home, F.slice("_w", k + 1, n)).otherwise(F.slice("_w", F.lit(1), n - k)))
    gone = lambda k: F.array_join(F.when(at_home, F.slice("_w", F.lit(1), k)).otherwise(F.slice("_w", n - k + 1, k)), " ")
    trim = lambda h: F.struct(h["k"].alias("k"), h["own"].alias("own"), name(h["k"]).alias("name"), _still_name(name(h["k"])).alias("named"), gone(h["k"]).alias("cut"))
    found = cut.join(hits, ["side", "text"], "left")
    return found.select("side", "text", F.transform(F.concat(F.coalesce("_hits", F.array().cast("array<struct<k:int,own:array<string>>>")), whole), trim).alias("trims"))


def trim_over_pair(rows: DataFrame, pairs: DataFrame, row_id: str, home: str, away: str, at: str, minutes: int = 180, most: int = 3) -> DataFrame:
    """(row_id, ref, home, away, cut) of the rows whose sides, without up to ``most`` words at
    the start of the home side and at the end of the away side, are a reference pair at most so
    many minutes away word for word: the smallest cut, and none if the cuts name several
    matches or the sides are such a pair as they stand. pairs: ref, home, away, start."""
    base = rows.select(F.col(row_id).alias("_id"), F.col(home).alias("_home"), F.col(away).alias("_away"), F.col(at).alias("_at")).filter("_at IS NOT NULL AND _home IS NOT NULL AND _away IS NOT NULL")
    names = pairs.filter("start IS NOT NULL").select("ref", F.col("start").alias("_start"), F.lower(F.array_join(_words(F.col("home")), " ")).alias("_x"), F.lower(F.array_join(_words(F.col("away")), " ")).alias("_y"))
    sided = lambda df, h, a: df.select(F.inline(F.array(F.struct(F.lit("home").alias("side"), F.col(h).alias("text")), F.struct(F.lit("away").alias("side"), F.col(a).alias("text"))))).distinct()
    cuts = _side_names(sided(base, "_home", "_away"), sided(names, "_x", "_y"), most)
    of = lambda s: cuts.filter(F.col("side") == s).select(F.col("text").alias(f"_{s}"), F.col("cuts").alias(f"_{s}_cuts"))
    tried = base.join(of("home"), "_home").join(of("away"), "_away").select("_id", "_at", "_away_cuts", F.inline("_home_cuts").alias("k", "_th", "_x"))
    tried = tried.select("_id", "_at", "k", "_th", "_x", F.inline("_away_cuts").alias("m", "_ta", "_y"))
    # matches of one name and time count as their first and last, so copies of a match do not multiply
    names = names.groupBy("_x", "_y", "_start").agg(F.min("ref").alias("ref"), F.max("ref").alias("_last"))
    met = within(tried, names, ["_x", "_y"], "_at", "_start", -60 * minutes, 60 * minutes)
    best = F.min(F.struct((F.col("k") + F.col("m")).alias("cut"), F.col("k"), F.col("_th").alias("home"), F.col("_ta").alias("away")))
    found = met.groupBy("_id").agg(F.min("ref").alias("ref"), F.max("_last").alias("_last"), best.alias("_b")).filter((F.col("ref") == F.col("_last")) & (F.col("_b.cut") > 0))
    return found.select(F.col("_id").alias(row_id), "ref", "_b.home", "_b.away", "_b.cut")


def _side_names(sides: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(side, text, cuts): of distinct sides the cuts of up to ``most`` words that leave a name
    known on that side, with the name and how it is known. Cuts that leave none meet no pair."""
    w = sides.withColumn("_w", _words(F.col("text"))).filter("size(_w) > 0")
    tried = w.select("side", "text", "_w", F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.size("_w") - 1))).alias("k"))
    name = _name(F.when(F.col("side") == "home", F.slice("_w", F.col("k") + 1, F.size("_w"))).otherwise(F.slice("_w", F.lit(1), F.size("_w") - F.col("k"))))
    named = tried.select("side", "text", "k", name.alias("name")).withColumn("known", F.lower("name"))
    met = named.join(known.withColumnRenamed("text", "known"), ["side", "known"], "left_semi")
    return met.groupBy("side", "text").agg(F.collect_list(F.struct("k", "name", "known")).alias("cuts"))
