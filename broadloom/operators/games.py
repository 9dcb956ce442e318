"""Operators on merged games: display attributes, bridges, folds, ties, trims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadloom.functions.names import similarity
from broadloom.functions.text import unreadable
from broadloom.operators.intervals import within


def display_name(names: DataFrame, game: str, name: str, order: str) -> DataFrame:
    """One name per game: readable scripts first, then the one that agrees most with the
    game's other names, then the shorter, then the earlier. Agreement is scored once per
    distinct pair of a game's names."""
    distinct = names.groupBy(game, name).agg(F.min(order).alias("_o"), F.count("*").alias("_n"))
    a = distinct.select(game, F.col(name).alias("_a"))
    b = distinct.select(game, F.col(name).alias("_b"), F.col("_n").alias("_w"))
    agree = a.join(b, game).withColumn("_s", similarity(F.col("_a"), F.col("_b")) * F.col("_w")).groupBy(game, F.col("_a").alias(name)).agg(F.sum("_s").alias("_agree"))
    ranked = distinct.join(agree, [game, name])
    best = F.struct(unreadable(F.col(name)).cast("int").alias("u"), (-F.col("_agree")).alias("s"), F.length(name).alias("l"), F.col("_o").alias("o"))
    return ranked.groupBy(game).agg(F.min_by(name, best).alias(name))


def specific_league(leagues: DataFrame, game: str, league: str, order: str) -> DataFrame:
    """One league per game: not a bare sport ('X: FOOTBALL'), not in an unreadable script, the
    earlier."""
    general = F.col(league).rlike(r"(?i):\s*(football|basketball|tennis)\s*$")
    return leagues.groupBy(game).agg(F.min_by(league, F.struct(general.cast("int").alias("g"), unreadable(F.col(league)).cast("int").alias("u"), F.col(order).alias("o"))).alias(league))


def bridge_pick(candidates: DataFrame, game: str, same_league: Column, score: Column, side: Column, tie: str) -> DataFrame:
    """Decision per game by its candidates in the same league and time: 'sure', 'ask' or
    'none', with the candidate. One candidate passes its floor; one perfect side while others
    are weak is sure; else the best must reach the floor and lead the second."""
    w = Window.partitionBy(game)
    c = candidates.select(game, tie, same_league.alias("_same"), score.alias("_score"), side.alias("_side"))
    # the ordered windows come first, so that one sort serves all
    order = w.orderBy(F.desc("_score"), tie)
    c = c.withColumn("_lead", F.col("_score") - F.coalesce(F.lead("_score").over(order), F.lit(0))).withColumn("_rn", F.row_number().over(order))
    c = c.withColumn("_n", F.count("*").over(w)).withColumn("_perfect", F.sum(F.when(F.col("_side") >= 100, 1).otherwise(0)).over(w)).withColumn("_weak", F.sum(F.when(F.col("_side") <= 75, 1).otherwise(0)).over(w))
    alone = F.when(F.col("_same"), F.col("_score") >= 45).otherwise((F.col("_score") >= 40) | (F.col("_side") >= 75))
    sure_side = (F.col("_perfect") == 1) & (F.col("_weak") == F.col("_n") - 1) & (F.col("_side") >= 100)
    floor = F.when(F.col("_same"), 40).otherwise(60)
    leads = (F.col("_rn") == 1) & (F.col("_score") >= floor) & (F.col("_lead") >= 15)
    strong = F.col("_same") & (F.col("_lead") >= 20) & ((F.col("_score") >= 70) | ((F.col("_score") >= 40) & (F.col("_side") >= 75)))
    verdict = F.when((F.col("_n") == 1) & alone, "sure").when(F.col("_n") == 1, None).when(sure_side, "sure").when(leads & strong, "sure").when(leads, "ask")
    judged = c.withColumn("verdict", verdict)
    best = F.when(F.col("verdict").isNotNull() & F.col(game).isNotNull(), F.struct((F.col("verdict") == "ask").cast("int").alias("v"), F.col("_rn").alias("r")))
    picked = judged.groupBy(game).agg(F.min_by(F.struct(tie, "verdict"), best).alias("p"))
    return picked.select(game, F.col(f"p.{tie}").alias(tie), F.coalesce("p.verdict", F.lit("none")).alias("verdict"))


def fold_unreadable(games: DataFrame, channel: str, ts: str, game: str, name: str, seconds: int = 900) -> DataFrame:
    """(game, into): a game of unreadable names on a channel where, within ``seconds``,
    exactly one readable game is on, is that game."""
    marked = games.withColumn("_u", unreadable(F.col(name)))
    odd = marked.filter("_u").select(channel, F.col(game), F.col(ts).alias("_a"))
    plain = marked.filter("NOT _u").select(channel, F.col(game).alias("into"), F.col(ts).alias("_p"))
    near = within(odd, plain, [channel], "_a", "_p", -seconds, seconds)
    return near.groupBy(game).agg(F.min("into").alias("into"), F.countDistinct("into").alias("_n")).filter("_n = 1").drop("_n")


def member_of_tie(rows: DataFrame, ties: DataFrame, row_id: str, words: str, at: str, tie_id: str, tie_words: str, tie_at: str, days: int = 3) -> DataFrame:
    """(row_id, tie_id): rows all of whose words are among a tie's, at most ``days`` later,
    if exactly one tie fits. Rows meet ties by their first word, not by a product."""
    r = rows.select(row_id, F.col(words).alias("_w"), F.col(at).alias("_at")).filter(F.size("_w") > 0).withColumn("_k", F.element_at("_w", 1))
    t = ties.select(F.col(tie_id), F.col(tie_words).alias("_tw"), F.col(tie_at).alias("_tat")).withColumn("_k", F.explode(F.array_distinct("_tw")))
    met = r.join(t, "_k").filter((F.size(F.array_except("_w", "_tw")) == 0) & F.datediff("_at", "_tat").between(0, days))
    return met.groupBy(row_id).agg(F.min(tie_id).alias(tie_id), F.countDistinct(tie_id).alias("_n")).filter("_n = 1").drop("_n")


def outer_trims(side: Column, most: int = 3) -> Column:
    """array<struct<cut, text>>: a side without 1..most words at its start, smallest first;
    at least one word stays."""
    words = F.split(F.trim(side), r"\s+")
    cuts = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.least(F.lit(most), F.size(words) - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.arrays_zip(cuts.alias("cut"), F.transform(cuts, lambda k: words).alias("w")), lambda x: F.struct(x["cut"].alias("cut"), F.array_join(F.slice(x["w"], x["cut"] + 1, F.size(x["w"])), " ").alias("text")))


def trimmed_by_reference(rows: DataFrame, reference: DataFrame, row_id: str, side: str, name: str, most: int = 3) -> DataFrame:
    """(row_id, text, cut): the smallest cut after which a side is a reference name word for
    word; none if the side is a name as it stands."""
    names = reference.select(F.lower(name).alias("_n")).distinct()
    unknown = rows.join(names, F.lower(side) == F.col("_n"), "left_anti")
    tried = unknown.select(row_id, F.explode(outer_trims(F.col(side), most)).alias("t"))
    hit = tried.join(names, F.lower("t.text") == F.col("_n"), "left_semi")
    return hit.groupBy(row_id).agg(F.min(F.struct("t.cut", "t.text")).alias("b")).select(row_id, F.col("b.text").alias("text"), F.col("b.cut").alias("cut"))


def shifted_twins(games: DataFrame, pair: list[str], at: str, game: str, hours: int = 24, least_hours: int = 1) -> DataFrame:
    """(game, twin): the same pair again within a day, at another hour."""
    a = games.select(*pair, F.col(game), F.col(at).alias("_a"))
    b = games.select(*pair, F.col(game).alias("twin"), F.col(at).alias("_c"))
    return within(a, b, pair, "_a", "_c", 3600 * least_hours, 3600 * hours).filter(F.col(game) != F.col("twin")).select(game, "twin")


def retimed(games: DataFrame, reference: DataFrame, key: str, at: str) -> DataFrame:
    """Games with the reference's time where it has one; ``was`` keeps a time that changed."""
    r = reference.select(key, F.col(at).alias("_r"))
    j = games.join(r, key, "left")
    return j.withColumn("was", F.when(F.col("_r") != F.col(at), F.col(at))).withColumn(at, F.coalesce("_r", at)).drop("_r")


def title_twins(sessions: DataFrame, titles: DataFrame, marks: DataFrame, seen: DataFrame) -> DataFrame:
    """(twin, into): titles without players that are a merged session under an older title: they
    start in its minute, and every channel that they still have was confirmed for it. Titles
    without a channel stay; of several sessions the smallest takes the twin. Games of one minute
    and the same channels are judged as one.

    sessions: into, start; titles: twin, start; marks: twin, channel (the live ones); seen:
    into, channel. Null starts meet nothing."""
    def placed(games: DataFrame, held: DataFrame, key: str) -> DataFrame:
        sets = held.groupBy(key).agg(F.array_sort(F.collect_set("channel")).alias("_set"))
        return games.select(key, F.date_trunc("minute", "start").alias("_m")).filter("_m IS NOT NULL").distinct().join(sets, key)

    # a title may be a session too, so of each class the two smallest count
    two = lambda df, *by: df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("into"))).filter("_rn <= 2").drop("_rn")
    twins = placed(titles, marks.join(marks.filter("channel IS NULL").select("twin"), "twin", "left_anti"), "twin")
    given = two(placed(sessions, seen.filter("channel IS NOT NULL"), "into"), "_m", "_set").withColumnRenamed("_set", "_all")
    asked = twins.select("_m", "_set").distinct().withColumn("_k", F.element_at("_set", 1))
    met = asked.join(given.withColumn("_k", F.explode("_all")), ["_m", "_k"]).filter(F.size(F.array_except("_set", "_all")) == 0)
    best = two(met.select("_m", "_set", "into").distinct(), "_m", "_set")
    return twins.join(best, ["_m", "_set"]).filter("twin <> into").groupBy("twin").agg(F.min("into").alias("into"))
