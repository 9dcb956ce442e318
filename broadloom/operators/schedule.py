"""Operators on programme grids: midnight counter, first and nearest show, multicast, full
grid, rounds, moments. All are windows over a site, channel or pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_shift(grid: DataFrame, part: list[str], pos: str, minute: str, overlap: int = 240, out: str = "shift") -> DataFrame:
    """Days to add to a page's day: one more whenever the clock steps back by ``overlap``
    minutes or more. Rows without a time keep their place and do not move the clock."""
    w = Window.partitionBy(*part).orderBy(pos)
    before = F.last(minute, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = F.when(before - F.col(minute) >= overlap, 1).otherwise(0)
    return grid.withColumn("_back", back).withColumn(out, F.sum("_back").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_back")


def evening_pages(shifted: DataFrame, part: list[str], minute: str, shift: str = "shift") -> DataFrame:
    """Adds ``began_evening``: after its first midnight the page reaches noon, so its first
    rows were the evening before."""
    w = Window.partitionBy(*part)
    return shifted.withColumn("began_evening", F.coalesce(F.max(F.when(F.col(shift) == 1, F.col(minute))).over(w) >= 720, F.lit(False)))


def start_by_window(shifted: DataFrame, part: list[str], minute: str, low: int, high: int, shift: str = "shift") -> DataFrame:
    """Per page, 0 or -1: the first day that puts more rows within [low, high] minutes from
    the page's midnight; the page's own day on a tie."""
    at = F.col(minute) + 1440 * F.col(shift)
    inside = lambda off: F.sum(F.when((at + off).between(low, high), 1).otherwise(0))
    counts = shifted.groupBy(*part).agg(inside(0).alias("own"), inside(-1440).alias("before"))
    return counts.select(*part, F.when(F.col("before") > F.col("own"), -1).otherwise(0).alias("first_day"), "own", "before")


def first_shows(shows: DataFrame, keys: list[str], start: str, guessed: str) -> DataFrame:
    """Adds ``first_start`` per key and ``is_repeat``: a guessed row later than the first."""
    first = F.min(start).over(Window.partitionBy(*keys))
    return shows.withColumn("first_start", first).withColumn("is_repeat", F.col(guessed) & (F.col(start) > F.col("first_start")))


def nearest_shows(shows: DataFrame, keys: list[str], gap: Column, tie: str, guessed: str, same_seconds: int) -> DataFrame:
    """Drops guessed rows other than the one nearest to the kickoff and those within the
    same-show tolerance of it; stated rows stay."""
    w = Window.partitionBy(*keys)
    ranked = shows.withColumn("_gap", F.abs(gap)).withColumn("_least", F.min("_gap").over(w))
    ranked = ranked.withColumn("_rn", F.row_number().over(w.orderBy("_gap", tie)))
    return ranked.filter(~F.col(guessed) | (F.col("_rn") == 1) | (F.col("_gap") - F.col("_least") <= same_seconds)).drop("_gap", "_least", "_rn")


def multicast(shows: DataFrame, channel: list[str], ts: str, game: str, seconds: int, least: int = 2) -> DataFrame:
    """Adds ``is_multicast``: ``least`` different games or more on the channel within
    ``seconds`` before or after."""
    w = Window.partitionBy(*channel).orderBy(F.unix_seconds(F.col(ts).cast("timestamp"))).rangeBetween(-seconds, seconds)
    return shows.withColumn("is_multicast", F.size(F.collect_set(game).over(w)) >= least)


def full_grid(shows: DataFrame, channel: list[str], ts: str, title: str, moments: DataFrame, at: str, back: int = 21600, ahead: int = 600, gap: int = 10800, least: int = 3) -> DataFrame:
    """For each moment (channel and instant): is the channel's grid full around it? At least
    ``least`` shows from ``back`` seconds before to ``ahead`` after, no pause longer than
    ``gap``, the last one no older than ``gap``, and two different titles or more."""
    secs = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    # shows meet a moment through buckets as wide as the reach, never by a product
    wide = back + ahead
    m = moments.select(*channel, at).distinct().withColumn("_t", secs(at))
    m = m.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor((F.col("_t") - back) / wide), F.floor((F.col("_t") + ahead) / wide)))))
    s = shows.withColumn("_s", secs(ts)).withColumn("_b", F.floor(F.col("_s") / wide)).select(*channel, "_b", "_s", F.col(title).alias("_title"))
    met = m.join(s, [*channel, "_b"], "left").filter(F.col("_s").isNull() | F.col("_s").between(F.col("_t") - back, F.col("_t") + ahead))
    w = Window.partitionBy(*channel, at).orderBy("_s")
    met = met.withColumn("_pause", F.col("_s") - F.lag("_s").over(w))
    test = (F.count("_s") >= least) & (F.coalesce(F.max("_pause"), F.lit(0)) <= gap) & (F.first("_t") - F.max("_s") <= gap) & (F.countDistinct("_title") >= 2)
    found = met.groupBy(*channel, at).agg(F.coalesce(test, F.lit(False)).alias("is_full"), F.count("_s").alias("n_shows"))
    # a moment whose buckets hold only shows out of reach has no row above
    return moments.select(*channel, at).distinct().join(found, [*channel, at], "left").select(*channel, at, F.coalesce("is_full", F.lit(False)).alias("is_full"), F.coalesce("n_shows", F.lit(0)).alias("n_shows"))


def crowded_minutes(games: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Adds ``is_round``: ``least`` games or more of one key in the same minute, a placeholder
    kickoff of a round rather than a real one."""
    return games.withColumn("is_round", F.count("*").over(Window.partitionBy(*keys)) >= least)


def settled_moment(votes: DataFrame, key: str, moment: str, preferred: str) -> DataFrame:
    """One moment per key: most votes, then a preferred vote, then the earlier."""
    counted = votes.groupBy(key, moment).agg(F.count("*").alias("votes"), F.max(F.col(preferred).cast("int")).alias("pref"))
    best = F.max_by(F.struct(moment, "votes"), F.struct("votes", "pref", -F.unix_micros(F.col(moment).cast("timestamp"))))
    return counted.groupBy(key).agg(best.alias("b")).select(key, f"b.{moment}", "b.votes")


def lead_over_second(scored: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The best row per key and its lead over the second best (null if alone)."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    ranked = scored.withColumn("lead", F.col(score) - F.lead(score).over(w)).withColumn("_rn", F.row_number().over(w))
    return ranked.filter("_rn = 1").drop("_rn")


def covered(windows: DataFrame, key: list[str], start: str, end: str, need_from: str, need_to: str) -> DataFrame:
    """Per key: do the windows cover [need_from, need_to] without a hole?"""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.greatest(F.col(need_from), F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col(need_from)))
    holes = windows.withColumn("_reach", reach).withColumn("_hole", (F.col(start) > F.col("_reach")) & (F.col("_reach") < F.col(need_to)))
    return holes.groupBy(*key, need_from, need_to).agg((~F.bool_or("_hole") & (F.max(end) >= F.first(need_to))).alias("is_covered"))
