"""Plain relational operators: star listing, first mark per channel, membership, set merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``, which must end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def ordered_distinct(value: Column, order: Column) -> Column:
    """Aggregate: distinct values in the order of their first occurrence."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_distinct(F.transform(rows, lambda x: x["v"]))


def two_sided(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """A row for each side, so that ``x IN (left, right)`` becomes an equi join. A row whose
    sides are equal gives one."""
    return df.withColumn(out, F.explode(F.array_distinct(F.array(left, right))))


def merge_lists(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Old and new by key: the new value, else the old one, and where the row comes from."""
    o = old.select(*keys, F.col(value).alias("_old"))
    n = new.select(*keys, F.col(value).alias("_new"))
    both = o.join(n, keys, "full_outer")
    state = F.when(F.col("_new").isNull(), "old").when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return both.select(*keys, F.coalesce("_new", "_old").alias(value), state.alias("state"))


def conflicting_keys(df: DataFrame, key: str, value: str, out: str = "values") -> DataFrame:
    """Keys that more than one value claims, with the values in order."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(out)).filter(F.size(out) > 1)


def page_of(df: DataFrame, order: list[Column], offset: int, limit: int, most: int | None = 500) -> DataFrame:
    """A page of an ordered result; ``limit`` is held to ``most``, if any. Spark turns this into a
    top-(offset+limit) of each partition before one small merge."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit if most is None else min(limit, most)))


def event_page(
    games: DataFrame, links: DataFrame, channels: DataFrame, order: list[Column], date_from: str | None = None, date_to: str | None = None, sport: str | None = None, league: int | None = None,
    channel: int | None = None, has_channels: bool = False, q: str | None = None, offset: int = 0, limit: int = 200, most: int | None = 500,
) -> DataFrame:
    """A page of the listing under the filters that are given, each row with the ``total`` of all
    that pass. games: game, date, sport, league_id, home, away, league; links: game, channel;
    channels: channel, name. Plain filters come first and reach the scan; a channel or any is a
    semi join; ``q`` is searched, whatever its case, in home, away, league and the names of the
    channels (by id), which are gathered only if it is asked for."""
    found = games
    for test, value in ((F.col("date").cast("string") >= date_from, date_from), (F.col("date").cast("string") <= date_to, date_to), (F.col("sport") == sport, sport), (F.col("league_id") == league, league)):
        found = found.filter(test) if value is not None else found
    if channel is not None:
        found = found.join(links.filter(F.col("channel") == channel).select("game").distinct(), "game", "left_semi")
    elif has_channels:
        found = found.join(links.select("game").distinct(), "game", "left_semi")
    if q:
        text = lambda c: F.coalesce(c, F.lit(""))
        asked = links.join(found.select("game"), "game", "left_semi").join(channels, "channel").groupBy("game").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("channel", "name"))), lambda c: text(c["name"])), " ").alias("_names"))
        body = F.concat_ws(" ", text(F.col("home")), text(F.col("away")), text(F.col("league")), F.col("_names"))
        found = found.join(asked, "game", "left").filter(F.contains(F.lower(body), F.lit(q.lower()))).drop("_names")
    total = found.agg(F.count("*").alias("total"))
    return page_of(found, order, offset, limit, most).crossJoin(F.broadcast(total))  # the total is one row
