"""Row classification: ordered verdict cascades in which the first rule that applies wins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.functions.text import episode_code, has_word, pair_sides


@dataclass(frozen=True)
class Markers:
    """The vocabulary of the live verdict, for the languages of a site."""

    live: list[str]
    not_live: list[str] = field(default_factory=list)
    stop_titles: list[str] = field(default_factory=list)
    stop_genres: list[str] = field(default_factory=list)
    lead_shows: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)


def cascade(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first rule that holds; a null condition does not hold."""
    out = None
    for name, condition in rules:
        test = F.coalesce(condition, F.lit(False))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def live_reason(title: Column, signals: Column, pair_field: Column, m: Markers, need_pair: bool = True) -> Column:
    """Why a programme is not a live match, or 'ok': stop title or episode, lead show, stop
    genre, not-live word, stop in the pair field, no live marker, no pair; in that order."""
    lead = F.exists(F.split(title, r"\s[|:–-]\s", -1), lambda p: has_word(F.regexp_extract(p, r"^\s*(\S+)", 1), m.lead_shows)) if m.lead_shows else F.lit(False)
    return cascade(
        [
            ("stop title", has_word(title, m.stop_titles, m.keep) | episode_code(title)),
            ("lead show", lead),
            ("stop genre", has_word(signals, m.stop_genres, m.keep)),
            ("not live", has_word(signals, m.not_live)),
            ("stop in pair", has_word(pair_field, m.stop_titles, m.keep)),
            ("no live marker", ~has_word(F.concat_ws(" ", signals, title), m.live)),
            ("no pair", F.coalesce(pair_sides(pair_field), pair_sides(title)).isNull() if need_pair else F.lit(False)),
        ],
        "ok",
    )


def sift(rows: DataFrame, reason: Column, keep: str = "ok") -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed rows with their ``reason``); the reason is computed in one place."""
    judged = rows.withColumn("reason", reason)
    return judged.filter(F.col("reason") == keep).drop("reason"), judged.filter(F.col("reason") != keep)


def allowed_words(vocabulary: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, word): words of the languages of a site. English belongs to every site, and a
    site of unknown languages takes all words. vocabulary: word, langs; sites: site, langs."""
    s = sites.select("site", F.when(F.coalesce(F.size("langs"), F.lit(0)) > 0, F.array_union("langs", F.array(F.lit("en")))).alias("own"))
    known = s.filter("own IS NOT NULL").withColumn("lang", F.explode("own")).join(vocabulary.withColumn("lang", F.explode("langs")), "lang").select("site", "word")
    every = s.filter("own IS NULL").select("site").crossJoin(F.broadcast(vocabulary.select("word")))  # the vocabulary is a small dimension
    return known.union(every).distinct()


def sport_decision(genre: Column, reference: Column, both_sides: Column, own: Column, league: Column, hint: Column) -> Column:
    """struct(sport, rule): the first source that knows. Inputs are null where silent."""
    sources = [(genre, 1), (reference, 2), (both_sides, 4), (own, 5), (league, 6), (hint, 8)]
    return F.coalesce(*(F.when(c.isNotNull(), F.struct(c.alias("sport"), F.lit(r).alias("rule"))) for c, r in sources), F.struct(F.lit("-").alias("sport"), F.lit(10).alias("rule")))


def now_flag_sites(rows: DataFrame, site: str, day: str, flagged: str, crawl_day: Column, least: int = 3) -> DataFrame:
    """Sites whose live flag stands on the day of the crawl alone: it says 'now', not 'live'."""
    flags = F.sum(F.when(F.col(flagged), 1).otherwise(0))
    other = F.sum(F.when(F.col(flagged) & (F.col(day) != crawl_day), 1).otherwise(0))
    days = F.countDistinct(day)
    return rows.groupBy(site).agg(flags.alias("flags"), other.alias("other"), days.alias("days")).filter((F.col("flags") >= least) & (F.col("other") == 0) & (F.col("days") > 1)).select(site, "flags")
