"""Standing audit queries over one run or two: what is missing, contradictory or shifted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Ids that stand with more than one value."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high")).filter("n_values > 1")


def dropped_sites(now: DataFrame, before: DataFrame, site: str, count: str, share: float = 0.3) -> DataFrame:
    """Sites that gave nothing now, or less than ``share`` of before."""
    n = now.select(site, F.col(count).alias("n_now"))
    b = before.select(site, F.col(count).alias("n_before"))
    both = b.join(n, site, "left").withColumn("n_now", F.coalesce("n_now", F.lit(0)))
    return both.filter(F.col("n_now") < share * F.col("n_before"))


def vanished(seen: DataFrame, outputs: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows that passed and are in none of the outputs."""
    out = seen
    for o in outputs:
        out = out.join(o.select(*key).distinct(), key, "left_anti")
    return out


def clock_goes_back(rows: DataFrame, page: str, pos: str, at: Column, minutes: int = 120) -> DataFrame:
    """Pages on which time steps back by more than ``minutes``."""
    w = Window.partitionBy(page).orderBy(pos)
    return rows.withColumn("_back", F.lag(at).over(w) - at).groupBy(page).agg(F.sum(F.when(F.col("_back") > 60 * minutes, 1).otherwise(0)).alias("n_back")).filter("n_back > 0")


def zone_offsets(pairs: DataFrame, site: str, gap_minutes: Column, least: int = 2, share: float = 0.5) -> DataFrame:
    """Sites whose rows lie a whole number of hours from their matches: the offset that at
    least ``share`` of ``least`` rows or more have."""
    rows = pairs.withColumn("offset", F.round(gap_minutes / 60).cast("int")).withColumn("_exact", F.abs(gap_minutes - 60 * F.col("offset")) <= 5)
    n = Window.partitionBy(site)
    counted = rows.filter("_exact").groupBy(site, "offset").agg(F.count("*").alias("n"))
    every = rows.groupBy(site).agg(F.count("*").alias("total"))
    best = counted.join(every, site).withColumn("_rn", F.row_number().over(n.orderBy(F.desc("n"), "offset")))
    return best.filter((F.col("_rn") == 1) & (F.col("offset") != 0) & (F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select(site, "offset", "n", "total")


def mass_failure(pages: DataFrame, site: str, failed: str, least_sites: int = 10, share: float = 0.2) -> DataFrame:
    """One row: sites, sites of which every page failed, and whether so many failed that the
    run, not the sites, is to blame."""
    per = pages.groupBy(site).agg(F.bool_and(failed).alias("all_failed"))
    total = per.agg(F.count("*").alias("sites"), F.coalesce(F.sum(F.when(F.col("all_failed"), 1).otherwise(0)), F.lit(0)).alias("failed"))
    return total.withColumn("is_mass", (F.col("sites") >= least_sites) & (F.col("failed") > share * F.col("sites")))


def too_few(now: DataFrame, before: DataFrame, key: str, count: str, floor: int = 100) -> DataFrame:
    """Keys with fewer than max(floor, half of before); a key that is new or gone counts 0."""
    both = now.select(key, F.col(count).alias("n_now")).join(before.select(key, F.col(count).alias("n_before")), key, "full_outer")
    both = both.select(key, F.coalesce("n_now", F.lit(0)).alias("n_now"), F.coalesce("n_before", F.lit(0)).alias("n_before"))
    return both.filter(F.col("n_now") < F.greatest(F.lit(floor), F.col("n_before") / 2))


def evidence(rows: DataFrame, key: list[str], beside: str, least: int = 2, cap: int = 20) -> DataFrame:
    """Keys seen beside ``least`` different values or more, with up to ``cap`` of them."""
    found = rows.groupBy(*key).agg(F.sort_array(F.collect_set(beside)).alias("_s"), F.count("*").alias("seen")).filter(F.size("_s") >= least)
    return found.select(*key, "seen", F.size("_s").cast("long").alias("n_beside"), F.array_join(F.slice("_s", 1, cap), ",").alias("beside"))


def empty_twins(parents: DataFrame, children: DataFrame, same: list[str], key: str, foreign: str) -> DataFrame:
    """Records that share a name with another and have no children."""
    w = Window.partitionBy(*same)
    twins = parents.withColumn("_n", F.count("*").over(w)).filter("_n > 1").drop("_n")
    return twins.join(children.select(F.col(foreign).alias(key)).distinct(), key, "left_anti")


def first_language(aliases: DataFrame, alias: str, lang: str, order: str) -> DataFrame:
    """How many spellings each language was the first to bring."""
    first = aliases.groupBy(alias).agg(F.min_by(lang, order).alias(lang))
    return first.groupBy(lang).agg(F.count("*").alias("fresh"))


def single_valued(previous: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Two memories joined; keys that end with more than one value are forgotten."""
    both = previous.select(key, value).union(new.select(key, value))
    return both.groupBy(key).agg(F.collect_set(value).alias("_v")).filter(F.size("_v") == 1).select(key, F.col("_v")[0].alias(value))


def silent_watchers(limits: DataFrame, beats: DataFrame, missing: DataFrame, now: Column, uptime: Column | None = None) -> DataFrame:
    """(name, minutes, seen, silent): for how long each watcher has sent no beat: since its last
    one, else since it was first missed, else 0; never longer than the machine is up.

    limits: name, most (minutes it may be silent). beats: name, at. missing: name, first_at.
    ``now``: the instant of the question; beats of the future count as now."""
    last = beats.groupBy("name").agg(F.max("at").alias("_at"))
    first = missing.groupBy("name").agg(F.min("first_at").alias("_first"))
    rows = limits.join(last, "name", "left").join(first, "name", "left")
    since = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.coalesce("_at", "_first").cast("timestamp"))
    minutes = F.greatest(F.lit(0), F.coalesce(F.floor(since / 60), F.lit(0)))
    minutes = minutes if uptime is None else F.least(minutes, uptime)
    return rows.select("name", minutes.cast("long").alias("minutes"), F.col("_at").isNotNull().alias("seen"), (minutes > F.col("most")).alias("silent"))
