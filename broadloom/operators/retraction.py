"""Retraction by proof of absence: which rule forbids to take a mark back, page by page.

A mark says that a site shows a game on a channel. A new file that lacks it proves nothing by
itself: the page that would show it may not have been fetched, may hold another day, or may
be a list that ends before the game. All is joined by page kind and day; no site's pages are
brought into one row. Marks of one site, channel, address and day are one case, which is judged
once, whatever number of marks it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.sources.shared import materialize

YEAR_FIRST = r"(?<![0-9])([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?![0-9])"
YEAR_LAST = r"(?<![0-9])([0-9]{1,2})[-./]([0-9]{1,2})[-./]([0-9]{4})(?![0-9])"


def address_kind(url: Column) -> Column:
    """Site and path without its numbers and the query: what pages of one kind share."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)^[a-z]+://(?:www\.)?|[?#].*$", "")
    site = F.lower(F.regexp_extract(bare, "^[^/]*", 0))
    path = F.regexp_replace(F.regexp_extract(bare, "/.*$", 0), "[0-9]+", "#")
    return F.regexp_replace(F.concat(site, path), "/+$", "")


def address_day(url: Column) -> Column:
    """The first date that an address holds, year first or last, as yyyy-MM-dd; '' if none.
    Day numbers, weekdays and seconds are none: they mean other pages on other days."""
    text = F.replace(F.coalesce(url, F.lit("")), F.lit("%2F"), F.lit("/"))
    both = F.regexp_extract(text, f"{YEAR_FIRST}|{YEAR_LAST}", 0)
    part = lambda pattern, i: F.lpad(F.regexp_extract(both, pattern, i), 2, "0")
    first = F.concat_ws("-", F.regexp_extract(both, YEAR_FIRST, 1), part(YEAR_FIRST, 2), part(YEAR_FIRST, 3))
    last = F.concat_ws("-", F.regexp_extract(both, YEAR_LAST, 3), part(YEAR_LAST, 2), part(YEAR_LAST, 1))
    found = F.when(both.rlike(YEAR_FIRST), first).when(both.rlike(YEAR_LAST), last)
    return F.coalesce(F.date_format(found.try_cast("date"), "yyyy-MM-dd"), F.lit(""))


def undated(url: Column) -> Column:
    text = F.replace(F.coalesce(url, F.lit("")), F.lit("%2F"), F.lit("/"))
    return F.regexp_replace(text, f"{YEAR_FIRST}|{YEAR_LAST}", "")


def page_coverage(report: DataFrame, whole: str, silent: list[str]) -> dict[str, DataFrame]:
    """What a crawl report proves. report: site, channel ('' for a grid of all channels), url,
    day ('' for none), verdict, paged (a list that runs through all days).

    'answered' (site); 'kinds' (kind, dated, paged): do all its addresses hold their own day;
    'pages' (kind, day, channel, ok): a channel needs one whole page, a grid all of its pages;
    'keys' (kind, day, only_grid, grid_ok); 'addresses' (kind, day, address, n, ok). The report's
    addresses are taken apart once, as all five read them."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = report.select("site", text("channel"), "url", text("day"), "verdict", F.coalesce("paged", F.lit(False)).alias("paged"))
    rows = rows.withColumns({"kind": address_kind(F.col("url")), "ok": F.coalesce(F.col("verdict") == whole, F.lit(False)), "day": F.when(F.col("paged"), "").otherwise(F.col("day"))})
    own_day = F.when(F.col("day") != "", address_day(F.col("url")) == F.col("day"))
    rows = materialize(rows.select("site", "channel", "day", "verdict", "paged", "kind", "ok", own_day.alias("own_day"), undated(F.col("url")).alias("address")))
    kinds = rows.groupBy("kind").agg(F.coalesce(F.bool_and("own_day"), F.lit(False)).alias("dated"), F.bool_or("paged").alias("paged"))
    whole_of = F.when(F.col("channel") == "", F.bool_and("ok")).otherwise(F.bool_or("ok"))
    pages = rows.groupBy("kind", "day", "channel").agg(whole_of.alias("ok"))
    keys = pages.groupBy("kind", "day").agg(F.bool_and(F.col("channel") == "").alias("only_grid"), F.coalesce(F.bool_or(F.when(F.col("channel") == "", F.col("ok"))), F.lit(False)).alias("grid_ok"))
    addresses = rows.groupBy("kind", "day", "address").agg(F.count_distinct("channel").alias("n"), F.bool_or("ok").alias("any_ok"))
    answered = rows.filter(F.col("verdict").isNotNull() & ~F.col("verdict").isin(silent)).select("site").distinct()
    return {"answered": answered, "kinds": kinds, "pages": pages, "keys": keys, "addresses": addresses}


def retraction_verdicts(marks: DataFrame, seen: DataFrame, names: DataFrame, coverage: dict[str, DataFrame], collected: Column, backfill: bool = False, new_file: bool = True, orphans: bool = True, share: float = 0.5, night_until: int = 8) -> DataFrame:
    """(mark_id, verdict) of every live mark that the new file lacks: 'retract', or the first
    rule that forbids it: 'backfill', 'old file', 'not in file', 'started', 'no answer',
    'page missing', 'list ends', 'too few'.

    marks: mark_id, game, site, channel, url, start (timestamp_ntz); seen: game, site, channel,
    start of the file; names: site (null: any), channel, spelling, how reports write a channel.

    The page that must be whole is that of the day which the address holds, if addresses of its
    kind hold their day, else that of the game's day and, for a game before ``night_until``
    o'clock, also of the day before, whose page may run through the night. Pages without a day
    speak for all days. Of channel pages it is the channel's own, by its spellings, else the
    one at the same address without dates if only one channel has it. A list must show a later
    day of the site. ``orphans``: may a game be judged that no site of the file shows?"""
    day = F.date_format("start", "yyyy-MM-dd")
    if backfill or not new_file:
        return marks.select("mark_id", F.lit("backfill" if backfill else "old file").alias("verdict"))
    ahead = F.coalesce(F.col("start") > collected, F.lit(False))
    # the file goes once to where its games meet the marks, and is counted there
    file = seen.select("game", "site", "channel", day.alias("day")).repartition("game", "site", "channel").distinct()
    given = file.groupBy("site", "day").agg(F.count("*").alias("given"))
    last = given.groupBy("site").agg(F.max("day").alias("last_day"))
    live = marks.filter(ahead).groupBy("site", day.alias("day")).agg(F.count("*").alias("live"))
    gone = marks.join(file, ["game", "site", "channel"], "left_anti")
    if orphans:
        gone = gone.withColumn("in_file", F.lit(True))
    else:
        gone = gone.join(seen.select("game").distinct().withColumn("in_file", F.lit(True)), "game", "left")
    settled = F.when(F.col("in_file").isNull(), "not in file").when(~ahead, "started")
    before = F.when(F.hour("start") < night_until, F.date_format(F.date_sub(F.to_date("start"), 1), "yyyy-MM-dd"))
    gone = materialize(gone.select("mark_id", settled.alias("settled"), "site", "channel", F.coalesce("url", F.lit("")).alias("url"), day.alias("day"), before.alias("before")))
    open_ = gone.filter("settled IS NULL")
    cases = _judged(open_.select("site", "channel", "url", "day", "before").distinct(), names, coverage, live, given, last, share)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("site", "channel", "before")] + [F.col(c) == F.col(f"_{c}") for c in ("url", "day")]
    return gone.filter("settled IS NOT NULL").select("mark_id", F.col("settled").alias("verdict")).union(open_.join(cases, same).select("mark_id", "verdict"))


def _judged(cases: DataFrame, names: DataFrame, coverage: dict[str, DataFrame], live: DataFrame, given: DataFrame, last: DataFrame, share: float) -> DataFrame:
    """(_site, _channel, _url, _day, _before, verdict) of the distinct cases by page evidence and
    counts of the site's day; before: the day before, for a game at night."""
    parts = {"kind": address_kind(F.col("url")), "address": undated(F.col("url")), "own": address_day(F.col("url")), "_case": F.monotonically_increasing_id()}
    cases = materialize(cases.withColumns(parts))
    known = cases.join(coverage["answered"].withColumn("answered", F.lit(True)), "site", "left").join(coverage["kinds"], "kind", "left")
    known = known.join(live, ["site", "day"], "left").join(given, ["site", "day"], "left").join(last, "site", "left")

    days = F.when(F.coalesce("dated", F.lit(False)) & (F.col("own") != ""), F.array("own")).when(F.col("before").isNotNull(), F.array("before", "day")).otherwise(F.array("day"))
    needs = cases.join(coverage["kinds"], "kind", "left").select("_case", "site", "channel", "kind", "address", F.explode(days).alias("page_day"))
    asked = needs.select("*", F.explode(F.array(F.lit(""), "page_day")).alias("key_day"))
    on_key = lambda df, *more: df.withColumnRenamed("day", "key_day").select("kind", "key_day", *more)
    met = asked.join(on_key(coverage["keys"], "only_grid", "grid_ok"), ["kind", "key_day"])
    spelled = names.select(F.col("site").alias("of"), "channel", "spelling")
    by_name = met.join(spelled, "channel").filter(F.col("of").isNull() | (F.col("of") == F.col("site"))).withColumn("channel", F.col("spelling"))
    by_name = by_name.join(on_key(coverage["pages"], "channel", "ok"), ["kind", "key_day", "channel"])
    by_name = by_name.groupBy("_case", "page_day", "key_day").agg(F.bool_or("ok").alias("own_ok"))
    met = met.join(by_name, ["_case", "page_day", "key_day"], "left").join(on_key(coverage["addresses"], "address", "n", "any_ok"), ["kind", "key_day", "address"], "left")
    proves = F.when(F.col("own_ok").isNotNull(), F.col("own_ok")).when(F.col("only_grid"), F.col("grid_ok")).when(F.col("n") == 1, F.col("any_ok")).otherwise(False)
    # pages without a day come first; a day that has no page of the kind proves nothing
    of_day = met.groupBy("_case", "page_day").agg(F.min_by(proves, "key_day").alias("proof"))
    whole = of_day.groupBy("_case").agg(F.count_if("proof").alias("whole"))
    n, k = F.coalesce("given", F.lit(0)), F.coalesce("live", F.lit(0))
    verdict = (
        F.when(F.col("answered").isNull(), "no answer")
        .when(F.coalesce("whole", F.lit(0)) < F.size(days), "page missing")
        .when(F.coalesce("paged", F.lit(False)) & ~F.coalesce(F.col("last_day") > F.col("day"), F.lit(False)), "list ends")
        .when((n == 0) | (n < F.ceil(k * share)), "too few")
        .otherwise("retract")
    )
    return known.join(whole, "_case", "left").select(*(F.col(c).alias(f"_{c}") for c in ("site", "channel", "url", "day", "before")), verdict.alias("verdict"))
