"""Page and log readers. Pages come as a table (url, html) or whole-text files; parsing is
column expressions where it can be, and a registered reader per domain where it cannot."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.functions.text import domain

PROGRAM = "site string, channel string, title string, minute int, raw_time string, url string"


def visible_lines(html: Column) -> Column:
    """What a reader sees: scripts, styles and comments go, block tags end lines, other tags
    go, common entities are resolved; blank lines go."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|/?(?:p|div|li|ul|tr|td|th|h[1-6]|table|article|nav|section|title|body))\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


TIMED = r"^([01]?[0-9]|2[0-3])[:.]([0-5][0-9])\s+(\S.*)$"


def timed_lines(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The fallback reader: a row for each visible line 'HH:MM title'."""
    rows = pages.select(F.col(url).alias("url"), F.posexplode(visible_lines(F.col(html))).alias("pos", "line")).filter(F.col("line").rlike(TIMED))
    part = lambda i: F.regexp_extract("line", TIMED, i)
    return rows.select(domain(F.col("url")).alias("site"), F.lit(None).cast("string").alias("channel"), part(3).alias("title"), (part(1).cast("int") * 60 + part(2).cast("int")).alias("minute"), F.concat(part(1), F.lit(":"), part(2)).alias("raw_time"), "url")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, href, label) of every link of a page, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a\s*>"), F.lit(0))
    rows = pages.select(F.col(url).alias("url"), F.posexplode(found).alias("pos", "a"))
    part = lambda i: F.regexp_extract("a", r"(?is)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a\s*>", i)
    return rows.select("url", F.col("pos").cast("long").alias("pos"), part(1).alias("href"), F.trim(F.regexp_replace(part(2), r"<[^>]*>", "")).alias("label"))


def json_records(pages: DataFrame, body: str, start_keys: list[str], title_keys: list[str], depth: int | None = 12, most: int | None = 5000) -> DataFrame:
    """The fallback JSON reader: (url, title, start) of every object, at most ``depth`` deep,
    that has a start and a title. A page gives at most ``most`` rows: longer ones are not
    schedules; with None for either bound everything is read. Bodies that are not JSON give
    none."""

    def walk(value, out):
        todo = [(value, 0)]
        while todo and (most is None or len(out) < most):
            value, level = todo.pop()
            if depth is not None and level > depth:
                continue
            if isinstance(value, dict):
                start = next((value[k] for k in start_keys if isinstance(value.get(k), str | int | float)), None)
                title = next((value[k] for k in title_keys if isinstance(value.get(k), str)), None)
                if start is not None and title:
                    out.append((title, str(start)))
                value = list(value.values())
            if isinstance(value, list):
                todo += [(x, level + 1) for x in reversed(value)]

    def read(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for url, text in zip(pdf["url"], pdf["body"], strict=True):
                try:
                    found: list = []
                    walk(json.loads(text), found)
                    rows += [(url, *x) for x in found]
                except (TypeError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["url", "title", "start"])

    return pages.select("url", F.col(body).alias("body")).mapInPandas(read, "url string, title string, start string")


def parse_score(programs: DataFrame, key: str) -> DataFrame:
    """0 to 100 per parse: up to 50 for timed rows, 30 for titled, 10 for pairs, 10 for a
    channel; halved under 5 rows. programs: key, minute, title, is_pair, channel."""
    n = F.count("*")
    share = lambda c: F.sum(F.when(c, 1).otherwise(0))
    raw = 50 * share(F.col("minute").isNotNull()) / n + 30 * share(F.coalesce(F.col("title"), F.lit("")) != "") / n + F.least(F.lit(10), share(F.col("is_pair"))) + F.when(F.max("channel").isNotNull(), 10).otherwise(0)
    return programs.groupBy(key).agg(F.floor(F.when(n < 5, raw / 2).otherwise(raw)).alias("score"), n.alias("rows_n"))


#: Readers by domain. A reader takes (url, html) and yields (channel, title, minute, raw_time).
READERS: dict[str, Callable] = {}


def register(name: str) -> Callable:
    """Decorator: the reader of a domain. A domain's own reader wins over a borrowed one."""

    def add(f: Callable) -> Callable:
        READERS[name] = f
        return f

    return add


def read_pages(pages: DataFrame, readers: dict[str, Callable] | None = None) -> DataFrame:
    """Rows of every page by the reader of its domain; pages without one go to the fallback."""
    table = dict(readers if readers is not None else READERS)
    named = pages.select("url", "html", domain(F.col("url")).alias("site"))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(site, channel, title, minute, raw, url) for url, html, site in zip(pdf["url"], pdf["html"], pdf["site"], strict=True) for channel, title, minute, raw in table[site](url, html)]
            yield pd.DataFrame(rows, columns=["site", "channel", "title", "minute", "raw_time", "url"])

    own = named.filter(F.col("site").isin(*table)) if table else named.limit(0)
    rest = named.filter(~F.col("site").isin(*table)) if table else named
    return own.mapInPandas(run, PROGRAM).unionByName(timed_lines(rest))


LOG_FIELDS = ["at", "ip", "method", "path", "status", "who", "endpoint", "agent", "vid", "ref", "src", "lang"]
BEACON_FIELDS = ["at", "vid", "page", "secs", "acts"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated visit log of 12 fields, or of the 8 of its first version; lines of any
    other number are dropped."""
    return split_log(spark.read.text(path))


def split_log(lines: DataFrame) -> DataFrame:
    cells = F.split("value", "\t", -1)
    rows = lines.select(cells.alias("c")).filter(F.size("c").isin(8, 12))
    return rows.select(*(F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(f) for i, f in enumerate(LOG_FIELDS)))


def split_beacons(lines: DataFrame, most_secs: int = 60, most_acts: int = 100) -> DataFrame:
    """Beacon lines of 5 fields; numbers are held to 0..most, junk is 0."""
    rows = lines.select(F.split("value", "\t", -1).alias("c")).filter(F.size("c") == 5)
    number = lambda i, most: F.least(F.lit(most), F.greatest(F.lit(0), F.coalesce(F.get("c", F.lit(i)).try_cast("int"), F.lit(0))))
    return rows.select(*(F.get("c", F.lit(i)).alias(f) for i, f in enumerate(BEACON_FIELDS[:3])), number(3, most_secs).alias("secs"), number(4, most_acts).alias("acts"))


def filled(template: Column, day: Column) -> Column:
    """An address template with the marks of a day filled; without a day they are empty."""
    marks = {"{date}": F.date_format(day, "yyyy-MM-dd"), "{dmy}": F.date_format(day, "dd.MM.yyyy"), "{unix}": F.unix_timestamp(day.cast("timestamp")).cast("string"), "{weekday}": F.lower(F.date_format(day, "EEEE"))}
    for mark, value in marks.items():
        template = F.replace(template, F.lit(mark), F.coalesce(value, F.lit("")))
    return template


def crawl_plan(sources: DataFrame, first_day: Column, days: int, url: str = "url") -> DataFrame:
    """A row for each source and day, with the address template filled: {date}, {dmy},
    {unix}, {weekday}."""
    plan = sources.withColumn("day", F.explode(F.sequence(first_day, F.date_add(first_day, days - 1))))
    return plan.withColumn("target", filled(F.col(url), F.col("day")))


def crawl_depth(days: Column, own: Column, cap: Column, reference: Column, most: int = 7) -> Column:
    """How many days of a site are fetched: the same for all, at most ``most``; a reference site
    takes its own number if that is more; a site's cap holds for both."""
    deep = F.least(F.lit(most), F.when(F.coalesce(reference, F.lit(False)), F.greatest(F.coalesce(own, F.lit(0)), days)).otherwise(days))
    return F.greatest(F.lit(1), F.when(F.coalesce(cap, F.lit(0)) > 0, F.least(deep, cap)).otherwise(deep))


def crawl_targets(sources: DataFrame, channels: DataFrame, days: int) -> DataFrame:
    """(source_id, channel, day, target): every page to fetch.

    sources: source_id, kind, url (template), today (the site's own date), pages (of a list, a
    day), own_days, max_days, reference. channels: source_id, channel, url (null: the source's).
    By kind: 'grid' one page; 'channels' one for each channel; 'days' one a day; 'paged' the
    pages 1 to days times ``pages`` of one list; any other, each channel on each day, a source
    without channels by its own address. Templates take the marks of ``crawl_plan`` and {n},
    the number of a page or day from 1, and {daynum}, that of a day from 0."""
    by_channel = ~F.col("kind").isin("grid", "days", "paged")
    depth = crawl_depth(F.lit(days), F.col("own_days"), F.col("max_days"), F.col("reference"))
    s = sources.filter(F.col("source_id").isNotNull()).withColumns({"kind": F.coalesce("kind", F.lit("")), "_depth": depth})
    c = channels.select("source_id", "channel", F.col("url").alias("_own"))
    met = s.filter(by_channel).join(c, "source_id", "left").filter((F.col("kind") != "channels") | F.col("channel").isNotNull())
    rows = met.unionByName(s.filter(~by_channel), allowMissingColumns=True)
    n = F.when(F.col("kind").isin("grid", "channels"), 1).when(F.col("kind") == "paged", F.col("_depth") * F.coalesce("pages", F.lit(1))).otherwise(F.col("_depth"))
    rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), n.cast("int"))))
    day = F.when(F.col("kind").isin("grid", "channels"), None).when(F.col("kind") == "paged", F.col("today")).otherwise(F.date_add("today", F.col("_n") - 1))
    rows = rows.withColumns({"day": day, "channel": F.coalesce("channel", F.lit("")), "url": F.coalesce("_own", "url")})
    target = F.replace(F.replace(filled(F.col("url"), F.col("day")), F.lit("{n}"), F.col("_n").cast("string")), F.lit("{daynum}"), (F.col("_n") - 1).cast("string"))
    return rows.select("source_id", "channel", "day", target.alias("target"))
