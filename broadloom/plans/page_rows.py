"""Pages through the page source: a reader for a family of sites, one that is borrowed, and
the fallback."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.plans.catalog import query
from broadloom.sources import page_source as S
from broadloom.sources.tables import table


def heading(url: str, page: str):
    """One row a page: its heading."""
    if found := re.search(r"<h1>(.*?)</h1>", page):
        yield None, found[1], len(found[1]), None


def menu(url: str, page: str):
    """A row for each link of the menu."""
    for i, (href, label) in enumerate(re.findall(r'<li><a href="([^"]*)">([^<]*)</a></li>', page)):
        yield href, label, i, None


READERS = {".example.net": heading, "menus.test": menu}
#: .example.net has a reader of its own, which wins.
BORROWED = {".example.org": "menus.test", ".example.net": "menus.test"}

ROWS_SQL = r"""
WITH p AS (SELECT url, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1), '^www\.', '') AS site, html FROM pages),
h AS (SELECT site, NULL AS channel, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title, url FROM p WHERE site LIKE '%.example.net' AND regexp_matches(html, '<h1>(.*?)</h1>')),
l AS (SELECT site, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS channel, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS title, unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>')))) AS minute FROM p WHERE site LIKE '%.example.org'),
r AS (SELECT site, channel, title, length(title) AS minute, url FROM h UNION ALL SELECT site, channel, title, minute, url FROM l)"""


@query("source_rows", ROWS_SQL + " SELECT site, channel, title, CAST(minute AS INTEGER) AS minute, url FROM r")
def source_rows(spark: SparkSession, d: str) -> DataFrame:
    """Read by the format, with the columns that the schema names."""
    S.register(spark, READERS, BORROWED)
    source = spark.read.format("broadloom_pages").schema("site string, channel string, title string, minute int, url string")
    return source.load(f"{d}/pages.parquet")


@query("lateral_page_rows", ROWS_SQL + " SELECT site, count(*) AS n, count(channel) AS channels, CAST(sum(minute) AS BIGINT) AS minutes FROM r GROUP BY 1")
def lateral_page_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same rows from a DataFrame of pages, through the table function."""
    rows = S.page_rows(table(spark, d, "pages"), READERS, BORROWED)
    return rows.groupBy("site").agg(F.count("*").alias("n"), F.count("channel").alias("channels"), F.sum("minute").alias("minutes"))
