"""Containment queries: names out of the documents' first words and the parts' names, looked up
in the visible text of all pages and in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.functions import text as X
from broadloom.operators import containment as C
from broadloom.plans.catalog import query
from broadloom.sources.shared import materialize
from broadloom.sources.tables import table

#: Pages as words, and names of one to four words: the link labels, part names, and runs of words of pages.
TEXT_SQL = r"""
WITH p AS (SELECT page_id, lower(regexp_extract(html, '<article>(.*?)</article>', 1, 's')) AS body, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages),
t AS (SELECT page_id, list_filter(regexp_split_to_array(body, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w, list_filter(regexp_split_to_array(title, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS tw FROM p),
n AS (SELECT DISTINCT name FROM (SELECT array_to_string(tw[1:1 + page_id % 4], ' ') AS name FROM t UNION ALL SELECT p_name FROM part UNION ALL SELECT array_to_string(w[5:5 + page_id % 4], ' ') FROM t) WHERE name <> ''),
m AS (SELECT name, string_split(name, ' ') AS own FROM n)"""


def _texts(spark, d):
    """Pages with their visible text, and the first words of each: title, words, more (than twelve)."""
    part = lambda pattern: F.regexp_extract("html", pattern, 1)
    text, title = part(r"(?s)<article>(.*?)</article>"), part(r"<title>([^<]*)</title>")
    pages = table(spark, d, "pages").select("page_id", "url", text.alias("text"), title.alias("title"))
    cut = pages.select("page_id", C.words(F.col("title")).alias("title"), C.words(F.col("text")).alias("words"))
    heads = materialize(cut.select("page_id", F.slice("title", 1, 4).alias("title"), F.slice("words", 1, 12).alias("words"), (F.size("words") > 12).alias("more")))
    return pages.drop("title"), heads


def _names(spark, d, heads):
    some = lambda c, at: F.array_join(F.slice(c, at, (F.col("page_id") % 4 + 1).cast("int")), " ").alias("name")
    return heads.select(some("title", 1)).union(table(spark, d, "part").select("p_name")).union(heads.select(some("words", 5)))


@query("names_in_pages", TEXT_SQL + """,
u AS (SELECT page_id, w, unnest(range(len(w))) AS i FROM t),
h AS (SELECT page_id, name, i FROM u JOIN m ON own[1] = w[i + 1] AND w[i + 1:i + len(own)] = own)
SELECT page_id, name, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS places FROM h GROUP BY 1, 2""")
def names_in_pages(spark: SparkSession, d: str) -> DataFrame:
    pages, heads = _texts(spark, d)
    found = C.contained(pages, _names(spark, d, heads), "page_id", "text", "name")
    return found.select("page_id", "name", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


@query("seen_not_shown", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1), '^www\.', '') AS site, list_filter(regexp_split_to_array(lower(regexp_extract(html, '<article>(.*?)</article>', 1, 's')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM pages),
t AS (SELECT *, 600 * page_id AS at, ' ' || array_to_string(w, ' ') || ' ' AS body FROM p),
r AS (SELECT page_id AS ref, 600 * page_id + page_id % 7 * 1200 - 1800 AS start, array_to_string(w[3:3 + page_id % 2], ' ') AS home, array_to_string(w[11:12], ' ') AS away FROM t WHERE len(w) > 12),
h AS (SELECT t.site, t.page_id, r.ref, r.start - t.at AS gap FROM t JOIN r ON r.start - t.at BETWEEN -900 AND 3600 AND contains(t.body, ' ' || r.home || ' ') AND contains(t.body, ' ' || r.away || ' ')),
l AS (SELECT *, row_number() OVER (PARTITION BY site, ref ORDER BY abs(gap), page_id) AS rn FROM h WHERE ref % 3 <> 0)
SELECT site, ref, page_id FROM l WHERE rn = 1""")
def seen_not_shown(spark: SparkSession, d: str) -> DataFrame:
    """A page every ten minutes; matches are named by words of some page, every third is shown."""
    pages, heads = _texts(spark, d)
    k = F.col("page_id")
    shows = pages.select("page_id", X.domain(F.col("url")).alias("site"), F.timestamp_seconds(600 * k).alias("at"), "text")
    named = heads.filter("more")
    some = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    matches = named.select(k.alias("ref"), F.timestamp_seconds(600 * k + k % 7 * 1200 - 1800).alias("start"), some(3, (k % 2 + 1).cast("int")).alias("home"), some(11, F.lit(2)).alias("away"))
    return C.seen_not_shown(shows, matches, _shown(matches, shows)).drop("places")


def _shown(matches: DataFrame, shows: DataFrame) -> DataFrame:
    """Every third match is listed for every site that has a page within a day of it."""
    day = lambda c: F.floor(F.unix_seconds(F.col(c)) / 86400)
    near = F.explode(F.sequence(day("start") - 1, day("start") + 1))
    return matches.filter("ref % 3 = 0").select("ref", near.alias("_d")).join(shows.select("site", day("at").alias("_d")).distinct(), "_d").select("site", "ref")
