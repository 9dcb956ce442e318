"""Retraction with its page evidence, and whole crawl plans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators import retraction as R
from broadloom.plans.catalog import query
from broadloom.sources import pages as P
from broadloom.sources.shared import materialize
from broadloom.sources.tables import table

#: Marks from shipped lines, on sites of five kinds of pages; the file lacks a sixth of them.
MARKS_SQL = """
WITH m0 AS (SELECT DISTINCT l_orderkey AS game, l_suppkey % 20 AS s, l_partkey % 3 AS c, l_shipdate + to_hours(CAST(l_partkey % 24 AS INT)) AS start FROM lineitem),
m AS (SELECT *, game || '/' || s || '/' || c || '/' || strftime(start, '%Y-%m-%d %H') AS mark_id, strftime(start, '%Y-%m-%d') AS day, strftime(start - INTERVAL 1 DAY, '%Y-%m-%d') AS before, s % 5 AS k FROM m0),
seen AS (SELECT DISTINCT s, c, game, day FROM m WHERE game % 6 <> 0 OR c = 1 AND s % 2 = 0),"""


@query("retraction_verdicts", MARKS_SQL + """
pages AS (SELECT DISTINCT s, k, c, day, (s + c + CASE WHEN k IN (1, 4) THEN 0 ELSE CAST(right(day, 2) AS INT) END) % 7 <> 0 AS ok, (s + CAST(right(day, 2) AS INT)) % 11 <> 0 AS there FROM m),
by_day AS (SELECT s, day, bool_and(ok) AS ok FROM pages WHERE there AND k IN (0, 3) GROUP BY 1, 2),
lists AS (SELECT s, bool_and(ok) AS ok FROM pages WHERE there AND k IN (1, 4) GROUP BY 1),
own AS (SELECT s, c, day, ok FROM pages WHERE there AND k = 2),
live AS (SELECT s, day, count(*) AS n FROM m WHERE start > TIMESTAMP '1996-06-01' GROUP BY 1, 2), given AS (SELECT s, day, count(*) AS n FROM seen GROUP BY 1, 2), latest AS (SELECT s, max(day) AS day FROM seen GROUP BY 1)
SELECT m.mark_id, CASE WHEN m.start <= TIMESTAMP '1996-06-01' THEN 'started' WHEN m.s = 13 THEN 'no answer'
  WHEN NOT coalesce(CASE WHEN k = 0 THEN d.ok WHEN k IN (1, 4) THEN l.ok WHEN k = 3 THEN d.ok AND (hour(m.start) >= 8 OR coalesce(db.ok, false)) ELSE o.ok AND (hour(m.start) >= 8 OR coalesce(ob.ok, false)) END, false) THEN 'page missing'
  WHEN k = 1 AND NOT t.day > m.day THEN 'list ends' WHEN coalesce(g.n, 0) = 0 OR g.n < ceil(v.n * 0.5) THEN 'too few' ELSE 'retract' END AS verdict
FROM m ANTI JOIN seen USING (game, s, c) LEFT JOIN by_day d ON d.s = m.s AND d.day = m.day LEFT JOIN by_day db ON db.s = m.s AND db.day = m.before LEFT JOIN lists l ON l.s = m.s
LEFT JOIN own o ON o.s = m.s AND o.c = m.c AND o.day = m.day LEFT JOIN own ob ON ob.s = m.s AND ob.c = m.c AND ob.day = m.before
LEFT JOIN live v ON v.s = m.s AND v.day = m.day LEFT JOIN given g ON g.s = m.s AND g.day = m.day LEFT JOIN latest t ON t.s = m.s""")
def retraction_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Dated pages, lists, channel pages, undated day grids and one grid for all days."""
    s, c = (F.col("l_suppkey") % 20).cast("int"), (F.col("l_partkey") % 3).cast("int")
    start = F.expr("l_shipdate + make_dt_interval(0, cast(l_partkey % 24 as int))")
    lines = materialize(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game"), s.alias("s"), c.alias("c"), start.alias("start")).distinct())
    named = {"site": F.concat(F.lit("s"), F.col("s").cast("string"), F.lit(".tv")), "channel": F.concat(F.lit("c"), F.col("c").cast("string"))}
    m = lines.withColumns({"mark_id": F.concat_ws("/", "game", "s", "c", F.date_format("start", "yyyy-MM-dd HH")), **named})
    k, host = F.col("s") % 5, F.concat(F.lit("https://www."), "site")
    # the page of a day has another number in every crawl; only its kind is the same
    url = F.when(k == 0, F.concat(host, F.lit("/on/"), F.date_format("start", "dd.MM.yyyy"))).when(k == 1, F.concat(host, F.lit("/list/?page="), F.col("c").cast("string"))).when(k == 2, F.concat(host, F.lit("/ch/7?id="), "channel")).when(k == 3, F.concat(host, F.lit("/day/3/"))).otherwise(F.concat(host, F.lit("/grid")))
    m = m.withColumn("url", url)
    seen = m.filter("game % 6 <> 0 OR c = 1 AND s % 2 = 0")
    dom = F.substring("day", 9, 2).cast("int")
    days = lines.select("s", "c", F.to_date("start").alias("start")).distinct().withColumns({"day": F.date_format("start", "yyyy-MM-dd"), **named}).withColumn("url", url)
    rows = days.filter((F.col("s") + dom) % 11 != 0)
    verdict = F.when(F.col("s") == 13, "no reply").when((F.col("s") + F.col("c") + F.when(k.isin(1, 4), 0).otherwise(dom)) % 7 != 0, "schedule").otherwise("empty")
    report = rows.select("site", F.when(k == 2, F.concat(F.lit("The "), "channel")).otherwise("").alias("channel"), "url", F.when(k == 4, "").otherwise(F.col("day")).alias("day"), verdict.alias("verdict"), (k == 1).alias("paged"))
    names = lines.select("c").distinct().withColumn("channel", named["channel"]).select(F.lit(None).cast("string").alias("site"), "channel", F.concat(F.lit("The "), "channel").alias("spelling"))
    coverage = R.page_coverage(report, "schedule", ["no reply"])
    return R.retraction_verdicts(m.select("mark_id", "game", "site", "channel", "url", "start"), seen.select("game", "site", "channel", "start"), names, coverage, F.lit("1996-06-01").cast("timestamp_ntz"))


@query("crawl_targets", """
WITH s AS (SELECT s_suppkey AS source_id, s_suppkey % 5 AS k, 'http://s' || s_suppkey || '.tv/' AS base, DATE '2024-02-27' + CAST(s_suppkey % 2 AS INT) AS today,
  greatest(1, least(CASE WHEN s_suppkey % 7 = 0 THEN 6 ELSE 4 END, CASE WHEN s_suppkey % 6 = 0 THEN 3 ELSE 7 END)) AS depth FROM supplier),
c AS (SELECT DISTINCT l_suppkey AS source_id, 'c' || (l_partkey % 4) AS channel FROM lineitem WHERE l_partkey % 3 = 0 AND l_suppkey % 4 <> 0)
SELECT source_id, '' AS channel, CAST(NULL AS VARCHAR) AS day, base || 'all' AS target FROM s WHERE k = 0
UNION ALL SELECT s.source_id, channel, NULL, base || channel FROM s JOIN c ON s.source_id = c.source_id WHERE k = 1
UNION ALL SELECT source_id, '', strftime(today + CAST(n - 1 AS INT), '%Y-%m-%d'), base || strftime(today + CAST(n - 1 AS INT), '%d.%m.%Y') || '?d=' || (n - 1) FROM s, range(1, 8) r(n) WHERE k = 2 AND n <= depth
UNION ALL SELECT source_id, '', strftime(today, '%Y-%m-%d'), base || 'list?page=' || n FROM s, range(1, 15) r(n) WHERE k = 3 AND n <= 2 * depth
UNION ALL SELECT s.source_id, coalesce(channel, ''), strftime(today + CAST(n - 1 AS INT), '%Y-%m-%d'), base || coalesce(channel || '/', '') || strftime(today + CAST(n - 1 AS INT), '%Y-%m-%d') FROM s LEFT JOIN c ON s.source_id = c.source_id, range(1, 8) r(n) WHERE k = 4 AND n <= depth""")
def crawl_targets(spark: SparkSession, d: str) -> DataFrame:
    """Sources of all kinds, some reference sites of more days, some with a cap or no channels."""
    n = F.col("s_suppkey")
    kind, base = n % 5, F.concat(F.lit("http://s"), n.cast("string"), F.lit(".tv/"))
    url = F.when(kind == 0, F.concat(base, F.lit("all"))).when(kind == 2, F.concat(base, F.lit("{dmy}?d={daynum}"))).when(kind == 3, F.concat(base, F.lit("list?page={n}"))).otherwise(F.concat(base, F.lit("{date}")))
    name = F.when(kind == 0, "grid").when(kind == 1, "channels").when(kind == 2, "days").when(kind == 3, "paged")
    s = table(spark, d, "supplier").select(n.alias("source_id"), name.alias("kind"), url.alias("url"), F.date_add(F.lit("2024-02-27").cast("date"), (n % 2).cast("int")).alias("today"), F.lit(2).alias("pages"), F.lit(6).alias("own_days"), F.when(n % 6 == 0, 3).alias("max_days"), (n % 7 == 0).alias("reference"))
    c = table(spark, d, "lineitem").filter("l_partkey % 3 = 0 AND l_suppkey % 4 <> 0").select(F.col("l_suppkey").alias("source_id"), F.concat(F.lit("c"), (F.col("l_partkey") % 4).cast("string")).alias("channel")).distinct()
    address = F.concat(F.lit("http://s"), F.col("source_id").cast("string"), F.lit(".tv/"), "channel", F.when(F.col("source_id") % 5 == 4, "/{date}").otherwise(""))
    out = P.crawl_targets(s, c.withColumn("url", address), 4)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
