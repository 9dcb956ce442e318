"""Programme-grid queries over ``events`` (a user is a channel, an event a show) and the
order tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators import schedule as S
from broadloom.operators.relational import first_per
from broadloom.plans.catalog import query
from broadloom.sources.tables import table

CLOCK_SQL = """
WITH c AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE extract(hour FROM ts) * 60 + extract(minute FROM ts) END AS minute FROM events),
p AS (SELECT *, last_value(minute IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
s AS (SELECT user_id, event_id, minute, CAST(sum(CASE WHEN before - minute >= {overlap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shift FROM p)
"""


def _clock(spark, d, overlap):
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("minute"))
    return S.day_shift(rows, ["user_id"], "event_id", "minute", overlap)


@query("midnight_counter", CLOCK_SQL.format(overlap=240) + "SELECT user_id, event_id, shift FROM s")
def midnight_counter(spark: SparkSession, d: str) -> DataFrame:
    return _clock(spark, d, 240).select("user_id", "event_id", "shift")


@query("midnight_counter_any_step", CLOCK_SQL.format(overlap=1) + "SELECT user_id, event_id, shift FROM s")
def midnight_counter_any_step(spark: SparkSession, d: str) -> DataFrame:
    return _clock(spark, d, 1).select("user_id", "event_id", "shift")


@query("evening_pages", CLOCK_SQL.format(overlap=240) + "SELECT user_id, coalesce(max(CASE WHEN shift = 1 THEN minute END) >= 720, false) AS began_evening FROM s GROUP BY user_id")
def evening_pages(spark: SparkSession, d: str) -> DataFrame:
    return S.evening_pages(_clock(spark, d, 240), ["user_id"], "minute").select("user_id", "began_evening").distinct()


@query("start_by_window", CLOCK_SQL.format(overlap=240) + """
SELECT user_id, CASE WHEN before > own THEN -1 ELSE 0 END AS first_day, own, before FROM (SELECT user_id,
  CAST(sum(CASE WHEN minute + 1440 * shift BETWEEN 300 AND 1739 THEN 1 ELSE 0 END) AS BIGINT) AS own,
  CAST(sum(CASE WHEN minute + 1440 * shift - 1440 BETWEEN 300 AND 1739 THEN 1 ELSE 0 END) AS BIGINT) AS before FROM s GROUP BY user_id)""")
def start_by_window(spark: SparkSession, d: str) -> DataFrame:
    return S.start_by_window(_clock(spark, d, 240), ["user_id"], "minute", 300, 1739)


@query("first_show_flag", """
WITH e AS (SELECT event_id, user_id % 20 AS site, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS pair, event_type <> 'purchase' AS guessed, ts FROM events),
f AS (SELECT *, min(ts) OVER (PARTITION BY site, pair) AS first_start FROM e)
SELECT event_id, guessed AND ts > first_start AS is_repeat FROM f""")
def first_show_flag(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("site", F.col("user_id") % 20).withColumn("pair", F.get_json_object("props", "$.k").cast("long") % 5).withColumn("guessed", F.col("event_type") != "purchase")
    return S.first_shows(e, ["site", "pair"], "ts", "guessed").select("event_id", "is_repeat")


@query("nearest_show_rank", """
WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, abs(date_diff('second', date_trunc('day', ts) + INTERVAL 12 HOUR, date_trunc('second', ts))) AS gap, event_type <> 'purchase' AS guessed FROM events),
r AS (SELECT *, min(gap) OVER (PARTITION BY user_id, day) AS least, row_number() OVER (PARTITION BY user_id, day ORDER BY gap, event_id) AS rn FROM e)
SELECT event_id FROM r WHERE NOT guessed OR rn = 1 OR gap - least <= 900""")
def nearest_show_rank(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("guessed", F.col("event_type") != "purchase")
    secs = lambda c: F.unix_seconds(c.cast("timestamp"))
    gap = secs(F.date_trunc("second", "ts")) - secs(F.date_trunc("day", "ts")) - 43200
    return S.nearest_shows(e, ["user_id", "day"], gap, "event_id", "guessed", 900).select("event_id")


@query("multicast_range", """
SELECT a.event_id, count(DISTINCT b.event_type) >= 2 AS is_multicast FROM events a JOIN events b ON a.user_id = b.user_id
 AND abs(floor(epoch(a.ts)) - floor(epoch(b.ts))) <= 7200 GROUP BY a.event_id""")
def multicast_range(spark: SparkSession, d: str) -> DataFrame:
    return S.multicast(table(spark, d, "events"), ["user_id"], "ts", "event_type", 7200).select("event_id", "is_multicast")


@query("full_grid_check", """
WITH m AS (SELECT DISTINCT user_id, ts AS moment_at FROM events WHERE event_type = 'purchase'),
x AS (SELECT m.user_id, m.moment_at, e.ts, e.event_type, floor(epoch(e.ts)) AS s FROM m LEFT JOIN events e ON e.user_id = m.user_id AND floor(epoch(e.ts)) BETWEEN floor(epoch(m.moment_at)) - 86400 AND floor(epoch(m.moment_at)) + 600),
y AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id, moment_at ORDER BY s) AS pause FROM x)
SELECT user_id, strftime(moment_at, '%Y-%m-%d %H:%M:%S.%f') AS moment_at, count(s) AS n_shows,
  count(s) >= 3 AND coalesce(max(pause), 0) <= 43200 AND floor(epoch(moment_at)) - max(s) <= 43200 AND count(DISTINCT event_type) >= 2 AS is_full FROM y GROUP BY user_id, moment_at""")
def full_grid_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    moments = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("moment_at"))
    out = S.full_grid(e, ["user_id"], "ts", "event_type", moments, "moment_at", back=86400, ahead=600, gap=43200)
    return out.withColumn("moment_at", F.date_format("moment_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("placeholder_minute", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority, o_orderdate) >= 3 AS is_round FROM orders")
def placeholder_minute(spark: SparkSession, d: str) -> DataFrame:
    return S.crowded_minutes(table(spark, d, "orders"), ["o_orderpriority", "o_orderdate"], 3).select("o_orderkey", "is_round")


@query("settled_moment", """
WITH c AS (SELECT l_orderkey % 500 AS fs_id, date_trunc('month', l_shipdate) AS moment, count(*) AS votes, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pref FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY fs_id ORDER BY votes DESC, pref DESC, moment) AS rn FROM c)
SELECT fs_id, strftime(moment, '%Y-%m-%d') AS moment, votes FROM r WHERE rn = 1""")
def settled_moment(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("fs_id"), F.date_trunc("month", "l_shipdate").alias("moment"), (F.col("l_returnflag") == "R").alias("pref"))
    return S.settled_moment(li, "fs_id", "moment", "pref").withColumn("moment", F.date_format("moment", "yyyy-MM-dd"))


@query("lead_over_second", """
SELECT l_orderkey, l_quantity AS score, lead FROM (SELECT l_orderkey, l_quantity, l_quantity - lead(l_quantity) OVER w AS lead, row_number() OVER w AS rn
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey)) WHERE rn = 1""")
def lead_over_second(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("tie", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return S.lead_over_second(li, "l_orderkey", "l_quantity", "tie").select("l_orderkey", F.col("l_quantity").alias("score"), "lead")


@query("unique_rows", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def unique_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of identical rows the first stays: the hash is what is shuffled, not the text."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    return docs.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("m")).select("m.doc_id", "m.source")


@query("dup_reject_reason", """
WITH r AS (SELECT doc_id, CASE WHEN length(text) < 60 THEN 'short' WHEN regexp_matches(text, '[#*$%&|<>]{3}') THEN 'symbols' WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 THEN 'copy' ELSE 'kept' END AS reason FROM documents)
SELECT reason, count(*) AS n, min(doc_id) AS example FROM r GROUP BY reason""")
def dup_reject_reason(spark: SparkSession, d: str) -> DataFrame:
    """The journal of a filter: how many rows each reason took, and an example."""
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), F.col("text").rlike("[#*$%&|<>]{3}").alias("sym"), F.md5(F.col("text").cast("binary")).alias("h"))
    copy = F.col("doc_id") > F.min("doc_id").over(Window.partitionBy("h"))
    reason = F.when(F.col("n") < 60, "short").when(F.col("sym"), "symbols").when(copy, "copy").otherwise("kept")
    return rows.withColumn("reason", reason).groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("example"))


@query("earliest_snapshot", "SELECT l_partkey, l_returnflag AS first_value, strftime(l_shipdate, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def earliest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")]
    return first_per(table(spark, d, "lineitem"), ["l_partkey"], order).select("l_partkey", F.col("l_returnflag").alias("first_value"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))


@query("coverage_gaps", """
WITH w AS (SELECT user_id, epoch(ts) AS s, epoch(ts) + 172800 AS e, epoch(TIMESTAMP '2024-01-05') AS lo, epoch(TIMESTAMP '2024-01-25') AS hi FROM events WHERE event_type IN ('view', 'click')),
r AS (SELECT *, greatest(lo, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS reach FROM w)
SELECT user_id, NOT bool_or(s > reach AND reach < hi) AND max(e) >= max(hi) AS is_covered FROM r GROUP BY user_id""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    e = table(spark, d, "events").filter("event_type IN ('view', 'click')").select("user_id", at.alias("s"), (at + 172800).alias("e"))
    point = lambda x: F.unix_seconds(F.lit(x).cast("timestamp_ntz").cast("timestamp")).cast("double")
    e = e.withColumn("lo", point("2024-01-05 00:00:00")).withColumn("hi", point("2024-01-25 00:00:00"))
    return S.covered(e, ["user_id"], "s", "e", "lo", "hi").select("user_id", "is_covered")
