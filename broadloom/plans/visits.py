"""Web-log queries over ``events``: a user is a visitor, views, clicks and errors are
requests, purchases are beacons with seconds."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators import visits as V
from broadloom.plans.catalog import query
from broadloom.sources.tables import table

GAP = 1800

SESSION_SQL = """
WITH lagged AS (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > {gap}000000 THEN 1 ELSE 0 END AS is_new
  FROM events),
s AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM lagged)
"""


def _sessions(spark: SparkSession, d: str, gap: int = GAP) -> DataFrame:
    return V.sessionize(table(spark, d, "events"), "user_id", "ts", "event_id", gap)


BOUNDS_SQL = """
SELECT user_id, session_no, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n_rows
FROM s GROUP BY user_id, session_no"""


def _bounds(spark, d, gap):
    out = V.session_bounds(_sessions(spark, d, gap), "user_id", "ts")
    return out.select("user_id", "session_no", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started", "ended")), "n_rows")


@query("sessions_30m", SESSION_SQL.format(gap=GAP) + BOUNDS_SQL)
def sessions_30m(spark: SparkSession, d: str) -> DataFrame:
    return _bounds(spark, d, GAP)


@query("sessions_12h", SESSION_SQL.format(gap=43200) + BOUNDS_SQL)
def sessions_12h(spark: SparkSession, d: str) -> DataFrame:
    return _bounds(spark, d, 43200)


MEASURES_SQL = (
    SESSION_SQL.format(gap=43200)
    + """, m AS (
SELECT user_id, session_no, strftime(min(ts), '%Y-%m-%d') AS day,
  CAST(sum(CASE WHEN event_type IN ('view','click') THEN 1 ELSE 0 END) AS BIGINT) AS pages,
  CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS actions,
  CAST(sum(CASE WHEN event_type = 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 ELSE 1 END) AS BIGINT) AS hits,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN least(60, greatest(0, CAST(floor(value) AS BIGINT))) END) AS BIGINT) AS seconds,
  coalesce(arg_min(CASE WHEN event_type = 'click' THEN 'click' WHEN event_type = 'view' THEN 'view' ELSE '' END, ts) FILTER (WHERE event_type IN ('click','view')), NULL) AS source
FROM s GROUP BY user_id, session_no)
"""
)


def _measures(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    return V.visit_measures(
        _sessions(spark, d, 43200), "user_id", "ts", "event_id",
        is_page=kind.isin("view", "click"), is_action=kind == "signup",
        seconds=F.when(kind == "purchase", F.least(F.lit(60), F.greatest(F.lit(0), F.floor("value")))),
        weight=F.when(kind == "error", k % 5).otherwise(F.lit(1)),
        source=F.when(kind.isin("click", "view"), kind).otherwise(F.lit("")),
    )


@query("session_measures", MEASURES_SQL + "SELECT * FROM m")
def session_measures(spark: SparkSession, d: str) -> DataFrame:
    return _measures(spark, d)


@query("daily_rollup", MEASURES_SQL + """
SELECT day, coalesce(source, 'none') AS source, count(*) AS visits, count(DISTINCT user_id) AS visitors, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(pages) AS BIGINT) AS pages,
  CAST(sum(actions) AS BIGINT) AS actions, CAST(coalesce(sum(seconds), 0) AS BIGINT) AS seconds, count(seconds) AS timed
FROM m GROUP BY day, coalesce(source, 'none')""")
def daily_rollup(spark: SparkSession, d: str) -> DataFrame:
    return V.daily_rollup(_measures(spark, d).withColumn("source", F.coalesce("source", F.lit("none"))), "user_id", ["source"])


@query("two_level_rollup", MEASURES_SQL + """
SELECT day, coalesce(CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END, 'none') AS source, count(*) AS visits, count(DISTINCT user_id) AS visitors
FROM m GROUP BY GROUPING SETS ((day, source), (day))""")
def two_level_rollup(spark: SparkSession, d: str) -> DataFrame:
    m = _measures(spark, d)
    sub = F.when(F.grouping("source") == 1, F.lit("TOTAL")).otherwise(F.coalesce("source", F.lit("none")))
    out = m.groupingSets([["day", "source"], ["day"]], "day", "source").agg(F.count("*").alias("visits"), F.countDistinct("user_id").alias("visitors"), sub.alias("name"))
    return out.select("day", F.col("name").alias("source"), "visits", "visitors")


@query("monthly_series", MEASURES_SQL + "SELECT substr(day, 1, 7) AS month, count(*) AS visits, CAST(sum(pages) AS BIGINT) AS pages, count(DISTINCT user_id) AS visitors FROM m GROUP BY 1")
def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    return _measures(spark, d).groupBy(F.substring("day", 1, 7).alias("month")).agg(F.count("*").alias("visits"), F.sum("pages").alias("pages"), F.countDistinct("user_id").alias("visitors"))


@query("period_uniques", MEASURES_SQL + """, p(period) AS (VALUES (1), (7), (30), (365)),
x AS (SELECT period, coalesce(source, 'none') AS source, user_id FROM m JOIN p ON date_diff('day', CAST(day AS DATE), DATE '2024-01-30') BETWEEN 0 AND period - 1)
SELECT period, CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS visits, count(DISTINCT user_id) AS visitors
FROM x GROUP BY GROUPING SETS ((period, source), (period))""")
def period_uniques(spark: SparkSession, d: str) -> DataFrame:
    m = _measures(spark, d).withColumn("source", F.coalesce("source", F.lit("none")))
    daily = V.daily_sets(m, "user_id", ["source"], salt="pepper")
    out = V.period_uniques(daily, "2024-01-30", ["source"])
    return out.withColumn("source", F.coalesce("source", F.lit("TOTAL")))


@query("forged_sliding_distinct", """
WITH w AS (SELECT a.user_id, a.event_id, count(DISTINCT b.event_type) AS n FROM events a JOIN events b ON a.user_id = b.user_id
  AND floor(epoch(b.ts)) BETWEEN floor(epoch(a.ts)) - 21600 AND floor(epoch(a.ts)) GROUP BY a.user_id, a.event_id)
SELECT user_id, max(n) AS most_labels FROM w GROUP BY user_id HAVING max(n) >= 3""")
def forged_sliding_distinct(spark: SparkSession, d: str) -> DataFrame:
    return V.forged_visitors(table(spark, d, "events"), "user_id", "ts", "event_type", seconds=21600)


@query("visitor_group_case", """
SELECT user_id, CASE WHEN bool_or(CAST(json_extract_string(props, '$.k') AS BIGINT) = 99) THEN 'own' WHEN bool_and(event_type <> 'purchase') THEN 'scanner'
  WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 4 > count(*) THEN 'service' WHEN bool_or(event_type = 'signup') THEN 'human' ELSE 'other' END AS grp
FROM events GROUP BY user_id""")
def visitor_group_case(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    rules = [("own", F.bool_or(k == 99)), ("scanner", F.bool_and(kind != "purchase")), ("service", F.sum(F.when(kind == "error", 1).otherwise(0)) * 4 > F.count("*")), ("human", F.bool_or(kind == "signup"))]
    return V.visitor_groups(table(spark, d, "events"), "user_id", rules, "other")


@query("most_common_agent", """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c)
SELECT user_id, event_type, n FROM r WHERE rn = 1""")
def most_common_agent(spark: SparkSession, d: str) -> DataFrame:
    return V.most_common(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("beacon_join", """
WITH v AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' AND value > 60 GROUP BY user_id)
SELECT e.event_id, e.user_id, v.n AS n_views, least(60, greatest(0, CAST(floor(e.value) AS BIGINT))) AS seconds
FROM events e JOIN v ON e.user_id = v.user_id WHERE e.event_type = 'purchase'""")
def beacon_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    seen = e.filter("event_type = 'view' AND value > 60").groupBy("user_id").agg(F.count("*").alias("n_views"))
    seconds = F.least(F.lit(60), F.greatest(F.lit(0), F.floor("value"))).cast("long")
    return e.filter("event_type = 'purchase'").join(seen, "user_id").select("event_id", "user_id", "n_views", seconds.alias("seconds"))


@query("closable_days", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE date_trunc('day', ts) + INTERVAL 25 HOUR <= TIMESTAMP '2024-01-20 00:30:00' AND date_trunc('day', ts) NOT IN (DATE '2024-01-03', DATE '2024-01-05')")
def closable_days(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    done = spark.createDataFrame([("2024-01-03",), ("2024-01-05",)], "day string")
    return V.unclosed(V.closable(days, "day", "2024-01-20 00:30:00"), done)
