"""Streaming queries: the event log as a file stream, run to its end."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.plans import store, visits  # noqa: F401  (the SQL of their batch forms)
from broadloom.plans.catalog import ORACLES, query
from broadloom.plans.names import RATE_SQL
from broadloom.plans.store import silent_days
from broadloom.sources.shared import new_path
from broadloom.sources.tables import table
from broadloom.streaming import states as T2
from broadloom.streaming import visits as T


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return T.file_stream(spark, d, "events.parquet", table(spark, d, "events").schema)


@query("session_stream", """
WITH l AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 43200000000 THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n_rows FROM s GROUP BY user_id, k""")
def session_stream(spark: SparkSession, d: str) -> DataFrame:
    out = T.run_to_table(T.session_stream(_stream(spark, d), "user_id", "ts", gap="12 hours"), "complete", keep_last=True)
    return out.select("user_id", *(F.unix_micros(c).alias(c) for c in ("started", "ended")), "n_rows")


@query("tumbling_day_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_day_stream(spark: SparkSession, d: str) -> DataFrame:
    return T.run_to_table(T.tumbling_days(_stream(spark, d), "ts", ["event_type"]), "complete", keep_last=True)


@query("late_rows_stream", "SELECT DISTINCT user_id, event_type FROM events")
def late_rows_stream(spark: SparkSession, d: str) -> DataFrame:
    return T.run_to_table(T.first_rows(_stream(spark, d), ["user_id", "event_type"], "ts", late="400 days"), "append").select("user_id", "event_type")


@query("rate_limit_stream", RATE_SQL.format(span=36000, name=""))
def rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    out = T.run_to_table(T.rate_limit_stream(_stream(spark, d), "user_id", "event_id", "ts", limit=2, seconds=36000), "append")
    return out.select(F.col("row_id").alias("event_id"), "is_rejected")


def _run(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    out = new_path(spark)
    T2.run(stream, out, new_path(spark))
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


@query("forged_stream", ORACLES["forged_sliding_distinct"])
def forged_stream(spark: SparkSession, d: str) -> DataFrame:
    """The sliding distinct count with state: the last row of a visitor has its most labels."""
    out = _run(T2.sliding_labels(_stream(spark, d), "user_id", "ts", "event_type", seconds=21600, late="400 days"))
    return out.groupBy(F.col("visitor").alias("user_id")).agg(F.max("most_labels").alias("most_labels")).filter("most_labels >= 3")


@query("moved_stream", """
WITH v AS (SELECT user_id, epoch_us(ts) // 1000000 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
m AS (SELECT user_id, max(CASE WHEN rn = n THEN sec END) AS now_at, max(CASE WHEN rn = 1 THEN sec END) AS first_at FROM v GROUP BY 1)
SELECT user_id, now_at, CASE WHEN now_at - first_at >= 3600 * 24 * 25 THEN first_at END AS moved_from FROM m""")
def moved_stream(spark: SparkSession, d: str) -> DataFrame:
    out = _run(T2.moved_stream(_stream(spark, d), "user_id", "ts", "event_id", "ts", least_hours=24 * 25, days=400))
    return out.groupBy(F.col("key").alias("user_id")).agg(F.max_by(F.struct("now_at", "moved_from"), "versions").alias("x")).select("user_id", "x.*")


@query("streak_stream", ORACLES["streak_state"])
def streak_stream(spark: SparkSession, d: str) -> DataFrame:
    """Silent days of every visitor, written as a table and read as a stream."""
    days = silent_days(spark, d)
    path = new_path(spark)
    days.write.parquet(path)
    out = _run(T2.streak_stream(T.file_stream(spark, path, "*.parquet", days.schema), "user_id", "day", "silent", "was_read"))
    return out.select(F.col("key").alias("user_id"), F.date_format("day", "yyyy-MM-dd").alias("day"), "streak")
