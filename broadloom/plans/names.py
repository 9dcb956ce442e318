"""Name matching and merge queries. Scores have no SQL form; tests hold brute-force versions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.functions import names as N
from broadloom.operators import merge as M
from broadloom.plans.catalog import query
from broadloom.sources.tables import table


@query("fuzzy_same_name")
def fuzzy_same_name(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct part names that are alike (85 or more)."""
    return M.alike_names(table(spark, d, "part").select(F.lower("p_name").alias("name")))


def _entries(spark, d):
    e = table(spark, d, "events").filter("event_type IN ('purchase', 'signup')")
    k = F.get_json_object("props", "$.k").cast("long")
    club = lambda x: F.element_at(F.array(*(F.lit(n) for n in ("Dynamo Kyiv", "Real Madrid", "FC Porto", "Ajax", "Olympique Lyon", "Spartak"))), (x % 6 + 1).cast("int"))
    return e.select(F.col("event_id").alias("entry_id"), F.col("ts").alias("start"), (F.col("user_id") % 30).alias("site"), club(k).alias("home"), club(k / 6).alias("away"), F.when(k % 4 == 0, "").when(k % 2 == 0, "F").otherwise("B").alias("sport"))


@query("merged_games")
def merged_games(spark: SparkSession, d: str) -> DataFrame:
    return M.merged_entries(_entries(spark, d), ["site"])


@query("majority_sport", """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1""")
def majority_sport(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")))
    return M.majority_sport(e, "user_id", "event_type", "event_id")


#: Events of a visitor one after another, and the recursion that carries what was kept so far.
WALK_SQL = "WITH RECURSIVE o AS (SELECT event_id, user_id, event_type <> 'purchase' AS guessed, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@query("late_repeats", WALK_SQL + """,
r AS (SELECT event_id, user_id, rn, [t] AS kept, false AS is_repeat FROM o WHERE rn = 1 UNION ALL
  SELECT o.event_id, o.user_id, o.rn, CASE WHEN o.guessed AND len(list_filter(r.kept, lambda x: o.t - x > 9000 AND o.t - x <= 108000)) > 0 THEN list_filter(r.kept, lambda x: o.t - x <= 108000) ELSE list_append(list_filter(r.kept, lambda x: o.t - x <= 108000), o.t) END,
    o.guessed AND len(list_filter(r.kept, lambda x: o.t - x > 9000 AND o.t - x <= 108000)) > 0 FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
SELECT event_id, is_repeat FROM r""")
def late_repeats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") != "purchase").alias("guessed"))
    return M.late_repeats(e, ["user_id"], "ts", "event_id", "guessed").select("event_id", "is_repeat")


RATE_SQL = WALK_SQL + """,
r AS (SELECT event_id, user_id, rn, [t] AS kept, false AS is_rejected FROM o WHERE rn = 1 UNION ALL
  SELECT o.event_id, o.user_id, o.rn, CASE WHEN len(list_filter(r.kept, lambda x: o.t - x <= {span})) >= 2 THEN list_filter(r.kept, lambda x: o.t - x <= {span}) ELSE list_append(list_filter(r.kept, lambda x: o.t - x <= {span}), o.t) END,
    len(list_filter(r.kept, lambda x: o.t - x <= {span})) >= 2 FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
SELECT event_id{name}, is_rejected FROM r"""


@query("rate_limited", RATE_SQL.format(span=36000, name=""))
def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return M.rate_limited(e, "user_id", "ts", "event_id", limit=2, seconds=36000).select("event_id", "is_rejected")


@query("bridge_components")
def bridge_components(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers (even nodes) and orders (odd nodes) that any line ties; a recursive query is
    too slow for it, so tests hold a brute-force version."""
    from broadloom.operators.graph import components

    return components(table(spark, d, "lineitem").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_orderkey") * 2 + 1).alias("b")))


@query("latin_names")
def latin_names(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct word of the documents."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))
    return table(spark, d, "documents").select(words.alias("name")).distinct().select("name", N.latin(F.col("name")).alias("latin"), N.normal_form(F.col("name")).alias("normal"))
