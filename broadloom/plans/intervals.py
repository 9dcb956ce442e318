"""Interval and as-of join queries over ``events``: a purchase is a show, a click a calendar
entry, k of the properties the sport or league."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators import intervals as I
from broadloom.plans.catalog import query
from broadloom.sources.tables import table



def _k():
    return F.get_json_object("props", "$.k").cast("long")


K_SQL = "CAST(json_extract_string({a}.props, '$.k') AS BIGINT)"
HOUR = 3600.0


def _side(spark, d, kind, prefix):
    e = table(spark, d, "events").filter(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias(f"{prefix}_id"), F.col("ts").alias(f"{prefix}_ts"), _k().alias(f"{prefix}_k"))


CONFIRM_SQL = f"""
WITH p AS (SELECT s.user_id, s.event_id AS show_id, c.event_id AS click_id, epoch_us(c.ts) - epoch_us(s.ts) AS gap, {K_SQL.format(a="s")} AS show_k, {K_SQL.format(a="c")} AS click_k
  FROM events s JOIN events c ON s.user_id = c.user_id AND c.ts BETWEEN s.ts - INTERVAL 15 HOUR AND s.ts + INTERVAL 60 HOUR WHERE s.event_type = 'purchase' AND c.event_type = 'click')
"""


def _confirm(spark, d):
    pairs = I.within(_side(spark, d, "purchase", "show"), _side(spark, d, "click", "click"), ["user_id"], "show_ts", "click_ts", -15 * HOUR, 60 * HOUR)
    return pairs.withColumn("gap", F.unix_micros(F.col("click_ts").cast("timestamp")) - F.unix_micros(F.col("show_ts").cast("timestamp")))


@query("asof_confirm", CONFIRM_SQL + "SELECT show_id, click_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY abs(gap), click_id) AS rn FROM p) WHERE rn = 1")
def asof_confirm(spark: SparkSession, d: str) -> DataFrame:
    return I.nearest(_confirm(spark, d), "show_id", F.col("gap"), "click_id").select("show_id", "click_id", "gap")


@query("confirm_ladder", CONFIRM_SQL + """, r AS (SELECT *, CASE WHEN show_k % 10 = click_k % 10 THEN 1 WHEN show_k % 5 = click_k % 5 THEN 2 ELSE 3 END AS rank FROM p),
b AS (SELECT *, min(rank) OVER (PARTITION BY show_id) AS best FROM r), c AS (SELECT *, count(*) OVER (PARTITION BY show_id) AS candidates, row_number() OVER (PARTITION BY show_id ORDER BY abs(gap), click_id) AS rn FROM b WHERE rank = best)
SELECT show_id, click_id, rank, candidates FROM c WHERE rn = 1 AND (rank = 1 OR candidates = 1)""")
def confirm_ladder(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("show_k") % 10 == F.col("click_k") % 10, 1).when(F.col("show_k") % 5 == F.col("click_k") % 5, 2).otherwise(3)
    return I.ladder(_confirm(spark, d), "show_id", rank, F.col("gap"), "click_id").select("show_id", "click_id", "rank", "candidates")


@query("unique_sport", CONFIRM_SQL + "SELECT show_id, min(click_k % 3) AS sport FROM p GROUP BY show_id HAVING count(DISTINCT click_k % 3) = 1")
def unique_sport(spark: SparkSession, d: str) -> DataFrame:
    return I.unique_class(_confirm(spark, d).withColumn("sport", F.col("click_k") % 3), "show_id", "sport")


@query("interval_repeat_antijoin", f"""
SELECT a.event_id FROM events a WHERE a.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.user_id = a.user_id
  AND {K_SQL.format(a="b")} % 4 = {K_SQL.format(a="a")} % 4 AND b.ts < a.ts - INTERVAL 3 HOUR AND b.ts >= a.ts - INTERVAL 60 HOUR)""")
def interval_repeat_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Shows whose pair was not on more than 3 and at most 60 hours before."""
    e = table(spark, d, "events").filter("event_type = 'view'").select("user_id", F.col("event_id").alias("_id"), "ts", (_k() % 4).alias("pair"))
    earlier = e.select("user_id", "pair", F.col("ts").alias("seen_ts"))
    return I.within(e, earlier, ["user_id", "pair"], "ts", "seen_ts", -60 * HOUR, -3 * HOUR, "left_anti", closed=(True, False)).select(F.col("_id").alias("event_id"))


@query("same_game_pairs", """
SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type = b.event_type
  AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN -9000000000 AND 9000000000""")
def same_game_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Theta self-join: same channel and kind, at most 150 minutes apart."""
    e = table(spark, d, "events")
    a = e.select("user_id", "event_type", F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
    b = e.select("user_id", "event_type", F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts"))
    return I.within(a, b, ["user_id", "event_type"], "a_ts", "b_ts", -9000, 9000, extra=F.col("a_id") < F.col("b_id")).select("a_id", "b_id")


@query("same_show_own_channel", """
WITH p AS (SELECT s.event_id AS show_id, c.event_id AS own_id FROM events s JOIN events c ON s.user_id = c.user_id AND epoch_us(c.ts) - epoch_us(s.ts) BETWEEN -14400000000 AND 14400000000
  WHERE s.event_type = 'signup' AND c.event_type = 'view')
SELECT show_id, min(own_id) AS own_id FROM p GROUP BY show_id HAVING count(*) = 1""")
def same_show_own_channel(spark: SparkSession, d: str) -> DataFrame:
    """The one show of the own channel near in time; none if there are several."""
    pairs = I.within(_side(spark, d, "signup", "show"), _side(spark, d, "view", "own"), ["user_id"], "show_ts", "own_ts", -4 * HOUR, 4 * HOUR)
    return pairs.groupBy("show_id").agg(F.min("own_id").alias("own_id"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query("contradicted_rows", f"""
SELECT s.event_id FROM events s WHERE s.event_type = 'click' AND EXISTS (SELECT 1 FROM events g WHERE g.event_type = 'error' AND g.user_id = s.user_id
  AND epoch_us(g.ts) - epoch_us(s.ts) BETWEEN -5400000000 AND 5400000000 AND {K_SQL.format(a="g")} % 2 <> {K_SQL.format(a="s")} % 2)""")
def contradicted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that another grid of the same channel contradicts at the same time."""
    s = _side(spark, d, "click", "s").withColumn("_id", F.col("s_id"))
    g = _side(spark, d, "error", "g")
    return I.within(s, g, ["user_id"], "s_ts", "g_ts", -5400, 5400, "left_semi", extra=F.col("g_k") % 2 != F.col("s_k") % 2).select(F.col("s_id").alias("event_id"))


@query("token_candidates", """
WITH t AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), q AS (SELECT DISTINCT n_nationkey, w FROM nation JOIN t ON t.p_partkey % 25 = n_nationkey)
SELECT q.n_nationkey, t.p_partkey, count(DISTINCT q.w) AS shared FROM q JOIN t ON q.w = t.w GROUP BY 1, 2""")
def token_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Inverted-index candidates over all parts, frequent words included: rows that share a
    word, with how many."""
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    asked = words.join(table(spark, d, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey")).select("n_nationkey", "w").distinct()
    met = asked.join(words.distinct(), "w")
    return met.groupBy("n_nationkey", "p_partkey").agg(F.countDistinct("w").alias("shared"))


@query("symmetric_pairs", """
SELECT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b, count(*) AS n, count(DISTINCT s_nationkey) AS orders_seen
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def symmetric_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.least("s_nationkey", "c_nationkey").alias("a"), F.greatest("s_nationkey", "c_nationkey").alias("b")).agg(F.count("*").alias("n"), F.countDistinct("s_nationkey").alias("orders_seen"))
