"""The event listing under all its filters: orders as games, suppliers of their lines as channels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators import relational as R
from broadloom.plans.catalog import query
from broadloom.sources.tables import table

LISTING_SQL = """
WITH g AS (SELECT o_orderkey AS game, strftime(o_orderdate, '%Y-%m-%d') AS date, substr(o_orderpriority, 3) AS sport, o_custkey % 40 AS league_id, c_name AS home, o_orderstatus || ' side' AS away, 'League ' || (o_custkey % 40) AS league FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT DISTINCT l_orderkey AS game, l_suppkey AS channel FROM lineitem WHERE l_quantity > 10), n AS (SELECT game, string_agg(s_name, ' ' ORDER BY s_suppkey) AS names FROM l JOIN supplier ON channel = s_suppkey GROUP BY 1)"""


def _listing(spark, d):
    t = lambda n: table(spark, d, n)
    games = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("game"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.substring("o_orderpriority", 3, 30).alias("sport"), (F.col("o_custkey") % 40).alias("league_id"),
        F.col("c_name").alias("home"), F.concat("o_orderstatus", F.lit(" side")).alias("away"), F.concat(F.lit("League "), (F.col("o_custkey") % 40).cast("string")).alias("league"),
    )
    links = t("lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("channel"))
    return games, links, t("supplier").select(F.col("s_suppkey").alias("channel"), F.col("s_name").alias("name"))


@query("event_page_channel", LISTING_SQL + """,
f AS (SELECT * FROM g WHERE date >= '1995-01-01' AND date <= '1999-12-31' AND sport = 'HIGH' AND game IN (SELECT game FROM l WHERE channel = 7))
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY date, game LIMIT 200 OFFSET 5""")
def event_page_channel(spark: SparkSession, d: str) -> DataFrame:
    """Dates, sport and one channel; the page limit is the feature."""
    order = [F.col("date"), F.col("game")]
    return R.event_page(*_listing(spark, d), order, date_from="1995-01-01", date_to="1999-12-31", sport="HIGH", channel=7, offset=5)


@query("event_page_search", LISTING_SQL + """,
f AS (SELECT g.* FROM g LEFT JOIN n USING (game) WHERE game IN (SELECT game FROM l) AND contains(lower(concat_ws(' ', home, away, league, names)), 'side league 1 supplier#00000000'))
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY date DESC, game LIMIT 500""")
def event_page_search(spark: SparkSession, d: str) -> DataFrame:
    """A phrase over sides, league and channel names, games with channels only."""
    order = [F.desc("date"), F.col("game")]
    return R.event_page(*_listing(spark, d), order, has_channels=True, q="Side League 1 SUPPLIER#00000000", limit=9000)


@query("event_page_league", LISTING_SQL + """,
f AS (SELECT * FROM g WHERE league_id = 3)
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY date, game LIMIT 50 OFFSET 20""")
def event_page_league(spark: SparkSession, d: str) -> DataFrame:
    return R.event_page(*_listing(spark, d), [F.col("date"), F.col("game")], league=3, offset=20, limit=50)
