"""Listing, counting, membership and set queries on the order tables.

An order is a scheduled game: its customer the home side, the nation the league, line items
its channel marks, a part the channel and a supplier the source of a mark.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators import relational as R
from broadloom.plans.catalog import ORACLES, query
from broadloom.sources.tables import table

NOW = "1998-06-15 12:00:00"


@query("schedule_listing", """
WITH grace(p, mins) AS (VALUES ('1-URGENT', 130), ('2-HIGH', 190), ('3-MEDIUM', 240)),
g AS (SELECT o.*, o_orderdate + to_minutes(CAST(coalesce(mins, 240) AS INTEGER)) AS ends FROM orders o LEFT JOIN grace ON p = o_orderpriority),
live AS (SELECT * FROM g WHERE ends >= TIMESTAMP '1998-06-15 12:00:00'),
m AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_returnflag, l_linestatus, l_linenumber, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem l),
c AS (SELECT l_orderkey, string_agg(p_name || '@' || s_name, ', ' ORDER BY l_returnflag, l_linestatus, l_linenumber, l_partkey) AS channels, count(*) AS n_channels
  FROM m JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE rn = 1 GROUP BY l_orderkey)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS starts, strftime(ends, '%Y-%m-%d %H:%M') AS ends, c_name AS home, n_name AS league,
  coalesce(channels, '') AS channels, coalesce(n_channels, 0) AS n_channels, o_orderdate <= TIMESTAMP '1998-06-15 12:00:00' AND TIMESTAMP '1998-06-15 12:00:00' < ends AS is_live
FROM live LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN c ON o_orderkey = l_orderkey""")
def schedule_listing(spark: SparkSession, d: str) -> DataFrame:
    """Games on now or later, each with its channels: live marks first, one per channel."""
    t = lambda n: table(spark, d, n)
    minutes = F.when(F.col("o_orderpriority") == "1-URGENT", 130).when(F.col("o_orderpriority") == "2-HIGH", 190).otherwise(240)
    games = t("orders").withColumn("ends_at", F.col("o_orderdate") + F.make_interval(mins=minutes)).filter(F.col("ends_at") >= F.lit(NOW).cast("timestamp_ntz"))
    marks = R.first_per(t("lineitem"), ["l_orderkey", "l_partkey"], [F.col(c) for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice")])
    marks = marks.join(games.select("o_orderkey"), marks["l_orderkey"] == games["o_orderkey"], "left_semi")
    named = marks.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    order = F.struct("l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", F.concat("p_name", F.lit("@"), "s_name").alias("label"))
    channels = named.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["label"]), ", ").alias("channels"), F.count("*").alias("n_channels"))
    out = games.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(channels, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    now = F.lit(NOW).cast("timestamp_ntz")
    return out.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("starts"), F.date_format("ends_at", "yyyy-MM-dd HH:mm").alias("ends"), F.col("c_name").alias("home"), F.col("n_name").alias("league"),
        F.coalesce("channels", F.lit("")).alias("channels"), F.coalesce("n_channels", F.lit(0)).alias("n_channels"), ((F.col("o_orderdate") <= now) & (now < F.col("ends_at"))).alias("is_live"),
    )


@query("marks_first_per_channel", """
SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def marks_first_per_channel(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return R.first_per(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], order).select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"))


@query("site_day_counts", "SELECT l_suppkey AS site, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS rows_n, count(DISTINCT l_orderkey) AS games FROM lineitem GROUP BY 1, 2")
def site_day_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows_n"), F.countDistinct("l_orderkey").alias("games"))


@query("channel_games", "SELECT l_suppkey AS site, l_partkey AS channel, count(DISTINCT l_orderkey) AS games FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 2")
def channel_games(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("channel")).agg(F.countDistinct("l_orderkey").alias("games")).filter("games >= 2")


@query("channel_sources_listagg", """
SELECT p_partkey, p_name, count(DISTINCT s_suppkey) AS n, coalesce(string_agg(DISTINCT s_name, ',' ORDER BY s_name), '') AS sources
FROM part LEFT JOIN lineitem ON p_partkey = l_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def channel_sources_listagg(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lists = pairs.groupBy("l_partkey").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("s_name")), ",").alias("sources"))
    out = table(spark, d, "part").join(lists, F.col("p_partkey") == F.col("l_partkey"), "left")
    return out.select("p_partkey", "p_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sources", F.lit("")).alias("sources"))


@query("included_exists_or", """
SELECT p_partkey, p_name FROM part p WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)
  OR EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_acctbal < 0)""")
def included_exists_or(spark: SparkSession, d: str) -> DataFrame:
    """EXISTS or EXISTS as two flag sets joined to the channels, not one disjunctive join."""
    li = table(spark, d, "lineitem")
    own = li.filter("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey")
    grid = li.join(table(spark, d, "supplier").filter("s_acctbal < 0"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey")
    return table(spark, d, "part").join(own.union(grid), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query("two_side_membership", """
WITH g AS (SELECT DISTINCT l_orderkey, s_nationkey AS home, c_nationkey AS away FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT n_name, count(*) AS games FROM g JOIN nation ON n_nationkey = home OR n_nationkey = away GROUP BY n_name""")
def two_side_membership(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("home")).distinct()
    games = li.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    games = games.select("l_orderkey", "home", F.col("c_nationkey").alias("away"))
    sides = R.two_sided(games, "home", "away", "team").groupBy("team").agg(F.count("*").alias("games"))
    return sides.join(table(spark, d, "nation"), F.col("team") == F.col("n_nationkey")).select("n_name", "games")


@query("union_distinct", "SELECT lower(c_mktsegment) AS alias FROM customer UNION SELECT lower(p_type) FROM part UNION SELECT lower(n_name) FROM nation")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    cols = (("customer", "c_mktsegment"), ("part", "p_type"), ("nation", "n_name"))
    a, b, c = (table(spark, d, t).select(F.lower(x).alias("alias")) for t, x in cols)
    return a.union(b).union(c).distinct()


@query("set_difference", "SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    closed, urgent = o.filter("o_orderstatus = 'F'"), o.filter("o_orderpriority = '1-URGENT'")
    return closed.select(F.col("o_custkey").alias("custkey")).subtract(urgent.select("o_custkey"))


@query("set_intersection", "SELECT l_suppkey AS site FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 50")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter("l_quantity >= 50")
    return li.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("site")).intersect(li.filter("l_returnflag = 'A'").select("l_suppkey"))


MERGE_SQL = """
WITH o AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), n AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.v, o.v) AS v, CASE WHEN n.v IS NULL THEN 'old' WHEN o.v IS NULL THEN 'new' WHEN o.v = n.v THEN 'same' ELSE 'changed' END AS state
FROM o FULL JOIN n ON o.o_custkey = n.o_custkey"""


@query("full_outer_merge", MERGE_SQL)
def full_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    old = o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("o_custkey").agg(F.max("o_orderkey").alias("v"))
    new = o.filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("v"))
    return R.merge_lists(old, new, ["o_custkey"], "v")


@query("paging_total", """
WITH f AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' AND o_orderstatus = 'F' AND o_totalprice > 1000),
p AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM f ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100)
SELECT p.*, (SELECT count(*) FROM f) AS total FROM p""")
def paging_total(spark: SparkSession, d: str) -> DataFrame:
    """A page of a filtered listing with the total: the page limit is the feature."""
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    f = table(spark, d, "orders").filter((F.col("o_orderdate") >= day("1996-01-01")) & (F.col("o_orderdate") < day("1999-01-01")) & (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000))
    page = R.page_of(f, [F.col("o_orderdate"), F.col("o_orderkey")], 100, 50)
    return page.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).crossJoin(F.broadcast(f.agg(F.count("*").alias("total"))))


@query("contested_names", "SELECT p_name, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS kinds FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1")
def contested_names(spark: SparkSession, d: str) -> DataFrame:
    return R.conflicting_keys(table(spark, d, "part"), "p_name", "p_type", "kinds").withColumn("kinds", F.array_join("kinds", "|"))


@query("listing_order", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderdate, o_orderkey) AS pos FROM orders""")
def listing_order(spark: SparkSession, d: str) -> DataFrame:
    """Multi-key order with a condition as the first key, numbered within each listing."""
    from pyspark.sql import Window

    listing = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") == "F", "o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(listing).cast("long").alias("pos"))


@query("latest_rows", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(100)


@query("share_by_site", """
SELECT l_suppkey AS site, count(*) AS rows_n, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) * 100 // count(*) AS percent FROM lineitem GROUP BY 1 HAVING count(*) >= 10 AND sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) * 10 >= 3 * count(*)""")
def share_by_site(spark: SparkSession, d: str) -> DataFrame:
    """Sites with enough rows of which a share is of one kind."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(F.count("*").alias("rows_n"), F.sum(F.when(F.col("l_returnflag") == "N", 1).otherwise(0)).alias("k"))
    return g.filter("rows_n >= 10 AND k * 10 >= 3 * rows_n").select("site", "rows_n", F.expr("k * 100 div rows_n").cast("long").alias("percent"))


@query("table_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("orders", "lineitem", "events", "pages")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("stamp_totals", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0)::BIGINT AS finished, coalesce(strftime(max(o_orderdate), '%Y-%m-%d'), '') AS last_day FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def stamp_totals(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("finished"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"))
    out = table(spark, d, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("finished", F.lit(0)).alias("finished"), F.coalesce("last_day", F.lit("")).alias("last_day"))
