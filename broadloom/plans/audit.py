"""Audit queries on the driver tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators import audit as A
from broadloom.operators.intervals import nearest, within
from broadloom.plans.catalog import ORACLES, query
from broadloom.sources.tables import table


@query("audit_two_times", "SELECT l_orderkey % 3000 AS fs_id, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_values, strftime(min(l_shipdate), '%Y-%m-%d') AS low, strftime(max(l_shipdate), '%Y-%m-%d') AS high FROM lineitem GROUP BY 1 HAVING count(DISTINCT CAST(l_shipdate AS DATE)) > 1")
def audit_two_times(spark: SparkSession, d: str) -> DataFrame:
    return A.two_values(table(spark, d, "lineitem").select((F.col("l_orderkey") % 3000).alias("fs_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")), "fs_id", "day")


def _per_site(spark, d, where):
    return table(spark, d, "lineitem").filter(where).groupBy(F.col("l_suppkey").alias("site")).agg(F.count("*").alias("n"))


@query("audit_dropped_sites", """
WITH b AS (SELECT l_suppkey AS site, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), n AS (SELECT l_suppkey AS site, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 12 GROUP BY 1)
SELECT b.site, b.n AS n_before, coalesce(n.n, 0) AS n_now FROM b LEFT JOIN n ON b.site = n.site WHERE coalesce(n.n, 0) < 0.2 * b.n""")
def audit_dropped_sites(spark: SparkSession, d: str) -> DataFrame:
    return A.dropped_sites(_per_site(spark, d, "l_returnflag = 'R' AND l_quantity < 12"), _per_site(spark, d, "l_returnflag = 'A'"), "site", "n", share=0.2)


@query("audit_too_few", """
WITH a AS (SELECT l_suppkey AS site, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_suppkey AS site, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey % 3 <> 0 GROUP BY 1)
SELECT coalesce(a.site, b.site) AS site, coalesce(a.n, 0) AS n_now, coalesce(b.n, 0) AS n_before FROM a FULL JOIN b ON a.site = b.site WHERE coalesce(a.n, 0) < greatest(300, coalesce(b.n, 0) / 2)""")
def audit_too_few(spark: SparkSession, d: str) -> DataFrame:
    return A.too_few(_per_site(spark, d, "l_linestatus = 'O'"), _per_site(spark, d, "l_linestatus = 'F' AND l_suppkey % 3 <> 0"), "site", "n", floor=300)


@query("audit_vanished", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)")
def audit_vanished(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), table(spark, d, "orders")
    return A.vanished(o.filter("o_orderstatus = 'P'"), [li.filter("l_returnflag = 'R'"), li.filter("l_quantity > 40"), o.filter("o_totalprice > 300000")], ["o_orderkey"]).select("o_orderkey")


@query("audit_clock_back", """
WITH e AS (SELECT user_id, event_id, epoch(ts) - CASE WHEN event_id % 9 = 0 THEN 800000 ELSE 0 END AS moment FROM events),
l AS (SELECT user_id, lag(moment) OVER (PARTITION BY user_id ORDER BY event_id) - moment AS back FROM e)
SELECT user_id, CAST(sum(CASE WHEN back > 7200 THEN 1 ELSE 0 END) AS BIGINT) AS n_back FROM l GROUP BY 1 HAVING sum(CASE WHEN back > 7200 THEN 1 ELSE 0 END) > 0""")
def audit_clock_back(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - F.when(F.col("event_id") % 9 == 0, 800000).otherwise(0)
    return A.clock_goes_back(table(spark, d, "events"), "user_id", "event_id", at)


@query("audit_zone_offsets", """
WITH p AS (SELECT s.user_id % 60 AS site, s.event_id, (epoch_us(c.ts) - epoch_us(s.ts)) / 60000000.0 AS gap, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(epoch_us(c.ts) - epoch_us(s.ts)), c.event_id) AS rn
  FROM events s JOIN events c ON s.user_id = c.user_id AND c.event_type = 'view' AND abs(epoch_us(c.ts) - epoch_us(s.ts)) <= 64800000000 WHERE s.event_type = 'signup'),
r AS (SELECT site, CAST(round(gap / 60) AS INTEGER) AS off, abs(gap - 60 * round(gap / 60)) <= 5 AS exact FROM p WHERE rn = 1), t AS (SELECT site, count(*) AS total FROM r GROUP BY 1),
c AS (SELECT site, off, count(*) AS n FROM r WHERE exact GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, off) AS rn FROM c)
SELECT b.site, b.off AS "offset", b.n, t.total FROM b JOIN t ON b.site = t.site WHERE rn = 1 AND b.off <> 0 AND b.n >= 2 AND b.n >= 0.05 * t.total""")
def audit_zone_offsets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    side = lambda kind, p: e.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts"))
    pairs = within(side("signup", "s"), side("view", "c"), ["user_id"], "s_ts", "c_ts", -64800, 64800)
    gap = (F.unix_micros(F.col("c_ts").cast("timestamp")) - F.unix_micros(F.col("s_ts").cast("timestamp"))) / 60_000_000
    best = nearest(pairs, "s_id", gap, "c_id").withColumn("site", F.col("user_id") % 60).withColumn("gap", gap)
    return A.zone_offsets(best, "site", F.col("gap"), least=2, share=0.05)


@query("audit_mass_failure", """
WITH p AS (SELECT user_id, bool_and(event_type <> 'purchase' OR user_id % 3 = 0) AS all_failed FROM events GROUP BY 1)
SELECT count(*) AS sites, CAST(sum(CASE WHEN all_failed THEN 1 ELSE 0 END) AS BIGINT) AS failed, count(*) >= 10 AND sum(CASE WHEN all_failed THEN 1 ELSE 0 END) > 0.2 * count(*) AS is_mass FROM p""")
def audit_mass_failure(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("failed", (F.col("event_type") != "purchase") | (F.col("user_id") % 3 == 0))
    return A.mass_failure(e, "user_id", "failed")


@query("audit_evidence", "SELECT p_name, count(*) AS seen, count(DISTINCT p_brand) AS n_beside, array_to_string(list_slice(list_sort(list(DISTINCT p_brand)), 1, 4), ',') AS beside FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def audit_evidence(spark: SparkSession, d: str) -> DataFrame:
    return A.evidence(table(spark, d, "part"), ["p_name"], "p_brand", cap=4)


@query("audit_empty_twins", "SELECT p_partkey FROM part p WHERE (SELECT count(*) FROM part q WHERE q.p_name = p.p_name AND q.p_type = p.p_type) > 1 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def audit_empty_twins(spark: SparkSession, d: str) -> DataFrame:
    return A.empty_twins(table(spark, d, "part"), table(spark, d, "lineitem").filter("l_quantity > 49"), ["p_name", "p_type"], "p_partkey", "l_partkey").select("p_partkey")


@query("audit_first_language", "WITH f AS (SELECT c_nationkey % 7 AS name, c_mktsegment AS lang, row_number() OVER (PARTITION BY c_nationkey % 7 ORDER BY c_custkey) AS rn FROM customer) SELECT lang, count(*) AS fresh FROM f WHERE rn = 1 GROUP BY 1")
def audit_first_language(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select((F.col("c_nationkey") % 7).alias("name"), F.col("c_mktsegment").alias("lang"), "c_custkey")
    return A.first_language(c, "name", "lang", "c_custkey")


@query("audit_single_valued", "SELECT k, min(v) AS v FROM (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer) GROUP BY 1 HAVING count(DISTINCT v) = 1")
def audit_single_valued(spark: SparkSession, d: str) -> DataFrame:
    f = lambda t, n, k: table(spark, d, t).select(F.col(k).alias("k"), F.col(n).alias("v"))
    return A.single_valued(f("supplier", "s_nationkey", "s_suppkey"), f("customer", "c_nationkey", "c_custkey"), "k", "v")
