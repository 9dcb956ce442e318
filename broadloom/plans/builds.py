"""Differences of two builds of the orders as a listing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators import builds as B
from broadloom.plans.catalog import query
from broadloom.sources.shared import materialize
from broadloom.sources.tables import table

BUILD_SQL = """
WITH c AS (SELECT l_orderkey AS k, list_distinct(list('ch' || (l_suppkey % 15))) AS ch FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, 'pair' || (o_custkey % 700) AS pair, epoch_us(o_orderdate) // 1000000 + o_orderkey % 12 * 7200 AS t, coalesce(ch, []) AS ch, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders LEFT JOIN c ON o_orderkey = c.k),
old AS (SELECT k AS old_id, pair, t, ch, CASE WHEN k % 13 <> 2 THEN t + 5400 END AS rt, status, priority, price FROM o),
new AS (SELECT k + 1000000 AS new_id, CASE WHEN k % 13 = 3 THEN 'other' || k ELSE pair END AS pair, CASE WHEN k % 13 = 4 THEN t + 300 WHEN k % 13 IN (2, 5) THEN t + 3600 ELSE t END AS t, CASE WHEN k % 13 = 6 THEN list_concat(ch, ['ch0', 'ch1', 'ch2', 'ch3', 'ch4']) ELSE ch END AS ch,
  CASE WHEN k % 13 = 7 THEN 'X' ELSE status END AS status, CASE WHEN k % 13 IN (7, 8) THEN NULL ELSE priority END AS priority, price FROM o WHERE k % 13 NOT IN (9, 10, 11))"""


def _builds(spark, d, kept=lambda df: df):
    t = lambda n: table(spark, d, n)
    channels = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.concat(F.lit("ch"), (F.col("l_suppkey") % 15).cast("string"))).alias("ch"))
    none = F.array().cast("array<string>")
    k = F.col("k")
    o = kept(t("orders").withColumn("k", F.col("o_orderkey")).join(channels, "k", "left").select(
        "k", F.concat(F.lit("pair"), (F.col("o_custkey") % 700).cast("string")).alias("pair"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 12 * 7200).alias("t"),
        F.coalesce("ch", none).alias("channels"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"),
    ))
    at = F.timestamp_seconds
    m = k % 13
    old = o.select(k.alias("old_id"), "pair", at("t").alias("start"), "channels", F.when(m != 2, at(F.col("t") + 5400)).alias("ref_start"), "status", "priority", "price")
    start = F.when(m == 4, F.col("t") + 300).when(m.isin(2, 5), F.col("t") + 3600).otherwise(F.col("t"))
    more = F.array(*(F.lit(f"ch{i}") for i in range(5)))
    new = o.filter(~m.isin(9, 10, 11)).select(
        (k + 1000000).alias("new_id"), F.when(m == 3, F.concat(F.lit("other"), k.cast("string"))).otherwise(F.col("pair")).alias("pair"), at(start).alias("start"), F.when(m == 6, F.concat("channels", more)).otherwise(F.col("channels")).alias("channels"),
        F.when(m == 7, "X").otherwise(F.col("status")).alias("status"), F.when(~m.isin(7, 8), F.col("priority")).alias("priority"), "price",
    )
    return old, new


MET_SQL = """SELECT old_id, new_id, max(p) AS same_pair, sum(c) AS common, any_value(abs(nt - ot)) AS gap, any_value(nt) AS nt, any_value(ot) AS ot FROM (
 SELECT old_id, new_id, 1 AS p, 0 AS c, o.t AS ot, n.t AS nt FROM {o} o JOIN {n} n ON o.pair = n.pair AND abs(n.t - o.t) <= 10800
 UNION ALL SELECT old_id, new_id, 0, 1, o.t, n.t FROM (SELECT old_id, t, unnest(list_distinct(ch)) AS c FROM {o}) o JOIN (SELECT new_id, t, unnest(list_distinct(ch)) AS c FROM {n}) n ON o.c = n.c AND abs(n.t - o.t) <= 10800) GROUP BY 1, 2"""

FATES_SQL = BUILD_SQL + f""",
nk AS (SELECT *, row_number() OVER (PARTITION BY pair, t ORDER BY new_id) AS rn FROM new), ok AS (SELECT *, row_number() OVER (PARTITION BY pair, t ORDER BY old_id) AS rn FROM old),
kept AS (SELECT old_id, new_id, list_filter([CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.priority IS DISTINCT FROM b.priority THEN 'priority' END, CASE WHEN a.price IS DISTINCT FROM b.price THEN 'price' END], lambda x: x IS NOT NULL) AS fields FROM ok a JOIN nk b ON a.pair = b.pair AND a.t = b.t AND a.rn = 1 AND b.rn = 1),
lf AS (SELECT * FROM old WHERE old_id NOT IN (SELECT old_id FROM kept)), fr AS (SELECT * FROM new WHERE new_id NOT IN (SELECT new_id FROM kept)),
met AS ({MET_SQL.format(o="lf", n="fr")}), mt AS (SELECT met.*, len(ch) AS n, rt FROM met JOIN lf USING (old_id)),
nr AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY gap, new_id) AS a, row_number() OVER (PARTITION BY new_id ORDER BY gap, old_id) AS b FROM mt WHERE gap <= 600 AND (same_pair = 1 OR 2 * common > n)), renamed AS (SELECT old_id, new_id FROM nr WHERE a = 1 AND b = 1),
cl AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY gap, new_id) AS a, row_number() OVER (PARTITION BY new_id ORDER BY gap, old_id) AS b FROM mt WHERE same_pair = 1 AND abs(nt - rt) < abs(ot - rt) AND old_id NOT IN (SELECT old_id FROM renamed) AND new_id NOT IN (SELECT new_id FROM renamed)), retimed AS (SELECT old_id, new_id FROM cl WHERE a = 1 AND b = 1),
rs AS (SELECT * FROM lf WHERE old_id NOT IN (SELECT old_id FROM renamed UNION SELECT old_id FROM retimed)), hs AS (SELECT * FROM new WHERE new_id IN (SELECT new_id FROM kept UNION SELECT new_id FROM renamed UNION SELECT new_id FROM retimed)),
h0 AS ({MET_SQL.format(o="rs", n="hs")}), ab AS (SELECT old_id, arg_min(new_id, (gap, new_id)) AS new_id FROM h0 JOIN rs USING (old_id) WHERE same_pair = 1 OR len(ch) > 0 AND common = len(ch) GROUP BY 1),
gone AS (SELECT * FROM rs WHERE old_id NOT IN (SELECT old_id FROM ab)), bad AS (SELECT DISTINCT old_id FROM (SELECT old_id, unnest(ch) AS c FROM gone) WHERE c NOT IN ('ch1', 'ch2', 'ch3', 'ch4', 'ch5', 'ch6', 'ch7')),
f AS (SELECT old_id, CASE WHEN len(fields) = 0 THEN 'same' ELSE 'changed' END AS fate, new_id, array_to_string(fields, ',') AS fields FROM kept UNION ALL SELECT old_id, 'renamed', new_id, '' FROM renamed UNION ALL SELECT old_id, 'retimed', new_id, '' FROM retimed UNION ALL SELECT old_id, 'absorbed', new_id, '' FROM ab
  UNION ALL SELECT old_id, CASE WHEN len(ch) = 0 OR old_id IN (SELECT old_id FROM bad) THEN 'lost' ELSE 'explained' END, NULL, '' FROM gone)"""


@query("build_fates", FATES_SQL + " SELECT f.old_id, fate, f.new_id, fields, array_to_string(list_sort(list_filter(old.ch, lambda x: NOT list_contains(coalesce(new.ch, []), x))), ',') AS missing FROM f JOIN old ON f.old_id = old.old_id LEFT JOIN new ON f.new_id = new.new_id")
def build_fates(spark: SparkSession, d: str) -> DataFrame:
    old, new = _builds(spark, d, materialize)  # both are read several times
    cases = spark.range(1, 8).select(F.concat(F.lit("ch"), F.col("id").cast("string")).alias("channel"))
    out = B.fates(old, new, cases, ["status", "priority", "price"])
    return out.select("old_id", "fate", "new_id", F.array_join("fields", ",").alias("fields"), F.array_join("missing", ",").alias("missing"))


@query("record_diff", BUILD_SQL + """,
b AS (SELECT old_id, new_id - 1000000 AS nid, a.pair AS p1, b.pair AS p2, a.t AS t1, b.t AS t2, a.status AS s1, b.status AS s2, a.priority AS r1, b.priority AS r2 FROM (SELECT * FROM old WHERE old_id % 17 <> 0) a FULL JOIN new b ON a.old_id = b.new_id - 1000000)
SELECT coalesce(old_id, nid) AS game, CASE WHEN old_id IS NULL THEN 'added' WHEN nid IS NULL THEN 'gone' WHEN fields = '' THEN 'same' ELSE 'changed' END AS state, CASE WHEN old_id IS NULL OR nid IS NULL THEN '' ELSE fields END AS fields
FROM (SELECT *, array_to_string(list_filter([CASE WHEN p1 IS DISTINCT FROM p2 THEN 'pair' END, CASE WHEN t1 IS DISTINCT FROM t2 THEN 'start' END, CASE WHEN s1 IS DISTINCT FROM s2 THEN 'status' END, CASE WHEN r1 IS DISTINCT FROM r2 THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS fields FROM b)""")
def record_diff(spark: SparkSession, d: str) -> DataFrame:
    """All fields of each record compared, by id."""
    old, new = _builds(spark, d)
    fields = ["pair", "start", "status", "priority"]
    a = old.filter("old_id % 17 <> 0").select(F.col("old_id").alias("game"), *fields)
    out = B.record_diff(a, new.select((F.col("new_id") - 1000000).alias("game"), *fields), ["game"])
    return out.select("game", "state", F.array_join("fields", ",").alias("fields"))


@query("title_twins", """
WITH o AS (SELECT o_orderkey AS k, o_orderdate AS start FROM orders), m AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 6 AS channel FROM lineitem),
s AS (SELECT k AS into_, start FROM o WHERE k % 3 = 0), t AS (SELECT k AS twin, start FROM o WHERE k % 3 <> 0), p AS (SELECT twin, into_ FROM t JOIN s USING (start)),
c AS (SELECT twin, into_, count(*) AS c FROM p JOIN m ON m.k = twin JOIN m x ON x.k = into_ AND x.channel = m.channel GROUP BY 1, 2), n AS (SELECT k, count(*) AS n FROM m GROUP BY 1)
SELECT twin, min(into_) AS into FROM c JOIN n ON n.k = twin AND c = n GROUP BY 1""")
def title_twins(spark: SparkSession, d: str) -> DataFrame:
    from broadloom.operators.games import title_twins as twins

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("start"))
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 6).alias("channel"))
    named = lambda df, name: df.withColumnRenamed("k", name)
    return twins(named(o.filter("k % 3 = 0"), "into"), named(o.filter("k % 3 <> 0"), "twin"), named(m, "twin"), named(m, "into"))


@query("silent_watchers", """
WITH w AS (SELECT DISTINCT user_id AS name, 60 * (user_id % 50) AS most FROM events), b AS (SELECT user_id AS name, max(epoch_us(ts) // 1000000) AS at FROM events WHERE event_type = 'purchase' AND user_id % 4 > 0 GROUP BY 1),
f AS (SELECT user_id AS name, min(epoch_us(ts) // 1000000) AS at FROM events WHERE user_id % 8 = 0 GROUP BY 1), z AS (SELECT max(epoch_us(ts) // 1000000) AS now FROM events)
SELECT w.name, least(coalesce((now - coalesce(b.at, f.at)) // 60, 0), 20000) AS minutes, b.at IS NOT NULL AS seen, least(coalesce((now - coalesce(b.at, f.at)) // 60, 0), 20000) > most AS silent FROM w LEFT JOIN b USING (name) LEFT JOIN f USING (name), z""")
def silent_watchers(spark: SparkSession, d: str) -> DataFrame:
    """Visitors as watchers, purchases as beats; asked at the end of the log."""
    from broadloom.operators.audit import silent_watchers as report

    e = table(spark, d, "events").select(F.col("user_id").alias("name"), "ts", "event_type")
    limits = e.select("name", (60 * (F.col("name") % 50)).alias("most")).distinct().crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    beats = e.filter("event_type = 'purchase' AND name % 4 > 0").select("name", F.col("ts").alias("at"))
    return report(limits, beats, e.filter("name % 8 = 0").select("name", F.col("ts").alias("first_at")), F.col("now"), F.lit(20000))
