"""Mutation queries: orders before a day are the stored table, others the incoming file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators import store as S
from broadloom.plans.catalog import query
from broadloom.sources.tables import table


def _split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    stored = o.filter("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))
    incoming = o.filter("o_orderkey % 2 = 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("!"), F.col("o_orderpriority"))))
    return stored.drop("o_orderdate"), incoming.drop("o_orderdate"), o


SPLIT_SQL = """
WITH st AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0),
inc AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '!' || o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)
"""


@query("upsert_merge", SPLIT_SQL + """
SELECT coalesce(st.o_orderkey, inc.o_orderkey) AS o_orderkey, coalesce(inc.o_custkey, st.o_custkey) AS o_custkey, coalesce(inc.o_orderstatus, st.o_orderstatus) AS o_orderstatus,
  CASE WHEN st.o_orderkey IS NULL THEN inc.o_orderpriority ELSE coalesce(nullif(inc.o_orderpriority, ''), st.o_orderpriority) END AS o_orderpriority,
  CASE WHEN st.o_orderkey IS NULL THEN 'added' WHEN inc.o_orderkey IS NULL THEN 'kept' WHEN inc.o_orderstatus = st.o_orderstatus AND coalesce(nullif(inc.o_orderpriority, ''), st.o_orderpriority) = st.o_orderpriority THEN 'same' ELSE 'updated' END AS change
FROM st FULL JOIN inc ON st.o_orderkey = inc.o_orderkey""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming, _ = _split(spark, d)
    return S.upsert(stored, incoming, ["o_orderkey"], {"o_orderpriority": S.keep_if_empty})


@query("insert_only", SPLIT_SQL + "SELECT * FROM st UNION ALL SELECT * FROM inc WHERE o_orderkey NOT IN (SELECT o_orderkey FROM st)")
def insert_only(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming, _ = _split(spark, d)
    return S.insert_only(stored, incoming, ["o_orderkey"], [F.col("o_custkey")])


@query("orphans", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate >= TIMESTAMP '2000-01-01' AND NOT (o_orderkey % 2 = 0)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    _, incoming, o = _split(spark, d)
    return S.orphans(o.filter("o_orderkey % 3 <> 0"), incoming, ["o_orderkey"], F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("match_cascade", """
WITH i AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), s AS (SELECT s_suppkey, s_nationkey FROM supplier),
a AS (SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM i JOIN s ON c_custkey = s_suppkey * 3 GROUP BY 1),
b AS (SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM i JOIN s ON c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10 WHERE c_custkey NOT IN (SELECT c_custkey FROM a) GROUP BY 1)
SELECT i.c_custkey, coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.c_custkey IS NOT NULL THEN 'id' WHEN b.c_custkey IS NOT NULL THEN 'place' END AS stage
FROM i LEFT JOIN a ON i.c_custkey = a.c_custkey LEFT JOIN b ON i.c_custkey = b.c_custkey""")
def match_cascade(spark: SparkSession, d: str) -> DataFrame:
    by_id = lambda i, s: i.join(s, F.col("c_custkey") == F.col("s_suppkey") * 3).select("c_custkey", "s_suppkey")
    place = lambda i, s: i.join(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_custkey") % 10 == F.col("s_suppkey") % 10)).select("c_custkey", "s_suppkey")
    return S.match_cascade(table(spark, d, "customer"), table(spark, d, "supplier"), "c_custkey", "s_suppkey", [("id", by_id), ("place", place)])


@query("moved_detection", """
WITH v AS (SELECT l_orderkey, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, strftime(max(CASE WHEN rn = n THEN l_shipdate END), '%Y-%m-%d') AS now_at, strftime(CASE WHEN abs(epoch(max(CASE WHEN rn = n THEN l_shipdate END)) - epoch(max(CASE WHEN rn = 1 THEN l_shipdate END))) >= 3600 * 2400 THEN max(CASE WHEN rn = 1 THEN l_shipdate END) END, '%Y-%m-%d') AS moved_from FROM v GROUP BY 1""")
def moved_detection(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")]
    out = S.moved(table(spark, d, "lineitem"), "l_orderkey", "l_shipdate", order, least_hours=2400)
    return out.select("l_orderkey", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("now_at", "moved_from")))


@query("streak_state", """
WITH x AS (SELECT u.user_id, x.day FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) x),
e AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT x.*, n IS NULL OR n < 2 AS silent, (x.user_id + extract(day FROM x.day)) % 6 <> 0 AS was_read FROM x LEFT JOIN e ON x.user_id = e.user_id AND x.day = e.day),
g AS (SELECT *, sum(CASE WHEN was_read AND NOT silent THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CAST(sum(CASE WHEN was_read AND silent THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g""")
def streak_state(spark: SparkSession, d: str) -> DataFrame:
    return S.streaks(silent_days(spark, d), "user_id", "day", "silent", "was_read").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "streak")


def silent_days(spark: SparkSession, d: str) -> DataFrame:
    """Every visitor on every day of the log: silent below two events, not read by a rule."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    every = e.select("user_id").distinct().crossJoin(F.broadcast(e.select("day").distinct()))  # a calendar of days
    n = e.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return every.join(n, ["user_id", "day"], "left").withColumn("silent", F.col("n").isNull() | (F.col("n") < 2)).withColumn("was_read", (F.col("user_id") + F.dayofmonth("day")) % 6 != 0)


POINTER_SQL = """
WITH RECURSIVE p AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 4 <> 0 AND p_partkey >= 4 THEN p_partkey - p_partkey % 4 ELSE CASE WHEN p_partkey % 16 = 4 AND p_partkey > 4 THEN p_partkey - 4 END END AS up FROM part),
r(node, at_node) AS (SELECT node, node FROM p UNION ALL SELECT r.node, p.up FROM r JOIN p ON r.at_node = p.node WHERE p.up IS NOT NULL),
s AS (SELECT node, min(at_node) AS survivor FROM r GROUP BY node)
"""


def _survivors(spark, d):
    k = F.col("p_partkey")
    up = F.when((k % 4 != 0) & (k >= 4), k - k % 4).when((k % 16 == 4) & (k > 4), k - 4)
    return S.survivors(table(spark, d, "part").select(k.alias("node"), up.alias("up")), "node", "up")


@query("pointer_chase", POINTER_SQL + "SELECT node, survivor FROM s")
def pointer_chase(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d)


@query("repointed_children", POINTER_SQL + """, c AS (SELECT l_orderkey, survivor AS l_partkey, l_suppkey, l_linenumber, l_shipdate FROM lineitem JOIN s ON l_partkey = node)
SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_shipdate) AS rn FROM c) WHERE rn = 1""")
def repointed_children(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_suppkey", "l_shipdate")]
    out = S.repointed(table(spark, d, "lineitem"), "l_partkey", _survivors(spark, d), ["l_orderkey", "l_partkey"], order)
    return out.select("l_orderkey", "l_partkey", "l_linenumber")


@query("ttl_purge", "SELECT o_orderkey FROM orders WHERE epoch(o_orderdate) + 60 * CASE o_orderpriority WHEN '1-URGENT' THEN 130 WHEN '2-HIGH' THEN 190 ELSE 240 END >= epoch(TIMESTAMP '1999-05-05 02:30:00')")
def ttl_purge(spark: SparkSession, d: str) -> DataFrame:
    minutes = F.when(F.col("o_orderpriority") == "1-URGENT", 130).when(F.col("o_orderpriority") == "2-HIGH", 190).otherwise(240)
    return S.alive(table(spark, d, "orders"), F.col("o_orderdate"), minutes, F.lit("1999-05-05 02:30:00").cast("timestamp_ntz")).select("o_orderkey")


@query("own_site_rows", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS official, l_quantity < 30 AS in_depth FROM lineitem),
h AS (SELECT *, bool_or(official) OVER (PARTITION BY l_partkey) AS has FROM r), k AS (SELECT *, official OR NOT (has AND in_depth) AS keep FROM h),
a AS (SELECT *, bool_or(keep) OVER (PARTITION BY l_partkey) AS any_kept FROM k)
SELECT l_partkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM a WHERE keep OR NOT any_kept GROUP BY 1""")
def own_site_rows(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").withColumn("official", F.col("l_returnflag") == "R").withColumn("in_depth", F.col("l_quantity") < 30)
    return S.own_site_rows(r, ["l_partkey"], "official", "in_depth").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))


@query("absent_proofs", """
WITH m AS (SELECT DISTINCT l_orderkey AS game, l_suppkey AS site, strftime(l_shipdate, '%Y-%m') AS day FROM lineitem),
seen AS (SELECT DISTINCT game, site FROM m WHERE game % 4 <> 0), cov AS (SELECT s_suppkey AS site, x.day FROM supplier, (SELECT DISTINCT day FROM m) x WHERE s_suppkey % 5 <> 0 AND (s_suppkey + CAST(substr(x.day, 6, 2) AS BIGINT)) % 3 <> 0),
g AS (SELECT m.site, m.day, count(*) AS live, count(seen.game) AS given FROM m LEFT JOIN seen ON m.game = seen.game AND m.site = seen.site GROUP BY 1, 2)
SELECT m.game, m.site, m.day FROM m JOIN cov ON m.site = cov.site AND m.day = cov.day JOIN g ON m.site = g.site AND m.day = g.day
WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.game = m.game AND seen.site = m.site) AND given > 0 AND given >= ceil(live * 0.5)""")
def absent_proofs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("site"), F.date_format("l_shipdate", "yyyy-MM").alias("day")).distinct()
    cov = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site")).crossJoin(F.broadcast(m.select("day").distinct()))
    cov = cov.select("site", "day", (F.col("site") % 5 != 0).alias("answered"), ((F.col("site") + F.substring("day", 6, 2).cast("long")) % 3 != 0).alias("intact"))
    return S.absent_proofs(m, m.filter("game % 4 <> 0"), cov, ["game"], "site", "day")


@query("alias_resolution", """
WITH al AS (SELECT lower(p_name) AS alias, 'en' AS lang, substr(p_type, 1, 1) AS sport, '' AS category, p_partkey AS team, p_brand AS club, false AS is_canonical FROM part),
ask AS (SELECT c_custkey, lower(p_name) AS alias, 'en' AS lang, substr(p_type, 1, 1) AS sport, '' AS category FROM customer JOIN part ON p_partkey = (c_custkey * 7) % (SELECT max(p_partkey) + 1 FROM part)),
c AS (SELECT ask.c_custkey, ask.sport AS asked, al.* FROM ask LEFT JOIN al USING (alias)),
n AS (SELECT *, bool_or(sport = asked) OVER (PARTITION BY c_custkey) AS any_sport FROM c), k AS (SELECT * FROM n WHERE NOT coalesce(any_sport, false) OR sport = asked)
SELECT c_custkey, CASE WHEN max(team) IS NULL THEN 'unknown' WHEN count(DISTINCT club) > 1 THEN 'disputed' WHEN count(DISTINCT sport) = 1 AND max(sport) <> max(asked) THEN 'other sport' ELSE 'found' END AS how,
  CASE WHEN count(DISTINCT club) = 1 AND max(sport) = max(asked) THEN max(team) END AS team FROM k GROUP BY 1""")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of all parts; customers ask for part keys from the whole range."""
    part, cust = table(spark, d, "part"), table(spark, d, "customer")
    named = lambda *extra: (F.col("p_name").alias("alias"), F.lit("en").alias("lang"), F.substring("p_type", 1, 1).alias("sport"), F.lit("").alias("category"), *extra)
    aliases = part.select(*named(F.col("p_partkey").alias("team"), F.col("p_brand").alias("club"), F.lit(False).alias("is_canonical")))
    slots = part.agg((F.max("p_partkey") + 1).alias("slots"))  # one row
    turned = cust.crossJoin(F.broadcast(slots)).select("c_custkey", (F.col("c_custkey") * 7 % F.col("slots")).alias("slot"))
    asked = turned.join(part, F.col("slot") == F.col("p_partkey")).select("c_custkey", *named())
    return S.alias_ladder(asked, aliases, "c_custkey")


QUARANTINE_SQL = """
WITH al AS (SELECT lower(p_name || ' ' || p_size % 9) AS alias, substr(p_type, 1, 1) AS sport, p_partkey AS team, p_brand AS club FROM part),
qu AS (SELECT alias, team FROM al JOIN part ON p_partkey = team WHERE p_size % 3 > 0)"""


def _quarantine(spark: SparkSession, d: str):
    alias = F.concat("p_name", F.lit(" "), (F.col("p_size") % 9).cast("string"))
    part = table(spark, d, "part").select("p_partkey", "p_size", alias.alias("alias"), F.lit("en").alias("lang"), F.substring("p_type", 1, 1).alias("sport"), F.lit("").alias("category"), F.col("p_partkey").alias("team"), F.col("p_brand").alias("club"), F.lit(False).alias("is_canonical"))
    return part, part.filter("p_size % 3 > 0").select(F.upper("alias").alias("alias"), "team")


@query("alias_quarantine", QUARANTINE_SQL + """,
ask AS (SELECT l_orderkey AS ask, l_linenumber AS line, alias, sport FROM lineitem JOIN al ON team = l_partkey), f AS (SELECT * FROM al WHERE team NOT IN (SELECT team FROM qu)),
c AS (SELECT ask, line, ask.sport AS asked, ask.alias AS said, f.* FROM ask LEFT JOIN f USING (alias)), n AS (SELECT *, bool_or(sport = asked) OVER (PARTITION BY ask, line, said, asked) AS any_sport FROM c), k AS (SELECT * FROM n WHERE NOT coalesce(any_sport, false) OR sport = asked),
h AS (SELECT ask, line, said, asked, CASE WHEN max(team) IS NULL THEN 'unknown' WHEN count(DISTINCT club) > 1 THEN 'disputed' WHEN count(DISTINCT sport) = 1 AND max(sport) <> asked THEN 'other sport' ELSE 'found' END AS how, max(team) AS team FROM k GROUP BY 1, 2, 3, 4)
SELECT DISTINCT said AS alias, asked AS sport, CASE WHEN how = 'unknown' AND said IN (SELECT alias FROM qu) THEN 'quarantine' ELSE how END AS how, CASE WHEN how = 'found' THEN team END AS team FROM h""")
def alias_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Every line asks for its part; two thirds of the aliases are in quarantine."""
    part, held = _quarantine(spark, d)
    asked = table(spark, d, "lineitem").join(part.select("p_partkey", "alias", "sport", "lang", "category"), F.col("l_partkey") == F.col("p_partkey")).select("alias", "sport", "lang", "category").distinct()
    asked = asked.withColumn("ask", F.struct("alias", "sport"))
    return S.guarded_ladder(asked, part, held, "ask").select(F.lower("ask.alias").alias("alias"), "ask.sport", "how", "team")


@query("lifted_aliases", QUARANTINE_SQL + """,
t AS (SELECT DISTINCT alias, team FROM lineitem JOIN al ON team = l_partkey WHERE l_orderkey % 40 = 0), r AS (SELECT qu.alias, qu.team, t.team IS NOT NULL AS told FROM qu LEFT JOIN t ON qu.alias = t.alias AND qu.team = t.team)
SELECT alias, team, CASE WHEN n <> 1 THEN 'held' WHEN told THEN 'lifted' ELSE 'dropped' END AS fate FROM (SELECT *, count(*) FILTER (told) OVER (PARTITION BY alias) AS n FROM r)""")
def lifted_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Some lines come with a match id, which tells whose the alias is."""
    part, held = _quarantine(spark, d)
    told = table(spark, d, "lineitem").filter("l_orderkey % 40 = 0").join(part, F.col("l_partkey") == F.col("team")).select("alias", "team")
    return S.lifted(held, told)
