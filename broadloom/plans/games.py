"""Queries on merged games, names and times over the order tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.functions import names as N
from broadloom.functions import text as X
from broadloom.functions import times as D
from broadloom.operators import games as G
from broadloom.operators.relational import ordered_distinct
from broadloom.plans.catalog import query
from broadloom.sources.files import purged
from broadloom.sources.tables import table


@query("bridge_pick", """
WITH c AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS cand, l_suppkey % 2 = 0 AS same, CAST(l_quantity * 2 AS INTEGER) AS score, CAST(l_partkey % 101 AS INTEGER) AS side FROM lineitem),
n AS (SELECT *, count(*) OVER g AS n, sum(CASE WHEN side >= 100 THEN 1 ELSE 0 END) OVER g AS perfect, sum(CASE WHEN side <= 75 THEN 1 ELSE 0 END) OVER g AS weak,
  score - coalesce(lead(score) OVER (PARTITION BY l_orderkey ORDER BY score DESC, cand), 0) AS lead, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, cand) AS rn, row_number() OVER (PARTITION BY l_orderkey ORDER BY side DESC, cand) AS rs
  FROM c WINDOW g AS (PARTITION BY l_orderkey)),
v AS (SELECT *, CASE WHEN n = 1 AND CASE WHEN same THEN score >= 45 ELSE score >= 40 OR side >= 75 END THEN 'sure' WHEN n = 1 THEN NULL WHEN perfect = 1 AND weak = n - 1 AND rs = 1 THEN 'sure'
  WHEN rn = 1 AND score >= CASE WHEN same THEN 40 ELSE 60 END AND lead >= 15 THEN CASE WHEN same AND lead >= 20 AND (score >= 70 OR (score >= 40 AND side >= 75)) THEN 'sure' ELSE 'ask' END END AS verdict FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY verdict = 'ask', rn) AS best FROM v WHERE verdict IS NOT NULL)
SELECT c.l_orderkey, p.cand, coalesce(p.verdict, 'none') AS verdict FROM (SELECT DISTINCT l_orderkey FROM c) c LEFT JOIN p ON c.l_orderkey = p.l_orderkey AND best = 1""")
def bridge_pick(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").withColumn("cand", F.col("l_linenumber") * F.lit(1000000).cast("long") + F.col("l_partkey"))
    return G.bridge_pick(c, "l_orderkey", F.col("l_suppkey") % 2 == 0, (F.col("l_quantity") * 2).cast("int"), (F.col("l_partkey") % 101).cast("int"), "cand")


@query("specific_league", r"""
WITH l AS (SELECT c_nationkey AS game, c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ': FOOTBALL' ELSE c_name END AS league FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY regexp_matches(league, '(?i):\s*(football|basketball|tennis)\s*$'), c_custkey) AS rn FROM l)
SELECT game, league FROM r WHERE rn = 1""")
def specific_league(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("game"), "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit(": FOOTBALL"))).otherwise(F.col("c_name")).alias("league"))
    return G.specific_league(c, "game", "league", "c_custkey")


@query("display_names")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("game"), F.col("p_name").alias("name"), "p_partkey")
    return G.display_name(p, "game", "name", "p_partkey")


@query("ordered_channels", """
WITH f AS (SELECT l_orderkey, l_suppkey, min((l_linenumber * 100000000 + l_partkey) * 10000 + l_suppkey) AS first_at FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY first_at) AS sites FROM f GROUP BY 1""")
def ordered_channels(spark: SparkSession, d: str) -> DataFrame:
    order = (F.col("l_linenumber") * F.lit(100000000).cast("long") + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(ordered_distinct(F.col("l_suppkey").cast("string"), order).alias("sites"))
    return g.withColumn("sites", F.array_join("sites", ","))


@query("fold_unreadable", """
WITH e AS (SELECT event_id, user_id, ts, event_id % 4 = 0 AS odd FROM events),
p AS (SELECT a.event_id AS game, b.event_id AS into_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.odd AND NOT b.odd AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000)
SELECT game, min(into_id) AS "into" FROM p GROUP BY game HAVING count(DISTINCT into_id) = 1""")
def fold_unreadable(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("game"), F.when(F.col("event_id") % 4 == 0, F.lit("דינמו קייב")).otherwise(F.col("event_type")).alias("name"))
    return G.fold_unreadable(e, "user_id", "ts", "game", "name", 7200)


@query("tie_members", """
WITH w AS (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS words, DATE '2024-01-01' + CAST(p_partkey % 6 AS INTEGER) AS day FROM part),
t AS (SELECT n_nationkey, list_distinct(string_split(p1.p_name || ' ' || p2.p_name, ' ')) AS words, DATE '2024-01-01' + CAST(n_nationkey % 3 AS INTEGER) AS day FROM nation JOIN part p1 ON p1.p_partkey = n_nationkey JOIN part p2 ON p2.p_partkey = n_nationkey + 30),
m AS (SELECT w.p_partkey, t.n_nationkey FROM w JOIN t ON list_has_all(t.words, w.words) AND w.day - t.day BETWEEN 0 AND 3)
SELECT p_partkey, min(n_nationkey) AS n_nationkey FROM m GROUP BY 1 HAVING count(DISTINCT n_nationkey) = 1""")
def tie_members(spark: SparkSession, d: str) -> DataFrame:
    part, nation = table(spark, d, "part"), table(spark, d, "nation")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    rows = part.select("p_partkey", F.array_distinct(F.split("p_name", " ")).alias("words"), day(F.col("p_partkey") % 6).alias("day"))
    one, two = part.select(F.col("p_partkey").alias("k1"), F.col("p_name").alias("n1")), part.select((F.col("p_partkey") - 30).alias("k2"), F.col("p_name").alias("n2"))
    ties = nation.join(one, F.col("k1") == F.col("n_nationkey")).join(two, F.col("k2") == F.col("n_nationkey"))
    ties = ties.select("n_nationkey", F.array_distinct(F.split(F.concat_ws(" ", "n1", "n2"), " ")).alias("tie_words"), day(F.col("n_nationkey") % 3).alias("tie_day"))
    return G.member_of_tie(rows, ties, "p_partkey", "words", "day", "n_nationkey", "tie_words", "tie_day")


@query("trimmed_by_reference", """
WITH n AS (SELECT DISTINCT p_name FROM part WHERE p_partkey % 3 = 0), s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Live ' || p_name ELSE 'Cup final ' || p_name END AS side, p_name FROM part)
SELECT p_partkey, p_name AS text, CAST(p_partkey % 3 AS INTEGER) AS cut FROM s WHERE p_partkey % 3 <> 0 AND p_name IN (SELECT p_name FROM n)""")
def trimmed_by_reference(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    part = table(spark, d, "part")
    rows = part.select("p_partkey", F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("Live "), "p_name")).otherwise(F.concat(F.lit("Cup final "), "p_name")).alias("side"))
    return G.trimmed_by_reference(rows, part.filter("p_partkey % 3 = 0"), "p_partkey", "side", "p_name")


@query("shifted_twins", """
SELECT a.event_id, b.event_id AS twin FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id
 AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 3600000000 AND 86400000000""")
def shifted_twins(spark: SparkSession, d: str) -> DataFrame:
    return G.shifted_twins(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id")


@query("retimed", """
WITH r AS (SELECT l_orderkey, max(l_shipdate) AS at FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1)
SELECT o_orderkey, strftime(coalesce(r.at, o_orderdate), '%Y-%m-%d') AS day, strftime(CASE WHEN r.at <> o_orderdate THEN o_orderdate END, '%Y-%m-%d') AS was FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""")
def retimed(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "lineitem").filter("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("o_orderdate"))
    out = G.retimed(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ref, "o_orderkey", "o_orderdate")
    return out.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("was", "yyyy-MM-dd").alias("was"))


@query("purged_log", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events GROUP BY 1 HAVING count(*) > 335) GROUP BY 1")
def purged_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    done = e.groupBy("day").agg(F.count("*").alias("n")).filter("n > 335")
    return purged(e, done, "day").groupBy("day").agg(F.count("*").alias("n"))


@query("broadcast_days", """
SELECT strftime(CASE WHEN extract(hour FROM ts) < 7 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1""")
def broadcast_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_format(D.tv_day(F.col("ts")), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("home_times", """
SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') AS local, strftime(ts, '%Y-%m-%d %H:%M') AS back FROM events""")
def home_times(spark: SparkSession, d: str) -> DataFrame:
    """January: two hours ahead; tests hold the days on which clocks change."""
    local = D.from_utc(F.col("ts"))
    return table(spark, d, "events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm").alias("local"), F.date_format(D.to_utc(local), "yyyy-MM-dd HH:mm").alias("back"))


@query("moments_of_any_form", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at_utc FROM events""")
def moments_of_any_form(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    form = F.when(k == 0, F.unix_seconds(at).cast("string")).when(k == 1, F.unix_millis(at).cast("string")).when(k == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("soon"))
    return table(spark, d, "events").select("event_id", F.date_format(D.moment(form), "yyyy-MM-dd HH:mm:ss").alias("at_utc"))


@query("odd_minute_records", """
SELECT a.event_id, extract(minute FROM a.ts) % 5 <> 0 AND NOT coalesce(floor(epoch(b.ts)) - floor(epoch(a.ts)) BETWEEN 0 AND 600, false) AS is_record FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1""")
def odd_minute_records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    nxt = e.select((F.col("event_id") - 1).alias("event_id"), F.col("ts").alias("kickoff"))
    return e.join(nxt, "event_id", "left").select("event_id", D.odd_minute_record(F.col("ts"), F.col("kickoff")).alias("is_record"))


@query("past_seasons", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS is_past FROM part""")
def past_seasons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    label = F.concat("p_name", F.when(k == 0, " 2019").when(k == 1, " 2023/24").when(k == 2, " 2021-2022").otherwise(" cup"))
    return table(spark, d, "part").select("p_partkey", D.past_season(label, F.lit("2024-03-01").cast("date")).alias("is_past"))


@query("freshness_badges", """
SELECT o_orderkey, epoch(o_orderdate) >= epoch(TIMESTAMP '1998-06-15 12:00:00') - 43200 AS is_new, epoch(ship) >= epoch(TIMESTAMP '1998-06-15 12:00:00') - 172800 AND epoch(ship) - epoch(o_orderdate) >= 10800 AS channel_is_new
FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def freshness_badges(spark: SparkSession, d: str) -> DataFrame:
    ship = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"))
    b = D.badges(F.lit("1998-06-15 12:00:00").cast("timestamp_ntz"), F.col("o_orderdate"), F.col("ship"))
    return table(spark, d, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", *(c.alias(n) for n, c in b.items()))


@query("unreadable_texts", r"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\pL')) AS letters, len(regexp_extract_all(text, '[\p{Latin}\p{Cyrillic}\p{Greek}]')) AS known FROM documents) SELECT doc_id, 2 * (letters - known) > letters AS is_unreadable FROM c""")
def unreadable_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.unreadable(F.col("text")).alias("is_unreadable"))


@query("channel_links", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'http://x.com/else' WHEN p_size % 5 = 1 THEN 'https://own.tv/1' ELSE 'http://x.com/ch/' || CAST(p_size % 5 AS VARCHAR) END AS url FROM part""")
def channel_links(spark: SparkSession, d: str) -> DataFrame:
    ids = F.create_map(*(F.lit(x) for x in ("k1", "https://own.tv/1", "k2", "2", "k3", "3", "k4", "4")))
    key = F.concat(F.lit("k"), (F.col("p_size") % 5).cast("string"))
    return table(spark, d, "part").select("p_partkey", X.link(F.lit("http://x.com/ch/{key}"), key, ids, F.lit("http://x.com/else")).alias("url"))


@query("best_local_spelling")
def best_local_spelling(spark: SparkSession, d: str) -> DataFrame:
    """The most alike nation name for every customer's market segment and nation."""
    n = table(spark, d, "nation")
    asked = table(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct().join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    local = n.select(F.col("n_name").alias("local"), F.col("n_regionkey").alias("r"))
    met = asked.join(local, F.col("n_regionkey") == F.col("r"))
    scored = met.select("c_mktsegment", "c_nationkey", "local", N.similarity(F.concat_ws(" ", "n_name"), F.col("local")).alias("score"))
    return scored.groupBy("c_mktsegment", "c_nationkey").agg(F.max_by("local", F.struct("score", "local")).alias("local"), F.max("score").alias("score"))
