"""Alignment queries: orders are the reference's matches, the same orders as a site shows them
are the games. Team names are made of the keys' digests, so every name is found and scored."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators import alignment as A
from broadloom.plans.catalog import query
from broadloom.sources.shared import materialize
from broadloom.sources.tables import table

LETTERS = ("0123456789abcdef", "aeioubdfgklmnprt")

#: A match's sides; a site writes one team in four as the reference does, one with another
#: letter, two in words of its own; some pairs turned, some with the match's id, some without
#: a league, some with a wrong opponent.
SIDES_SQL = """
WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_custkey % 300 AS h, 300 + o_orderkey * 7 % 300 AS a, substr(o_orderpriority, 1, 1) AS sport, 'L' || (o_custkey % 20) AS league, epoch_us(o_orderdate) // 1000000 + o_orderkey % 24 * 3600 AS t FROM orders),
r AS (SELECT k AS ref, sport, league, t, translate(substr(md5(CAST(h AS VARCHAR)), 1, 12), '0123456789abcdef', 'aeioubdfgklmnprt') AS home, translate(substr(md5(CAST(a AS VARCHAR)), 1, 12), '0123456789abcdef', 'aeioubdfgklmnprt') AS away FROM o),
w AS (SELECT k, sport, CASE WHEN k % 11 <> 0 THEN league END AS league, t + (k % 5 - 2) * 1800 AS t, CASE WHEN k % 40 = 0 THEN k END AS match_id, CASE WHEN k % 7 = 0 THEN a ELSE h END AS h, CASE WHEN k % 7 = 0 THEN h WHEN k % 97 = 0 THEN 300 + (a + 1) % 300 ELSE a END AS a FROM o),
n AS (SELECT i, translate(substr(md5(CAST(i AS VARCHAR)), 1, 12), '0123456789abcdef', 'aeioubdfgklmnprt') AS own, translate(substr(md5('x' || i), 1, 12), '0123456789abcdef', 'aeioubdfgklmnprt') AS other FROM range(600) x(i)),
s AS (SELECT i, CASE i % 4 WHEN 0 THEN own WHEN 1 THEN substr(own, 1, 5) || 'z' || substr(own, 7) ELSE other END AS name FROM n),
g AS (SELECT k AS game, sport, league, t, match_id, x.name AS home, y.name AS away FROM w JOIN s x ON x.i = w.h JOIN s y ON y.i = w.a),
m AS (SELECT game, ref, g.sport, abs(g.t - r.t) AS gap, coalesce(g.league = r.league, false) AS same_league, false AS by_id, g.home AS gh, g.away AS ga, r.home AS rh, r.away AS ra FROM g JOIN r ON g.sport = r.sport AND abs(g.t - r.t) <= 10800 AND coalesce(g.league = r.league OR g.home IN (r.home, r.away) OR g.away IN (r.home, r.away), g.home IN (r.home, r.away) OR g.away IN (r.home, r.away)) AND coalesce(g.match_id <> r.ref, true)
  UNION SELECT game, ref, g.sport, abs(g.t - r.t), coalesce(g.league = r.league, false), true, g.home, g.away, r.home, r.away FROM g JOIN r ON g.match_id = r.ref),
c AS (SELECT game, ref, sport, gap, same_league, by_id, false AS turned, gh AS x, rh AS xt, ga AS y, ra AS yt FROM m UNION ALL SELECT game, ref, sport, gap, same_league, by_id, true, gh, ra, ga, rh FROM m),
b AS (SELECT game, sport, x, xt, y, yt, by_id, CAST(levenshtein(x, xt) <= 1 AS INTEGER) + CAST(levenshtein(y, yt) <= 1 AS INTEGER) AS s, turned FROM c),
i AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY s DESC, turned) AS rn FROM b WHERE by_id),
ids AS (SELECT sport, x AS name, xt AS team FROM i WHERE rn = 1 UNION SELECT sport, y, yt FROM i WHERE rn = 1),
f0 AS (SELECT sport, x AS name, xt AS team FROM c UNION SELECT sport, y, yt FROM c),
f1 AS (SELECT f0.*, ids.name IS NOT NULL AS told, ids.name IS NOT NULL OR levenshtein(f0.name, f0.team) <= 1 AS seed FROM f0 LEFT JOIN ids ON f0.sport = ids.sport AND f0.name = ids.name AND f0.team = ids.team),
f2 AS (SELECT *, count(*) FILTER (WHERE seed) OVER (PARTITION BY sport, name) AS ns, count(*) FILTER (WHERE told) OVER (PARTITION BY sport, name) AS nt FROM f1),
f AS (SELECT sport, name, team, seed AND (ns = 1 OR told AND nt = 1) AS yes, (ns = 1 OR nt = 1) AND NOT (seed AND (ns = 1 OR told AND nt = 1)) AS no FROM f2),
sd AS (SELECT ref, sport, t, unnest([home, away]) AS team FROM r), cr AS (SELECT DISTINCT p.ref FROM sd p JOIN sd q ON p.sport = q.sport AND p.team = q.team AND p.ref <> q.ref AND abs(p.t - q.t) <= 21600),
e0 AS (SELECT DISTINCT sport, x, xt, y, yt FROM c WHERE same_league AND ref NOT IN (SELECT ref FROM cr)), e AS (SELECT * FROM e0 UNION SELECT sport, y, yt, x, xt FROM e0),
fs AS (SELECT sport, name, team, CASE WHEN yes THEN 1 WHEN no THEN -1 ELSE 0 END AS st FROM f),
es AS (SELECT e.*, p.st AS stx, q.st AS sty FROM e JOIN fs p ON e.sport = p.sport AND e.x = p.name AND e.xt = p.team JOIN fs q ON e.sport = q.sport AND e.y = q.name AND e.yt = q.team),
sa AS (SELECT sport, y AS name, yt AS team, bool_or(stx = 1) AS good, bool_or(stx = -1) AS bad FROM es WHERE sty = 0 AND stx <> 0 GROUP BY 1, 2, 3),
q0 AS (SELECT f.*, coalesce(good, false) AS good, coalesce(bad, false) AS bad, NOT yes AND NOT no AND NOT coalesce(bad, false) AS free FROM f LEFT JOIN sa USING (sport, name, team)),
e1 AS (SELECT es.* FROM es JOIN q0 p ON es.sport = p.sport AND es.x = p.name AND es.xt = p.team AND p.free JOIN q0 q ON es.sport = q.sport AND es.y = q.name AND es.yt = q.team AND q.free),
up AS (SELECT sport, name, team FROM q0 WHERE free AND good UNION SELECT e.sport, e.y, e.yt FROM up JOIN e1 e ON up.sport = e.sport AND up.name = e.x AND up.team = e.xt),
z1 AS (SELECT q0.*, up.name IS NOT NULL AS reached, count(*) FILTER (WHERE yes OR up.name IS NOT NULL) OVER (PARTITION BY sport, name) AS n FROM q0 LEFT JOIN up USING (sport, name, team)),
q1 AS (SELECT *, reached AND n > 1 AS several, free AND NOT (reached AND n > 1) AS free1 FROM z1),
e2 AS (SELECT es.* FROM es JOIN q1 p ON es.sport = p.sport AND es.x = p.name AND es.xt = p.team AND p.free1 JOIN q1 q ON es.sport = q.sport AND es.y = q.name AND es.yt = q.team AND q.free1),
up2 AS (SELECT sport, name, team FROM q1 WHERE free1 AND good UNION SELECT e.sport, e.y, e.yt FROM up2 u JOIN e2 e ON u.sport = e.sport AND u.name = e.x AND u.team = e.xt),
facts AS (SELECT q1.sport, q1.name, q1.team, CASE WHEN yes THEN 'known' WHEN no THEN 'denied' WHEN several OR good AND bad THEN 'quarantine' WHEN bad THEN 'refuted' WHEN up2.name IS NOT NULL THEN 'learnt' ELSE 'open' END AS how FROM q1 LEFT JOIN up2 USING (sport, name, team))"""


def _sides(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 300).alias("h"), (300 + F.col("o_orderkey") * 7 % 300).alias("a"), F.substring("o_orderpriority", 1, 1).alias("sport"),
        F.concat(F.lit("L"), (F.col("o_custkey") % 20).cast("string")).alias("league"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 24 * 3600).alias("t"),
    )
    digest = lambda text: F.translate(F.substring(F.md5(text), 1, 12), *LETTERS)
    own = lambda i: digest(i.cast("string"))
    k, h, a = F.col("k"), F.col("h"), F.col("a")
    reference = o.select(k.alias("ref"), "sport", "league", F.timestamp_seconds("t").alias("start"), own(h).alias("home"), own(a).alias("away"))
    written = lambda i: F.when(i % 4 == 0, own(i)).when(i % 4 == 1, F.concat(F.substring(own(i), 1, 5), F.lit("z"), F.substring(own(i), 7, 6))).otherwise(digest(F.concat(F.lit("x"), i.cast("string"))))
    home = F.when(k % 7 == 0, a).otherwise(h)
    away = F.when(k % 7 == 0, h).when(k % 97 == 0, 300 + (a + 1) % 300).otherwise(a)
    start = F.timestamp_seconds(F.col("t") + (k % 5 - 2) * 1800)
    games = o.select(k.alias("game"), "sport", F.when(k % 11 != 0, F.col("league")).alias("league"), start.alias("start"), written(home).alias("home"), written(away).alias("away"), F.when(k % 40 == 0, k).alias("match_id"))
    # both are read several times
    return materialize(games), materialize(reference), spark.createDataFrame([], "sport string, alias string, team string")


@query("aligned_games", SIDES_SQL + """,
j AS (SELECT c.*, p.how AS hx, q.how AS hy, levenshtein(x, xt) AS lx, levenshtein(y, yt) AS ly FROM c JOIN facts p ON c.sport = p.sport AND c.x = p.name AND c.xt = p.team JOIN facts q ON c.sport = q.sport AND c.y = q.name AND c.yt = q.team),
k AS (SELECT *, CASE WHEN by_id THEN 0 WHEN lx <= 1 AND ly <= 1 AND NOT turned THEN 1 WHEN lx <= 1 AND ly <= 1 THEN 2 WHEN hx IN ('known', 'learnt') AND hy IN ('known', 'learnt') THEN 3
  WHEN same_league AND (lx = 0 AND hx = 'known' AND hy = 'open' OR ly = 0 AND hy = 'known' AND hx = 'open') THEN 4 WHEN same_league AND (hx IN ('known', 'learnt') OR hy IN ('known', 'learnt')) THEN 5 END AS rung FROM j),
x AS (SELECT *, rank() OVER (PARTITION BY game ORDER BY rung, gap) AS rk FROM k WHERE rung IS NOT NULL), y AS (SELECT game, count(DISTINCT ref) AS n, min(ref) AS ref, min(rung) AS rung FROM x WHERE rk = 1 GROUP BY 1)
SELECT g.game, CASE WHEN n = 1 THEN y.ref END AS ref, CASE WHEN n IS NULL THEN 'missed' WHEN n > 1 THEN 'disputed' ELSE (['id', 'letters', 'reversed', 'learnt', 'firm side', 'ask'])[rung + 1] END AS rung FROM g LEFT JOIN y ON g.game = y.game""")
def aligned_games(spark: SparkSession, d: str) -> DataFrame:
    return A.align(*_sides(spark, d), firm=99)[0]


@query("learnt_spellings", SIDES_SQL + " SELECT sport, name, team, how FROM facts")
def learnt_spellings(spark: SparkSession, d: str) -> DataFrame:
    """What alignment learns, from names, times and some ids."""
    games, reference, known = _sides(spark, d)
    return A.judged_facts(games, reference, known).drop("score")


@query("late_marks", """
WITH o AS (SELECT o_orderkey AS k, substr(o_orderpriority, 1, 1) AS sport, epoch_us(o_orderdate) // 1000000 AS t, translate(substr(md5(CAST(o_custkey % 60 AS VARCHAR)), 1, 12), '0123456789abcdef', 'aeioubdfgklmnprt') AS h, translate(substr(md5(CAST(60 + o_orderkey % 60 AS VARCHAR)), 1, 12), '0123456789abcdef', 'aeioubdfgklmnprt') AS a FROM orders),
r AS (SELECT k AS ref, sport, t, h, a, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'W' WHEN 2 THEN 'U19' END AS marks FROM o),
m AS (SELECT g.k AS row, r.ref, r.marks, NOT (r.h = g.h AND r.a = g.a) AS turned FROM o g JOIN r ON g.sport = r.sport AND abs(g.t - r.t) <= 10800 AND (r.h = g.h AND r.a = g.a OR r.h = g.a AND r.a = g.h)),
j AS (SELECT row, bool_or(coalesce(marks = '', false)) AS plain, count(*) FILTER (marks <> '') AS n, max(CASE WHEN marks <> '' THEN ref END) AS ref, max(CASE WHEN marks <> '' THEN marks END) AS marks, bool_or(turned) FILTER (marks <> '') AS turned FROM m GROUP BY 1)
SELECT row, ref, marks, turned <> (row % 5 = 0) AS turned FROM j WHERE NOT plain AND n = 1""")
def late_marks(spark: SparkSession, d: str) -> DataFrame:
    """Orders without marks against orders of which three in four carry some."""
    k = F.col("o_orderkey")
    name = lambda i: F.translate(F.substring(F.md5(i.cast("string")), 1, 12), *LETTERS)
    o = table(spark, d, "orders").select(k.alias("k"), F.substring("o_orderpriority", 1, 1).alias("sport"), F.col("o_orderdate").alias("start"), name(F.col("o_custkey") % 60).alias("h"), name(60 + k % 60).alias("a"))
    k = F.col("k")
    mark = lambda c, other: F.when(k % 4 == 0, F.col(c)).when(k % 4 == 1, F.concat(c, F.lit(" (W)"))).when(k % 4 == 2, F.concat(c, F.lit(" U19"))).otherwise(F.concat(c, F.lit(other)))
    reference = o.select(k.alias("ref"), "sport", "start", mark("h", " (W)").alias("home"), mark("a", " U19").alias("away"))
    turn = k % 5 == 0
    rows = o.select(k.alias("row"), "sport", "start", F.when(turn, F.col("a")).otherwise(F.col("h")).alias("home"), F.when(turn, F.col("h")).otherwise(F.col("a")).alias("away"))
    return A.late_marks(rows, reference)
