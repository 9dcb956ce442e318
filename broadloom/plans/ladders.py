"""Matching ladders, sport rules, listings and dictionary checks over the order tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.functions import names as N
from broadloom.functions import text as X
from broadloom.operators import classify as C
from broadloom.operators import matching as M
from broadloom.operators import store as S
from broadloom.plans.catalog import query
from broadloom.sources.tables import table

GAMES_SQL = """
e AS (SELECT event_id, ts, user_id % 12 AS team, event_type AS sport, CASE WHEN event_id % 9 = 0 THEN CAST(event_id // 2 % 500 AS VARCHAR) END AS ref, CASE WHEN event_id % 7 = 0 THEN 'show ' || user_id END AS title, CASE WHEN event_id % 11 = 0 THEN user_id END AS link, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
i AS (SELECT * FROM e WHERE event_id % 3 = 0), s AS (SELECT event_id AS stored, ts AS stored_ts, team, sport, ref, title, link, k FROM e WHERE event_id % 3 <> 0)"""


@query("match_ladder", f"""
WITH {GAMES_SQL},
m1 AS (SELECT i.event_id, min(stored) AS stored FROM i JOIN s USING (ref) GROUP BY 1), l1 AS (SELECT * FROM i WHERE event_id NOT IN (SELECT event_id FROM m1)),
m2 AS (SELECT l.event_id, min(stored) AS stored FROM l1 l JOIN s ON l.team = s.team AND l.sport = s.sport AND abs(epoch_us(stored_ts) - epoch_us(ts)) <= 1200000000 GROUP BY 1), l2 AS (SELECT * FROM l1 WHERE event_id NOT IN (SELECT event_id FROM m2)),
im AS (SELECT l2.event_id, ts, unnest(list_distinct([k % 10, k % 7 + 10, k % 4 + 20])) AS mark FROM l2), sm AS (SELECT stored, stored_ts, unnest(list_distinct([k % 10, k % 7 + 10, k % 4 + 20])) AS mark FROM s),
c AS (SELECT event_id, stored, count(*) AS n FROM im JOIN sm ON im.mark = sm.mark AND abs(epoch_us(stored_ts) - epoch_us(ts)) <= 1800000000 GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, stored) AS rn FROM c WHERE n >= 2), m3 AS (SELECT event_id, stored FROM f WHERE rn = 1), l3 AS (SELECT * FROM l2 WHERE event_id NOT IN (SELECT event_id FROM m3)),
m4 AS (SELECT l.event_id, min(stored) AS stored FROM l3 l JOIN s ON l.title = s.title AND abs(epoch_us(stored_ts) - epoch_us(ts)) <= 86400000000 GROUP BY 1), l4 AS (SELECT * FROM l3 WHERE event_id NOT IN (SELECT event_id FROM m4)),
m5 AS (SELECT l.event_id, min(stored) AS stored FROM l4 l JOIN s ON l.link = s.link GROUP BY 1), l5 AS (SELECT * FROM l4 WHERE event_id NOT IN (SELECT event_id FROM m5)),
m6 AS (SELECT l.event_id, min(s.stored) AS stored FROM l5 l JOIN s ON l.event_id + 1 = s.stored GROUP BY 1), l6 AS (SELECT * FROM l5 WHERE event_id NOT IN (SELECT event_id FROM m6)),
m7 AS (SELECT l.event_id, min(stored) AS stored FROM l6 l JOIN s ON l.team = s.team AND l.sport = s.sport AND abs(epoch_us(stored_ts) - epoch_us(ts)) <= 108000000000 GROUP BY 1),
u AS (SELECT *, 'reference' AS stage FROM m1 UNION ALL SELECT *, 'name' FROM m2 UNION ALL SELECT *, 'marks' FROM m3 UNION ALL SELECT *, 'title' FROM m4 UNION ALL SELECT *, 'link' FROM m5 UNION ALL SELECT *, 'twin' FROM m6 UNION ALL SELECT *, 'moved' FROM m7)
SELECT i.event_id, u.stored, u.stage FROM i LEFT JOIN u ON i.event_id = u.event_id""")
def match_ladder(spark: SparkSession, d: str) -> DataFrame:
    """All seven rungs: reference id, name in time, channel marks, title, link, twin, moved."""
    k, u, n = F.get_json_object("props", "$.k").cast("long"), F.col("user_id"), F.col("event_id")
    e = table(spark, d, "events").select("event_id", "ts", (u % 12).alias("team"), F.col("event_type").alias("sport"), F.when(n % 9 == 0, F.expr("CAST(event_id div 2 % 500 AS STRING)")).alias("ref"), F.when(n % 7 == 0, F.concat(F.lit("show "), u.cast("string"))).alias("title"), F.when(n % 11 == 0, u).alias("link"), (n + 1).alias("twin"), F.array_distinct(F.array(k % 10, k % 7 + 10, k % 4 + 20)).alias("marks"))
    incoming = e.filter("event_id % 3 = 0")
    stored = e.filter("event_id % 3 <> 0").drop("twin").withColumnRenamed("event_id", "stored").withColumnRenamed("ts", "stored_ts").withColumn("own", F.col("stored"))
    ids = ("event_id", "stored")
    rungs = [("reference", M.by_key("ref", "ref", *ids)), ("name", M.by_time(["team", "sport"], "ts", "stored_ts", 20, *ids)), ("marks", M.by_marks("ts", "stored_ts", "marks", "marks", *ids)), ("title", M.by_time(["title"], "ts", "stored_ts", 1440, *ids)), ("link", M.by_key("link", "link", *ids)), ("twin", M.by_key("twin", "own", *ids)), ("moved", M.by_time(["team", "sport"], "ts", "stored_ts", 1800, *ids))]
    return S.match_cascade(incoming, stored, "event_id", "stored", rungs)


@query("align_ladder", """
WITH c AS (SELECT l_orderkey AS game, l_partkey * 10 + l_linenumber AS ref, l_suppkey % 2 = 0 AS same, CAST(l_quantity AS INTEGER) * 2 AS score, CAST(l_partkey % 101 AS INTEGER) AS side, l_returnflag = 'R' AS turned FROM lineitem),
r AS (SELECT *, CASE WHEN score >= 85 AND NOT turned THEN 0 WHEN score >= 85 THEN 1 WHEN same AND side >= 95 THEN 2 WHEN side >= 90 AND score >= 40 THEN 3 WHEN same AND score >= 60 THEN 4 END AS rung FROM c),
k AS (SELECT *, rank() OVER (PARTITION BY game ORDER BY rung, score DESC, side DESC) AS rk FROM r WHERE rung IS NOT NULL), b AS (SELECT game, count(DISTINCT ref) AS n, min(ref) AS ref, min(rung) AS rung FROM k WHERE rk = 1 GROUP BY 1)
SELECT g.game, CASE WHEN n = 1 THEN ref END AS ref, CASE WHEN n IS NULL THEN 'missed' WHEN n > 1 THEN 'disputed' ELSE (['letters', 'reversed', 'firm side', 'leader', 'ask'])[rung + 1] END AS rung FROM (SELECT DISTINCT game FROM c) g LEFT JOIN b ON g.game = b.game""")
def align_ladder(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ref"), (F.col("l_suppkey") % 2 == 0).alias("same"), (F.col("l_quantity").cast("int") * 2).alias("score"), (F.col("l_partkey") % 101).cast("int").alias("side"), (F.col("l_returnflag") == "R").alias("turned"))
    score, side = F.col("score"), F.col("side")
    rungs = [("letters", (score >= 85) & ~F.col("turned")), ("reversed", score >= 85), ("firm side", F.col("same") & (side >= 95)), ("leader", (side >= 90) & (score >= 40)), ("ask", F.col("same") & (score >= 60))]
    return M.aligned(c, "game", "ref", rungs, [F.desc("score"), F.desc("side")])


@query("sport_by_rules", r"""
WITH p AS (SELECT *, p_name || ' - ' || p_type AS text, regexp_extract(p_name, '(\w+)$', 1) AS noun FROM part)
SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'G' WHEN regexp_matches(text, '\bcold\b') THEN 'W' WHEN p_size % 5 = 0 THEN 'R' WHEN noun = 'ring' AND p_type = 'SMALL' THEN 'B' WHEN noun = 'ring' THEN 'X' WHEN noun = 'bolt' THEN 'O' WHEN p_type = 'PROMO' THEN 'L' WHEN p_brand LIKE '%#7' THEN 'V' WHEN p_size % 4 = 1 THEN 'H' WHEN noun = 'gear' THEN 'T' ELSE '-' END AS sport,
  CASE WHEN p_size % 9 = 0 OR regexp_matches(text, '\bcold\b') THEN 1 WHEN p_size % 5 = 0 THEN 2 WHEN noun = 'ring' AND p_type = 'SMALL' THEN 3 WHEN noun = 'ring' THEN 4 WHEN noun = 'bolt' THEN 5 WHEN p_type = 'PROMO' THEN 6 WHEN p_brand LIKE '%#7' THEN 7 WHEN p_size % 4 = 1 THEN 8 WHEN noun = 'gear' THEN 9 ELSE 10 END AS rule FROM p""")
def sport_by_rules(spark: SparkSession, d: str) -> DataFrame:
    """All ten rules, evidence found in the text of each part."""
    text = F.concat("p_name", F.lit(" - "), "p_type")
    on = lambda test, v: F.when(test, F.lit(v))
    size, word = F.col("p_size"), lambda w: X.has_word(text, [w])
    rules = [(1, F.coalesce(on(size % 9 == 0, "G"), on(word("cold"), "W"))), (2, on(size % 5 == 0, "R")), (3, on(word("ring") & (F.col("p_type") == "SMALL"), "B")), (4, on(word("ring"), "X")), (5, on(word("bolt"), "O")), (6, on(word("promo"), "L")), (7, on(F.col("p_brand").endswith("#7"), "V")), (8, on(size % 4 == 1, "H")), (9, on(word("gear"), "T"))]
    s = M.sport_by_rules(rules)
    return table(spark, d, "part").select("p_partkey", s["sport"].alias("sport"), s["rule"].alias("rule"))


@query("allowed_words", """
WITH v AS (SELECT DISTINCT p_name AS word, CASE WHEN length(p_name) % 3 = 0 THEN ['en'] WHEN length(p_name) % 3 = 1 THEN ['de', 'fr'] ELSE ['es'] END AS langs FROM part), s AS (SELECT s_suppkey AS site, CASE s_suppkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['de'] WHEN 2 THEN ['es', 'fr'] ELSE NULL END AS langs FROM supplier)
SELECT DISTINCT site, word FROM s JOIN v ON coalesce(len(s.langs), 0) = 0 OR list_has_any(v.langs, list_append(s.langs, 'en'))""")
def allowed_words(spark: SparkSession, d: str) -> DataFrame:
    lang = lambda *x: F.array(*map(F.lit, x))
    n, k = F.length("p_name") % 3, F.col("s_suppkey") % 4
    words = table(spark, d, "part").select(F.col("p_name").alias("word"), F.when(n == 0, lang("en")).when(n == 1, lang("de", "fr")).otherwise(lang("es")).alias("langs")).distinct()
    sites = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.when(k == 0, F.array().cast("array<string>")).when(k == 1, lang("de")).when(k == 2, lang("es", "fr")).alias("langs"))
    return C.allowed_words(words, sites)


@query("listing_nulls", """
WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS start, CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS name FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY start ASC NULLS LAST, lower(name), o_orderkey) AS pos FROM o""")
def listing_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Games without a time last, names by letters whatever their case."""
    from pyspark.sql import Window

    start, name = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")), F.when(F.col("o_orderkey") % 3 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    w = Window.partitionBy("o_custkey").orderBy(start.asc_nulls_last(), F.lower(name), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("pos"))


@query("pair_guess_lists", r"""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || '+' || p_type WHEN 1 THEN p_name || '+' || p_brand WHEN 2 THEN p_name || '+' || p_type || ';' || p_brand || '+' || p_name ELSE p_name || '+' || p_brand END AS guesses FROM part""")
def pair_guess_lists(spark: SparkSession, d: str) -> DataFrame:
    k, n, t, b = F.col("p_size") % 4, F.col("p_name"), F.col("p_type"), F.col("p_brand")
    title = F.when(k == 0, F.concat(F.lit("Cup: "), n, F.lit(" vs "), t)).when(k == 1, F.concat(n, F.lit("-"), b)).when(k == 2, F.concat(n, F.lit(" - "), t, F.lit(" | "), b, F.lit(" x "), n)).otherwise(F.concat(F.lit("Sport / "), n, F.lit(" – "), b))
    pairs = F.transform(X.pair_guesses(title), lambda p: F.array_join(p, "+"))
    return table(spark, d, "part").select("p_partkey", F.array_join(pairs, ";").alias("guesses"))


@query("donor_sports", """
WITH r AS (SELECT event_id, user_id AS game, CASE WHEN event_id % 3 = 0 THEN event_type END AS sport FROM events), n AS (SELECT game, sport, count(*) AS n FROM r WHERE sport IS NOT NULL GROUP BY 1, 2),
d AS (SELECT r.game, r.sport, row_number() OVER (PARTITION BY r.game ORDER BY n DESC, event_id) AS rn FROM r JOIN n ON r.game = n.game AND r.sport = n.sport)
SELECT event_id, coalesce(r.sport, d.sport) AS sport FROM r LEFT JOIN d ON r.game = d.game AND rn = 1""")
def donor_sports(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("game"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("sport"), F.lit(1).alias("vote"))
    return M.donor_rows(rows, "game", "sport", "vote", [F.col("event_id")]).select("event_id", "sport")


@query("covered_days", """
WITH w AS (SELECT l_suppkey AS site, epoch(l_shipdate) // 86400 AS s, epoch(l_shipdate) // 86400 + 4 AS e FROM lineitem), b AS (SELECT min(s) + 400 AS low, min(s) + 430 AS high FROM w),
x AS (SELECT site, s, e, low, high, greatest(coalesce(max(e) OVER (PARTITION BY site ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low), low) AS reach FROM w, b WHERE e >= low AND s <= high),
g AS (SELECT site, bool_or(s > reach) AS hole, max(e) AS e, max(high) AS high FROM x GROUP BY 1) SELECT DISTINCT w.site, coalesce(NOT hole AND g.e >= high, false) AS covered FROM w LEFT JOIN g ON w.site = g.site""")
def covered_days(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400)
    w = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), day.alias("s"), (day + 4).alias("e"))
    w = w.crossJoin(F.broadcast(w.agg(F.min("s").alias("first"))))  # one row
    return M.covered_days(w, "site", "s", "e", F.col("first") + 400, F.col("first") + 430)


@query("dictionary_faults", """
WITH a AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS alias, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'en' END AS lang, CASE WHEN p_size % 4 = 0 THEN 'W' ELSE NULL END AS category, p_brand AS team FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(alias), coalesce(lang, ''), coalesce(category, ''), team ORDER BY id DESC) AS n, max(CASE WHEN category IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY lower(alias), team) AS marked FROM a)
SELECT id, alias, team, CASE WHEN n > 1 THEN 'copy' ELSE 'bare' END AS fault FROM r WHERE n > 1 OR category IS NULL AND marked = 1""")
def dictionary_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size")
    a = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("alias"), F.when(k % 3 != 0, F.lit("en")).alias("lang"), F.when(k % 4 == 0, F.lit("W")).alias("category"), F.col("p_brand").alias("team"))
    return M.dictionary_faults(a, "alias", "lang", "category", "team")


@query("retractable_marks", """
WITH m AS (SELECT DISTINCT l_orderkey AS game, l_suppkey AS site, strftime(l_shipdate, '%Y-%m') AS day, CAST(l_shipdate AS DATE) AS start FROM lineitem), seen AS (SELECT DISTINCT game, site FROM m WHERE game % 4 <> 0),
cov AS (SELECT DISTINCT site, day FROM m WHERE site % 5 <> 0 AND (site + CAST(substr(day, 6, 2) AS BIGINT)) % 3 <> 0), g AS (SELECT m.site, m.day, count(*) AS live, count(seen.game) AS given FROM m LEFT JOIN seen ON m.game = seen.game AND m.site = seen.site GROUP BY 1, 2)
SELECT m.game, m.site, m.day, strftime(m.start, '%Y-%m-%d') AS start FROM m JOIN cov ON m.site = cov.site AND m.day = cov.day JOIN g ON m.site = g.site AND m.day = g.day
WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.game = m.game AND seen.site = m.site) AND given > 0 AND given >= ceil(live * 0.5) AND m.start > DATE '1997-06-01'""")
def retractable_marks(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("site"), F.date_format("l_shipdate", "yyyy-MM").alias("day"), F.to_date("l_shipdate").alias("start")).distinct()
    site, month = F.col("site"), F.substring("day", 6, 2).cast("long")
    cov = m.select("site", "day").distinct().select("site", "day", (site % 5 != 0).alias("answered"), ((site + month) % 3 != 0).alias("intact"))
    out = S.retractable(m, m.filter("game % 4 <> 0"), cov, ["game"], "site", "day", F.col("start"), F.lit("1997-06-01").cast("date"), backfill=False, new_file=True)
    return out.select("game", "site", "day", F.date_format("start", "yyyy-MM-dd").alias("start"))


@query("suspended_pages", r"""
SELECT page_id, CASE WHEN trim(coalesce(html, '')) = '' THEN 'empty' WHEN regexp_matches(html, '(?i)(captcha|checking your browser|access denied|attention required)') THEN 'protected' ELSE 'other' END AS state, contains(lower(html), '<title>') AND lower(trim(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1))) <> '' AS has_title FROM pages""")
def suspended_pages(spark: SparkSession, d: str) -> DataFrame:
    from broadloom.functions.payload import page_state

    state = page_state(F.col("html"))
    title = F.trim(F.regexp_extract("html", r"(?i)<title>([^<]*)</title>", 1)) != ""
    return table(spark, d, "pages").select("page_id", F.when(state.isin("empty", "protected"), state).otherwise("other").alias("state"), title.alias("has_title"))


@query("readings_of_names", r"""
SELECT DISTINCT p_name AS name, p_name || '|' || regexp_replace(regexp_replace(replace(replace(p_name, 'ch', '#'), 'c', 'k'), 'w', 'v', 'g'), '(g)g|(l)l|(r)r', '\1\2\3', 'g') AS forms FROM (SELECT DISTINCT p_name FROM part)""")
def readings_of_names(spark: SparkSession, d: str) -> DataFrame:
    """Plain names and their words with letters of one sound alike."""
    @F.pandas_udf("string")
    def sounds(x):
        return x.map(lambda v: "|".join([v, " ".join(N.one_sound(w) for w in v.split())]))

    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().select("name", sounds("name").alias("forms"))
