"""Row evidence, sides, dictionaries and audits over parts, orders, events, pages and documents.

On the SQL side expressions have no look-around; the words of the part names are plain ASCII, so
``\\b`` gives the same borders there."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.functions import payload as P
from broadloom.operators import classify as C
from broadloom.operators import rows as R
from broadloom.operators import store as S
from broadloom.plans.catalog import query
from broadloom.plans.text import MARKERS, VERDICT_SQL
from broadloom.sources.tables import table


def _case(name: str, *options) -> object:
    """The option whose number is the column's remainder, the last for all others."""
    out = None
    for i, o in enumerate(options[:-1]):
        test = F.expr(f"{name} % {len(options)} = {i}")
        out = F.when(test, o) if out is None else out.when(test, o)
    return out.otherwise(options[-1])


@query("sport_evidence", r"""
WITH t AS (SELECT p_partkey, p_size % 12 + 1 AS month, p_name, p_brand, p_name || ' - ' || p_brand || ' ' || CASE p_size % 3 WHEN 0 THEN 'bolt' WHEN 1 THEN p_type ELSE 'old ring' END AS text FROM part),
b AS (SELECT *, regexp_replace(text, '(?i)\bold\s+ring\b', ' ', 'g') AS body, trim(regexp_replace(replace(replace(lower(text), lower(p_name), ' '), lower(p_brand), ' '), '\s+', ' ', 'g')) AS rest FROM t)
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(body, '(?i)\b(ring|gear|small)\b'), lambda x: lower(x)), ',') AS alien, nullif(lower(regexp_extract(body, '(?i)\b(bolt|rod)\b')), '') AS own,
  CASE WHEN regexp_matches(text, '(?i)\bring\b') AND month NOT IN (1, 2, 3) THEN 'ring' WHEN regexp_matches(text, '(?i)\bgear\b') AND month NOT IN (6, 7) THEN 'gear' END AS late,
  rest, regexp_matches(p_name || ' ' || p_brand, '(?i)\b(ring|gear|small)\b') AND NOT regexp_matches(rest, '(?i)\b(ring|gear|small)\b') AND regexp_matches(rest, '(?i)\b(bolt|rod)\b') AS inside FROM b""")
def sport_evidence(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" - "), "p_brand", F.lit(" "), F.when(F.expr("p_size % 3 = 0"), F.lit("bolt")).when(F.expr("p_size % 3 = 1"), F.col("p_type")).otherwise(F.lit("old ring")))
    alien, own, skip = ["ring", "gear", "small"], ["bolt", "rod"], ["old ring"]
    rows = table(spark, d, "part").withColumn("text", text)
    rows = rows.withColumn("rest", R.without_pair(F.col("text"), F.col("p_name"), F.col("p_brand")))
    late = R.out_of_season(F.col("text"), F.col("p_size") % 12 + 1, {"ring": {1, 2, 3}, "gear": {6, 7}})
    return rows.select("p_partkey", F.array_join(R.word_hits(F.col("text"), alien, skip), ",").alias("alien"), R.first_word(F.col("text"), own, skip).alias("own"), late.alias("late"), "rest", R.alien_inside(F.col("p_name"), F.col("p_brand"), F.col("rest"), alien, own).alias("inside"))


@query("team_sport_words", "WITH w AS (SELECT DISTINCT lower(p_type) AS word FROM part), n AS (SELECT DISTINCT p_name, unnest(list_distinct(string_split(p_name, ' '))) AS word FROM part) SELECT word, count(DISTINCT p_name) AS n_names FROM w JOIN n USING (word) GROUP BY 1")
def team_sport_words(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return R.team_words(part.select(F.col("p_type").alias("word")), "word", part, "p_name")


@query("own_channel_rows", """
WITH r AS (SELECT p_partkey, upper(p_name) || ' ' AS channel, CASE p_size % 3 WHEN 0 THEN p_name ELSE p_brand END AS home, CASE WHEN p_size % 3 = 1 THEN p_name ELSE p_type END AS away FROM part),
o AS (SELECT *, CASE WHEN lower(home) = lower(trim(channel)) THEN away WHEN lower(away) = lower(trim(channel)) THEN home END AS other FROM r)
SELECT p_partkey, other IS NOT NULL AND lower(regexp_replace(other, '[^A-Za-z0-9]+', ' ', 'g')) NOT IN (SELECT lower(p_type) FROM part WHERE p_size < 10 UNION SELECT 'brand 7') AS is_filler FROM o""")
def own_channel_rows(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    rows = part.select("p_partkey", F.concat(F.upper("p_name"), F.lit(" ")).alias("channel"), F.when(F.expr("p_size % 3 = 0"), F.col("p_name")).otherwise(F.col("p_brand")).alias("home"), F.when(F.expr("p_size % 3 = 1"), F.col("p_name")).otherwise(F.col("p_type")).alias("away"))
    teams = part.filter("p_size < 10").select(F.col("p_type").alias("team")).union(spark.createDataFrame([("Brand#7",)], "team string"))
    return R.channel_filler(rows, "channel", "home", "away", teams, "team").select("p_partkey", "is_filler")


@query("display_window", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-03-07' AS shown FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-02-28'")
def display_window(spark: SparkSession, d: str) -> DataFrame:
    today, day = F.lit("1998-03-01").cast("date"), F.to_date("o_orderdate")
    return table(spark, d, "orders").filter(R.not_past(day, today)).select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"), R.in_window(day, today).alias("shown"))


@query("placeholders", r"""
WITH r AS (SELECT p_partkey, p_name AS channel, CASE p_size % 8 WHEN 0 THEN 'Winner of ' || p_name WHEN 1 THEN 'TBD U19' WHEN 2 THEN 'Qualifier ' || p_size WHEN 3 THEN p_name WHEN 4 THEN '(W)' WHEN 5 THEN 'winner ' || p_name WHEN 6 THEN 'bye' ELSE upper(p_name) || ' show' END AS name FROM part),
b AS (SELECT *, trim(regexp_replace(regexp_replace(name, '(?i)(\bu[- ]?[0-9]{2}\b|\bwomen\b|\(w\))', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM r)
SELECT p_partkey, bare = '' OR regexp_matches(bare, '(?i)^(tbd|tba|to be decided|to be announced|qualifier|bye|winner|loser)(\s+(of|from)\b.*|\s*[0-9]*)$') AS nobody,
  trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) = '' OR starts_with(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), channel) AS no_show FROM b""")
def placeholders(spark: SparkSession, d: str) -> DataFrame:
    name = _case("p_size", F.concat(F.lit("Winner of "), "p_name"), F.lit("TBD U19"), F.concat(F.lit("Qualifier "), F.col("p_size").cast("string")), F.col("p_name"), F.lit("(W)"), F.concat(F.lit("winner "), "p_name"), F.lit("bye"), F.concat(F.upper("p_name"), F.lit(" show")))
    return table(spark, d, "part").withColumn("name", name).select("p_partkey", R.is_placeholder(F.col("name")).alias("nobody"), R.is_empty_show(F.col("name"), F.col("p_name")).alias("no_show"))


STAGE_SQL = r"""CASE WHEN regexp_matches(text, '(^|[^0-9/])1/2($|[^0-9/])') THEN 'Semifinals' WHEN regexp_matches(text, '(^|[^0-9/])1/4($|[^0-9/])') THEN 'Quarterfinals' WHEN regexp_matches(text, '(^|[^0-9/])1/8($|[^0-9/])') THEN 'Round of 16' WHEN regexp_matches(text, '(^|[^0-9/])1/16($|[^0-9/])') THEN 'Round of 32'
  WHEN regexp_matches(text, '(?i)\b(round of 32|last 32)\b') THEN 'Round of 32' WHEN regexp_matches(text, '(?i)\b(round of 16|last 16)\b') THEN 'Round of 16' WHEN regexp_matches(text, '(?i)\b(quarterfinals?|quarter-finals?)\b') THEN 'Quarterfinals' WHEN regexp_matches(text, '(?i)\b(semifinals?|semi-finals?)\b') THEN 'Semifinals' WHEN regexp_matches(text, '(?i)\b(grand )?final\b') THEN 'Final' END"""


@query("tournament_stages", f"""
WITH r AS (SELECT p_partkey, p_name || ' ' || CASE p_size % 8 WHEN 0 THEN '1/2 FINAL' WHEN 1 THEN 'Semi-Finals' WHEN 2 THEN 'last 16' WHEN 3 THEN '11/8' WHEN 4 THEN 'Grand Final' WHEN 5 THEN 'finalists' WHEN 6 THEN '1/16 of ' || p_size ELSE 'quarterfinal' END AS text, CASE WHEN p_size % 2 = 0 THEN 'T' ELSE 'F' END AS sport, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS away FROM part)
SELECT p_partkey, {STAGE_SQL} AS stage, sport = 'T' AND away = '' AS is_title FROM r""")
def tournament_stages(spark: SparkSession, d: str) -> DataFrame:
    said = _case("p_size", F.lit("1/2 FINAL"), F.lit("Semi-Finals"), F.lit("last 16"), F.lit("11/8"), F.lit("Grand Final"), F.lit("finalists"), F.concat(F.lit("1/16 of "), F.col("p_size").cast("string")), F.lit("quarterfinal"))
    rows = table(spark, d, "part").withColumns({"text": F.concat("p_name", F.lit(" "), said), "sport": _case("p_size", F.lit("T"), F.lit("F")), "away": F.when(F.expr("p_size % 5 = 0"), F.lit("")).otherwise(F.col("p_brand"))})
    return rows.select("p_partkey", R.stage(F.col("text")).alias("stage"), R.is_title_row(F.col("sport"), F.col("text"), F.col("away")).alias("is_title"))


TOURNAMENTS_SQL = "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Red' WHEN 1 THEN 'red ring' WHEN 2 THEN 'Old Gear' WHEN 3 THEN 'gear' ELSE 'anvil' END AS name, n_nationkey * 2 AS f, n_nationkey * 2 + 9 AS l FROM nation"


@query("whole_tournaments", f"""
WITH t AS ({TOURNAMENTS_SQL}), m AS (SELECT DISTINCT p_partkey, name, length(name) AS n FROM part JOIN t ON contains(' ' || lower(p_name) || ' ', ' ' || lower(name) || ' ') AND p_size BETWEEN f AND l),
x AS (SELECT *, max(n) OVER (PARTITION BY p_partkey) AS top FROM m) SELECT p_partkey, min(name) AS name FROM x WHERE n = top GROUP BY 1 HAVING count(*) = 1""")
def whole_tournaments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    t = table(spark, d, "nation").select(_case("n_nationkey", F.lit("Red"), F.lit("red ring"), F.lit("Old Gear"), F.lit("gear"), F.lit("anvil")).alias("name"), (k * 2).alias("f"), (k * 2 + 9).alias("l"))
    return R.whole_tournaments(table(spark, d, "part"), "p_partkey", "p_name", "p_size", t, "name", "f", "l")


@query("tidied_sides", r"""
WITH r AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'Semifinal: ' || p_name WHEN 1 THEN p_name || ' - LIVE' WHEN 2 THEN p_type || ' ' || p_name WHEN 3 THEN p_name || ' (' || p_type || ')' WHEN 4 THEN 'final, live ' || p_name WHEN 5 THEN p_name || ' [replay]' ELSE p_type END AS side FROM part),
a AS (SELECT p_partkey, regexp_replace(side, '(?i)^\s*((small|promo|economy|semifinal|final|live)\s*[:,-]?\s+)+', '') AS s FROM r), b AS (SELECT p_partkey, regexp_replace(s, '(?i)\s*[\(\[]\s*(small|promo|economy|replay)\s*[\)\]]', '', 'g') AS s FROM a),
c AS (SELECT p_partkey, regexp_replace(s, '(?i)(\s*[:,-]?\s+(small|promo|economy|live))+\s*$', '') AS s FROM b) SELECT p_partkey, trim(s) AS side FROM c""")
def tidied_sides(spark: SparkSession, d: str) -> DataFrame:
    kind, name = F.col("p_type"), F.col("p_name")
    side = _case("p_size", F.concat(F.lit("Semifinal: "), name), F.concat(name, F.lit(" - LIVE")), F.concat(kind, F.lit(" "), name), F.concat(name, F.lit(" ("), kind, F.lit(")")), F.concat(F.lit("final, live "), name), F.concat(name, F.lit(" [replay]")), kind)
    return table(spark, d, "part").select("p_partkey", R.tidy_side(side, ["small", "promo", "economy"]).alias("side"))


@query("title_over_pair", """
WITH k AS (SELECT DISTINCT lower(p_name) AS n FROM part WHERE p_size > 25), r AS (SELECT a.p_partkey, a.p_name AS th, b.p_name AS ta, b.p_brand AS fh, a.p_name AS fa FROM part a JOIN part b ON b.p_partkey = (a.p_partkey * 3 + 1) % (SELECT count(*) FROM part)),
s AS (SELECT *, CASE WHEN lower(th) IN (SELECT n FROM k) THEN 1 ELSE 0 END + CASE WHEN lower(ta) IN (SELECT n FROM k) THEN 1 ELSE 0 END AS t, CASE WHEN lower(fh) IN (SELECT n FROM k) THEN 1 ELSE 0 END + CASE WHEN lower(fa) IN (SELECT n FROM k) THEN 1 ELSE 0 END AS f FROM r)
SELECT p_partkey, CASE WHEN t > f THEN 'title' ELSE 'field' END AS source, CASE WHEN t > f THEN th ELSE fh END AS home, CASE WHEN t > f THEN ta ELSE fa END AS away FROM s""")
def title_over_pair(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    b = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("ta"), F.col("p_brand").alias("fh"))
    rows = part.withColumn("k", (F.col("p_partkey") * 3 + 1) % part.count()).join(b, "k").select("p_partkey", F.col("p_name").alias("th"), "ta", "fh", F.col("p_name").alias("fa"))
    return R.title_over_pair(rows, "p_partkey", {"title_home": "th", "title_away": "ta", "field_home": "fh", "field_away": "fa"}, part.filter("p_size > 25"), "p_name")


@query("merged_cities", """
WITH k AS (SELECT p_brand, list(DISTINCT p_type) AS tours, list(DISTINCT p_name) AS words FROM part WHERE p_size % 2 = 0 GROUP BY 1), f AS (SELECT p_brand, list(DISTINCT p_type) AS tours, list(DISTINCT upper(p_name)) AS words FROM part WHERE p_size % 3 = 0 GROUP BY 1)
SELECT coalesce(k.p_brand, f.p_brand) AS p_brand, array_to_string(list_sort(list_distinct(list_concat(coalesce(k.tours, []), coalesce(f.tours, [])))), ',') AS tours, array_to_string(list_sort(list_distinct(list_concat(coalesce(k.words, []), coalesce(f.words, [])))), ',') AS words, k.p_brand IS NULL AS is_new FROM k FULL JOIN f ON k.p_brand = f.p_brand""")
def merged_cities(spark: SparkSession, d: str) -> DataFrame:
    side = lambda n, w: table(spark, d, "part").filter(f"p_size % {n} = 0").groupBy("p_brand").agg(F.collect_set("p_type").alias("tours"), F.collect_set(w).alias("words"))
    out = P.merged_state(side(2, F.col("p_name")), side(3, F.upper("p_name")), "p_brand", ["tours", "words"])
    return out.withColumns({"tours": F.array_join("tours", ","), "words": F.array_join("words", ",")})


@query("seen_names", """
SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN '' WHEN 2 THEN lower(p_type) ELSE CASE WHEN lower(p_type) < p_name THEN lower(p_type) || ',' || p_name ELSE p_name || ',' || lower(p_type) END END AS names FROM part""")
def seen_names(spark: SparkSession, d: str) -> DataFrame:
    kind, name = F.col("p_type"), F.col("p_name")
    value = _case("p_size", F.concat(F.lit('["'), name, F.lit('", " '), kind, F.lit('"]')), F.concat(F.lit('["'), kind, F.lit('","'), F.upper(F.replace(name, F.lit(" "), F.lit("  "))), F.lit('","'), kind, F.lit('", null]')), F.concat(F.lit('["'), kind, F.lit('", "", "  "]')), F.concat(F.lit('["'), kind))
    return table(spark, d, "part").select("p_partkey", F.array_join(P.names_in_json(value), ",").alias("names"))


@query("tournament_keys", r"""
WITH r AS (SELECT p_partkey, lower(p_name || ' ' || p_type || CASE WHEN p_size % 3 = 0 THEN ' open' WHEN p_size % 7 = 0 THEN ' masters' ELSE '' END) AS t FROM part),
n AS (SELECT *, list_filter(['hot', 'cold'], lambda x: regexp_matches(t, '\b' || x || '\b')) AS tours, list_filter(['ring', 'gear', 'bolt', 'small'], lambda x: regexp_matches(t, '\b' || x || '\b')) AS cities FROM r),
c AS (SELECT p_partkey, tours, tours[1] AS tour, CASE WHEN len(cities) > 0 THEN cities ELSE list_concat(CASE WHEN regexp_matches(t, '\bopen\b') AND coalesce(tours[1], 'hot') = 'hot' THEN ['ring'] ELSE [] END, CASE WHEN regexp_matches(t, '\bmasters\b') AND coalesce(tours[1], 'cold') = 'cold' THEN ['gear'] ELSE [] END) END AS found FROM n),
v AS (SELECT p_partkey, tours, tour, CASE WHEN tour IS NULL THEN found ELSE list_filter(found, lambda x: list_contains(CASE x WHEN 'ring' THEN ['hot', 'cold'] WHEN 'gear' THEN ['cold'] WHEN 'bolt' THEN ['hot'] ELSE ['hot', 'cold'] END, tour)) END AS chosen FROM c)
SELECT p_partkey, CASE WHEN len(tours) < 2 AND len(chosen) = 1 THEN CASE WHEN tour IS NOT NULL THEN tour || ' ' || chosen[1] WHEN chosen[1] = 'gear' THEN 'cold gear' WHEN chosen[1] = 'bolt' THEN 'hot bolt' END END AS key FROM v""")
def tournament_keys(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" "), "p_type", F.when(F.expr("p_size % 3 = 0"), F.lit(" Open")).when(F.expr("p_size % 7 = 0"), F.lit(" Masters")).otherwise(F.lit("")))
    key = R.tournament_key(text, {"ring": ["hot", "cold"], "gear": ["cold"], "bolt": ["hot"], "small": ["hot", "cold"]}, {"open": ["hot", "ring"], "masters": ["cold", "gear"]}, {"hot": ["hot"], "cold": ["cold"]})
    return table(spark, d, "part").select("p_partkey", key.alias("key"))


@query("miss_counts", """
WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'), m AS (SELECT l.l_orderkey, l.l_linenumber, CAST(l_quantity AS INTEGER) % 4 AS n, a.l_orderkey IS NOT NULL AS gone FROM lineitem l LEFT JOIN a ON a.l_orderkey = l.l_orderkey AND a.l_linenumber = l.l_linenumber)
SELECT l_orderkey, l_linenumber, n + CASE WHEN gone THEN 1 ELSE 0 END AS misses, gone AND n = 2 AS goes FROM m""")
def miss_counts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    marks = li.select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 4).alias("misses"))
    return S.count_misses(marks, li.filter("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"], "misses", 3)


@query("learnt_aliases", """
WITH n AS (SELECT DISTINCT c_mktsegment || c_nationkey AS alias, c_custkey % 40 AS team FROM customer WHERE c_custkey % 5 < 3), k AS (SELECT DISTINCT c_mktsegment || c_nationkey AS alias, c_custkey % 40 AS team FROM customer WHERE c_custkey % 5 > 1),
a AS (SELECT alias, count(DISTINCT team) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM k) GROUP BY 1)
SELECT lower(n.alias) AS alias, n.team, CASE WHEN a.n > 1 THEN 'quarantine' WHEN EXISTS (SELECT 1 FROM k WHERE k.alias = n.alias AND k.team = n.team) THEN 'known' ELSE 'learnt' END AS fate FROM n JOIN a USING (alias)""")
def learnt_aliases(spark: SparkSession, d: str) -> DataFrame:
    pairs = lambda test: table(spark, d, "customer").filter(test).select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("alias"), (F.col("c_custkey") % 40).alias("team"))
    return S.learnt_aliases(pairs("c_custkey % 5 < 3"), pairs("c_custkey % 5 > 1"), "alias", "team")


@query("review_queue", """
WITH a AS (SELECT l_orderkey, l_shipmode_ AS answer, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_shipmode_ DESC) AS rn FROM (SELECT l_orderkey, l_shipdate, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem WHERE l_quantity > 40))
SELECT o_orderkey, answer, CASE WHEN answer IS NOT NULL THEN 'answered' WHEN o_totalprice < 30000 THEN 'not asked: weak' WHEN o_custkey % 11 = 0 THEN 'not asked: known' WHEN o_orderpriority = '1-URGENT' THEN 'automatic: same' ELSE 'open' END AS state FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey AND rn = 1""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", F.concat("l_returnflag", "l_linestatus").alias("answer"))
    suppressed = F.when(F.col("o_totalprice") < 30000, F.lit("weak")).when(F.col("o_custkey") % 11 == 0, F.lit("known"))
    automatic = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("same"))
    return R.latest_answers(table(spark, d, "orders"), ["o_orderkey"], answers, "l_shipdate", automatic, suppressed).select("o_orderkey", "answer", "state")


@query("upsert_rules", """
WITH b AS (SELECT o_orderkey, o_totalprice > 20000 AS given, CASE WHEN o_custkey % 4 = 0 THEN 'Football' ELSE 'League ' || o_custkey % 9 END AS old_league, CASE o_orderkey % 3 WHEN 0 THEN ' football ' WHEN 2 THEN 'Cup ' || o_orderpriority END AS new_league, o_orderstatus, o_orderpriority, CASE WHEN o_custkey % 2 = 0 THEN 'Kyiv' ELSE 'Київ' END AS old_name, CASE o_orderkey % 3 WHEN 0 THEN 'Киев' WHEN 1 THEN 'Kiev' ELSE '' END AS new_name FROM orders)
SELECT o_orderkey, CASE WHEN NOT given THEN old_league WHEN trim(lower(coalesce(new_league, ''))) IN ('', 'football') AND lower(old_league) <> 'football' THEN old_league ELSE coalesce(new_league, old_league) END AS league, CASE WHEN given THEN o_orderstatus || ',' || o_orderpriority ELSE o_orderstatus END AS marks,
  CASE WHEN NOT given OR new_name = '' THEN old_name WHEN old_name = 'Kyiv' AND new_name = 'Киев' THEN old_name ELSE new_name END AS name FROM b""")
def upsert_rules(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    stored = o.select("o_orderkey", F.when(F.col("o_custkey") % 4 == 0, F.lit("Football")).otherwise(F.concat(F.lit("League "), (F.col("o_custkey") % 9).cast("string"))).alias("league"), F.array("o_orderstatus").alias("marks"), F.when(F.col("o_custkey") % 2 == 0, F.lit("Kyiv")).otherwise(F.lit("Київ")).alias("name"))
    league = F.when(F.expr("o_orderkey % 3 = 0"), F.lit(" football ")).when(F.expr("o_orderkey % 3 = 2"), F.concat(F.lit("Cup "), "o_orderpriority"))
    incoming = o.filter("o_totalprice > 20000").select("o_orderkey", league.alias("league"), F.array("o_orderpriority").alias("marks"), _case("o_orderkey", F.lit("Киев"), F.lit("Kiev"), F.lit("")).alias("name"))
    out = S.upsert(stored, incoming, ["o_orderkey"], {"league": S.specific_wins(["Football"]), "marks": S.marks_appended, "name": S.latin_wins})
    return out.select("o_orderkey", "league", F.array_join("marks", ",").alias("marks"), "name")


@query("honest_flags", "SELECT event_type, count(*) AS n, sum(CASE WHEN value > 50 AND (user_id % 3 <> 0 OR event_id % 4 = 0) THEN 1 ELSE 0 END) AS honest FROM events GROUP BY 1")
def honest_flags(spark: SparkSession, d: str) -> DataFrame:
    flag = R.honest_live(F.col("value") > 50, F.col("user_id") % 3 == 0, F.col("event_id") % 4 == 0)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(flag.cast("long")).alias("honest"))


def _full_verdicts(spark, d):
    lines = F.split("text", "\n", -1)
    line = lambda i: F.coalesce(F.get(lines, F.lit(i)), F.lit(""))
    return table(spark, d, "documents").select("doc_id", line(0).alias("title"), line(1).alias("signals"), line(2).alias("pair"))


FULL_SQL = VERDICT_SQL.split("SELECT doc_id, CASE", 1)[0].replace("AS signals FROM documents)", "AS signals, split_part(text, chr(10), 3) AS pair FROM documents)").replace("AS bare_signals FROM d)", r"AS bare_signals, regexp_replace(pair, '(?i)(^|[^\pL\pN_])this\s+is($|[^\pL\pN_])', '\1 \2', 'g') AS bare_pair FROM d)")
WORD_SQL = r"(?i)(^|[^\pL\pN_])({})($|[^\pL\pN_])"
FULL_SQL += f"""SELECT doc_id, CASE WHEN regexp_matches(bare, '{WORD_SQL.format("this|avec")}') OR regexp_matches(title, '(?i)(^|[^a-z0-9])s[0-9]{{1,3}}\\s?e[0-9]{{1,4}}($|[^a-z0-9])') THEN 'stop title'
  WHEN len(list_filter(regexp_split_to_array(title, '\\s[|:–-]\\s'), lambda x: regexp_matches(regexp_extract(x, '^\\s*(\\S+)', 1), '{WORD_SQL.format("In|Of")}'))) > 0 THEN 'lead show' WHEN regexp_matches(bare_signals, '{WORD_SQL.format("scum|idiot")}') THEN 'stop genre' WHEN regexp_matches(signals, '{WORD_SQL.format("and|und")}') THEN 'not live'
  WHEN regexp_matches(bare_pair, '{WORD_SQL.format("this|avec")}') THEN 'stop in pair' WHEN NOT regexp_matches(signals || ' ' || title, '{WORD_SQL.format("the|der|les|que")}') THEN 'no live marker' ELSE 'ok' END AS reason FROM k"""


@query("live_reasons", FULL_SQL)
def live_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The live verdict of every document's title, signals and pair field (its first lines)."""
    return _full_verdicts(spark, d).select("doc_id", C.live_reason(F.col("title"), F.col("signals"), F.col("pair"), MARKERS, need_pair=False).alias("reason"))


@query("sifted_rows", f"SELECT reason, count(*) AS n, min(doc_id) AS example FROM ({FULL_SQL}) GROUP BY 1")
def sifted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Kept rows, and removed ones by reason with an example."""
    kept, removed = C.sift(_full_verdicts(spark, d), C.live_reason(F.col("title"), F.col("signals"), F.col("pair"), MARKERS, need_pair=False))
    both = kept.select("doc_id", F.lit("ok").alias("reason")).unionByName(removed.select("doc_id", "reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("example"))


@query("classified_rows", r"""
WITH r AS (SELECT p_partkey, upper(p_brand) AS channel, CASE p_size % 5 WHEN 0 THEN 'Live: ' || p_name WHEN 1 THEN 'Winner of ' || p_name WHEN 2 THEN p_brand ELSE p_name END AS home, p_type AS away, CASE WHEN p_size % 7 <> 0 THEN DATE '2024-01-01' + CAST(p_size AS INTEGER) END AS day, CASE WHEN p_name LIKE '%ring' THEN 'R' WHEN p_name LIKE '%bolt' THEN 'B' END AS sport, p_name FROM part),
t AS (SELECT *, trim(regexp_replace(home, '(?i)^\s*live:\s+', '')) AS h FROM r)
SELECT p_partkey, h AS home, CASE WHEN regexp_matches(p_name, '\bold\b') THEN 'stop title' WHEN regexp_matches(h, '^Winner of') THEN 'no opponent' WHEN lower(h) = lower(channel) AND away <> 'PROMO' THEN 'own channel' WHEN sport IS NULL THEN 'unknown sport' WHEN day IS NULL THEN 'no time' WHEN day < DATE '2024-01-14' THEN 'past' ELSE 'ok' END AS verdict FROM t""")
def classified_rows(spark: SparkSession, d: str) -> DataFrame:
    """All stages of the row classification, each row with its first exit."""
    name, size = F.col("p_name"), F.col("p_size")
    home = _case("p_size", F.concat(F.lit("Live: "), name), F.concat(F.lit("Winner of "), name), F.col("p_brand"), name, name)
    day = F.when(size % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), size.cast("int")))
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.upper("p_brand").alias("channel"), home.alias("home"), F.col("p_type").alias("away"), day.alias("day"))
    m = C.Markers(live=["ring", "bolt", "rod", "gear", "anvil", "plate", "gizmo", "widget"], stop_titles=["old"])
    reason = C.live_reason(name, F.lit(""), F.lit(""), m, need_pair=False)
    sport = F.when(name.endswith("ring"), F.lit("R")).when(name.endswith("bolt"), F.lit("B"))
    out = R.classified(rows, reason, [], sport, spark.createDataFrame([("PROMO",)], "team string"), "team", F.lit("2024-01-15").cast("date"))
    return out.select("p_partkey", "home", "verdict")


@query("audit_unread_flags", r"""
WITH p AS (SELECT regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS host, html FROM pages), s AS (SELECT regexp_replace(host, '^www\.', '') AS site, html FROM p),
c AS (SELECT site, 'item' AS sign, sum(len(regexp_extract_all(html, '<li>'))) AS n FROM s GROUP BY 1 UNION ALL SELECT site, 'script', sum(len(regexp_extract_all(html, 'track\('))) FROM s GROUP BY 1)
SELECT site, sign, CAST(n AS BIGINT) AS n FROM c WHERE n >= 3 AND site NOT IN (SELECT site FROM s WHERE contains(html, 'lang="en"'))""")
def audit_unread_flags(spark: SparkSession, d: str) -> DataFrame:
    from broadloom.functions.text import domain

    pages = table(spark, d, "pages").select(domain(F.col("url")).alias("site"), "html")
    return R.unread_flags(pages, "site", "html", {"item": "<li>", "script": r"track\("}, pages.filter(F.col("html").contains('lang="en"')), "site")


@query("audit_unknown_words", r"""
WITH w AS (SELECT source, unnest(string_split(trim(regexp_replace(lower(text), '[^\pL\pN]+', ' ', 'g')), ' ')) AS word FROM documents), b AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(text), '[^\pL\pN]+', ' ', 'g')), ' ')) AS word FROM benchmark)
SELECT source, word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN (SELECT word FROM b) GROUP BY 1, 2 HAVING count(*) >= 3""")
def audit_unknown_words(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = table(spark, d, "benchmark").select(F.explode(F.split(R.plain(F.col("text")), " ")).alias("word"))
    return R.unknown_words(table(spark, d, "documents"), "source", "text", vocabulary, "word")


@query("audit_stop_in_name", """
SELECT site, word, count(*) AS n FROM (SELECT DISTINCT a.event_id, a.user_id % 20 AS site, a.event_type AS word FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 10800000000 WHERE a.event_type IN ('error', 'view')) GROUP BY 1, 2""")
def audit_stop_in_name(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.filter("event_type IN ('error', 'view')").select("user_id", "ts", (F.col("user_id") % 20).alias("site"), F.col("event_type").alias("word"))
    return R.stopped_but_known(rows, e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("ref_ts")), ["user_id"], "ts", "ref_ts", "site", "word")


@query("audit_women_leagues", """
WITH e AS (SELECT event_id, user_id, user_id % 6 AS site, ts, CASE WHEN event_id % 3 = 0 THEN 'Liga ' || event_id % 2 ELSE 'Liga ' || event_id % 2 || ' Women' END AS league FROM events)
SELECT site, league, count(*) AS n FROM (SELECT DISTINCT a.event_id, a.site, a.league FROM e a JOIN e b ON a.user_id = b.user_id AND NOT contains(a.league, 'Women') AND b.league = a.league || ' Women' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 1800000000) GROUP BY 1, 2""")
def audit_women_leagues(spark: SparkSession, d: str) -> DataFrame:
    league = F.concat(F.lit("Liga "), (F.col("event_id") % 2).cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit(" Women")))
    e = table(spark, d, "events").select("user_id", (F.col("user_id") % 6).alias("site"), "ts", league.alias("league"))
    reference = e.select("user_id", F.col("ts").alias("ref_ts"), F.col("league").alias("ref_league"))
    return R.unmarked_women(e, reference, ["user_id"], "ts", "ref_ts", "site", "league", "ref_league")


@query("audit_loss_step", """
WITH li AS (SELECT l_orderkey, max(l_quantity) AS q, bool_or(l_returnflag = 'R') AS r, bool_or(l_discount > 0.05) AS d FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN li.l_orderkey IS NULL THEN 'read' WHEN q <= 30 THEN 'sifted' WHEN NOT r THEN 'matched' WHEN NOT d THEN 'stored' END AS lost_at FROM orders LEFT JOIN li ON l_orderkey = o_orderkey""")
def audit_loss_step(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    steps = [("read", li), ("sifted", li.filter("l_quantity > 30")), ("matched", li.filter("l_returnflag = 'R'")), ("stored", li.filter("l_discount > 0.05"))]
    return R.loss_step(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], steps)
