"""Trims by a book that the parts teach, and over pairs of the reference."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators import trims as T
from broadloom.plans.catalog import query
from broadloom.sources.tables import table

BOOK_SQL = """
WITH c AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'home' ELSE 'away' END AS side, CASE p_partkey % 5 WHEN 0 THEN 'Live' WHEN 1 THEN 'cup  Final' WHEN 2 THEN 'Brand' || p_size ELSE p_type || ' ' || p_size END AS phrase, CASE WHEN p_partkey % 3 > 0 THEN 'l' || (p_size % 4) END AS lang, p_name || CASE WHEN p_size % 2 = 0 THEN ' U19' ELSE '' END AS team, p_partkey % 11 = 0 AS by_person FROM part),
g AS (SELECT side, lower(array_to_string(list_filter(string_split_regex(phrase, '\\s+'), lambda w: w <> ''), ' ')) AS phrase, bool_or(by_person) AS p, count(DISTINCT replace(lower(team), ' u19', '')) AS n, bool_or(lang IS NULL) AS anyl, list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL)) AS langs FROM c GROUP BY 1, 2),
b AS (SELECT side, phrase, CASE WHEN NOT anyl THEN langs END AS langs FROM g WHERE p OR n >= 2)"""


def _rules(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    n = size.cast("string")
    phrase = F.when(k % 5 == 0, "Live").when(k % 5 == 1, "cup  Final").when(k % 5 == 2, F.concat(F.lit("Brand"), n)).otherwise(F.concat("p_type", F.lit(" "), n))
    cuts = table(spark, d, "part").select(F.when(k % 2 == 0, "home").otherwise("away").alias("side"), phrase.alias("phrase"), F.when(k % 3 > 0, F.concat(F.lit("l"), (size % 4).cast("string"))).alias("lang"), F.concat("p_name", F.when(size % 2 == 0, " U19").otherwise("")).alias("team"), (k % 11 == 0).alias("by_person"))
    return T.book_rules(cuts)


@query("book_rules", BOOK_SQL + " SELECT side, phrase, array_to_string(langs, ',') AS langs FROM b")
def book_rules(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).select("side", "phrase", F.array_join("langs", ",").alias("langs"))


@query("trim_by_book", BOOK_SQL + """,
r AS (SELECT l_orderkey * 10 + l_linenumber AS id, row_number() OVER () AS x, l_orderkey, l_suppkey, l_linenumber, p_name, p_type, p_size FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, l_linenumber AS l, CASE l_orderkey % 4 WHEN 0 THEN 'LIVE ' || p_name WHEN 1 THEN p_type || ' ' || p_size || ' ' || p_name WHEN 2 THEN 'Brand' || p_size || ' cup' ELSE p_name END AS home, CASE l_suppkey % 3 WHEN 0 THEN p_name || ' Cup final' WHEN 1 THEN p_name || ' brand' || p_size ELSE 'x' END AS away, CASE WHEN l_linenumber % 3 > 0 THEN ['l' || (l_linenumber % 4)] END AS langs FROM r),
i AS (SELECT *, string_split(home, ' ') AS h, string_split(away, ' ') AS a FROM s),
fit AS (SELECT o, s, l, home, away, any_value(h) AS h, any_value(a) AS a, max(CASE WHEN b.side = 'home' THEN len(string_split(b.phrase, ' ')) ELSE 0 END) AS k, max(CASE WHEN b.side = 'away' THEN len(string_split(b.phrase, ' ')) ELSE 0 END) AS m FROM i JOIN b ON (b.side = 'home' AND starts_with(lower(home) || ' ', b.phrase || ' ') AND len(string_split(b.phrase, ' ')) < len(h) OR b.side = 'away' AND ends_with(' ' || lower(away), ' ' || b.phrase) AND len(string_split(b.phrase, ' ')) < len(a)) AND (b.langs IS NULL OR i.langs IS NULL OR list_has_any(b.langs, i.langs)) GROUP BY o, s, l, home, away, i.langs),
f AS (SELECT array_to_string(h[k + 1:], ' ') AS home, array_to_string(a[:len(a) - m], ' ') AS away, concat_ws(' … ', nullif(array_to_string(h[:k], ' '), ''), nullif(array_to_string(a[len(a) - m + 1:], ' '), '')) AS cut, o, s, l FROM fit)
SELECT o, s, l, home, away, cut FROM f WHERE regexp_matches(home, '\\p{L}{2}') AND regexp_matches(away, '\\p{L}{2}')""")
def trim_by_book(spark: SparkSession, d: str) -> DataFrame:
    o, s, ln, n = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("p_size").cast("string")
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    home = F.when(o % 4 == 0, F.concat(F.lit("LIVE "), "p_name")).when(o % 4 == 1, F.concat("p_type", F.lit(" "), n, F.lit(" "), "p_name")).when(o % 4 == 2, F.concat(F.lit("Brand"), n, F.lit(" cup"))).otherwise(F.col("p_name"))
    away = F.when(s % 3 == 0, F.concat("p_name", F.lit(" Cup final"))).when(s % 3 == 1, F.concat("p_name", F.lit(" brand"), n)).otherwise("x")
    line = F.col("id.l")
    langs = F.when(line % 3 > 0, F.array(F.concat(F.lit("l"), (line % 4).cast("string"))))
    rows = rows.select(F.struct(o.alias("o"), s.alias("s"), ln.alias("l"), home.alias("home"), away.alias("away")).alias("id")).distinct().select("id", "id.home", "id.away", langs.alias("langs"))
    out = T.trim_by_book(rows, _rules(spark, d), "id", "home", "away", "langs")
    return out.select("id.o", "id.s", "id.l", "home", "away", "cut")


@query("trim_over_pair", """
WITH p AS (SELECT o_orderkey AS ref, 'Club ' || (o_custkey % 400) AS home, 'Team ' || (o_orderkey % 300) AS away, epoch_us(o_orderdate) // 1000000 AS t FROM orders),
r AS (SELECT ref AS id, CASE ref % 5 WHEN 0 THEN home WHEN 1 THEN 'Live: ' || home WHEN 2 THEN 'Cup of ' || home ELSE 'a b c d ' || home END AS home, CASE WHEN ref % 3 = 0 THEN away || ' - live' ELSE upper(away) END AS away, t + (ref % 7 - 3) * 3600 AS t FROM p),
h AS (SELECT id, ref, CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS k, CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS m, p.home, CASE WHEN id % 3 = 0 THEN p.away ELSE upper(p.away) END AS away FROM r JOIN p ON abs(r.t - p.t) <= 10800 AND ends_with(r.home, p.home) AND (r.away = p.away || ' - live' OR lower(r.away) = lower(p.away)) AND (r.home = p.home OR ends_with(r.home, ' ' || p.home)))
SELECT id, min(ref) AS ref, min(home) AS home, min(away) AS away, min(CASE WHEN id % 3 = 0 THEN k + 1 ELSE k + m END) AS cut FROM h WHERE k <= 3 GROUP BY id HAVING count(DISTINCT ref) = 1 AND min(k + m) > 0""")
def trim_over_pair(spark: SparkSession, d: str) -> DataFrame:
    """Of ' - live' the word is cut and the dash goes with the edge."""
    k = F.col("ref")
    pairs = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), F.concat(F.lit("Club "), (F.col("o_custkey") % 400).cast("string")).alias("home"), F.concat(F.lit("Team "), (F.col("o_orderkey") % 300).cast("string")).alias("away"), F.col("o_orderdate").alias("start"))
    home = F.when(k % 5 == 0, F.col("home")).when(k % 5 == 1, F.concat(F.lit("Live: "), "home")).when(k % 5 == 2, F.concat(F.lit("Cup of "), "home")).otherwise(F.concat(F.lit("a b c d "), "home"))
    away = F.when(k % 3 == 0, F.concat("away", F.lit(" - live"))).otherwise(F.upper("away"))
    rows = pairs.select(k.alias("id"), home.alias("home"), away.alias("away"), F.timestamp_seconds(F.unix_seconds(F.col("start").cast("timestamp")) + (k % 7 - 3) * 3600).alias("at"))
    return T.trim_over_pair(rows, pairs, "id", "home", "away", "at")
