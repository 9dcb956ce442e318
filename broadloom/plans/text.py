"""Text queries: verdicts, pairs, labels and page readers over documents, parts and pages.

On the SQL side the expressions have no look-around, so whole words are tested with explicit
borders there."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.functions import text as X
from broadloom.operators import classify as C
from broadloom.plans.catalog import query
from broadloom.sources import pages as P
from broadloom.sources.tables import table

#: A small vocabulary in the words of the test corpus.
MARKERS = C.Markers(live=["the", "der", "les", "que"], not_live=["and", "und"], stop_titles=["this", "avec"], stop_genres=["scum", "idiot"], lead_shows=["In", "Of"], keep=["this is"])


def _w(words: list[str]) -> str:
    return r"(?i)(^|[^\pL\pN_])(" + "|".join(words) + r")($|[^\pL\pN_])"


VERDICT_SQL = rf"""
WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 2) ELSE '' END AS signals FROM documents),
k AS (SELECT *, regexp_replace(title, '(?i)(^|[^\pL\pN_])this\s+is($|[^\pL\pN_])', '\1 \2', 'g') AS bare, regexp_replace(signals, '(?i)(^|[^\pL\pN_])this\s+is($|[^\pL\pN_])', '\1 \2', 'g') AS bare_signals FROM d)
SELECT doc_id, CASE
  WHEN regexp_matches(bare, '{_w(["this", "avec"])}') THEN 'stop title'
  WHEN regexp_matches(regexp_extract(title, '^\s*(\S+)', 1), '{_w(["In", "Of"])}') THEN 'lead show'
  WHEN regexp_matches(bare_signals, '{_w(["scum", "idiot"])}') THEN 'stop genre'
  WHEN regexp_matches(signals, '{_w(["and", "und"])}') THEN 'not live'
  WHEN NOT regexp_matches(signals || ' ' || title, '{_w(["the", "der", "les", "que"])}') THEN 'no live marker' ELSE 'ok' END AS reason FROM k"""


@query("live_verdict_cascade", VERDICT_SQL)
def live_verdict_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The operator judges a grid row by two short fields, title and signals; a document's first
    and second line stand in for them, and its further lines for no field of a row."""
    lines = F.split("text", "\n", -1)
    rows = table(spark, d, "documents").select("doc_id", lines[0].alias("title"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("signals"))
    m = C.Markers(live=MARKERS.live, not_live=MARKERS.not_live, stop_titles=MARKERS.stop_titles, stop_genres=MARKERS.stop_genres, keep=MARKERS.keep)
    lead = X.has_word(F.regexp_extract("title", r"^\s*(\S+)", 1), MARKERS.lead_shows)
    rules = [("stop title", X.has_word(F.col("title"), m.stop_titles, m.keep)), ("lead show", lead), ("stop genre", X.has_word(F.col("signals"), m.stop_genres, m.keep)), ("not live", X.has_word(F.col("signals"), m.not_live)), ("no live marker", ~X.has_word(F.concat_ws(" ", "signals", "title"), m.live))]
    return rows.select("doc_id", C.cascade(rules, "ok").alias("reason"))


@query("pair_split", r"""
WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' - ' || p_type WHEN 1 THEN 'LIVE: ' || p_name || ' vs ' || p_brand WHEN 2 THEN p_name || ' (W) x ' || p_brand || ' (W)' WHEN 3 THEN p_name || ' - ' || p_name ELSE p_name || '-' || p_brand END AS title FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '|' || p_type WHEN 1 THEN p_name || '|' || p_brand WHEN 2 THEN p_name || '|' || p_brand ELSE '' END AS pair FROM t JOIN part USING (p_partkey)""")
def pair_split(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    title = F.when(k == 0, F.concat("p_name", F.lit(" - "), "p_type")).when(k == 1, F.concat(F.lit("LIVE: "), "p_name", F.lit(" vs "), "p_brand")).when(k == 2, F.concat("p_name", F.lit(" (W) x "), "p_brand", F.lit(" (W)"))).when(k == 3, F.concat("p_name", F.lit(" - "), "p_name")).otherwise(F.concat("p_name", F.lit("-"), "p_brand"))
    rows = table(spark, d, "part").select("p_partkey", title.alias("title"))
    return rows.select("p_partkey", F.coalesce(F.array_join(X.pair_sides(F.col("title")), "|"), F.lit("")).alias("pair"))


@query("league_clean", r"""
SELECT p_partkey, p_name AS league FROM part""")
def league_clean(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, F.concat(F.lit("Football: "), "p_name", F.lit(" 2024/25"))).when(k == 1, F.concat("p_name", F.lit(", Round 12 of 38"))).when(k == 2, F.concat(F.lit("TENNIS - "), "p_name", F.lit(" (live)"))).otherwise(F.concat("p_name", F.lit(" 2023 - ")))
    rows = table(spark, d, "part").select("p_partkey", label.alias("label"))
    return rows.select("p_partkey", X.clean_league(F.col("label"), ["football", "tennis"]).alias("league"))


@query("name_category", r"""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'U19' WHEN 1 THEN 'W' WHEN 2 THEN 'B' WHEN 3 THEN 'U21 W' WHEN 4 THEN 'W' ELSE '' END AS category FROM part""")
def name_category(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, F.concat("p_name", F.lit(" U-19"))).when(k == 1, F.concat("p_name", F.lit(" (W)"))).when(k == 2, F.concat("p_name", F.lit(" II"))).when(k == 3, F.concat(F.lit("Women "), "p_name", F.lit(" Under 21"))).when(k == 4, F.concat("p_name", F.lit(" Ladies"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.category(name).alias("category"))


@query("auto_english", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name, '(^| )small ring($| )', '\\1little ring\\2'), '(^| )red($| )', '\\1rouge\\2'), '(^| )bolt($| )', '\\1boulon\\2') AS name FROM part")
def auto_english(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.translated(F.col("p_name"), {"red": "rouge", "bolt": "boulon", "small ring": "little ring"}).alias("name"))


@query("label_keys", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' ' || p_brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def label_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("page_kinds", r"""
WITH u AS (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1), '^www\.', '') AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT host || regexp_replace(path, '[0-9]+', '0', 'g') AS kind, count(*) AS n FROM u GROUP BY 1""")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(X.page_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query("page_links", r"""
WITH a AS (SELECT url, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>.*?</a\s*>', 1) AS h FROM pages)
SELECT url, count(*) AS pages, CAST(sum(len(h)) AS BIGINT) AS n_links, min(array_to_string(h, ' ')) AS hrefs FROM a WHERE len(h) > 0 GROUP BY url""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.concat_ws("\t", F.col("page_id").cast("string"), "url").alias("url"), "html")
    found = P.links(pages).groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda x: x["href"]), " ").alias("hrefs"), F.count("*").alias("n"))
    per = found.select(F.split("url", "\t")[1].alias("url"), "hrefs", "n")
    return per.groupBy("url").agg(F.count("*").alias("pages"), F.sum("n").alias("n_links"), F.min("hrefs").alias("hrefs"))


@query("same_page_hash", r"SELECT md5(regexp_extract(html, '<article>(.*?)</article>', 1, 's')) AS h, count(*) AS n, min(url) AS first_url FROM pages GROUP BY 1 HAVING count(DISTINCT url) >= 2")
def same_page_hash(spark: SparkSession, d: str) -> DataFrame:
    """Identical articles on different addresses."""
    article = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    rows = table(spark, d, "pages").select(F.md5(article.cast("binary")).alias("h"), "url")
    return rows.groupBy("h").agg(F.count("*").alias("n"), F.min("url").alias("first_url"), F.countDistinct("url").alias("u")).filter("u >= 2").drop("u")


@query("page_time_marks", r"""
WITH x AS (SELECT event_id, strftime(ts, '%H:%M') || ' ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' 21h10' WHEN event_id % 3 = 1 THEN ' 9.05 x' ELSE ' 27:10' END AS line FROM events)
SELECT event_id, CAST(split_part(line, ':', 1) AS INTEGER) * 60 + CAST(substr(line, 4, 2) AS INTEGER) AS first_minute, CASE event_id % 3 WHEN 0 THEN 1270 WHEN 1 THEN 545 ELSE -1 END AS second_minute FROM x""")
def page_time_marks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    line = F.concat(F.date_format("ts", "HH:mm"), F.lit(" "), "event_type", F.when(k == 0, " 21h10").when(k == 1, " 9.05 x").otherwise(" 27:10"))
    rows = table(spark, d, "events").select("event_id", X.clock_times(line).alias("t"))
    return rows.select("event_id", F.get("t", F.lit(0)).alias("first_minute"), F.coalesce(F.get("t", F.lit(1)), F.lit(-1)).alias("second_minute"))


@query("timed_page_lines", r"""
WITH x AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS minute, event_type AS title FROM events WHERE event_type <> 'error')
SELECT 'tv' || user_id || '.example.com' AS site, 'http://www.tv' || user_id || '.example.com/' || day AS url, CAST(minute AS INTEGER) AS minute, title FROM x""")
def timed_page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Grid pages are made from the event log, then read back by the fallback reader."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    line = F.struct("event_id", F.concat(F.lit("<li><b>"), F.when(F.col("event_type") == "error", F.lit("later")).otherwise(F.date_format("ts", "HH:mm")), F.lit("</b> "), "event_type", F.lit("</li>")).alias("li"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["li"]), "")
    pages = e.groupBy("user_id", "day").agg(F.concat(F.lit("<html><script>var t='10:00 no';</script><!-- 11:00 no --><ul>"), body, F.lit("</ul></html>")).alias("html"))
    pages = pages.select(F.concat(F.lit("http://www.tv"), F.col("user_id").cast("string"), F.lit(".example.com/"), "day").alias("url"), "html")
    return P.timed_lines(pages).select("site", "url", "minute", "title")


@query("json_page_records", r"""
SELECT user_id, event_id AS start_id, event_type AS title FROM events WHERE event_type <> 'error'""")
def json_page_records(spark: SparkSession, d: str) -> DataFrame:
    """Nested JSON bodies are made from the log and searched for records with start and title."""
    e = table(spark, d, "events")
    item = F.struct(F.col("event_id").alias("start"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("name"))
    body = F.to_json(F.struct(F.struct(F.collect_list(item).alias("rows")).alias("data"), F.lit(1).alias("start")))
    pages = e.groupBy("user_id").agg(body.alias("body")).select(F.col("user_id").cast("string").alias("url"), "body")
    out = P.json_records(pages, "body", ["start"], ["name", "title"])
    return out.select(F.col("url").cast("long").alias("user_id"), F.col("start").cast("long").alias("start_id"), "title")


@query("parse_scores", r"""
WITH p AS (SELECT source AS key, CASE WHEN doc_id % 4 <> 0 THEN 1 END AS minute, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS title, doc_id % 5 = 0 AS is_pair, CASE WHEN source > 'src5' THEN 'x' END AS channel FROM documents),
g AS (SELECT key, count(*) AS n, sum(CASE WHEN minute IS NOT NULL THEN 1 ELSE 0 END) AS t, sum(CASE WHEN title <> '' THEN 1 ELSE 0 END) AS w, sum(CASE WHEN is_pair THEN 1 ELSE 0 END) AS p, max(channel) AS c FROM p GROUP BY key)
SELECT key, CAST(floor((50.0 * t / n + 30.0 * w / n + least(10, p) + CASE WHEN c IS NOT NULL THEN 10 ELSE 0 END) / CASE WHEN n < 5 THEN 2 ELSE 1 END + 1e-9) AS BIGINT) AS score, n AS rows_n FROM g""")
def parse_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("key"), F.when(F.col("doc_id") % 4 != 0, 1).alias("minute"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("title"), (F.col("doc_id") % 5 == 0).alias("is_pair"), F.when(F.col("source") > "src5", "x").alias("channel"))
    return P.parse_score(rows, "key")


@query("crawl_plan", "SELECT s_suppkey, 'http://s' || s_suppkey || '.example.com/' || strftime(x.day, '%Y-%m-%d') || '/' || strftime(x.day, '%d.%m.%Y') || '?u=' || CAST(epoch(x.day) AS BIGINT) || '&w=' || lower(strftime(x.day, '%A')) AS target FROM supplier, (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-02-27', TIMESTAMP '2024-03-02', INTERVAL 1 DAY)) AS TIMESTAMP) AS day) x WHERE s_acctbal > 0")
def crawl_plan(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey", F.concat(F.lit("http://s"), F.col("s_suppkey").cast("string"), F.lit(".example.com/{date}/{dmy}?u={unix}&w={weekday}")).alias("url"))
    return P.crawl_plan(s, F.lit("2024-02-27").cast("date"), 5).select("s_suppkey", "target")


@query("log_lines", r"""
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error')
SELECT 'u' || user_id AS ip, CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END AS method, CASE WHEN k % 2 = 0 THEN 'v' || k ELSE '' END AS vid, count(*) AS n FROM e GROUP BY 1, 2, 3""")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Log lines of 12, 8 and (dropped) 9 fields are written from the events and read."""
    k = F.get_json_object("props", "$.k").cast("long")
    eight = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.when(F.col("event_type") == "signup", "POST").otherwise("GET"), F.lit("/"), F.lit("200"), F.lit(""), F.col("event_type"), F.lit("agent")]
    long = F.concat_ws("\t", *eight, F.concat(F.lit("v"), k.cast("string")), F.lit(""), F.lit(""), F.lit("en"))
    line = F.when(F.col("event_type") == "error", F.concat_ws("\t", *eight, F.lit("x"))).when(k % 2 == 0, long).otherwise(F.concat_ws("\t", *eight))
    return P.split_log(table(spark, d, "events").select(line.alias("value"))).groupBy("ip", "method", "vid").agg(F.count("*").alias("n"))


@query("beacon_clamps", r"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE least(60, CAST(floor(value) AS INTEGER)) END AS secs, 100 AS acts FROM events")
def beacon_clamps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    secs = F.when(F.col("event_id") % 7 == 0, F.lit("junk")).otherwise(F.floor("value").cast("string"))
    lines = e.select(F.concat_ws("\t", F.lit("t"), F.col("event_id").cast("string"), F.lit("p"), secs, F.lit("4000")).alias("value"))
    return P.split_beacons(lines).select(F.col("vid").cast("long").alias("event_id"), "secs", "acts")


@query("agent_kinds", r"""
WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Mozilla/5.0 (Linux; Android 14)' WHEN 1 THEN 'Googlebot/2.1' WHEN 2 THEN 'curl/8.0' WHEN 3 THEN '' ELSE 'Mozilla/5.0 (iPhone)' END AS agent FROM events)
SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'bot' WHEN 2 THEN 'tool' WHEN 3 THEN 'empty' ELSE 'browser' END AS kind FROM a""")
def agent_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    agent = F.when(k == 0, "Mozilla/5.0 (Linux; Android 14)").when(k == 1, "Googlebot/2.1").when(k == 2, "curl/8.0").when(k == 3, "").otherwise("Mozilla/5.0 (iPhone)")
    rules = [("empty", r"^\s*$"), ("bot", r"(?i)bot|crawl|spider"), ("tool", r"(?i)^(curl|wget|python|go-http)"), ("browser", "^Mozilla/")]
    return table(spark, d, "events").select("event_id", X.first_match(agent, rules, "odd").alias("kind"))


@query("now_flag_sites", """
WITH e AS (SELECT user_id AS site, CAST(ts AS DATE) AS day, event_type = 'signup' AND (user_id % 4 = 0 OR CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events WHERE event_type = 'signup' AND user_id % 4 <> 0)) AS flag FROM events)
SELECT site, CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) AS BIGINT) AS flags FROM e GROUP BY site
HAVING sum(CASE WHEN flag THEN 1 ELSE 0 END) >= 1 AND sum(CASE WHEN flag AND day <> (SELECT max(CAST(ts AS DATE)) FROM events WHERE event_type = 'signup' AND user_id % 4 <> 0) THEN 1 ELSE 0 END) = 0 AND count(DISTINCT day) > 1""")
def now_flag_sites(spark: SparkSession, d: str) -> DataFrame:
    """The crawl is on the last day with a flag; one site in four states its flag on any day."""
    e = table(spark, d, "events").select(F.col("user_id").alias("site"), F.to_date("ts").alias("day"), "event_type")
    honest = F.col("site") % 4 == 0
    crawl = e.filter((F.col("event_type") == "signup") & ~honest).agg(F.max("day")).scalar()
    e = e.withColumn("flag", (F.col("event_type") == "signup") & (honest | (F.col("day") == crawl)))
    return C.now_flag_sites(e, "site", "day", "flag", crawl, least=1)


@query("sport_decision", """
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'G' WHEN p_size % 5 = 0 THEN 'R' WHEN p_size % 3 = 0 THEN 'O' WHEN p_size % 2 = 0 THEN 'L' ELSE '-' END AS sport,
  CASE WHEN p_size % 7 = 0 THEN 1 WHEN p_size % 5 = 0 THEN 2 WHEN p_size % 3 = 0 THEN 5 WHEN p_size % 2 = 0 THEN 6 ELSE 10 END AS rule FROM part""")
def sport_decision(spark: SparkSession, d: str) -> DataFrame:
    on = lambda n, v: F.when(F.col("p_size") % n == 0, F.lit(v))
    none = F.lit(None).cast("string")
    s = C.sport_decision(on(7, "G"), on(5, "R"), none, on(3, "O"), on(2, "L"), none)
    return table(spark, d, "part").select("p_partkey", s["sport"].alias("sport"), s["rule"].alias("rule"))
