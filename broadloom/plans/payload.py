"""Queries of payload functions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.functions import payload as P
from broadloom.plans.catalog import query
from broadloom.sources.tables import table


@query("unflattened_payloads", "SELECT event_id, event_type AS title, user_id AS channel FROM events")
def unflattened_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Index-array payloads are written from the log and read back."""
    body = F.concat(F.lit('[{"rows":1},[2],{"t":3,"c":4},"'), F.col("event_type"), F.lit('",'), F.col("user_id").cast("string"), F.lit("]"))
    e = table(spark, d, "events").select("event_id", P.unflattened(body).alias("j"))
    row = F.from_json("j", "struct<rows array<struct<t string, c long>>>")["rows"][0]
    return e.select("event_id", row["t"].alias("title"), row["c"].alias("channel"))


@query("cell_labels", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type END AS label FROM part")
def cell_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    cell = F.when(k == 0, F.concat(F.lit('<td class="a" data-channel=" '), "p_name", F.lit(' " title="no"><b>x</b></td>'))).when(k == 1, F.concat(F.lit('<td><img alt="'), "p_brand", F.lit('"/></td>'))).when(k == 2, F.concat(F.lit("<td> <b>"), "p_type", F.lit("</b>\n</td>"))).otherwise(F.lit("<td> </td>"))
    return table(spark, d, "part").select("p_partkey", P.cell_label(cell).alias("label"))


@query("page_states", r"""
SELECT CASE WHEN len(regexp_extract_all(html, '[^0-9:]([01]?[0-9]|2[0-3]):[0-5][0-9][^0-9:]')) >= 3 THEN 'schedule' WHEN regexp_matches(html, '(?i)(captcha|checking your browser|access denied|attention required)') THEN 'protected' ELSE 'no schedule' END AS state, count(*) AS n FROM pages GROUP BY 1""")
def page_states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(P.page_state(F.col("html")).alias("state")).agg(F.count("*").alias("n"))


@query("moved_candidates", "SELECT s_suppkey, 'https://new' || s_suppkey || '.org/tv' AS href FROM supplier WHERE s_suppkey % 3 <> 0")
def moved_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    own = F.concat(F.lit("http://old"), F.col("s_suppkey").cast("string"), F.lit(".com/"))
    links = s.select(own.alias("url"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.concat(own, F.lit("tv")).alias("href"), F.lit("tv").alias("label")), F.struct(F.lit(1).alias("pos"), F.lit("https://ads.net/x").alias("href"), F.lit("buy").alias("label")), F.struct(F.lit(2).alias("pos"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("https://new"), F.col("s_suppkey").cast("string"), F.lit(".org/tv"))).otherwise(F.lit("/tv")).alias("href"), F.lit("we moved").alias("label")))).alias("x")).select("url", "x.*")
    out = P.moved_candidates(links, F.col("url"), ["moved", "tv"])
    return out.select(F.regexp_extract("url", r"old([0-9]+)", 1).cast("long").alias("s_suppkey"), "href")


@query("suggested_names", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' FC II' AS name FROM part")
def suggested_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", P.suggested_name(F.concat("p_name", F.lit("  fc ii"))).alias("name"))


@query("abbreviations", "SELECT p_partkey, p_partkey % 3 <> 2 AS is_short FROM part")
def abbreviations(spark: SparkSession, d: str) -> DataFrame:
    words, k = F.split("p_name", " "), F.col("p_partkey") % 3
    initials = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    starts = F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 2), F.lit("."))), " ")
    return table(spark, d, "part").select("p_partkey", P.abbreviates(F.when(k == 0, initials).when(k == 1, starts).otherwise(F.lit("zz")), F.col("p_name")).alias("is_short"))


@query("foreign_words", "SELECT p_partkey, 'odd' AS words FROM part")
def foreign_words(spark: SparkSession, d: str) -> DataFrame:
    side = F.concat(F.lit("Odd "), "p_name")
    return table(spark, d, "part").select("p_partkey", F.array_join(P.foreign_words(side, F.array("p_name", "p_brand")), " ").alias("words"))
