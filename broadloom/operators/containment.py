"""Which of many names stand in which texts, as whole words one after another.

The search goes by an index of neighbouring words. Each name is looked up by its rarest pair of
neighbouring words (rarity is counted over all texts), a name of one word by that word; a pair
that no text holds settles its names at once. A text then goes once to its hits, where the
other words are compared in place. Nothing is multiplied: rows are occurrences of the names'
rarest pairs. Texts are cut into words once; the steps read the stored words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.operators.intervals import seconds
from broadloom.sources.shared import materialize

SPACE = " "


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _grams(of: Column) -> Column:
    """struct(gram, pos): pairs of neighbouring words, and the only word of a single one."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(of) - 1), lambda i: F.struct(F.concat_ws(SPACE, F.element_at(of, i), F.element_at(of, i + 1)).alias("gram"), (i - 1).alias("pos")))
    return F.when(F.size(of) >= 2, pairs).when(F.size(of) == 1, F.array(F.struct(F.element_at(of, 1).alias("gram"), F.lit(0).alias("pos"))))


def _occurrences(body: DataFrame) -> DataFrame:
    """(_id, pos, gram) of every word and every pair of neighbouring words, in one pass."""
    after = F.slice("_words", F.lit(2), F.size("_words"))
    placed = body.select("_id", F.posexplode(F.arrays_zip(F.col("_words").alias("w"), after.alias("x"))).alias("pos", "_p")).select("_id", "pos", "_p.w", "_p.x")
    both = F.array(F.col("w"), F.when(F.col("x").isNotNull(), F.concat(F.col("w"), F.lit(SPACE), F.col("x"))))
    return placed.select("_id", "pos", F.explode(both).alias("gram"))


def contained(texts: DataFrame, names: DataFrame, text_id: str, text: str, name: str) -> DataFrame:
    """(text_id, name, places): every distinct name that a text holds, with the word numbers at
    which it starts. Names are compared as ``words``; null and wordless ones are found nowhere,
    and names of equal words are told apart by their spelling. Rows that repeat a text_id are
    one text with all their places."""
    wanted = names.select(F.col(name).alias("_name")).filter("_name IS NOT NULL").distinct().withColumn("_own", words(F.col("_name"))).filter(F.size("_own") > 0)
    body = materialize(texts.select(F.col(text_id).alias("_id"), words(F.col(text)).alias("_words")).filter("_id IS NOT NULL")).filter("size(_words) > 0")
    asked = materialize(wanted.select("_name", "_own", F.explode(_grams(F.col("_own"))).alias("_g")).select("_name", "_own", "_g.gram", F.col("_g.pos").alias("_k")))
    keys = asked.select("gram").distinct()
    seen = materialize(_occurrences(body).join(keys, "gram", "left_semi"))
    often = seen.groupBy("gram").agg(F.count("*").alias("_n"))
    counted = asked.join(often, "gram", "left").groupBy("_name", "_own").agg(F.min_by(F.struct("gram", "_k"), F.struct(F.coalesce("_n", F.lit(0)), "_k")).alias("_p"), F.min(F.coalesce("_n", F.lit(0))).alias("_least"))
    pivots = counted.filter("_least > 0").select("_name", "_own", "_p.gram", "_p._k")
    hits = seen.join(pivots, "gram").select("_id", "_name", "_own", (F.col("pos") - F.col("_k")).alias("_at")).filter("_at >= 0")
    sure = hits.filter(F.size("_own") <= 2).select("_id", "_name", "_at")
    rest = hits.filter(F.size("_own") > 2).groupBy("_id").agg(F.collect_set(F.struct("_name", "_own", "_at")).alias("_hits"))
    same = F.filter("_hits", lambda h: F.slice(F.col("_words"), h["_at"] + 1, F.size(h["_own"])) == h["_own"])
    checked = body.join(rest, "_id").select("_id", F.explode(same).alias("_h")).select("_id", "_h._name", "_h._at")
    found = sure.union(checked).groupBy("_id", "_name").agg(F.array_sort(F.collect_set("_at")).alias("places"))
    return found.select(F.col("_id").alias(text_id), F.col("_name").alias(name), "places")


def seen_not_shown(pages: DataFrame, matches: DataFrame, shown: DataFrame, before_minutes: int = 60, after_minutes: int = 15) -> DataFrame:
    """(site, ref, page_id, places): reference matches that a page of a site names near their
    start though the listing has no channel of that site for them; of several pages the one
    nearest in time, then the smallest page_id, and where the first side stands in it.

    pages: page_id, site, at, text (what is on at that time). matches: ref, start, home, away.
    shown: site, ref. A match starts at most ``after_minutes`` before and ``before_minutes``
    after the page's time."""
    sides = matches.select("ref", "start", F.col("home").alias("_home"), F.col("away").alias("_away")).filter("start IS NOT NULL")
    names = sides.select(F.col("_home").alias("name")).union(sides.select("_away"))
    held = materialize(contained(pages, names, "page_id", "text", "name"))
    timed = held.join(pages.select("page_id", "site", "at"), "page_id").filter("at IS NOT NULL")
    one = timed.withColumnRenamed("name", "_home").join(sides, "_home")
    gap = seconds("start") - seconds("at")
    one = one.withColumn("_gap", gap).filter((F.col("_gap") >= -60 * after_minutes) & (F.col("_gap") <= 60 * before_minutes))
    both = one.join(held.select("page_id", F.col("name").alias("_away"), F.lit(True).alias("_both")), ["page_id", "_away"])
    lost = both.join(shown.select("site", "ref").distinct(), ["site", "ref"], "left_anti")
    best = F.min_by(F.struct("page_id", "places"), F.struct(F.abs("_gap"), "page_id")).alias("_b")
    return lost.groupBy("site", "ref").agg(best).select("site", "ref", "_b.page_id", "_b.places")
