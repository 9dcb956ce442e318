"""Store mutations as whole-table transformations: old state and new rows in, new state out.

A table format with MERGE can apply the results; the rules themselves are joins. Each stage
of a matching cascade sees only what earlier stages left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadloom.sources.shared import materialize


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Stored and incoming by key. Where both have a row, each column follows its rule of
    (old, new), by default the new value unless null. ``change`` tells what happened."""
    columns = [c for c in stored.columns if c not in keys]
    o = stored.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in columns), F.lit(True).alias("_old"))
    n = incoming.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in columns), F.lit(True).alias("_new"))
    both = o.join(n, keys, "full_outer")
    value = {c: F.when(F.col("_old").isNull(), F.col(f"_n_{c}")).when(F.col("_new").isNull(), F.col(f"_o_{c}")).otherwise(rules.get(c, lambda a, b: F.coalesce(b, a))(F.col(f"_o_{c}"), F.col(f"_n_{c}"))) for c in columns}
    same = F.lit(True)
    for c in columns:
        same = same & value[c].eqNullSafe(F.col(f"_o_{c}"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "kept").when(same, "same").otherwise("updated")
    return both.select(*keys, *(value[c].alias(c) for c in columns), change.alias("change"))


def keep_if_empty(old: Column, new: Column) -> Column:
    """The new text unless it is empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def latin_wins(old: Column, new: Column) -> Column:
    """A Latin name displaces another script, never the other way round."""
    latin = lambda c: c.rlike(r"\p{IsLatin}") & ~c.rlike(r"[\p{L}&&[^\p{IsLatin}]]")
    return F.when(new.isNull() | (new == ""), old).when(latin(old) & ~latin(new), old).otherwise(new)


def insert_only(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Stored rows, and the first incoming row of each key that is not stored: late rows
    never update and never take away."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = incoming.join(stored.select(*keys).distinct(), keys, "left_anti").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return stored.unionByName(new.select(stored.columns))


def orphans(stored: DataFrame, incoming: DataFrame, keys: list[str], upcoming: Column) -> DataFrame:
    """Stored rows of the future that the new file does not have."""
    return stored.filter(upcoming).join(incoming.select(*keys).distinct(), keys, "left_anti")


def match_cascade(incoming: DataFrame, stored: DataFrame, incoming_id: str, stored_id: str, stages: list[tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]]) -> DataFrame:
    """(incoming_id, stored_id, stage) for every incoming row; null where no stage matched.
    A stage takes (unmatched incoming, stored) and returns (incoming_id, stored_id) pairs;
    of several for one row the smallest stored id stands."""
    left, found = incoming, None
    for name, stage in stages:
        got = stage(left, stored).groupBy(incoming_id).agg(F.min(stored_id).alias(stored_id)).withColumn("stage", F.lit(name))
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select(incoming_id), incoming_id, "left_anti")
    return incoming.select(incoming_id).join(found, incoming_id, "left")


def moved(versions: DataFrame, key: str, at: str, order: list[Column], least_hours: int = 3) -> DataFrame:
    """Per key: the last instant, and the one it moved from if its versions ever lay
    ``least_hours`` apart from the first: the first old value, and null if it came back."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = versions.withColumn("_first", F.first(at).over(whole)).withColumn("_last", F.last(at).over(whole))
    far = F.abs(F.unix_seconds(F.col("_last").cast("timestamp")) - F.unix_seconds(F.col("_first").cast("timestamp"))) >= 3600 * least_hours
    return rows.groupBy(key).agg(F.first("_last").alias("now_at"), F.first(F.when(far, F.col("_first"))).alias("moved_from"))


def streaks(days: DataFrame, key: str, day: str, silent: str, read: str) -> DataFrame:
    """Runs of silence: +1 on a silent day that was read, back to 0 on a day with data, held on
    a day that was not read. A window over the days of a key, no state carried by hand."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    spoke = F.col(read) & ~F.col(silent)
    rows = days.withColumn("_run", F.sum(F.when(spoke, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(key, "_run").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("streak", F.sum(F.when(F.col(read) & F.col(silent), 1).otherwise(0)).over(inside).cast("long")).drop("_run")


def survivors(pointers: DataFrame, node: str, merged_into: str) -> DataFrame:
    """(node, survivor): follows merge pointers to their end by doubling, so a chain of n hops,
    however long, takes log2 n joins. A pointer that leads nowhere ends where it points; a
    node in a cycle survives as the smallest of the cycle."""
    to = F.coalesce(F.col(merged_into), F.col(node))
    hop = materialize(pointers.select(F.col(node).alias("node"), to.alias("to"), F.least(F.col(node), to).alias("low"), (to != F.col(node)).alias("went")))
    step, longest = 1, hop.filter("went").count()
    while step <= longest and not hop.filter("went").isEmpty():
        nxt = hop.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        joined = hop.join(nxt, "to", "left")
        hop = materialize(joined.select("node", F.coalesce("to2", "to").alias("to"), F.least(F.col("low"), F.coalesce("low2", "low")).alias("low"), (F.coalesce("to2", "to") != F.col("to")).alias("went")))
        step *= 2
    end = hop.select(F.col("node").alias("to"), F.col("to").alias("end"), F.col("low").alias("end_low"))
    ended = hop.join(end, "to", "left")
    return ended.select("node", F.when(F.coalesce("end", "to") == F.col("to"), F.col("to")).otherwise(F.coalesce("end_low", "low")).alias("survivor"))


def repointed(children: DataFrame, column: str, survivors_of: DataFrame, unique: list[str], order: list[Column]) -> DataFrame:
    """Children after a merge of their parents: the column points to the survivor, and of rows
    that now share a unique key the first stays."""
    m = survivors_of.select(F.col("node").alias(column), "survivor")
    rows = children.join(m, column, "left").withColumn(column, F.coalesce("survivor", column)).drop("survivor")
    w = Window.partitionBy(*unique).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def alive(games: DataFrame, start: Column, minutes: Column, now: Column) -> DataFrame:
    """Games that are not over: start and grace reach ``now`` or beyond."""
    return games.filter(F.unix_seconds(start.cast("timestamp")) + 60 * minutes >= F.unix_seconds(now.cast("timestamp")))


def own_site_rows(rows: DataFrame, group: list[str], official: str, within_depth: str) -> DataFrame:
    """Official rows stay; others go where the channel has an official source that reaches the
    day; a group of which nothing would be left stays whole."""
    has = F.max(F.col(official).cast("int")).over(Window.partitionBy(*group)) == 1
    keep = F.col(official) | ~(has & F.col(within_depth))
    judged = rows.withColumn("_keep", keep)
    any_kept = F.max(F.col("_keep").cast("int")).over(Window.partitionBy(*group)) == 1
    return judged.withColumn("_any", any_kept).filter(F.col("_keep") | ~F.col("_any")).drop("_keep", "_any")


def absent_proofs(marks: DataFrame, seen: DataFrame, coverage: DataFrame, game: list[str], site: str, day: str, share: float = 0.5) -> DataFrame:
    """Marks to retract by proof of absence: not seen in the new file, while the site answered,
    its pages of that day are whole, and it gave at least ``share`` of its marks that day.
    coverage: site, day, answered, intact."""
    gone = marks.join(seen.select(*game, site).distinct(), [*game, site], "left_anti")
    given = marks.join(seen.select(*game, site).distinct(), [*game, site], "left_semi").groupBy(site, day).agg(F.count("*").alias("given"))
    live = marks.groupBy(site, day).agg(F.count("*").alias("live"))
    proof = gone.join(coverage.filter("answered AND intact").select(site, day), [site, day]).join(live, [site, day]).join(given, [site, day], "left")
    return proof.filter((F.coalesce("given", F.lit(0)) > 0) & (F.coalesce("given", F.lit(0)) >= F.ceil(F.col("live") * share))).select(marks.columns)


def alias_ladder(asked: DataFrame, aliases: DataFrame, ask_id: str) -> DataFrame:
    """(ask_id, team, how) of a spelling: nobody has it -> unknown; one exact canonical name;
    then those of its language (else without one), its sport, its category; one team left ->
    that, several clubs -> disputed.

    asked: ask_id, alias, lang, sport, category. aliases: alias, lang, sport, category, team,
    club, is_canonical. Each spelling is answered once, whoever asks for it, over one row for
    each kind of alias, so neither many askers nor many teams of one name multiply; ask_id is
    unique."""
    key = ["alias", "_lang", "_sport", "_category"]
    a = asked.select(ask_id, F.lower("alias").alias("alias"), F.col("lang").alias("_lang"), F.col("sport").alias("_sport"), F.col("category").alias("_category")).distinct()
    told = aliases.withColumn("alias", F.lower("alias")).groupBy("alias", "lang", "sport", "category", "is_canonical")
    # of rows that no rung tells apart the largest team and the extreme clubs say all
    told = told.agg(F.max("team").alias("team"), F.min("club").alias("_least"), F.max("club").alias("_most"))
    cand = a.select(*key).distinct().join(told, "alias", "left")
    w = Window.partitionBy(*key)

    def narrow(df: DataFrame, name: str, test: Column) -> DataFrame:
        hit = F.coalesce(test, F.lit(False))
        return df.withColumn("_hit", hit).withColumn("_any", F.max(F.col("_hit").cast("int")).over(w)).filter((F.col("_any") == 0) | F.col("_hit")).drop("_hit", "_any")

    for name, test in (("canonical", F.col("is_canonical")), ("lang", F.col("lang") == F.col("_lang")), ("sport", F.col("sport") == F.col("_sport")), ("category", F.col("category").eqNullSafe(F.col("_category")))):
        cand = narrow(cand, name, test)
    how = F.when(F.max("team").isNull(), "unknown").when(F.min("_least") < F.max("_most"), "disputed").when((F.min("sport") == F.max("sport")) & (F.max("sport") != F.col("_sport")), "other sport").otherwise("found")
    out = cand.groupBy(*key).agg(how.alias("how"), F.max("team").alias("team")).withColumnsRenamed({c: f"_of{c}" for c in key})
    same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in key]
    return a.join(out, reduce(and_, same), "left").select(ask_id, F.when(F.col("how") == "found", F.col("team")).alias("team"), "how")


def marks_appended(old: Column, new: Column) -> Column:
    """Old marks and those that the new row adds, in that order."""
    return F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))


def specific_wins(generic: list[str]) -> Callable[[Column, Column], Column]:
    """A league that only names the sport never overwrites a league of its own."""
    def rule(old: Column, new: Column) -> Column:
        bare = lambda c: F.coalesce(F.trim(F.lower(c)), F.lit("")).isin(["", *(g.lower() for g in generic)])
        return F.when(bare(new) & ~bare(old), old).otherwise(F.coalesce(new, old))

    return rule


def count_misses(marks: DataFrame, absent: DataFrame, keys: list[str], count: str, limit: int) -> DataFrame:
    """Marks with one more miss where they are absent; ``goes`` at the miss that reaches the
    limit, and at no later one."""
    missed = absent.select(*keys).distinct().withColumn("_absent", F.lit(1))
    out = marks.join(missed, keys, "left").withColumn(count, F.coalesce(count, F.lit(0)) + F.coalesce("_absent", F.lit(0)))
    return out.withColumn("goes", F.col("_absent").isNotNull() & (F.col(count) == limit)).drop("_absent")


def learnt_aliases(seen: DataFrame, known: DataFrame, alias: str, team: str) -> DataFrame:
    """(alias, team, fate) of new pairs: 'known', 'learnt' (the alias has one team, here and in
    the dictionary), or 'quarantine' (teams differ; nothing is learnt from it)."""
    new = seen.select(F.lower(alias).alias(alias), team).distinct()
    own = known.select(F.lower(alias).alias(alias), F.col(team).alias("_team")).distinct()
    teams = new.select(alias, F.col(team).alias("_any")).union(own).groupBy(alias).agg(F.countDistinct("_any").alias("_n"))
    has = own.withColumnRenamed("_team", team).withColumn("_known", F.lit(True))
    fate = F.when(F.col("_n") > 1, "quarantine").when(F.col("_known"), "known").otherwise("learnt")
    return new.join(teams, alias).join(has, [alias, team], "left").select(alias, team, fate.alias("fate"))


def retractable(marks: DataFrame, seen: DataFrame, coverage: DataFrame, game: list[str], site: str, day: str, start: Column, collected: Column, backfill: bool, new_file: bool, share: float = 0.5) -> DataFrame:
    """Proof of absence by all its rules: the run is no backfill and its file is new, the game
    has not started when the file was collected, and ``absent_proofs`` holds."""
    if backfill or not new_file:
        return marks.limit(0)
    return absent_proofs(marks, seen, coverage, game, site, day, share).filter(start > collected)


def guarded_ladder(asked: DataFrame, aliases: DataFrame, quarantine: DataFrame, ask_id: str) -> DataFrame:
    """``alias_ladder`` over the dictionary without what is in quarantine (alias, team): a
    spelling all of whose teams are there is answered 'quarantine', not 'unknown'."""
    held = quarantine.select(F.lower("alias").alias("_q"), F.col("team").alias("_qt")).filter("_q IS NOT NULL").distinct()
    on = (F.lower("alias") == F.col("_q")) & (F.col("team") == F.col("_qt"))
    out = alias_ladder(asked, aliases.join(held, on, "left_anti"), ask_id)
    known = aliases.join(held, on, "left_semi").select(F.lower("alias").alias("_q")).distinct()
    caught = asked.join(known, F.lower("alias") == F.col("_q"), "left_semi").select(ask_id, F.lit(True).alias("_caught"))
    how = F.when((F.col("how") == "unknown") & F.col("_caught"), "quarantine").otherwise(F.col("how"))
    return out.join(caught.distinct(), ask_id, "left").select(ask_id, "team", how.alias("how"))


def lifted(quarantine: DataFrame, told: DataFrame) -> DataFrame:
    """(alias, team, fate) of the quarantine after new evidence, the pairs that a match id has
    told: where these name exactly one of an alias' teams, that one is 'lifted' and the others
    are 'dropped'; else all stay 'held'."""
    q = quarantine.select(F.lower("alias").alias("alias"), "team").filter("alias IS NOT NULL").distinct()
    t = told.select(F.lower("alias").alias("alias"), "team").distinct().withColumn("_told", F.lit(True))
    rows = q.join(t, ["alias", "team"], "left")
    n = rows.groupBy("alias").agg(F.count("_told").alias("_n"))
    fate = F.when(F.col("_n") != 1, "held").when(F.col("_told"), "lifted").otherwise("dropped")
    return rows.join(n, "alias").select("alias", "team", fate.alias("fate"))
