"""Web-log analytics: sessions, visit measures, visitor groups, roll-ups, rolling uniques.

A log is one row per request or beacon. Column names are parameters, so a log of any layout
can be used. All operators are windows and aggregates keyed by visitor or day: one shuffle
for the sessions, one for each roll-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionize(log: DataFrame, visitor: str, ts: str, tie: str, gap_seconds: int = 1800) -> DataFrame:
    """Adds ``session_no``, from 0 per visitor. A session ends where the pause is longer than
    the gap; a pause of exactly the gap does not end it. Rows of one instant are ordered by
    ``tie``. Null times sort first and start no session of their own."""
    w = Window.partitionBy(visitor).orderBy(ts, tie)
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    new = F.when(pause > gap_seconds * 1_000_000, 1).otherwise(0)
    return log.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w).cast("long")).drop("_new")


def session_bounds(sessions: DataFrame, visitor: str, ts: str) -> DataFrame:
    """One row per session: first and last instant and number of rows."""
    return sessions.groupBy(visitor, "session_no").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_rows"))


def visit_measures(sessions: DataFrame, visitor: str, ts: str, tie: str, is_page: Column, is_action: Column, seconds: Column, weight: Column, source: Column) -> DataFrame:
    """One row per visit: pages, actions, hits (weighted rows), seconds (null if no row has
    any: an untimed visit is not a visit of no time), the first source that is not empty in
    time order, and the day the visit began."""
    order = F.struct(F.col(ts), F.col(tie))
    named = F.when(source.isNotNull() & (source != ""), order)
    return sessions.groupBy(visitor, "session_no").agg(
        F.date_format(F.min(ts), "yyyy-MM-dd").alias("day"),
        F.sum(F.when(is_page, 1).otherwise(0)).alias("pages"),
        F.sum(F.when(is_action, 1).otherwise(0)).alias("actions"),
        F.sum(weight).cast("long").alias("hits"),
        F.sum(seconds).cast("long").alias("seconds"),
        F.min_by(source, named).alias("source"),
    )


def forged_visitors(log: DataFrame, visitor: str, ts: str, label: str, least: int = 3, seconds: int = 3600) -> DataFrame:
    """Visitors that showed ``least`` different labels or more within any trailing span."""
    w = Window.partitionBy(visitor).orderBy(F.unix_seconds(F.col(ts).cast("timestamp"))).rangeBetween(-seconds, 0)
    seen = log.withColumn("_n", F.size(F.collect_set(label).over(w)))
    return seen.groupBy(visitor).agg(F.max("_n").cast("long").alias("most_labels")).filter(F.col("most_labels") >= least)


def visitor_groups(log: DataFrame, visitor: str, rules: list[tuple[str, Column]], otherwise: str, group: str = "grp") -> DataFrame:
    """One group per visitor. Rules are (name, aggregate condition) and the first that holds
    wins, over all rows of the visitor, not over a session."""
    out = None
    for name, condition in rules:
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return log.groupBy(visitor).agg(out.otherwise(F.lit(otherwise)).alias(group))


def most_common(log: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value per key; of equal counts the one met first."""
    counted = log.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first_at"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first_at"))).alias(value), F.max("n").alias("n"))


def daily_rollup(visits: DataFrame, visitor: str, by: list[str]) -> DataFrame:
    """Visits, distinct visitors and sums of the measures per day and group."""
    return visits.groupBy("day", *by).agg(
        F.count("*").alias("visits"),
        F.countDistinct(visitor).alias("visitors"),
        F.sum("hits").alias("hits"),
        F.sum("pages").alias("pages"),
        F.sum("actions").alias("actions"),
        F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"),
        F.count("seconds").alias("timed"),
    )


def daily_sets(visits: DataFrame, visitor: str, by: list[str], salt: str) -> DataFrame:
    """The daily fact with hashed visitors, whose unions give uniques of any period: a row for
    each day, group and visitor with the number of visits, so that no set is one value."""
    hashed = F.substring(F.sha2(F.concat(F.lit(salt), F.col(visitor).cast("string")), 256), 1, 10)
    return visits.groupBy("day", *by, hashed.alias("id")).agg(F.count("*").alias("visits"))


def period_uniques(daily: DataFrame, today: str, by: list[str], days: tuple[int, ...] = (1, 7, 30, 365)) -> DataFrame:
    """Visits and unique visitors of the periods that end on ``today``, per group and in
    total (null group). A visitor of several days counts once: sets are joined, not counts
    added. One pass: each day goes to the periods it lies in, then grouping sets."""
    ago = F.datediff(F.lit(today).cast("date"), F.col("day").cast("date"))
    spans = F.filter(F.array(*(F.lit(d) for d in days)), lambda d: (ago >= 0) & (ago < d))
    rows = daily.withColumn("period", F.explode(spans))
    visits = rows.groupingSets([["period", *by], ["period"]], "period", *by).agg(F.sum("visits").alias("visits"))
    people = rows.groupingSets([["period", *by], ["period"]], "period", *by).agg(F.countDistinct("id").alias("visitors"))
    on = visits["period"] == people["period"]
    for b in by:
        on = on & visits[b].eqNullSafe(people[b])
    return visits.join(people, on).select(visits["period"], *(visits[b] for b in by), "visits", "visitors")


def closable(days: DataFrame, day: str, now: str, hours: int = 1) -> DataFrame:
    """Days that ended at least ``hours`` before ``now`` and so may be closed for good."""
    end = F.col(day).cast("date").cast("timestamp_ntz") + F.make_interval(days=F.lit(1), hours=F.lit(hours))
    return days.filter(end <= F.lit(now).cast("timestamp_ntz"))


def unclosed(days: DataFrame, done: DataFrame, day: str = "day") -> DataFrame:
    """Write once: days that are closed already are not computed again."""
    return days.join(done.select(day).distinct(), day, "left_anti")
