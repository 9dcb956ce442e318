"""Purging a log month by month, and the listing's filters."""

import pytest
from pyspark.sql import functions as F

from broadloom.operators import relational as R
from broadloom.sources import files


def test_purge_rewrites_closed_months_only(spark, tmp_path):
    path = str(tmp_path / "log")
    days = [("2024-01", "2024-01-05"), ("2024-01", "2024-01-06"), ("2024-02", "2024-02-01"), ("2024-02", "junk"), ("2024-03", "2024-03-30"), ("2024-04", "2024-04-01"), ("2024-04", "2024-04-20"), ("2023-12", "2023-12-31")]
    spark.createDataFrame([(m, d, i) for m, d in days for i in range(3)], "month string, day string, hit int").write.partitionBy("month").parquet(path)
    files_of = lambda m: sorted(p.name for p in (tmp_path / "log" / f"month={m}").glob("part-*"))
    before = {m: files_of(m) for m in ("2024-03", "2024-04", "2023-12")}
    done = spark.createDataFrame([(d,) for d in ("2024-01-05", "2024-01-06", "2024-04-01", "2024-02-09")], "day string")

    def broken(x):
        raise RuntimeError("an executor is lost")

    with pytest.raises(Exception, match="an executor is lost"):
        files.purge_log(spark, path, done.select(F.udf(broken)("day").alias("day")), "2024-04-15")
    days_left = lambda: {(r.day, r["count"]) for r in spark.read.parquet(path).groupBy("day").count().collect()}
    assert days_left() == {(d, 3) for _, d in days}
    got = files.purge_log(spark, path, done, "2024-04-15")
    assert {(r.month, r.kept, r.gone) for r in got.collect()} == {("2024-01", 0, 6), ("2024-02", 3, 3)}
    # days not rolled up stay, and so does the month that is still open
    assert days_left() == {(d, 3) for d in ("2024-02-01", "2024-03-30", "2024-04-01", "2024-04-20", "2023-12-31")}
    assert {m: files_of(m) for m in before} == before
    assert files.purge_log(spark, path, done, "2024-04-15").count() == 0
    files.rewrite_partitions(spark.createDataFrame([("2024-03", "2024-03-30", 9)], "month string, day string, hit int").select("day", "hit", "month"), path, "month")
    assert spark.read.parquet(path).filter("month = '2024-03'").count() == 1 and spark.read.parquet(path).filter("month = '2024-04'").count() == 6


def test_filters_of_the_listing(spark):
    games = spark.createDataFrame([(i, f"2024-05-0{i}", "FB"[i % 2], i % 3, f"Home {i}", None if i == 4 else "Away", "Cup") for i in range(1, 8)], "game int, date string, sport string, league_id int, home string, away string, league string")
    links = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 11), (5, 12)], "game int, channel int")
    channels = spark.createDataFrame([(10, "Sport ONE"), (11, "Two"), (12, None)], "channel int, name string")
    page = lambda **k: [(r.game, r.total) for r in R.event_page(games, links, channels, [F.col("game")], **k).collect()]
    assert page() == [(i, 7) for i in range(1, 8)]
    assert page(date_from="2024-05-03", date_to="2024-05-05", sport="B") == [(3, 2), (5, 2)]
    assert page(league=0) == [(3, 2), (6, 2)]
    assert page(channel=11) == [(1, 2), (2, 2)] and page(has_channels=True) == [(1, 3), (2, 3), (5, 3)]
    assert page(q="cup sport one TWO") == [(1, 1)] and page(q="4  cup") == [(4, 1)] and page(q="nothing") == []
    assert page(offset=2, limit=2) == [(3, 7), (4, 7)] and len(page(limit=9, most=4)) == 4 and page(offset=50) == []
