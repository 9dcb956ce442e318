"""Retraction by page evidence, rule by rule, and crawl plans at their edges."""

from datetime import date, datetime

from pyspark.sql import functions as F

from broadloom.operators import retraction as R
from broadloom.sources import pages as P

MARK = "mark_id string, game int, site string, channel string, url string, start timestamp_ntz"
SEEN = "game int, site string, channel string, start timestamp_ntz"
REPORT = "site string, channel string, url string, day string, verdict string, paged boolean"
NAMES = "site string, channel string, spelling string"


def verdicts(spark, marks, seen, report, names=(), **options):
    cover = R.page_coverage(spark.createDataFrame(report, REPORT), "schedule", ["no reply"])
    out = R.retraction_verdicts(spark.createDataFrame(marks, MARK), spark.createDataFrame(seen, SEEN), spark.createDataFrame(list(names), NAMES), cover, F.lit("2026-10-06 12:00:00").cast("timestamp_ntz"), **options)
    return {r.mark_id: r.verdict for r in out.collect()}


def at(day, hour):
    return datetime(2026, 10, day, hour)


def test_addresses(spark):
    urls = ["https://www.A.tv/ch/Sport-2?date=2026-10-06", "http://a.tv/on/06%2F10%2F2026/", "a.tv/epg-2026/1/5.json", "http://a.tv/d/31.02.2026", None, "http://a.tv"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select(R.address_kind(F.col("u")), R.address_day(F.col("u")), R.undated(F.col("u"))).collect()
    assert [tuple(r)[:2] for r in df] == [("a.tv/ch/Sport-#", "2026-10-06"), ("a.tv/on/#%#F#%#F#", "2026-10-06"), ("a.tv/epg-#/#/#.json", "2026-01-05"), ("a.tv/d/#.#.#", ""), ("", ""), ("a.tv", "")]
    assert df[0][2] == "https://www.A.tv/ch/Sport-2?date="


def test_night_games_need_the_page_of_the_day_before(spark):
    grid = "http://g.tv/day/1"
    marks = [("night", 1, "g.tv", "c", grid, at(8, 2)), ("noon", 2, "g.tv", "c", grid, at(8, 12)), ("shown", 3, "g.tv", "c", grid, at(8, 13))]
    seen = [(3, "g.tv", "c", at(8, 13)), (4, "g.tv", "c", at(8, 14))]
    today = ("g.tv", None, grid, "2026-10-08", "schedule", None)
    assert verdicts(spark, marks, seen, [today]) == {"night": "page missing", "noon": "retract"}
    before = ("g.tv", None, "http://g.tv/day/0", "2026-10-07", "schedule", None)
    assert verdicts(spark, marks, seen, [today, before]) == {"night": "retract", "noon": "retract"}
    # one page of the grid that is not whole spoils the day; an address that holds its day needs that day alone
    assert verdicts(spark, marks, seen, [today, (*today[:4], "empty", None), before])["noon"] == "page missing"
    dated = [("night", 1, "g.tv", "c", "http://g.tv/on/2026-10-08", at(8, 2)), *marks[1:]]
    assert verdicts(spark, dated, seen, [today, ("g.tv", None, "http://g.tv/on/2026-10-08", "2026-10-08", "schedule", None)])["night"] == "retract"


def test_channel_pages_speak_for_their_channel_only(spark):
    url = lambda c: f"http://p.tv/ch?id={c}"
    marks = [("a", 1, "p.tv", "A", url("a"), at(8, 12)), ("b", 1, "p.tv", "B", url("b"), at(8, 12)), ("x", 1, "p.tv", "X", url("x"), at(8, 12))]
    seen = [(5, "p.tv", "A", at(8, 13)), (6, "p.tv", "A", at(8, 14))]
    report = [("p.tv", "One", url("a"), "2026-10-08", "schedule", False), ("p.tv", "Two", url("b"), "2026-10-08", "empty", False), ("p.tv", "Two", url("b2"), "2026-10-08", "empty", False)]
    names = [(None, "A", "One"), ("p.tv", "B", "Two"), ("else.tv", "X", "One")]
    assert verdicts(spark, marks, seen, report, names) == {"a": "retract", "b": "page missing", "x": "page missing"}
    # by its address alone, and one whole page of two is enough
    report[2] = (*report[2][:4], "schedule", False)
    report.append(("p.tv", "Unknown", url("x"), "2026-10-08", "schedule", False))
    assert verdicts(spark, marks, seen, report, names) == {"a": "retract", "b": "retract", "x": "retract"}


def test_lists_must_reach_a_later_day_and_other_rules(spark):
    url = "http://l.tv/sport?page=1"
    marks = [("m", 1, "l.tv", "c", url, at(8, 12)), ("past", 2, "l.tv", "c", url, at(6, 12)), ("null", 9, "l.tv", "c", None, None)]
    report = [("l.tv", "", url, "2026-10-06", "schedule", True)]
    same = [(3, "l.tv", "c", at(8, 13))]
    assert verdicts(spark, marks, same, report) == {"m": "list ends", "past": "started", "null": "started"}
    assert verdicts(spark, marks, [*same, (4, "l.tv", "c", at(9, 1))], report)["m"] == "retract"
    assert verdicts(spark, marks, [(4, "l.tv", "c", at(9, 1))], report)["m"] == "too few"
    assert verdicts(spark, marks, same, report, orphans=False)["m"] == "not in file"
    assert verdicts(spark, marks, same, [(*report[0][:4], "no reply", True)])["m"] == "no answer"
    assert set(verdicts(spark, marks, same, report, backfill=True).values()) == {"backfill"}
    assert set(verdicts(spark, marks, same, report, new_file=False).values()) == {"old file"}
    assert verdicts(spark, [], [], []) == {}


def test_crawl_targets_edges(spark):
    schema = "source_id int, kind string, url string, today date, pages int, own_days int, max_days int, reference boolean"
    day = date(2026, 10, 6)
    rows = [(1, None, "u/{date}", day, None, None, None, None), (2, "channels", "u", day, None, None, None, None), (3, "paged", "p{n}", day, 2, 9, None, True), (4, "days", "d{daynum}", day, None, 6, 1, True), (None, "grid", "g", day, None, None, None, None)]
    channels = spark.createDataFrame([(1, "A", None), (1, "B", "b/{dmy}"), (9, "C", "c")], "source_id int, channel string, url string")
    out = P.crawl_targets(spark.createDataFrame(rows, schema), channels, 2).collect()
    got = sorted((r.source_id, r.channel, str(r.day), r.target) for r in out)
    assert [g for g in got if g[0] == 1] == [(1, "A", "2026-10-06", "u/2026-10-06"), (1, "A", "2026-10-07", "u/2026-10-07"), (1, "B", "2026-10-06", "b/06.10.2026"), (1, "B", "2026-10-07", "b/07.10.2026")]
    assert [g[3] for g in got if g[0] == 4] == ["d0"] and not [g for g in got if g[0] in (2, None)]
    assert sorted(int(g[3][1:]) for g in got if g[0] == 3) == list(range(1, 15))


def test_marks_of_one_page_and_day_are_one_case(spark, monkeypatch):
    """20,000 marks of one address and day, noon and night; some without site, channel or address."""
    asked = []
    judged = R._judged
    monkeypatch.setattr(R, "_judged", lambda cases, *more: (asked.append(cases.count()), judged(cases, *more))[1])
    page = "http://g.tv/on/day/1"
    ids = spark.range(20_000).withColumn("start", F.lit("2026-10-08 12:00:00").cast("timestamp_ntz") - F.expr("make_dt_interval(0, cast(if(id % 2 = 0, 10, 0) as int))"))
    marks = ids.select(F.col("id").cast("string").alias("mark_id"), F.col("id").cast("int").alias("game"), F.when(F.col("id") != 1, "g.tv").alias("site"), F.when(F.col("id") != 3, "c").alias("channel"), F.when(F.col("id") != 5, page).alias("url"), "start")
    seen = spark.range(10_000).select((F.col("id") + 50_000).cast("int").alias("game"), F.lit("g.tv").alias("site"), F.lit("c").alias("channel"), F.lit("2026-10-08 13:00:00").cast("timestamp_ntz").alias("start"))
    cover = R.page_coverage(spark.createDataFrame([("g.tv", None, page, "2026-10-08", "schedule", None)], REPORT), "schedule", ["no reply"])
    out = R.retraction_verdicts(marks, seen, spark.createDataFrame([], NAMES), cover, F.lit("2026-10-06 12:00:00").cast("timestamp_ntz")).collect()
    assert len(out) == 20_000 and len({r.mark_id for r in out}) == 20_000
    odd = {r.mark_id: r.verdict for r in out if r.mark_id in ("0", "1", "3", "5", "7")}
    assert odd == {"0": "page missing", "1": "no answer", "3": "retract", "5": "page missing", "7": "retract"}
    assert {(int(r.mark_id) % 2, r.verdict) for r in out if r.mark_id not in odd} == {(0, "page missing"), (1, "retract")}
    assert asked == [5]
