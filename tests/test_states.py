"""Streams with state against their batch operators: several batches, late rows, a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from broadloom.operators import store as S
from broadloom.operators import visits as V
from broadloom.streaming import states as T
from broadloom.streaming import visits as W

NOON = dt.datetime(2024, 3, 1, 12)


def parts(spark, folder, rows, schema, cuts):
    """Writes rows as files that a stream takes one by one; a number of them now, the rest by
    the returned function."""
    bounds = [0, *cuts, len(rows)]

    def write(i):
        spark.createDataFrame(rows[bounds[i] : bounds[i + 1]], schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")

    return write, len(bounds) - 1


def in_two_runs(spark, tmp_path, make, rows, schema, cuts):
    """The stream's output after a run over the first files and one over the others."""
    folder = tmp_path / "in"
    folder.mkdir()
    write, n = parts(spark, folder, rows, schema, cuts)
    for files in (range(n // 2), range(n // 2, n)):
        for i in files:
            write(i)
        stream = W.file_stream(spark, str(folder), "*.parquet", spark.createDataFrame([], schema).schema, files_per_batch=1)
        T.run(make(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("seed", [1, 2])
def test_sliding_labels_equal_the_window(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), NOON + dt.timedelta(seconds=40 * i + rng.randrange(-900, 900)), rng.choice("abcdef")) for i in range(400)]
    rows += [(None, NOON, "a"), (9, None, "a"), (9, NOON, None)]
    schema = "visitor long, ts timestamp_ntz, label string"
    got = in_two_runs(spark, tmp_path, lambda s: T.sliding_labels(s, "visitor", "ts", "label", seconds=300), rows, schema, [90, 180, 300])
    want = V.forged_visitors(spark.createDataFrame(rows[:400], schema), "visitor", "ts", "label", least=1, seconds=300)
    assert {(r.visitor, r.n) for r in got.groupBy("visitor").agg(F.max("most_labels").alias("n")).collect()} == {(r.visitor, r.most_labels) for r in want.collect()}
    assert len({r.batch for r in got.select("batch").distinct().collect()}) > 1


def test_moved_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(30), NOON + dt.timedelta(hours=rng.choice([0, 0, 1, 4, -5])), i, NOON + dt.timedelta(minutes=i)) for i in range(150)]
    schema = "game long, start timestamp_ntz, version long, seen timestamp_ntz"
    got = in_two_runs(spark, tmp_path, lambda s: T.moved_stream(s, "game", "start", "version", "seen"), rows, schema, [40, 80, 120])
    last = got.groupBy("key").agg(F.max_by(F.struct("now_at", "moved_from"), "versions").alias("x"))
    want = S.moved(spark.createDataFrame(rows, schema), "game", "start", [F.col("version")])
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    assert {tuple(r) for r in last.select("key", "x.*").collect()} == {tuple(r) for r in want.select("game", seconds("now_at"), seconds("moved_from")).collect()}
    assert any(r.x.moved_from for r in last.collect())


def test_streaks_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, NOON.date() + dt.timedelta(days=d), rng.random() < 0.6, rng.random() < 0.8) for d in range(40) for k in range(5)]
    schema = "channel long, day date, silent boolean, was_read boolean"
    got = in_two_runs(spark, tmp_path, lambda s: T.streak_stream(s, "channel", "day", "silent", "was_read"), rows, schema, [50, 100, 150])
    want = S.streaks(spark.createDataFrame(rows, schema), "channel", "day", "silent", "was_read")
    assert {(r.key, r.day, r.streak) for r in got.collect()} == {(r.channel, r.day, r.streak) for r in want.collect()}


def test_games_end_by_timers(spark, tmp_path):
    hour = lambda h: NOON + dt.timedelta(hours=h)
    rows = [(1, hour(0), hour(-1)), (2, hour(1), hour(-1)), (2, hour(3), hour(0)), (3, hour(20), hour(0)), (9, hour(6), hour(6)), (9, hour(6), hour(6)), (9, hour(6), hour(6))]
    schema = "game long, start timestamp_ntz, seen timestamp_ntz"
    got = in_two_runs(spark, tmp_path, lambda s: T.open_games(s, "game", "start", F.lit(130), "seen"), rows, schema, [2, 4, 5, 6])
    over = lambda h: int((hour(h) - dt.datetime(1970, 1, 1)).total_seconds()) + 130 * 60
    assert sorted((r.key, r.what, r["at"]) for r in got.collect()) == [(1, "opened", over(0)), (1, "over", over(0)), (2, "opened", over(1)), (3, "opened", over(20)), (9, "opened", over(6))]
