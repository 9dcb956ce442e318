"""Streams with state of their own: sliding distinct labels, moved starts, silent streaks, and
games that end. Each equals its batch operator over the same rows, whatever the micro-batches
and over restarts. Keys are dealt by hash and a key's state stays bounded: what the watermark
has passed goes by timers.

State lies in RocksDB (``run`` sets the provider for the query that it starts), checkpoints and
output in folders that the caller names, so a run that is broken off goes on where it was.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(stream: DataFrame, out: str, state: str, mode: str = "append") -> None:
    """Process what is there; each batch overwrites its own folder of ``out``. Called again with
    the same folders it takes only what came since."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        sink = lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
        stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(sink).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class _Labels(StatefulProcessor):
    """Seconds and labels of a visitor within reach, and the most labels of any span so far.
    A row is judged as it comes: it can only change the spans that end within ``seconds``
    after it, so these alone are counted anew."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "at long, label string")
        self.most = handle.getValueState("most", "n long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        held = sorted(set(map(tuple, self.seen.get())) if self.seen.exists() else ())
        most = before = self.most.get()[0] if self.most.exists() else 0
        new = set()
        for pdf in rows:
            new.update(zip(pdf["at"].tolist(), pdf["label"].tolist(), strict=True))
        new -= set(held)
        for row in new:
            insort(held, row)
        ends = sorted({held[i][0] for at, _ in new for i in range(bisect_left(held, (at,)), bisect_left(held, (at + self.seconds + 1,)))})
        lo = hi = 0
        inside: dict = {}
        for end in ends:
            while hi < len(held) and held[hi][0] <= end:
                inside[held[hi][1]] = inside.get(held[hi][1], 0) + 1
                hi += 1
            while held[lo][0] < end - self.seconds:
                inside[held[lo][1]] -= 1
                if not inside[held[lo][1]]:
                    del inside[held[lo][1]]
                lo += 1
            most = max(most, len(inside))
        # rows before the watermark come no more, so nothing reaches back beyond it by a span
        keep = held[bisect_left(held, (timerValues.getCurrentWatermarkInMs() // 1000 - self.seconds,)) :]
        self._put(keep)
        if most > before:
            self.most.update((most,))
            yield pd.DataFrame({"visitor": [key[0]], "most_labels": [most]})

    def _put(self, keep) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if keep:
            self.seen.put(keep)
            self.handle.registerTimer((keep[-1][0] + self.seconds + 1) * 1000)
        else:
            self.seen.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        self.seen.clear()  # the newest row is out of reach
        yield pd.DataFrame({"visitor": [], "most_labels": []}).astype("int64")

    def close(self) -> None:
        pass


def sliding_labels(events: DataFrame, visitor: str, ts: str, label: str, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """(visitor, most_labels): a row whenever a visitor shows more different labels within a
    trailing span of so many seconds than ever before; exact for rows at most ``late`` behind.
    The last row of a visitor is what ``visits.forged_visitors`` counts."""
    at = F.col(ts).cast("timestamp")
    rows = events.select(F.col(visitor).cast("long").alias("visitor"), at.alias("_at"), F.unix_seconds(at).alias("at"), F.col(label).cast("string").alias("label")).filter("visitor IS NOT NULL AND at IS NOT NULL AND label IS NOT NULL")
    return rows.withWatermark("_at", late).groupBy("visitor").transformWithStateInPandas(_Labels(seconds), "visitor long, most_labels long", "Append", "EventTime")


class _Moved(StatefulProcessor):
    def __init__(self, seconds: int, days: int) -> None:
        self.seconds, self.days = seconds, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ends", "first long, last long, n long, rests long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        new = pd.concat(list(rows)).sort_values("version")
        at = new["at"].tolist()
        first, _, n, rests = self.state.get() if self.state.exists() else (at[0], None, 0, None)
        if rests is not None:
            self.handle.deleteTimer(rests)
        last, n, rests = at[-1], n + len(at), max(rests or 0, (int(new["seen"].max()) + self.days * 86_400) * 1000)
        self.state.update((first, last, n, rests))
        self.handle.registerTimer(rests)
        moved = first if abs(last - first) >= self.seconds else None
        yield pd.DataFrame({"key": [key[0]], "now_at": [last], "moved_from": pd.array([moved], "Int64"), "versions": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        self.state.clear()  # it has rested for so long
        yield pd.DataFrame({"key": [], "now_at": [], "moved_from": [], "versions": []}).astype("int64")

    def close(self) -> None:
        pass


def moved_stream(versions: DataFrame, key: str, at: str, version: str, seen: str, least_hours: int = 3, days: int = 30, late: str = "1 hour") -> DataFrame:
    """(key, now_at, moved_from, versions), epoch seconds: a row for each key and batch, the one
    with the most versions holds. As ``store.moved``: the first old start, null if the start
    came back. Versions of a key come in order; ``seen`` is when a version was read, and a key
    of which nothing was read for so many days is forgotten."""
    read = F.col(seen).cast("timestamp")
    rows = versions.select(F.col(key).cast("long").alias("key"), F.unix_seconds(F.col(at).cast("timestamp")).alias("at"), F.col(version).cast("long").alias("version"), read.alias("_at"), F.unix_seconds(read).alias("seen"))
    rows = rows.filter("key IS NOT NULL AND at IS NOT NULL AND seen IS NOT NULL").withWatermark("_at", late)
    return rows.groupBy("key").transformWithStateInPandas(_Moved(3600 * least_hours, days), "key long, now_at long, moved_from long, versions long", "Append", "EventTime")


class _Streak(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "streak long, day int")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        streak, last = self.state.get() if self.state.exists() else (0, None)
        out = []
        for day, silent, read in pd.concat(list(rows)).sort_values("day")[["day", "silent", "was_read"]].itertuples(index=False):
            if last is not None and day <= last:
                continue
            streak, last = (0 if read and not silent else streak + bool(read)), day
            out.append((key[0], day, streak))
        self.state.update((streak, last))
        yield pd.DataFrame(out, columns=["key", "day", "streak"])

    def close(self) -> None:
        pass


def streak_stream(days: DataFrame, key: str, day: str, silent: str, read: str) -> DataFrame:
    """(key, day, streak): as ``store.streaks``. Days of a key come in order; one that comes after
    a later day of its key is dropped, as the streak it belongs to is told."""
    rows = days.select(F.col(key).cast("long").alias("key"), F.unix_date(F.col(day)).alias("day"), F.col(silent).alias("silent"), F.col(read).alias("was_read")).filter("key IS NOT NULL AND day IS NOT NULL")
    out = rows.groupBy("key").transformWithStateInPandas(_Streak(), "key long, day int, streak long", "Append", "None")
    return out.select("key", F.date_from_unix_date("day").alias("day"), "streak")


class _Open(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("over", "over long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        over = int(max(pdf["over"].max() for pdf in rows))
        held = self.state.get()[0] if self.state.exists() else None
        if held is None or over > held:
            if held is not None:
                self.handle.deleteTimer(held * 1000)
            self.state.update((over,))
            self.handle.registerTimer(over * 1000)
        new = held is None
        yield pd.DataFrame({"key": pd.Series([key[0]] * new, dtype="int64"), "what": pd.Series(["opened"] * new, dtype="object"), "at": pd.Series([over] * new, dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        over = self.state.get()[0]
        self.state.clear()
        yield pd.DataFrame({"key": [key[0]], "what": pd.Series(["over"], dtype="object"), "at": [over]})

    def close(self) -> None:
        pass


def open_games(games: DataFrame, key: str, start: str, minutes: Column, seen: str, late: str = "1 hour") -> DataFrame:
    """(key, what, at), ``at`` in epoch seconds: 'opened' when a game is first seen, 'over' when
    the time of what is seen passes its start and grace (``store.alive`` keeps the others). A
    later row may put the end off, never forward."""
    over = (F.unix_seconds(F.col(start).cast("timestamp")) + 60 * minutes).cast("long")
    rows = games.select(F.col(key).cast("long").alias("key"), F.col(seen).cast("timestamp").alias("_at"), over.alias("over")).filter("key IS NOT NULL AND over IS NOT NULL")
    return rows.withWatermark("_at", late).groupBy("key").transformWithStateInPandas(_Open(), "key long, what string, at long", "Append", "EventTime")
