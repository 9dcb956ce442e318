"""Date and time functions as Spark expressions. The current time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOME = "Europe/Kyiv"


def to_utc(local: Column, zone: str = HOME) -> Column:
    """Wall time to UTC wall time; of a repeated hour the earlier instant."""
    return F.to_utc_timestamp(local.cast("timestamp"), zone).cast("timestamp_ntz")


def from_utc(utc: Column, zone: str = HOME) -> Column:
    return F.from_utc_timestamp(utc.cast("timestamp"), zone).cast("timestamp_ntz")


def moment(value: Column) -> Column:
    """UTC wall time of epoch seconds, epoch milliseconds or ISO text; null if it is neither."""
    number = value.try_cast("long")
    epoch = F.when(number >= 100_000_000_000, F.timestamp_millis(number)).when(number >= 100_000_000, F.timestamp_seconds(number))
    return F.coalesce(epoch, F.when(number.isNull(), value.try_cast("timestamp"))).cast("timestamp_ntz")


def tv_day(local: Column, until: int = 7) -> Column:
    """The broadcast day: before ``until`` o'clock it is still yesterday."""
    return F.when(F.hour(local) < until, F.date_sub(F.to_date(local), 1)).otherwise(F.to_date(local))


def text_minute(value: Column) -> Column:
    """The normal form 'yyyy-MM-dd HH:mm' of a text time with 'T', seconds or 'Z'."""
    return F.substring(F.replace(value, F.lit("T"), F.lit(" ")), 1, 16)


def hint_is_fresh(day: Column, start: Column, days: int = 1) -> Column:
    """A hint holds for games around its day."""
    return F.abs(F.datediff(start, day)) <= days


def odd_minute_record(start: Column, kickoff: Column) -> Column:
    """A guess that starts at an odd minute is a recording, unless it is the ten minutes
    before its kickoff."""
    lead = F.unix_seconds(kickoff.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return (F.minute(start) % 5 != 0) & ~F.coalesce(lead.between(0, 600), F.lit(False))


def past_season(label: Column, when: Column) -> Column:
    """Does the label name a season that ended before ``when``'s?"""
    year = F.regexp_extract(label, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1).try_cast("int")
    second = F.regexp_extract(label, r"(?<![0-9])(?:19|20)([0-9]{2})\s?[/\-–]\s?(?:(?:19|20))?([0-9]{2})(?![0-9])", 2).try_cast("int")
    ends = F.coalesce(F.when(second.isNotNull(), F.floor(year / 100) * 100 + second), year)
    return F.coalesce(ends < F.year(when), F.lit(False))


def badges(now: Column, first_seen: Column, channel_seen: Column) -> dict[str, Column]:
    """'new' for 12 hours; a channel is new for 48, if it came 3 hours after the game or more."""
    secs = lambda c: F.unix_seconds(c.cast("timestamp"))
    return {
        "is_new": secs(first_seen) >= secs(now) - 12 * 3600,
        "channel_is_new": (secs(channel_seen) >= secs(now) - 48 * 3600) & (secs(channel_seen) - secs(first_seen) >= 3 * 3600),
    }
