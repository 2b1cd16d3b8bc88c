"""Functions of times, places in schedules and runs of numbers, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normal

PERIODS = ("24h", "7d", "30d", "12m")


def period_start(period: str, now: Column) -> Column:
    """Where a period that ends now begins: so many hours or days before, or midnight of the day a year before, the month's last where it has fewer days. In the session's time zone; use UTC."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period}")
    if period == "12m":
        return F.add_months(F.to_date(now), -12).cast("timestamp")
    return now - F.make_dt_interval(hours=F.lit({"24h": 24, "7d": 7 * 24, "30d": 30 * 24}[period]))


def due(key: Column, every: int, day: Column) -> Column:
    """Whether a day is the key's turn, one day in `every` (below 2 ** 31): SHA-256 of the key and the day's number since the year 1 leave the same."""
    if every <= 1:
        return F.lit(True)
    digits = F.sha2(key.cast("string"), 256)
    # seven hexadecimal digits at a time, so that nothing leaves the long
    parts = F.transform(F.sequence(F.lit(1), F.lit(64), F.lit(7)), lambda i: F.substring(digits, i, F.lit(7)))
    turn = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: F.pmod(acc * F.when(F.length(p) == 7, F.lit(1 << 28)).otherwise(F.lit(16)) + F.conv(p, 16, 10).cast("long"), F.lit(every)))
    return turn == F.pmod(F.datediff(day, F.lit("0001-01-01").cast("date")) + 1, F.lit(every))


def frame_mean(probs: Column, unit: Column, start: Column, end: Column) -> Column:
    """The mean of frames from start to end: those that they touch, one at least; the last frame where start is behind them, 0 without frames or unit."""
    n = F.size(probs)
    low = F.greatest(F.lit(0), F.floor(start / unit)).cast("int")
    high = F.least(F.greatest(low + 1, F.ceil(end / unit).cast("int")), n)
    some = F.slice(probs, low + 1, F.greatest(high - low, F.lit(1)))
    mean = F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.size(some)
    return F.when(probs.isNull() | (n <= 0) | (unit <= 0), 0.0).when(low >= n, F.element_at(probs, -1)).otherwise(mean)


def comparable(text: Column) -> Column:
    """Lower case, single blanks, none at the edges; a null text is empty."""
    return F.coalesce(normal(text), F.lit(""))


def has_word(text: Column, word: Column) -> Column:
    """Whether a text has the letters of a word in it, whatever case or accents."""
    return F.contains(F.collate(text, "UNICODE_CI_AI"), F.collate(word, "UNICODE_CI_AI"))
