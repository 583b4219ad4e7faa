"""Clock and name expressions on part file names and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STAMP = r"(\d{1,2})日(\d{1,2})点(\d{1,2})分"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(
        name
    )


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def clock_base(path: Column) -> Column:
    """Seconds of the day from the ``DD日HH点MM分`` stamp of a part name, NULL without one."""
    name = base_name(path)
    h = F.regexp_extract(name, _STAMP, 2).try_cast("long")
    m = F.regexp_extract(name, _STAMP, 3).try_cast("long")
    return F.when(name.rlike(_STAMP), h * 3600 + m * 60)


def part_no(path: Column) -> Column:
    """The digits after the first ``P<digits>`` of the stem, ``-`` if there are none."""
    s = stem(path)
    return F.when(s.rlike(r"P\d+"), F.regexp_extract(s, r"P(\d+)", 1)).otherwise("-")


def _whole(sec: Column) -> Column:
    return F.bround(sec).cast("long")


def mmss(sec: Column) -> Column:
    s = _whole(sec)
    return F.when(
        sec.isNotNull(), F.format_string("%02dm%02ds", F.floor(s / 60), F.pmod(s, F.lit(60)))
    )


def wall_clock(sec: Column) -> Column:
    s = _whole(sec)
    text = F.format_string(
        "%02d:%02d:%02d",
        F.pmod(F.floor(s / 3600), F.lit(24)),
        F.floor(F.pmod(s, F.lit(3600)) / 60),
        F.pmod(s, F.lit(60)),
    )
    return F.when(sec.isNotNull(), text)


def minutes_text(sec: Column) -> Column:
    s = _whole(sec)
    return F.when(
        sec.isNotNull(), F.format_string("%d分%02d秒", F.floor(s / 60), F.pmod(s, F.lit(60)))
    )


def in_hours(hour: Column, start: int, end: int) -> Column:
    """``[start, end)`` on the clock; an end before the start wraps past midnight."""
    if start <= end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)
