"""Media times: seconds as doubles, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(seconds: Column) -> Column:
    """Whole milliseconds, halves up."""
    return F.floor(seconds * 1000 + 0.5).cast("long")


def round_seconds(seconds: Column) -> Column:
    return F.floor(seconds * 1000 + 0.5) / F.lit(1000.0)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _part(c: Column) -> Column:
    """A number as scripts read it: blanks count as zero, other text as null."""
    text = F.trim(c)
    return F.when(text == "", 0.0).when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def parse_timestamp(text: Column) -> Column:
    """[hours:]minutes:seconds, with a comma or point before the fraction; null if it isn't one."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^([^,]*),", "$1."), ":")
    n = F.size(parts)
    seconds, minutes = _part(F.element_at(parts, -1)), _part(F.try_element_at(parts, F.lit(-2)))
    hours = F.when(n == 3, _part(F.element_at(parts, 1))).otherwise(F.lit(0.0))
    return F.when(n.isin(2, 3), hours * 3600 + minutes * 60 + seconds)


def format_timestamp(seconds: Column, mark: str = ".") -> Column:
    """HH:MM:SS.mmm; negative and missing times are zero and milliseconds are cut off."""
    t = F.greatest(F.lit(0.0), F.coalesce(seconds, F.lit(0.0)))
    two = lambda c: F.when(c < 10, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    hours, minutes, secs = F.floor(t / 3600), F.floor((t % 3600) / 60), F.floor(t % 60)
    ms = F.floor((t - F.floor(t)) * 1000)
    return F.concat(two(hours), F.lit(":"), two(minutes), F.lit(":"), two(secs), F.lit(mark), F.lpad(ms.cast("string"), 3, "0"))


def iso_duration(text: Column) -> Column:
    """ISO-8601 durations in seconds; a year is 365 days and a month 30; null if nothing is given."""
    shape = r"(?i)^P(?:([0-9.]+)Y)?(?:([0-9.]+)M)?(?:([0-9.]+)W)?(?:([0-9.]+)D)?(?:T(?:([0-9.]+)H)?(?:([0-9.]+)M)?(?:([0-9.]+)S)?)?$"
    body = F.trim(text)
    worth = [365 * 86400, 30 * 86400, 7 * 86400, 86400, 3600, 60, 1]
    total = F.lit(0.0)
    for at, w in enumerate(worth, 1):
        total = total + F.coalesce(F.nullif(F.regexp_extract(body, shape, at), F.lit("")).try_cast("double"), F.lit(0.0)) * w
    return F.when(body.rlike(shape) & (total > 0), total)


def duration_value(text: Column) -> Column:
    """A number of seconds (of milliseconds beyond 100000) or an ISO duration."""
    number = F.when(F.trim(text).rlike(r"^[0-9]+\.?[0-9]*$"), F.trim(text).try_cast("double"))
    return F.coalesce(F.when(number > 100_000, number / 1000).when(number > 0, number), iso_duration(text))
