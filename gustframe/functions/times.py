"""Times: stamps, leads, ages and calendar parts. Microseconds are whole numbers throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustframe.functions.nulls import col

HOUR, DAY = 3_600_000_000, 86_400_000_000


def micros(c: Column | str) -> Column:
    """Microseconds since 1970; for stamps with or without a zone (UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def seconds(c: Column | str) -> Column:
    """Whole seconds since 1970, downwards."""
    return F.floor(micros(c) / F.lit(1_000_000)).cast("long")


def stamp(c: Column | str, pattern: str = "yyyyMMddHHmm") -> Column:
    return F.try_to_timestamp(col(c).cast("string"), F.lit(pattern))


def in_utc(local: Column | str, zone: str) -> Column:
    """A wall clock's stamp in a zone, as the moment it names: of the hour that comes twice the first, of the skipped one an hour later."""
    return F.to_utc_timestamp(col(local), zone)


def local_time(moment: Column | str, zone: str) -> Column:
    return F.from_utc_timestamp(col(moment), zone)


def valid_time(start: Column | str, lead_hours: Column | str) -> Column:
    return F.timestamp_micros(micros(start) + col(lead_hours).cast("long") * HOUR)


def age_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole days between two stamps, downwards."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(DAY)).cast("long")


def age_years(later: Column | str, earlier: Column | str, days: float = 365.25) -> Column:
    """Whole days as years; evaluations take years of 365 days instead."""
    return age_days(later, earlier) / F.lit(days)


def years_since(c: Column | str, today: Column | None = None, days: float = 365.0) -> Column:
    """Years from a date to today, or to a given day where results have to stay the same."""
    return F.datediff(F.current_date() if today is None else today, F.to_date(col(c))) / F.lit(days)


def commissioned(first: Column | str, years: Column | str) -> Column:
    """The date `years` before a series begins."""
    return F.to_date(F.timestamp_micros((micros(first) - col(years) * 365.25 * DAY).cast("long")))


def day_after(c: Column | str, days: int, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.date_add(F.to_date(col(c)), days), pattern)


def in_days(c: Column | str, first: str | None = None, last: str | None = None) -> Column:
    """first <= c, and c on or before the whole of the day `last`."""
    out = F.lit(True)
    if first:
        out = out & (col(c) >= F.lit(first).cast("timestamp_ntz").cast("timestamp"))
    if last:
        out = out & (col(c) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))
    return out


def cyclic(c: Column | str) -> dict[str, Column]:
    """Sine and cosine of the hour in a day and the month in a year."""
    import math

    h, m = F.hour(col(c)) * (2 * math.pi / 24), F.month(col(c)) * (2 * math.pi / 12)
    return {"hour_sin": F.sin(h), "hour_cos": F.cos(h), "month_sin": F.sin(m), "month_cos": F.cos(m)}
