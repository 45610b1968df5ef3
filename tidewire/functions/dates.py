"""Date parsing on columns; everything is UTC, and what does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import col

#: The forms in which pages show a day; numbered groups are its parts.
SHOWN_DAY_FIRST = r"\b(\d{1,2})[/.-](\d{1,2})[/.-](20\d{2})(?:\s+(\d{1,2}):(\d{2}))?\b"
SHOWN_YEAR_FIRST = r"\b(20\d{2})[/.-](\d{1,2})[/.-](\d{1,2})\b"
CLOCK = r"(\d{1,2}):(\d{2})"
#: The marks of the halves of a day, after noon and before it.
AFTER_NOON, BEFORE_NOON = "م", "ص"


def _parts(raw: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract(raw, pattern, i + 1).try_cast("int") for i in range(n)]


def _midnight(y: Column, m: Column, d: Column) -> Column:
    """Null unless the numbers are a day."""
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd"))


def _plus(day: Column, hour: Column, minute: Column) -> Column:
    """The day at that clock; null if there is no such time."""
    h, m = F.coalesce(hour, F.lit(0)), F.coalesce(minute, F.lit(0))
    return F.when((h < 24) & (m < 60), day + F.make_dt_interval(hours=h, mins=m))


def iso(raw: Column | str) -> Column:
    """ISO 8601 from the day on; without a zone it is UTC."""
    t = F.trim(col(raw))
    return F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}")), t).try_cast("timestamp")


def local_naive(raw: Column | str, hours: int = 3) -> Column:
    """ISO 8601; without a zone it is ``hours`` ahead of UTC."""
    t = F.trim(col(raw))
    # only a time without a zone can take one more
    bare = F.coalesce(iso(F.concat(t, F.lit("Z"))), iso(F.concat(t, F.lit("T00:00:00Z"))))
    return F.coalesce(bare - F.make_dt_interval(hours=F.lit(hours)), iso(t))


def day_first(raw: Column | str) -> Column:
    """The first dd/mm/yyyy [hh:mm] in a text."""
    d, m, y, hour, minute = _parts(col(raw), SHOWN_DAY_FIRST, 5)
    return _plus(_midnight(y, m, d), hour, minute)


def year_first(raw: Column | str) -> Column:
    """The first yyyy/mm/dd in a text."""
    return _midnight(*_parts(col(raw), SHOWN_YEAR_FIRST, 3))


def clock_hour(raw: Column | str) -> Column:
    """The hour of hh:mm, by the Arabic mark of the half day if there is one."""
    (hour,) = _parts(col(raw), CLOCK, 1)
    has = lambda mark: F.contains(col(raw), F.lit(mark))
    return F.when(has(AFTER_NOON), F.when(hour < 12, hour + 12).otherwise(hour)).when(has(BEFORE_NOON) & (hour == 12), 0).otherwise(hour)


def day_and_clock(raw: Column | str) -> Column:
    """yyyy/mm/dd, at the hh:mm that stands behind it if there is one."""
    _, minute = _parts(col(raw), CLOCK, 2)
    day = year_first(raw)
    return F.coalesce(_plus(day, clock_hour(raw), minute), day)


def feed_date(raw: Column | str) -> Column:
    """RFC 822 as feeds write it, else ISO."""
    t = F.regexp_replace(F.trim(col(raw)), r"^[A-Za-z]{3},\s*", "")
    zone = F.regexp_replace(F.regexp_replace(t, r"\b(GMT|UTC|UT|Z)$", "+0000"), r"\s+", " ")
    return F.coalesce(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm Z")), F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss")), iso(raw))


def lastmod(raw: Column | str) -> Column:
    """A sitemap's lastmod: ISO with at least the day; nothing else."""
    return iso(raw)


def edition_date(slug: Column | str) -> Column:
    """dd-mm-yyyy as a date."""
    found = F.regexp_extract(col(slug), r"^(\d{2})-(\d{2})-(\d{4})$", 0)
    return F.to_date(F.try_to_timestamp(F.when(found != "", found), F.lit("dd-MM-yyyy")))
