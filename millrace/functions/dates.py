"""Date expressions; every rule that compares with today takes ``as_of``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import vocab as V
from millrace.functions.text import let, or_empty, strip


def loose_date(c: Column) -> Column:
    """Date of a loosely written day or month; a day that its month lacks counts as the
    first; null if there is none."""
    s = strip(or_empty(c))
    s = F.replace(F.replace(F.replace(s, F.lit("年"), F.lit("-")), F.lit("月"), F.lit("-")), F.lit("日"), F.lit(""))
    return let(F.regexp_replace(F.regexp_replace(s, r"(?Us)[T\s].*$", ""), r"^[ ./]+|[ ./]+$", ""), _date_of)


def _date_of(s: Column) -> Column:
    whole = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$"
    month = r"^(\d{4})[-/](\d{1,2})$"
    part = r"(20\d{2})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?"

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    take = lambda x, p, i: F.regexp_extract(x, p, i)
    ten, seven = F.left(s, F.lit(10)), F.left(s, F.lit(7))
    full = lambda x: F.when(F.rlike(x, F.lit(whole)), made(take(x, whole, 1), take(x, whole, 3), take(x, whole, 4)))
    half = lambda x: F.when(F.rlike(x, F.lit(month)), made(take(x, month, 1), take(x, month, 2), F.lit("1")))
    day = F.coalesce(F.nullif(take(s, part, 3), F.lit("")), F.lit("1"))
    found = F.when(F.rlike(s, F.lit(part)), F.coalesce(made(take(s, part, 1), take(s, part, 2), day), made(take(s, part, 1), take(s, part, 2), F.lit("1"))))
    return F.coalesce(full(ten), half(ten), full(seven), half(seven), full(s), half(s), found)


def deadline_scope(c: Column, as_of: date) -> Column:
    """none, expired, soon (within a week) or later; strict form on the first 10 characters."""
    today = F.lit(as_of)
    return let(F.try_to_date(F.left(strip(or_empty(c)), F.lit(10)), "yyyy-M-d"), lambda d: F.when(d.isNull(), "none").when(d < today, "expired").when(d <= F.date_add(today, V.SOON_DAYS), "soon").otherwise("later"))


def deadline_passed(c: Column, as_of: date) -> Column:
    return F.coalesce(loose_date(c) < F.lit(as_of), F.lit(False))


def lookback_days(days: int | None = None, months: int | None = None) -> int:
    return days if days and days > 0 else months * 30 if months and months > 0 else V.LOOKBACK_DAYS


def any_before(dates: list[Column], as_of: date, days: int = V.LOOKBACK_DAYS) -> Column:
    """Whether ANY of the dates lies before the window."""
    cutoff = F.date_sub(F.lit(as_of), max(1, days))
    return F.coalesce(F.least(*dates, F.lit(as_of)) < cutoff, F.lit(False))


def is_stale(dates: list[Column], as_of: date, days: int = V.LOOKBACK_DAYS) -> Column:
    """``any_before`` of dates in loose forms."""
    return any_before([loose_date(c) for c in dates], as_of, days)


def age_date(*dates: Column) -> Column:
    """Latest of the dates that can be read."""
    return F.greatest(*[loose_date(c) for c in dates])


def past_retention(dates: list[Column], as_of: date, days: int = V.RETENTION_DAYS) -> Column:
    return F.coalesce(age_date(*dates) < F.date_sub(F.lit(as_of), days), F.lit(False))


def list_cutoff(as_of: date, months: int = V.LIST_MONTHS) -> Column:
    return F.date_sub(F.lit(as_of), max(1, months * 30))


def target_year(as_of: date) -> int:
    """Graduation year that a season hires for."""
    return as_of.year + 1


def publish_cutoff(as_of: date) -> date:
    return date(target_year(as_of) - 2, 1, 1)


def _years(matches: Column) -> Column:
    return F.filter(F.transform(matches, lambda y: y.try_cast("int")), lambda y: y.isNotNull())


def batch_year(c: Column) -> Column:
    """Largest graduation year written as 2027届, 27届 or 2027应届; else null."""
    found = _years(F.regexp_extract_all(or_empty(c), F.lit(V.BATCH), F.lit(0)))
    return F.array_max(F.transform(found, lambda y: F.when(y < 100, y + 2000).otherwise(y)))


def title_batch_year(c: Column) -> Column:
    """As ``batch_year``, else the smallest bare year of a title."""
    bare = lambda x: F.array_min(_years(F.regexp_extract_all(or_empty(x), F.lit(V.BARE_YEAR), F.lit(1))))
    return let(c, lambda x: F.coalesce(batch_year(x), bare(x)))


def resolve_batch(title: Column, text: Column, existing: Column, as_of: date) -> Column:
    year = F.coalesce(title_batch_year(title), batch_year(text), batch_year(existing), F.lit(target_year(as_of)))
    return F.concat(year.cast("string"), F.lit("届"))


def ticks_date(c: Column) -> Column:
    """Date of .NET ticks (100 ns since year 1); null outside 2000 to 2100."""
    day = F.date_add(F.lit("0001-01-01").cast("date"), F.floor(c / 864000000000).cast("int"))
    return F.when(c.between(600_000_000_000_000_000, 670_000_000_000_000_000) & F.year(day).between(2000, 2100), day)


def first_iso_date(c: Column) -> Column:
    """First dddd-dd-dd of a text; year 0001 stands for none."""
    d = F.nullif(F.regexp_extract(or_empty(c), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.when(~F.startswith(d, F.lit("0001-")), d)
