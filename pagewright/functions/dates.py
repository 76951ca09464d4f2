"""Dates as they are written, as the days that they may mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold

# The months.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?"
_DAY = "([0-9]{1,2})(?:st|nd|rd|th)?"


def date_interval(x: Column) -> Column:
    """(first, last): the days that a written date may mean; null where it is none.

    2024-03-05, 5 March 2024 and March 5, 2024 mean a day; 2024-03 and March 2024 a month; 2024 a year. 5/3/2024 and 5.3.2024 may mean
    either order: from the earlier to the later reading, where both are dates. A time behind a date is passed over."""
    t = F.lower(fold(x))
    part = lambda pattern, i: F.nullif(F.regexp_extract(t, f"^{pattern}(?:$|[t ,])", i), F.lit("")).try_cast("int")
    month = lambda pattern, i: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(t, f"^{pattern}(?:$|[t ,])", i)), F.lit(0).cast("long")).cast("int")
    day = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    whole = lambda y, m, d: F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), day(y, m, d))
    one = F.lit(1)

    iso, slashed = "([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", "([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})"
    led, closed, named = f"{_DAY} (?:of )?{_MONTH},? ([0-9]{{4}})", f"{_MONTH} {_DAY},? ([0-9]{{4}})", f"{_MONTH},? ([0-9]{{4}})"
    exact = F.coalesce(whole(part(iso, 1), part(iso, 2), part(iso, 3)), whole(part(led, 3), month(led, 2), part(led, 1)), whole(part(closed, 3), month(closed, 1), part(closed, 2)))
    a, b, y = part(slashed, 1), part(slashed, 2), part(slashed, 3)
    by_day, by_month = whole(y, b, a), whole(y, a, b)
    months = F.coalesce(whole(part(named, 2), month(named, 1), one), whole(part("([0-9]{4})-([0-9]{1,2})", 1), part("([0-9]{4})-([0-9]{1,2})", 2), one))
    year = whole(part("([0-9]{4})", 1), one, one)
    first = F.coalesce(exact, F.least(by_day, by_month), months, year)
    last = F.coalesce(exact, F.greatest(by_day, by_month), F.last_day(months), F.date_sub(F.add_months(year, 12), 1))
    return F.when(first.isNotNull(), F.struct(first.alias("first"), last.alias("last")))


def date_conflicts(claims: DataFrame) -> DataFrame:
    """(page_id, kind, dates, conflict): whether two of a page's dates of a kind cannot mean the same day; claims: (page_id, kind, value).

    Two intervals are apart if the latest beginning lies behind the earliest end, so counts and extremes are enough, which are taken
    before rows are shuffled. Values that are no dates do not count; kinds without any have no row."""
    rows = claims.withColumn("span", date_interval(F.col("value"))).where("span is not null")
    return rows.groupBy("page_id", "kind").agg(F.count("*").alias("dates"), (F.max("span.first") > F.min("span.last")).alias("conflict"))
