"""Market-calendar rules as closed-form expressions on a date column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.numeric import flag

# Fixed values of the calendar rules.
MEETING_MONTHS = (1, 3, 5, 6, 7, 9, 11, 12)
SEASON_MONTHS = (1, 4, 7, 10)
SEASON_FIRST_DAY, SEASON_DAYS = 15, 21
MONDAY, THURSDAY, FRIDAY = 0, 3, 4


def _month_start(day: Column, months: int) -> Column:
    return F.add_months(F.trunc(day, "month"), months)


def meeting_of_month(day: Column, months: int = 0) -> Column:
    """Meeting date of the month `months` away: six days after the first
    Wednesday, in listed months only."""
    start = _month_start(day, months)
    first_wednesday = F.next_day(F.date_sub(start, 1), "Wed")
    return F.when(F.month(start).isin(*MEETING_MONTHS), F.date_add(first_wednesday, 6))


def meetings(day: Column, start: Column, end: Column) -> dict[str, Column]:
    """Meeting flag and day counts to the next and since the last meeting.

    Listed months are at most two apart, so three months hold the neighbour.
    Meetings outside start..end do not exist.
    """
    inside = [
        F.when(m.between(start, end), m) for m in (meeting_of_month(day, k) for k in range(-2, 3))
    ]
    following = F.least(*[F.when(m >= day, m) for m in inside[2:]])
    previous = F.greatest(*[F.when(m <= day, m) for m in inside[:3]])
    return {
        "fed_meeting": flag(inside[2] == day),
        "days_to_fed_meeting": F.datediff(following, day).cast("double"),
        "days_since_fed_meeting": F.datediff(day, previous).cast("double"),
    }


def listed_meetings(day: Column, dates: list) -> dict[str, Column]:
    """The same columns from an explicit list of meeting dates."""
    known = F.array(*[F.lit(d) for d in sorted(dates)])
    following = F.array_min(F.filter(known, lambda m: m >= day))
    previous = F.array_max(F.filter(known, lambda m: m <= day))
    return {
        "fed_meeting": flag(F.array_contains(known, day)),
        "days_to_fed_meeting": F.datediff(following, day).cast("double"),
        "days_since_fed_meeting": F.datediff(day, previous).cast("double"),
    }


def earnings_season(day: Column) -> Column:
    """Three weeks from the 15th of each quarter's first month."""
    spans = []
    for months in (0, -1):
        start = _month_start(day, months)
        opens = F.date_add(start, SEASON_FIRST_DAY - 1)
        within = day.between(opens, F.date_add(opens, SEASON_DAYS - 1))
        spans.append(F.month(start).isin(*SEASON_MONTHS) & within)
    return flag(reduce(lambda a, b: a | b, spans))


def releases(day: Column) -> dict[str, Column]:
    number, weekday = F.dayofmonth(day), F.weekday(day)
    return {
        "employment_report": flag((weekday == FRIDAY) & (number <= 7)),
        "cpi_release": flag(number.between(10, 15)),
        "gdp_release": flag(number.between(25, 31)),
        "jobless_claims": flag(weekday == THURSDAY),
    }


def market_holiday(day: Column) -> Column:
    month, number = F.month(day), F.dayofmonth(day)
    fixed = [(1, 1), (7, 4), (12, 25)]
    on_fixed = reduce(lambda a, b: a | b, [(month == m) & (number == d) for m, d in fixed])
    thanksgiving = (month == 11) & (F.weekday(day) == THURSDAY) & number.between(22, 28)
    return flag(on_fixed | thanksgiving)


def half_day(day: Column) -> Column:
    month, number = F.month(day), F.dayofmonth(day)
    after_thanksgiving = (month == 11) & (F.weekday(day) == FRIDAY) & number.between(23, 29)
    return flag(after_thanksgiving | ((month == 12) & (number == 24)))


def options_expiration(day: Column) -> Column:
    return flag((F.weekday(day) == FRIDAY) & F.dayofmonth(day).between(15, 21))
