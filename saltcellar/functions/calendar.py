"""United States public holidays as a column expression, by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONDAY, THURSDAY, FRIDAY = 0, 3, 4
JUNETEENTH_SINCE = 2021

# Holidays on one date (month, day) and on a weekday of a month.
DATE_HOLIDAYS = {
    "New Year's Day": (1, 1),
    "Juneteenth National Independence Day": (6, 19),
    "Independence Day": (7, 4),
    "Veterans Day": (11, 11),
    "Christmas Day": (12, 25),
}
WEEKDAY_HOLIDAYS = {  # month, weekday, first and last possible day of the month
    "Martin Luther King Jr. Day": (1, MONDAY, 15, 21),
    "Washington's Birthday": (2, MONDAY, 15, 21),
    "Memorial Day": (5, MONDAY, 25, 31),
    "Labor Day": (9, MONDAY, 1, 7),
    "Columbus Day": (10, MONDAY, 8, 14),
    "Thanksgiving Day": (11, THURSDAY, 22, 28),
}


def _on_date(day: Column) -> Column:
    name = F.lit(None).cast("string")
    for holiday, (month, number) in DATE_HOLIDAYS.items():
        hit = (F.month(day) == month) & (F.dayofmonth(day) == number)
        if holiday.startswith("Juneteenth"):
            hit = hit & (F.year(day) >= JUNETEENTH_SINCE)
        name = F.when(hit, holiday).otherwise(name)
    return name


def holiday_name(day: Column) -> Column:
    """The holiday of a date; a date holiday on a weekend is also observed on the near workday."""
    name = _on_date(day)
    for holiday, (month, weekday, first, last) in WEEKDAY_HOLIDAYS.items():
        hit = (F.month(day) == month) & (F.weekday(day) == weekday) & F.dayofmonth(day).between(first, last)
        name = F.when(hit, holiday).otherwise(name)
    observed = F.when(F.weekday(day) == FRIDAY, _on_date(F.date_add(day, 1))).when(
        F.weekday(day) == MONDAY, _on_date(F.date_sub(day, 1))
    )
    return F.coalesce(name, F.concat(observed, F.lit(" (observed)")))
