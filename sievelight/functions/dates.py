"""Date functions; what day it is, is always a parameter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENT_DAYS, OLD_DAYS = 730, 1460


def parsed(text: Column) -> Column:
    """The first ``20YY-M-D`` (also with ``./年月``) as a date; null if it is none."""
    pattern = r"(20\d{2})[-./年](\d{1,2})[-./月](\d{1,2})"
    year, month, day = (F.regexp_extract(F.coalesce(text, F.lit("")), pattern, k) for k in (1, 2, 3))
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def from_url(url: Column) -> Column:
    """The date in a path ``/YYYY/MMDD/``."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*", 0)
    parts = [F.regexp_extract(path, r"/(20\d{2})/(\d{2})(\d{2})/", k) for k in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")


def age_days(day: Column, as_of: date) -> Column:
    return F.datediff(F.lit(as_of), day)


def recency_bonus(day: Column, as_of: date) -> Column:
    """Falls with the logarithm of the age; 0.2 for the future, 0 for none."""
    days = age_days(day, as_of)
    return F.when(day.isNull(), 0.0).when(days < 0, 0.2).otherwise(F.greatest(F.lit(0.0), F.lit(1.5) - F.log10((days + 1).cast("double"))))


def deadline_bonus(day: Column, as_of: date) -> Column:
    days = F.datediff(day, F.lit(as_of))
    return F.when(day.isNull(), 0.0).when(days < 0, -1.2).when(days <= 14, 1.0).when(days <= 45, 0.4).otherwise(0.0)


def scope_score(day: Column, title: Column, scope: str | None, as_of: date) -> Column:
    """Bonus and penalty of a time scope: a year, ``current``, ``recent_2y`` or ``historical``."""
    if not scope:
        return F.lit(0.0)
    recency, age = recency_bonus(day, as_of), age_days(day, as_of)
    if scope.isdigit():
        return F.when(F.contains(title, F.lit(scope)), 1.5).otherwise(0.0) + F.when(F.date_format(day, "yyyy-MM-dd").startswith(scope), 1.2).otherwise(0.0)
    penalty = F.when(age > OLD_DAYS, -8.0).when(age > CURRENT_DAYS, -3.5).otherwise(0.0)
    if scope == "current":
        return F.when(age <= CURRENT_DAYS, F.lit(2.4) + recency * 1.8).otherwise(recency * 0.6) + penalty
    if scope == "recent_2y":
        return F.when(age <= CURRENT_DAYS, F.lit(1.6) + recency).otherwise(0.0) + penalty
    return -recency if scope == "historical" else F.lit(0.0)
