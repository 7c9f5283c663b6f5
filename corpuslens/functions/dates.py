"""Column functions over dates and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def temporal_interval(expression: Column, reference: Column) -> Column:
    """(start_date, end_date, precision) of an ISO day, month, year, year range or relative days; else nulls.

    Intervals are half open.  ``reference`` is the date that relative expressions start from.
    """
    e = F.lower(F.trim(F.regexp_replace(expression, r"\s+", " ")))
    day, month, year = e.rlike(r"^\d{4}-\d{2}-\d{2}$"), e.rlike(r"^\d{4}-\d{2}$"), e.rlike(r"^\d{4}$")
    span = e.rlike(r"^\d{4}\s*(-|–|—|to)\s*\d{4}$")
    count = F.regexp_extract(e, r"^(?:last|next) (\d+) days?$", 1)
    last, following = e.rlike(r"^last \d+ days?$"), e.rlike(r"^next \d+ days?$")
    n = F.when(count != "", count).cast("int")
    first = lambda y: F.to_date(F.concat(y, F.lit("-01-01")))
    offset = F.when(e == "today", 0).when(e == "yesterday", -1).when(e == "tomorrow", 1)
    start = (
        F.when(day, F.try_to_date(e)).when(month, F.try_to_date(F.concat(e, F.lit("-01")))).when(year | span, first(F.substring(e, 1, 4)))
        .when(last, F.date_sub(reference, n)).when(following, F.date_add(reference, 1)).when(offset.isNotNull(), F.date_add(reference, offset))
    )
    end = (
        F.when(day, F.date_add(F.try_to_date(e), 1)).when(month, F.add_months(F.try_to_date(F.concat(e, F.lit("-01"))), 1))
        .when(year, F.add_months(first(e), 12)).when(span, F.add_months(first(F.regexp_extract(e, r"(\d{4})$", 1)), 12))
        .when(last, reference).when(following, F.date_add(reference, n + 1)).when(offset.isNotNull(), F.date_add(reference, offset + 1))
    )
    precision = F.when(day, "day").when(month, "month").when(year, "year").when(span, "range").when(last | following | offset.isNotNull(), "relative")
    return F.struct(start.alias("start_date"), end.alias("end_date"), precision.alias("precision"))


def interval_relation(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (
        F.when(e1 < s2, "before").when(s1 > e2, "after").when((s1 == s2) & (e1 == e2), "equal")
        .when((s1 >= s2) & (e1 <= e2), "during").when((s1 <= s2) & (e1 >= e2), "contains").otherwise("overlaps")
    )
