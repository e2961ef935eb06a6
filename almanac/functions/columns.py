"""Column helpers.  All are built-in expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.sources.schemas import DIMENSIONS, OUT_NOW, TBA, TODAY

#: Unicode white space that a keyword loses at its ends; Spark's own trim knows the blank only.
SPACES = "\t\n\x0b\x0c\r \xa0                　﻿"


def keyword(query: str) -> str:
    """The search text as it is compared: trimmed and in lower case."""
    return query.strip(SPACES).lower()


def contains_keyword(query: str, *fields: str, arrays: tuple[str, ...] = ()) -> Column:
    """Whether one of the fields, or an element of the arrays, has the keyword inside; always true for a blank one."""
    wanted = keyword(query)
    if not wanted:
        return F.lit(True)
    hit = lambda x: F.coalesce(F.contains(F.lower(x), F.lit(wanted)), F.lit(False))
    found = F.lit(False)
    for name in fields:
        found = found | hit(F.col(name))
    for name in arrays:
        found = found | F.coalesce(F.exists(name, hit), F.lit(False))
    return found


def mean_score(*scores: Column | str) -> Column:
    """Mean of the four dimensions, exact; null if one is."""
    total = sum((F.col(s) if isinstance(s, str) else s for s in scores or DIMENSIONS), F.expr("cast(0 as decimal(3,1))"))
    return (total * F.expr("cast(0.25 as decimal(3,2))")).cast("decimal(5,3)")


def one_decimal(value: Column) -> Column:
    """A number as text with one decimal, rounded half up."""
    return F.round(value, 1).cast("decimal(6,1)").cast("string")


def label(code: Column | str, labels: dict[str, str]) -> Column:
    """The label of a code; null for an unknown one."""
    pairs = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.try_element_at(pairs, F.col(code) if isinstance(code, str) else code)


def labels_joined(codes: str, labels: dict[str, str], by: str = " · ") -> Column:
    return F.array_join(F.transform(codes, lambda c: label(c, labels)), by)


def days_to_release(date: Column | str, as_of: str) -> Column:
    """Whole days until the date begins at UTC+8, rounded up; negative afterwards."""
    there = F.to_date(F.from_utc_timestamp(F.lit(as_of).cast("timestamp"), "Asia/Shanghai"))
    return F.datediff(F.col(date) if isinstance(date, str) else date, there)


def countdown(status: Column | str, date: Column | str, as_of: str) -> Column:
    days = days_to_release(date, as_of)
    status = F.col(status) if isinstance(status, str) else status
    return F.when((status == "development") | days.isNull(), TBA).when(days < 0, OUT_NOW).when(days == 0, TODAY).otherwise(F.concat(F.lit("D-"), days.cast("string")))


def or_else(value: Column | str, other: Column | str) -> Column:
    """The text, unless it is null or empty."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.when(value != "", value), F.col(other) if isinstance(other, str) else other)
