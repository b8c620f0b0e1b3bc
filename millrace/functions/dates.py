"""Strict dates out of text. What is not a real date is NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Date formats of the three sources.
POS_DATE = "MM/dd/yyyy"
SIGNUP_DATE = "dd-MMM-yy"
ISO_DATE = "yyyy-MM-dd"
ISO_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([+-]\d{2}:\d{2}|Z)$"


def pos_date(col: Column) -> Column:
    return F.try_to_date(F.trim(col), POS_DATE)


def signup_date(col: Column) -> Column:
    """18-JAN-22 is 2022-01-18: two-digit years are 2000 to 2099, month names in any case."""
    return F.try_to_date(F.trim(col), SIGNUP_DATE)


def leading_date(col: Column) -> Column:
    """Date in the first ten characters, whatever follows."""
    return F.try_to_date(F.left(col, F.lit(10)), ISO_DATE)


def local_date(col: Column) -> Column:
    """Local date of a complete ISO 8601 time stamp with offset."""
    stamp = F.trim(col)
    return F.when(stamp.rlike(ISO_STAMP), leading_date(stamp))


def file_name_date(name: Column) -> Column:
    """First real date of 2000 to 2100 in a file name as yyyy-MM-dd text: dashed ones first, then plain."""

    def candidates(pattern: str, layout: str) -> Column:
        found = F.regexp_extract_all(name, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda text: F.try_to_date(text, layout))

    dates = F.concat(
        candidates(r"\d{4}-\d{2}-\d{2}", ISO_DATE),
        candidates(r"\d{8}", "yyyyMMdd"),
    )
    in_range = F.filter(dates, lambda day: F.year(day).between(2000, 2100))
    return F.date_format(F.get(in_range, F.lit(0)), ISO_DATE)
