"""Text cleaning and value lookups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean(col: Column) -> Column:
    """Without outer spaces; nothing left means NULL."""
    return F.nullif(F.trim(col), F.lit(""))


def clean_upper(col: Column) -> Column:
    return clean(F.upper(col))


def clean_lower(col: Column) -> Column:
    return clean(F.lower(col))


def sku(col: Column) -> Column:
    """One spelling for product codes: TH1001, th-1001 and TH-1001 are all TH-1001."""
    code = clean_upper(col)
    undashed = code.startswith("TH") & ~code.startswith("TH-")
    return F.when(undashed, F.concat(F.lit("TH-"), F.substr(code, F.lit(3)))).otherwise(code)


def loyalty_number(col: Column) -> Column:
    """Customer number out of a store loyalty code (L000123 is 000123)."""
    code = clean_upper(col)
    return F.when(code.startswith("L"), clean(F.substr(code, F.lit(2)))).otherwise(code)


def padded_number(col: Column, width: int = 6) -> Column:
    """Number as text with leading zeros. A number wider than `width` keeps all its digits."""
    text = col.cast("string")
    return F.when(F.length(text) > width, text).otherwise(F.lpad(text, width, "0"))


def translate_value(col: Column, table: dict[str, str]) -> Column:
    """The value `table` gives for `col`, or `col` itself where it has none."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)


def name_list(**conditions: Column) -> Column:
    """Names of the conditions that hold, joined by commas in the order given ('' if none)."""
    return F.concat_ws(",", *[F.when(holds, F.lit(name)) for name, holds in conditions.items()])


def unparsed(**values: Column) -> Column:
    """Names of the values that are NULL, or NULL when all are there."""
    found = name_list(**{name: value.isNull() for name, value in values.items()})
    return F.nullif(found, F.lit(""))
