"""Numbers out of text and money."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

PRICE = "decimal(10,2)"
# Exact intermediate for cents.
CENTS = "decimal(18,4)"
# The contract path and the SQL path convert at different rates.
USD_TO_CAD = "1.35"
USD_TO_CAD_SQL = "1.4250"

_OUTER = r"[\s\p{Cntrl}]*"
_WHOLE_NUMBER = rf"^{_OUTER}([+-]?\d+)(?:\.\d*)?{_OUTER}$"
_ONLY_FRACTION = rf"^{_OUTER}[+-]?\.\d*{_OUTER}$"


def whole_number(col: Column) -> Column:
    """Integer out of text. A fraction is cut off ('2.5' is 2, '.5' is 0); anything else is NULL."""
    digits = F.nullif(F.regexp_extract(col, _WHOLE_NUMBER, 1), F.lit(""))
    return F.when(digits.isNotNull(), digits.try_cast("int")).when(col.rlike(_ONLY_FRACTION), F.lit(0))


def price(col: Column) -> Column:
    """Price out of text, rounded half up to cents; NULL when it is no number or too large."""
    return F.trim(col).try_cast(PRICE)


def rate_to_cad(currency: Column, usd_to_cad: str) -> Column:
    """1 for CAD, the given rate for USD, NULL (never a guess) for the rest."""
    code = F.upper(F.trim(currency))
    return F.when(code == "USD", F.lit(Decimal(usd_to_cad))).when(code == "CAD", F.lit(Decimal(1)))


def cents_to_cad(cents: Column, rate: Column) -> Column:
    """Exact cents times rate, rounded half up."""
    return (cents.try_cast(CENTS) * F.lit(Decimal("0.01")) * rate).try_cast(PRICE)
